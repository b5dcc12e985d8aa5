"""Where plays come from and where tables go."""
