"""Whole runs: which operators make up a layer and where its tables go."""
