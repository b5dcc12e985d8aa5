"""hearlog: listening-history analytics as Spark DataFrame functions."""

from hearlog.params import Params

__all__ = ["Params"]
