"""wardframe: clinical time-series analytics as PySpark DataFrame functions."""

from wardframe.session import checkpoint_root, get_session

__all__ = ["checkpoint_root", "get_session"]
