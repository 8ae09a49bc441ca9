"""Coded audio and other framed signals as Spark tables."""

__version__ = "0.1.0"
