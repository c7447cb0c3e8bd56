"""Halyard: governed analytics and large-scale table processing on Spark."""

__version__ = "0.1.0"
