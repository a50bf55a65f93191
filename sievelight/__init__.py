"""Sievelight: screening, curation and measurement of large text tables on Spark."""

__version__ = "0.1.0"
