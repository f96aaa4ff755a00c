"""Vocalith: speech and text feature tables, and data-quality operators, on Spark DataFrames."""

__version__ = "0.1.0"
