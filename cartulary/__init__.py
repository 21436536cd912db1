"""Cartulary: evidence analytics over document collections, on PySpark DataFrames."""

__version__ = "0.1.0"
