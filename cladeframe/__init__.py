"""Keyed-matrix analytics on Spark: many studies' gene x branch matrices held as long DataFrames."""

__version__ = "0.1.0"
