"""Operators on training-data tables: splits, percentiles, name mapping, leakage, mixing and spam."""
