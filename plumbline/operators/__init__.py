"""Checks and comparisons: DataFrames in, a DataFrame of measurements and verdicts out."""
