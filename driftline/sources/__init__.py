"""Inputs as DataFrames: observation logs, and the supplied tables seen as such."""
