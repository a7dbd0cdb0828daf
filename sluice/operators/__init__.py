"""Operators: plain functions that take DataFrames and return DataFrames."""
