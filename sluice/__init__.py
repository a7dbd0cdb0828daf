"""Data quality, preparation and governance operators for Spark DataFrames."""
