"""Data quality, feature tables and model scoring as Spark DataFrames."""

__version__ = "0.1.0"
