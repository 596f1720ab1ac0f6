"""geoloom: spatial analytics on plain Spark DataFrames."""

__version__ = "0.1.0"
