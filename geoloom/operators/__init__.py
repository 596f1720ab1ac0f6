"""Spatial operators as plan builders over DataFrames."""
