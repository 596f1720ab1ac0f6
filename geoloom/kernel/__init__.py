"""Planar geometry in plain Python and NumPy; knows nothing of Spark."""
