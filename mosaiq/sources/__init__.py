"""Rasters, graphs and features: readers and writers."""
