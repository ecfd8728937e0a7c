"""Scalar spatial functions over pixels, boxes and tiles, as Spark columns."""
