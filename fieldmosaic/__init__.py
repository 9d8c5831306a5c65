"""Crop-sample learning and tile mosaics as Spark DataFrame operators."""
