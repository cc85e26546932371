"""Raster masks, pixel graphs and mosaic statistics on Spark DataFrames."""
