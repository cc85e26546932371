"""Scalar and aggregate expressions, all built from Spark SQL functions."""
