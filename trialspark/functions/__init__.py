"""Scalar functions expressed as Spark columns."""
