"""Spark-native analysis of trial-level experiment tables and hurdle-model draws."""
