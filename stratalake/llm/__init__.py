"""Operators for large-scale training-data preparation, each a Spark job over whole tables."""
