"""Drillhole analytics as Spark jobs over DataFrames."""
