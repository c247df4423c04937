"""Temporal assertion analytics as Spark DataFrame transformations."""
