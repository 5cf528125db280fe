"""Operators of large training-data pipelines, each a Spark job."""
