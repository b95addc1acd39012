"""Operators of a training-data pipeline: nothing outside this package and the pipeline module uses it."""
