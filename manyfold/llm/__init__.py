"""Operators of a training-data pipeline.  Nothing else in manyfold imports this subpackage."""
