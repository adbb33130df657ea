"""Operators of a training-data pipeline (nothing else in tsfold imports this)."""
