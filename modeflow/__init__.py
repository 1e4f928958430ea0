"""Mobility analytics on Spark: sensor points to sessions, windows, features, labels, models and shares."""
