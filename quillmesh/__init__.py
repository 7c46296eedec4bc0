"""Labelled-text analytics on Spark."""
