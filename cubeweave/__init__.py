"""Labelled cubes on Spark."""
