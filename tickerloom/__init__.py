"""Spark-first panel analytics for equity screening: every operator is DataFrame -> DataFrame."""
