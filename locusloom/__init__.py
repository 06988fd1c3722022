"""Interval and sequencing-read analytics as PySpark DataFrame operators."""
