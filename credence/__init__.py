"""Interval matching, evidence fusion and graph features on Spark."""
