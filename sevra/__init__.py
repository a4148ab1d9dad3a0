"""Severity grading and training-data preparation on Spark."""
