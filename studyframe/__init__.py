"""Spark DataFrame operators for repeated-measures study data."""
