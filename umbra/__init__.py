"""Distributed detection and redaction of personal data on Spark DataFrames."""
