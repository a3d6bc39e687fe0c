"""Reversible masking of personal data on Spark."""
