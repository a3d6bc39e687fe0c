"""Scalar functions: normalisation, validators, token counts."""
