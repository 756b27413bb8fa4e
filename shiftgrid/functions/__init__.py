"""Scalar functions and complex arithmetic as column expressions."""
