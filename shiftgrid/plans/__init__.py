"""Whole plans: one-shot tracking, prepared images that are reused, and the registered queries."""
