"""Composite operators (DataFrame → DataFrame)."""
