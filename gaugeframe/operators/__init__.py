"""Readiness metrics: each takes a DataFrame and returns a tidy DataFrame."""
