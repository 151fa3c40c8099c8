"""Readers, writers and clean-up of missing values."""
