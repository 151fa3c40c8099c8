"""Queries over the sample tables, each with an equivalent SQL text."""

from .registry import ORACLES, QUERIES  # noqa: F401
from . import associations, documents, fairness, privacy, quality, tables  # noqa: F401
