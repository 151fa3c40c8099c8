import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import odd_documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows with further columns; the rows come twice as a list."""
    return odd_documents.frame(spark)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return odd.limit(0)
