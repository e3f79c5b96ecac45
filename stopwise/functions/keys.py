"""Stable keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(text: Column) -> Column:
    """Signed 64-bit hash of an id, equal in every run."""
    return F.xxhash64(text)
