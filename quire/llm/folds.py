"""Held-out folds by a checksum of the document id."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(key: Column, folds: int, fold: int) -> Column:
    """True for the rows whose crc32(key as text) leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
