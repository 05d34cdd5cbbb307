"""Word columns as SQL expressions: words are runs of [^\\x20\\x09-\\x0D]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """array<string> of the words; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), _SEP)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.size(parts) == 0, parts).when(F.element_at(parts, 1) == "", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def word_count(text: Column) -> Column:
    """Number of words, without building more than the split."""
    parts = F.split(F.coalesce(text, F.lit("")), _SEP)
    n = F.size(parts)
    head = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    tail = F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (n - head - tail).cast("long")
