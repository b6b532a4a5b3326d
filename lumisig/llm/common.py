"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisig.cluster import materialize, scratch_dir

__all__ = ["SPACE", "WORD", "fits", "materialize", "scratch_dir", "shuffled", "sized_broadcast"]

#: ASCII white space: what separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fits(df: DataFrame, limit_rows: int) -> bool:
    """Whether ``df`` has at most ``limit_rows`` rows; reads no more than needed to tell."""
    return df.limit(limit_rows + 1).count() <= limit_rows


def sized_broadcast(df: DataFrame, limit_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if fits(df, limit_rows) else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, never broadcast by Spark's own estimate, which takes a table after an explode to be as small as before it."""
    return df.hint("merge")
