"""Query corpora: strata, samples and new numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import numbered

BUDGETS = {"random": 2, "grayscale": 6, "near_threshold": 6, "near_black": 6}  # shares of n: n / 2, n / 6, ...


def shuffled(key: Column, seed: int) -> Column:
    """An order that looks random and that other engines can make too."""
    return F.pmod(key.cast("long") * 7919 + seed, F.lit(65537))


def stratified(rows: DataFrame, n: int, seed: int, key: str, kind: str = "kind") -> DataFrame:
    """A sample of each kind: its budget, one at least; kinds without rows are left out. Each task sends its first rows of a kind only."""
    order = shuffled(F.col(key), seed)
    parts = [rows.where(F.col(kind) == name).orderBy(order, key).limit(max(n // part, 1)) for name, part in BUDGETS.items()]
    return reduce(DataFrame.unionAll, parts)


def systematic(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Every k-th row in the order of the key, ``n`` at most."""
    step = max(rows.count() // n, 1)
    return numbered(rows, key, "__r").where(F.pmod(F.col("__r") - 1, F.lit(step)) == 0).where(F.col("__r") <= n * step).drop("__r")


def subsample(rows: DataFrame, n: int, seed: int, key: str, name: str) -> DataFrame:
    """``n`` rows that look random, with new ids from 1 in the order of the key."""
    return numbered(rows.withColumn("__o", shuffled(F.col(key), seed)).orderBy("__o", key).limit(n).drop("__o"), key, name)
