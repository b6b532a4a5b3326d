"""Bring a table to the state of a source: differences, counts, the new table, and sampled verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import numbered


def bits_equal(a: Column, b: Column, kind: str) -> Column:
    """Null-safe equality; of floats by their shortest text, so that zero and negative zero differ and not-a-number equals itself."""
    if kind in ("double", "float"):
        return a.cast("string").eqNullSafe(b.cast("string"))
    return a.eqNullSafe(b)


def classify(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, action, source's columns): new, changed, removed or unchanged, by one full outer join on the key."""
    cols = [c for c in target.columns if c != key]
    kinds = dict(target.dtypes)
    s = source.select(key, F.lit(True).alias("__s"), *(F.col(c).alias(f"s_{c}") for c in cols))
    t = target.select(key, F.lit(True).alias("__t"), *(F.col(c).alias(f"t_{c}") for c in cols))
    same = F.lit(True)
    for c in cols:
        same = same & bits_equal(F.col(f"s_{c}"), F.col(f"t_{c}"), kinds[c])
    action = F.when(F.col("__t").isNull(), "new").when(F.col("__s").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return s.join(t, key, "full_outer").select(key, action.alias("action"), *(F.col(f"s_{c}").alias(c) for c in cols))


def report(classified: DataFrame) -> DataFrame:
    """(upserted, deleted, unchanged)."""
    n = lambda *a: F.count_if(F.col("action").isin(*a))
    return classified.agg(n("new", "changed").alias("upserted"), n("removed").alias("deleted"), n("unchanged").alias("unchanged"))


def apply(target: DataFrame, classified: DataFrame, key: str) -> DataFrame:
    """The new target: what is left unchanged, and what is set."""
    gone = classified.where("action <> 'unchanged'").select(key)
    return target.join(gone, key, "left_anti").unionByName(classified.where(F.col("action").isin("new", "changed")).select(*target.columns))


def events(classified: DataFrame, key: str, after: int = 0) -> DataFrame:
    """(seq, op, key, columns) of the differences: dense numbers after ``after``, in the order of the keys."""
    d = classified.where("action <> 'unchanged'").withColumn("op", F.when(F.col("action") == "removed", 2).otherwise(1)).drop("action")
    return numbered(d, key, "seq", after).select("seq", "op", key, *[c for c in classified.columns if c not in (key, "action")])


def verify(source: DataFrame, target: DataFrame, key: str, value: str, sample: int, order: Column) -> DataFrame:
    """(source_rows, target_rows, checked, missing, mismatches): counts of all, and a sample of the source's rows looked up.

    The sample is the ``sample`` rows that come first by ``order``, an expression of the key.
    """
    chosen = source.withColumn("__o", order).orderBy("__o", key).limit(sample).select(key, F.col(value).alias("__s"))
    met = chosen.join(target.select(key, F.col(value).alias("__t"), F.lit(True).alias("__in")), key, "left")
    found = met.agg(
        F.count("*").alias("checked"), F.count_if(F.col("__in").isNull()).alias("missing"),
        F.count_if(F.col("__in").isNotNull() & ~bits_equal(F.col("__s"), F.col("__t"), dict(source.dtypes)[value])).alias("mismatches"),
    )
    counts = source.agg(F.count("*").alias("source_rows")).crossJoin(target.agg(F.count("*").alias("target_rows")))  # one row each
    return counts.crossJoin(found)
