"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffled


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) joined with the smallest v of each u. The minima are written first, so that
    both sides of the join are plain exchanges and a hub's rows can be split among tasks."""
    lows = materialize(pairs.groupBy("u").agg(F.min("v").alias("low")))
    return pairs.join(shuffled(lows), "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges(src, dst)``; component is the smallest node reachable.

    Self links, repeated links and links with a null end are ignored; an empty
    table gives an empty result. Each round is a handful of shuffles of the
    links; the number of rounds grows with the logarithm of the longest chain.
    """
    e = materialize(
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct()
    )
    seen = _state(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialize(
            _toward_minimum(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).where("u <> v").distinct()
        )
        star = _toward_minimum(large)
        e = materialize(
            star.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("low").alias("b")), F.struct(F.col("u").alias("a"), F.col("low").alias("b")))).alias("p"))
            .select("p.a", "p.b")
            .where("a <> b")
            .distinct()
        )
        now = _state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
