"""Latencies, counters and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import materialize, numbered

QUANTILES = {"p50": 50, "p90": 90, "p99": 99}


def quantiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by..., n, p50, p90, p99, max): recorded values, not interpolated ones. Values are numbered in order over range partitions, so that no task holds a group."""
    key = F.struct(*by, value)
    placed = materialize(numbered(rows.where(F.col(value).isNotNull()).select(key.alias("k")), "k", "i"))
    groups = placed.select(*(F.col(f"k.{c}").alias(c) for c in by), "i", F.col(f"k.{value}").alias("v")).groupBy(*by).agg(F.min("i").alias("f"), F.count("*").alias("n"), F.max("v").alias("max"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.col("f") - 1 + F.expr(f"({p} * n + 99) DIV 100")).alias("i")) for name, p in QUANTILES.items())))
    found = groups.select(*by, "n", "max", wanted.alias("w")).select(*by, "n", "max", "w.name", "w.i").join(placed.select("i", F.col(f"k.{value}").alias("v")), "i")
    found = found.groupBy(*by).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in QUANTILES), F.first("max").alias("max"))
    empty = rows.groupBy(*by).agg(F.count(value).alias("n")).where("n = 0")
    none = F.lit(None).cast(dict(rows.dtypes)[value])
    return found.unionByName(empty.select(*by, F.col("n"), *(none.alias(c) for c in (*QUANTILES, "max"))))


def histogram(rows: DataFrame, value: str, bounds: list[float], *by: str) -> DataFrame:
    """(by..., le, total): how many values are at most each bound, and infinity, as scrapers read histograms."""
    levels = [*bounds, float("inf")]
    counts = rows.groupBy(*by).agg(*(F.count_if(F.col(value) <= x).alias(f"n{i}") for i, x in enumerate(levels)))
    each = F.explode(F.array(*(F.struct(F.lit("+Inf" if x == levels[-1] else f"{x:g}").alias("le"), F.col(f"n{i}").alias("total")) for i, x in enumerate(levels))))
    return counts.select(*by, each.alias("e")).select(*by, "e.le", "e.total")


def counters(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("total"))


def throughput(rows: DataFrame, seconds: float, failed: str = "failed") -> DataFrame:
    """(n, errors, per_second) of calls (failed boolean) made within ``seconds``."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(failed)).alias("errors"), (F.count("*") / F.lit(float(seconds))).alias("per_second"))


def exposition(metrics: DataFrame, name: str, value: str) -> DataFrame:
    """(line): each row in the text format that metric scrapers read, the other columns as labels."""
    labels = [F.concat(F.lit(f'{c}="'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('\\"')), F.lit('"')) for c in metrics.columns if c != value]
    inside = F.concat(F.lit("{"), F.concat_ws(",", *labels), F.lit("}")) if labels else F.lit("")
    return metrics.select(F.concat(F.lit(name), inside, F.lit(" "), F.col(value).cast("string")).alias("line"))
