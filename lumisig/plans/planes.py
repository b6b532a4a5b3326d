"""Small images from the test tables: each embedding of 64 numbers is an 8 x 8 plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import haar
from ..schema import Geometry

#: 8 x 8 pixels, 16 coefficients a channel.
SMALL = Geometry(side=8, keep=16, ties="index")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, r, g, b): grayscale, near-threshold, near-black and colour images by the vector's id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("post_id"), F.transform("embedding", lambda x: (x.cast("double") + 1) * 128).alias("p"))
    at = lambda f: F.transform("p", lambda x, i: F.get("p", F.pmod(f(i), F.lit(64))))
    gray, edge, dark = (F.pmod("post_id", F.lit(n)) == 0 for n in (7, 11, 13))
    second, third = at(lambda i: i + 21), at(lambda i: i * 5 + 7)
    g, b = F.transform(second, lambda x: x * 0.75), F.transform(third, lambda x: x * 0.5)
    twelfth = lambda c: F.transform(c, lambda x: x / 12)
    return e.select(
        "post_id",
        F.when(gray, F.col("p")).when(edge, F.transform("p", lambda x: x + 2)).when(dark, twelfth("p")).otherwise(F.col("p")).alias("r"),
        F.when(gray | edge, F.col("p")).when(dark, twelfth(g)).otherwise(g).alias("g"),
        F.when(gray | edge, F.col("p")).when(dark, twelfth(b)).otherwise(b).alias("b"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, avglf1..3, coefs) of the small images."""
    d = channels(spark, sf_dir).select("post_id", haar.haar_signature(F.col("r"), F.col("g"), F.col("b"), SMALL).alias("s"))
    return d.select("post_id", *(F.get("s.avglf", F.lit(i)).alias(f"avglf{i + 1}") for i in range(3)), F.col("s.sig").alias("coefs"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a change feed: (seq, op, key, value, at)."""
    op = F.when(F.col("event_type") == "error", 2).otherwise(1)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), "value", F.col("ts").cast("timestamp").alias("at"))
