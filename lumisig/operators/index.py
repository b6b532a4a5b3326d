"""The searchable index as three tables: live images, posting lists, and how many images each list has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, haar
from ..schema import CHUNK_SLOTS, FULL, Geometry


def live(images: DataFrame, g: Geometry = FULL) -> DataFrame:
    """(post_id, slot, a1..a3 float, gray, buckets) of ``images`` (post_id, avglf1..3, coefs or sig, optionally slot).

    Grayscale images have buckets of their first channel only. Equal scores go to the
    earlier slot: the post's id unless a slot is given, as after later events.
    """
    coefs = F.col("coefs") if "coefs" in images.columns else codec.decode_blob(F.col("sig"), g)
    slot = F.col("slot") if "slot" in images.columns else F.col("post_id")
    d = images.select("post_id", slot.cast("long").alias("slot"), "avglf1", "avglf2", "avglf3", coefs.alias("coefs"))
    per_channel = F.transform("coefs", lambda cs, c: F.transform(cs, lambda x: haar.bucket_index(c, x, g.pixels)))
    gray = haar.is_grayscale(F.col("avglf2"), F.col("avglf3"))
    return d.select(
        "post_id", "slot", *(F.col(f"avglf{i}").cast("float").alias(f"a{i}") for i in (1, 2, 3)), gray.alias("gray"),
        F.array_distinct(F.flatten(F.when(gray, F.slice(per_channel, 1, 1)).otherwise(per_channel))).alias("buckets"),
    )


def postings(alive: DataFrame) -> DataFrame:
    """(bucket, post_id, slot): one row for each coefficient of each image."""
    return alive.select(F.explode("buckets").alias("bucket"), "post_id", "slot")


def census(alive: DataFrame) -> DataFrame:
    """(bucket, images): sums are combined before the shuffle, so that it carries a row a bucket and task at most."""
    return alive.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("images"))


def write(images: DataFrame, path: str, g: Geometry = FULL) -> None:
    """Store the index: lists sorted by bucket, so that a query's buckets are found by their files' statistics."""
    alive = live(images, g)
    alive.write.mode("overwrite").parquet(f"{path}/live")
    kept = images.sparkSession.read.parquet(f"{path}/live")
    postings(kept).repartitionByRange("bucket").sortWithinPartitions("bucket", "slot").write.mode("overwrite").parquet(f"{path}/postings")
    census(kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/census")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live images, census and posting lists as they were stored."""
    live_, counted, posts = (spark.read.parquet(f"{path}/{name}") for name in ("live", "census", "postings"))
    return live_, counted, posts


def later(counted: DataFrame, added: DataFrame, gone: DataFrame) -> DataFrame:
    """A census after images were ``added`` and others are ``gone``, without counting the rest again."""
    sums = counted.unionByName(census(added)).unionByName(census(gone).withColumn("images", -F.col("images")))
    return sums.groupBy("bucket").agg(F.sum("images").alias("images"))


def stats(slots: DataFrame) -> DataFrame:
    """(live, tombstones, chunks, tombstone_ratio) of ``slots`` (slot, dead boolean)."""
    n, dead = F.count("*"), F.coalesce(F.sum(F.col("dead").cast("long")), F.lit(0))
    return slots.agg(
        (n - dead).alias("live"), dead.alias("tombstones"), F.ceil(n / CHUNK_SLOTS).cast("long").alias("chunks"),
        F.when(n > 0, dead / n).otherwise(0.0).alias("tombstone_ratio"),
    )


def broken(alive: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows by which a kept census differs from the images: empty where the index is sound. A bucket without images counts as absent."""
    kept, anew = counted.where("images <> 0"), census(alive)
    return anew.exceptAll(kept).unionAll(kept.exceptAll(anew))
