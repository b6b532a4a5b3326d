"""Requests and answers as tables of JSON: batches of what a web service would take, with its statuses and error messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import MAX_POST_ID, Engine, channel_valid, input_kind
from .functions import codec, haar
from .operators import scoring
from .schema import MAX_LIMIT

QUERY_BODY = "hash string, channels struct<r: array<int>, g: array<int>, b: array<int>>, post_id bigint, limit bigint, min_score double, _bad string"
IMAGE_BODY = "r array<int>, g array<int>, b array<int>, _bad string"
_OPTIONS = {"columnNameOfCorruptRecord": "_bad"}


def _channels_valid(c, pixels: int):
    return channel_valid(c["r"], pixels) & channel_valid(c["g"], pixels) & channel_valid(c["b"], pixels)


def images(engine: Engine, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of ``requests`` (post_id, body): images for ``Engine.upsert``, and (post_id, error). The id is looked at first."""
    d = requests.withColumn("b", F.from_json("body", IMAGE_BODY, _OPTIONS))
    error = (
        F.when(F.col("post_id").isNull() | ~F.col("post_id").between(0, MAX_POST_ID), "invalid post_id")
        .when(F.col("b").isNull() | F.col("b._bad").isNotNull(), "malformed JSON")
        .when(~_channels_valid(F.col("b"), engine.g.pixels), f"channels must have {engine.g.pixels} values from 0 to 255")
    )
    d = d.withColumn("error", error)
    return d.where("error IS NULL").select("post_id", "b.r", "b.g", "b.b"), d.where("error IS NOT NULL").select("post_id", "error")


def read(engine: Engine, requests: DataFrame) -> DataFrame:
    """(query_id, kind, limit, min_score, avglf1..3, coefs, status, error) of ``requests`` (query_id, body).

    Of several inputs the hash counts before the channels, and those before the post's id. A wrong limit is told before
    a wrong input. status: 200, 400, or 404 for an image that is not indexed.
    """
    g = engine.g
    d = requests.select("query_id", F.from_json("body", QUERY_BODY, _OPTIONS).alias("b"))
    d = d.select("query_id", F.col("b").isNull().alias("none"), F.coalesce(F.col("b._bad").isNotNull(), F.lit(False)).alias("bad"), "b.*")
    d = d.withColumn("kind", input_kind(F.col("hash"), F.col("channels"), F.col("post_id"))).withColumn("decoded", codec.decode_hash(F.when(F.col("kind") == "hash", F.col("hash")), g))
    ok = F.coalesce(_channels_valid(F.col("channels"), g.pixels), F.lit(False)) & (F.col("kind") == "channels")
    blank = F.array_repeat(F.lit(0), g.pixels)
    d = d.withColumn("drawn", haar.haar_signature(*(F.when(ok, F.col(f"channels.{c}")).otherwise(blank) for c in "rgb"), g))
    known = engine.images().select(F.col("post_id").cast("long").alias("post_id"), F.array("avglf1", "avglf2", "avglf3").alias("stored"), codec.decode_blob(F.col("sig"), g).alias("stored_sig"))
    d = d.join(known, (F.col("kind") == "post_id") & (d["post_id"] == known["post_id"]), "left").drop(known["post_id"])
    limit = scoring.clamp_limit(F.col("limit"))
    error = (
        F.when(F.col("none") | F.col("bad"), "malformed JSON").when(limit.isNull(), "limit must be at least 1")
        .when(F.col("kind").isNull(), "one of hash, channels or post_id is needed").when(F.col("kind") == "hash", F.col("decoded.error"))
        .when((F.col("kind") == "channels") & ~ok, f"channels must have {g.pixels} values from 0 to 255")
        .when((F.col("kind") == "post_id") & ~F.col("post_id").between(0, MAX_POST_ID), "invalid post_id")
    )
    missing = (F.col("kind") == "post_id") & F.col("stored").isNull()
    pick = lambda a, b, c: F.when(F.col("kind") == "hash", F.col(a)).when(F.col("kind") == "channels", F.col(b)).otherwise(F.col(c))
    d = d.withColumns({"error": error, "means": pick("decoded.avglf", "drawn.avglf", "stored"), "coefs": pick("decoded.sig", "drawn.sig", "stored_sig"), "limit": limit})
    status = F.when(F.col("error").isNotNull(), 400).when(missing, 404).otherwise(200)
    return d.select(
        "query_id", "kind", "limit", "min_score", *(F.get("means", F.lit(i)).alias(f"avglf{i + 1}") for i in range(3)), "coefs",
        status.alias("status"), F.when(status == 404, "not_indexed").otherwise(F.col("error")).alias("error"),
    )


def answer(engine: Engine, requests: DataFrame, kernel: str = "scan") -> DataFrame:
    """(query_id, status, body): a JSON array of {post_id, score, hash}, best first, or {error}."""
    asked = read(engine, requests)
    alive, counted, posts = engine.live()
    best = scoring.similar(alive, asked.where("status = 200"), MAX_LIMIT, None, kernel, counted, engine.g, posts)
    best = best.join(asked.select("query_id", "limit", F.col("min_score").cast("float").alias("least")), "query_id")
    best = best.where((F.col("rank") <= F.col("limit")) & (F.col("least").isNull() | (F.col("score") >= F.col("least"))))
    best = best.join(engine.get(best.select("post_id").distinct()), "post_id")
    # a query has at most 200 results
    rows = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "post_id", "score", "hash"))).alias("found"))
    body = F.coalesce(F.to_json(F.transform("found", lambda x: F.struct(x["post_id"].alias("post_id"), x["score"].alias("score"), x["hash"].alias("hash")))), F.lit("[]"))
    out = asked.select("query_id", "status", "error").join(rows, "query_id", "left")
    return out.select("query_id", "status", F.when(F.col("status") == 200, body).otherwise(F.to_json(F.struct("error"))).alias("body"))
