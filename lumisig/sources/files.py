"""Query corpora and expected signatures as JSON, and table rows in PostgreSQL's binary COPY format."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, haar
from ..schema import CORPUS, FULL, Geometry
from . import synthetic


def write_corpus(entries: DataFrame, path: str) -> None:
    """(hash, kind) as JSON lines."""
    entries.select("hash", "kind").write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(CORPUS).json(path).where("hash IS NOT NULL")


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of {case, hash}."""
    return spark.read.schema("`case` int, hash string").option("multiLine", True).json(path)


def build_corpus(images: DataFrame, n: int, seed: int, g: Geometry) -> DataFrame:
    """(hash, kind) of a stratified sample of ``images`` (post_id, avglf1..3, coefs or sig)."""
    from ..operators import corpus

    d = images.withColumn("kind", haar.stratum(F.col("avglf1"), F.col("avglf2"), F.col("avglf3")))
    chosen = corpus.stratified(d, n, seed, "post_id")
    coefs = F.col("coefs") if "coefs" in images.columns else codec.decode_blob(F.col("sig"), g)
    return chosen.select(codec.encode_hash(F.array("avglf1", "avglf2", "avglf3"), coefs, g).alias("hash"), "kind")


def synthetic_corpus(spark: SparkSession) -> DataFrame:
    """(hash, kind) of the synthetic test images, at full size: ``synthetic_0`` and so on."""

    @F.arrow_udf("string")
    def hashes(n: pa.Array) -> pa.Array:
        out = []
        for i in n.to_pylist():
            means, sig = haar.signatures(np.stack([c.astype(float) for c in synthetic.case(i)])[None], FULL)
            out.append(codec.to_hash(means[0], sig[0]))
        return pa.array(out)

    return spark.range(synthetic.CASES).select(hashes("id").alias("hash"), F.concat(F.lit("synthetic_"), F.col("id").cast("string")).alias("kind"))


# Fixed values of PostgreSQL's binary COPY format.
COPY_HEADER = b"PGCOPY\n\xff\r\n\0" + struct.pack(">ii", 0, 0)
COPY_TRAILER = struct.pack(">h", -1)


def copy_row(post_id: int, avglf1: float, avglf2: float, avglf3: float, sig: bytes) -> bytes:
    """A row of five fields, each with its length before it, big-endian."""
    fields = [struct.pack(">i", post_id), *(struct.pack(">d", x) for x in (avglf1, avglf2, avglf3)), bytes(sig)]
    return struct.pack(">h", len(fields)) + b"".join(struct.pack(">i", len(f)) + f for f in fields)


def copy_rows(images: DataFrame) -> DataFrame:
    """(row): each image's COPY bytes; between the header and the trailer they are a COPY stream."""

    @F.arrow_udf("binary")
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([copy_row(*r) for r in zip(*(c.to_pylist() for c in columns), strict=True)], pa.binary())

    return images.select(run("post_id", "avglf1", "avglf2", "avglf3", "sig").alias("row"))


def copy_stream(images: DataFrame) -> Iterator[bytes]:
    """A whole COPY stream: header, rows as they come, trailer. A partition is held at a time."""
    yield COPY_HEADER
    for r in copy_rows(images).toLocalIterator():
        yield bytes(r["row"])
    yield COPY_TRAILER
