"""Mixing sources to target weights, by Pfair scheduling, in DataFrame functions only.

Each source's documents form blocks. With share w of all weights, block k of a source is
released at slot floor(k / w) and due at slot ceil((k + 1) / w); in each slot the released block with the
earliest deadline runs, which keeps every source within one block of its share. Shares are exact
fractions of the weights as they are written, so the schedule repeats with their common period; it is
made for that, or for as many slots as the documents need where those are fewer.

The m sources of one weight are scheduled as one group of m times their share, whose blocks they take in
turn: block k of source j is block m k + j of the group, and the group's window for it,
floor((m k + j) / m w) to ceil((m k + j + 1) / m w), lies within the source's own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisig.cluster import numbered

from .common import materialize, scratch_dir, sized_broadcast

#: Slots of a schedule that are made on the driver at a time.
CHUNK = 1 << 18


def exact_shares(weights: Mapping) -> dict:
    """The smallest whole numbers in proportion to the weights as they are written; their sum is the period of the schedule."""
    if any(not 0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be over zero")
    ws = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in ws.values()))
    whole = {s: int(w * scale) for s, w in ws.items()}
    common = math.gcd(*whole.values()) or 1
    return {s: n // common for s, n in whole.items()}


def exact_schedule(slots: Mapping[int, int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(group, block, slot, release, deadline) without end: the earliest deadline first among the released; of equal ones the first group."""
    period = sum(slots.values())
    waiting, ready, t = [(0, g, 0) for g in sorted(slots)], [], 0
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            release, g, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // slots[g]), g, k, release))
        due, g, k, release = heapq.heappop(ready)
        yield g, k, t, release, due
        heapq.heappush(waiting, ((k + 1) * period // slots[g], g, k + 1))
        t += 1


def _plan(spark: SparkSession, slots: Mapping[int, int], length: int) -> DataFrame:
    """(__g, __b, __t): group, block and slot of the first ``length`` slots; longer ones are written by and by."""
    of = exact_schedule(slots)
    schema, path = "__g int, __b long, __t long", None
    while True:
        rows = [x[:3] for x in islice(of, min(CHUNK, length))]
        length -= len(rows)
        d = spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("__g", pa.int32()), ("__b", pa.int64()), ("__t", pa.int64())))})) if rows else spark.createDataFrame([], schema)
        if path is None and not length:
            return F.broadcast(d) if len(rows) <= CHUNK // 2 else d
        path = path or scratch_dir(spark)
        d.write.mode("append").parquet(path)
        if not length:
            return spark.read.schema(schema).parquet(path)


def _sources(named: DataFrame, weights: Mapping[str, float], default: float | None) -> tuple[DataFrame, list[float]]:
    """(__s, __c, __g, __j, __m): each source's rows, its group, its place there and the group's size; and the groups' weights.

    Sources of one weight are a group; they are numbered by their names, however many there are.
    """
    spark = named.sparkSession
    levels = sorted({*weights.values(), *([] if default is None else [default])}, key=lambda w: Fraction(str(w)))
    listed = spark.createDataFrame([(s, levels.index(w)) for s, w in weights.items()], "__s string, __g int")
    found = materialize(named.groupBy("__s").agg(F.count("*").alias("__c")))
    every = found.join(F.broadcast(listed), "__s", "full")  # listed: as many rows as the caller names
    unknown = [r[0] for r in every.where("__g IS NULL").select("__s").limit(5).collect()]
    if unknown and default is None:
        raise ValueError(f"no weight for {unknown}")
    every = every.select(F.struct(F.coalesce("__g", F.lit(levels.index(default) if default is not None else 0)).alias("g"), F.col("__s").alias("s")).alias("__k"), F.coalesce("__c", F.lit(0)).alias("__c"))
    every = materialize(numbered(every, "__k", "__j"))
    groups = every.groupBy(F.col("__k.g").alias("__g")).agg(F.min("__j").alias("__f"), F.count("*").alias("__m"))  # a row a weight
    placed = every.withColumn("__g", F.col("__k.g")).join(F.broadcast(groups), "__g")
    return placed.select(F.col("__k.s").alias("__s"), "__c", "__g", (F.col("__j") - F.col("__f")).alias("__j"), "__m"), levels


def mix(docs: DataFrame, weights: Mapping[str, float], block_docs: int = 8, default: float | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", rows_per_bucket: int = 1024, least_slots: int = 120) -> DataFrame:
    """``docs`` with mix_block, mix_slot and mix_place: its block in its source, that block's slot, its place in the block.

    Order by (mix_slot, mix_place) to read the mixture. Every row is kept: while all
    sources last, each has its share within one block at every slot; when one runs out its slots are empty,
    which leaves the others' slots in proportion. Within a source documents are shuffled by a
    hash of their id. A source without a weight gets ``default``; without a default that is an
    error. Null sources are one source. Rows with null ids come first in their source; repeated
    rows follow each other. Columns of the names that are added are replaced. The table of slots holds
    whole periods of the exact shares, at least ``least_slots`` slots of them, or all slots that the documents
    need where those are fewer; there can be any number of sources, as the schedule deals slots to
    groups of equal weight. Rows are numbered in buckets of the hash, so that a hot source is dealt over tasks.
    """
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    h = F.pmod(F.pmod(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed), F.lit(1 << 32))
    d = docs.withColumn("__s", name).withColumn("__h", h)
    sources, levels = _sources(d, weights, default)
    last = F.when(F.col("__c") > 0, F.floor((F.col("__c") + (block_docs - 1)) / block_docs - 1) * F.col("__m") + F.col("__j") + 1).otherwise(0)
    sizes = {r["__g"]: r for r in sources.groupBy("__g").agg(F.first("__m").alias("m"), F.max(last).alias("blocks")).collect()}  # a row a weight
    slots = exact_shares({g: Fraction(str(levels[g])) * r["m"] for g, r in sizes.items()}) if sizes else {}
    cycle = sum(slots.values())
    need = max((-(-r["blocks"] * cycle // slots[g]) for g, r in sizes.items()), default=0)  # the last block's deadline
    repeats = -(-least_slots // cycle) if cycle else 1
    if repeats * cycle <= max(need, CHUNK):
        length, turn = repeats * cycle, {g: n * repeats for g, n in slots.items()}
    else:
        length, turn = need, dict.fromkeys(slots, 1 << 62)  # every block has a row of its own
    spark = docs.sparkSession
    table = _plan(spark, slots, length)
    turns = spark.createDataFrame(list(turn.items()), "__g int, __n long")
    each = sources.join(F.broadcast(turns), "__g").withColumn("__b_", F.greatest(F.lit(1), F.ceil(F.col("__c") / rows_per_bucket)))
    each = sized_broadcast(each.select("__s", "__g", "__j", "__m", "__n", "__b_"))
    d = d.join(each, "__s")  # a row for each source
    d = d.withColumn("__k", F.floor(F.col("__h") * F.col("__b_") / F.lit(1 << 32)).cast("int"))
    # how many rows of the source stand in buckets before
    before = materialize(d.groupBy("__s", "__k").agg(F.count("*").alias("__c")))
    by_source = "SUM(__c) OVER (PARTITION BY __s ORDER BY __k) - __c"
    before = before.select("__s", "__k", F.expr(by_source).alias("__f"))
    rank = f"ROW_NUMBER() OVER (PARTITION BY __s, __k ORDER BY __h, {id_col})"
    d = d.withColumn("__r", F.expr(rank)).join(before, ["__s", "__k"]).withColumn("__r", F.col("__r") + F.col("__f") - 1)
    d = d.withColumn("mix_block", F.floor(F.col("__r") / block_docs)).withColumn("mix_place", F.pmod("__r", F.lit(block_docs)))
    d = d.withColumn("__q", F.col("mix_block") * F.col("__m") + F.col("__j"))  # the block's number in its group
    d = d.withColumn("__b", F.pmod("__q", "__n")).join(table, ["__g", "__b"])
    d = d.withColumn("mix_slot", F.expr("__q DIV __n") * F.lit(length) + F.col("__t"))
    added = ["mix_block", "mix_slot", "mix_place"]
    return d.select(*(c for c in docs.columns if c not in added), *added)


def mix_sql(table: str, weights: Mapping[str, float], columns: str, default: float, block_docs: int = 8, seed: int = 1) -> str:
    """DuckDB SQL of ``mix``, from the weights alone: releases, deadlines and the choice of each slot are made in SQL."""
    unit = math.lcm(*(Fraction(str(w)).denominator for w in (*weights.values(), default)))
    listed = ", ".join(f"('{s}', {int(Fraction(str(w)) * unit)})" for s, w in weights.items())
    return f"""
    WITH RECURSIVE listed(s, w) AS (VALUES {listed}),
    d AS (SELECT *, COALESCE(source, '') AS s FROM {table}),
    named AS (SELECT s, w FROM listed UNION ALL SELECT DISTINCT s, {int(Fraction(str(default)) * unit)} FROM d WHERE s NOT IN (SELECT s FROM listed)),
    member AS (SELECT s, w, ROW_NUMBER() OVER (PARTITION BY w ORDER BY s) - 1 AS j, COUNT(*) OVER (PARTITION BY w) AS m, DENSE_RANK() OVER (ORDER BY w) AS g FROM named),
    groups AS (SELECT g, CAST(SUM(w) AS BIGINT) AS share FROM member GROUP BY g),
    goal AS (SELECT LIST(share ORDER BY g) AS share, CAST(SUM(share) AS BIGINT) AS period FROM groups),
    edf(t, g, k, done) AS (
      SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), [CAST(0 AS BIGINT) FOR x IN share] FROM goal
      UNION ALL
      SELECT t + 1, pick, done[pick], [done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END FOR i IN range(1, len(share) + 1)]
      FROM (SELECT *, list_min([CASE WHEN done[i] * period // share[i] <= t + 1 THEN ((done[i] + 1) * period + share[i] - 1) // share[i] * 1000000 + i END FOR i IN range(1, len(share) + 1)]) % 1000000 AS pick
            FROM edf, goal WHERE t + 1 < period)),
    ranked AS (SELECT d.*, m, j, member.g AS g, ROW_NUMBER() OVER (PARTITION BY d.s ORDER BY ((doc_id % 2147483648) * 2654435761 + {seed}) % 4294967296, doc_id) - 1 AS r FROM d JOIN member ON member.s = d.s),
    blocks AS (SELECT *, r // {block_docs} AS mix_block, r % {block_docs} AS mix_place, (r // {block_docs}) * m + j AS q FROM ranked)
    SELECT {columns}, mix_block, (q // share[blocks.g]) * period + edf.t AS mix_slot, mix_place
    FROM blocks, goal, edf WHERE edf.t >= 0 AND edf.g = blocks.g AND edf.k = q % share[blocks.g]"""
