"""Change feed: state from events, cursors, lag and retention.

Events are (seq, op, key, ...payload, at): op 1 sets the key's payload, 2 removes it.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import HorizonBreach
from ..schema import DELETE, UPSERT


def decoded(events: DataFrame, payload: list[str]) -> DataFrame:
    """``events``, failing on a row with another op, or an upsert without its payload."""
    missing = F.lit(False)
    for c in payload:
        missing = missing | F.col(c).isNull()
    bad = F.when(~F.col("op").isin(UPSERT, DELETE) | F.col("op").isNull(), F.concat(F.lit("unknown op in event "), F.col("seq")))
    bad = bad.when((F.col("op") == UPSERT) & missing, F.concat(F.lit("upsert without payload in event "), F.col("seq")))
    return events.withColumn("op", F.when(bad.isNotNull(), F.raise_error(bad).cast("int")).otherwise(F.col("op")))


def latest_state(events: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """(key, seq, payload...) after all events: the last of each key, unless it removes it.

    A maximum by key, combined before the shuffle: a key with many events costs one row a task.
    """
    last = events.groupBy(key).agg(F.max_by(F.struct("op", "seq", *payload), "seq").alias("e"))
    return last.where(F.col("e.op") == UPSERT).select(key, "e.seq", *(f"e.{c}" for c in payload))


def replay(snapshot: DataFrame, tail: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """The state of ``snapshot`` (key, seq, payload...) after the events of ``tail``. Events that the snapshot has already are harmless."""
    old = snapshot.select(F.lit(UPSERT).alias("op"), key, "seq", *payload)
    return latest_state(old.unionByName(tail.select(F.col("op").cast("int").alias("op"), key, "seq", *payload)), key, payload)


def page(events: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next ``limit`` events after the cursor, in order."""
    return events.where(F.col("seq") > cursor).orderBy("seq").limit(limit)


def tail_cursor(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("cursor"))


def seconds(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def lag(events: DataFrame, cursor: int, now: Column) -> DataFrame:
    """(lag_seconds): age of the oldest event after the cursor; 0 where there is none."""
    return events.where(F.col("seq") > cursor).agg(F.coalesce(seconds(now, F.min("at")), F.lit(0.0)).alias("lag_seconds"))


def horizon(events: DataFrame, now: Column, retention: timedelta, before: int = 0) -> DataFrame:
    """(horizon): the last event older than the retention, never less than ``before``."""
    cutoff = now - F.expr(f"INTERVAL {int(retention.total_seconds())} SECONDS")
    return events.where(F.col("at") < cutoff).agg(F.greatest(F.coalesce(F.max("seq"), F.lit(0)), F.lit(before)).cast("long").alias("horizon"))


def prune_report(events: DataFrame, now: Column, retention: timedelta, before: int = 0) -> DataFrame:
    """(horizon, deleted, kept). What goes is a prefix: all events up to the horizon, whatever their times."""
    h = horizon(events, now, retention, before)
    gone = F.col("seq") <= F.col("horizon")
    counts = events.crossJoin(F.broadcast(h))  # one row
    return counts.groupBy("horizon").agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def after_prune(events: DataFrame, now: Column, retention: timedelta, before: int = 0) -> DataFrame:
    return events.crossJoin(F.broadcast(horizon(events, now, retention, before))).where(F.col("seq") > F.col("horizon")).drop("horizon")


def check_horizon(cursor: int, pruned: int) -> None:
    """To be asked before events are read: later ones would move the cursor past what is lost."""
    if cursor < pruned:
        raise HorizonBreach(f"cursor {cursor} is below the prune horizon {pruned}")


def slots(events: DataFrame, key: str) -> DataFrame:
    """(slot, dead): each upsert takes a slot; it is dead once a later event of its key replaces or removes it."""
    last = events.groupBy(key).agg(F.max("seq").alias("last"))
    e = events.where(F.col("op") == UPSERT).join(last, key)
    return e.select(F.col("seq").alias("slot"), (F.col("seq") < F.col("last")).alias("dead"))
