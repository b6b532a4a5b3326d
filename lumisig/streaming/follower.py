"""Followers of the change feed, on Structured Streaming.

A follower keeps a state of its own that is complete up to a cursor. New log
files wake it; what it applies is read by sequence number from the store, so a
batch that is run again changes nothing.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import HorizonBreach
from ..operators import feed
from ..schema import EVENTS
from ..sources.store import STATE, Store

PAYLOAD = ["avglf1", "avglf2", "avglf3", "sig"]


class Follower:
    """State in ``path``: a base table, and for each batch of events since a small table of what it changed.

    ``base-<cursor>`` and ``delta-<after>-<cursor>`` count once they are finished. A batch takes ``batch`` events at most;
    after ``deltas`` of them the state is written anew as the base, and what that replaces is removed.
    """

    def __init__(self, spark: SparkSession, store: Store, path: str, batch: int = 10_000, deltas: int = 16):
        self.spark, self.store, self.path, self.batch, self.deltas = spark, store, path.rstrip("/"), batch, deltas
        self.updated = 0.0

    def _parts(self) -> tuple[int | None, list[tuple[int, int]]]:
        """The newest base's cursor, and the batches (after, cursor) applied since, in order."""
        fs, p = self.store._fs(self.path)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(path(s.getPath(), "_SUCCESS"))] if fs.exists(p) else []
        bases = [int(n[5:]) for n in names if n.startswith("base-")]
        if not bases:
            return None, []
        steps = dict(tuple(map(int, n[6:].split("-"))) for n in names if n.startswith("delta-"))
        at, chain = max(bases), []
        while at in steps:
            chain.append((at, steps[at]))
            at = steps[at]
        return max(bases), chain

    def cursor(self) -> int | None:
        """How far the state is complete; None before it is loaded."""
        base, chain = self._parts()
        return chain[-1][1] if chain else base

    def state(self) -> DataFrame:
        """(post_id, seq, avglf1..3, sig)."""
        base, chain = self._parts()
        rows = self.spark.read.schema(STATE).parquet(f"{self.path}/base-{base}")
        if not chain:
            return rows
        changes = self.spark.read.schema(EVENTS).parquet(*(f"{self.path}/delta-{a}-{z}" for a, z in chain))
        return feed.replay(rows, changes, "post_id", PAYLOAD)

    def _rebase(self, rows: DataFrame, cursor: int) -> None:
        """Make ``rows`` the base and remove all that was there before."""
        rows.write.mode("overwrite").parquet(f"{self.path}/base-{cursor}.new")
        fs, p = self.store._fs(self.path)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if fs.exists(path(p, f"base-{cursor}")):
            fs.delete(path(p, f"base-{cursor}"), True)
        fs.rename(path(p, f"base-{cursor}.new"), path(p, f"base-{cursor}"))
        for s in fs.listStatus(p):
            if s.getPath().getName() != f"base-{cursor}":
                fs.delete(s.getPath(), True)

    def load(self) -> int:
        """Start from the store's snapshot; events from its cursor on follow."""
        rows, cursor = self.store.snapshot()
        self._rebase(rows, cursor)
        return cursor

    def drain(self) -> int:
        """Apply what is new, by batches, and return the cursor. Fails where the log no longer has all of it.

        The horizon is compared before anything is read: events after a gap must not move the cursor past it.
        Sequence numbers have no gaps, so a batch is a range of them.
        """
        cursor = self.cursor()
        if cursor is None:
            cursor = self.load()
        feed.check_horizon(cursor, self.store.horizon())
        last, events = self.store.cursor(), self.store.events()
        while cursor < last:
            to = min(cursor + self.batch, last)
            part = events.where(F.col("seq").between(cursor + 1, to))
            newest = part.groupBy("post_id").agg(F.max("seq").alias("seq"))
            part.join(newest, ["post_id", "seq"], "left_semi").select(*(f.name for f in EVENTS)).write.mode("overwrite").parquet(f"{self.path}/delta-{cursor}-{to}")
            cursor = to
        if len(self._parts()[1]) > self.deltas:
            self._rebase(self.state(), cursor)
        self.updated = time.time()
        return cursor

    def follow(self) -> int:
        """``drain``, or load anew where the log was pruned past the cursor."""
        try:
            return self.drain()
        except HorizonBreach:
            self.load()
            return self.drain()

    def start(self, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Follow the log's files: as they come, looked for every ``interval``, or what is there now if that is None."""
        files = self.spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{self.store.path}/log/*")
        writer = files.select("seq").writeStream.foreachBatch(lambda batch, _: self.follow() and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def run(self, stop, pause: float = 2.0, back_off: float = 5.0, on_error=None) -> None:
        """Follow by polling until ``stop()``; after an error the cursor stays and the next look waits longer."""
        while not stop():
            try:
                self.follow()
                time.sleep(pause)
            except Exception as e:  # noqa: BLE001  the store may be out of reach for a while
                if on_error:
                    on_error(e)
                time.sleep(back_off)

    def lag(self, now=None) -> float:
        """Age in seconds of the oldest event that is not applied."""
        return feed.lag(self.store.events(), self.cursor() or 0, now if now is not None else F.current_timestamp()).first()["lag_seconds"]

    def ready(self, max_lag: float = 30.0, max_age: float = 30.0) -> bool:
        return self.lag() <= max_lag and time.time() - self.updated <= max_age


def converged(follower: Follower, engine_cursor: int, budget: float = 5.0, pause: float = 0.05) -> float:
    """Seconds until the follower has reached the cursor; fails after ``budget``."""
    began = time.time()
    while (follower.cursor() or 0) < engine_cursor:
        if time.time() - began > budget:
            raise TimeoutError(f"the follower did not reach {engine_cursor} in {budget} s")
        time.sleep(pause)
    return time.time() - began
