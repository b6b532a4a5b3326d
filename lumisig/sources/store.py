"""A versioned store on any file system that Spark writes: snapshots, an append-only event log, and a pointer table.

    path/log/<n>        events of one write (Parquet)
    path/state/<n>      snapshots with their index
    path/head/<n>       one-row tables: the newest says which snapshot, log parts and horizon hold

A version counts only once its head is committed, so that a writer that dies leaves nothing visible.
Writers take turns by a lock file, so that sequence numbers follow the order of commits; a lock that is older
than its lease belongs to a writer that died. Readers keep the version they began with, until ``vacuum``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialize, numbered
from ..operators import feed, index
from ..schema import EVENTS, FULL, Geometry

HEAD = "version long, snapshot string, snapshot_cursor long, cursor long, horizon long, log array<string>"
STATE = "post_id int, seq long, avglf1 double, avglf2 double, avglf3 double, sig binary"


#: Parts of the log from which on a snapshot merges them.
MERGED_PARTS = 32


class Store:
    def __init__(self, spark: SparkSession, path: str, wait: float = 600.0, lease: float = 3600.0):
        self.spark, self.path, self.wait, self.lease = spark, path.rstrip("/"), wait, lease

    @contextmanager
    def _writing(self) -> Iterator[None]:
        """One writer at a time; others wait."""
        fs, lock = self._fs(f"{self.path}/write.lock")
        until = time.time() + self.wait
        while not fs.createNewFile(lock):
            try:
                if time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > self.lease:
                    fs.delete(lock, False)
                    continue
            except Exception:  # noqa: BLE001  it was released just now
                continue
            if time.time() > until:
                raise TimeoutError("another writer holds the store")
            time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(lock, False)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def head(self) -> dict:
        """The newest committed version; an empty one where there is none."""
        fs, p = self._fs(f"{self.path}/head")
        done = []
        if fs.exists(p):
            jvm = self.spark.sparkContext._jvm
            done = [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if not done:
            return {"version": 0, "snapshot": None, "snapshot_cursor": 0, "cursor": 0, "horizon": 0, "log": []}
        return self.spark.read.schema(HEAD).parquet(f"{self.path}/head/{max(done)}").first().asDict()

    def _commit(self, head: dict, **changes) -> None:
        new = {**head, **changes, "version": head["version"] + 1}
        names = [c.split()[0] for c in HEAD.split(", ")]
        self.spark.createDataFrame([tuple(new[n] for n in names)], HEAD).coalesce(1).write.mode("error").parquet(f"{self.path}/head/{new['version']}")

    def cursor(self) -> int:
        return self.head()["cursor"]

    def horizon(self) -> int:
        return self.head()["horizon"]

    def events(self) -> DataFrame:
        """The log that is left, by its schema."""
        parts = self.head()["log"]
        return self.spark.read.schema(EVENTS).parquet(*parts) if parts else self.spark.createDataFrame([], EVENTS)

    def snapshot(self) -> tuple[DataFrame, int]:
        """The newest snapshot's rows, and the cursor that it holds."""
        h = self.head()
        rows = self.spark.read.schema(STATE).parquet(f"{h['snapshot']}/images") if h["snapshot"] else self.spark.createDataFrame([], STATE)
        return rows, h["snapshot_cursor"]

    def index(self) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """The newest snapshot's live images, census and posting lists; None before there is one."""
        path = self.head()["snapshot"]
        return index.read(self.spark, path) if path else None

    def append(self, events: DataFrame, at: Column | None = None) -> int:
        """Number ``events`` (op, post_id, payload) after the cursor, without gaps, and commit them; returns the new cursor."""
        d = materialize(numbered(events, "post_id", "seq"))
        when = at if at is not None else F.current_timestamp()
        with self._writing():
            h = self.head()
            part = f"{self.path}/log/{h['version'] + 1}"
            d = d.withColumn("seq", F.col("seq") + h["cursor"]).withColumn("at", when)
            d.select(*(F.col(f.name).cast(f.dataType) for f in EVENTS)).write.mode("overwrite").parquet(part)
            n = self.spark.read.schema(EVENTS).parquet(part).count()
            if n:
                self._commit(h, cursor=h["cursor"] + n, log=[*h["log"], part])
            return h["cursor"] + n

    def _snapshot(self, state: DataFrame, version: int, g: Geometry) -> str:
        path = f"{self.path}/state/{version}"
        state.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{path}/images")
        index.write(self.spark.read.schema(STATE).parquet(f"{path}/images"), path, g)
        return path

    def publish(self, state: DataFrame, cursor: int, g: Geometry = FULL) -> None:
        """Make ``state`` the snapshot that holds the cursor, with its index, and merge the log where it has many parts."""
        with self._writing():
            h = self.head()
            log = h["log"]
            if len(log) >= MERGED_PARTS:
                log = [f"{self.path}/log/{h['version'] + 1}"]
                self.events().repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(log[0])
            self._commit(h, snapshot=self._snapshot(state, h["version"] + 1, g), snapshot_cursor=cursor, log=log)

    def replace(self, state: DataFrame, g: Geometry = FULL) -> None:
        """A new state without events: the log so far ends, and cursors before it are below the horizon."""
        with self._writing():
            h = self.head()
            cursor = h["cursor"] + 1
            self._commit(h, snapshot=self._snapshot(state, h["version"] + 1, g), snapshot_cursor=cursor, cursor=cursor, horizon=cursor, log=[])

    def prune(self, retention: timedelta, now: Column) -> dict | None:
        """Rewrite the log without its expired prefix: {horizon, deleted, kept}. Events that the snapshot lacks stay. None while another prune runs."""
        fs, lock = self._fs(f"{self.path}/prune.lock")
        if not fs.createNewFile(lock):
            return None
        try:
            with self._writing():
                h = self.head()
                e = self.events()
                found = feed.horizon(e, now, retention, h["horizon"]).first()["horizon"]
                found = max(min(found, h["snapshot_cursor"]), h["horizon"])
                counts = e.agg(F.count_if(F.col("seq") <= found).alias("d"), F.count_if(F.col("seq") > found).alias("k")).first()
                if counts["d"]:
                    part = f"{self.path}/log/{h['version'] + 1}"
                    e.where(F.col("seq") > found).write.mode("overwrite").parquet(part)
                    self._commit(h, horizon=found, log=[part])
                return {"horizon": found, "deleted": counts["d"], "kept": counts["k"]}
        finally:
            fs.delete(lock, False)

    def vacuum(self, versions: int = 5) -> int:
        """Delete the versions before the newest ``versions``, with the snapshots and log parts that only they name; returns how many paths."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        with self._writing():
            fs, heads = self._fs(f"{self.path}/head")
            kept = sorted((int(s.getPath().getName()) for s in fs.listStatus(heads)), reverse=True)[:versions]
            rows = [self.spark.read.schema(HEAD).parquet(f"{self.path}/head/{v}").first() for v in kept]
            names = {x.rsplit("/", 1)[1] for r in rows for x in (*r["log"], r["snapshot"]) if x} | set(map(str, kept))
            old = [s.getPath() for d in ("head", "state", "log") if fs.exists(path(f"{self.path}/{d}")) for s in fs.listStatus(path(f"{self.path}/{d}")) if s.getPath().getName() not in names]
            for x in old:
                fs.delete(x, True)
            return len(old)
