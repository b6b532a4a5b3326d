"""The engine: a versioned image index that is written by batches and asked for similar images."""

from __future__ import annotations

import time
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import ship
from .errors import InvalidInput, NotIndexed
from .functions import codec, haar
from .operators import feed, index, metrics, scoring, sync
from .schema import DELETE, FULL, UPSERT, Geometry
from .sources.store import Store

PAYLOAD = ["avglf1", "avglf2", "avglf3", "sig"]
MAX_POST_ID = 2**31 - 1


def channel_valid(values: Column, pixels: int = FULL.pixels) -> Column:
    """Whether a channel has a byte for each pixel."""
    return F.coalesce((F.size(values) == pixels) & F.forall(values, lambda x: x.between(0, 255)), F.lit(False))


def input_kind(hash_: Column, channels: Column, post_id: Column) -> Column:
    """Which of a request's inputs counts: hash before channels before post_id; null where there is none."""
    return F.when(hash_.isNotNull(), "hash").when(channels.isNotNull(), "channels").when(post_id.isNotNull(), "post_id")


def check_post_ids(df: DataFrame, key: str = "post_id") -> DataFrame:
    """``df`` with an integer key, failing on ids that are null, negative or too large."""
    ok = F.col(key).isNotNull() & F.col(key).between(0, MAX_POST_ID)
    return df.withColumn(key, F.when(ok, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("invalid post_id "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("long")).cast("int"))


class Engine:
    """Images in a ``Store``. Writes append to its event log and then make a new version of its state."""

    def __init__(self, spark: SparkSession, path: str, g: Geometry = FULL):
        self.spark, self.g, self.store = ship(spark), g, Store(spark, path)

    # writes

    def signatures(self, channels: DataFrame) -> DataFrame:
        """(post_id, avglf1..3, sig) of images (post_id, r, g, b: binaries or arrays of bytes)."""
        d = check_post_ids(channels)
        if dict(channels.dtypes)["r"] != "binary":
            bad = ~(channel_valid(F.col("r"), self.g.pixels) & channel_valid(F.col("g"), self.g.pixels) & channel_valid(F.col("b"), self.g.pixels))
            d = d.withColumn("r", F.when(bad, F.raise_error(F.lit(f"channels must have {self.g.pixels} values from 0 to 255")).cast(dict(channels.dtypes)["r"])).otherwise(F.col("r")))
        s = d.select("post_id", haar.haar_signature(F.col("r"), F.col("g"), F.col("b"), self.g).alias("s"))
        return s.select("post_id", *(F.get("s.avglf", F.lit(i)).alias(f"avglf{i + 1}") for i in range(3)), codec.encode_blob(F.col("s.sig"), self.g).alias("sig"))

    def upsert(self, channels: DataFrame, at: Column | None = None) -> int:
        """Add or replace images; returns the cursor after their events."""
        return self.upsert_signatures(self.signatures(channels), at)

    def upsert_signatures(self, signed: DataFrame, at: Column | None = None) -> int:
        return self.store.append(signed.select(F.lit(UPSERT).alias("op"), "post_id", *PAYLOAD), at)

    def delete(self, keys: DataFrame, at: Column | None = None) -> int:
        """Remove images; absent ones have no event."""
        known = check_post_ids(keys.select("post_id")).distinct().join(self.images().select("post_id"), "post_id", "left_semi")
        empty = [F.lit(None).cast("binary" if c == "sig" else "double").alias(c) for c in PAYLOAD]
        return self.store.append(known.select(F.lit(DELETE).alias("op"), "post_id", *empty), at)

    def full_load(self, signed: DataFrame) -> None:
        """Replace the whole state without events. Followers must load anew: the horizon is set over all cursors."""
        self.store.replace(check_post_ids(signed).select("post_id", F.lit(0).cast("long").alias("seq"), *PAYLOAD), self.g)

    def synchronize(self, source: DataFrame) -> dict:
        """Bring the state to that of ``source`` (post_id, avglf1..3, sig) by events of the differences; returns their counts."""
        found = sync.classify(check_post_ids(source), self.images().select("post_id", *PAYLOAD), "post_id")
        counts = sync.report(found).first().asDict()
        changed = found.where("action <> 'unchanged'")
        self.store.append(changed.select(F.when(F.col("action") == "removed", DELETE).otherwise(UPSERT).alias("op"), "post_id", *PAYLOAD))
        return counts

    def prune(self, retention: timedelta, now: Column | None = None) -> dict | None:
        """Drop the log's prefix that is older than the retention; None while another prune runs."""
        return self.store.prune(retention, now if now is not None else F.current_timestamp())

    # reads

    def images(self) -> DataFrame:
        """(post_id, seq, avglf1..3, sig): the state after all events."""
        snapshot, cursor = self.store.snapshot()
        return feed.replay(snapshot, self.store.events().where(F.col("seq") > cursor), "post_id", PAYLOAD)

    def page(self, after: int = -1, limit: int = 10_000) -> DataFrame:
        """The next ``limit`` images after an id, in order."""
        return self.images().where(F.col("post_id") > after).orderBy("post_id").limit(limit)

    def compact(self) -> int:
        """Write the state as a new snapshot and its index, and turn readers to it; returns its cursor."""
        cursor = self.store.cursor()
        state = self.images().where(F.col("seq") <= cursor)
        self.store.publish(state, cursor, self.g)
        return cursor

    def live(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Live images, census and posting lists: the snapshot's stored ones, less what later events change and with what they add.

        Slots follow the posts' ids in the snapshot, and come after all of them for later events.
        """
        _, cursor = self.store.snapshot()
        stored, tail = self.store.index(), self.store.events().where(F.col("seq") > cursor)
        later = feed.latest_state(tail, "post_id", PAYLOAD).withColumn("slot", F.col("seq") + F.lit(1 << 32))
        new = index.live(later, self.g)
        if stored is None:
            return new, index.census(new), index.postings(new)
        alive, counted, posts = stored
        if tail.isEmpty():
            return stored
        changed = tail.select("post_id").distinct()
        gone = alive.join(changed, "post_id", "left_semi")
        kept = lambda d: d.join(changed, "post_id", "left_anti")
        return kept(alive).unionByName(new), index.later(counted, new, gone), kept(posts).select("bucket", "post_id", "slot").unionByName(index.postings(new))

    def get(self, keys: DataFrame) -> DataFrame:
        """(post_id, hash): null where there is no such image."""
        found = self.images().join(keys.select("post_id"), "post_id", "left_semi")
        h = codec.encode_hash(F.array("avglf1", "avglf2", "avglf3"), codec.decode_blob(F.col("sig"), self.g), self.g)
        return keys.select("post_id").join(found.select("post_id", h.alias("hash")), "post_id", "left")

    def query(self, queries: DataFrame, limit: int | None = None, min_score: float | None = None, kernel: str = "scan") -> DataFrame:
        """(query_id, rank, post_id, score, hash) of the images most similar to ``queries`` (query_id, avglf1..3, sig)."""
        limit = scoring.limit_of(limit)
        alive, counted, posts = self.live()
        found = scoring.similar(alive, queries, limit, min_score, kernel, counted, self.g, posts)
        return found.join(self.get(found.select("post_id").distinct()), "post_id").select("query_id", "rank", "post_id", "score", "hash")

    def query_one(self, hash: str | None = None, channels: tuple | None = None, post_id: int | None = None, limit: int | None = None, min_score: float | None = None) -> list[dict]:
        """The images most similar to one, best first: by its hash, else its channels, else its id."""
        scoring.limit_of(limit)
        if hash is not None:
            if error := codec.hash_error(hash, self.g):
                raise InvalidInput(error)
            means, sig = codec.from_hash(hash, self.g)
            row = (0, *map(float, means), codec.to_blob(sig))
        elif channels is not None:
            import numpy as np

            c = [np.asarray(x) for x in channels]
            if len(c) != 3 or any(x.size != self.g.pixels or x.min() < 0 or x.max() > 255 for x in c):
                raise InvalidInput(f"channels must have {self.g.pixels} values from 0 to 255")
            means, sig = haar.signatures(np.stack([x.ravel() for x in c])[None].astype(float), self.g)
            row = (0, *map(float, means[0]), codec.to_blob(sig[0]))
        elif post_id is not None:
            if not 0 <= post_id <= MAX_POST_ID:
                raise InvalidInput(f"invalid post_id {post_id}")
            found = self.images().where(F.col("post_id") == post_id).select(*PAYLOAD).first()
            if found is None:
                raise NotIndexed(f"post {post_id} is not indexed")
            row = (0, *found)
        else:
            raise InvalidInput("one of hash, channels or post_id is needed")
        q = self.spark.createDataFrame([row], "query_id long, avglf1 double, avglf2 double, avglf3 double, sig binary")
        return [r.asDict() for r in self.query(q, limit, min_score).orderBy("rank").select("post_id", "score", "hash").collect()]

    def status(self, now: Column | None = None) -> DataFrame:
        """One row: images, tombstones, their ratio, chunks, cursor, snapshot cursor, horizon and lag of the snapshot."""
        _, cursor = self.store.snapshot()
        lag = feed.lag(self.store.events(), cursor, now if now is not None else F.current_timestamp())
        s = index.stats(feed.slots(self.store.events().unionByName(self._snapshot_events(cursor)), "post_id"))
        return s.crossJoin(lag).withColumns({"cursor": F.lit(self.store.cursor()).cast("long"), "snapshot_cursor": F.lit(cursor).cast("long"), "horizon": F.lit(self.store.horizon()).cast("long")})

    def metrics(self, now: Column | None = None) -> DataFrame:
        """(line): the status as gauges, and the log's events by kind, in the text format that scrapers read."""
        s = self.status(now)
        gauges = s.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in s.columns))).alias("g")).select("g.name", "g.value")
        lines = gauges.select(F.concat(F.lit("lumisig_"), F.col("name"), F.lit(" "), F.col("value").cast("string")).alias("line"))
        kinds = metrics.counters(self.store.events().select(F.when(F.col("op") == UPSERT, "upsert").otherwise("delete").alias("op")), "op")
        return lines.unionAll(metrics.exposition(kinds, "lumisig_writes_total", "total"))

    def _snapshot_events(self, cursor: int) -> DataFrame:
        """The snapshot's rows as upserts, but for those whose events are still in the log."""
        rows, _ = self.store.snapshot()
        old = rows.where(F.col("seq") <= self.store.horizon())
        return old.select("seq", F.lit(UPSERT).alias("op"), "post_id", *PAYLOAD, F.lit(None).cast("timestamp").alias("at"))

    def ready(self, max_lag: float = 30.0, max_age: float = 30.0, updated: float | None = None, now: Column | None = None) -> bool:
        """Whether the snapshot is fresh: its lag, and the age of the last look (epoch seconds) where one is given."""
        lag = self.status(now).first()["lag_seconds"]
        return lag <= max_lag and (updated is None or time.time() - updated <= max_age)
