"""Queries over the test tables, one for each operator, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import materialize, scratch_dir, ship
from ..functions import codec, haar
from ..operators import compare, corpus, feed, index, metrics, scoring, sync
from ..sources import files
from ..schema import LEVEL, WEIGHTS
from . import planes
from .planes import SMALL, images, log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- DuckDB building blocks ------------------------------------------------------------------


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _f(x: float) -> str:
    return f"CAST({x!r} AS FLOAT)"


def _levels(name: str, source: str, keys: str) -> str:
    """CTEs that transform the list v of 8 numbers, level by level, to the list v of ``name``."""
    c1 = LEVEL
    c2 = c1 * LEVEL
    c3 = c2 * LEVEL
    pair = lambda a, n, op, c: "[" + ", ".join(f"({a}[{2 * i + 1}] {op} {a}[{2 * i + 2}]){c}" for i in range(n)) + "]"
    return f"""
    {name}1 AS (SELECT {keys}, {pair('v', 4, '+', '')} AS s, {pair('v', 4, '-', f' * {_d(c1)}')} AS d1 FROM {source}),
    {name}2 AS (SELECT {keys}, d1, {pair('s', 2, '+', '')} AS s, {pair('s', 2, '-', f' * {_d(c2)}')} AS d2 FROM {name}1),
    {name} AS (SELECT {keys}, list_concat([(s[1] + s[2]) * {_d(c3)}, (s[1] - s[2]) * {_d(c3)}], list_concat(d2, d1)) AS v FROM {name}2)"""


CHANNELS = """
    px AS (SELECT vec_id, list_transform(embedding, lambda x: (CAST(x AS DOUBLE) + 1) * 128) AS p FROM embeddings),
    px2 AS (SELECT vec_id, p, list_transform(range(0, 64), lambda i: p[(i + 21) % 64 + 1] * CAST(0.75 AS DOUBLE)) AS g, list_transform(range(0, 64), lambda i: p[(5 * i + 7) % 64 + 1] * CAST(0.5 AS DOUBLE)) AS b FROM px),
    rgb AS (SELECT vec_id,
      CASE WHEN vec_id % 7 = 0 THEN p WHEN vec_id % 11 = 0 THEN list_transform(p, lambda x: x + 2) WHEN vec_id % 13 = 0 THEN list_transform(p, lambda x: x / 12) ELSE p END AS r,
      CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN p WHEN vec_id % 13 = 0 THEN list_transform(g, lambda x: x / 12) ELSE g END AS g,
      CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN p WHEN vec_id % 13 = 0 THEN list_transform(b, lambda x: x / 12) ELSE b END AS b
      FROM px2)"""


def _yiq(m: tuple[float, float, float], i: str) -> str:
    return f"{_d(m[0])} * r[{i}] + {_d(m[1])} * g[{i}] + {_d(m[2])} * b[{i}]"


def _plane(m: tuple[float, float, float]) -> str:
    return f"list_transform(range(1, 65), lambda k: {_yiq(m, 'k')})"


_YIQ = ((0.299, 0.587, 0.114), (0.596, -0.275, -0.321), (0.212, -0.523, 0.311))
HAAR = f"""{CHANNELS},
    yiq AS (SELECT vec_id, ch, v FROM (SELECT vec_id, unnest([0, 1, 2]) AS ch, unnest([{', '.join(map(_plane, _YIQ))}]) AS v FROM rgb)),
    rows0 AS (SELECT vec_id, ch, y, v[8 * y + 1 : 8 * y + 8] AS v FROM yiq, range(0, 8) t(y)),
    {_levels('rows', 'rows0', 'vec_id, ch, y').strip()},
    cols0 AS (SELECT vec_id, ch, x, list(v[x + 1] ORDER BY y) AS v FROM rows, range(0, 8) t(x) GROUP BY vec_id, ch, x),
    {_levels('cols', 'cols0', 'vec_id, ch, x').strip()},
    cell AS (SELECT vec_id, ch, y * 8 + x AS i, v[y + 1] AS v FROM cols, range(0, 8) t(y)),
    haar AS (SELECT vec_id, ch, i, CASE WHEN i = 0 THEN v / 2048 ELSE v END AS v FROM cell)"""
SIGS = f"""{HAAR},
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vec_id, ch ORDER BY abs(v) DESC, i) AS n FROM haar WHERE i > 0),
    coefs AS (SELECT vec_id, ch, CAST(CASE WHEN v > 0 THEN i ELSE -i END AS INTEGER) AS coef FROM ranked WHERE n <= 16),
    means AS (SELECT vec_id, max(CASE WHEN ch = 0 THEN v END) AS a1, max(CASE WHEN ch = 1 THEN v END) AS a2, max(CASE WHEN ch = 2 THEN v END) AS a3 FROM haar WHERE i = 0 GROUP BY vec_id),
    flags AS (SELECT *, abs(a2) + abs(a3) < {_d(0.006)} AS gray FROM means)"""
_BIN = "least(greatest(abs(coef) // 8, abs(coef) % 8), 5)"
_WEIGHT = "CASE ch " + " ".join(f"WHEN {c} THEN CASE {_BIN} " + " ".join(f"WHEN {b} THEN {_f(WEIGHTS[b][c])}" for b in range(6)) + " END" for c in range(3)) + " END"
TERMS = f"""{SIGS},
    posts AS (SELECT vec_id, ch, coef, CAST(ch * 128 + CASE WHEN coef < 0 THEN 64 ELSE 0 END + abs(coef) AS INTEGER) AS bucket, {_WEIGHT} AS w
      FROM coefs JOIN flags USING (vec_id) WHERE NOT gray OR ch = 0)"""


def _search(queries: str, images_: str = "TRUE", limit: int | None = 10) -> str:
    """CTE ``best`` (query_id, rank, post_id, raw, scale) of the queries among the images that the conditions on vec_id choose."""
    return f"""{TERMS},
    live AS (SELECT vec_id, CAST(a1 AS FLOAT) AS a1, CAST(a2 AS FLOAT) AS a2, CAST(a3 AS FLOAT) AS a3 FROM flags WHERE {images_}),
    lists AS (SELECT vec_id, list(bucket) AS bs FROM posts WHERE {images_} GROUP BY vec_id),
    census AS (SELECT bucket, count(*) AS images FROM posts WHERE {images_} GROUP BY bucket),
    qterms AS (SELECT vec_id, list(bucket ORDER BY ch, coef) AS tb, list(w ORDER BY ch, coef) AS tw,
      list(CASE WHEN images > 0 THEN w ELSE CAST(0 AS FLOAT) END ORDER BY ch, coef) AS used FROM posts LEFT JOIN census USING (bucket) WHERE {queries} GROUP BY vec_id),
    q AS (SELECT vec_id, gray, CAST(a1 AS FLOAT) AS q1, CAST(a2 AS FLOAT) AS q2, CAST(a3 AS FLOAT) AS q3, tb, tw,
      list_reduce(list_concat([CAST(0 AS FLOAT)], used), lambda a, x: a - x) AS total FROM flags JOIN qterms USING (vec_id)),
    base AS (SELECT q.vec_id AS query_id, live.vec_id AS post_id, tb, tw, bs, total,
      CASE WHEN gray THEN {_f(5.0)} * abs(live.a1 - q1) ELSE {_f(5.0)} * abs(live.a1 - q1) + {_f(19.21)} * abs(live.a2 - q2) + {_f(34.37)} * abs(live.a3 - q3) END AS raw0
      FROM live JOIN lists USING (vec_id) CROSS JOIN q),
    scored AS (SELECT query_id, post_id, CASE WHEN total = 0 THEN CAST(0 AS FLOAT) ELSE CAST(1 AS FLOAT) / total END AS scale,
      list_reduce(list_concat([raw0], list_transform(range(1, len(tb) + 1), lambda k: CASE WHEN list_contains(bs, tb[k]) THEN tw[k] ELSE CAST(0 AS FLOAT) END)), lambda a, x: a - x) AS raw FROM base),
    best AS (SELECT *, raw * CAST(100 AS FLOAT) * scale AS score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY raw, post_id) AS rank FROM scored{f' QUALIFY rank <= {limit}' if limit else ''})"""


def _asked(d: DataFrame, where) -> DataFrame:
    """``d``, named as queries."""
    return d.where(where).withColumnRenamed("post_id", "query_id")


#: The stated query set of batches: every image whose id 50 divides, against all images.
BATCH = "post_id % 50 = 0"


# ---- signature extraction -------------------------------------------------------------------


@query(f"WITH {CHANNELS} SELECT vec_id AS post_id, CAST(i - 1 AS INTEGER) AS pixel, {_yiq(_YIQ[0], 'i')} AS y, {_yiq(_YIQ[1], 'i')} AS i, {_yiq(_YIQ[2], 'i')} AS q FROM rgb, range(1, 65) t(i)")
def yiq_convert(spark, sf_dir):
    d = planes.channels(spark, sf_dir).select("post_id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("pixel", "x"))
    r, g, b = F.col("x.r"), F.col("x.g"), F.col("x.b")
    return d.select("post_id", "pixel", haar.yiq(r, g, b, 0).alias("y"), haar.yiq(r, g, b, 1).alias("i"), haar.yiq(r, g, b, 2).alias("q"))


@query(f"WITH {HAAR} SELECT vec_id AS post_id, CAST(i AS INTEGER) AS i, v FROM haar WHERE ch = 0")
def haar_8x8(spark, sf_dir):
    d = planes.channels(spark, sf_dir).select("post_id", F.transform(F.arrays_zip("r", "g", "b"), lambda x: haar.yiq(x["r"], x["g"], x["b"], 0)).alias("y"))
    return d.select("post_id", F.posexplode(haar.haar_plane(F.col("y"), SMALL)).alias("i", "v"))


def _coefs(spark, sf_dir):
    d = images(spark, sf_dir).select("post_id", haar.is_grayscale(F.col("avglf2"), F.col("avglf3")).alias("gray"), F.posexplode("coefs").alias("channel", "cs"))
    return d.where(~F.col("gray") | (F.col("channel") == 0)).select("post_id", "channel", F.explode(F.col("cs").cast("array<int>")).alias("coef"))


@query(f"WITH {TERMS} SELECT vec_id AS post_id, CAST(ch AS INTEGER) AS channel, coef FROM posts")
def topk_coefs(spark, sf_dir):
    return _coefs(spark, sf_dir)


@query(f"""WITH {SIGS} SELECT f.vec_id AS post_id, a1 AS avglf1, CASE WHEN gray THEN 0 ELSE a2 END AS avglf2, CASE WHEN gray THEN 0 ELSE a3 END AS avglf3, gray, coefs
    FROM flags f JOIN (SELECT vec_id, string_agg(coef, ',' ORDER BY coef) AS coefs FROM coefs WHERE ch = 0 GROUP BY vec_id) USING (vec_id)""")
def signature_extract(spark, sf_dir):
    gray = haar.is_grayscale(F.col("avglf2"), F.col("avglf3"))
    return images(spark, sf_dir).select(
        "post_id", "avglf1", *(F.when(gray, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ("avglf2", "avglf3")), gray.alias("gray"),
        F.array_join(F.transform(F.get("coefs", F.lit(0)), lambda x: x.cast("string")), ",").alias("coefs"),
    )


@query(f"WITH {SIGS} SELECT vec_id AS post_id, gray, CAST(CASE WHEN gray THEN 1 ELSE 3 END AS INTEGER) AS colors FROM flags")
def grayscale_flag(spark, sf_dir):
    a = F.col("avglf2"), F.col("avglf3")
    return images(spark, sf_dir).select("post_id", haar.is_grayscale(*a).alias("gray"), haar.num_colors(*a).cast("int").alias("colors"))


@query(f"WITH {TERMS} SELECT vec_id AS post_id, CAST(ch AS INTEGER) AS channel, coef, bucket FROM posts")
def bucket_address(spark, sf_dir):
    return _coefs(spark, sf_dir).withColumn("bucket", haar.bucket_index(F.col("channel"), F.col("coef"), SMALL.pixels))


@query(f"WITH {TERMS} SELECT DISTINCT CAST(ch AS INTEGER) AS channel, coef, CAST({_BIN} AS INTEGER) AS bin, CAST(w AS DOUBLE) AS weight FROM posts")
def coef_bin_weight(spark, sf_dir):
    c, x = F.col("channel"), F.col("coef")
    return _coefs(spark, sf_dir).select("channel", "coef").distinct().select("channel", "coef", haar.coef_bin(x, SMALL.side).alias("bin"), haar.coef_weight(x, c, SMALL.side).cast("double").alias("weight"))


# ---- index ------------------------------------------------------------------------------------


@query(f"WITH {TERMS} SELECT bucket, vec_id AS post_id FROM posts")
def postings(spark, sf_dir):
    return index.postings(index.live(images(spark, sf_dir), SMALL)).select("bucket", "post_id")


@query(f"WITH {TERMS} SELECT bucket, count(*) AS images FROM posts GROUP BY bucket")
def census(spark, sf_dir):
    return index.census(index.live(images(spark, sf_dir), SMALL))


@query(f"""WITH {TERMS}, n AS (SELECT bucket, count(*) AS images FROM posts WHERE vec_id % 5 <> 0 GROUP BY bucket HAVING bucket % 100 = 7)
    SELECT bucket, images FROM n UNION ALL SELECT bucket, images + 1 FROM n""")
def index_invariants(spark, sf_dir):
    """A census kept through inserts and deletes against one made anew: only what is broken on purpose, in every hundredth bucket, differs."""
    every = materialize(index.live(images(spark, sf_dir), SMALL))
    third, fifth = F.pmod("post_id", F.lit(3)) == 1, F.pmod("post_id", F.lit(5)) == 0
    kept = index.later(index.census(every.where(~third)), every.where(third), every.where(fifth))
    return index.broken(every.where(~fifth), kept.withColumn("images", F.col("images") + (F.pmod("bucket", F.lit(100)) == 7).cast("int") * (F.col("images") > 0).cast("int")))


@query("""WITH e AS (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events),
    s AS (SELECT event_id < last AS dead FROM e WHERE event_type <> 'error')
    SELECT count(*) FILTER (NOT dead) AS live, count(*) FILTER (dead) AS tombstones, CAST(ceil(count(*) / 65536) AS BIGINT) AS chunks, count(*) FILTER (dead) / count(*) AS tombstone_ratio FROM s""")
def index_stats(spark, sf_dir):
    return index.stats(feed.slots(log(spark, sf_dir), "key"))


# ---- similarity -------------------------------------------------------------------------------


def _found(d: DataFrame) -> DataFrame:
    return d.select("query_id", F.col("rank").cast("int").alias("rank"), "post_id", F.col("score").cast("double").alias("score"))


_OUT = "SELECT query_id, CAST(rank AS INTEGER) AS rank, post_id, CAST(score AS DOUBLE) AS score FROM best"


def _similar(spark, sf_dir, where, kernel="scan", kept=None, **more):
    every = images(spark, sf_dir)
    return _found(scoring.similar(index.live(every if kept is None else every.where(kept), SMALL), _asked(every, where), kernel=kernel, g=SMALL, **more))


@query(f"WITH {_search('vec_id = 1')} {_OUT}")
def similar_one(spark, sf_dir):
    return _similar(spark, sf_dir, F.col("post_id") == 1)


@query(f"WITH {_search('vec_id % 50 = 0')} {_OUT}")
def similar_batch(spark, sf_dir):
    return _similar(spark, sf_dir, BATCH)


@query(f"WITH {_search('vec_id % 50 = 0')} {_OUT}")
def similar_batch_fold(spark, sf_dir):
    return _similar(spark, sf_dir, BATCH, "fold")


@query(f"WITH {_search('vec_id % 50 = 0')} {_OUT}")
def similar_batch_join(spark, sf_dir):
    every, path = images(spark, sf_dir), scratch_dir(spark)
    index.write(every, path, SMALL)
    alive, counted, posts = index.read(spark, path)
    return _found(scoring.similar(alive, _asked(every, BATCH), kernel="join", g=SMALL, counted=counted, posts=posts))


@query(f"WITH {_search('vec_id % 50 = 0')} {_OUT} WHERE score >= CAST(40 AS FLOAT)")
def similar_min_score(spark, sf_dir):
    return _similar(spark, sf_dir, BATCH, min_score=40.0)


@query(f"WITH {_search('vec_id = 0')} {_OUT}")
def similar_gray_query(spark, sf_dir):
    return _similar(spark, sf_dir, F.col("post_id") == 0)


@query(f"WITH {_search('vec_id % 50 = 0', 'vec_id % 3 <> 1')} {_OUT}")
def similar_after_delete(spark, sf_dir):
    return _similar(spark, sf_dir, BATCH, kept=F.pmod("post_id", F.lit(3)) != 1)


@query(f"""WITH {_search('vec_id % 50 = 0')}, asked AS (SELECT vec_id + 0 AS query_id FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT -1)
    SELECT asked.query_id, CAST(rank AS INTEGER) AS rank, post_id, CAST(score AS DOUBLE) AS score, post_id IS NULL AS not_indexed FROM asked LEFT JOIN best USING (query_id)""")
def similar_by_id(spark, sf_dir):
    every = materialize(images(spark, sf_dir))
    asked = _asked(every, BATCH).select("query_id").unionAll(spark.range(-1, 0).toDF("query_id"))
    known = every.withColumnRenamed("post_id", "query_id").join(F.broadcast(asked), "query_id", "left_semi")
    found = _found(scoring.similar(index.live(every, SMALL), known, g=SMALL))
    return asked.join(found, "query_id", "left").withColumn("not_indexed", F.col("post_id").isNull())


@query(f"WITH {_search('TRUE')} SELECT DISTINCT query_id, CAST(scale AS DOUBLE) AS scale FROM scored")
def scale_per_query(spark, sf_dir):
    every = materialize(images(spark, sf_dir))
    q = scoring.terms(every.withColumnRenamed("post_id", "query_id"), SMALL)
    return scoring.scales(q, index.census(index.live(every, SMALL))).select("query_id", F.col("scale").cast("double").alias("scale"))


@query(f"WITH {_search('TRUE', limit=None)} SELECT query_id, post_id, CAST(score AS DOUBLE) AS score FROM best WHERE query_id <> post_id AND score >= CAST(50 AS FLOAT)")
def near_duplicate_pairs(spark, sf_dir):
    every = materialize(images(spark, sf_dir))
    found = scoring.pairs(materialize(index.live(every, SMALL)), every.withColumnRenamed("post_id", "query_id"), 50.0, SMALL)
    return found.select("query_id", "post_id", F.col("score").cast("double").alias("score"))


# ---- codecs -----------------------------------------------------------------------------------


@query(f"""WITH {TERMS} SELECT vec_id AS post_id, CAST(ch AS INTEGER) AS channel, string_agg(lpad(to_hex((coef + 65536) % 65536), 4, '0'), '' ORDER BY coef) AS hex FROM posts GROUP BY vec_id, ch""".replace("to_hex((coef + 65536) % 65536)", "lower(to_hex((coef + 65536) % 65536))"))
def hash_coef_hex(spark, sf_dir):
    d = images(spark, sf_dir).select("post_id", haar.is_grayscale(F.col("avglf2"), F.col("avglf3")).alias("gray"), F.posexplode("coefs").alias("channel", "cs"))
    return d.where(~F.col("gray") | (F.col("channel") == 0)).select("post_id", "channel", F.array_join(F.transform("cs", codec.coef_hex), "").alias("hex"))


def _hashes(spark, sf_dir):
    return images(spark, sf_dir).select("post_id", codec.encode_hash(F.array("avglf1", "avglf2", "avglf3"), F.col("coefs"), SMALL).alias("h"))


@query("SELECT vec_id AS post_id, vec_id % 5 NOT IN (1, 2) AS valid FROM embeddings")
def hash_valid(spark, sf_dir):
    h = F.when(F.pmod("post_id", F.lit(5)) == 1, F.concat("h", F.lit("0"))).when(F.pmod("post_id", F.lit(5)) == 2, F.overlay("h", F.lit("g"), F.lit(3))).otherwise(F.upper("h"))
    return _hashes(spark, sf_dir).select("post_id", codec.hash_valid(h, SMALL).alias("valid"))


@query("SELECT vec_id AS post_id, TRUE AS same FROM embeddings")
def codec_round_trip(spark, sf_dir):
    d = images(spark, sf_dir).withColumn("h", codec.encode_hash(F.array("avglf1", "avglf2", "avglf3"), F.col("coefs"), SMALL)).withColumn("back", codec.decode_hash(F.col("h"), SMALL))
    blob = codec.decode_blob(codec.encode_blob(F.col("coefs")), SMALL)
    same = (F.col("back.sig") == F.col("coefs")) & (F.col("back.avglf") == F.array("avglf1", "avglf2", "avglf3")) & (blob == F.col("coefs")) & (codec.coefs_from_hash(F.col("h"), SMALL) == F.flatten("coefs").cast("array<int>"))
    return d.select("post_id", same.alias("same"))


def _bits(v: str) -> str:
    """DuckDB SQL of a normal or zero double's 64 bits as hex digits."""
    e = f"(floor(log2(abs({v}))) + CASE WHEN abs({v}) >= pow(2.0, floor(log2(abs({v}))) + 1) THEN 1 WHEN abs({v}) < pow(2.0, floor(log2(abs({v})))) THEN -1 ELSE 0 END)"
    whole = f"CAST((abs({v}) / pow(2.0, {e}) - 1) * 4503599627370496 AS UBIGINT) + CAST(({e} + 1023) AS UBIGINT) * 4503599627370496"
    return f"CASE WHEN {v} = 0 THEN repeat('0', 16) ELSE lpad(lower(to_hex({whole} + CASE WHEN {v} < 0 THEN CAST(9223372036854775808 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END)), 16, '0') END"


@query(f"WITH {SIGS}, p AS (SELECT vec_id AS post_id, {_bits('a1')} AS bits FROM means) SELECT post_id, bits, bits = repeat('0', 16) AS black FROM p")
def dc_prefix(spark, sf_dir):
    return _hashes(spark, sf_dir).select("post_id", codec.dc_prefix(F.col("h")).alias("bits"), (codec.dc_prefix(F.col("h")) == "0" * 16).alias("black"))


# ---- change feed ------------------------------------------------------------------------------

NOW = "2024-01-31 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


_STATE = "SELECT user_id AS key, event_id AS seq, value FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'"


@query(_STATE)
def latest_state(spark, sf_dir):
    return feed.latest_state(log(spark, sf_dir), "key", ["value"])


@query("SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, user_id AS key, value FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 10000")
def event_page(spark, sf_dir):
    return feed.page(log(spark, sf_dir), 500, 10_000).select("seq", "op", "key", "value")


@query("SELECT CAST(coalesce(max(event_id), 0) AS BIGINT) AS cursor FROM events")
def tail_cursor(spark, sf_dir):
    return feed.tail_cursor(log(spark, sf_dir))


@query(f"SELECT coalesce((epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(ts))) / 1e6, 0) AS lag_seconds FROM events WHERE event_id > 900")
def lag_seconds(spark, sf_dir):
    return feed.lag(log(spark, sf_dir), 900, _now())


_HORIZON = f"(SELECT coalesce(max(event_id), 0) FROM events WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY)"


@query(f"SELECT CAST({_HORIZON} AS BIGINT) AS horizon, count(*) FILTER (event_id <= {_HORIZON}) AS deleted, count(*) FILTER (event_id > {_HORIZON}) AS kept FROM events")
def prune_report(spark, sf_dir):
    return feed.prune_report(log(spark, sf_dir), _now(), timedelta(days=7))


@query(f"SELECT event_id AS seq, user_id AS key FROM events WHERE event_id > {_HORIZON}")
def events_after_prune(spark, sf_dir):
    return feed.after_prune(log(spark, sf_dir), _now(), timedelta(days=7)).select("seq", "key")


@query(_STATE)
def replay_from_snapshot(spark, sf_dir):
    e = log(spark, sf_dir)
    snapshot = feed.latest_state(e.where("seq <= 600"), "key", ["value"])
    return feed.replay(snapshot, e.where("seq > 500"), "key", ["value"])


@query("""WITH e AS (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS last FROM events)
    SELECT count(*) FILTER (event_id < last) / count(*) AS tombstone_ratio FROM e WHERE event_type <> 'error'""")
def tombstone_ratio(spark, sf_dir):
    return index.stats(feed.slots(log(spark, sf_dir), "key")).select("tombstone_ratio")


# ---- synchronisation --------------------------------------------------------------------------


def _sides(spark, sf_dir):
    """(source, target): the customers, and the same without some, with new ones and with other balances."""
    target = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    k = F.col("c_custkey")
    kept = target.where(F.pmod(k, F.lit(10)) != 3).withColumn("c_acctbal", F.when(F.pmod(k, F.lit(7)) == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    new = target.where(F.pmod(k, F.lit(20)) == 0).withColumn("c_custkey", k + 1_000_000)
    return kept.unionByName(new), target


_SIDES = """t AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer),
    s AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM t WHERE c_custkey % 10 <> 3
      UNION ALL SELECT c_custkey + 1000000, c_acctbal FROM t WHERE c_custkey % 20 = 0),
    d AS (SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'new' WHEN s.c_custkey IS NULL THEN 'removed' WHEN s.c_acctbal = t.c_acctbal THEN 'unchanged' ELSE 'changed' END AS action
      FROM s FULL JOIN t ON s.c_custkey = t.c_custkey)"""


@query(f"WITH {_SIDES} SELECT c_custkey, action FROM d")
def delta_classify(spark, sf_dir):
    return sync.classify(*_sides(spark, sf_dir), "c_custkey").select("c_custkey", "action")


@query(f"WITH {_SIDES} SELECT count(*) FILTER (action IN ('new', 'changed')) AS upserted, count(*) FILTER (action = 'removed') AS deleted, count(*) FILTER (action = 'unchanged') AS unchanged FROM d")
def delta_report(spark, sf_dir):
    return sync.report(sync.classify(*_sides(spark, sf_dir), "c_custkey"))


@query(f"WITH {_SIDES} SELECT c_custkey, c_acctbal FROM s")
def apply_delta(spark, sf_dir):
    source, target = _sides(spark, sf_dir)
    return sync.apply(target, sync.classify(source, target, "c_custkey"), "c_custkey")


@query(f"WITH {_SIDES} SELECT ROW_NUMBER() OVER (ORDER BY c_custkey) + 100 AS seq, CAST(CASE WHEN action = 'removed' THEN 2 ELSE 1 END AS INTEGER) AS op, c_custkey FROM d WHERE action <> 'unchanged'")
def delta_events(spark, sf_dir):
    return sync.events(sync.classify(*_sides(spark, sf_dir), "c_custkey"), "c_custkey", after=100).select("seq", "op", "c_custkey")


def _orders(spark, sf_dir):
    """(source, target) of which the target lacks some orders and has other prices."""
    source = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    target = source.where(F.pmod("o_orderkey", F.lit(97)) != 0).withColumn("o_totalprice", F.when(F.pmod("o_orderkey", F.lit(41)) == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return source, target


@query("SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM orders WHERE o_orderkey % 97 <> 0) AS target_rows")
def verify_counts(spark, sf_dir):
    source, target = _orders(spark, sf_dir)
    return sync.verify(source, target, "o_orderkey", "o_totalprice", 1, corpus.shuffled(F.col("o_orderkey"), 1)).select("source_rows", "target_rows")


@query("""WITH c AS (SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 7919 + 1) % 65537, o_orderkey LIMIT 1000)
    SELECT count(*) AS checked, count(*) FILTER (o_orderkey % 97 = 0) AS missing, count(*) FILTER (o_orderkey % 97 <> 0 AND o_orderkey % 41 = 0) AS mismatches FROM c""")
def verify_sample(spark, sf_dir):
    source, target = _orders(spark, sf_dir)
    return sync.verify(source, target, "o_orderkey", "o_totalprice", 1000, corpus.shuffled(F.col("o_orderkey"), 1)).select("checked", "missing", "mismatches")


# ---- corpora ----------------------------------------------------------------------------------


def _strata(spark, sf_dir):
    return images(spark, sf_dir).select("post_id", haar.stratum(F.col("avglf1"), F.col("avglf2"), F.col("avglf3")).alias("kind"))


_KINDS = f"""{SIGS}, strata AS (SELECT vec_id AS post_id, CASE WHEN abs(a2) + abs(a3) < {_d(0.006)} THEN 'grayscale' WHEN abs(a2) + abs(a3) < {_d(0.007)} THEN 'near_threshold' WHEN a1 < {_d(0.05)} THEN 'near_black' ELSE 'random' END AS kind FROM flags)"""


@query(f"WITH {_KINDS} SELECT post_id, kind FROM strata")
def stratify(spark, sf_dir):
    return _strata(spark, sf_dir)


@query(f"""WITH {_KINDS} SELECT post_id, kind FROM strata
    QUALIFY ROW_NUMBER() OVER (PARTITION BY kind ORDER BY (post_id * 7919 + 5) % 65537, post_id) <= CASE kind WHEN 'random' THEN 60 ELSE 20 END""")
def stratified_sample(spark, sf_dir):
    return corpus.stratified(_strata(spark, sf_dir), 120, 5, "post_id")


@query("""WITH n AS (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) AS r, greatest((SELECT count(*) FROM embeddings) // 50, 1) AS step FROM embeddings)
    SELECT vec_id FROM n WHERE (r - 1) % step = 0 AND r <= 50 * step""")
def systematic_sample(spark, sf_dir):
    return corpus.systematic(table(spark, sf_dir, "embeddings").select("vec_id"), 50, "vec_id")


@query("WITH c AS (SELECT vec_id FROM embeddings ORDER BY (vec_id * 7919 + 3) % 65537, vec_id LIMIT 100) SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) AS new_id FROM c")
def renumber(spark, sf_dir):
    return corpus.subsample(table(spark, sf_dir, "embeddings").select("vec_id"), 100, 3, "vec_id", "new_id")


# ---- differences between engines --------------------------------------------------------------


def _runs(spark, sf_dir):
    """(oracle, subject): ten results, and twelve of which some scores are moved."""
    every = images(spark, sf_dir)
    alive, asked = index.live(every, SMALL), _asked(every, BATCH)
    oracle = scoring.similar(alive, asked, 10, g=SMALL)
    moved = F.when(F.pmod("post_id", F.lit(13)) == 0, 0.5).otherwise(0.0)
    subject = scoring.similar(alive, asked, 12, g=SMALL).withColumn("score", F.col("score").cast("double") + moved).withColumn("black", F.lit(False))
    return oracle, subject


_VERDICTS = f"""{_search('vec_id % 50 = 0', limit=12)},
    o AS (SELECT query_id, post_id, CAST(score AS DOUBLE) AS o FROM best WHERE rank <= 10),
    s AS (SELECT query_id, post_id, CAST(score AS DOUBLE) + CASE WHEN post_id % 13 = 0 THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS s FROM best),
    ends AS (SELECT query_id, min(s) AS s_min, (SELECT min(o) FROM o WHERE o.query_id = s.query_id) AS o_min FROM s GROUP BY query_id),
    met AS (SELECT s.query_id, abs(s - o) AS delta, CASE WHEN o IS NOT NULL THEN abs(s - o) > CAST(0.01 AS DOUBLE) ELSE s > o_min + CAST(0.01 AS DOUBLE) END AS bad
      FROM s LEFT JOIN o ON o.query_id = s.query_id AND o.post_id = s.post_id JOIN ends ON ends.query_id = s.query_id),
    verdicts AS (SELECT query_id, count(*) FILTER (bad) = 0 AS ok, coalesce(max(delta), 0) AS max_delta, count(*) FILTER (bad) AS problems FROM met GROUP BY query_id)"""


@query(f"WITH {_VERDICTS} SELECT * FROM verdicts")
def diff_verdicts(spark, sf_dir):
    return compare.verdicts(*_runs(spark, sf_dir))


@query(f"WITH {_VERDICTS} SELECT count(*) AS queries, count(*) FILTER (NOT ok) AS failed, coalesce(max(max_delta), 0) AS max_delta FROM verdicts")
def diff_report(spark, sf_dir):
    return compare.report(compare.verdicts(*_runs(spark, sf_dir)))


# ---- metrics and requests ---------------------------------------------------------------------


@query("""WITH r AS (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, any_value(n) AS n, min(value) FILTER (i >= 0.5 * n) AS p50, min(value) FILTER (i >= 0.9 * n) AS p90, min(value) FILTER (i >= 0.99 * n) AS p99, max(value) AS max FROM r GROUP BY event_type""")
def latency_quantiles(spark, sf_dir):
    return metrics.quantiles(table(spark, sf_dir, "events"), "value", "event_type")


@query("SELECT event_type, count(*) AS total FROM events GROUP BY event_type")
def counters_by_label(spark, sf_dir):
    return metrics.counters(table(spark, sf_dir, "events"), "event_type")


@query("""SELECT 'lumisig_events_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def metrics_text(spark, sf_dir):
    return metrics.exposition(metrics.counters(table(spark, sf_dir, "events"), "event_type"), "lumisig_events_total", "total")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 10 WHEN event_id % 300 - 20 > 0 THEN least(event_id % 300 - 20, 200) END AS n FROM events")
def limit_clamp(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return e.select("event_id", scoring.clamp_limit(F.when(F.pmod("event_id", F.lit(11)) != 0, F.pmod("event_id", F.lit(300)) - 20)).cast("long").alias("n"))


@query("SELECT vec_id AS post_id, vec_id % 4 NOT IN (1, 2) AS valid FROM embeddings")
def channel_validation(spark, sf_dir):
    from ..engine import channel_valid

    k, n = F.pmod("post_id", F.lit(4)), SMALL.pixels
    r = F.transform("r", lambda x: F.least(x, F.lit(255.0)).cast("int"))
    r = F.when(k == 1, F.slice(r, 1, n - 1)).when(k == 2, F.transform(r, lambda x: x + 256)).otherwise(r)
    return planes.channels(spark, sf_dir).select("post_id", channel_valid(r, n).alias("valid"))


@query("SELECT vec_id AS post_id, CASE WHEN vec_id % 2 = 0 THEN 'hash' WHEN vec_id % 3 = 0 THEN 'channels' WHEN vec_id % 5 = 0 THEN 'post_id' END AS kind FROM embeddings")
def query_precedence(spark, sf_dir):
    from ..engine import input_kind

    k = F.col("vec_id")
    given = lambda n: F.when(F.pmod(k, F.lit(n)) == 0, F.lit("x"))
    return table(spark, sf_dir, "embeddings").select(k.alias("post_id"), input_kind(given(2), given(3), given(5)).alias("kind"))


@query("""SELECT event_type, le, count(*) FILTER (value <= CASE le WHEN '+Inf' THEN CAST('Infinity' AS DOUBLE) ELSE CAST(le AS DOUBLE) END) AS total
    FROM events, (SELECT unnest(['0.5', '5', '50', '+Inf']) AS le) GROUP BY event_type, le""")
def duration_histogram(spark, sf_dir):
    return metrics.histogram(table(spark, sf_dir, "events"), "value", [0.5, 5.0, 50.0], "event_type")


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) / CAST(60 AS DOUBLE) AS per_second FROM events")
def call_throughput(spark, sf_dir):
    return metrics.throughput(table(spark, sf_dir, "events").select((F.col("event_type") == "error").alias("failed")), 60)


# ---- files, full size, and the engine as a whole ----------------------------------------------


@query("SELECT event_id AS seq, CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS INTEGER) AS op, user_id AS key, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
def event_decode(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("value", F.when(F.col("op") == 1, F.col("value")))
    return feed.decoded(rows, ["value"]).select("seq", F.col("op").cast("int").alias("op"), "key", "value")


#: SHA-1 of the recorded hashes of the 30 synthetic images, 128 x 128 pixels and 40 coefficients a channel.
RECORDED = """
    62b916f39a373253918b5662e382aeef80e1b473 4ad8464bf9802961f46c6e2564a1ee60583e1493 a36a2e8e1993c928224d98af151b087596094b72
    f6e27800dc1ad012ad2c1dd058af59fa89ad9702 d4d647960b776d33ec1c118624424ad78e0a05d5 e3360703c34a3710e0f53f7d850f9b6790677f00
    b7c3322668c394c211faae1fc622192d856c895c 286aa82f8628e100f3dfb905c18d13b808e1b34f d1f9187f5d17c0cd016059fbb71956eac5fcbe78
    07dc20f195ceb188216b9ae65ebf50f5e6faf2ed 4b8d73c223c40219bddef42fd61e7ced0137a410 2954dc3bf680746128f2e7ad955b68fc65e2b933
    0d6e712d52e1f72e4bdee0f788b9fbc36296ca7a 382043a3ca0dd7f5a51f44849d54b5626d6ab2c0 a4cbea04a0825b90f78a761acc4253366ae41628
    0f736cf768dceb79be759658cd68d87135db8a2a 92df5b56a3d89709e07e3c2247d904f89299697b a81a1970c0304e2df1ed9f7d26bd6f06624272e7
    66145337b0e32ecdcb783182d28c2cc6876614f5 b406b0373818842e6c57e311e14ea025058730e7 5f63e9ac854c9557ef03b3c72ae888ec36944ef1
    b071678121a0ce7bfd9ebefeda977e386422f647 e856a18460dc6b8e20d34fd4d35f0855112d82cf 2165266aeec0df63e64a5e3599e0fd3cb460fcd6
    b516b7103770de9f466f080fa1fbf84e7196f6d9 045456f9477ae01ce7a7389c48e487565d302225 cedebac8a3be2f2db083f10b343b8ac89e58912a
    c23dc40632d0aa302e6be7d4fa0ec6c0c9256170 e6c48cadda164cd56b744f2acec6f1deb8acf044 bf7e4f2628e85911963337eef4361d0cbd3ebb70
""".split()


@query("SELECT 'synthetic_' || (i - 1) AS kind, digest FROM (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(RECORDED, 1)) + ") t(i, digest)")
def full_size_hashes(spark, sf_dir):
    return files.synthetic_corpus(ship(spark)).select("kind", F.sha1(F.col("hash").cast("binary")).alias("digest"))


@query(f"""WITH {SIGS}, h AS (SELECT vec_id, string_agg(lpad(lower(to_hex((coef + 65536) % 65536)), 4, '0'), '' ORDER BY ch, coef) AS c FROM coefs GROUP BY vec_id)
    SELECT {_bits('a1')} || {_bits('a2')} || {_bits('a3')} || c AS hash, CASE WHEN gray THEN 'grayscale' ELSE 'other' END AS kind FROM flags JOIN h USING (vec_id)""")
def corpus_round_trip(spark, sf_dir):
    """Hashes written and read back as JSON lines."""
    path = scratch_dir(spark)
    gray = haar.is_grayscale(F.col("avglf2"), F.col("avglf3"))
    files.write_corpus(images(spark, sf_dir).select(codec.encode_hash(F.array("avglf1", "avglf2", "avglf3"), F.col("coefs"), SMALL).alias("hash"), F.when(gray, "grayscale").otherwise("other").alias("kind")), path)
    return files.read_corpus(spark, path)


@query(f"""WITH {SIGS}, s AS (SELECT vec_id, string_agg(lpad(lower(to_hex(((coef + 65536) % 65536) % 256)), 2, '0') || lpad(lower(to_hex(((coef + 65536) % 65536) // 256)), 2, '0'), '' ORDER BY ch, coef) AS c FROM coefs GROUP BY vec_id)
    SELECT '0005' || '00000004' || lpad(lower(to_hex(vec_id)), 8, '0') || '00000008' || {_bits('a1')} || '00000008' || {_bits('a2')} || '00000008' || {_bits('a3')} || '00000060' || c AS row FROM means JOIN s USING (vec_id)""")
def copy_row_bytes(spark, sf_dir):
    d = images(spark, sf_dir).withColumn("sig", codec.encode_blob(F.col("coefs"), SMALL)).withColumn("post_id", F.col("post_id").cast("int"))
    return files.copy_rows(d).select(F.lower(F.hex("row")).alias("row"))


def _engine(spark, sf_dir):
    """An engine on the small images: loaded with the even ids, the odd ones written, and every fifth removed by events."""
    from ..engine import Engine

    e = Engine(spark, scratch_dir(ship(spark)), SMALL)
    d = images(spark, sf_dir).select(F.col("post_id").cast("int").alias("post_id"), "avglf1", "avglf2", "avglf3", codec.encode_blob(F.col("coefs"), SMALL).alias("sig"))
    odd, fifth = F.pmod("post_id", F.lit(2)) == 1, F.pmod("post_id", F.lit(5)) == 0
    e.full_load(d.where(~odd))
    e.upsert_signatures(d.where(odd), _now())
    e.delete(d.where(fifth).select("post_id"), _now())
    return e


@query(f"WITH {TERMS} SELECT bucket, count(*) AS images FROM posts WHERE vec_id % 5 <> 0 GROUP BY bucket")
def index_bulk_build(spark, sf_dir):
    """The stored posting lists' sizes after a load, events and a compaction."""
    e = _engine(spark, sf_dir)
    e.compact()
    return e.live()[2].groupBy("bucket").agg(F.count("*").alias("images"))


@query(f"""WITH {TERMS} SELECT bucket, count(*) AS images FROM posts WHERE vec_id % 5 <> 0 GROUP BY bucket""")
def index_after_events(spark, sf_dir):
    """The census that is kept through events, without a compaction."""
    return _engine(spark, sf_dir).live()[1].where("images <> 0")


@query("""WITH n AS (SELECT count(*) AS every, count(*) FILTER (vec_id % 2 = 0) AS even, count(*) FILTER (vec_id % 2 = 1) AS odd, count(*) FILTER (vec_id % 5 = 0) AS fifth FROM embeddings)
    SELECT unnest(['lumisig_live ' || CAST(CAST(every - fifth AS DOUBLE) AS VARCHAR), 'lumisig_cursor ' || CAST(CAST(1 + odd + fifth AS DOUBLE) AS VARCHAR), 'lumisig_horizon 1.0',
      'lumisig_writes_total{op="upsert"} ' || odd, 'lumisig_writes_total{op="delete"} ' || fifth]) AS line FROM n""")
def status_gauges(spark, sf_dir):
    return _engine(spark, sf_dir).metrics(_now()).where(F.col("line").rlike("^lumisig_(live|cursor|horizon|writes_total)\\b"))
