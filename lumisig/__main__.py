"""Command line: load, synchronise, verify and ask a store.

    python -m lumisig import images.sqlite /shared/store
"""

from __future__ import annotations

import argparse
import json
import time
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import compare, corpus, metrics, sync
from .sources import files, sqlite
from .streaming.follower import Follower, converged


def _legacy(spark: SparkSession, path: str) -> DataFrame:
    sqlite.SqliteImages.register(spark)
    return spark.read.format("sqlite_images").load(path)


def _answers(engine: Engine, hashes: DataFrame, limit: int) -> DataFrame:
    """(query_id, post_id, score, black) for each hash of a corpus."""
    from .functions import codec

    q = hashes.select(F.xxhash64("hash").alias("query_id"), codec.decode_hash(F.col("hash"), engine.g).alias("d")).where("d.error IS NULL").dropDuplicates(["query_id"])
    q = q.select("query_id", *(F.get("d.avglf", F.lit(i)).alias(f"avglf{i + 1}") for i in range(3)), codec.encode_blob(F.col("d.sig"), engine.g).alias("sig"))
    found = engine.query(q, limit)
    return found.select("query_id", "post_id", "score", (codec.dc_prefix(F.col("hash")) == "0" * 16).alias("black"))


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """What a command did, as a row of JSON."""
    engine = Engine(spark, args.store) if "store" in args else None
    began = time.perf_counter()
    if args.command == "import":
        rows = _legacy(spark, args.sqlite)
        if args.incremental:
            return engine.synchronize(rows)
        engine.full_load(rows)
        n = engine.images().count()
        return {"rows": n, "seconds": round(time.perf_counter() - began, 3)}
    if args.command == "verify":
        return sync.verify(_legacy(spark, args.sqlite), engine.images().drop("seq"), "post_id", "sig", args.sample, corpus.shuffled(F.col("post_id"), 1)).first().asDict()
    if args.command == "stats":
        return {k: v for k, v in engine.status().first().asDict().items()}
    if args.command == "prune":
        return engine.prune(timedelta(days=args.days)) or {"busy": True}
    if args.command == "compact":
        return {"cursor": engine.compact(), "removed": engine.store.vacuum()}
    if args.command == "corpus":
        made = files.build_corpus(engine.images(), args.n, args.seed, engine.g).unionByName(files.synthetic_corpus(spark))
        files.write_corpus(made, args.out)
        return {"entries": files.read_corpus(spark, args.out).count()}
    if args.command == "subsample":
        return {"rows": sqlite.write(corpus.subsample(engine.images().drop("seq"), args.n, args.seed, "post_id", "__n").withColumn("post_id", F.col("__n").cast("int")), args.out)}
    if args.command == "diff":
        hashes = files.read_corpus(spark, args.corpus)
        oracle, subject = _answers(Engine(spark, args.oracle), hashes, args.limit), _answers(engine, hashes, args.limit)
        judged = compare.verdicts(oracle.drop("black"), subject)
        compare.write_report(judged, args.out)
        return compare.report(judged).first().asDict()
    if args.command == "bench":
        h = [r["hash"] for r in files.read_corpus(spark, args.corpus).limit(args.n).collect()]
        calls = []
        for x in h:
            at = time.perf_counter()
            try:
                engine.query_one(hash=x, limit=args.limit)
                calls.append((time.perf_counter() - at, False))
            except Exception:  # noqa: BLE001  counted
                calls.append((time.perf_counter() - at, True))
        d = spark.createDataFrame(calls, "seconds double, failed boolean")
        took = time.perf_counter() - began
        return {**metrics.throughput(d, took).first().asDict(), **metrics.quantiles(d, "seconds").first().asDict()}
    if args.command == "converge":
        f = Follower(spark, engine.store, args.state)
        f.follow()
        return {"seconds": round(converged(f, engine.store.cursor(), args.budget), 3), "cursor": f.cursor()}
    raise SystemExit(f"no command {args.command}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumisig", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *positional: str, **options) -> None:
        c = sub.add_parser(name, help=help_)
        for x in positional:
            c.add_argument(x)
        for x, default in options.items():
            c.add_argument(f"--{x}", default=default, **({"action": "store_true"} if default is False else {"type": type(default)}))

    command("import", "load a SQLite table, or with --incremental its differences", "sqlite", "store", incremental=False)
    command("verify", "compare counts and a sample of rows with a SQLite table", "sqlite", "store", sample=1000)
    command("stats", "images, tombstones, cursor, horizon and lag", "store")
    command("prune", "drop events older than --days that the snapshot holds", "store", days=7.0)
    command("compact", "write a new snapshot and remove old versions", "store")
    command("corpus", "write a stratified corpus of queries with the synthetic images", "store", "out", n=1000, seed=1)
    command("subsample", "write a renumbered sample as SQLite", "store", "out", n=1000, seed=1)
    command("diff", "compare the answers of two stores to a corpus", "oracle", "store", "corpus", "out", limit=10)
    command("bench", "ask one query after another and report latencies", "store", "corpus", n=100, limit=10)
    command("converge", "follow the store and report how long the state took", "store", "state", budget=5.0)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lumisig").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(run(spark, args), default=str))


if __name__ == "__main__":
    main()
