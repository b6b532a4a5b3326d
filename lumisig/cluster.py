"""What a cluster needs: the package's code on executors, and tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the cluster names no shared folder, as in local tests.
FALLBACK_SCRATCH = "/tmp/checkpoints"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's code to the executors, once for each Spark context, and return ``spark``.

    Needed where the package is not installed there; the files are those that
    ``--py-files`` would name.
    """
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_lumisig_shipped", False):
        return spark
    target = Path(tempfile.mkdtemp()) / "lumisig.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._lumisig_shipped = True
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """A new name in the shared folder that ``spark.checkpoint.dir`` names; in local mode, where that is unset, in the fallback."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    path = f"{(base or FALLBACK_SCRATCH).rstrip('/')}/lumisig-{uuid.uuid4().hex}"
    sc._lumisig_scratch = [*getattr(sc, "_lumisig_scratch", ()), path]
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this application has written for itself, once its results are no longer needed; returns how many tables."""
    sc = spark.sparkContext
    paths = getattr(sc, "_lumisig_scratch", ())
    for x in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(x)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    sc._lumisig_scratch = []
    return len(paths)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    Parquet rather than ``checkpoint()``: it is written once, pruned by column,
    its size is known to the planner, and a lost executor loses nothing.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: str, name: str, after: int = 0) -> DataFrame:
    """``rows`` numbered after ``after`` in the order of the key, without gaps: by range partitions and their offsets, not in one task.

    Partitions are written before they are counted, as they may be cut otherwise when they are made again.
    """
    d = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    d = materialize(d)
    first = d.groupBy("__p").agg(F.min("__i").alias("__f"), F.count("*").alias("__n"))
    first = first.select("__p", "__f", F.expr("SUM(__n) OVER (ORDER BY __p) - __n").alias("__o"))  # a row a partition
    return d.join(F.broadcast(first), "__p").withColumn(name, F.col("__i") - F.col("__f") + F.col("__o") + 1 + after).drop("__p", "__i", "__f", "__o")
