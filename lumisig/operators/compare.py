"""Differences between the results of two engines, with what may differ accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EPSILON


def verdicts(oracle: DataFrame, subject: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, ok, max_delta, problems) for two tables (query_id, post_id, score; of the subject also black).

    A shared post's scores may differ by epsilon. A post that one side lacks is a problem only if
    its score is over that side's worst (of the subject, worst that is not black) by more than
    epsilon. Black posts that only the subject has are accepted.
    """
    o = oracle.select("query_id", "post_id", F.col("score").cast("double").alias("o"))
    s = subject.select("query_id", "post_id", F.col("score").cast("double").alias("s"), "black")
    ends = s.groupBy("query_id").agg(F.min(F.when(~F.col("black"), F.col("s"))).alias("s_min")).join(o.groupBy("query_id").agg(F.min("o").alias("o_min")), "query_id", "full_outer")
    d = o.join(s, ["query_id", "post_id"], "full_outer").join(ends, "query_id")
    delta = F.abs(F.col("s") - F.col("o"))
    bad = (
        F.when(F.col("o").isNotNull() & F.col("s").isNotNull(), delta > epsilon)
        .when(F.col("s").isNull(), F.coalesce(F.col("o") > F.col("s_min") + epsilon, F.lit(False)))
        .otherwise(F.coalesce(~F.col("black") & (F.col("s") > F.col("o_min") + epsilon), F.lit(False)))
    )
    n = F.count_if(bad)
    return d.groupBy("query_id").agg((n == 0).alias("ok"), F.coalesce(F.max(delta), F.lit(0.0)).alias("max_delta"), n.alias("problems"))


def report(judged: DataFrame) -> DataFrame:
    """(queries, failed, max_delta)."""
    return judged.agg(F.count("*").alias("queries"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.max("max_delta"), F.lit(0.0)).alias("max_delta"))


def write_report(judged: DataFrame, path: str) -> None:
    """The verdicts and their report as JSON: ``path/verdicts``, a line a query, and ``path/report``, one line."""
    judged.write.mode("overwrite").json(f"{path}/verdicts")
    report(judged.sparkSession.read.schema(judged.schema).json(f"{path}/verdicts")).coalesce(1).write.mode("overwrite").json(f"{path}/report")
