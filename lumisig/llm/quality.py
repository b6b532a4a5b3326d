"""Document rules and host verdicts, in DataFrame functions only.

Each document gets its counts; rule failures are summed by host, each host's
rate is shrunk with a beta prior fitted to all hosts, and the host's verdict
joins back to its documents, where it sets the limits that they are judged by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Limits:
    """A document's limits, and how a host's record moves them.

    A host's rate of breaking a rule has a beta posterior. Where that says, at ``sure`` standard
    deviations, that the host breaks a soft rule more than twice as often as the corpus, its documents
    are judged at half the rule's limit; where it says less than half as often, at one and a half times the
    limit. A host that breaks any rule in more than half of its documents, as surely, goes as a whole.
    """

    min_words: int = 20
    repeat_percent: int = 30
    symbol_percent: int = 6
    dup_line_percent: int = 30
    dup_lines: int = 3
    stutter_percent: int = 30
    sure: float = 2.326  # 99 % of a normal distribution, which stands for the beta posterior


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """(id, carry..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stutter).

    n_stutter: words equal to the one before. Null text counts as empty (all zero). Windows are told apart by a 64-bit hash of their
    words. Everything of a document is found within its row: no shuffle; work is linear in
    its length, but for a sort in documents that have a repeated window.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), *(F.col(c) for c in carry), text.alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", SPACE), lambda x: x != ""))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("l", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    starts = F.sequence(F.lit(1), F.size("w") - (WINDOW - 1))
    d = d.withColumn("h", F.when(F.size("w") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size("h") > F.size(F.array_distinct("h"))
    placed = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("s", F.when(repeats, placed))
    at = lambda i: F.get("s", i)["x"]
    found = F.filter("s", lambda x, i: F.coalesce((x["x"] == at(i - 1)) | F.lit(False), F.lit(False)) | F.coalesce((x["x"] == at(i + 1)) | F.lit(False), F.lit(False)))
    d = d.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(found, lambda x: x["i"]))))
    # each window adds the words that the one before it has not covered
    covered = F.aggregate(
        "p", F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    return d.select(
        "id", *carry, "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x, i: (i > 0) & (x == F.get("w", i - 1)))).cast("long").alias("n_stutter"),
    )


def base_rule(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))


def soft_rules(limits: Limits, halves: int = 2) -> dict[str, Column]:
    """Each soft rule's failure as a boolean of the counts, at ``halves`` halves of its limit."""
    over = lambda n, percent, of: 200 * F.col(n) > halves * percent * F.col(of)
    return {
        "symbols": over("n_symbols", limits.symbol_percent, "word_chars"),
        "lines": (F.col("n_dup_lines") >= limits.dup_lines) & over("n_dup_lines", limits.dup_line_percent, "n_lines"),
        "stutter": over("n_stutter", limits.stutter_percent, "n_words"),
    }


#: Rules whose limits a host's record moves.
SOFT = ("symbols", "lines", "stutter")


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n, and for each soft rule and any: m_ the corpus's rate, p_ and sd_ the posterior mean and deviation of the host's), one row per host.

    The prior of each rule is a beta distribution with the mean and variance of the hosts'
    rates (method of moments over hosts of at least two documents). Where there is no variance
    to fit, its strength is one document.
    """
    names = [*SOFT, "any"]
    host = judged.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"f_{r}").cast("long")).alias(r) for r in names))
    rate = lambda r: F.when(F.col("n") >= 2, F.col(r) / F.col("n"))
    prior = host.agg(*(x for r in names for x in (F.coalesce(F.sum(r) / F.sum("n"), F.lit(0.0)).alias(f"m_{r}"), F.coalesce(F.var_samp(rate(r)), F.lit(0.0)).alias(f"v_{r}"))))
    for r in names:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        k = F.when((v > 0) & (m * (1 - m) / F.when(v > 0, v) > 2), m * (1 - m) / F.when(v > 0, v) - 1).otherwise(F.lit(1.0))
        prior = prior.withColumn(f"k_{r}", F.least(k, F.lit(10_000.0)))
    d = host.crossJoin(F.broadcast(prior))  # the prior is one row
    for r in names:
        strength = F.col("n") + F.col(f"k_{r}")
        d = d.withColumn(f"p_{r}", (F.col(r) + F.col(f"m_{r}") * F.col(f"k_{r}")) / strength)
        d = d.withColumn(f"sd_{r}", F.sqrt(F.col(f"p_{r}") * (1 - F.col(f"p_{r}")) / (strength + 1)))
    return d.select("host", "n", *(f"{x}_{r}" for r in names for x in ("m", "p", "sd")))


def judge(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", salts: int = 32, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry..., counts..., base_failed, host_rate, by_host, kept) for each row of ``docs``.

    host_rate is the posterior mean of the host's rate of breaking any rule; by_host says whether
    the host's verdict changed the document's. Null or absent text fails the base rule. A null host is a
    host of its own. Repeated rows are judged and counted as often as they stand. A hot host's rows are
    dealt over ``salts`` tasks in the join; sums by host are combined before they are shuffled.
    """
    d = counts(docs.withColumn("__host", F.coalesce(F.col(host_col).cast("string"), F.lit("")) if host_col in docs.columns else F.lit("")), id_col, text_col, "__host", *carry)
    no = lambda c: F.coalesce(c, F.lit(False))
    d = d.select("*", no(base_rule(limits)).alias("f_base"), *(no(c).alias(f"f_{r}") for r, c in soft_rules(limits).items())).withColumnRenamed("__host", "host")
    d = materialize(d.withColumn("f_any", F.greatest("f_base", *(f"f_{r}" for r in SOFT))))
    rates = host_rates(d)
    above = lambda r, level: F.col(f"p_{r}") - level > limits.sure * F.col(f"sd_{r}")
    below = lambda r, level: level - F.col(f"p_{r}") > limits.sure * F.col(f"sd_{r}")
    halves = [F.when(above(r, 2 * F.col(f"m_{r}")), 1).when(below(r, F.col(f"m_{r}") / 2), 3).otherwise(2).alias(f"h_{r}") for r in SOFT]
    rates = rates.select("host", F.col("p_any").alias("host_rate"), above("any", F.lit(0.5)).alias("rotten"), *halves, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    d = d.withColumn("salt", F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(salts)).cast("int")).join(rates, ["host", "salt"])
    strict, loose = soft_rules(limits, 1), soft_rules(limits, 3)
    alone, bad = F.col("f_base"), F.col("f_base") | F.col("rotten")
    for r in SOFT:
        alone = alone | F.col(f"f_{r}")
        bad = bad | F.when(F.col(f"h_{r}") == 1, no(strict[r])).when(F.col(f"h_{r}") == 3, no(loose[r])).otherwise(F.col(f"f_{r}"))
    return d.select("id", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", F.col("f_base").alias("base_failed"), "host_rate", (bad != alone).alias("by_host"), (~bad).alias("kept"))
