"""Conversations in reply order, without the quotations that tell the order.

Quoted passages are found by their nested marks, normalised and hashed, with their
sentences and windows of words, and joined to the messages of the same conversation that first said them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisig.cluster import numbered

from .common import materialize, sized_broadcast

_MARK = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
#: Words of the windows by which parts of lines and paragraphs meet, however they are cut or wrapped.
WINDOW = 6
_NOTE = re.compile(r"[^\n]{1,200}\b(?:wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*", re.I)


def parse(text: str) -> list[tuple[int, str]]:
    """(level, text) of each run of lines at one quote level; 0 is the author's own. A line that introduces a quotation belongs to it."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARK.match(line)
        level, line = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if level and runs and not runs[-1][0]:
            own = runs[-1][1]
            while own and not own[-1].strip():
                own.pop()
            if own and _NOTE.fullmatch(own[-1]):
                own.pop()
            if not own:
                runs.pop()
        if runs and runs[-1][0] == level:
            runs[-1][1].append(line)
        else:
            runs.append((level, [line]))
    return [(level, "\n".join(lines)) for level, lines in runs]


def normal(passage: str) -> str:
    """Lower case, letters and digits only, single spaces."""
    return " ".join(re.findall(r"\w+", passage.lower()))


def passages(text: str) -> set[int]:
    """Hashes of the whole text, its paragraphs, lines and sentences, and of every ``WINDOW`` words in a row, each normalised."""
    parts = {normal(p) for p in (text, *re.split(r"\n\s*\n", text), *text.split("\n"), *_SENTENCE.split(text))} - {""}
    words = normal(text).split(" ")
    parts.update(" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1))
    return {xxhash.xxh64_intdigest(p) - (1 << 63) for p in parts}


def _parsed(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, quoted = [], []
            for t in b.column(2).to_pylist():
                runs = parse(t or "")
                mine = [r for level, r in runs if not level]
                said.append(sorted(set().union(*map(passages, mine)) | passages("\n".join(mine))))
                quoted.append([{"level": level, "hash": h} for level, r in runs if level for h in sorted(passages(r))])
            q = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.list_(pa.int64())), pa.array(quoted, q)], names=["conv", "turn", "said", "quoted"])

    return messages.select(F.col(conv).cast("long"), F.col(turn).cast("long"), F.col(text).cast("string")).mapInArrow(run, "conv long, turn long, said array<long>, quoted array<struct<level: int, hash: long>>")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, reply_to, thread, depth, n_quotes, position), one row per message.

    text is the message without quotations; reply_to the turn that it quotes: of the outermost
    level that is found, the earlier message with most of the passages, the latest of equals;
    null where it quotes none. thread is the turn where the chain of replies began, depth the replies
    since. position counts the messages of a conversation from 0 in reply order, which is that of (thread, turn): a message comes
    after the one it answers; repeated rows share theirs, and rows without a conversation or turn have none. A passage belongs to the first message of its conversation that says it. Null text is empty;
    messages with a null conversation or turn link with nothing; repeated rows return repeatedly.
    """
    parsed = materialize(_parsed(messages, conv, turn, text))
    quoted = materialize(parsed.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.level", "q.hash").distinct())
    if quoted.isEmpty():
        replies = None
    else:
        said = parsed.select("conv", "turn", F.explode("said").alias("hash"))
        first = materialize(said.groupBy("conv", "hash").agg(F.min("turn").alias("to")))
        votes = quoted.join(first, ["conv", "hash"]).where("to < turn").groupBy("conv", "turn", "level", "to").agg(F.count("*").alias("n"))
        best = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "to")).alias("b"))
        replies = materialize(best.select("conv", "turn", F.col("b.to").alias("to"), F.col("b.to").alias("top"), F.lit(1).alias("depth")))
        while True:  # each round doubles the steps that top is away
            up = replies.select("conv", F.col("turn").alias("top"), F.col("top").alias("top2"), F.col("depth").alias("depth2"))
            replies = materialize(replies.join(up, ["conv", "top"], "left").select("conv", "turn", "to", F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("top2").isNotNull().alias("moved")))
            if replies.where("moved").isEmpty():
                break
            replies = replies.drop("moved")
    has_role = role in messages.columns
    rows = messages.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), *([F.col(role).cast("string").alias("role")] if has_role else []), F.col(text).cast("string").alias("t"))
    place = parsed.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn").distinct()
    if replies is None:
        place = place.select("conv", "turn", F.lit(None).cast("long").alias("to"), F.col("turn").alias("top"), F.lit(0).alias("depth"))
    else:
        place = place.join(replies.select("conv", "turn", "to", "top", "depth"), ["conv", "turn"], "left").withColumn("top", F.coalesce("top", "turn"))
    place = materialize(place.select(F.struct("conv", "top", "turn").alias("k"), "to", "depth"))
    place = materialize(numbered(place, "k", "at")).select("k.*", "to", "depth", "at")
    first = sized_broadcast(materialize(place.groupBy("conv").agg(F.min("at").alias("first"))))
    place = place.join(first, "conv").withColumn("position", F.col("at") - F.col("first"))
    clean = _without_quotes()
    rows = rows.select("conv", "turn", F.col("role") if has_role else F.lit(None).cast("string").alias("role"), clean("t").alias("c")).select("conv", "turn", "role", "c.own", "c.n")
    out = rows.join(place, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("own").alias("text"), F.col("to").alias("reply_to"),
        F.coalesce("top", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("n").alias("n_quotes"), "position",
    )


def _without_quotes():
    @F.arrow_udf("own string, n long")
    def run(t: pa.Array) -> pa.Array:
        own, n = [], []
        for x in t.to_pylist():
            runs = parse(x or "")
            mine = [r for level, r in runs if not level]
            own.append(x or "" if len(mine) == len(runs) else "\n".join(y for r in mine if (y := r.strip("\n"))))
            n.append(len(runs) - len(mine))
        return pa.StructArray.from_arrays([pa.array(own, pa.string()), pa.array(n, pa.int64())], names=["own", "n"])

    return run
