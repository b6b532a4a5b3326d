"""Toxicity grades by cumulative-link ordinal regression on sparse words.

P(grade <= k) = s(t[k] - w.x): the weights w are shared by all grades, only the
ordered thresholds t differ. x tells which of the chosen words a text has. The
prediction is the expected grade.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A-Z to a-z; ASCII punctuation and control characters to spaces.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def words(text: bytes | None) -> set[bytes]:
    """The different words of a whole text, and their beginnings of four and five bytes, marked by an asterisk."""
    found = set((text or b"").translate(_CLEAN).split())
    return found | {w[:4] + b"*" for w in found if len(w) > 4} | {w[:5] + b"*" for w in found if len(w) > 5}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """``vocabulary``: word to weight; ``cuts``: the ordered thresholds, one fewer than there are grades."""

    vocabulary: dict[bytes, float]
    cuts: np.ndarray
    known: frozenset = field(init=False, repr=False)

    def __post_init__(self):
        self.known = frozenset(self.vocabulary)

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return _sigmoid(np.asarray(score, float)[:, None] - self.cuts[None])

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        get = self.vocabulary.__getitem__
        return np.array([sum(map(get, sorted(words(t) & self.known))) for t in texts], float)

    @classmethod
    def fit(cls, vocabulary: list[bytes], rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 400, rate: float = 0.05, penalty: float = 1e-4) -> Ordinal:
        """Maximum likelihood by Adam over the whole sample; rows hold the places of a text's words."""
        n, at = len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
        share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n
        share = np.clip(share, 1e-3, 1 - 1e-3)
        cuts = np.log(share / (1 - share))
        gap = np.log(np.maximum(np.diff(cuts), 0.05))
        p = np.concatenate([np.zeros(len(vocabulary)), cuts[:1], gap])
        m, v, k = np.zeros_like(p), np.zeros_like(p), len(vocabulary)
        for step in range(1, rounds + 1):
            cuts = p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))])
            score = np.bincount(at, p[col], n)
            low = np.concatenate([[-np.inf], cuts])[grades] - score
            high = np.concatenate([cuts, [np.inf]])[grades] - score
            with np.errstate(over="ignore"):
                sl, sh = np.where(np.isinf(low), 0.0, _sigmoid(low)), np.where(np.isinf(high), 1.0, _sigmoid(high))
            mass = np.maximum(sh - sl, 1e-12)
            dl, dh = sl * (1 - sl) / mass, sh * (1 - sh) / mass
            g_cut = np.array([(dl[grades == j + 1].sum() - dh[grades == j].sum()) / n for j in range(len(cuts))])
            g = np.concatenate([np.bincount(col, (dh - dl)[at], k) / n + penalty * p[:k], [g_cut.sum()], [g_cut[j + 1 :].sum() * np.exp(p[k + 1 + j]) for j in range(len(cuts) - 1)]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(dict(zip(vocabulary, p[:k].tolist(), strict=True)), p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))]))


def _places(vocabulary: list[bytes]):
    place = {w: i for i, w in enumerate(vocabulary)}
    known = frozenset(place)

    @F.arrow_udf("array<int>")
    def run(t: pa.Array) -> pa.Array:
        return pa.array([sorted(place[w] for w in words(x.as_py()) & known) for x in t], pa.list_(pa.int32()))

    return run


def _counts(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """(w, n, bad): in how many texts (y, t) a word is, and in how many toxic ones; combined by task as far as memory for ``most`` words goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        bad: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(n)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([n[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], names=["w", "n", "bad"])

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = words(t.as_py())
                n.update(found)
                if y > 0:
                    bad.update(found)
                if len(n) > most:
                    yield out()
                    n.clear()
                    bad.clear()
        yield out()

    each = rows.select("y", F.col("t").cast("binary")).mapInArrow(run, "w binary, n long, bad long")
    return each.groupBy("w").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_words: int = 2048, least: int = 3, z: float = 3.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grade_col: str | None = None) -> Ordinal:
    """Fit to a bounded sample of labelled rows: the ``max_rows`` with the smallest hashes of their ids.

    Words are chosen by the log-odds of a toxic text that has them: at least ``least`` texts, ``z``
    standard errors from even, the ``max_words`` farthest. Where the labels have no ``grade_col``
    (0 clean, then more and more severe), a toxic text's grade is made from how many features of
    the strongly toxic kind it has: under four 1, under eight 2, more 3. Rows with a null label
    or id stay out; null text has no words. Without both kinds of label the model says 0 for all.
    """
    y = F.col(grade_col or label_col).cast("int")
    lab = labels.where(y.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), y.alias("y")).dropDuplicates(["id"])
    known = docs.select(F.col(id_col).cast("long").alias("id")).join(lab, "id", "left_semi").distinct()
    chosen = lab.join(F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(max_rows)), "id")
    # the sample is bounded, and read from the documents once
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "id").dropDuplicates(["id"]))
    seen = _counts(rows).where(F.col("n") >= least)
    both = rows.agg(F.count("*"), F.sum((F.col("y") > 0).cast("long"))).first()
    n, bad = both[0], both[1] or 0
    if not bad or bad == n:
        return Ordinal({}, np.array([40.0]))
    a, b = F.col("bad"), F.col("n") - F.col("bad")
    odds = F.log((a + 0.5) / (F.lit(bad) - a + 0.5)) - F.log((b + 0.5) / (F.lit(n - bad) - b + 0.5))
    far = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    words_ = seen.select("w", "n", "bad", far.alias("z")).where(F.abs("z") >= z).orderBy(F.abs("z").desc(), "w").limit(max_words).collect()
    vocabulary = [bytes(r["w"]) for r in words_]
    strong = {i for i, r in enumerate(words_) if r["z"] > 0 and r["bad"] >= 0.9 * r["n"]}
    sample = sorted(rows.select("id", "y", _places(vocabulary)(F.col("t").cast("binary")).alias("x")).collect(), key=lambda r: r["id"])
    grades = np.array([r["y"] if grade_col or r["y"] <= 0 else 1 + min(2, len(strong.intersection(r["x"])) // 4) for r in sample])
    return Ordinal.fit(vocabulary, [np.array(r["x"], np.int64) for r in sample], grades, int(grades.max()) + 1)


def severity(model: Ordinal, text: Column) -> Column:
    """(severity, toxic): the expected grade of a text, and whether it is more likely over grade 0 than not. Null text has no words."""

    @F.arrow_udf("severity double, toxic boolean")
    def run(t: pa.Array) -> pa.Array:
        p = model.at_least(model.scores([x.as_py() for x in t]))
        return pa.StructArray.from_arrays([pa.array(p.sum(1)), pa.array(p[:, 0] >= 0.5)], names=["severity", "toxic"])

    return run(text.cast("string").cast("binary"))
