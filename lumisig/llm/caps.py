"""Embedding near-duplicates by spherical-cap filters.

Filter directions are sums of codewords, one from each block of a randomly
rotated vector: a structured random product code. Each vector is list-decoded,
block by block with pruning, to all directions that it exceeds by ``height``;
vectors that share a filter are compared. Equal vectors are one node. Filters
that many different vectors share are compared in bounded blocks, which return
counts and a spanning forest of links, not pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast
from .components import connected_components


def _share(height: float, dim: int, apart: float = 0.0) -> float:
    """Of all directions, those within a cap of this height around each of two unit vectors whose angle is twice ``apart``."""
    top = np.arccos(height) - apart
    if top <= 0:
        return 0.0
    turn = np.linspace(0, top, 1001)
    here = np.maximum(1 - (height / np.cos(turn + apart)) ** 2, 0) ** ((dim - 2) / 2) if dim > 2 else np.ones_like(turn)
    return float(np.trapezoid(here, turn) / np.pi)


@dataclass(frozen=True)
class Caps:
    """``codes`` independent product codes, whose caps are made for a dimension so that vectors at the least cosine share ``common`` filters on average.

    Caps are as steep as that allows with at most ``words`` squared directions a code, but not steeper than
    ``steepest``; where few directions are enough a code has one block, else two. A vector exceeds some 25 to 70 filters in any
    dimension, and two vectors with cosine 0.93 miss each other in under one of 100 cases (tests/llm measures both from 2 to
    384 dimensions).
    """

    codes: int = 12
    words: int = 400
    common: float = 20.0
    steepest: float = 0.8
    seed: int = 11

    def plan(self, dim: int, least: float) -> tuple[float, int, int]:
        """(height, blocks, codewords of a block)."""
        return _planned(self, dim, least)

    def directions(self, dim: int, least: float) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        return _directions(self, dim, least)


@functools.lru_cache(maxsize=64)
def _planned(caps: Caps, dim: int, least: float) -> tuple[float, int, int]:
    if dim < 2:
        return 0.5, 1, 8
    apart = float(np.arccos(np.clip(least, -1, 1)) / 2)
    for height in np.linspace(caps.steepest, 0.02, 400):
        both = _share(height, dim, apart)
        if both and caps.common / both <= caps.codes * caps.words**2:
            break
    each = min(caps.common / max(both, 1e-12), caps.codes * caps.words**2) / caps.codes
    blocks = 1 if dim < 4 or each <= 5 * caps.words else 2
    return float(height), blocks, int(np.ceil(each ** (1 / blocks)))


@functools.lru_cache(maxsize=8)
def _directions(caps: Caps, dim: int, least: float) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each code: a rotation, and the unit codewords of each block."""
    _, blocks, words = caps.plan(dim, least)
    out = []
    for c in range(caps.codes):
        r = np.random.default_rng([caps.seed, c, dim])
        q, s = np.linalg.qr(r.standard_normal((dim, dim)))
        edges = np.linspace(0, dim, blocks + 1).astype(int)
        books = [r.standard_normal((words, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        out.append((q * np.sign(np.diag(s)), [x / np.linalg.norm(x, axis=1, keepdims=True) for x in books]))
    return out


def decode(x: np.ndarray, caps: Caps, least: float = 0.93) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for each filter that a row of unit vectors exceeds."""
    rows, filters = [], []
    height, _, words = caps.plan(x.shape[1], least)
    for c, (rotation, books) in enumerate(caps.directions(x.shape[1], least)):
        y = x @ rotation
        need, at, dots = height * np.sqrt(len(books)), 0, []
        for book in books:
            dots.append(y[:, at : at + book.shape[1]] @ book.T)
            at += book.shape[1]
        rest = np.cumsum([d.max(1) for d in dots[::-1]], axis=0)[::-1]
        row, code, total = np.arange(len(x)), np.full(len(x), c, np.int64), np.zeros(len(x))
        for b, d in enumerate(dots):
            best = rest[b + 1][row] if b + 1 < len(dots) else 0.0
            keep, word = np.nonzero(total[:, None] + d[row] + np.reshape(best, (-1, 1)) >= need)
            row, code, total = row[keep], code[keep] * words + word, total[keep] + d[row[keep], word]
        rows.append(row)
        filters.append(code)
    return np.concatenate(rows), np.concatenate(filters)


def _filters(classes: DataFrame, caps: Caps, least: float) -> DataFrame:
    """(cid, label, u, n, fs) of ``classes`` (cid, label, e, n): u is e scaled by a power of two to components of at most one, fs its sorted filters.

    The scaling is exact, and keeps products from overflow and underflow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.asarray(v, np.float64) for v in b.column(2).to_pylist()]
            vectors = [np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in vectors]
            found: list[list[int]] = [[] for _ in vectors]
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                for at in np.array_split(np.flatnonzero(sizes == dim), np.count_nonzero(sizes == dim) // 2048 + 1):
                    x = np.stack([vectors[i] for i in at])
                    row, code = decode(x / np.linalg.norm(x, axis=1, keepdims=True), caps, least)
                    order = np.lexsort((code, row))
                    for i, codes in zip(at, np.split(code[order], np.searchsorted(row[order], np.arange(1, len(at)))), strict=True):
                        found[i] = codes
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.list_(pa.float64())), b.column(3), pa.array(found, pa.list_(pa.int64()))], names=["cid", "label", "u", "n", "fs"])

    return classes.select("cid", "label", "e", "n").mapInArrow(run, "cid long, label string, u array<double>, n long, fs array<long>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _crowd(least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Of two blocks of one filter: how many rows each vector links to, and links that join two groups.

        A pair counts in the first of its common filters, and only where no uncrowded filter has it too.
        """
        here = group["f"].iloc[0]
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        same = group["tb"].iloc[0] == group["pb"].iloc[0]
        ids = sorted({f for fs, calm in zip(group["fs"], group["calm"], strict=True) for f in (*calm, *(x for x in fs if x < here))})
        place = {f: i for i, f in enumerate(ids)}

        def seen(part: pd.DataFrame) -> np.ndarray:
            m = np.zeros((len(part), len(ids) + 1), np.float32)
            for r, (fs, calm) in enumerate(zip(part["fs"], part["calm"], strict=True)):
                m[r, [place[f] for f in (*calm, *(x for x in fs if x < here))]] = 1
            return m

        a, b = (np.stack([np.asarray(v, float) for v in p["u"]]) if len(p) else np.zeros((0, 1)) for p in (left, right))
        va, vb, na, nb = left["cid"].to_numpy(), right["cid"].to_numpy(), left["n"].to_numpy(), right["n"].to_numpy()
        out: list[tuple] = []
        if len(a) and len(b):
            norm = lambda m: np.linalg.norm(m, axis=1)
            link = (a @ b.T >= least * norm(a)[:, None] * norm(b)[None]) & (seen(left) @ seen(right).T == 0)
            if same:
                link &= va[:, None] != vb[None]
            count_a, count_b = link @ nb, np.zeros(len(b), int) if same else na @ link
            out = [(int(v), int(n), None, None) for v, n in (*zip(va, count_a, strict=True), *zip(vb, count_b, strict=True)) if n]
            label = {v: v for v in (*va, *vb)}
            names = np.array([label[v] for v in vb])
            own = {v: i for i, v in enumerate(vb)} if same else {}
            mine = {v: v for v in va}
            for i, v in enumerate(va):
                now = names[own[v]] if same else mine[v]
                for name in np.unique(names[link[i]]):
                    if name != now:
                        out.append((None, None, int(v), int(vb[np.flatnonzero(link[i] & (names == name))[0]])))
                        names[names == name] = now
        return pd.DataFrame(out, columns=["cid", "n", "src", "dst"]).astype("Int64")

    return run


def join(vectors: DataFrame, least: float = 0.93, caps: Caps = Caps(), crowded: int = 64, block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id) for each row of ``vectors``.

    Rows are compared where labels are equal and not null and dimensions are equal, by cosine in
    double precision, whatever their magnitudes. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. n_links counts the other rows, copies included. Rows with a null id take part, but
    are nobody's component; where a whole component has none, component_id is null. Repeated rows link with each other;
    different vectors of one id are different rows.
    """
    e = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), e.alias("e"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("e").isNotNull() & ~odd & F.exists("e", lambda x: x != 0), F.lit(False))
    good = rows.where(usable)
    named = good.groupBy("label", "e").agg(F.min("id").alias("vid"), F.count("*").alias("n"))
    named = materialize(named.withColumn("cid", F.monotonically_increasing_id()))  # equal vectors are one class, by a number of its own
    classes = materialize(_filters(named, caps, least))
    held = classes.select("label", "cid", F.explode("fs").alias("f"))
    crowds = materialize(held.groupBy("label", "f").count().where(F.col("count") > crowded))
    any_crowd = not crowds.isEmpty()
    mark = sized_broadcast(crowds, 100_000) if any_crowd else crowds
    calm = held.join(mark, ["label", "f"], "left_anti") if any_crowd else held
    x, y = calm.alias("x"), calm.alias("y")
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.f") == F.col("y.f")) & (F.col("x.cid") < F.col("y.cid"))).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    unit = classes.select("cid", "n", "u", F.sqrt(_dot(F.col("u"), F.col("u"))).alias("size"))
    pairs = pairs.join(unit.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"), F.col("size").alias("sa")), "a")
    pairs = pairs.join(unit.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"), F.col("size").alias("sb")), "b")
    pairs = materialize(pairs.where(F.size("ua") == F.size("ub")).where(_dot(F.col("ua"), F.col("ub")) >= least * F.col("sa") * F.col("sb")).select("a", "b", "na", "nb"))
    counts = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("cid"), F.col("nb").alias("n")), F.struct(F.col("b").alias("cid"), F.col("na").alias("n")))).alias("p")).select("p.cid", "p.n")
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if any_crowd:
        in_crowd = held.join(mark, ["label", "f"])
        lists = in_crowd.groupBy("cid").agg(F.sort_array(F.collect_list("f")).alias("cs"))  # of one vector: bounded by its filters
        blocks = F.ceil(F.col("count") / block).cast("int")
        member = in_crowd.join(classes.select("cid", "n", "u", "fs"), "cid").join(lists, "cid").select(
            "label", "f", "cid", "n", "u", F.col("cs").alias("fs"), F.array_except("fs", "cs").alias("calm"), blocks.alias("nb"), F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("mine")
        )
        every = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
        common = ["label", "f", "cid", "n", "u", "fs", "calm"]
        left = member.select(*common, F.lit(0).alias("side"), F.col("mine").alias("tb"), every.alias("pb"))
        right = member.select(*common, F.lit(1).alias("side"), F.col("mine").alias("pb"), every.alias("tb"))
        met = materialize(left.unionByName(right).where("tb <= pb").groupBy("label", "f", F.size("u"), "tb", "pb").applyInPandas(_crowd(least), "cid long, n long, src long, dst long"))
        counts = counts.unionAll(met.where("cid IS NOT NULL").select("cid", "n"))
        edges = edges.unionAll(met.where("src IS NOT NULL").select("src", "dst"))
    counts = counts.groupBy("cid").agg(F.sum("n").alias("more"))
    parts = materialize(connected_components(edges).withColumnRenamed("node", "cid"))
    lowest = named.select("cid", "vid").join(parts, "cid").groupBy("component").agg(F.min("vid").alias("low"))
    parts = parts.join(sized_broadcast(materialize(lowest)), "component").select("cid", F.lit(True).alias("linked"), "low")
    found = materialize(
        named.join(counts, "cid", "left").join(parts, "cid", "left")
        .select("label", "e", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("linked"), F.col("low")).otherwise(F.col("vid")).alias("component_id"))
    )
    linked = good.join(found, ["label", "e"]).select("id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return linked.unionAll(rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
