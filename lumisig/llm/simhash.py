"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is cut into segments. Each fingerprint stands in one table row
per segment under the segment's exact value, and probes the table with the
Hamming ball of radius one around each segment; matches are verified on the
complete distance. Fingerprints that are equal are one node, so copies are
never paired. Buckets with many different fingerprints are compared in bounded
blocks, each of which returns only links that join two groups (a spanning
forest), so that the links stay linear in the rows.

Texts that are merely similar (``SIMILAR``) differ in too many bits for that: their candidates
come from MinHash bands and are verified by exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, materialize, shuffled
from .components import connected_components

SEED = 42
CHUNK = 255 * 256
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


@dataclass(frozen=True)
class Code:
    """``words`` 64-bit words of fingerprint over ``shingle``-word shingles."""

    shingle: int
    words: int


@dataclass(frozen=True)
class Plan:
    """What is indexed and what is verified.

    ``index`` code words are cut into ``per_word`` segments of ``bits`` bits; ``verify``
    is the code whose complete distance must be ``max_distance`` or less (None: the index
    code itself). ``near`` prefilters candidates on the verified code's first word.
    """

    index: Code
    per_word: int
    bits: int
    max_distance: int
    near: int
    verify: Code | None = None

    @property
    def checked(self) -> Code:
        return self.verify or self.index


#: 64 bits over three words, two segments of 32 bits: of 3 differing bits one segment has at most one, so no pair is missed.
STRICT = Plan(Code(3, 1), per_word=2, bits=32, max_distance=3, near=3)


@dataclass(frozen=True)
class Bands:
    """All pairs of Jaccard similarity ``least`` or more over ``shingle``-word shingles.

    Candidates agree in one of ``bands`` groups of ``rows`` MinHash minima; they are verified on
    their complete sets of shingles.
    """

    shingle: int
    bands: int
    rows: int
    least: float


#: At a similarity of 0.8 a band agrees with probability 0.41, however the edits lie, so that 0.02 % of such pairs are in no band together.
SIMILAR = Bands(5, bands=16, rows=4, least=0.8)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    m = len(bits) // 255 * 255
    return bits[:m].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[m:].sum(0, dtype=np.uint8)


def _derived(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each shingle; the 0-th is XXH64 itself."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(k) * _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


def fingerprint(words: list[bytes], code: Code) -> list[int]:
    """The fingerprint's 64-bit words, unsigned. No words give zeros."""
    if not words:
        return [0] * code.words
    k = min(code.shingle, len(words))
    n = len(words) - k + 1
    ones = np.zeros((code.words, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        end = min(n, at + CHUNK)
        parts = [words[at + i : end + i] for i in range(k)]
        h = np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*parts))), np.uint64, end - at)
        for w in range(code.words):
            ones[w] += _ones(_derived(h, w))
    return [int(x) for x in np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64).ravel()]


def fingerprints(docs: DataFrame, codes: list[Code], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, w0, w1, ...): the words of all ``codes`` in turn, as signed longs. Null text counts as empty."""
    n = sum(c.words for c in codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((b.num_rows, n), np.uint64)
            for i, t in enumerate(b.column(1)):
                t = t.as_py()
                if t:
                    words = t.lower().split()  # bytes: A-Z and ASCII white space only
                    out[i] = [x for c in codes for x in fingerprint(words, c)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, j].view(np.int64)) for j in range(n))], names=["id", *(f"w{j}" for j in range(n))])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(
        run, "id long, " + ", ".join(f"w{j} long" for j in range(n))
    )


def _segments(plan: Plan) -> list[Column]:
    """The value of each segment, with the segment's number above its bits."""
    mask = (1 << plan.bits) - 1
    return [
        (F.shiftrightunsigned(F.col(f"w{w}"), s * plan.bits).bitwiseAND(F.lit(mask))).bitwiseOR(F.lit((w * plan.per_word + s) << plan.bits))
        for w in range(plan.index.words)
        for s in range(plan.per_word)
    ]


def _cleared(segment: Column, bits: int) -> Column:
    """The segment with each of its set bits cleared in turn."""
    powers = F.array(*(F.lit(1 << i) for i in range(bits))).cast("array<bigint>")
    return F.transform(F.filter(powers, lambda p: segment.bitwiseAND(p) != 0), lambda p: segment.bitwiseXOR(p))


def _forest(plan: Plan):
    k = plan.checked.words

    def run(group: pa.Table) -> pa.Table:
        """Links between table rows and probe rows that join two groups, of all within the distance."""
        reps, probe = group["rep"].to_numpy(), group["probe"].to_numpy()
        code = np.stack([group[f"v{j}"].to_numpy().view(np.uint64) for j in range(k)], 1)
        t, p = np.flatnonzero(~probe), np.flatnonzero(probe)
        label = np.unique(reps, return_inverse=True)[1]
        src, dst = [], []
        for i in p:
            d = np.bitwise_count(code[t] ^ code[i]).sum(1, dtype=np.int64)
            hit = t[d <= plan.max_distance]
            found, first = np.unique(label[hit], return_index=True)
            for lab, j in zip(found, hit[first], strict=True):
                if lab != label[i]:
                    label[label == lab] = label[i]
                    src.append(reps[i])
                    dst.append(reps[j])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def links(reps: DataFrame, plan: Plan, crowded: int = 8, block: int = 2048) -> DataFrame:
    """(src, dst) that connect all different fingerprints within the plan's distance.

    ``reps``: (rep, w..., v...), one row per different fingerprint; v are the verified words.
    Segment values that more than ``crowded`` fingerprints share are dealt out as blocks of
    at most about ``block`` rows; all pairs of blocks are compared, none is capped or dropped.
    """
    k = plan.checked.words
    segs = _segments(plan)
    table = reps.select("rep", F.col("v0").alias("c"), F.explode(F.array(*segs)).alias("key"))
    own, ball = F.array(*segs), F.concat(*(_cleared(x, plan.bits) for x in segs))
    # of two segments that differ in one bit, that with the bit set finds the other
    probes = reps.select(
        F.col("rep").alias("rep2"), F.col("v0").alias("c2"),
        F.explode(F.concat(F.transform(own, lambda x: F.struct(x.alias("key"), F.lit(True).alias("same"))), F.transform(ball, lambda x: F.struct(x.alias("key"), F.lit(False).alias("same"))))).alias("p"),
    ).select("rep2", "c2", "p.key", "p.same")
    crowds = materialize(table.groupBy("key").count().where(F.col("count") > crowded))
    any_crowd = not crowds.isEmpty()
    calm, mark = table, crowds
    if any_crowd:
        mark = F.broadcast(crowds) if fits(crowds, 100_000) else shuffled(crowds)
        calm = table.join(mark, "key", "left_anti")
    near = (F.bit_count(F.col("c").bitwiseXOR(F.col("c2"))) <= plan.near) & (~F.col("same") | (F.col("rep2") > F.col("rep")))
    found = calm.join(shuffled(probes), "key").where(near).select(F.greatest("rep", "rep2").alias("src"), F.least("rep", "rep2").alias("dst")).distinct()
    verify = [F.col(f"v{j}") for j in range(k)]
    if k > 1:
        found = materialize(found)
        a = reps.select(F.col("rep").alias("src"), *verify)
        b = reps.select(F.col("rep").alias("dst"), *(F.col(f"v{j}").alias(f"u{j}") for j in range(k)))
        apart = sum((F.bit_count(F.col(f"v{j}").bitwiseXOR(F.col(f"u{j}"))) for j in range(k)), F.lit(0))
        found = found.join(shuffled(a), "src").join(shuffled(b), "dst").where(apart <= plan.max_distance).select("src", "dst")
    if not any_crowd:
        return found
    full = reps.select("rep", *verify)
    t = table.join(mark, "key").select("key", "rep", F.ceil(F.col("count") / block).cast("int").alias("nt"))
    p = materialize(probes.join(mark, "key").select("key", F.col("rep2").alias("rep"), F.ceil(F.col("count") / block).cast("int").alias("nt")))
    np_ = p.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("np"))
    np_ = F.broadcast(np_) if fits(crowds, 100_000) else shuffled(np_)
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = t.join(np_, "key").select("key", "rep", F.lit(False).alias("probe"), dealt("nt").alias("tb"), span("np").alias("pb"))
    right = p.join(np_, "key").select("key", "rep", F.lit(True).alias("probe"), dealt("np").alias("pb"), span("nt").alias("tb"))
    both = left.unionByName(right).join(shuffled(full), "rep")
    return found.unionAll(both.groupBy("key", "tb", "pb").applyInArrow(_forest(plan), "src long, dst long"))


def classes(docs: DataFrame, plan: Plan = STRICT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, v0, ..., component_id) for each row of ``docs``.

    component_id is the smallest id that links reach; rows with equal fingerprints are linked
    too. Null text counts as empty, and all texts without words share fingerprint zero. A row
    with a null id has a fingerprint; its component is the smallest id that others give it, or
    null. Repeated rows return repeatedly. An empty table gives an empty result.
    """
    codes = [plan.index] + ([plan.verify] if plan.verify else [])
    fp = fingerprints(docs, codes, id_col, text_col)
    first = plan.index.words if plan.verify else 0
    ws, vs = [f"w{j}" for j in range(plan.index.words)], [f"v{j}" for j in range(plan.checked.words)]
    fp = materialize(fp.select("id", *ws, *(F.col(f"w{first + j}").alias(v) for j, v in enumerate(vs))))
    names = list(dict.fromkeys(ws + vs))
    reps = materialize(fp.groupBy(*names).agg(F.min("id").alias("rep")))
    parts = connected_components(links(reps.where("rep IS NOT NULL"), plan))
    named = materialize(reps.join(shuffled(parts), reps["rep"] == parts["node"], "left").select(*names, F.coalesce("component", "rep").alias("component_id")))
    return fp.join(shuffled(named), names).select("id", *vs, "component_id")


def hex_digits(word: str) -> Column:
    """A 64-bit word as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(word)), 16, "0"))


def shingle_set(words: list[bytes], k: int) -> np.ndarray:
    """The different hashes of the k-word shingles, ascending; shorter texts are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    parts = [words[i : len(words) - k + 1 + i] for i in range(k)]
    return np.unique(np.fromiter((digest(s, SEED) for s in map(b" ".join, zip(*parts))), np.uint64, len(words) - k + 1))


def _band_keys(h: np.ndarray, plan: Bands, factors: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band."""
    if not len(h):
        return []
    low = np.full(len(factors), 2**64 - 1, np.uint64)
    for at in range(0, len(h), 8192):
        low = np.minimum(low, (h[at : at + 8192] * factors[:, None]).min(1))
    return [xxhash.xxh64_intdigest(low[i * plan.rows : (i + 1) * plan.rows].tobytes(), i) - (1 << 63) for i in range(plan.bands)]


def _signed(docs: DataFrame, plan: Bands, id_col: str, text_col: str) -> DataFrame:
    """(id, s0, s1, keys): a 128-bit digest of the text's set of shingles, and its band keys."""
    factors = _derived(np.arange(1, plan.bands * plan.rows + 1, dtype=np.uint64), 1) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, keys = np.zeros((b.num_rows, 2), np.int64), []
            for i, t in enumerate(b.column(1)):
                h = shingle_set((t.as_py() or b"").lower().split(), plan.shingle)
                digests[i] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                keys.append(_band_keys(h, plan, factors))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(keys, pa.list_(pa.int64()))], names=["id", "s0", "s1", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "id long, s0 long, s1 long, keys array<long>")


def _shingled(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(rep, s): the bytes of each text's set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingle_set((t.as_py() or b"").lower().split(), k).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary())], names=["rep", "s"])

    return docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(run, "rep long, s binary")


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (small + large - both)


def _verified(pairs: DataFrame, sets: DataFrame, least: float, salt: int = 512) -> DataFrame:
    """The rows of ``pairs`` (src, dst) whose sets are alike. A dst of many pairs is dealt over tasks."""
    hot = pairs.groupBy("dst").agg(F.ceil(F.count("*") / salt).cast("int").alias("m")).where("m > 1")
    hot = F.broadcast(hot) if fits(hot, 100_000) else shuffled(hot)
    left = pairs.join(hot, "dst", "left").select("src", "dst", F.pmod(F.xxhash64("src"), F.coalesce("m", F.lit(1))).cast("int").alias("z"))
    right = sets.withColumnRenamed("rep", "dst").join(hot, "dst", "left").select("dst", F.col("s").alias("sd"), F.explode(F.sequence(F.lit(0), F.coalesce("m", F.lit(1)) - 1)).alias("z"))
    both = left.join(shuffled(right), ["dst", "z"]).select("src", "dst", "sd").join(shuffled(sets.withColumnRenamed("rep", "src")), "src").select("src", "dst", "s", "sd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["src", "dst"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "src long, dst long").distinct()


def _joined(least: float):
    def run(group: pa.Table) -> pa.Table:
        """Links between table rows and probe rows that join two groups, of all that are alike."""
        reps, probe = group["rep"].to_numpy(), group["probe"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group["s"]]
        label = np.unique(group["label"].to_numpy(), return_inverse=True)[1]
        table, src, dst = np.flatnonzero(~probe), [], []
        for i in np.flatnonzero(probe):
            for j in table:
                if label[i] != label[j] and _alike(sets[i], sets[j], least):
                    label[label == label[j]] = label[i]
                    src.append(reps[i])
                    dst.append(reps[j])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _labelled(reps: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, label): the smallest rep that links reach."""
    parts = connected_components(links)
    return reps.join(shuffled(parts), reps["rep"] == parts["node"], "left").select("rep", F.coalesce("component", "rep").alias("label"))


def similar_links(reps: DataFrame, sets_of, plan: Bands, crowded: int = 64, block: int = 256) -> DataFrame:
    """(src, dst) that connect all of ``reps`` (rep, keys) that are alike and share a band.

    First each meets three members of its bands; then only members of a band that this left in
    different groups are compared. Bands with more than ``crowded`` of those are dealt out as
    blocks; no pair is capped or dropped. ``sets_of`` gives (rep, s) of the reps asked for.
    """
    rows = reps.select("rep", F.explode("keys").alias("key"))
    odd = F.xxhash64("rep")
    ends = rows.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.min_by("rep", odd).alias("c"), F.count("*").alias("n")).where("a < b")
    shared = materialize(rows.join(shuffled(ends), "key"))
    if shared.isEmpty():
        return shared.select(F.col("rep").alias("src"), F.col("a").alias("dst"))
    members = materialize(shared.select("rep").distinct())
    sets = materialize(sets_of(members))
    stars = materialize(shared.select(F.col("rep").alias("src"), F.explode(F.array("a", "b", "c")).alias("dst")).where("src <> dst").distinct())
    first = materialize(_verified(stars, sets, plan.least))
    named = shared.select("key", "rep").join(shuffled(_labelled(members, first)), "rep")
    mixed = named.groupBy("key").agg(F.min("label").alias("la"), F.max("label").alias("lb"), F.count("*").alias("n")).where("la < lb").select("key", "n")
    left = materialize(named.join(shuffled(mixed), "key"))
    calm = left.where(F.col("n") <= crowded)
    other = calm.select("key", F.col("rep").alias("dst"), F.col("label").alias("label2"))
    pairs = calm.join(shuffled(other), "key").where("dst < rep AND label <> label2").select(F.col("rep").alias("src"), "dst").distinct()
    out = first.unionByName(_verified(materialize(pairs.join(shuffled(stars), ["src", "dst"], "left_anti")), sets, plan.least))
    full = left.where(F.col("n") > crowded)
    if full.isEmpty():
        return out
    # all pairs of two groups have a member that is not of the band's largest group
    size = full.groupBy("key", "label").count()
    top = materialize(size.groupBy("key").agg(F.max_by("label", "count").alias("top"), F.ceil(F.sum("count") / block).cast("int").alias("nt"), F.ceil((F.sum("count") - F.max("count")) / block).cast("int").alias("np")))
    full = full.join(F.broadcast(top) if fits(top, 100_000) else shuffled(top), "key")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    table = full.select("key", "rep", "label", F.lit(False).alias("probe"), dealt("nt").alias("tb"), span("np").alias("pb"))
    probes = full.where("label <> top").select("key", "rep", "label", F.lit(True).alias("probe"), dealt("np").alias("pb"), span("nt").alias("tb"))
    both = table.unionByName(probes).join(shuffled(sets), "rep")
    return out.unionByName(both.groupBy("key", "tb", "pb").applyInArrow(_joined(plan.least), "src long, dst long"))


def similar_classes(docs: DataFrame, plan: Bands = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) for each row of ``docs``; ids, nulls and texts without words as in ``classes``."""
    fp = materialize(_signed(docs, plan, id_col, text_col))
    reps = materialize(fp.groupBy("s0", "s1").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")))
    rows = docs.where(F.col(id_col).isNotNull())

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _shingled(rows.join(wanted, F.col(id_col).cast("long") == F.col("rep"), "left_semi"), plan.shingle, id_col, text_col).distinct()

    known = reps.where("rep IS NOT NULL")
    parts = connected_components(similar_links(known.select("rep", "keys"), sets_of, plan))
    named = reps.join(shuffled(parts), reps["rep"] == parts["node"], "left").select("s0", "s1", F.coalesce("component", "rep").alias("component_id"))
    return fp.select("id", "s0", "s1").join(shuffled(materialize(named)), ["s0", "s1"]).select("id", "component_id")


def deduplicate(docs: DataFrame, plan: Plan | Bands = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id. Rows with a null id stay."""
    found = (similar_classes if isinstance(plan, Bands) else classes)(docs, plan, id_col, text_col)
    keep = materialize(found.where("id = component_id").select(F.col("id").alias("__keep")).distinct())
    named = docs.where(F.col(id_col).isNotNull())
    return named.join(keep, F.col(id_col).cast("long") == F.col("__keep"), "left_semi").dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
