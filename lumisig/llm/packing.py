"""Lexical retrieval packing: fill each training window with documents that resemble its seed.

Document frequencies are counted over the whole corpus. Pieces are dealt to tasks by the
terms that tell most of them, so that like pieces meet, or stay as they are read. Each shard
gets a BM25 inverted index over token ids; an unused piece seeds a window, the index is asked
for all its terms and returns its unused neighbours, best first, and they fill the window, the
last one cut to fit. What is left of a shard is carried to the next shard of the same task, and
memory is bounded by the shard.
"""

from __future__ import annotations

import functools
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 2048
END = 1
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: ASCII marks, which none of the tokenizer's patterns joins to a letter or digit before them.
_TAIL = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
#: Which bytes are ASCII letters or digits.
_ALNUM = np.array([bytes([b]).isalnum() for b in range(256)])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``first[i]`` to ``first[i] + n[i] - 1`` of each i in turn."""
    after = np.cumsum(n)
    return np.arange(after[-1] if len(after) else 0) + np.repeat(first - (after - n), n)


def _sizes(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _parted(words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Words without closing marks, the marks of those that were cut, and which those are.

    Marks are cut only after a letter or digit of ASCII or Latin-1, where they are a piece of their own.
    """
    core = pc.ascii_rtrim(words, characters=_TAIL)
    size, left = _sizes(words), _sizes(core)
    data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
    first = np.cumsum(size) - size + np.frombuffer(words.buffers()[1], np.int32)[words.offset] if len(words) else size
    last, before = (data[np.maximum(first + left - k, 0)] for k in (1, 2))
    cut = (left < size) & (left > 0) & (_ALNUM[last] | ((left > 1) & (before == 0xC3) & (last != 0x97) & (last != 0xB7)))
    n = (size - left)[cut]
    marks = data[_ranges((first + left)[cut], n)]
    tails = pa.StringArray.from_buffers(len(n), pa.py_buffer(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.py_buffer(marks))
    return pc.if_else(pa.array(cut), core, words), tails, cut


class WordEncoder:
    """Ids by a tokenizer that drops white space, so that words can be encoded one by one and kept.

    Texts that may hold a special token are encoded whole. Gives little-endian unsigned
    32-bit ids. At most ``most`` words and those of a block are kept.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # pieces that end a word
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # places of known words in ``first`` and ``size``, which say where their ids are
        self.known: dict[bytes, int] = {}
        self.first, self.size, self.ids, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, bool)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[bytes], step: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and sizes of words of letters only, which are one piece each: many at once."""
        for i in range(0, len(words), step):
            part = words[i : i + step]
            ids = self._encode([b" ".join(part).decode()])[0]
            size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
            if len(size) != len(part):
                each = self._encode([w.decode() for w in part])
                ids, size = np.concatenate(each), np.array(list(map(len, each)))
            yield ids, size

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Keep the ids of new words; returns the words' places."""
        letters = np.fromiter((w.isalpha() or w.decode().isalpha() for w in words), bool, len(words))
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        n, words = np.count_nonzero(letters), [words[i] for i in order.tolist()]
        plain, other = words[:n], words[n:]
        got = list(self._encode_plain(plain))
        each = self._encode([w.decode() for w in other])
        size = np.concatenate([*(n for _, n in got), np.fromiter(map(len, each), np.int64, len(each))])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *(x for x, _ in got), *each])
        self.met = np.concatenate([self.met, np.zeros(len(words), bool)])
        places = np.empty(len(words), np.int64)
        places[order] = np.arange(len(self.known), len(self.first))
        self.known.update(zip(words, range(len(self.known), len(self.first)), strict=True))
        return places

    def _forget(self) -> None:
        """Keep the words that were met again since the last time, or none where those are many."""
        keep = np.flatnonzero(self.met)
        keep = keep if 2 * len(keep) <= self.most else keep[:0]
        words = list(self.known)
        self.known = {words[k]: i for i, k in enumerate(keep.tolist())}
        size = self.size[keep]
        self.ids = self.ids[_ranges(self.first[keep], size)]
        self.first, self.size, self.met = np.cumsum(size) - size, size, np.zeros(len(keep), bool)

    def _places(self, words: pa.Array) -> np.ndarray:
        """The places of different words, which are learned where they aren't known."""
        keys = words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()

        def find() -> np.ndarray:
            return np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))

        at = find()
        new = np.flatnonzero(at < 0)
        self.met[at[at >= 0]] = True
        if len(new) and len(self.known) + len(new) > self.most:
            self._forget()
            at = find()
            new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn([keys[i] for i in new.tolist()])
        return at

    def __call__(self, text: bytes) -> bytes:
        return next(self.each(pa.array([text]).cast(pa.string()))).tobytes()

    def each(self, texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[np.ndarray]:
        """Ids of each of the texts (strings; null is empty) in turn, by blocks of some ``most_bytes``.

        A block's words are told apart by Arrow; only its different words pass through Python.
        """
        texts = pc.fill_null(texts, "")
        end = np.cumsum(_sizes(texts))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most_bytes, "right")))
            yield from self._block(texts.slice(at, stop - at))
            at = stop

    def _block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        special = pc.match_substring(texts, "<|")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", texts)))
        words = lists.flatten().dictionary_encode()
        cores, tails, cut = _parted(words.dictionary)
        parts = pa.concat_arrays([cores, tails]).dictionary_encode()
        at = self._places(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)]
        core, tail = at[: len(cores)], at[len(cores) :]
        size = self.size[core]
        more = np.zeros(len(size), np.int64)
        more[cut] = self.size[tail]
        first = np.cumsum(size + more) - (size + more)
        ids = np.empty(int((size + more).sum()), "<u4")
        ids[_ranges(first, size)] = self.ids[_ranges(self.first[core], size)]
        ids[_ranges((first + size)[cut], more[cut])] = self.ids[_ranges(self.first[tail], more[cut])]
        word = words.indices.to_numpy(zero_copy_only=False)
        n = (size + more)[word]
        out = ids[_ranges(first[word], n)]
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
        start = 0
        for i, (stop, whole) in enumerate(zip(ends.tolist(), special.to_numpy(zero_copy_only=False).tolist(), strict=True)):
            yield self._encode([texts[i].as_py()])[0] if whole else out[start:stop]
            start = stop


@functools.lru_cache(maxsize=2)
def encoder(path: str, most: int = 400_000) -> WordEncoder:
    return WordEncoder(path, most)


class Statistics:
    """How many pieces there are, their mean size, and how many hold each term."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean = n, mean
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    @classmethod
    def of(cls, pieces: list[np.ndarray]) -> Statistics:
        df = np.bincount(np.concatenate([np.unique(p) for p in pieces]))
        return cls(len(pieces), sum(map(len, pieces)) / len(pieces), df)


class Index:
    """BM25 over the token ids of one shard's pieces; ``stats`` are the corpus's, or the shard's where not given.

    Terms of over a quarter of the pieces are rows of a matrix, which are added faster than lists of that length.
    """

    def __init__(self, pieces: list[np.ndarray], stats: Statistics | None = None, k1: float = 1.2, b: float = 0.75):
        stats = stats or Statistics.of(pieces)
        n = self.n = len(pieces)
        size = np.array([len(p) for p in pieces])
        key = np.concatenate(pieces).astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(n, dtype=np.uint64), size)
        key.sort()
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        tf = np.diff(np.append(new, len(key)))
        key = key[new]
        doc, term = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.int64)
        score = stats.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[doc] / stats.mean))
        order = np.argsort(doc, kind="stable")
        self.query = np.split(term[order], np.cumsum(np.bincount(doc, minlength=n))[:-1])
        held = np.bincount(term)
        common = np.flatnonzero(4 * held > n)
        self.row = np.full(len(held), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n))
        often = self.row[term] >= 0
        self.dense[self.row[term[often]], doc[often]] = score[often]
        self.doc, self.score = doc[~often], score[~often]
        held[common] = 0
        self.at = np.concatenate(([0], np.cumsum(held)))

    def scores(self, i: int) -> np.ndarray:
        """BM25 of each piece for all terms of piece ``i``."""
        term = self.query[i]
        row = self.row[term]
        total = self.dense[row[row >= 0]].sum(0)
        rare = term[row < 0]
        if len(rare):
            ranges = [slice(a, z) for a, z in zip(self.at[rare].tolist(), self.at[rare + 1].tolist(), strict=True)]
            total += np.bincount(np.concatenate([self.doc[x] for x in ranges]), np.concatenate([self.score[x] for x in ranges]), self.n)
        return total

    def neighbours(self, i: int, free: np.ndarray | None = None, first: int = 32) -> Iterator[int]:
        """Other pieces, of the ``free`` ones, that share a term, best first; equal scores in order of place. The ``first`` are sorted before the rest."""
        score = self.scores(i)
        found = np.flatnonzero(score > 0 if free is None else (score > 0) & free)
        found = found[found != i]
        worst = -score[found]
        if len(found) > first:
            edge = np.partition(worst, first)[first]
            head, tail = np.flatnonzero(worst < edge), np.flatnonzero(worst >= edge)
            yield from found[head[np.argsort(worst[head], kind="stable")]].tolist()
            found, worst = found[tail], worst[tail]
        yield from found[np.argsort(worst, kind="stable")].tolist()


def _pack_shard(pool: list[list], window: int, rest: bool, stats: Statistics | None = None) -> tuple[list[list[tuple]], list[list]]:
    """Sequences of (document, start, ids, document's tokens), and what is left for the next shard.

    pool: [document, start, ids, document's tokens], each shorter than a window.
    """
    if not pool:
        return [], []
    index, free, out, at = Index([p[2] for p in pool], stats), np.ones(len(pool), bool), [], 0
    while True:
        if len(pool) > 256 and 2 * np.count_nonzero(free) < len(pool):  # a smaller index is sooner read
            pool = [p for p, f in zip(pool, free, strict=True) if f]
            if pool:
                index, free, at = Index([p[2] for p in pool], stats), np.ones(len(pool), bool), 0
        room, row = window, []
        while room:
            while at < len(pool) and not free[at]:
                at += 1
            if at == len(pool):
                break
            for j in chain((at,), index.neighbours(at, free)):
                doc, start, ids, total = pool[j]
                cut = min(room, len(ids))
                row.append((doc, start, ids[:cut], total))
                room -= cut
                if cut == len(ids):
                    free[j] = False
                else:
                    pool[j][1:3] = start + cut, ids[cut:]
                if not room:
                    break
        if room and not rest:
            return out, [list(x) for x in row]
        if row:
            out.append(row)
        if room:
            return out, []


def narrow(tokenizer: str, end: int) -> str:
    """The type that ids are stored in between steps: two bytes where all fit, else four."""
    return "<u2" if max(len(encoder(tokenizer).last) - 1, end) < 1 << 16 else "<u4"


def _pieces(docs: DataFrame, tokenizer: str, window: int, end: int, known_words: int = 400_000) -> DataFrame:
    """(doc_id, start, full, ids, doc_tokens, stats) of ``docs`` (id, text).

    A piece's ids are in ``full`` (four bytes each) where it fills a window, in ``ids`` (``narrow``) where not. Each task
    adds a row with ``stats`` alone: its pieces, their tokens, and how many hold each term.
    """
    kind = narrow(tokenizer, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer, known_words), np.array([end], "<u4")
        df, n, size = np.zeros(1 << 16, np.int64), 0, 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "full", "ids", "doc_tokens", "stats"])

        for b in batches:
            rows, terms, held = [], [], 0
            for doc, ids in zip(b.column(0).to_pylist(), encode.each(b.column(1)), strict=True):
                ids = np.append(ids, last)
                n, size, total = n + -(-len(ids) // window), size + len(ids), len(ids)
                for i in range(0, total, window):
                    part = ids[i : i + window]
                    terms.append(np.unique(part))
                    whole = len(part) == window
                    rows.append((doc, i, part.tobytes() if whole else None, None if whole else part.astype(kind).tobytes(), total, None))
                held += total
                if held >= 1 << 20:
                    df = _added(df, terms)
                    yield out(rows)
                    rows, terms, held = [], [], 0
            df = _added(df, terms)
            yield out(rows)
            pa.default_memory_pool().release_unused()
        at = np.flatnonzero(df)
        yield out([(None, None, None, None, None, np.concatenate(([n, size], at, df[at])).astype("<i8").tobytes())])

    return docs.mapInArrow(run, "doc_id long, start long, full binary, ids binary, doc_tokens long, stats binary")


def _added(df: np.ndarray, terms: list[np.ndarray]) -> np.ndarray:
    if not terms:
        return df
    more = np.bincount(np.concatenate(terms), minlength=len(df))
    more[: len(df)] += df
    return more


def _statistics(pieces: DataFrame) -> Statistics:
    """Of all pieces, from the tasks' rows: no more than a row a term is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                x = np.frombuffer(x.as_py(), "<i8")
                k = (len(x) - 2) // 2
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], x[2 : 2 + k]))), pa.array(np.concatenate((x[:2], x[2 + k :])))], names=["term", "n"])

    found = {r["term"]: r["n"] for r in pieces.where("stats IS NOT NULL").select("stats").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, size = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Statistics(n, size / max(n, 1), df)


def _strongest(ids: np.ndarray, stats: Statistics) -> int:
    """The two terms that tell most of a piece, as one number."""
    term, tf = np.unique(ids, return_counts=True)
    weight = stats.idf[term] * tf / (tf + 1.2)
    first = int(weight.argmax())
    a = int(term[first])
    weight[first] = -1.0
    second = int(weight.argmax())
    return a << 32 | (int(term[second]) if second != first else 0)


def _gathered(pieces: DataFrame, stats: Statistics, kind: str, shard_tokens: int) -> DataFrame:
    """``pieces`` (doc_id, start, ids, doc_tokens) in the order of the two terms that tell most of each, dealt over tasks by range.

    A group of copies is dealt on by its ids. The ranges' bounds come from a sample, which costs less than the pass over
    all pieces that Spark's own range partitioning would add; every piece goes to the range that holds it.
    """
    spark = pieces.sparkSession
    tokens = stats.n * stats.mean
    # a few shards a task, so that few sequences are short; more tasks than the session has for shuffles only for large tables
    n = int(max(1, min(tokens // (6 * shard_tokens), int(spark.conf.get("spark.sql.shuffle.partitions"))), tokens // (16 * shard_tokens)))
    least = -(1 << 63)

    def keys(b: pa.RecordBatch) -> list[tuple[int, int, int]]:
        ids = [x.as_py() for x in b.column(2)]
        return [(_strongest(np.frombuffer(x, kind), stats), zlib.crc32(x), least if d is None else d) for x, d in zip(ids, b.column(0).to_pylist(), strict=True)]

    def batch(rows: list[tuple[int, int, int]]) -> list[pa.Array]:
        return [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]

    bounds: list[tuple[int, int, int]] = []
    if n > 1:

        def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays(batch(keys(b)), names=["a", "c", "d"])

        part = pieces.sample(min(1.0, 60.0 * n / max(stats.n, 1)), seed=1).mapInArrow(sampled, "a long, c long, d long")
        seen = sorted(tuple(r) for r in part.collect())  # some 60 rows a task to come
        bounds = [seen[len(seen) * i // n] for i in range(1, n)] if seen else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = keys(b)
            place = pa.array([bisect_right(bounds, r) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, place, *batch(rows)], names=[*b.schema.names, "__p", "__a", "__c", "__d"])

    keyed = pieces.mapInArrow(run, "doc_id long, start long, ids binary, doc_tokens long, __p int, __a long, __c long, __d long")
    return keyed.repartitionById(n, "__p").sortWithinPartitions("__a", "__c", "__d", "start").select(*pieces.columns)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, shard_tokens: int = 1 << 21, id_col: str = "doc_id", text_col: str = "text", gather: bool = True, known_words: int = 400_000) -> DataFrame:
    """Pieces of all documents, dealt to sequences of at most ``window`` tokens (see SCHEMA).

    A document is its ids and then ``end``; null text is empty text, which gives ``end``
    alone. Only the last sequence of a task can be shorter than the window. Repeated rows are
    packed as often as they stand. ``tokenizer`` is the path of a tokenizer file that each
    executor can open. sequence_id holds the task's number above 40 bits, so that a task that
    is run again gives the same ids. Without ``gather`` pieces stay in the tasks and order in which
    they are read, for callers whose order means something. A worker keeps the ids of up to ``known_words`` words, some 220 bytes each.
    """
    pieces = materialize(_pieces(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), tokenizer, window, end, known_words))
    stats, kind = _statistics(pieces), narrow(tokenizer, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        seq = (task.partitionId() if task else 0) << 40
        pool: list[list] = []
        held = 0

        def emit(rows: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            cols: list[list] = [[] for _ in range(7)]
            for row in rows:
                offset = 0
                for doc, start, ids, total in row:
                    for c, x in zip(cols, (doc, start, len(ids), ids.astype("<u4").tobytes(), total, seq, offset), strict=True):
                        c.append(x)
                    offset += len(ids)
                seq += 1
            if cols[0]:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        full: list[list[tuple]] = []
        for b in batches:
            for i, (doc, start, n) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
                ids = b.column(2)[i].as_py()
                if ids is not None:
                    pool.append([doc, start, np.frombuffer(ids, kind), n])
                    held += len(pool[-1][2])
                else:
                    full.append([(doc, start, np.frombuffer(b.column(4)[i].as_py(), "<u4"), n)])
                    held += window
                if held >= shard_tokens:
                    rows, pool = _pack_shard(pool, window, False, stats)
                    yield from emit(full + rows)
                    pa.default_memory_pool().release_unused()
                    full, held = [], sum(len(p[2]) for p in pool)
        rows, _ = _pack_shard(pool, window, True, stats)
        yield from emit(full + rows)

    columns = ["doc_id", "start", "ids", "doc_tokens"]
    if not gather:
        return pieces.where("stats IS NULL").select(*columns, "full").mapInArrow(run, SCHEMA)
    # full windows stay where they are; their sequences have bit 39 set
    place = F.spark_partition_id().cast("long") * F.lit(1 << 40) + F.lit(1 << 39) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    zero = F.lit(0).cast("long")
    full = pieces.where("full IS NOT NULL").select("doc_id", "start", F.lit(window).cast("long").alias("length"), F.col("full").alias("ids"), "doc_tokens", place.alias("sequence_id"), zero.alias("offset"))
    return full.unionByName(_gathered(pieces.where("ids IS NOT NULL").select(*columns), stats, kind, shard_tokens).mapInArrow(run, SCHEMA))
