"""Packing: tokens are those of the tokenizer, whole and once; windows are full; neighbours resemble their seeds."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lumisig.llm import packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = ["", None, "Hello, World!", "it's. don't?! l'été, naïve… Straße; ÉCOLE... İstanbul, ΣΑΣ", "a<|endoftext|>b <|STARTOFTEXT|>", "é café, 3.14, x2,y ×, ÷. ﬁne",
         "tab\tnew\nline\x0b\x0c\r nbsp x y 中文字, 日本語。 한국어! \U0001f600, ok", "word" * 3000, "?!.,;: .,. ...", "'s 't 'S", "of%%% a'' b.' c's' d_e_ f-- (g) [h]. i~' é! 1' 's, x'll' ߀' ²' ٣."]


def test_word_encoder_equals_the_tokenizer():
    t, enc = tokenizer(), packing.WordEncoder(PATH, most=30)
    r = random.Random(0)
    alphabet = "abcéèñß.,'!0 9-x́Kİ \n"
    for text in TEXTS + ["".join(r.choice(alphabet) for _ in range(200)) for _ in range(60)]:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(enc((text or "").encode()), "<u4").tolist() == want, text


def check(rows, docs, window=packing.WINDOW):
    t, by_doc, by_seq = tokenizer(), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in docs:
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            got = np.frombuffer(p.ids, "<u4").tolist()
            assert p.start == at and got == ids[at : at + p.length] and p.doc_tokens == len(ids)
            at += p.length
        assert at == len(ids)
    short = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += at < window
    return by_seq, short


def test_pack(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    docs = [(i, " ".join(r.choice(words) for _ in range(int(r.expovariate(1 / 300))))) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for shard in (1 << 21, 20_000):
        by_seq, short = check(packing.pack(d, PATH, shard_tokens=shard).collect(), docs)
        assert short <= 3
    first = packing.pack(d, PATH).selectExpr("doc_id", "start", "crc32(ids) AS c").first()
    assert first.c == zlib.crc32(packing.pack(d, PATH).where(f"doc_id = {first.doc_id} AND start = {first.start}").first().ids)


def test_neighbours_resemble(spark):
    r = random.Random(5)
    topics = [["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(300)] for _ in range(4)]
    docs = [(i, " ".join(r.choice(topics[i % 4]) for _ in range(100))) for i in range(200)]
    r.shuffle(docs)
    by_seq, _ = check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), PATH).collect(), docs)
    same = [max(sum(p.doc_id % 4 == k for p in ps) for k in range(4)) / len(ps) for ps in by_seq.values()]
    assert np.mean(same) > 0.85


def test_edges(spark):
    schema = "doc_id long, text string, ids string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a", "x"), (1, "b", "x"), (1, "b", "x")], schema), PATH).collect()
    assert sum(r.length for r in rows) == 6 and sum(r.doc_id is None for r in rows) == 1


def test_index_finds_the_best():
    r = np.random.default_rng(0)
    pieces = [r.integers(0, 200, 50).astype("<u4") for _ in range(80)]
    pieces[7] = np.concatenate([pieces[3][:40], pieces[7][:10]])
    assert next(packing.Index(pieces).neighbours(3)) == 7 and next(packing.Index(pieces).neighbours(7)) == 3


def test_neighbours_equal_plain_bm25():
    r = np.random.default_rng(3)
    pieces = [np.concatenate([r.integers(0, 12, 20), r.integers(12, 4000, r.integers(1, 60))]).astype("<u2") for _ in range(150)]
    pieces += [pieces[0], pieces[0], np.array([4001], "<u2")]
    n, mean = len(pieces), sum(map(len, pieces)) / len(pieces)
    idf = {t: np.log1p((n - k + 0.5) / (k + 0.5)) for t, k in Counter(t for p in pieces for t in set(p.tolist())).items()}
    index = packing.Index(pieces)
    for i in (0, 5, 150, 152):
        score = []
        for j, p in enumerate(pieces):
            tf = Counter(p.tolist())
            score.append(sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(p) / mean)) for t in set(pieces[i].tolist()) if t in tf))
        assert np.allclose(index.scores(i), score)
        got = list(index.neighbours(i))
        assert sorted(got) == [j for j in range(n) if j != i and score[j] > 0] and got == list(index.neighbours(i, first=n))
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:]))
    assert list(index.neighbours(0))[:2] == [150, 151]  # equal scores in order of place


def test_all_terms_of_all_copies_count():
    r = np.random.default_rng(4)
    copy, rest = r.integers(0, 300, 60).astype("<u4"), [r.integers(1000, 40_000, 60).astype("<u4") for _ in range(60)]
    pieces = [copy if i % 2 else rest[i // 2] for i in range(120)]  # half of the shard
    assert set(packing.Index(pieces).neighbours(1)) == set(range(3, 120, 2))
    # a neighbour that shares only the weakest of many terms
    strong, other = np.arange(100, 140).astype("<u4"), np.arange(300, 340).astype("<u4")
    pieces = [np.concatenate([np.repeat(strong, 5), [9]]).astype("<u4"), np.concatenate([other, [9]]).astype("<u4"), np.repeat(strong, 5), *([other] * 3)]
    assert 1 in packing.Index(pieces).neighbours(0)


def test_like_documents_meet_wherever_they_stand(spark):
    r = random.Random(9)
    topics = [["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(150)] for _ in range(40)]
    docs = [(i, " ".join(topics[i % 40])) for i in range(400)]  # ten copies of a text, far from each other
    d = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(8, "doc_id")
    found = packing.pack(d, PATH, shard_tokens=16_384).collect()
    by_seq, _ = check(found, docs)
    same = [max(sum(p.length for p in ps if p.doc_id % 40 == k) for k in range(40)) / sum(p.length for p in ps) for ps in by_seq.values()]
    assert np.mean(same) > 0.6
    stay = packing.pack(d, PATH, shard_tokens=16_384, gather=False).collect()
    check(stay, docs)


def test_frequencies_are_of_the_whole_corpus(spark):
    docs = [(i, f"common word{i % 7}") for i in range(70)]
    pieces = packing._pieces(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), PATH, 2048, 1)
    got, want = packing._statistics(pieces), packing.Statistics.of([np.frombuffer(r.ids, "<u2") for r in pieces.where("ids IS NOT NULL").collect()])
    assert got.n == want.n == 70 and got.mean == want.mean and np.array_equal(got.idf, want.idf)
