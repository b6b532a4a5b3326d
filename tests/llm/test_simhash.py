"""SimHash: fingerprints, links and classes against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from lumisig.llm import simhash
from lumisig.llm.components import connected_components


def plain_fingerprint(text, k=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus():
    r = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    out = []
    for i in range(60):
        base = [r.choice(words) for _ in range(r.randint(1, 200))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            near = list(base)
            near[r.randrange(len(near))] = r.choice(words)
            out.append(r.choice([" ", "\n", "\t\x0b"]).join(near).replace("w1", "W1"))
    return out + ["", None, "   \n", "one", "ONE", "one two", "é é é", "Ä x y"] + ["copy of a text here"] * 5


def test_classes_equal_brute_force(spark):
    rows = [(10 * i + 7, t) for i, t in enumerate(corpus())]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, w0 string, component_id long")  # clashing names
    got = {r.id: r for r in simhash.classes(d).withColumn("hex", simhash.hex_digits("v0")).collect()}
    fp = {i: plain_fingerprint(t or "") for i, t in rows}
    assert {i: int(r.hex, 16) for i, r in got.items()} == fp
    edges = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == smallest(fp, edges)
    assert any(fp[a] != fp[b] for a, b in edges)


@pytest.mark.parametrize("crowded", [64, 1])
def test_links_lose_none(spark, crowded):
    r = np.random.default_rng(0)
    rows = []
    for i in range(80):
        base = int(r.integers(0, 2**63))
        for k in range(5):
            flips = sum(1 << int(p) for p in r.choice(64, k, replace=False))
            rows.append((len(rows), base ^ flips))
    signed = [(i, x - 2**64 if x >= 2**63 else x) for i, x in rows]
    df = spark.createDataFrame([(i, x, x) for i, x in signed], "rep long, w0 long, v0 long")
    want = {(b[0], a[0]) for a, b in itertools.combinations(rows, 2) if (a[1] ^ b[1]).bit_count() <= 3}
    got = {tuple(x) for x in simhash.links(df, simhash.STRICT, crowded=crowded, block=3).collect()}
    nodes = [i for i, _ in rows]
    assert smallest(nodes, got) == smallest(nodes, want)
    if crowded == 64:
        assert got == want


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4100)] + [(1, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()))
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: c for n, c in smallest(nodes | {1}, edges).items() if n in nodes}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_empty_null_and_repeated(spark):
    schema = "doc_id long, text string, extra string"
    assert simhash.classes(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "x"), (None, None, None), (4, None, None), (5, "", None)]
    got = sorted((r.id is None, r.id or 0, r.v0, r.component_id) for r in simhash.classes(spark.createDataFrame(rows, schema)).collect())
    assert [g[3] for g in got] == [1, 1, 4, 4, 1, 4] if got[4][2] else [1, 1, 4, 4, 4, 1]
    kept = simhash.deduplicate(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 4] and all(r.asDict().keys() == {"doc_id", "text", "extra"} for r in kept)


def jaccard(a, b, k=5):
    s, t = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(s & t) / len(s | t)


def test_similar_texts_are_found_and_others_stay(spark):
    r = random.Random(11)
    words = ["word%d" % i for i in range(3000)]
    rows, copies = [], 0
    for i in range(120):
        base = [r.choice(words) for _ in range(r.randint(150, 400))]
        rows.append((len(rows), " ".join(base)))
        for n in (1, 3):
            near = list(base)
            for _ in range(n):
                near[r.randrange(len(near))] = r.choice(words)
            if jaccard(" ".join(base), " ".join(near)) >= 0.85:
                copies += 1
                rows.append((len(rows), " ".join(near)))
    rows += [(10_000 + i, " ".join(r.choice(words) for _ in range(30))) for i in range(60)]
    kept = {x.doc_id for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(10_000 + i in kept for i in range(60))
    assert copies > 180 and 120 + 60 <= len(kept) <= 180 + 0.06 * copies


def test_long_texts_are_cut_nowhere():
    r = random.Random(2)
    words = [b"w%d" % r.randrange(50) for _ in range(simhash.CHUNK + 500)]
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    bits = [(2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) << b for b in range(64)]
    assert simhash.fingerprint(words, simhash.Code(3, 1)) == [sum(bits)]


def test_contiguous_edits_are_found(spark):
    r = random.Random(21)
    some = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], []
    for i in range(360):
        n = r.randint(200, 400)
        base, at = some(n), r.randrange(n // 4, n // 2)
        part = int(n * r.uniform(0.17, 0.24))
        near = [base + some(part), base[:at] + base[at + part :], base[:at] + some(part // 2) + base[at + part // 2 :]][i % 3]
        if 0.8 <= jaccard(" ".join(base), " ".join(near)) <= 0.85:
            pairs.append(2 * i + 1)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    kept = {x.doc_id for x in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 100 and sum(i in kept for i in pairs) <= 0.01 * len(pairs)
    assert all(2 * i in kept for i in range(360))
    assert all(i in kept for i in range(1, 720, 2) if jaccard(rows[i][1], rows[i - 1][1]) < 0.8)


def test_crowded_bands_lose_none(spark):
    r = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base[:at] + [f"x{r.randrange(10**6)}" for _ in range(k)] + base[at + k :]) for at, k in ((r.randrange(100), r.randint(1, 20)) for _ in range(150))]
    plan = simhash.SIMILAR
    factors = simhash._derived(np.arange(1, 65, dtype=np.uint64), 1) | np.uint64(1)
    keys = [simhash._band_keys(simhash.shingle_set(t.encode().split(), 5), plan, factors) for t in texts]
    ids = range(len(texts))
    near = [(b, a) for a, b in itertools.combinations(ids, 2) if set(keys[a]) & set(keys[b]) and jaccard(texts[a], texts[b]) >= 0.8]
    reps = spark.createDataFrame(list(zip(ids, keys)), "rep long, keys array<long>")
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for crowded, block in ((10**6, 9), (2, 9)):
        got = {tuple(x) for x in simhash.similar_links(reps, lambda wanted: simhash._shingled(docs, 5, "doc_id", "text"), plan, crowded, block).collect()}
        assert smallest(ids, got) == smallest(ids, near)
        assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in got)


def test_exploded_tables_are_not_broadcast_by_their_size_before(spark):
    rows = [(i, x, x) for i, x in enumerate(np.random.default_rng(12).integers(-(2**63), 2**63, 2000).tolist())]
    reps = simhash.materialize(spark.createDataFrame(rows, "rep long, w0 long, v0 long"))
    assert "BroadcastHashJoin" not in simhash.links(reps, simhash.STRICT)._jdf.queryExecution().executedPlan().toString()
