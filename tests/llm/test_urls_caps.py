"""URL rules and trees, and the cosine join."""

import itertools
import random

import numpy as np
import pytest

from lumisig.llm import caps, urls
from lumisig.llm.queries import URL_RULES


@pytest.mark.parametrize("url,parts", [("HTTP://Ex.COM/A/b?c#d", ("ex.com", "/A/b")), ("http://a?x/y", ("a", "")), ("http://a#b://c/", ("a", "")), ("mailto:x", ("", "")), (None, ("", "")), ("", ("", "")), ("://", ("", "")), ("x://É.Com/é", ("É.com", "/é"))])
def test_split(url, parts):
    assert urls.split_url(url) == parts


def test_rules():
    find = lambda u: URL_RULES.find(*urls.split_url(u))
    assert find("http://a.com/x") == ("com/", "allow") and find("http://com/") == ("com/", "allow") and find("http://acom/") is None
    assert find("http://blog.example.com/en/1") == ("example.com/en/", "block") and find("http://www.example.com/en/1") == ("www.example.com/en/", "allow")
    assert find("http://a.www.example.com/en/") == ("www.example.com/en/", "allow") and find("http://example.com/en") == ("com/", "allow")
    assert find("http://x.net/es/1") == ("net/es/", "block") and find("http://x.net/de/") is None and find("http://x.com") is None


def test_held_out_accuracy():
    rows = urls.example_urls(4000, seed=1)
    x, y = [u for u, _ in rows], np.array([b for _, b in rows], float)
    s = urls.suffix_statistics(x[:3000], y[:3000])
    feats = np.array([urls.lexical(u, s) for u in x])
    model = urls.UrlModel(urls.Trees.fit(feats[:3000], y[:3000]), s)
    assert ((model.blocked(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_accuracy_on_names_that_were_not_seen():
    train = urls.example_urls(6000, 2, urls.ORDINARY[::2], urls.LURES[::2])
    held = urls.example_urls(3000, 3, urls.ORDINARY[1::2], urls.LURES[1::2])
    model = urls.UrlModel.fit([u for u, _ in train], np.array([b for _, b in train], float))
    assert ((model.blocked([u for u, _ in held]) >= 0.5) == [b for _, b in held]).mean() > 0.8


def test_rules_equal_a_plain_loop():
    r = random.Random(8)
    label = lambda: r.choice(["a", "b", "www", "example", "net", "com", "x-y"])
    host = lambda: ".".join(label() for _ in range(r.randint(1, 4)))
    path = lambda: "".join(r.choice(["/", "/en/", "/e", "n", "/es/x"]) for _ in range(r.randint(0, 3)))
    for _ in range(300):
        rules = tuple((r.choice(["allow", "block"]), x) for x in {host() + "/" + path()[1:] for _ in range(r.randint(1, 6))})
        table = urls.Rules(rules)
        for _ in range(20):
            h, p = host(), path()
            best = None
            for verdict, rule in rules:
                rule_host, _, rule_path = rule.partition("/")
                if (h == rule_host or h.endswith("." + rule_host)) and p.startswith("/" + rule_path) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            found = table.find(h, p)
            assert (found is None) == (best is None)
            assert best is None or (len(found[0]) == len(best[0]) and found in [(rule, v) for v, rule in rules])


def test_trees_equal_plain_walks():
    r = np.random.default_rng(5)
    x, y = r.standard_normal((400, 4)), r.integers(0, 2, 400).astype(float)
    t = urls.Trees.fit(x, y, rounds=7)
    plain = []
    for row in x:
        score = t.start
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > cut[at] else 1)
            score += leaf[at - len(f)]
        plain.append(1 / (1 + np.exp(-score)))
    assert np.allclose(t.predict(x), plain)


def test_trees_learn_interactions():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    t = urls.Trees.fit(x[:1500], y[:1500])
    assert ((t.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9
    assert len(t.predict(np.zeros((0, 3)))) == 0


def test_judge(spark):
    model = urls.train(urls.example_table(spark, 2000), max_rows=1500)
    rows = [(1, "http://www.cheap-pills.example.net/en/5"), (2, "http://thernd.example.net/en/5"), (3, None), (4, ""), (5, "http://a.net/fr/1"), (5, "http://a.net/fr/1"), (None, "http://a.com/"), (6, "http://" + "a" * 100_000 + ".org/")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    got = urls.judge(d, URL_RULES, model).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 8 and by[1].verdict == "block" and by[2].verdict == "allow" and by[5].rule == "net/fr/" and by[5].blocked is None and by[None].verdict == "allow"
    assert by[3].host == "" and by[3].rule is None and all(r.verdict in ("allow", "block") for r in got)
    assert urls.judge(d.where("false"), URL_RULES, model).count() == 0
    with pytest.raises(ValueError):
        urls.train(urls.example_table(spark, 10).where("false"))


def brute(rows, least=0.93):
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = [(a[0], b[0]) for a, b in itertools.combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= least]
    up = {r[0]: r[0] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    n = dict.fromkeys(up, 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i in up}, len(links)


def vectors(dim=64, groups=40, seed=0):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = r.standard_normal(dim)
        for k in range(int(r.integers(1, 5)) if g else 25):
            v = base + r.standard_normal(dim) * np.linalg.norm(base) / dim**0.5 * (r.uniform(0.05, 0.3) if k else 0)
            out.append((v.astype(np.float32).tolist(), int(g % 3)))
        if g % 5 == 0:
            out += [out[-1]] * 3
    odd = [(None, 1), ([0.0] * dim, 1), ([float("nan")] * dim, 1), ([float("inf")] * dim, 1), ([None] * dim, 1), ([], 1), (out[0][0], None), (out[0][0][:8], 0), (out[0][0][:8], 0)]
    out += odd
    order = r.permutation(len(out))
    return [(int(i) * 3 + 2, *out[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("crowded,block", [(64, 1024), (2, 4)])
def test_join_equals_brute_force(spark, crowded, block):
    rows = vectors()
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, vid string, n int")
    want, n = brute(rows)
    got = {r.id: (r.n_links, r.component_id) for r in caps.join(d, crowded=crowded, block=block).collect()}
    assert got == want and n > 300


def test_recall_at_the_threshold():
    r = np.random.default_rng(1)
    n, dim = 1500, 64
    x = r.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((n, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * z

    def sets(v):
        found = [set() for _ in range(n)]
        for i, f in zip(*caps.decode(v, caps.Caps()), strict=True):
            found[i].add(f)
        return found

    a, b = sets(x), sets(y)
    assert np.mean([bool(p & q) for p, q in zip(a, b, strict=True)]) > 0.99
    assert np.mean([bool(a[i] & a[i - 1]) for i in range(n)]) < 0.01


@pytest.mark.parametrize("dim", [2, 3, 8, 32, 64, 384])
def test_recall_and_filters_by_dimension(dim):
    r = np.random.default_rng(dim)
    n, least = 1500, 0.93
    x = r.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((n, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    y = least * x + (1 - least**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    found = []
    for v in (x, y):
        row, code = caps.decode(v, caps.Caps(), least)
        found.append([set() for _ in range(n)])
        for i, f in zip(row, code, strict=True):
            found[-1][i].add(f)
    assert np.mean([bool(a & b) for a, b in zip(*found, strict=True)]) >= 0.99
    assert np.mean([len(a) for a in found[0]]) < 75 and max(map(len, found[0])) < 400


def test_magnitudes_null_ids_and_repeated_ids(spark):
    near, far = [1.0, 0.0], [0.9, 0.6]  # cosine 0.83
    like = [1.0, 0.01]
    times = lambda v, m: [x * m for x in v]
    rows = [(1, times(near, 1e200), 1), (2, times(far, 1e200), 1), (3, times(near, 1e-200), 2), (4, times([0.8, 0.6], 1e-200), 2)]
    rows += [(5, times(near, 1e300), 3), (6, times(like, 5e-320), 3), (None, like, 4), (7, near, 4), (None, [0.0, 1.0], 4)]
    rows += [(9, near, 5), (9, [0.0, 1.0], 5), (8, like, 5), (10, [0.01, 1.0], 5)]
    rows += [(None, near, 6), (None, like, 6)]
    got = sorted(((r.id is None, r.id or 0, r.n_links, r.component_id or 0) for r in caps.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 1, 7), (8, 1, 8), (9, 1, 8), (9, 1, 9), (10, 1, 9)]
    assert got == sorted([(False, *w) for w in want] + [(True, 0, 1, 7), (True, 0, 0, 0), (True, 0, 1, 0), (True, 0, 1, 0)])


@pytest.mark.parametrize("dim", [2, 8, 32])
def test_join_equals_brute_force_in_few_dimensions(spark, dim):
    r = np.random.default_rng(dim)
    rows = [(i, r.standard_normal(dim).tolist(), int(r.integers(0, 2))) for i in range(250)]
    rows += [(250 + i, (np.array(rows[i][1]) + r.standard_normal(dim) * 0.2).tolist(), rows[i][2]) for i in range(100)]
    want, n = brute(rows)
    got = {x.id: (x.n_links, x.component_id) for x in caps.join(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == want and n > 20


def test_join_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert caps.join(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [-1.0, 0.0], 1)]
    got = sorted((r.id or 0, r.n_links, r.component_id) for r in caps.join(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3)]
