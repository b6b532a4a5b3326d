"""Rules with host verdicts, and source mixing."""

import random
import re
from collections import Counter
from fractions import Fraction
from itertools import islice

import pytest

from lumisig.llm import mixing, quality


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts():
    r = random.Random(4)
    v = ["a", "bé", "c#", "d|d", "€*", "f"]
    out = [" ".join(r.choice(v) for _ in range(r.randint(0, 60))) for _ in range(60)]
    phrase = " ".join("w%d" % i for i in range(9))
    out += [f"{phrase} x {phrase}", f"{phrase} {phrase} {phrase}\n{phrase}", "z " * 50, "a\n\na\n a\na", "   x", "", None, "a b c d e f g h", "a b c d e f g h a b c d e f g h"]
    return out + ["x" * 50_000 + " y" * 3000]


def test_counts_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain_counts(t) for i, t in rows}


def test_judgement(spark):
    good = " ".join("word%d" % i for i in range(40))
    rows = [(i, good + f" {i}", "good.example", 1) for i in range(200)]
    rows += [(1000 + i, "short", "rotten.example", 1) for i in range(90)] + [(2000 + i, good + f" {i}", "rotten.example", 1) for i in range(10)]
    rows += [(3000, " ".join(f"w{i}%%%" for i in range(40)), "good.example", 1), (3001, "a a a a " * 10 + good, None, 1), (3003, good + "\nx\nx", "good.example", 1), (3002, None, None, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long")
    got = {r.id: r for r in quality.judge(d).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].kept for i in range(90))
    assert not any(got[2000 + i].kept for i in range(10)) and not got[2000].base_failed  # the host goes as a whole
    assert got[3003].kept and not got[3001].kept and not got[3000].kept and not got[3000].base_failed and got[3002].base_failed
    assert quality.judge(d.where("false")).count() == 0
    assert quality.judge(d.drop("source")).where("kept").count() >= 200
    again = quality.judge(d.unionAll(d.where("doc_id = 3002")))
    assert again.count() == len(rows) + 1


def test_host_verdicts_move_the_limits(spark):
    # n symbols among some 590 characters: 25 break half the limit, 48 the limit, 80 one and a half times
    some = lambda n, i: " ".join([f"# word{j}" if j < n else f"word{j}" for j in range(100)] + [f"x{i}"])
    rows = [(h * 1000 + i, some(80 if i < 20 else 0, i), f"h{h}") for h in range(10) for i in range(400)]  # 5 % break the symbol rule
    rows += [(100_000 + i, some(80 if i < 100 else 25 if i < 150 else 0, i), "bad") for i in range(400)]  # a quarter do
    rows += [(200_000 + i, some(48 if i < 3 else 0, i), "good") for i in range(1000)]  # 0.3 % do, barely
    rows += [(300_000, some(25, 0), "h1"), (300_001, some(48, 0), "h1")]
    got = {r.id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[100_000 + i].kept for i in range(150)) and all(got[100_000 + i].kept for i in range(150, 400))
    assert [got[100_000].by_host, got[100_120].by_host] == [False, True]  # the second breaks half the limit only
    assert all(got[200_000 + i].kept for i in range(1000)) and got[200_000].by_host and not got[200_100].by_host
    assert got[300_000].kept and not got[300_001].kept  # an ordinary host


def test_shrinkage(spark):
    # one bad document of one does not make a host rotten where others are clean
    good = " ".join("word%d" % i for i in range(40))
    rows = [(h * 100 + i, good, f"h{h}") for h in range(10) for i in range(20)] + [(5000, "short", "single")]
    got = {r.id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[5000].host_rate < 0.6 and got[5000].base_failed and sum(r.kept for r in got.values()) == 200


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, r.choice("aaab") if i % 50 else None, f"t{i}", 5) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_slot_old int")
    weights = {"a": 1.0, "b": 2.0, "": 1.0}
    got = mixing.mix(d, weights, block_docs=4, rows_per_bucket=100).collect()
    assert sorted(x.doc_id for x in got) == list(range(3000)) and len({(x.mix_slot, x.mix_place) for x in got}) == 3000
    one = mixing.mix(d, weights, block_docs=4, rows_per_bucket=10**6).collect()
    assert {x.doc_id: (x.mix_slot, x.mix_place) for x in got} == {x.doc_id: (x.mix_slot, x.mix_place) for x in one}
    got.sort(key=lambda x: (x.mix_slot, x.mix_place))
    order = []
    for x in got:
        if not order or order[-1] != (x.mix_slot, x.source):
            order.append((x.mix_slot, x.source))
    n, least = Counter(), min(Counter(s for _, s in order).values())
    shares = {"a": 10, "b": 20, None: 10}
    for i, (_, s) in enumerate(order, 1):
        n[s] += 1
        if max(n.values()) > least:
            break
        assert all(abs(n[x] - i * shares[x] / 40) < 1 for x in shares)


def test_mix_edges(spark):
    d = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, source string")
    assert mixing.mix(d, {"a": 1.0}, default=1.0).count() == 4
    assert mixing.mix(d.where("false"), {"a": 1.0}).count() == 0
    many = spark.range(300).selectExpr("id AS doc_id", "concat('s', id % 150) AS source", "1 AS mix_slot")
    got = mixing.mix(many, {}, default=1.0)
    assert got.columns == ["doc_id", "source", "mix_block", "mix_slot", "mix_place"] and got.select("mix_slot", "mix_place").distinct().count() == 300
    with pytest.raises(ValueError, match="no weight"):
        mixing.mix(d, {"a": 1.0})
    with pytest.raises(ValueError):
        mixing.exact_shares({"a": 0.0})


@pytest.mark.parametrize("weights", [{"a": 0.5, **{f"s{i}": 0.01 for i in range(50)}}, {"a": 0.9, **{f"s{i}": 0.001 for i in range(100)}}, {f"s{i}": 1 + i % 4 for i in range(20)}, {f"s{i}": 1.0 for i in range(300)}, {"a": 0.1, "b": 1 / 3}])
def test_exact_schedule_follows_the_weights(weights):
    total, done = sum(map(Fraction, map(str, weights.values()))), dict.fromkeys(weights, 0)
    want = {s: Fraction(str(w)) / total for s, w in weights.items()}
    for s, b, t, release, due in islice(mixing.exact_schedule(mixing.exact_shares(weights)), 2500):
        assert release <= t < due and b == done[s] and release == b // want[s] and due == -(-(b + 1) // want[s])
        done[s] += 1
        assert abs(done[s] - (t + 1) * want[s]) < 1
    assert all(abs(done[s] - 2500 * want[s]) < 1 for s in weights)


@pytest.mark.parametrize("odd", [1.0, 1 / 3])
def test_mix_keeps_to_the_weights_over_many_periods(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 500)
    weights = {f"s{i}": 1.0 + i % 4 for i in range(19)} | {"s19": 4 * odd}
    total = sum(Fraction(str(y)) for y in weights.values())
    rows = [(i, f"s{i % 20}") for i in range(8000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=2).select("source", "mix_block", "mix_slot").distinct().collect()
    assert len(got) == 4000 and len({x.mix_slot for x in got}) == 4000
    for x in got:
        w = Fraction(str(weights[x.source])) / total
        assert x.mix_block // w <= x.mix_slot < -(-(x.mix_block + 1) // w)


def test_every_source_stays_within_a_block_of_its_target_for_fifty_periods(spark):
    weights = {f"s{i}": 1.0 + i % 4 for i in range(20)}
    d = spark.range(20 * 50 * 4).selectExpr("id AS doc_id", "concat('s', id % 20) AS source")
    got = sorted((r.mix_slot, r.source) for r in mixing.mix(d, weights, block_docs=1).collect())
    slots, done = {t: s for t, s in got}, Counter()
    assert len(slots) == len(got)
    for t in range(50 * 50):
        done[slots[t]] += 1  # no slot is empty while all sources last
        assert all(abs(done[s] - (t + 1) * Fraction(int(w), 50)) < 1 for s, w in weights.items())
    assert [done[f"s{i}"] for i in range(4)] == [50, 100, 150, 200]


def test_any_number_of_sources(spark):
    d = spark.range(24_000).selectExpr("id AS doc_id", "concat('s', id % 12000) AS source")
    got = mixing.mix(d, {"s7": 3.0, "none": 1.0}, block_docs=1, default=1.0).select("source", "mix_block", "mix_slot").collect()
    assert len(got) == 24_000 == len({x.mix_slot for x in got})
    for x in got:
        w = Fraction(3 if x.source == "s7" else 1, 12_003)
        assert x.mix_block // w <= x.mix_slot < -(-(x.mix_block + 1) // w)
