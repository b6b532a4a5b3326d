"""Quotation linking, toxicity grades and the pipeline."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisig.llm import chat, toxicity

A = "Hello there, how are you?\n\nI wanted to ask about the plan."
B = "> Hello there, how  are YOU?\n\nFine, thanks."
C = "On Monday, B wrote:\n> > Hello there, how are you?\n> Fine, thanks.\nGood to hear."
D = "> I wanted to ask about the plan.\nWhich plan?"


def test_parse():
    assert chat.parse(C) == [(2, "Hello there, how are you?"), (1, "Fine, thanks."), (0, "Good to hear.")]
    assert chat.parse("a > b\nc") == [(0, "a > b\nc")] and chat.parse("") == [(0, "")]
    assert chat.parse(" >>x\n>y") == [(2, "x"), (1, "y")]


def test_links(spark):
    rows = [(1, 0, "user", A), (1, 1, "assistant", B), (1, 2, "user", C), (1, 3, "user", D), (1, 4, "user", "no quotation"), (1, 5, "user", "> never said\nx"),
            (2, 0, "user", "> Fine, thanks."), (2, 1, "user", None), (2, 2, "user", ""), (None, 1, None, B), (1, 3, "user", D)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, own string")
    got = {(r.conv_id, r.turn): r for r in chat.link(d).collect()}
    assert chat.link(d).count() == len(rows)
    assert [(got[1, t].reply_to, got[1, t].thread, got[1, t].depth) for t in range(6)] == [(None, 0, 0), (0, 0, 1), (1, 0, 2), (0, 0, 1), (None, 4, 0), (None, 5, 0)]
    assert (got[1, 1].text, got[1, 2].text, got[1, 3].text, got[1, 0].text) == ("Fine, thanks.", "Good to hear.", "Which plan?", A)
    assert got[2, 0].reply_to is None and got[2, 1].text == "" and got[1, 5].n_quotes == 1
    assert chat.link(d.where("false")).count() == 0 and chat.link(d.drop("role")).count() == len(rows)


def test_long_chains(spark):
    rows = [(1, 0, "message 0")] + [(1, i, f"> message {i - 1}\nmessage {i}") for i in range(1, 70)]
    got = {r.turn: r for r in chat.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert all(got[i].depth == i and got[i].thread == 0 and got[i].reply_to == (i - 1 if i else None) for i in range(70))


def test_without_quotations(spark):
    rows = [(1, i, "user", f"  plain\n\ntext {i} ") for i in range(3)]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.text, r.reply_to, r.thread) for r in got) == [(i, f"  plain\n\ntext {i} ", None, i) for i in range(3)]


def test_ordinal_fit():
    r = np.random.default_rng(0)
    true = np.array([2.0, -2.0, 1.0, 0.0])
    rows = [np.flatnonzero(r.random(4) < 0.5) for _ in range(4000)]
    z = np.array([true[x].sum() for x in rows]) + r.logistic(size=4000)
    y = np.digitize(z, [0.5, 2.0])
    m = toxicity.Ordinal.fit([b"a", b"b", b"c", b"d"], rows, y, 3, rounds=800)
    assert np.allclose(list(m.vocabulary.values()), true, atol=0.25) and np.allclose(m.cuts, [0.5, 2.0], atol=0.25) and (np.diff(m.cuts) > 0).all()


def table(spark, n=1500):
    r = random.Random(2)
    clean, bad, rows = [f"word{i}" for i in range(300)], ["vile", "nasty", "horrid"], []
    for i in range(n):
        toxic = i % 7 == 0
        w = [r.choice(clean) for _ in range(r.randint(5, 80))]
        for _ in range(r.randint(1, 4) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad).upper() + r.choice(["", ",", "!"]))
        rows.append((i, " ".join(w), int(toxic)))
    return spark.createDataFrame(rows, "id long, text string, toxic int").withColumnRenamed("id", "doc_id").withColumn("severity", F.lit("x"))


def test_held_out(spark):
    d = table(spark)
    model = toxicity.train(d.where("doc_id < 1000").drop("toxic"), d.select("doc_id", "toxic"), max_rows=700)
    got = d.where("doc_id >= 1000").select("toxic", toxicity.severity(model, F.col("text")).alias("s")).collect()
    assert np.mean([r.s.toxic == bool(r.toxic) for r in got]) > 0.97
    assert np.mean([r.s.severity for r in got if r.toxic]) > 10 * np.mean([r.s.severity for r in got if not r.toxic])
    odd = spark.createDataFrame([(None,), ("",), ("x" * 200_000,)], "text string").select(toxicity.severity(model, F.col("text")).alias("s")).collect()
    assert not any(r.s.toxic for r in odd)


def test_given_grades_and_one_kind(spark):
    d = table(spark, 400)
    graded = d.select("doc_id", F.when(F.col("toxic") == 1, F.lit(2)).otherwise(0).alias("grade"), "toxic")
    assert len(toxicity.train(d, graded, grade_col="grade").cuts) == 2
    for labels in (graded.where("false"), graded.where("toxic = 0")):
        model = toxicity.train(d, labels)
        assert not any(r.s.toxic for r in d.limit(5).select(toxicity.severity(model, F.col("text")).alias("s")).collect())


def test_pipeline(spark):
    import corpus_pipeline
    from lumisig.llm import quality, simhash

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, ids = [], [set(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialize(stage(spark, docs, sf))
        assert out.columns == docs.columns
        ids.append({r.doc_id for r in out.collect()})
        assert out.count() == len(ids[-1]) and ids[-1] <= ids[-2]
        docs = out
    judged = {r.id for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").collect()}
    assert ids[1] == judged
    assert ids[3] and ids[4] == ids[3]  # mixing keeps all
    assert simhash.deduplicate(docs).count() == len(ids[3])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == ids[4]
    assert {(r.doc_id, r.start, r.length) for r in packed} and len(corpus_pipeline.run(spark, sf).columns) == 7


def test_library_stands_without_this_subpackage():
    import ast
    from pathlib import Path

    root = Path(chat.__file__).resolve().parent.parent
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            names = {getattr(n, "module", None) or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)}
            assert not any("llm" in n for n in names), p


def test_partial_and_wrapped_quotations(spark):
    first = "The old mill stands by the river. Nobody has lived there since the great flood came! We should visit it on Sunday morning if the weather stays dry."
    other = "A second message with other words in it. It says nothing about the place that the first describes."
    rows = [(1, 0, first), (1, 1, other)]
    rows += [(1, 2, "> Nobody has lived there since the great flood came!\nReally?")]  # one sentence of a line
    rows += [(1, 3, "> there since the great flood came! We should\n> visit it on Sunday morning if\nYes.")]  # cut and re-wrapped
    rows += [(1, 4, "> It says nothing about\n> the place that the first\nNo.\n> describes.\nIndeed.")]  # an inline reply
    rows += [(1, 5, "> words that nobody has said so far in this talk\nHm.")]
    got = {r.turn: (r.reply_to, r.thread, r.n_quotes) for r in chat.link(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0, 0), 1: (None, 1, 0), 2: (0, 0, 1), 3: (0, 0, 1), 4: (1, 1, 2), 5: (None, 5, 1)}


def thread_tables(r, conversations, most):
    """Messages with quotations of earlier ones, whole, in part, wrapped anew and nested; some quote nothing or nobody."""
    words = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8))) for _ in range(900)]
    said = lambda: " ".join(r.choice(words) for _ in range(r.randint(8, 30))) + "."
    rows = []
    for c in range(conversations):
        own: list[str] = []
        for t in range(r.randint(1, most)):
            mine = "\n".join(said() for _ in range(r.randint(1, 3)))
            parts = [mine]
            if t and r.random() < 0.8:
                w = own[r.randrange(t)].split()
                start = r.randint(0, max(0, len(w) - 8))
                quoted = w[start : start + r.randint(7, 60)] if r.random() < 0.7 else w
                width = r.randint(4, 12)
                lines = [" ".join(quoted[i : i + width]) for i in range(0, len(quoted), width)]
                if r.random() < 0.3 and t > 1:  # what that one answers, a level deeper
                    lines = ["> " + " ".join(own[0].split()[:9]), *lines]
                parts = [*(["On Monday somebody wrote:"] if r.random() < 0.4 else []), *("> " + x for x in lines), mine]
            own.append(mine)
            rows.append((c, t, "user", "\n".join(parts)))
    return rows


def plain_links(rows):
    """reply_to of each message by comparing it with every earlier message of its conversation."""
    import re

    norm = lambda x: re.findall(r"\w+", x.lower())

    def pieces(text):
        out = {tuple(norm(p)) for p in [text, *re.split(r"\n\s*\n", text), *text.split("\n"), *re.split(r"(?<=[.!?…])\s+", text)]}
        w = norm(text)
        return {p for p in out if p} | {tuple(w[i : i + 6]) for i in range(len(w) - 5)}

    def levels(text):
        found: dict[int, list[list[str]]] = {}
        before = None
        for line in text.split("\n"):
            marks = re.match(r"(?:\s*>)*", line)[0].count(">")
            line = re.sub(r"^(?:\s*>)+ ?", "", line)
            if marks == 0 and line.endswith("wrote:"):
                continue
            if marks != before:
                found.setdefault(marks, []).append([])
            found[marks][-1].append(line)
            before = marks
        return {k: ["\n".join(x) for x in v] for k, v in found.items()}

    talks, out = {}, {}
    for c, t, _, x in rows:
        talks.setdefault(c, []).append((t, levels(x)))
    for c, talk in talks.items():
        owners = [(t, set().union(*map(pieces, lv.get(0, [])), pieces("\n".join(lv.get(0, []))))) for t, lv in talk]
        for t, lv in talk:
            out[c, t] = None
            for level in sorted(k for k in lv if k):
                want = set().union(*map(pieces, lv[level]))
                votes = {}
                for p in want:
                    first = next((u for u, has in owners if p in has), None)
                    if first is not None and first < t:
                        votes[first] = votes.get(first, 0) + 1
                if votes:
                    out[c, t] = max(votes, key=lambda u: (votes[u], u))
                    break
    return out


def test_links_equal_a_plain_comparison(spark):
    r = random.Random(11)
    rows = thread_tables(r, 60, 12) + [(1000, t, u, x) for _, t, u, x in thread_tables(r, 1, 150)[:150]]
    want = plain_links(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.link(d).collect()
    assert len(got) == len(rows) and {(x.conv_id, x.turn): x.reply_to for x in got} == want
    assert sum(v is not None for v in want.values()) > 0.6 * len(rows)
    by = {(x.conv_id, x.turn): x for x in got}
    talks = {}
    for x in got:
        talks.setdefault(x.conv_id, []).append(x)
        up, steps = x, 0
        while up.reply_to is not None:
            up, steps = by[up.conv_id, up.reply_to], steps + 1
        assert (x.thread, x.depth) == (up.turn, steps) and (x.reply_to is None or by[x.conv_id, x.reply_to].position < x.position)
    for talk in talks.values():
        assert [x.position for x in sorted(talk, key=lambda x: (x.thread, x.turn))] == list(range(len(talk)))


def test_long_messages_and_much_quoted_passages(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "> " + " ".join(f"word{i}" for i in range(40_000, 40_020)) + "\nyes")]
    rows += [(2, 0, "user", "Everybody repeats this one sentence all day long.")] + [(2, t, "user", "> Everybody repeats this one sentence all day long.\nIndeed " + str(t)) for t in range(1, 1500)]
    rows += [(None, 1, "user", "a"), (3, None, "user", "b"), (4, 0, None, None), (5, 0, "user", "c"), (5, 0, "user", "c")]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(x.conv_id, x.turn): x for x in got}
    assert by[1, 1].reply_to == 0 and all((by[2, t].reply_to, by[2, t].depth, by[2, t].position) == (0, 1, t) for t in range(1, 1500))
    assert by[None, 1].position is None and by[3, None].position is None and by[4, 0].text == "" and by[5, 0].position == 0


def test_scores_equal_a_plain_scorer_and_its_slope(spark):
    d = table(spark, 500)
    model = toxicity.train(d, d.select("doc_id", "toxic"))
    got = {x.doc_id: x.s for x in d.select("doc_id", toxicity.severity(model, F.col("text")).alias("s")).collect()}
    for x in d.collect():
        words = set()
        for w in "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in x.text).split():
            words |= {w.encode(), *([w[:4].encode() + b"*"] if len(w) > 4 else []), *([w[:5].encode() + b"*"] if len(w) > 5 else [])}
        score = sum(v for w, v in model.vocabulary.items() if w in words)
        p = [1 / (1 + np.exp(cut - score)) for cut in model.cuts]  # P(grade > k)
        assert abs(got[x.doc_id].severity - sum(p)) < 1e-9 and got[x.doc_id].toxic == (p[0] >= 0.5)
    assert list(model.cuts) == sorted(model.cuts)


def test_given_grades_are_told_apart_on_held_out_texts(spark):
    r = random.Random(6)
    clean, kinds = [f"word{i}" for i in range(300)], [[], ["silly", "rubbish"], ["stupid", "idiot"], ["vermin", "scum"]]
    rows = []
    for i in range(2400):
        grade = r.choice([0, 0, 0, 1, 2, 3])
        w = [r.choice(clean) for _ in range(r.randint(10, 60))] + [r.choice(k) for g, k in enumerate(kinds) if 0 < g <= grade for _ in range(r.randint(1, 2))]
        r.shuffle(w)
        rows.append((i, " ".join(w), grade))
    d = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.train(d.where("doc_id < 1600").drop("grade"), d.select("doc_id", "grade"), grade_col="grade")
    got = d.where("doc_id >= 1600").select("grade", toxicity.severity(model, F.col("text")).alias("s")).collect()
    assert np.mean([abs(x.s.severity - x.grade) for x in got]) < 0.15
    assert np.mean([round(x.s.severity) == x.grade for x in got]) > 0.95
