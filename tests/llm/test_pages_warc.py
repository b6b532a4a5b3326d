"""Main text of pages, and archives."""

import gzip
import hashlib
import itertools
import random
import time

import pytest

from lumisig.llm import pages, warc


def page(i, extra="", main=True):
    body = f"<h1>Title {i}</h1><p>First &amp; only\n  text <b>of</b> {i}.<br>More<p>Second&nbsp;part {i * 7}</p><ul><li>one {i}<li>two</ul>"
    return (
        f'<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body><header><p>Site {i}</p></header>'
        f'<nav><ul><li><a href="/x">Menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies {i}</div><!-- <p>no</p> --><div class="ad">Buy {i}</div>'
        f'{extra}{"<article>" if main else "<div>"}{body}<form><p>Sign up {i}</p><input></form><div class="comments"><p>Great {i}!</p></div>{"</article>" if main else "</div>"}'
        f'<aside>Side {i}</aside><section id="sidebar">Bar {i}</section><footer>&copy; {i}</footer></body></html>'
    )


def want(i):
    return f"Title {i}\n\nFirst & only text of {i}. More\n\nSecond part {i * 7}\n\none {i}\n\ntwo"


def test_articles_are_taken(spark):
    rows = [(i, f"https://a{i % 2}.example/{i}", page(i)) for i in range(40)]
    rows += [(100 + i, f"http://plain.example/{i}", page(i, main=False)) for i in range(20)]
    rows += [(200, None, page(200)), (201, "x", None), (202, "http://a0.example/z", ""), (203, "http://a0.example/y", "no markup at all"), (204, "http://a0.example/w", "<html><body><p>lone <i>text</i>")]
    d = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string").repartition(3)
    for limit in (16 << 20, 0):  # the second joins wrappers by host
        got = {r.page_id: r.text for r in pages.main_text(d, broadcast_bytes=limit).collect()}
        assert len(got) == len(rows)
        for i in range(40):
            assert got[i] == want(i)
        for i in range(20):
            assert got[100 + i] == want(i)
        assert [got[i] for i in (200, 201, 202, 203, 204)] == [want(200), "", "", "no markup at all", "lone text"]
    assert pages.main_text(d.where("false")).count() == 0


def test_constant_boxes_outside_the_article_are_template(spark):
    box = '<div class="info">Our terms have not changed</div>'
    rows = [(i, "http://b.example/", page(i, main=False).replace("<body>", "<body><center>" + box + "</center>")) for i in range(30)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == want(r.page_id) for r in got)


def test_shared_passages_in_articles_stay(spark):
    rows = [(i, "http://c.example/", f"<body><article><h1>Same</h1><p>Shared passage</p><p>Own {i}</p></article></body>") for i in range(30)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Same\n\nShared passage\n\nOwn {r.page_id}" for r in got)


def test_cut_pages():
    for cut in range(0, len(page(1)), 7):
        pages.extract(page(1)[:cut], None, {})
    assert pages.extract("<article><p>a</p><p>b &am", None, {}) == "a\n\nb &am"
    assert pages.extract("<article><p>a<script>x</article>", None, {}) == "a"
    assert pages.extract("<article><p>a<button>x</button></article><article class='comment'><p>c</article>", None, {}) == "a"
    assert pages.extract("<title>t<p>a", None, {}) == "t\n\na"
    assert pages.extract("<p>1 < 2 &lt; 3</p>", None, {}) == "1 < 2 < 3"


def test_tree_matching():
    a, b = (pages.shape([pages.tree(x)]) for x in ("<div><p>x</p></div><ul></ul><div class=z></div>", "<ul></ul><div><h1></h1><p></p></div><div class=z></div>"))
    size, pairs = pages.matched(a.kids, b.kids)
    assert size == 3 and [(a.kids[i].label, b.kids[j].label) for i, j in pairs] == [("div", "div"), ("div.z", "div.z")]


def plain_match(a, b):
    """Simple tree matching by its definition, every combination in turn."""
    w = [[1 + plain_match(x.kids, y.kids)[0] if x.label == y.label else 0 for y in b] for x in a]
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w[i][j])
    i, j, pairs = len(a), len(b), []
    while i and j:
        if w[i - 1][j - 1] and m[i][j] == m[i - 1][j - 1] + w[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif m[i][j] == m[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return m[-1][-1], pairs[::-1]


def row(r, n, labels, depth):
    out = [pages.Shape(r.choice(labels), False) for _ in range(r.randint(n // 2, n))]
    for s in out:
        s.kids = row(r, n // 2, labels, depth - 1) if depth and r.random() < 0.5 else []
    return out


def test_matching_equals_its_definition(monkeypatch):
    r = random.Random(4)
    for held, plain, known in ((1, 0, 2), (40, 5, 1 << 18), (1 << 22, 100, 1 << 18)):
        monkeypatch.setattr(pages.Sizes, "PLAIN", plain)
        monkeypatch.setattr(pages.Sizes, "KNOWN", known)
        monkeypatch.setattr(pages.Table, "HELD", held)
        monkeypatch.setattr(pages.Table, "KEPT", 3)
        for n, labels, depth in [(4, "ab", 3), (10, "abc", 2), (30, "abcdefgh", 1), (60, "ab", 0)] * 60:
            a = row(r, n, labels, depth)
            b = row(r, n, labels, depth) if r.random() < 0.7 else [x for x in a if r.random() < 0.8] + row(r, 2, labels, 1)
            assert pages.matched(a, b) == plain_match(a, b)


def test_long_rows_are_matched_as_short_ones():
    for n in (20, 255, 300, 3000):  # 256 trees a row had been the limit
        d = [pages.Shape(f"d{i}", False) for i in range(n)]
        z = pages.Shape("z", False)
        assert pages.matched([*d, z], [z, *d]) == (n, [(i, i + 1) for i in range(n)])
    a, b = (row(random.Random(i), 600, "abcde", 0) for i in (1, 2))
    assert pages.matched(a, b) == plain_match(a, b)


@pytest.mark.parametrize("n", [20, 400])
def test_wide_pages_get_the_same_text_as_narrow_ones(spark, n):
    names = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    tail = "<div class=z>Ours since ever</div>"
    rows = []
    for i in range(12):  # the host's line stands below the blocks, or above them on every third page
        blocks = "".join(f"<div class=c{names(k)}>own {i} {k}</div><p class=c{names(k)}>The same {k}</p>" for k in range(n // 2))
        rows.append((i, "http://wide.example/", f"<body>{tail + blocks if i % 3 == 2 else blocks + tail}</body>"))
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    for i in range(12):
        text = "\n\n".join(f"own {i} {k}" for k in range(n // 2))
        assert got[i] == ("Ours since ever\n\n" if i % 3 == 2 else "") + text  # on a third of the pages it is not yet the host's


def story(r, h, i):
    """A page without any telling tag or name, and its text: the host's own boxes are around and among its blocks."""
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9)))
    said = lambda n: " ".join(word() for _ in range(n))
    blocks = [("h2", f"{said(4)} {i}")] + [(r.choice("ppps"), said(r.randint(8, 60))) for _ in range(r.randint(2, 9))]
    tag = {"h2": "<h2>{}</h2>", "p": "<p>{}", "s": "<div class=x9>{}</div>"}
    body = [tag[k].format(t) for k, t in blocks]
    if h % 3 == 1:  # a box of the host between the title and the rest
        body.insert(1, f"<div class=x3><p>Please keep our house {h} in mind<p>and its garden</div>")
    if h % 3 == 2:  # plain blocks of the host beside the text
        body = [f"<p>This is the gazette of town {h}</p>", *body, f"<p>Printed by hand in town {h}</p><ul><li>first floor</li><li>second floor</li></ul>"]
    top = f"<div class=x1><div class=x2>The gazette {h}</div><ul><li>one<li>two {h}<li>three</ul></div>"
    low = f"<div class=x7><p>All rights of {h}</p><div><p>Street {h * 3}</p></div></div>"
    page = f"<html><head><title>{i}</title></head><body>{top}<div class=x5>{''.join(body)}</div>{low}</body></html>"
    if h % 2:
        page = page.replace("<div class=x5>", "").replace(f"</div>{low}", low)  # no box around the text either
    return page, "\n\n".join(t for _, t in blocks)


def test_the_template_alone_finds_the_text(spark):
    r = random.Random(5)
    rows = {i: (f"http://h{i % 8}.example/{i}", *story(r, i % 8, i)) for i in range(240)}
    d = spark.createDataFrame([(i, u, p) for i, (u, p, _) in rows.items()], "page_id long, url string, html string").repartition(5)
    got = {x.page_id: x.text for x in pages.main_text(d).collect()}
    alone = {i: pages.extract(p, None, {}) for i, (_, p, _) in rows.items()}
    assert sum(got[i] == t for i, (_, _, t) in rows.items()) == 240
    assert sum(alone[i] == t for i, (_, _, t) in rows.items()) == 0  # each of the 240 needs the wrapper


def test_all_that_an_article_holds_stays(spark):
    rows = [(i, "http://d.example/", f"<body><div>Menu</div><article><h1>T</h1><div class=lead>Shared lead</div><table><tr><td>a<td>b</table><p>Own {i}<math><mi>x</mi></math></p></article></body>") for i in range(40)]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"T\n\nShared lead\n\na b\n\nOwn {r.page_id}x" for r in got)


def test_deep_wide_and_broken_pages(spark):
    deep = "<div>" * 10_000 + "<nav>menu</nav><p>deep" + "<p>x</p></div>" * 10_000
    flat = "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>w{i}</div>" for i in range(5000))
    rows = [(1, "http://e/", deep), (2, "http://e/", flat), (3, "http://e/", flat + "more"), (4, "http://e/", "<p>a" + '<a x="' * 150_000), (5, "http://e/", "<select>" * 30_000 + "<ul>" * 30_000 + "</p>" * 30_000 + "end")]
    began = time.time()
    got = {x.page_id: x.text for x in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert time.time() - began < 60
    assert got[1].startswith("deep\n\nx\n\nx") and "menu" not in got[1] and got[1].count("x") == 10_000
    assert got[2].startswith("w0\n\nw1\n\n") and got[2].count("w") == 5000 and got[3].endswith("more")
    assert got[4].startswith("a") and got[5] == "end"
    began = time.time()
    pages.tree('<a x="' * 170_000)  # a megabyte
    assert time.time() - began < 2


def test_templates_are_bounded_by_the_size_of_pages():
    names = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    learner, sizes = pages.Learner(), []
    for i in range(600):
        learner.add("h", "<body>" + "".join(f"<div class={names(i * 10 + k)}>w{i}{k}</div>" for k in range(10)) + f"<p class=text>own {i}</p></body>")
        sizes.append(len(learner.dump().__next__()[1]))
    assert len(learner.hosts["h"].template.preorder()) <= pages.Host.MOST + 12 and max(sizes[300:]) <= 1.2 * max(sizes[:300])
    more = pages.Host.read(learner.hosts["h"].dump())
    more.merge(learner.hosts["h"])
    assert more.template.pages == 1200 and any(s.label == "p.text" and s.pages == 1200 for s in more.template.preorder())


def rows_of(spark):
    big = "x" * 1200
    data = [(1, "http://a/", big), (2, "http://b/\r\nEvil: 1", big), (9, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "ü", "é\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 600),
            (8, "u", "\r\n\r\n"), (10, "u", "é" * 500), (11, "u", "é" * 500), (12, "u", "y" * 999), (13, "u", "y" * 999), (None, "u", big)]
    return data, spark.createDataFrame([(*r, "z") for r in data], "page_id long, url string, html string, refers_to string")


def test_archives(spark, tmp_path):
    data, d = rows_of(spark)
    path = str(tmp_path / "w")
    warc.write_archives(d, path, per_file=4)
    found = warc.read_archives(spark, path)
    got = {r.page_id: r for r in found.collect()}
    assert len(got) == len(data)
    for i, _, html in data:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
    assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {1: 9, 2: 9, 10: 11}
    assert got[7].url == "ü" and got[2].url == "http://b/%0D%0AEvil: 1" and got[9].url is None
    whole = {r.page_id: bytes(r.payload) for r in warc.restore(found).collect()}
    assert whole == {i: (h or "").encode() for i, _, h in data}
    warc.write_archives(d.where("false"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_repeated_rows(spark, tmp_path):
    d = spark.createDataFrame([(1, "u", "x" * 1000), (1, "u", "x" * 1000), (2, "u", "x" * 1000)], "page_id long, url string, html string")
    warc.write_archives(d, str(tmp_path / "w"))
    assert sorted((r.page_id, r.record_type) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == [(1, "revisit"), (1, "revisit"), (2, "response")]


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "USUAL_BYTES", 1000)
    r = random.Random(1)
    data = [(i, "u", "".join(r.choice("abcdefgh") for _ in range(r.choice([10, 900, 3000, 40_000, 100_000])))) for i in range(120)]
    d = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    path = tmp_path / "w"
    warc.write_archives(d, str(path), per_file=16)
    held = [sum(len(b) for _, b in warc.parse(f.read_bytes())) for f in path.rglob("part-*.gz")]
    assert max(held) < 101_000 and len(held) > 10
    got = {x.page_id: bytes(x.payload) for x in warc.read_archives(spark, str(path)).collect()}
    assert got == {i: t.encode() for i, _, t in data}


def test_parser():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    for content in (record * 3, gzip.compress(record) * 3, gzip.compress(record * 3)):
        for step in (1, 7, 1 << 20):
            assert [b for _, b in warc.parse(content, step)] == [b"ab\r\nc"] * 3
    for bad in (record[:-6], b"HTTP/1.1 x\r\n\r\n", b"WARC/1.0\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
