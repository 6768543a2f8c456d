"""Wrappers per host and the permutation index."""

from __future__ import annotations

import html
import json
import re
import time
from functools import reduce
from hashlib import blake2b

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import ROOT, given
from tickloom.llm import pivots, queries, wrappers
from tickloom.llm.common import Scratch
from tickloom.llm.markup import blocks, tree

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><script>var a="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies</div>
<article class="post has-comments"><header><h1>Head &amp; line</h1><span>by me</span></header>
<p>First <b>bold</b>text<br>second&nbsp;line<p>Third &lt;x&gt;
<aside>see also</aside><div class="ad">buy</div><form><input>Mail</form>
<ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section>
<footer>&copy; me</footer></body></html>"""


def test_article_of_a_page():
    want = "Head & line First boldtext second line Third <x> one two a b"
    text = wrappers.main_text(PAGE, None)
    assert text.replace("post has comments", "") == want


@pytest.mark.parametrize("page", ["", "   ", "plain words", "<p>a<p>b", "<b>x<i>y</b>z</i>", "<div" * 50, "<a href='x>y</a> z", "<!-- x", "<script>x", "&#x41;&bogus; &amp", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep", "</div></p>ok"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(wrappers.main_text(page, None), str)


def test_blocks_settle_white_space():
    parts = tree("<p> a\n b<i>c</i> d </p>e<div>f</div>").kids
    assert blocks(parts, lambda node: False) == ["a bc d", "e", "f"]


def test_folding_and_aligning():
    def keys(items):
        return [(x["k"], x["o"], x["r"]) for x in items]

    one = wrappers.expression(tree("<div><h2>a</h2><p>1</p><h2>b</h2><p>2</p></div><p>x</p><p>y</p>"))
    assert keys(one) == [("div", 0, 0), ("p", 0, 1)]
    assert keys(one[0]["c"]) == [("(h2 p)", 0, 1)]
    two = wrappers.expression(tree("<div><h2>c</h2><p>3</p></div><hr><p>z</p>"))
    three = wrappers.aligned(one, two)
    assert keys(three) == [("div", 0, 0), ("hr", 1, 0), ("p", 0, 1)]
    slot = wrappers.aligned(wrappers.expression(tree("<p>a</p>")), wrappers.expression(tree("<p>b</p>")))
    assert slot[0]["c"][0]["h"] is None


def test_template_without_article():
    """The region is where pages differ; what all of a host's pages say there is the template's."""
    def page(i):
        return (
            f"<body><div class='top'>My site</div><div class='x'><div class='story'><p>Story {i} {'word ' * 30}{i}</p>"
            f"<p>More {i} about {i}</p><span>All texts are free</span></div></div><div class='end'>Bye</div></body>"
        )

    wrapper = wrappers.expression(tree(page(0)))
    for i in range(1, 5):
        wrapper = wrappers.aligned(wrapper, wrappers.expression(tree(page(i))))
    found = wrappers.regions(wrapper)
    text = wrappers.main_text(page(7), found)
    assert text == " ".join(f"Story 7 {'word ' * 30}7 More 7 about 7".split())


def story(i):
    own = f"<em>By {i}</em>" if i == 1 else f"<i>By {i}</i>"
    return f"<body><div class='top'>My site</div><div class='x'><h2>Head {i}</h2><p>Story {i} {'word ' * 30}</p>{own}</div></body>"


def test_a_host_of_copies_keeps_its_texts(session):
    """Copies say nothing of the template: what only they have is not its own."""
    rows = [(i, "http://copies.x/a", story(1)) for i in range(6)]
    rows += [(10 + i, "http://some.x/a", story(1 if i < 4 else i)) for i in range(12)]
    df = session.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert all("Head 1 Story 1 word" in found[i] and "By 1" in found[i] for i in (*range(6), *range(10, 14)))
    assert all(f"Head {i} Story {i} word" in found[10 + i] and "My site" not in found[10 + i] for i in range(4, 12))


def test_the_wrapper_decides_in_articles_too(session):
    """Notices and comments with neutral names: the template's own texts, and articles beside the article."""
    def page(i):
        notice = "<div class='k'><b>Part of our series</b><p>Read on tomorrow</p></div>" if i % 4 else ""
        said = "".join(f"<article class='z'><p>Nice {i} {k}</p></article>" for k in range(i % 3))
        return (
            f"<body><article class='a'><h1>Head {i}</h1>{notice}<p>Story {i} {'word ' * 40}</p><p>Read on tomorrow</p>"
            f"<i>Filed by hand</i></article><div class='q'>{said}</div></body>"
        )

    rows = [(i, "http://paper.x/a", page(i)) for i in range(12)] + [(20, "http://alone.x/a", page(3))]
    df = session.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    for i in range(12):
        assert found[i] == " ".join(f"Head {i} Story {i} {'word ' * 40} Read on tomorrow".split())
    assert "Part of our series" in found[20] and "Filed by hand" in found[20]


@pytest.mark.parametrize("page", ["<a " * 3_300_000, '<a "' * 500_000, '<a "<a" ' * 300_000, "<!x " * 500_000, "</script " * 300_000 + "<script>", "<b>" * 50_000 + "<p>" * 50_000, "<p><td>" + "<b>" * 20_000 + "<p></p>" * 20_000])
def test_broken_pages_are_read_once(page):
    start = time.perf_counter()
    assert isinstance(wrappers.main_text(page, {"paths": [""], "fixed": [], "beside": []}), str)
    assert time.perf_counter() - start < 10
    if page.startswith("<a <a"):
        start = time.perf_counter()
        tree(page)
        assert time.perf_counter() - start < 2


def neutral(i):
    """No article, no telling names: a notice on all pages, a menu, comments on some, a text of paragraphs."""
    said = "".join(f"<div class='u'><b>R{i}{k}</b><span>fine {i} {k}</span></div>" for k in range(i % 3))
    return (
        f"<body><div class='a'><div>One</div><div>Two</div></div><div class='b'><div class='c'>We keep your data</div>"
        f"<div class='d'><h1>Head {i}</h1><p>Text {i} {' '.join(f'w{i}x{k}' for k in range(60))}</p><p>End {i}</p>"
        f"<i>All rights with us</i></div></div><div class='e'>{said}</div></body>"
    )


def test_neutral_names_need_the_other_pages(session, monkeypatch):
    """The text changes when the other pages are taken away, and not with the way Spark cuts them."""
    monkeypatch.setattr(wrappers, "BATCH", 4)
    monkeypatch.setattr(wrappers, "FAN", 2)
    rows = [(i, "http://neutral.x/a", neutral(i % 37)) for i in range(60)] + [(100, "http://alone.y/a", neutral(5))]
    df = session.createDataFrame(rows, "page_id long, url string, html string")
    found = [{r.page_id: r.text for r in wrappers.extract(df.repartition(n)).collect()} for n in (1, 7)]
    assert found[0] == found[1]
    for i in range(60):
        j = i % 37
        assert found[0][i] == f"Head {j} Text {j} {' '.join(f'w{j}x{k}' for k in range(60))} End {j}"
    assert "All rights with us" in found[0][100] and found[0][100] != found[0][5]


def test_a_hot_host_is_joined_in_a_tree(session, monkeypatch):
    """Parts of a host by the hash of its pages, aligned in its order, joined level by level: as in plain loops."""
    monkeypatch.setattr(wrappers, "BATCH", 4)
    monkeypatch.setattr(wrappers, "FAN", 3)
    pages = [neutral(i) for i in range(50)]
    df = session.createDataFrame([("http://hot.x/a", p) for p in pages] * 2, "url string, html string").repartition(5)
    (row,) = wrappers.wrappers(df, Scratch(session, "test")).collect()
    hashes = {blake2b(p.encode(), digest_size=16).digest(): p for p in pages}
    dealt = session.createDataFrame([(h,) for h in hashes], "page binary").select("page", F.pmod(F.xxhash64("page"), F.lit(13)).alias("part"))
    level: dict[int, list] = {}
    for r in sorted(dealt.collect(), key=lambda r: bytes(r.page)):
        level.setdefault(r.part, []).append(wrappers.expression(tree(hashes[bytes(r.page)])))
    joined = {k: reduce(wrappers.aligned, v) for k, v in level.items()}
    while len(joined) > 1:
        above: dict[int, list] = {}
        for k, w in joined.items():
            above.setdefault(k // 3, []).append(json.dumps(w))
        joined = {k: reduce(wrappers.aligned, map(json.loads, sorted(v))) for k, v in above.items()}
    assert (row.host, row.pages) == ("hot.x", 50) and json.loads(row.wrapper) == joined[0]


def article(page: str) -> str:
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"</?(p|h1|br|li|ul|div)>", "\n", inner)
    lines = (" ".join(html.unescape(b).split()) for b in re.sub(r"<[^>]+>", "", inner).split("\n"))
    return " ".join(x for x in lines if x)


def test_query_on_the_given_pages(session):
    found = {r.page_id: r for r in queries.QUERIES["op5_host_wrappers"](session, ROOT).collect()}
    rows = given("pages")
    assert len(found) == len(rows)
    for r in rows:
        assert found[r["page_id"]].text == article(r["html"])
        assert found[r["page_id"]].n_chars == len(article(r["html"]))
        assert found[r["page_id"]].url == r["url"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_extract_odd_rows(session, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    rows = [(1, None, "<p>no url</p>", 1), (2, "http://h.x/", None, 2), (None, "http://[bad", "<p>x</p>", 3), (4, "", "", 4), (1, None, "<p>no url</p>", 5)]
    rows += [(10 + i, "http://big.host/a", PAGE.replace("Third", f"Third{i}"), i) for i in range(30)]
    pages = session.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = sorted(map(tuple, wrappers.extract(pages).collect()), key=repr)
    assert len(found) == len(rows)
    assert found.count((1, None, "no url", 6)) == 2
    assert (2, "http://h.x/", "", 0) in found and (4, "", "", 0) in found
    assert all(f"Third{i} <x>" in t for p, _, t, _ in found if (i := (p or 0) - 10) >= 0)
    assert wrappers.extract(pages.limit(0)).count() == 0


def exact(rows, every, k=10):
    ids, vs = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0).tolist():
        far = np.sqrt(((vs - vs[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, far)).tolist() if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(n + 1, int(ids[j]), float(far[j])) for n, j in enumerate(order)]
    return out


def results(df):
    out: dict[int, list] = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_search_finds_nine_in_ten(session):
    found = results(queries.QUERIES["op10_pivot_permutations"](session, "/root/testdata/sf0.1"))
    import pyarrow.parquet as pq

    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pylist()]
    want = exact(rows, 100)
    assert found.keys() == want.keys() and all(len(v) == 10 for v in found.values())
    pairs = [(q, v) for q, rows in found.items() for _, v, _ in rows]
    assert pivots.recall(pairs, [(q, v) for q, rows in want.items() for _, v, _ in rows]) >= 0.9


def test_search_odd_rows(session):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(1, 60)]
    rows += [(100, rows[3][1]), (200, rows[3][1]), (300, rows[5][1])]
    bad = [(400, None), (500, [0.0] * 4), (600, [1.0, None, 2.0, 3.0]), (700, [float("nan")] * 4), (800, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (900, [1.0, 2.0])]
    df = session.createDataFrame([(i, v, 1, 2, True) for i, v in rows + bad + rows[:1]], "vec_id long, embedding array<double>, v int, block int, asks boolean")
    found = results(pivots.search(df, every=100))
    want = exact(rows, 100)
    assert {q: [(n, v, round(s, 12)) for n, v, s in x] for q, x in found.items()} == {q: [(n, v, round(s, 12)) for n, v, s in x] for q, x in want.items()}
    few = session.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert results(pivots.search(few, every=100)) == {0: [(1, 1, 2**0.5)]}
    assert pivots.search(few.limit(0), every=100).count() == 0


def test_copies_of_a_third_of_the_rows(session):
    """Ties go to the smaller ids, however many rows are equal."""
    rng = np.random.default_rng(8)
    common = rng.normal(size=8).tolist()
    ids = rng.permutation(3000).tolist()
    rows = [(i, common if n < 1000 else rng.normal(size=8).tolist()) for n, i in enumerate(ids)]
    df = session.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, want = results(pivots.search(df, every=20)), exact(rows, 20)
    equal = {i for i, v in rows if v is common and i % 20 == 0}
    assert len(equal) > 20 and found.keys() == want.keys()
    assert {q: found[q] for q in equal} == {q: want[q] for q in equal}


def test_ties_with_the_last_one_kept():
    far = np.array([3, 1, 2, 2, 5, 2, 0])
    assert pivots.nearest(far, 3).nonzero()[0].tolist() == [1, 2, 3, 5, 6]


def test_footrule_by_files_is_the_footrule():
    rng = np.random.default_rng(6)
    vectors, centres, n = rng.normal(size=(50, 5)), rng.normal(size=(20, 5)), 8
    files = pivots.Files(vectors, centres, n)
    order = pivots.nearest_pivots(vectors, centres, n)
    place = np.full((50, 20), n)
    np.put_along_axis(place, order, np.arange(n)[None].repeat(50, 0), axis=1)
    for i in range(50):
        assert (files.footrule(order[i]) == np.abs(place - place[i]).sum(1)).all()
