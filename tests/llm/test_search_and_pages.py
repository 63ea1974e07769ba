import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyloom.llm import htmldiff, topk


def brute(rows, query_ids, k):
    import math

    usable = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i in query_ids:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(usable) if a != b and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [8_192, 7])
def test_top_k(spark, block):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60 + i, [0.5] * 6) for i in range(9)] + [(80, [0.0] * 6)]
    rows += [(90, None), (91, [1.0, None] + [0.0] * 4), (92, [float("nan")] * 6), (93, [float("inf")] * 6), (94, [1.0, 2.0]), (95, [2.0, 1.0]), (None, [9.0] * 6), (5, rows[5][1]), (60, [0.5] * 6), (60, [0.25] * 6), (96, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit("clash")).withColumn("v", F.lit(1))
    asked = {0, 5, 10, 60, 80, 94}
    got = topk.top_k(df, df.where(F.col("vec_id").isin(list(asked))), 5, block=block, query_block=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, asked, 5)
    assert topk.top_k(df.limit(0), df, 5).count() == 0 == topk.top_k(df, df.limit(0), 5).count()


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(2)
    vectors = rng.integers(0, 50, (20_000, 2))
    vectors[7] = [1000, 900]
    lists = topk.SortedLists(np.arange(20_000), vectors)
    found, depth = lists.search(3, np.array([1, 1]), 1)
    assert found == [(1900, 7)] and depth < 100
    assert lists.search(3, np.array([1, 1]), 1, floor=1900) == ([(1900, 7)], 8)  # a floor from elsewhere stops at once
    assert lists.search(3, np.array([1, 1]), 1, floor=1901) == ([], 8)


@pytest.mark.parametrize("size", [1e4, 1e6, 1e9, 1e30])
def test_large_components_are_exact(spark, size):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, size))) for _ in range(5)]) for i in range(60)]
    rows += [(60 + i, [float(np.float32(size)) + i] * 5) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), 5, block=16, query_block=4).collect()
    long = lambda x: max(-(2**63), min(2**63 - 1, x))
    import math

    usable = [(i, [long(math.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for i, q in usable:
        if i % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if i != j)[:5]
            want += [(i, r, j, long(-s)) for r, (s, j) in enumerate(scored, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<script>var t="</p><p>no";</script><div class="ad">Buy {n}</div><article><h1>Title&nbsp;{n}</h1><p>First   line &amp; more<br>
after break<p>Second <b>bold</b> line {n}</article><section class="comments"><p>Nice post {n}</p></section><footer>&copy; me</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("clash")).withColumn("part", F.lit("x"))


def test_article_is_kept_and_furniture_goes(spark):
    rows = [(i, f"http://h.example/{i % 5}", PAGE.format(n=i)) for i in range(30)]
    rows += [(30, None, None), (31, "http://h.example/x", ""), (31, "http://h.example/x", ""), (32, "http://[bad", "plain &lt;text&gt;"), (33, "u", "<p>a < b</p><!-- c --><form>f</form><p>unclosed")]
    got = {r.page_id: r for r in htmldiff.main_text(pages(spark, rows), per_partition=8).collect()}
    assert len(got) == 34
    for i in range(30):
        assert got[i].text == f"Title {i}\nFirst line & more\nafter break\nSecond bold line {i}"
        assert got[i].n_chars == len(got[i].text)
    assert (got[30].text, got[31].text, got[32].text, got[33].text) == ("", "", "plain <text>", "a < b\nunclosed")
    assert htmldiff.main_text(pages(spark, [])).count() == 0


def test_places():
    page = '<div id="main-content"><p class="lead">In</p><div class="comments"><p>Out</p></div><header>Kept</header></div><header>Gone</header><div>Open</div>'
    assert htmldiff.lines_of(page) == [(0, "In"), (2, "Out"), (0, "Kept"), (2, "Gone"), (1, "Open")]
    assert htmldiff.lines_of("<article><p>a<p>b</article>c<br/>d<img alt='>'>e</nav>f<script>x") == [(0, "a"), (0, "b"), (1, "c"), (1, "de"), (1, "f")]
    assert htmldiff.lines_of("<p title='it's>a</p>b</ x>c<p class=") == [(1, "a"), (1, "bc")]
    assert htmldiff.lines_of("<title>t</title>a&#x41;&nbsp;&lt;<!-- b -->c<textarea>q</textarea>") == [(1, "aA <c")]


def test_wrappers_with_furniture_names():
    for wrapper in ('class="layout has-sidebar"', 'class="page with-comments"', "class=no-sidebar", 'id="page-search"', 'class="sidebar layout"', 'class="layout--has-left-sidebar"'):
        assert htmldiff.lines_of(f"<div {wrapper}><nav>Menu</nav><article><p>In</p></article></div>") == [(2, "Menu"), (0, "In")], wrapper
        assert htmldiff.lines_of(f"<p>Open</p><div {wrapper}><div role='main'><p>In</p></div></div>") == [(1, "Open"), (0, "In")], wrapper
    assert htmldiff.lines_of("<div class='layout has-sidebar'><p>Open</p><div class='sidebar'>Out</div></div>") == [(1, "Open"), (2, "Out")]
    assert htmldiff.lines_of("<article>In</article><div class='comments'><article>Nice</article></div>") == [(0, "In"), (2, "Nice")]
    assert htmldiff.lines_of("<p>In</p><div class='related'><article>Teaser</article></div>") == [(1, "In"), (2, "Teaser")]
    assert htmldiff.lines_of("<nav><article>Menu</article></nav><div role='search'><main>Form</main></div><p>In</p>") == [(2, "Menu"), (2, "Form"), (1, "In")]
    assert htmldiff.lines_of("<nav class='menu'>a</nav><article><div class='share'>b</div>c</article>") == [(2, "a"), (2, "b"), (0, "c")]


def test_differencing_without_markup(spark):
    page = "<div>Home</div><div>About us</div><div>Story {n} alone</div><div>All rights reserved by h</div>"
    rows = [(i, f"http://h.example/p{i:02}", page.format(n=i)) for i in range(25)] + [(99, "http://other.example/p", page.format(n=99))]
    rows += [(10, rows[10][1], rows[10][2])] * 3  # copies are no evidence
    for per_partition in (4, 1000):
        got = {r.page_id: r.text for r in htmldiff.main_text(pages(spark, rows), per_partition).collect()}
        assert all(got[i] == f"Story {i} alone" for i in range(25))
        assert got[99] == "Home\nAbout us\nStory 99 alone\nAll rights reserved by h"  # no page beside it on its host


def test_body_beside_a_marked_block(spark):
    page = "<div>My site</div><article>Teaser {n}</article><div>Body {n}</div><div>Imprint</div>"
    got = htmldiff.main_text(pages(spark, [(i, f"http://h.example/{i}", page.format(n=i)) for i in range(6)]), per_partition=3).collect()
    assert {r.page_id: (r.text, r.n_shared) for r in got} == {i: (f"Teaser {i}\nBody {i}", 2) for i in range(6)}


@pytest.mark.parametrize("per_partition", [5, 1000])
def test_copies_under_other_menus(spark, per_partition):
    page = "<div>My site</div><nav>Menu {n}</nav><div>Story {k} alone</div><div class='ad'>Buy {n}</div><footer>Since {n}</footer>"
    rows = [(i, f"http://h.example/p{i:02}", page.format(n=i, k=i // 2)) for i in range(20)]
    got = htmldiff.main_text(pages(spark, rows), per_partition).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Story {i // 2} alone" for i in range(20)}


def test_longest_common_subsequence():
    rng = random.Random(3)

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        kept = htmldiff.shared_lines(a, b)
        assert len(kept) == longest(a, b)
        rest = iter(b)
        assert all(any(a[i] == x for x in rest) for i in sorted(kept))


def test_alignment_in_linear_memory():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(40))] for _ in range(2))
        whole, halved = htmldiff.aligned(a, b), htmldiff.aligned(a, b, most_bits=30)
        assert len(whole) == len(halved) == (int(htmldiff._lengths(a, b)[-1]) if a and b else 0)
        for found in (whole, halved):
            rest = iter(b)
            assert found == sorted(set(found)) and all(any(a[i] == x for x in rest) for i in found)


def test_very_long_pages(spark):
    rng = random.Random(6)
    lines = [[f"line {rng.randrange(30_000)}" for _ in range(20_000)] for _ in range(2)]
    found = htmldiff.shared_lines(*lines)
    assert found == set(htmldiff.aligned(*lines)) and len(found) == int(htmldiff._lengths(*lines)[-1]) > 200
    rows = [(i, f"http://h.example/{i}", "".join(f"<p>{x}" for x in page)) for i, page in enumerate(lines)]
    got = {r.page_id: r for r in htmldiff.main_text(pages(spark, rows)).collect()}
    assert got[0].text == "\n".join(x for i, x in enumerate(lines[0]) if i not in found) and got[0].n_shared == len(found)


def test_names_that_only_contain_a_furniture_name():
    for name in ('class="social-science"', 'id="search-results"', 'class="comment-free-speech"', 'id="advertising-history"', "class='navy-blue'"):
        assert htmldiff.article(f"<p>Top</p><div {name}><p>Text</p></div>") == "Top\nText", name
    for name in ('class="ad"', 'class="ad-box"', 'class="site-nav left"', 'id="cookie-banner"', 'class="post comments-list"', "class=newsletter-signup-form"):
        assert htmldiff.article(f"<p>Top</p><div {name}><p>Text</p></div>") == "Top", name
    assert htmldiff.article('<div class="menu"><p>Soup<p>Fish</div>') == "Soup\nFish"  # the name misleads: there is no other text


def test_lines_of_articles_stay(spark):
    page = "<div>Top</div><article><h1>Story {n}</h1><p>The same first line<p>Body {n}</article><div>End</div>"
    rows = [(i, f"http://h.example/{i}", page.format(n=i)) for i in range(8)]
    got = htmldiff.main_text(pages(spark, rows), per_partition=3).collect()
    assert {r.page_id: (r.text, r.n_shared) for r in got} == {i: (f"Story {i}\nThe same first line\nBody {i}", 2) for i in range(8)}


def site(rng, n):
    """Pages without any marked article, whose templates change over a host, with
    runs of copies: rows and the article's lines."""
    rows, want = [], {}
    for i in range(n):
        host, at = rng.choice(["a", "b", "b", "c"]), rng.randrange(1000)
        top = [f"{host} home", "About us", f"Section {at // 100} of {host}"]
        end = [f"Imprint of {host}", "All rights reserved"]
        body = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(9)) for _ in range(rng.randrange(2, 9))]
        for copy in range(rng.choice([1, 1, 1, 9])):
            page_id = len(rows)
            rows.append((page_id, f"http://{host}.example/p{at:04}/{i}/{copy}", "".join(f"<div>{x}</div>" for x in top + body + end)))
            want[page_id] = body
    return rows, want


def test_sites_without_markup(spark):
    rows, want = site(random.Random(7), 300)
    runs = [{r.page_id: r.text for r in htmldiff.main_text(pages(spark, rows), n).collect()} for n in (3, 20, 10_000)]
    assert runs[0] == runs[1] == runs[2]  # wherever partitions end, and runs of copies cover several
    right = kept = wanted = 0
    for i, body in want.items():
        lines = runs[0][i].split("\n")
        right, kept, wanted = right + len(set(lines) & set(body)), kept + len(lines), wanted + len(body)
    assert right / kept > 0.98 and right / wanted > 0.98
    plain = [htmldiff.article(page) for _, _, page in rows]
    assert all(plain[i] != runs[0][i] for i in want)  # without differencing no page comes out right
    print(f"recall {right / wanted:.4f}, precision {right / kept:.4f}")
