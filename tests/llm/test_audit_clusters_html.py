"""Source divergence, centroid clusters and page texts against plain versions."""

import hashlib
import html
import math
import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from marketlens.llm import clusters, divergence, dom, extraction, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, least, top):
    """The contract's definition over (text, lang, source) rows."""
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    out = []
    for lang in {a for _, a, _ in rows}:
        texts = [(s, TERM.findall(brute.lower_ascii(t))) for t, a, s in rows if a == lang]
        held = Counter(term for _, terms in texts for term in set(terms))
        kept = {term for term, n in held.items() if n >= least}
        counts = {s: Counter() for s, _ in texts}
        for s, terms in texts:
            counts[s].update(t for t in terms if t in kept)
        everything = sum(counts.values(), Counter())

        def shares(count):
            total = sum(count.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // total for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(everything)
        for s in p:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s]
            above = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", above, top)):
                ranked = sorted(found, key=lambda row: (-row[0], row[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def odd_rows():
    rng = random.Random(5)
    words = ["a", "Bc", "straße", "x" * 8, "y" * 9, "漢字かな", "漢字仮名交じり文", "z" * 16, "w" * 17, "É", "é", "v" * 40, "q" * 700, "𝔘nicode", "don't", "a1b", "﻿"]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words[: 5 + i % 13]) for _ in range(rng.randrange(12)))
        rows.append((rng.choice([text, text + ".,;7" + text]), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "", None, "Ö"])))
    rows += [(None, "xx", "only"), ("", "xx", "only"), ("word " * 200_000, "en", "s1"), ("same", "yy", "a"), ("same", "yy", "b"), ("same", "yy", "a")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"CHUNK_BYTES": 64, "BLOCK_CELLS": 4}])
def test_divergence(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(divergence, name, value)
    rows = odd_rows()
    schema = "text string, lang string, source string, term string, n int, docs int, block int, zero int, terms string"
    docs = spark.createDataFrame([row + ("t", 1, 2, 3, 4, "u") for row in rows], schema).repartition(5)
    got = sorted(map(tuple, divergence.audit(docs, 3, 4).collect()))
    assert got == plain_audit(rows, 3, 4)
    assert divergence.audit(docs.limit(0)).count() == 0
    # A language without kept terms still has its pairs.
    assert all(value == 0 for *_, value, _ in plain_audit(rows, 999, 4))
    assert sorted(map(tuple, divergence.audit(docs, 999).collect())) == plain_audit(rows, 999, 50)


def test_share_is_exact(spark):
    total = 9 * 10**15 + 7
    row = spark.range(1).select(divergence._share(divergence.F.lit(total - 3), divergence.F.lit(total)).alias("p")).first()
    assert row.p == 1 + 10**9 * (total - 3) // total


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in named[:k]]

    def assign():
        def best(v):
            return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

        return [best(v) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if mine:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    at = assign()
    inertia = Counter()
    for distance, j in at:
        inertia[j] += distance
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, at))


@pytest.mark.parametrize("scale", [1.0, 20_000.0])
def test_clusters(spark, scale):
    rng = random.Random(2)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [scale * (m + rng.gauss(0, 0.2)) for m in middles[i % 6]]) for i in range(400)]
    hot = rows[3][1]
    rows += [(None, hot)] * 150 + [(7, hot)] * 150 + [(500, None), (501, []), (502, hot[:63]), (503, hot + [1.0]), (504, hot[:63] + [None])]
    rows += [(505, hot[:63] + [math.nan]), (506, hot[:63] + [math.inf]), (507, hot[:63] + [-math.inf]), (508, [0.0] * 64), (509, [-0.001] * 64)]
    schema = "vec_id long, embedding array<double>, cells string, key int, place int, cluster int, distance int"
    table = spark.createDataFrame([row + ("c", 1, 2, 3, 4) for row in rows], schema).repartition(4)
    got = Counter(map(tuple, clusters.with_inertia(*clusters.cluster(table)).collect()))
    assert got == plain_clusters(rows)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.5] * 64), (2, [0.25] * 64), (2, [0.25] * 64), (3, [1.0])]
    got = Counter(map(tuple, clusters.with_inertia(*clusters.cluster(spark.createDataFrame(rows, schema))).collect()))
    assert got == plain_clusters(rows)
    none = spark.createDataFrame(rows[3:], schema)
    assert clusters.with_inertia(*clusters.cluster(none)).count() == 0
    assert clusters.with_inertia(*clusters.cluster(none.limit(0))).count() == 0
    with pytest.raises(ValueError):
        clusters.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema))


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = [bytes(key) for key in clusters.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_candidates_out_and_change_nothing():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-100, 100, (16, 64))
    left_out = 0
    for spread in (1, 5, 50):
        cells = centroids[rng.integers(0, 2)] + rng.integers(-spread, spread + 1, (200, 64))
        candidates, at, distance = clusters.nearest(cells, cells.min(axis=0), cells.max(axis=0), centroids)
        plain = np.square(cells[:, None] - centroids).sum(axis=2)
        assert (at == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
        left_out += 16 - len(candidates)
    assert left_out > 16


def plain_article(page):
    """The text of a page of the test tables: its one article, which holds headings, paragraphs and bold words only."""
    article = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", part)).split()) for part in re.split("</?(?:p|h1)>", article)]
    return "\n".join(block for block in blocks if block)


def test_pages_of_the_test_table(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op13_html_text(spark, small).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == {
        i: (r.url, plain_article(r.html), len(plain_article(r.html))) for i, r in pages.items()
    }


def page(i, kind):
    words = f"Story {i} begins.", f"It goes on &amp; on&nbsp; {i * 7}\n here.", "A line that many stories share."
    body = f"<h1>Title {i}</h1><p>{words[0]}<p>{words[1]}<ul><li>item {i}<li>last {i % 3}</ul>"
    if i % 2:
        body += f"<p>{words[2]}</p>"
    body += f"<p>Subscribe to <b>our</b> letter</p><aside>see also {i}</aside><form><p>mail {i}</p></form>"
    menu = f"<div class='top-menu'><a href='/{i}'>Menu {i}</a></div><header><h2>Site {i}</h2></header>"
    rest = f"<div id=commentList><p>reader {i} says</p></div><div class=\"cookie-notice\">cookies {i}</div><footer>foot {i}</footer>"
    extra = "<script>document.write('<p>no</p>')</script><style>p{}</style><!-- <p>no</p> --><div hidden>no</div><span class=ad>no <span>no</span></span>"
    if kind == "article":
        body = f"<body>{menu}<article>{body}</article>{rest}{extra}"
    elif kind == "main":
        body = f"<body>{menu}{rest}<form action=/><div><div role=main>{body}</div></div></form>{extra}</body>"
    else:
        # No marks but classes: what all pages repeat is template.
        body = f"<body>{menu}<div class=x{i}><p>All rights reserved by us</p>{body}</div>{rest}{extra}<table><tr><td>cell {i}<td>Same cell</table></body>"
    expected = [f"Title {i}", words[0], f"It goes on & on {i * 7} here.", f"item {i}", f"last {i % 3}"] + [words[2]] * (i % 2)
    if kind == "plain":
        expected += [f"cell {i}"]
    return f"<!DOCTYPE html><html><head><title>T {i}</title></head>{body}", "\n".join(expected)


@pytest.mark.parametrize("kind", ["article", "main", "plain"])
def test_template_is_left_out(spark, kind):
    made = [page(i, kind) for i in range(30)]
    rows = [(i, f"http://h.org/{i}", text, "w", "s") for i, (text, _) in enumerate(made)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string, host string")
    got = {r.page_id: r.text for r in extraction.extract(pages).collect()}
    assert got == {i: expected for i, (_, expected) in enumerate(made)}


def test_copies_and_few_pages_are_no_template(spark):
    text, expected = page(4, "article")
    expected = expected + "\nSubscribe to our letter"
    rows = [(i, "http://copies.org/", text) for i in range(40)] + [(100 + i, f"http://few{i % 5}.org/", text) for i in range(30)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 70 and {r.text for r in got} == {expected}


def test_odd_pages(spark):
    deep, wide = "<div>" * 5000 + "deep" + "</div>" * 5000, "".join(f"<p>w{i}<div>v{i}</div>" for i in range(3000))
    cases = [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt; &am &ampx", "plain <text> &am &x"),
        ("a<b>b</b>c<br>d<p>e", "abc d\ne"),
        ("<p>x < y <3 z", "x < y <3 z"),
        ("<article>a<p>b</article>c", "a\nb"),
        ("<article>one</article><div>no</div><article>two</article>", "one\ntwo"),
        ("<p title='a > b'>q</p><a href=\"", "q\n<a href=\""),
        ("<script>never closed <p>x</p>", ""),
        ("<div class='has-sidebar'><p>kept</p></div><div class=sideBar>no</div>", "kept"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        (deep, "deep"),
        (wide, "\n".join(f"w{i}\nv{i}" for i in range(3000))),
        ("<p>" + "long " * 200_000, " ".join(["long"] * 200_000)),
        ("\x00<p>nul\x00</p>", "\x00\nnul\x00"),
    ]
    rows = [(i, url, text) for i, (text, _) in enumerate(cases) for url in (None, "no scheme", f"http://h{i}.org")] + [(None, "http://h.org", "<p>id</p>")]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.url, r.text) for r in got) == Counter(
        [(i, url, expected) for i, (_, expected) in enumerate(cases) for url in (None, "no scheme", f"http://h{i}.org")] + [(None, "http://h.org", "id")]
    )
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_alignment_is_the_largest(monkeypatch):
    rng = random.Random(6)

    def tree(depth):
        return (rng.choice("abc"), [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else [])

    def shape(node, depth=0):
        return " ".join([f"{depth}:{node[0]}.0" if depth else "0:", *(shape(kid, depth + 1) for kid in node[1])])

    def best(a, b):
        """Every way to match the children of two matched nodes."""

        def rows(mine, others):
            if not mine or not others:
                return 0
            skip = max(rows(mine[1:], others), rows(mine, others[1:]))
            return max(skip, best(mine[0], others[0]) + rows(mine[1:], others[1:])) if mine[0][0] == others[0][0] else skip

        return 1 + rows(a[1], b[1])

    for _ in range(60):
        a, b = ("", tree(2)[1]), ("", tree(2)[1])
        found = dom.aligned(shape(a), shape(b))
        (labels, _, parents), (labels2, _, parents2) = dom.tree_of(shape(a)), dom.tree_of(shape(b))
        matched = [(x, y) for x, y in enumerate(found) if y >= 0]
        assert len(matched) == best(a, b)
        assert sorted(y for _, y in matched) == [y for _, y in matched]
        assert all(labels[x] == labels2[y] and (x == 0 or found[parents[x]] == parents2[y]) for x, y in matched)
