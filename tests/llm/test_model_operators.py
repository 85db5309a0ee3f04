"""Licences, pages, near-duplicates, embeddings, the classifier and the pipeline on small tables."""

import random

import numpy as np
import pytest

from wavefold.llm import components, embedding_dedup, html_extract, labelled_pages, license_scan, license_texts, order_minhash, quality_classifier
from wavefold.llm.queries import ORACLE_SQL, QUERIES


def words(rng, n):
    return [rng.choice("abcdefghij") + rng.choice("aeiou") + rng.choice("klmnoprst") + rng.choice("aeiou") for _ in range(n)]


def test_licences(spark):
    rng = random.Random(1)
    filler = " ".join(words(rng, 200))
    rows = [(k, f"{filler}\n{text} {filler}") for k, text in enumerate(license_texts.TEXTS.values())]
    rows += [(100, None), (101, ""), (102, "The driver lost a licence and the copyright of a song."), (103, filler + " Licensed under the Apache License, Version 1.1. " + filler), (104, "Released under the MIT License. " * 3)]
    got: dict = {}
    for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, (name, wording) in enumerate(license_texts.TEXTS):
        assert [(r["license"], r["wording"], r["n_differences"]) for r in got[k]] == [(name, wording, 0)]
        text = rows[k][1][got[k][0]["start"] : got[k][0]["end"]]
        assert text == license_texts.TEXTS[name, wording].rstrip(".") or wording != "statement"
    assert not {100, 101, 102} & set(got)
    assert got[103][0]["differences"] == ["-2.0 +1.1"]
    assert len(got[104]) == 3


def real_texts(characters):
    """English texts of the test data without a licence word, cut to so many characters."""
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    return [r["text"][:characters] for r in rows if r["lang"] == "en" and len(r["text"] or "") > characters and not license_scan.ANCHOR.search(r["text"])]


@pytest.mark.parametrize("characters", [1600, 3000, 4500])
def test_licences_in_long_blocks_of_real_text(characters):
    texts = real_texts(characters)[:15]
    assert len(texts) == 15
    for k, (name, wording) in enumerate(license_texts.TEXTS):
        for x in texts:
            parts = [x[i : i + 1000] for i in range(0, len(x), 1000)]
            middle = len(parts) // 2
            text = " copyright ".join([*parts[:middle], license_texts.TEXTS[name, wording], *parts[middle:]])
            assert len(license_scan.blocks(text)) == 1
            assert [(r["license"], r["wording"], r["n_differences"]) for r in license_scan.scan(text)] == [(name, wording, 0)], (k, text)


def test_sentences_that_name_no_licence():
    for text in (
        "The patent was licensed under an agreement with MIT in 1999.", "He was released under bail by MIT police near the license office.", "The course is available under a grant from MIT.",
        "The single was released under the label GPLv3 records, whose license expired.", "Distributed under a deal between Apache and the state; the license was lost.",
    ):
        assert license_scan.scan(text) == [], text


def test_short_statements():
    for text, licence in {"This software is under the MIT license.": "MIT", "License: MIT": "MIT", "MIT licensed": "MIT", "Code is under Apache-2.0": "Apache-2.0", "Published under CC BY 4.0": "CC-BY-4.0", "released under the terms of the MIT License": "MIT"}.items():
        assert [r["license"] for r in license_scan.scan("Some words before it. " + text + " and some behind it.")] == [licence], text


def test_licences_in_a_notice_file():
    rng = random.Random(4)
    want, parts = [], []
    while sum(map(len, parts)) < 30_000:
        key = rng.choice(sorted(license_texts.TEXTS))
        want.append(key)
        parts += [f"{' '.join(words(rng, rng.randint(3, 30)))}. Copyright {rng.randint(1990, 2020)} {' '.join(words(rng, 2))}.", license_texts.TEXTS[key]]
    text = "\n".join(parts)
    assert len(license_scan.blocks(text)) == 1
    got = license_scan.scan(text)
    assert [(r["license"], r["wording"]) for r in got] == want
    assert all(a["end"] <= b["start"] for a, b in zip(got, got[1:]))


#: Wordings that the pack doesn't have as they are, what they say, and whether words differ.
REWORDED = [
    ("This project is licensed under the MIT License", "MIT", False), ("Licensed under the MIT license.", "MIT", False), ("# SPDX-License-Identifier: MIT", "MIT", False), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0", False),
    ("Released under the BSD 3-Clause License.", "BSD-3-Clause", False), ("This dataset is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0", False),
    ("This library is distributed under the terms of the GNU Lesser General Public License v2.1.", "LGPL-2.1", True), ("The code is available under the Apache 2.0 license, see LICENSE", "Apache-2.0", False), ("It was released under the terms of the Boost Software License, Version 1.0", "BSL-1.0", True),
    ("You may use it as it is licensed under the Mozilla Public License 2.0 by its owner", "MPL-2.0", False), ("licensed under CC BY-SA 3.0", "CC-BY-SA-3.0", False),
]


def test_reworded_licences():
    rng = random.Random(9)
    for text, licence, differs in REWORDED:
        for around in ("", " ".join(words(rng, 150))):
            got = license_scan.scan(f"{around}\n{text}\n{around}")
            assert [(r["license"], r["n_differences"] > 0) for r in got] == [(licence, differs)], (text, got)


def best_share(wording, words):
    """The most of a wording's words, in order, less words put between them, in any stretch of its length and the slack: by alignment, without anchors, blocks or compression."""
    slack = max(2, len(wording) // 5)
    best = 0
    for low in range(max(1, len(words) - len(wording) + slack)):
        part = words[low : low + len(wording) + 2 * slack]
        row = [0] * (len(part) + 1)  # what is left out before the first word costs nothing
        for w in wording:
            diagonal, row[0] = row[0], 0
            for j, x in enumerate(part, 1):
                put_in = row[j - 1] - (x not in license_scan.NEUTRAL)
                diagonal, row[j] = row[j], max(diagonal + (x == w or w == "_"), row[j], put_in)
        best = max(best, *row)
    return best / len(wording)


def test_findings_equal_direct_alignment():
    """A text has a finding if and only if some wording aligns with it well enough, whatever way it is sought."""
    rng = random.Random(10)
    pack = license_scan._pack()
    chosen = rng.sample(pack.templates, 12)
    chosen += [t for t in pack.templates if 20 < len(t.words) < 45][:6]
    for t in chosen:
        for edits in (0, 1, 2, len(t.words) // 8, len(t.words) // 5, len(t.words) // 3):
            said = list(t.words)
            for k in rng.sample(range(len(said)), min(edits, len(said))):
                said[k] = rng.choice(["altered", said[k] + " more", ""])
            text = f"{' '.join(words(rng, 30))} licence {' '.join(said)} {' '.join(words(rng, 30))}"
            seen = [w.lower() for w in license_scan._WORD.findall(text)]
            near = [x for x in pack.templates if len(set(x.words) & set(seen)) >= 0.6 * len(set(x.words))]
            best = max((best_share(x.words, seen) for x in near), default=0)
            got = license_scan.scan(text)
            assert bool(got) == (best >= license_scan.MIN_FOUND), (t.key, text, got, best)


def test_repeated_statements_take_time_in_proportion():
    import time

    took = []
    for n in (400, 1600):
        began = time.perf_counter()
        assert len(license_scan.scan("Released under the MIT License. " * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_licence_rows_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "x", 5), (1, "Released under the MIT License.", "x", 5), (None, "SPDX-License-Identifier: ISC", None, None), (3, None, None, 1)], "doc_id long, text string, license string, `end` int")
    got = license_scan.scan_licenses(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, r["license"]) for r in got) == [(0, "ISC"), (1, "MIT"), (1, "MIT")]
    assert license_scan.scan_licenses(df.limit(0), "doc_id", "text").count() == 0


def test_a_licence_excerpt_does_not_hide_an_edited_copy():
    template = license_texts.TEXTS["MIT", "text"]
    edited = template.split()
    for k in range(6, len(edited), 12):
        edited[k] = "altered"
    excerpt = " ".join(template.split()[:50])
    text = f"{excerpt} {' '.join(words(random.Random(6), 120))} {' '.join(edited)}"
    assert len(license_scan.blocks(text)) == 1
    got = license_scan.scan(text)
    assert [(r["license"], r["wording"], text[r["start"] : r["end"]]) for r in got] == [("MIT", "text", " ".join(edited).rstrip("."))]


def test_sum_product_equals_enumeration():
    page = html_extract.parse("<body><div>a<p>b</p></div><ul><li>c</ul></body>")
    f = html_extract.forest([page], {})
    rng = np.random.default_rng(2)
    n = len(f.parent)
    own, edge = rng.normal(size=n), rng.normal(size=(2, 2, 2))
    total, each = 0.0, np.zeros(n)
    for state in range(2**n):
        y = np.array([state >> i & 1 for i in range(n)])
        weight = np.exp(own @ y + sum(edge[int(f.leaf[i]), y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        total, each = total + weight, each + weight * y
    assert np.allclose(html_extract.sum_product(f, own, edge)[0], each / total)


def test_labelled_pages_held_out():
    model = html_extract.trained()
    held = [html_extract.parse(s) for s in labelled_pages.labelled_pages(200, seed=77)]
    f, p = model.marginals(held)
    truth = np.concatenate([html_extract._labels(x) for x in held])
    assert ((p > 0.5) == truth)[f.leaf].mean() > 0.96


HELD_OUT = {  # layouts that the generator doesn't make, and their main text
    '<body><nav><a href=x>Home</a></nav><article><h1>Title here</h1><p>First paragraph of the story goes on for a while.</p><p>Second paragraph of the story with more words.</p><div class="responses"><p>I liked this one a lot.</p><p>Me too, thanks for writing it.</p></div></article><ul class="discussion"><li>What a bad article this was.</li><li>Not at all, I disagree with you.</li></ul><footer>Copyright us</footer></body>': "Title here\nFirst paragraph of the story goes on for a while.\nSecond paragraph of the story with more words.",
    '<body><div id="wrap"><div id="leftcol"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div id="story"><h2>A headline</h2><p>Some text of the article is here, and it is rather long so that it counts.</p><p>More text of the article follows here, with a <a href=z>link</a> in it.</p><div class="reader-mail"><h4>Letters</h4><div class="letter"><b>Bob</b><p>Hello there.</p></div><div class="letter"><b>Ann</b><p>Nice.</p></div></div></div><div id="foot">Contact us at the office.</div></div></body>': "A headline\nSome text of the article is here, and it is rather long so that it counts.\nMore text of the article follows here, with a link in it.",
    '<main><h1>Real title</h1><p>Short.</p><p>Also quite short text.</p><figure><img src=a><figcaption>A caption.</figcaption></figure><p>The last one.</p></main><section class="user-feedback"><article><h4>Joe</h4><p>I think that this is wrong.</p></article><article><h4>Sue</h4><p>I think that is right.</p></article></section><div class="cookie-bar">We use cookies. <button>OK</button></div>': "Real title\nShort.\nAlso quite short text.\nA caption.\nThe last one.",
    '<body><div class="ad" title="a>b">Buy</div><article><h1>T &lt; x</h1><p>One two three four five six seven.</p><svg/><p>After the picture text goes on here.</p></article></body>': "T < x\nOne two three four five six seven.\nAfter the picture text goes on here.",
    "Just some text without tags at all, which is all there is.": "Just some text without tags at all, which is all there is.",
}


def test_whole_layouts_held_out():
    assert html_extract.main_texts(list(HELD_OUT), html_extract.trained()) == list(HELD_OUT.values())


def bare_pages(n):
    """Articles that stand in their container itself, of n words or twice as many."""
    rng = random.Random(n)
    a, b = (" ".join(rng.choice(labelled_pages.WORDS) for _ in range(n)).capitalize() + "." for _ in range(2))
    return {
        f"<div id='main'>{a}</div><div id='foot'>About us</div>": a,
        f"<nav><a href=1>Home</a> <a href=2>News</a></nav><div class='content'>{a}<br><br>{b}</div><footer>About us 2020</footer>": f"{a} {b}",
        f"<div class='text'><h1>Storm</h1>{a}<br>{b}</div><div class='side'><a href=1>More</a> <a href=2>Other</a></div>": f"Storm\n{a} {b}",
        f"<div id=a><div id=b>{a}<br><br>{b}</div></div><div id=c>Contact us</div>": f"{a} {b}",
        f"<table><tr><td><a href=1>Home</a> <a href=2>News</a></td><td>{a}<p>{b}</p></td></tr></table>": f"{a}\n{b}",
        f"<body><div id=x>{a}</div></body>": a,
        f"<div class='menu'><a href=1>A</a></div><div class='box'><div class='post'>{a}<br>{b}</div><div class='comments'><p>I liked it very much, thanks.</p></div></div>": f"{a} {b}",
    }


@pytest.mark.parametrize("n", [20, 40, 120, 400])
def test_articles_of_bare_text(n):
    pages = bare_pages(n)
    assert html_extract.main_texts(list(pages), html_extract.trained()) == list(pages.values())


def test_families_of_layouts_held_out(monkeypatch):
    """Trained without containers but tables and articles for bare text, and without line breaks in it, the model still finds those."""
    monkeypatch.setattr(labelled_pages, "BARE_MAIN", tuple(x for x in labelled_pages.BARE_MAIN if "<table" in x or "<article" in x))
    monkeypatch.setattr(labelled_pages, "BARE", tuple(x for x in labelled_pages.BARE if "<br" not in x))
    model = html_extract.train(list(labelled_pages.labelled_pages()))
    pages = bare_pages(60)
    got = html_extract.main_texts(list(pages), model)
    assert all(got) and np.mean([g == w for g, w in zip(got, pages.values(), strict=True)]) > 0.7


def test_a_block_of_words_is_never_lost():
    model = html_extract.trained()
    rng = random.Random(8)
    for _ in range(200):
        text = " ".join(rng.choice(labelled_pages.WORDS) for _ in range(rng.randint(20, 60)))
        page = text
        for _ in range(rng.randint(0, 4)):
            tag, name = rng.choice(["div", "section", "td", "span", "p"]), rng.choice(labelled_pages.PLAIN)
            page = f"<{tag} class={name}>{page}</{tag}>" + rng.choice(["", "<div>Short end</div>", "<ul><li><a href=x>Link</a></li></ul>"])
        assert text in html_extract.main_texts([page], model)[0]
    assert html_extract.main_texts(["<form><button>" + "word " * 30 + "</button></form>", "<nav><a href=x>" + "word " * 30 + "</a></nav>"], model) == ["", ""]


def test_hostile_pages_take_time_in_proportion():
    import time

    for junk in ('<a "', '<a x="', "<!--", "<script>", "</p>", "<td>", "<a b='\"", "<", "&", "<div>", "<ul><li>"):
        began = time.perf_counter()
        html_extract.parse(junk * (1_000_000 // len(junk)))
        assert time.perf_counter() - began < 8, junk


def test_pages_of_the_table_equal_a_plain_extraction(spark):
    import html
    import re

    def plain(page):
        found = re.search(r"<article>(.*?)</article>", page or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", found[1]) if found else []
        texts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
        return "\n".join(x for x in texts if x)

    folder = "/root/testdata/sf0.01"
    want = {r["page_id"]: plain(r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in QUERIES["op2_html_extract"](spark, folder).collect()}
    assert got == want


def test_pages(spark):
    model = html_extract.trained()
    page = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">x</a></li></ul></nav><div class="ad">Buy this now, it is cheap.</div><article><h1>Some  title</h1><p>One &amp; two<br>three<p>Four <b>five\n six</b>.</article><footer>&copy; All.</footer><script>var t="</p>";</script></body></html>'
    rows = [(1, page), (2, None), (3, ""), (4, "<p"), (5, "<<>&amp;"), (1, page)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, html string"), "html", ["page_id"], model).collect()
    assert got[0]["text"] == got[5]["text"] == "Some title\nOne & two three\nFour five six." and got[0]["n_chars"] == len(got[0]["text"])
    assert [r["text"] for r in got[1:3]] == ["", ""]
    clash = spark.createDataFrame([(None, page, 7, "x")], "page_id long, html string, n_chars int, text string")
    once = html_extract.extract(clash, "html", ["page_id", "n_chars", "text"], model)
    assert once.columns == ["page_id", "text", "n_chars"] and once.collect()[0]["text"] == got[0]["text"]
    assert html_extract.extract(clash.limit(0), "html", ["page_id"], model).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(None, 3), (7, 7)]
    parent = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {x: got.get(x, x) for x in parent} == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def near_corpus():
    rng = random.Random(4)
    rows = []
    for g in range(25):
        base = words(rng, rng.randint(3, 300))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, max(1, len(base) // 40)])):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            rows.append((len(rows), " ".join(copy)))
    hub = words(rng, 146)
    for _ in range(60):  # copies of one text, most of them near it but not near one another
        copy = list(hub)
        for _ in range(4):
            copy[rng.randrange(len(copy))] = words(rng, 1)[0]
        rows.append((len(rows), " ".join(copy)))
    rows.append((len(rows), " ".join(hub)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "."), (None, "no id")]


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_corpus()
    mers = {i: order_minhash.kmers(order_minhash.word_hashes(t or "")) for i, t in rows if i is not None}
    parent = {i: i for i in mers}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in mers:
        for b in mers:
            if a < b and order_minhash.similarity(mers[a], mers[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = {r["doc_id"]: r for r in order_minhash.near_duplicates(df, "doc_id", "text").collect()}
    assert {i: got[i]["class_id"] for i in mers} == {i: find(i) for i in mers}
    assert all(got[i]["kept"] == (find(i) == i) for i in mers) and got[None]["kept"] and got[None]["class_id"] is None
    assert order_minhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_similarity_is_ordered():
    rng = random.Random(5)
    a = words(rng, 80)
    mers = [order_minhash.kmers(order_minhash.word_hashes(" ".join(x))) for x in (a, a[40:] + a[:40], [*a[:20], "x", *a[20:]])]
    assert order_minhash.similarity(mers[0], mers[0]) == 1 and order_minhash.similarity(mers[0], mers[1], 0.01) < 0.6 < order_minhash.similarity(mers[0], mers[2], 0.01)


def test_profiles_bound_what_is_shared():
    rng = random.Random(5)
    a = words(rng, 80)
    mers = [order_minhash.kmers(order_minhash.word_hashes(" ".join(x))) for x in (a, a[40:] + a[:40], [*a[:20], "x", *a[20:]], words(rng, 70))]
    counts = [np.frombuffer(order_minhash.profile(m), "<u2") for m in mers]
    for i, x in enumerate(mers):
        for j, y in enumerate(mers):
            assert np.minimum(counts[i], counts[j]).sum() >= len(np.intersect1d(x, y))


def test_pages_of_one_template_meet_no_one(spark, monkeypatch):
    """Texts that share three quarters of their words are in common buckets, but hardly a pair of them becomes a row; two that differ by a word still link."""
    rng = random.Random(7)
    template = words(rng, 180)
    rows = [(i, " ".join(template + words(rng, 60))) for i in range(150)]
    rows.append((150, rows[3][1] + " more"))
    compared = []
    verified = order_minhash._verified

    def counted(pairs, texts, threshold):
        compared.append(pairs.count())
        return verified(pairs, texts, threshold)

    monkeypatch.setattr(order_minhash, "_verified", counted)
    got = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, kept string"), "id", "text").collect()}
    assert got == {i: 3 if i == 150 else i for i in range(151)}
    assert compared[0] <= 151 and sum(compared[1:]) < 60


@pytest.mark.parametrize(("families", "most", "limits"), [(120, 0, {}), (2, 0, {}), (2, 2_000, {"OUTSIDE": 16, "ALL": 32, "OUTSIDE_MERS": 1_500, "ALL_MERS": 4_000})])
def test_near_copies_make_few_rows(spark, monkeypatch, families, most, limits):
    """Texts of one template just below the threshold, and families of them that link: no row for each pair, and classes are those of all pairs."""
    for name, value in limits.items():
        monkeypatch.setattr(order_minhash, name, value)
    rng = random.Random(9)
    base = words(rng, 132)
    rows = [(i, " ".join([*base, *(f"t{i % families}x{k}" for k in range(16)), f"o{i}", f"p{i}"])) for i in range(120)]
    made, in_blocks = [], order_minhash._in_blocks

    def counted(mixed, classes, texts, threshold):
        links = in_blocks(mixed, classes, texts, threshold)
        made.append(links.count())
        return links

    monkeypatch.setattr(order_minhash, "_in_blocks", counted)
    if limits:
        monkeypatch.setattr(order_minhash, "_verified", lambda pairs, texts, threshold: pairs.limit(0))  # all links are left to the blocks
    got = {r["id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    mers = [order_minhash.kmers(order_minhash.word_hashes(t)) for _, t in rows]
    kept = [set(order_minhash.sketches(m).tolist()) for m in mers]
    want = list(range(120))
    for a in range(120):
        for b in range(a):
            if want[a] != want[b] and kept[a] & kept[b] and order_minhash.similarity(mers[a], mers[b]) >= 0.8:
                want = [min(want[a], want[b]) if c in (want[a], want[b]) else c for c in want]
    assert got == dict(enumerate(want))
    assert len(set(want)) == families and made and made[0] <= most


def test_near_duplicates_of_repeated_ids_and_long_texts(spark):
    rng = random.Random(8)
    long = words(rng, 60_000)
    a, b = " ".join(words(rng, 60)), " ".join(words(rng, 60))
    rows = [(5, a), (5, b), (5, a), (7, b + " x"), (9, a), (None, a), (None, a), (20, " ".join(long)), (21, " ".join([*long[:100], "x", *long[100:]])), (30, None), (31, "")]
    got = sorted((r["id"] or 0, r["class_id"] or 0, r["kept"]) for r in order_minhash.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], "id int, text string, tag int, salt int"), "id", "text").collect())
    assert got == sorted([(5, 5, True)] * 3 + [(7, 5, False), (9, 5, False), (0, 0, True), (0, 0, True), (20, 20, True), (21, 20, False), (30, 30, True), (31, 30, False)])


@pytest.mark.parametrize("dim", [1, 16])
def test_embeddings_equal_all_pairs(spark, dim):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, dim))
    for i in range(1, 120):
        x[i] = x[rng.integers(0, i)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.1])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [0.0] * dim), (902, [float("nan")] + [1.0] * (dim - 1)), (903, [None] + [1.0] * (dim - 1)), (904, [float("inf")] + [1.0] * (dim - 1)), (905, [])]
    got = {r["vec_id"]: r for r in embedding_dedup.link(spark.createDataFrame(rows + bad + [(None, rows[0][1])], "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(300)
    for _ in range(300):
        label = np.minimum(label, np.where(link, label[None, :], 999).min(axis=1))
    assert np.mean([got[i]["n_links"] == link[i].sum() for i in range(300)]) > 0.98
    assert np.mean([got[i]["component_id"] == label[i] for i in range(300)]) > 0.98
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in bad)


def test_one_longer_embedding_parts_no_others(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.01]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0, 0.0]), (6, [2.0, 0.1, 0.0, 0.0])]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_visits_reach_the_target_recall():
    """Neighbours at exactly the threshold are found in the visited cells with the stated probability."""
    rng = np.random.default_rng(7)
    x = embedding_dedup._unit(rng.normal(size=(6000, 32)))
    books = embedding_dedup.fit_codes(x[:, :16], 16), embedding_dedup.fit_codes(x[:, 16:], 16)
    bound = embedding_dedup.stop_bound(x[:2000], books, 0.9, 0.99)
    again = x[2000:4000]
    noise = rng.normal(size=again.shape)
    noise = embedding_dedup._unit(noise - (noise * again).sum(axis=1, keepdims=True) * again)
    first, second, _ = embedding_dedup.own_cells(0.9 * again + np.sqrt(0.19) * noise, books)
    query, centroid, depth, order = embedding_dedup.staircase(embedding_dedup._square_distances(again[:, :16], books[0]), embedding_dedup._square_distances(again[:, 16:], books[1]), bound)
    visited = {(q, c, s) for q, c, d in zip(query, centroid, depth, strict=True) for s in order[q, :d]}
    assert np.mean([(k, first[k], second[k]) in visited for k in range(2000)]) > 0.97 and len(visited) < 2000 * 200


def test_the_staircase_is_what_the_multi_sequence_visits():
    rng = np.random.default_rng(8)
    first, second = rng.random((40, 7)), rng.random((40, 9))
    query, centroid, depth, order = embedding_dedup.staircase(first, second, 0.4)
    for k in range(40):
        visits = list(embedding_dedup.multi_sequence(first[k], second[k]))
        assert len(visits) == 63 and all(x[0] <= y[0] for x, y in zip(visits, visits[1:], strict=False))
        stopped = {(a, b) for d, a, b in visits if d <= visits[0][0] + 0.4}
        assert {(c, s) for q, c, d in zip(query, centroid, depth, strict=True) if q == k for s in order[k, :d]} == stopped


def test_embeddings_of_extreme_size_and_repeated_ids(spark):
    tiny, huge = [1e-200, 2e-200], [1e200, 2.0001e200]
    rows = [(0, tiny), (1, huge), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, -1.0]), (4, [5e-324, 1e-323])]
    got = {(r["id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link(spark.createDataFrame(rows, "id long, v array<double>").selectExpr("*", "1 AS rep", "'x' AS vector"), "id", "v").collect()}
    assert got == {(0, 4, 0, True), (1, 4, 0, False), (2, 4, 0, False), (3, 0, 3, True), (4, 4, 0, False)}
    assert embedding_dedup.link(spark.createDataFrame([], "id long, v array<float>"), "id", "v").count() == 0


def test_recall_of_the_index_at_production_settings(spark):
    """All rows of the test table, with close companions, beyond the number where all cells are visited."""
    import pyarrow.parquet as pq

    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["embedding"]).column(0).to_pylist(), dtype=np.float32)
    rng = np.random.default_rng(9)
    noise = rng.normal(size=x.shape)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit + noise / np.linalg.norm(noise, axis=1, keepdims=True) * rng.uniform(0.2, 0.48, (len(x), 1))
    x = np.concatenate([x, near.astype(np.float32)])
    got = {r["id"]: r for r in embedding_dedup.link(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<float>"), "id", "v").collect()}
    unit = embedding_dedup._unit(x)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    assert link.sum() > 3000
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in got)


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        text = words(rng, rng.randint(20, 120))
        kind = rng.choice([0, 1, 2, 2])
        if kind == 0:
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["nastya", "nastyb", "vileness"])
        if kind == 1:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind != 1), int(kind == 0)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").selectExpr("*", "'x' AS kept")
    table = spark.createDataFrame([*labels[:300], (3, None, 0), (4, 1, None), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    grade = quality_classifier.grade(F.col("quality"), F.col("toxic"))
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, "text", quality_classifier.train(docs, table, "doc_id", "text", grade)).collect()}
    truth = {i: 0 if t else 1 + q for i, q, t in labels[300:]}
    assert np.mean([got[i]["kept"] == (g == 2) for i, g in truth.items()]) > 0.95
    mean = [np.mean([got[i]["expected_grade"] for i, g in truth.items() if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and got[900]["kept"] is not None
    nothing = quality_classifier.train(docs, table.limit(0), "doc_id", "text", grade)
    assert quality_classifier.score(docs, "text", nothing).filter("kept").count() == 602


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(12)
    row = np.repeat(np.arange(40), 6)
    column, grades = rng.integers(0, 15, len(row)), rng.integers(0, 4, 40)
    x = np.concatenate([rng.normal(size=15), [-1.0], rng.normal(size=2)])
    value, g = quality_classifier.loss(x, row, column, grades, 4, 0.01)
    cuts = np.array([-60, x[15], x[15] + np.exp(x[16]), x[15] + np.exp(x[16]) + np.exp(x[17]), 60])
    plain = 0.0
    for k in range(40):
        score = sum(x[c] for r, c in zip(row, column, strict=True) if r == k)
        below = lambda t: 1 / (1 + np.exp(-(t - score)))
        plain -= np.log(below(cuts[grades[k] + 1]) - below(cuts[grades[k]])) / 40
    assert value == pytest.approx(plain + 0.005 * (x[:15] ** 2).sum())
    for k in range(len(x)):
        step = np.zeros(len(x))
        step[k] = 1e-6
        slope = (quality_classifier.loss(x + step, row, column, grades, 4, 0.01)[0] - quality_classifier.loss(x - step, row, column, grades, 4, 0.01)[0]) / 2e-6
        assert g[k] == pytest.approx(slope, abs=1e-6)


def test_features_by_a_plain_version():
    import xxhash

    text = "The cat, the CAT!! sat 12| Ünder the-mat."
    mask = (1 << quality_classifier.BITS) - 1
    words = {b"the", b"cat", b"sat", b"12", b"mat", b"!!", "Ü".encode() + b"nder"}  # bytes beyond ASCII keep their case
    parts = words | {b"<" + w[:k] for w in words for k in (4, 5, 6)}
    own = set(quality_classifier.features(text).tolist())
    assert {xxhash.xxh3_64_intdigest(w) & mask for w in parts} <= own
    assert len(own) <= len(parts) + 9 * quality_classifier.SHAPE_COPIES


def test_classifier_on_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([], "doc_id long, text string, p_low string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels, "doc_id", "text", quality_classifier.grade(F.col("quality"), F.col("toxic")))
    assert quality_classifier.score(docs, "text", model).count() == 0 and not model.weights.any()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}'")
    ours, theirs = QUERIES[name](spark, folder).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (ours, theirs))
    assert a.equals(b)


def test_pipeline_does_its_stages(spark):
    import corpus_pipeline
    from wavefold.llm.common import table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    kept, ids = docs, [set(r[0] for r in docs.select("doc_id").collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder).cache()
        assert kept.columns == docs.columns
        ids.append({r[0] for r in kept.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    assert ids[2] == ids[3] and len(ids[4]) < len(ids[0])
    packed = corpus_pipeline.run(spark, folder)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids[4]


def test_pipeline_with_null_and_repeated_ids(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F
    from wavefold.llm.common import table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    good = corpus_pipeline.rules(spark, docs, folder).filter("length(text) > 500 and lang = 'en'").limit(12).collect()
    junk = "word 12 ## " * 200
    rows = [(None, *r[1:]) for r in good[:5]] + [(None, junk, "en", "s", 1), (None, None, None, None, None)]
    rows += [(7, *r[1:]) for r in good[5:7]] + [(7, junk, "en", "s", 1), (8, *good[7][1:])]
    mixed = docs.filter("doc_id > 1000000").unionByName(spark.createDataFrame(rows, docs.schema)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    count = lambda df: sorted((r["doc_id"], r["text"][:200]) for r in df.filter("doc_id IS NULL OR doc_id < 10").select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").collect())
    passed = corpus_pipeline.rules(spark, mixed, folder)
    assert passed.schema.simpleString() == docs.schema.simpleString()
    assert count(passed) == sorted([(-1, r["text"][:200]) for r in good[:5]] + [(7, r["text"][:200]) for r in good[5:7]] + [(8, good[7]["text"][:200])])
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))).cache()
    near = corpus_pipeline.near(spark, nameless, folder)
    assert near.columns == docs.columns
    assert near.filter("doc_id IS NULL").count() == nameless.filter("doc_id IS NULL").count() > 0
    assert near.filter("doc_id IS NOT NULL").count() < nameless.filter("doc_id IS NOT NULL").count()


def test_pipeline_by_brute_force(spark):
    """Every stage of the whole pipeline against loops over all documents and all pairs of them; the classifier's weights are the fit's own."""
    import zlib

    import corpus_pipeline
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from tests.llm.test_text_operators import brute_lines, plain_verdicts
    from wavefold.llm.common import table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    model = quality_classifier.train(docs, table(spark, folder, "labels"), "doc_id", "text", quality_classifier.grade(F.col("quality"), F.col("toxic")))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    good = lambda t: 1 / (1 + np.exp(model.thresholds[-1] - sum(model.weights[k] for k in quality_classifier.features(t or "")))) >= 0.5
    rows = [r for r in rows if good(r[1])]
    passed = plain_verdicts(rows)
    rows = [r for r in rows if passed[r[0]]]
    texts = {i: t for i, (t, _, _) in brute_lines([r[:2] for r in rows]).items()}
    mers = {i: order_minhash.kmers(order_minhash.word_hashes(t)) for i, t in texts.items()}
    classes = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and classes[a] != classes[b] and order_minhash.similarity(mers[a], mers[b]) >= 0.8:
                x, y = classes[a], classes[b]
                classes = {i: min(x, y) if c in (x, y) else c for i, c in classes.items()}
    kept = {i: texts[i] for i in texts if classes[i] == i}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in kept.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        want |= {(i, k // 2048, k, tuple(ids[k : k + 2048])) for k in range(0, len(ids), 2048)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got} == want and len(got) == len(want)
    assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)


def test_pipeline_stages_on_odd_tables(spark):
    """Empty tables, columns named as results are, nulls in every column and repeated rows."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    from wavefold.llm.common import table

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    names = ["kept", "p_low", "expected_grade", "n_lines", "n_dropped", "class_id", "n_words", "language", "id", "t", "h1", "tag", "shard", "salt"]
    odd = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    nothing = spark.range(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema))
    odd = odd.union(odd.filter("doc_id % 7 = 0")).union(nothing)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder).cache()
        assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema], name
        assert out.filter("doc_id IS NOT NULL AND (" + " OR ".join(f"{c} <> concat('{c}', doc_id)" for c in names) + ")").count() == 0
        n = out.count()
        assert {"line dedup": n == odd.count(), "near-dedup": 3 < n < docs.count()}.get(name, n > 0), name
        assert stage(spark, odd.limit(0), folder).count() == 0
    assert corpus_pipeline.pack(spark, odd, folder).filter("doc_id IS NULL").count() == 3
    assert corpus_pipeline.pack(spark, odd.limit(0), folder).count() == 0


def test_pipeline_hands_workers_small_batches(spark):
    """After each stage began, a partition of 24 MB reaches a Python worker in batches of a few MB, and whole; a batch ends with the row that reaches the bound."""
    import corpus_pipeline
    import pyarrow as pa
    from pyspark.sql import functions as F
    from wavefold.llm.common import table

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes - len(b.column(1)[b.num_rows - 1].as_py())])], ["n", "bytes"])

    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    texts = spark.range(0, 6001, 1, 1).select("id", F.when(F.col("id") == 6000, F.repeat(F.lit("x"), 6 << 20)).otherwise(F.repeat(F.lit("abcd"), 1000)).alias("text"))
    before = spark.conf.get(corpus_pipeline.BATCH_SETTING)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(corpus_pipeline.BATCH_SETTING, before)
            out = stage(spark, docs.limit(40), folder)
            seen = texts.mapInArrow(sizes, "n bigint, bytes bigint").collect()
            assert sum(r["n"] for r in seen) == 6001, name
            assert max(r["bytes"] for r in seen) < 1.1 * corpus_pipeline.BATCH_BYTES, (name, max(r["bytes"] for r in seen))
            assert out.count() > 0, name
    finally:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, before)
