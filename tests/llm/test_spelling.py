"""Spelling variants against comparing all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.llm import spelling

SCHEMA = "doc_id long, text string, n long"


def one_edit(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    upper = {chr(c): chr(c + 32) for c in range(65, 91)}
    counts = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c in upper or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += upper.get(c, c)
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[word] += len(word) >= 7
                run = ""
    n = {w: k for w, k in counts.items() if k >= 2}
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, len(near)]

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return sorted((w, f or "", root(w), n[w], k, n[f] if f else None) for w, (f, k) in out.items())


def texts(seed):
    """Words of few syllables, so that many share halves, and misspellings of them."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(["ción", "ab", "an", "nd", "a", "×", "Ét"]) for _ in range(rng.randint(3, 7))) for _ in range(60)]
    base += [f"samehead{a}{b}{c}" for a in "abcd" for b in "abcd" for c in "abcd"] + [f"{a}{b}sametail" for a in "abcd" for b in "efgh"]
    rows = []
    for doc in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = base[int(rng.random() ** 3 * len(base))]
            if rng.random() < 0.2:
                i = rng.randint(0, len(w))
                w = rng.choice([w[:i] + rng.choice("abÿZ") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("xy") + w[i + 1 :]])
            words.append(w)
        rows.append((doc, rng.choice([" ", ". ", "_"]).join(words)))
    return [*rows, (7, None), (None, "samehead samehead samehead"), (8, ""), (9, "Āā 1 2"), (9, "Āā 1 2")]


@pytest.mark.parametrize("tile", [256, 3])
def test_variants_equal_all_pairs(spark, monkeypatch, tile):
    """Also with tiles so small that halves are cut down to single places."""
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "ROWS", 50)  # tiles go over from one batch to the next
    rows = texts(tile)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA).repartition(3)
    got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, "doc_id", "text").collect())
    want = plain(rows)
    assert got == want
    assert sum(r[1] != "" for r in want) > 20 and max(r[4] for r in want) > 8


def test_large_tiles_are_joined_by_salts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 4)
    words = spark.createDataFrame([(f"common{a}{b}", i + 2) for i, (a, b) in enumerate((a, b) for a in "abcde" for b in "vwxyz")], "word string, n long")
    want = {tuple(r) for r in spelling.near_words(words).collect()}
    monkeypatch.setattr(spelling, "MOST_BROADCAST", 0)
    assert {tuple(r) for r in spelling.near_words(words).collect()} == want
    assert {r[1] for r in want} == {8}


def test_prefix_and_suffix_find_single_edits():
    pairs = [("abcdefg", "abcdefg"), ("abcdefg", "abcdefh"), ("abcdefg", "xbcdefg"), ("abcdefg", "xbcdefh"), ("aaaaaaa", "aabaaaa")]
    for a, b in pairs:
        letters = np.array([list(a.encode()), list(b.encode())], np.uint8)
        got = spelling.near_pairs(letters, np.array([0]), np.array([1]), 7, 0, np.array([0]), np.array([8]))[0]
        assert a == b or got == one_edit(a, b)
    for a, b in [("aaaaaaa", "aaaaaaaa"), ("abcdefg", "abcdefgh"), ("abcdefg", "zabcdefg"), ("abcdefg", "abcxdefg"), ("abcdefg", "abxcdxfg")]:
        letters = np.array([[*a.encode(), 0], list(b.encode())], np.uint8)
        assert spelling.near_pairs(letters, np.array([0]), np.array([1]), 7, 1, np.array([0]), np.array([8]))[0] == one_edit(a, b)


def test_chains_lead_to_their_end(spark):
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("y", "z")], "word string, form string")
    assert dict(map(tuple, spelling.roots(forms).collect())) == {"a": "d", "b": "d", "c": "d", "x": "d", "y": "z"}


def test_odd_tables(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA), "doc_id", "text").collect() == []
    long = "abcdefghij" * 3_000
    rows = [(1, f"{long} {long[:-1]} {long}", 1), (2, f"{long} {long[:-1]}", 2), (2, f"{long} {long[:-1]}", 2)]
    got = {r["word"]: r["n_near"] for r in spelling.variants(spark.createDataFrame(rows, SCHEMA), "doc_id", "text").filter(F.length("word") > 7).collect()}
    assert got[long] >= 1 and got[long[:-1]] >= 1
