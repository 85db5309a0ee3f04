"""Phrase collocations against loops over all phrases."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from wavefold.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def texts(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None])
        words = [f"{rng.choice('abcdefgh')}{min(rng.randrange(1, 60) for _ in range(2))}" for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice([["New", "york", "City"], ["la"] * rng.randint(2, 7), ["x", "y", "z", "u", "v", "w"], ["b1", "b2"]])
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for w in words), lang))
    return rows


@pytest.mark.parametrize(("min_count", "top", "tier"), [(4, 2000, 16), (20, 3, 2)])
def test_collocations_equal_loops(spark, monkeypatch, min_count, top, tier):
    monkeypatch.setattr(collocations, "TIER", tier)
    rows = [*texts(min_count), (None, None, "en"), (1, "", None), (2, "... , ;", "de")]
    want = collocations.plain([(t, lang) for _, t, lang in rows], min_count, top)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), "text", "lang", min_count, top).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_settled_languages_are_not_expanded(spark, monkeypatch):
    """Only first words that can still reach the last place are grown."""
    monkeypatch.setattr(collocations, "TIER", 2)
    grown = []
    grow = collocations.grow
    monkeypatch.setattr(collocations, "grow", lambda *a: grown.append(1) or grow(*a))
    text = ". ".join(["rare pair"] * 5 + ["the of"] * 300 + ["so so and the of"] * 40)
    df = spark.createDataFrame([(1, text, "en")], SCHEMA)
    got = collocations.collocations(df, "text", "lang", 5, 1).collect()
    assert [tuple(r) for r in got] == collocations.plain([(text, "en")], 5, 1)
    assert len(grown) == 1


def test_scores_are_exact_beyond_64_bits():
    assert collocations.least_cut(10**12, 10**15, [(1, 10**12, 10**12), (2, 10**12 + 1, 10**12)])[0] == 1000 * 10**27 // ((10**12 + 1) * 10**12)
    assert collocations.least_cut(100, 1000, [(2, 100, 200), (1, 200, 100)]) == (5000, 200, 100)  # a tie: the first cut


def test_odd_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA), "text", "lang").collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "A b. a B", "en")], SCHEMA), "text", "lang").collect() == []
    long = "Straße a\x1cb " * 150_000  # one piece longer than a row of hashes
    odd = spark.createDataFrame([(1, long, None, "x"), (2, "straße a\x1cb", None, "y")], "rank long, phrase string, lang string, score string")
    got = [tuple(r) for r in collocations.collocations(odd, "phrase", "lang").collect()]
    assert got == collocations.plain([(long, None), ("straße a\x1cb", None)])
    assert {r[0] for r in got} == {"und"} and got[0][6] == 300_002


def test_passes_hold_little_memory(monkeypatch):
    """A pass over millions of words groups them in small steps, and keeps nothing when it ends."""
    rng, captured = np.random.default_rng(3), []
    frame = SimpleNamespace(mapInArrow=lambda run, schema: captured.append(run) or SimpleNamespace(groupBy=lambda *c: SimpleNamespace(agg=lambda *a: None)))
    frame.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))
    monkeypatch.setattr(collocations.F, "sum", lambda c: SimpleNamespace(alias=lambda n: None))
    monkeypatch.setattr(collocations.F, "min", collocations.F.sum)
    monkeypatch.setattr(collocations.F, "max", collocations.F.sum)
    every = np.full((1 << collocations.BITS) >> 3, 255, np.uint8)
    collocations.grow(frame, every, every)
    words = rng.integers(1, 1 << 62, 1 << 16)
    codes = [rng.integers(0, 1 << 16, 64_000).astype("<u2").tobytes() for _ in range(32)]
    batches = [pa.RecordBatch.from_pydict({"word_table": [words.tobytes()], "codes": [c], "width": [2]}) for c in codes]
    before, most, rows = pa.total_allocated_bytes(), 0, 0
    own = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(own)
    pa.set_memory_pool(pool)
    try:
        for batch in captured[0](iter(batches)):
            rows += len(batch)
            del batch
        most = pool.max_memory()
    finally:
        pa.set_memory_pool(own)
    assert rows > 4_000_000 and most < 100e6 and pa.total_allocated_bytes() - before < 10e6


def test_words_of_many_languages_are_bounded_together(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 1_000)
    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "lang": [f"l{i}" for i in range(50)]})
    read, most, found = collocations._read(iter([batch])), 0, {}
    for out in read:
        if read.gi_frame is not None:
            most = max(most, sum(map(len, read.gi_frame.f_locals["hashes"].values())))
        for row in out.filter(out["word"].is_valid()).to_pylist():
            found[row["lang"], row["word"]] = (row["hash"], row["n"])
    assert len(found) == 20_000 and all(n == 1 for _, n in found.values()) and most <= 2_000
    assert found["l7", "w7x3"][0] == collocations._Hashes("l7")[b"w7x3"]
