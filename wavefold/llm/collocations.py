"""Phrase collocations by best-first branch-and-bound growth of prefixes.

Texts, A-Z in lower case, are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and those into words `[^\\x20\\x09]+`. Counts
are those of a language: n of all its words, f(phrase) of all contiguous places within pieces, overlaps
included. Phrases of 2 to 5 words with a = f(phrase) >= MIN_COUNT are candidates. A cut after the first k words
gives floor(1000 a n / (l r)) with the counts l and r of the two parts; the least over all cuts is the score, of the
smallest k among equals. A candidate goes if one longer candidate that holds it has the same count, which is so
if all its places have the same word before or behind them.

Growth. A phrase is no more frequent than its rest, so its score is at most 1000 n / f(first word), whatever it
grows to: the first word's count bounds the whole branch. Words are expanded in the order of this bound, tier by
tier (counts up to 16, 256, ... times MIN_COUNT), into all frequent phrases that start with them. A language is
settled when its 2000th surviving score is above the bound of all words not yet expanded, so that not even a tie
is left there, or when there are none; settled languages expand no further.

Spark's part. One pass turns texts into rows of 64,000 word hashes (a table of the row's distinct hashes and a code a word)
and counts words; a second counts pairs of frequent words by 32 bits of their hashes, so that only pairs that may be frequent are looked at. Each
tier then takes one pass for the places where it starts, as long as all pairs of neighbours may be frequent, and one for rests that start
elsewhere, where their counts are not known yet. Tasks add up before each shuffle. What a pass looks up are bit tables of fixed
size (BITS), which can only let too much through: the counts themselves are grouped by the words' hashes,
exactly. Two words with one 64-bit hash would be an error that stops the job, not a wrong count. Nothing passes
through the driver but bit tables (8 MB each) and whether a language is still open.

Defined results: a null text is empty, a null language `und`; repeated rows count each time; an empty table, or
one without frequent phrases, has no rows. Long texts are counted whole. Other columns are not read, so no name
clashes; the result's names are its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavefold.llm.common import materialise, text_or_empty

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: Counts of the first words of a tier go up to so many times those of the last one.
TIER = 16
#: Bits of a lookup table, as a power of 2, and of the part of it that one row holds.
BITS, PART = 26, 16
#: Words to a row of hashes, to a step of a pass, and distinct words held before their counts are passed on.
ROW, STEP, HELD = 64_000, 250_000, 200_000
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
_ENDS = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
_NAMES = ["n", "left_min", "left_max", "right_min", "right_max"]


def split_words(text: str) -> list[bytes]:
    """The words of a text in lower case, with a line feed for each end of a piece."""
    return [w for w in text.encode("utf-8").lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ") if w]


class _Hashes(dict):
    """Hash of each word of one language; never 0, which stands for an end."""

    def __init__(self, lang: str):
        super().__init__({b"\n": 0})
        self.lang = lang.encode("utf-8") + b"\0"

    def __missing__(self, word: bytes) -> int:
        h = (xxhash.xxh3_64_intdigest(self.lang + word) or 1) - (1 << 63)
        h = h or 1
        if len(self) > HELD:
            self.clear()
            self[b"\n"] = 0
        if len(word) <= 64:
            self[word] = h
        return h


_READ = "word_table binary, codes binary, width int, lang string, word string, hash long, n long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of word hashes, and counts of words."""
    schema = pa.schema([("word_table", pa.binary()), ("codes", pa.binary()), ("width", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()), ("n", pa.int64())])
    hashes: dict[str, _Hashes] = {}
    counts: dict[str, Counter] = {}
    row: list[int] = [0]

    def packed() -> pa.RecordBatch:
        words, codes = np.unique(np.array(row, np.int64), return_inverse=True)
        width = 2 if len(words) <= 1 << 16 else 4
        return pa.RecordBatch.from_pydict({"word_table": [words.tobytes()], "codes": [codes.astype(f"<u{width}").tobytes()], "width": [width], "lang": [None], "word": [None], "hash": [None], "n": [None]}, schema=schema)

    def counted() -> pa.RecordBatch:
        rows = [(lang, w, known[w], k) for lang, c in counts.items() for known in [hashes.get(lang) or _Hashes(lang)] for w, k in c.items()]
        lang, word, h, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        nothing = [None] * len(rows)
        counts.clear()
        return pa.RecordBatch.from_pydict({"word_table": nothing, "codes": nothing, "width": nothing, "lang": lang, "word": [w.decode("utf-8") for w in word], "hash": h, "n": n}, schema=schema)

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            lang, words = lang.as_py(), split_words(text.as_py())
            if lang not in hashes:
                if len(hashes) > 100:
                    yield counted()
                    hashes.clear()
                hashes[lang] = _Hashes(lang)
            row.extend(map(hashes[lang].__getitem__, words))
            row.append(0)
            seen = counts.setdefault(lang, Counter())
            seen.update(words)
            del seen[b"\n"]
            if len(row) >= ROW:
                yield packed()
                del row[1:]
            if sum(map(len, counts.values())) > HELD:
                yield counted()
            if sum(map(len, hashes.values())) > HELD + len(hashes):
                hashes.clear()
    yield packed()
    yield counted()


def _steps(batches: Iterator[pa.RecordBatch], least: int = STEP) -> Iterator[np.ndarray]:
    """Hashes of about least words at a time; 0 at ends, and at both ends of each array."""
    parts, n = [], 0
    for batch in batches:
        for words, codes, width in zip(*(batch.column(k) for k in range(3)), strict=True):
            parts.append(np.frombuffer(words.as_py(), np.int64)[np.frombuffer(codes.as_py(), f"<u{width.as_py()}")])
            n += len(parts[-1])
            if n >= least:
                yield np.concatenate(parts)
                parts, n = [], 0
    if parts:
        yield np.concatenate(parts)


def _mixed(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _slots(words: list[np.ndarray]) -> np.ndarray:
    """Where the bit tables keep a phrase."""
    return (_mixed(words) >> np.uint64(64 - BITS)).astype(np.int64)


def _has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def bits_at(slots: DataFrame) -> np.ndarray:
    """A bit for each slot there is. Of fixed size, made in parts by tasks."""

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PART, np.uint8)
        bits[table["at"].to_numpy()] = 1
        return pa.table({"part": table["part"][:1].cast(pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    placed = slots.select((F.col("slot") / F.lit(1 << PART)).cast("int").alias("part"), (F.col("slot") % F.lit(1 << PART)).cast("int").alias("at")).distinct()
    out = np.zeros((1 << BITS) >> 3, np.uint8)
    size = (1 << PART) >> 3
    for r in placed.groupBy("part").applyInArrow(pack, "part int, bits binary").collect():  # at most 2 ** (BITS - PART) rows of 8 kB
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def bit_table(phrases: DataFrame, names: list[str]) -> np.ndarray:
    """A bit for the slot of each phrase, a row of the columns names with 0 behind its last word."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            length = sum((w != 0).astype(int) for w in words)
            for m in np.unique(length):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots([w[length == m] for w in words[:m]])))], ["slot"])

    return bits_at(phrases.select(*names).mapInArrow(place, "slot long"))


def _grouped(words: list[np.ndarray], left: np.ndarray | None = None, right: np.ndarray | None = None) -> pa.RecordBatch:
    names = WORDS[: len(words)]
    table = pa.table(dict(zip(names, words, strict=True)) | ({} if left is None else {"left": left, "right": right}))
    sums = [(names[0], "count")] + ([] if left is None else [("left", "min"), ("left", "max"), ("right", "min"), ("right", "max")])
    found = table.group_by(names, use_threads=False).aggregate(sums).combine_chunks()  # a task has one core, and each thread would hold groups of its own
    nothing = pa.array(np.zeros(len(found), np.int64))
    columns = [found[c].combine_chunks() if c in names else nothing for c in WORDS]
    extra = [found[f"{names[0]}_count"].combine_chunks()] + ([] if left is None else [found[c].combine_chunks() for c in _NAMES[1:]])
    return pa.RecordBatch.from_arrays([*columns, *extra], WORDS + (_NAMES[:1] if left is None else _NAMES))


def _pass(tokens: DataFrame, step: Callable[[np.ndarray], Iterator[pa.RecordBatch]], names: list[str]) -> DataFrame:
    """Counts over all words what step finds in some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in _steps(batches):
            yield from step(v)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    found = tokens.mapInArrow(run, ", ".join(f"{c} long" for c in WORDS + names))
    sums = {"n": F.sum} | {c: F.min if c.endswith("min") else F.max for c in _NAMES[1:]}
    return found.groupBy(*WORDS).agg(*(sums[c](c).alias(c) for c in names))


def pair_table(tokens: DataFrame, frequent: np.ndarray, min_count: int) -> np.ndarray:
    """A bit for the slot of each pair of frequent words with min_count places. Pairs are counted by 32 bits of their hash, so some that are rarer have one too."""
    shared = tokens.sparkSession.sparkContext.broadcast(frequent)  # a bit table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in _steps(batches, 2 * STEP):
            often = _has(shared.value, _slots([v])) & (v != 0)
            at = np.flatnonzero(often[:-1] & often[1:])
            slot, n = np.unique((_mixed([v[at], v[at + 1]]) >> np.uint64(32)).astype(np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int32)), pa.array(n.astype(np.int32))], ["slot", "n"])

    often = tokens.mapInArrow(run, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    unsigned = F.pmod(F.col("slot").cast("bigint"), F.lit(1 << 32))
    return bits_at(often.select(F.floor(unsigned / F.lit(1 << (32 - BITS))).cast("bigint").alias("slot")))


def grow(tokens: DataFrame, first: np.ndarray, pair: np.ndarray) -> DataFrame:
    """Phrases that start with a word of first and whose pairs of neighbours are all in pair, with the least and greatest word before and behind them."""
    shared = tokens.sparkSession.sparkContext.broadcast((first, pair))  # bit tables

    def step(v: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, links = shared.value
        v = np.concatenate([v, np.zeros(LONGEST, np.int64)])
        linked = _has(links, _slots([v[:-1], v[1:]])) & (v[:-1] != 0) & (v[1:] != 0)
        at = np.flatnonzero(linked)
        at = at[_has(starts, _slots([v[at]]))]
        for m in range(2, LONGEST + 1):
            if m > 2:
                at = at[linked[at + m - 2]]
            yield _grouped([v[at + k] for k in range(m)], v[at - 1], v[at + m])

    return _pass(tokens, step, _NAMES)


def count_phrases(tokens: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Counts of the phrases of 2 to 4 words in wanted, and of some others."""
    shared = tokens.sparkSession.sparkContext.broadcast(wanted)  # a bit table

    def step(v: np.ndarray) -> Iterator[pa.RecordBatch]:
        v = np.concatenate([v, np.zeros(LONGEST, np.int64)])
        for m in range(2, LONGEST):
            words = [v[k : len(v) - LONGEST + k] for k in range(m)]
            at = np.flatnonzero(_has(shared.value, _slots(words)) & np.logical_and.reduce([w != 0 for w in words]))
            yield _grouped([w[at] for w in words])

    return _pass(tokens, step, ["n"])


def _parts(candidates: DataFrame) -> DataFrame:
    """A row for each part that a cut of a candidate leaves: the candidate's words, where it is cut, whether the part is the first one, the part's words as p1, p2, ..."""
    length = sum((F.col(w) != 0).cast("int") for w in WORDS)
    words = F.array(*WORDS)
    part = lambda a: F.concat(a, F.array_repeat(F.lit(0).cast("bigint"), LONGEST - 1 - F.size(a)))
    cuts = F.explode(F.sequence(F.lit(1), length - 1)).alias("k")
    cut = candidates.select(*WORDS, cuts, length.alias("m"))
    both = F.explode(F.array(F.struct(F.lit(True).alias("first"), part(F.slice(words, F.lit(1), F.col("k"))).alias("p")), F.struct(F.lit(False).alias("first"), part(F.slice(words, F.col("k") + 1, F.col("m") - F.col("k"))).alias("p")))).alias("s")
    return cut.select(*WORDS, "k", both).select(*WORDS, "k", "s.first", *(F.col("s.p")[k].alias(f"p{k + 1}") for k in range(LONGEST - 1)))


_PART = [f"p{k}" for k in range(1, LONGEST)]


def _as_parts(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col(WORDS[-1]) == 0).select(*(F.col(w).alias(p) for w, p in zip(WORDS, _PART, strict=False)), F.col("n").alias("f"))


def least_cut(a: int, n: int, sides: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(score, l, r) of the lowest-scoring cut among (k, l, r), in whole numbers of any size."""
    score, _, left, right = min((1000 * a * n // (left * right), k, left, right) for k, left, right in sides)
    return score, left, right


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [least_cut(a, n, [(s["k"], s["l"], s["r"]) for s in sides]) for a, n, sides in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], batch.column(0), batch.column(1), *(pa.array(list(c), pa.int64()) for c in columns)], [*batch.schema.names[3:], "a", "total", "score", "l", "r"])


def collocations(df: DataFrame, text_col: str, lang_col: str, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    texts = df.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    read = materialise(texts.mapInArrow(_read, _READ), "phrases-read")
    tokens = read.filter(F.col("codes").isNotNull()).select("word_table", "codes", "width")
    # A hash of two words shows as two rows here.
    words = materialise(read.filter(F.col("word").isNotNull()).groupBy("hash", "lang", "word").agg(F.sum("n").alias("f")), "phrases-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("total"))
    frequent = materialise(words.filter(F.col("f") >= min_count).join(totals, "lang"), "phrases-frequent")
    shared = frequent.select("hash").join(words.select("hash"), "hash").groupBy("hash").count().filter("count > 1")
    if not shared.isEmpty():
        raise ValueError("two words have one hash; give words another hash")
    singles = frequent.select(F.col("hash").alias("w1"), *(F.lit(0).cast("bigint").alias(w) for w in WORDS[1:]), F.col("f").alias("n"))
    linked = pair_table(tokens, bit_table(singles, ["w1"]), min_count)
    counts, scored, low = singles, None, min_count
    still = frequent.select("lang", "f", "total", "hash")
    while not still.isEmpty():
        tier = still.filter(F.col("f") < low * TIER)
        grown = materialise(grow(tokens, bit_table(tier, ["hash"]), linked).filter(F.col("n") >= min_count), "phrases-grown")
        # A bit table may let words of other tiers pass.
        starts = tier.select(F.col("hash").alias("w1"), "lang", "total")
        candidates = grown.join(starts, "w1")
        counts = counts.unionByName(candidates.select(*WORDS, "n"))
        cuts = _parts(candidates)
        unknown = materialise(cuts.filter("not first and p2 <> 0").select(*_PART).distinct().join(_as_parts(counts), _PART, "left_anti"), "phrases-unknown")
        if not unknown.isEmpty():
            rests = count_phrases(tokens, bit_table(unknown, _PART)).join(unknown.select(*(F.col(p).alias(w) for p, w in zip(_PART, WORDS, strict=False))), WORDS[:-1], "left_semi")
            counts_here = counts.unionByName(materialise(rests.select(*WORDS, "n"), "phrases-rests"))
        else:
            counts_here = counts
        sides = cuts.join(_as_parts(counts_here), _PART).groupBy(*WORDS, "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
        sides = sides.groupBy(*WORDS).agg(F.collect_list(F.struct("k", "l", "r")).alias("sides"))  # 4 at most
        held = ((F.col("left_min") == F.col("left_max")) & (F.col("left_min") != 0)) | ((F.col("right_min") == F.col("right_max")) & (F.col("right_min") != 0))
        alive = candidates.filter((F.col("w5") != 0) | ~held)
        long = ", ".join(f"{c} long" for c in ["a", "total", "score", "l", "r"])
        new = alive.join(sides, WORDS).select("n", "total", "sides", *WORDS, "lang").mapInArrow(_score, ", ".join(f"{c} long" for c in WORDS) + ", lang string, " + long)
        new = materialise(new, "phrases-scored")
        scored = new if scored is None else scored.unionByName(new)
        best = Window.partitionBy("lang").orderBy(F.desc("score"))
        last = scored.select("lang", "score", F.row_number().over(best).alias("nth")).filter(F.col("nth") <= top).groupBy("lang").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("last"))
        low *= TIER
        rest = still.filter(F.col("f") >= low)
        ahead = rest.groupBy("lang").agg(F.min("f").alias("least"))
        # The total may be large: whole numbers, and no product but 1000 times it.
        settled = last.filter(F.col("found") >= top).join(ahead, "lang").join(totals, "lang").filter(F.col("last") > F.expr("1000 * total div least")).select("lang")
        still = materialise(rest.join(settled, "lang", "left_anti"), "phrases-open")
    if scored is None:
        spark = df.sparkSession
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    # Ties are told apart by text, so only what reaches the last score gets one.
    best = Window.partitionBy("lang").orderBy(F.desc("score"))
    reach = scored.withColumn("nth", F.rank().over(best)).filter(F.col("nth") <= top).drop("nth")
    texts = reach.select(*WORDS, F.posexplode(F.filter(F.array(*WORDS), lambda w: w != 0)).alias("k", "hash")).join(frequent.select("hash", "word"), "hash")
    phrases = texts.groupBy(*WORDS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = reach.join(phrases, WORDS).withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def plain(rows: list[tuple[str | None, str | None]], min_count: int = MIN_COUNT, top: int = TOP) -> list[tuple]:
    """The same by loops over (text, lang), for tests."""
    counts: dict[str, Counter] = {}
    totals: Counter = Counter()
    for text, lang in rows:
        lang, piece = lang if lang is not None else "und", []
        seen = counts.setdefault(lang, Counter())
        for w in [*split_words(text or ""), b"\n"]:
            if w != b"\n":
                piece.append(w.decode("utf-8"))
                continue
            totals[lang] += len(piece)
            for m in range(1, LONGEST + 1):
                seen.update(tuple(piece[i : i + m]) for i in range(len(piece) - m + 1))
            piece = []
    out = []
    for lang, seen in counts.items():
        found = {g: a for g, a in seen.items() if len(g) > 1 and a >= min_count}
        held = {g[i:j] for g, a in found.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and found[g[i:j]] == a}
        rank = sorted((-s[0], -a, " ".join(g).encode("utf-8"), *s[1:]) for g, a in found.items() if g not in held for s in [least_cut(a, totals[lang], [(k, seen[g[:k]], seen[g[k:]]) for k in range(1, len(g))])])
        out += [(lang, i + 1, p.decode("utf-8"), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(rank[:top])]
    return out
