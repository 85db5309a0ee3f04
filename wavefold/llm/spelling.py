"""Spelling variants: words one edit apart, each sent to its much more frequent neighbour.

A word is a maximal run `[A-Za-z\\u00C0-\\u00FF]+` with A-Z in lower case, from which one letter goes where 31
divides a checksum of its document and itself (planted misspellings). Those of at least MIN_LENGTH letters that
occur MIN_COUNT times or more are compared. Two words are near if one inserted, deleted or replaced letter makes one
the other. A word's form is its near word of largest count (among equals the smallest), if that is FACTOR times
the word's or more; its root is what forms lead to in the end.

Dense prefix-suffix tiling. Words of a tile are rows of a matrix of code points (one byte each in this
alphabet). Blocks of pairs are compared at once: the lengths of their common prefix and common suffix; if these together reach the
longer length less one, one edit parts the pair. Tiles hold words of one length, or of two neighbouring ones.

Which words share a tile. The edit is at the first place where the two differ, and all else is common. The places
are cut into two halves, and a word joins a tile for each half by all its letters outside the half, so that near words
meet in exactly one tile, that of the half with the first difference. A tile of more than TILE words is cut again: its half is
halved, and so on down to one place, where a tile has at most a word for each letter of the alphabet. So no tile is
unbounded, none is compared by halves of its pairs only, and no pair is lost; the tiles' sizes are counted (added up in tasks
first) before any word moves. Tasks return a count and a best neighbour for each word of a tile, not pairs.

Defined results: null texts and texts without letters have no words; a null id counts as empty in the checksum.
Repeated rows count each time, very long texts and words are taken whole, an empty table has no rows. Other columns are
not read. Broadcast is only the list of tiles to cut, up to MOST_BROADCAST of them, beyond which it is joined salt by salt.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.llm.common import SALTS, materialise, salt, text_or_empty

MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: Most words of a tile; pairs compared at once; words held at once by a task, and bytes of their letters.
TILE, BLOCK, ROWS, BYTES = 256, 200_000, 100_000, 1 << 24
#: Distinct words held before their counts are passed on.
HELD = 200_000
MOST_BROADCAST = 1_000_000
_RUNS = re.compile("[a-zÀ-ÿ]+").findall
_SAME, _LONGER = 0, 1  # kinds of tiles: words of one length; words of a length and of one more


def runs(text: str, doc: str) -> Iterator[tuple[str, int]]:
    """The words of a document with their counts, after the deletions that its id stands for."""
    start = zlib.crc32(doc.encode("utf-8") + b":")
    for run, n in Counter(_RUNS(text.encode("utf-8").lower().decode("utf-8"))).items():
        if len(run) >= MIN_LENGTH:
            h = zlib.crc32(run.encode("utf-8"), start)
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < MIN_LENGTH:
                    continue
            yield run, n


def count_words(df: DataFrame, id_col: str, text_col: str, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in runs(text.as_py(), doc.as_py()):
                    seen[word] += n
                if len(seen) > HELD:
                    yield out()
        yield out()

    texts = df.select(text_or_empty(id_col).alias("doc"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _key(letters: bytes, kind: int, short: int, low: int, high: int) -> int:
    """Of the letters outside the places from low to high (without it), for a tile whose shorter words have so many letters."""
    rest = short - high + kind  # behind an inserted letter one place more is common
    seed = ((kind * 8191 + short) * 8191 + low) * 8191 + high
    return xxhash.xxh3_64_intdigest(letters[:low] + b"\0" + (letters[-rest:] if rest > 0 else b""), seed & (1 << 63) - 1) - (1 << 63)


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, word in enumerate(batch.column(0).to_pylist()):
            letters = word.encode("latin-1")
            m = len(letters)
            for kind, short in ((_SAME, m), (_LONGER, m), (_LONGER, m - 1)):
                middle = (short + 1) // 2
                for low, high in ((0, middle), (middle, short + 1)):
                    at.append(i)
                    rows.append((kind, short, low, high, _key(letters, kind, short, low, high)))
        yield _keyed(batch, at, rows)


def _next_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, (word, kind, short, low, high) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), strict=True)):
            letters, middle = word.encode("latin-1"), (low + high) // 2
            for a, b in ((low, middle), (middle, high)):
                at.append(i)
                rows.append((kind, short, a, b, _key(letters, kind, short, a, b)))
        yield _keyed(batch, at, rows)


def _keyed(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    index = pa.array(at, pa.int64())
    kinds = [pa.int32()] * 4 + [pa.int64()]
    return pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], _KEYED)


_KEYED = ["word", "n", "kind", "short", "low", "high", "key"]
_KEYED_TYPE = "word string, n long, kind int, short int, low int, high int, key long"


def near_pairs(letters: np.ndarray, a: np.ndarray, b: np.ndarray, short: int, kind: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of the pairs of rows a and b (b the longer ones), those parted by one edit whose first difference lies from low to high (without it)."""
    x, y = letters[a, :short], letters[b]
    from_left = x != y[:, :short]
    from_right = (x != y[:, kind : kind + short])[:, ::-1]
    prefix = np.where(from_left.any(axis=1), from_left.argmax(axis=1), short)
    suffix = np.where(from_right.any(axis=1), from_right.argmax(axis=1), short)
    return (prefix + suffix >= short + kind - 1) & (prefix >= low) & (prefix < high)


def _compare(words: np.ndarray, n: np.ndarray, length: np.ndarray, tile: np.ndarray, short: int, kind: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near rows, of tiles that stand one after another. Rows of a tile are dealt with those behind them, BLOCK pairs at a time."""
    letters = np.zeros((len(words), short + kind), np.uint8)
    for m in {short, short + kind}:
        rows = np.flatnonzero(length == m)
        if len(rows):
            letters[rows, :m] = np.frombuffer("".join(words[rows]).encode("latin-1"), np.uint8).reshape(len(rows), m)
    if kind == _SAME:
        first = np.arange(len(words))
        begin, end = first + 1, np.searchsorted(tile, tile, "right")
    else:
        first = np.flatnonzero(length == short)  # longer ones stand behind shorter ones of their tile
        begin = np.searchsorted(tile * 2 + (length > short), tile[first] * 2 + 1)
        end = np.searchsorted(tile, tile[first], "right")
    if kind == _SAME:
        begin, end = begin[first], end[first]
    many = np.maximum(end - begin, 0)
    found_a, found_b = [], []
    block = max(1, min(BLOCK, BYTES // max(1, short)))
    ends = np.cumsum(many)
    for k in range(0, int(ends[-1]) if len(ends) else 0, block):
        pair = np.arange(k, min(k + block, int(ends[-1])))
        i = np.searchsorted(ends, pair, "right")
        a, b = first[i], begin[i] + pair - (ends[i] - many[i])
        ok = near_pairs(letters, a, b, short, kind, low[a], high[a])
        found_a.append(a[ok])
        found_b.append(b[ok])
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *found_a]), np.concatenate([nothing, *found_b])


_FOUND = "word string, n_near long, best struct<less: bigint, word: string>"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a tile its near words there: how many, and the best. Rows come ordered by kind, length and tile; a tile begun in one batch ends in a later one."""
    held: pa.Table | None = None

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        words = np.array(table["word"].to_pylist(), dtype=object)
        n, kind, short, low, high, key = (table[c].to_numpy() for c in ("n", "kind", "short", "low", "high", "key"))
        length = np.array([len(w) for w in words], np.int64)
        new = np.ones(len(words), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (short[1:] != short[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (key[1:] != key[:-1])
        tile = np.cumsum(new)
        alone = np.bincount(tile)[tile] == 1
        source, other = [], []
        for part in np.split(np.flatnonzero(~alone), np.flatnonzero((np.diff(kind[~alone]) != 0) | (np.diff(short[~alone]) != 0)) + 1):
            if len(part):
                part = part[np.lexsort((length[part], tile[part]))]
                a, b = _compare(words[part], n[part], length[part], tile[part], int(short[part[0]]), int(kind[part[0]]), low[part], high[part])
                source += [part[a], part[b]]
                other += [part[b], part[a]]
        if source:
            s, o = np.concatenate(source), np.concatenate(other)
            names, code = np.unique(words, return_inverse=True)  # in code-point order
            order = np.lexsort((code[o], -n[o], s))
            s, o = s[order], o[order]
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            many = np.diff(np.concatenate([at, [len(s)]]))
            best = pa.StructArray.from_arrays([pa.array(-n[o[at]]), pa.array(list(words[o[at]]), pa.string())], ["less", "word"])
            yield pa.RecordBatch.from_arrays([pa.array(list(words[s[at]]), pa.string()), pa.array(many.astype(np.int64)), best], ["word", "n_near", "best"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < ROWS and held["word"].nbytes < BYTES:
            continue
        same = np.logical_and.reduce([held[c].to_numpy() == held[c][-1].as_py() for c in ("kind", "short", "low", "high", "key")])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last tile may go on
        yield from search(held.slice(0, cut).combine_chunks())
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from search(held.combine_chunks())


def _split(rows: DataFrame, large: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
    """The rows of other tiles, and those of large ones."""
    if many <= MOST_BROADCAST:  # checked: so many numbers
        return tuple(rows.join(F.broadcast(large), "key", how).select(*_KEYED) for how in ("left_anti", "left_semi"))
    dealt = rows.withColumn("salt", salt("word"))
    each = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return tuple(dealt.join(each, ["key", "salt"], how).select(*_KEYED) for how in ("left_anti", "left_semi"))


def near_words(words: DataFrame) -> DataFrame:
    """For each word (word, n) that has any: n_near, and best, its near word of largest count, which less has negative."""
    rows = materialise(words.select("word", "n").mapInArrow(_first_keys, _KEYED_TYPE), "spelling-keys")
    found = None
    while True:
        large = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("high") - F.col("low")).alias("width")).filter((F.col("c") > TILE) & (F.col("width") > 1)).select("key"), "spelling-large")
        many = large.count()
        small, rest = _split(rows, large, many) if many else (rows, None)
        here = small.repartition("key").sortWithinPartitions("kind", "short", "low", "high", "key").mapInArrow(_tiles, _FOUND)
        found = here if found is None else found.unionByName(here)
        if rest is None:
            break
        rows = materialise(rest.mapInArrow(_next_keys, _KEYED_TYPE), "spelling-keys")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the steps word, form lead to. Counts grow by FACTOR with each step, so steps are few; a form that many words have is joined salt by salt."""
    inner = forms.select(F.col("form").alias("word")).distinct().join(forms, "word")
    inner = materialise(inner.select(F.col("word").alias("root"), F.col("form").alias("next")), "spelling-inner")
    out = forms.select("word", F.col("form").alias("root"))
    if inner.isEmpty():
        return out
    each = inner.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    while True:
        step = out.withColumn("salt", salt("word")).join(each, ["root", "salt"], "left")
        out = materialise(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if out.filter("moved").isEmpty():
            return out.drop("moved")
        out = out.drop("moved")


def variants(df: DataFrame, id_col: str, text_col: str, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """A row for each word: word, form, root, n, n_near, form_n."""
    words = materialise(count_words(df, id_col, text_col, min_count), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    large = -F.col("best.less") >= factor * F.col("n")
    found = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(large, F.col("best.word")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"))
    found = materialise(found, "spelling-found")
    led = found.join(roots(found.filter("form is not null").select("word", "form")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
