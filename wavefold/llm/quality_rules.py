"""Quality rules: base counts, and how far a document's histograms lie from those of its language.

Two histograms are taken of each whole text: characters by class, and words by the common words of
the known languages. A language's reference is the mean of the normalised histograms of those of its
documents that pass the base rule and are close to the medians of all that do, so that rubbish, while it is less than about half of
a language's documents, doesn't make itself the reference. Texts in two languages are common, so the even mixtures of two references stand beside
them. The Jensen-Shannon distance (base 2, so from 0 to 1) to the closest of these decides, where
the text is long enough for its histogram to mean anything.

Defined results: null text counts as empty and has no words, so it fails the base rule. A language
that is null or has no word list adds to one reference of all such documents together, if its
characters are near those of a known language (beyond ASCII any may be letters) or if no document has one;
only such documents are judged by it besides. Without word lists, made-up words are not told from an
unlisted language there. Ties and repeated rows are judged each by itself; columns other than the three named are not read. An id column
that bears the name of a result comes back as <name>_id. Very long texts are counted whole; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.llm.common import materialise, own_id, text_or_empty

# Common words by language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei sie nach wird",
    "en": "the of and to in a is that for it was on are as with his they be at one have this from or had by not but what all",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou",
}
LANGUAGES = tuple(sorted(COMMON_WORDS))
WORD_BIN = {w.encode("utf-8"): i for i, w in enumerate(sorted({w for ws in COMMON_WORDS.values() for w in ws.split()}))}

# Classes of ASCII characters; what is in none of them is "other", all else "beyond ASCII".
CHARACTER_CLASSES = {
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": "0123456789",
    "space": " \t\r\x0b\x0c",
    "line end": "\n",
    "stop": ".,;:",
    "exclamation": "!?",
    "symbol": "#*$%&|<>",
    "bracket or quote": "()[]{}\"'`-_/\\",
}
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
N_CLASSES, N_WORDS = len(CHARACTER_CLASSES) + 2, len(WORD_BIN) + 1

#: A text is rejected whose characters, or words, are farther off than so much, or both than somewhat less.
MAX_CHARACTER_DISTANCE, MAX_WORD_DISTANCE, BOTH = 0.30, 0.40, (0.155, 0.265)
#: Texts shorter than this are not judged by distance: for characters, and for words or both.
MIN_CHARACTERS, MIN_WORDS = 200, 100
#: Steps in which medians are counted.
STEPS = 256
#: The base rule: fewest words, largest share of repeated words in percent, and their window.
BASE_WORDS, BASE_REPEATED, WINDOW = 10, 20, 5


def _class_matrix() -> np.ndarray:
    """Byte values by class: a row for each byte; bytes that continue a character belong to none."""
    m = np.zeros((256, N_CLASSES), dtype=np.int64)
    m[:0x80, N_CLASSES - 2] = 1
    m[0xC0:, N_CLASSES - 1] = 1
    for k, chars in enumerate(CHARACTER_CLASSES.values()):
        for b in chars.encode("ascii"):
            m[b] = 0
            m[b, k] = 1
    return m


_CLASSES = _class_matrix()
_SYMBOL_BYTES, _SPACE_BYTES = np.frombuffer(SYMBOLS, np.uint8), np.frombuffer(SPACES, np.uint8)


def repeated_words(ids: np.ndarray, distinct: int, window: int = WINDOW) -> int:
    """How many words stand in windows of so many words that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    ids = ids.astype(np.uint64)
    bits = max(1, int(distinct - 1).bit_length())
    key = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        if bits * window <= 64:  # the window's words side by side
            key = key << np.uint64(bits) | ids[k : k + n]
        else:  # a 64-bit hash of them
            key = (key ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def measure(raw: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the two histograms of one text."""
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    classes = per_byte @ _CLASSES
    spaces = int(per_byte[_SPACE_BYTES].sum())
    words = raw.split()
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    common = np.zeros(N_WORDS, dtype=np.int64)
    times = np.bincount(ids, minlength=len(known))
    for w, i in known.items():
        common[WORD_BIN.get(w.lower(), N_WORDS - 1)] += times[i]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [len(words), int(classes.sum()) - spaces, int(per_byte[_SYMBOL_BYTES].sum()), len(lines) - len(set(lines)), repeated_words(ids, len(known))], classes, common


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the reference; 0 for a row without counts."""
    total = counts.sum(axis=1, keepdims=True)
    p = np.where(total > 0, counts / np.maximum(total, 1), reference)
    m = (p + reference) / 2

    def to_mean(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)

    return np.sqrt(np.clip((to_mean(p) + to_mean(np.broadcast_to(reference, p.shape))) / 2, 0, 1))


def closest(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The least distance of each row of counts to a row of reference or to the even mixture of two."""
    pairs = combinations_with_replacement(reference, 2)
    return np.min([distances(counts, (a + b) / 2) for a, b in pairs], axis=0) if len(counts) else np.zeros(0)


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """A row for each document: id, language (an index into LANGUAGES, or one beyond), base counts and histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.encode("utf-8")) for t in batch.column(1).to_pylist()]
            base = list(zip(*(f[0] for f in found), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(b, pa.int64()) for b in base), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.int64()))], [id_col, "language", *_BASE, "classes", "common"])

    kind = df.schema[id_col].dataType.simpleString()
    language = F.coalesce(*(F.when(F.col(lang_col) == x, F.lit(i)) for i, x in enumerate(LANGUAGES)), F.lit(len(LANGUAGES)))
    return df.select(F.col(id_col), text_or_empty(text_col), language.cast("int")).mapInArrow(run, f"`{id_col}` {kind}, language int, " + "".join(f"{b} bigint, " for b in _BASE) + "classes array<bigint>, common array<bigint>")


def references(stats: DataFrame) -> tuple[np.ndarray, int]:
    """The mean normalised histograms of each known language that has any, over its documents that pass against the language's medians, then of the admitted ones of no known language if there are any; and how many are of known languages."""
    middle = medians(stats)
    sums = _sums(stats, lambda n, r, c, w, lang: passing(n, r, c, w, middle, lang))
    known = _means(sums[:-1])
    if not len(known):  # no document of a known language passes
        sums = _sums(stats)
        known = _means(sums[:-1])
    elif _sums_of_others(stats):
        sums = _sums(stats.filter(F.col("language") == len(LANGUAGES)), lambda n, r, c, w, lang: admitted(n, r, c, known))
    out = np.concatenate([known, _means(sums[-1:])])
    return (out, len(known)) if len(out) else (np.full((1, N_CLASSES + N_WORDS), 1e-9), 1)  # no words at all: nothing to judge


def _sums_of_others(stats: DataFrame) -> bool:
    return not stats.filter((F.col("language") == len(LANGUAGES)) & (F.col("n_words") > 0)).isEmpty()


def medians(stats: DataFrame) -> np.ndarray:
    """For each known language the median of each normalised bin over its documents that pass the base rule, to STEPS steps of its square root, and the sum made 1: what fewer than half of the documents
    are doesn't move it far. A language without such documents has zeros. At most a count for each language, bin and step comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(LANGUAGES), N_CLASSES + N_WORDS, STEPS), np.int64)
        for batch in batches:
            language = batch.column(0).to_numpy()
            counts = [batch.column(1 + k).flatten().to_numpy().reshape(-1, width).astype(float) for k, width in enumerate((N_CLASSES, N_WORDS))]
            rows = (language < len(LANGUAGES)) & ~base_failed(batch.column(3).to_numpy(), batch.column(4).to_numpy())
            share = np.concatenate([h[rows] / np.maximum(h[rows].sum(axis=1, keepdims=True), 1) for h in counts], axis=1)
            step = np.minimum((np.sqrt(share) * STEPS).astype(int), STEPS - 1)
            np.add.at(seen, (language[rows][:, None], np.arange(share.shape[1])[None, :], step), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen.ravel()[at])], ["at", "n"])

    rows = stats.select("language", "classes", "common", "n_words", "n_repeat_words").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(len(LANGUAGES) * (N_CLASSES + N_WORDS) * STEPS, np.int64)
    for r in rows:
        seen[r["at"]] = r["n"]
    total = np.cumsum(seen.reshape(len(LANGUAGES), -1, STEPS), axis=2)
    step = (2 * total < total[:, :, -1:]).sum(axis=2)
    out = np.where((step > 0) & (total[:, :, -1] > 0), ((step + 0.5) / STEPS) ** 2, 0.0)
    for a, b in ((0, N_CLASSES), (N_CLASSES, N_CLASSES + N_WORDS)):
        part = out[:, a:b]
        out[:, a:b] = np.divide(part, part.sum(axis=1, keepdims=True), out=np.zeros_like(part), where=part.sum(axis=1, keepdims=True) > 0)
    return out


def too_far(n_words: np.ndarray, n_chars: np.ndarray, by_class: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    """The verdict of the distances, where a text is long enough for them."""
    return (by_class > MAX_CHARACTER_DISTANCE) & (n_chars >= MIN_CHARACTERS) | ((by_word > MAX_WORD_DISTANCE) | (by_class > BOTH[0]) & (by_word > BOTH[1])) & (n_words >= MIN_WORDS)


def passing(n_words: np.ndarray, n_repeat: np.ndarray, classes: np.ndarray, common: np.ndarray, middle: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Which documents of known languages add to their reference: they pass the base rule and are close to their own language's medians."""
    out = np.zeros(len(n_words), bool)
    for i in np.unique(language[language < len(LANGUAGES)]):
        rows = language == i
        far = [distances(h[rows], middle[i][a:b]) for h, a, b in ((classes, 0, N_CLASSES), (common, N_CLASSES, N_CLASSES + N_WORDS))]
        out[rows] = ~base_failed(n_words[rows], n_repeat[rows]) & ~too_far(n_words[rows], classes[rows].sum(axis=1), *far)
    return out


def admitted(n_words: np.ndarray, n_repeat: np.ndarray, classes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which documents of no known language may add to their reference: they pass the base rule, and their characters are near a known language's. There is no word list for them, and characters beyond ASCII may be their letters."""
    lower, beyond = list(CHARACTER_CLASSES).index("lower"), N_CLASSES - 1

    def as_letters(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, lower] += x[:, beyond]
        x[:, beyond] = 0
        return x

    return ~base_failed(n_words, n_repeat) & (closest(as_letters(classes), as_letters(known[:, :N_CLASSES])) <= MAX_CHARACTER_DISTANCE)


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < BASE_WORDS) | (100 * n_repeat > BASE_REPEATED * n_words)


def _means(sums: np.ndarray) -> np.ndarray:
    out = sums[(sums[:, :2] > 0).all(axis=1)]
    width = sums.shape[1]
    for k, (a, b) in enumerate(((2, 2 + N_CLASSES), (2 + N_CLASSES, width))):
        out[:, a:b] /= out[:, k : k + 1]
    return out[:, 2:]


def _sums(stats: DataFrame, may: Callable[..., np.ndarray] | None = None) -> np.ndarray:
    """A row for each language and one for all others: how many normalised histograms of either kind, and their sums; of the documents that may add to them (by words, repeated words, histograms, language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LANGUAGES) + 1, 2 + N_CLASSES + N_WORDS))
        for batch in batches:
            language = batch.column(0).to_numpy()
            counts = [batch.column(1 + k).flatten().to_numpy().reshape(-1, width).astype(float) for k, width in enumerate((N_CLASSES, N_WORDS))]
            if may is not None:
                rows = may(batch.column(3).to_numpy(), batch.column(4).to_numpy(), *counts, language)
                language, counts = language[rows], [h[rows] for h in counts]
            at = 2
            for k, h in enumerate(counts):
                width = h.shape[1]
                n = h.sum(axis=1, keepdims=True)
                np.add.at(total[:, at : at + width], language, np.divide(h, n, out=np.zeros_like(h), where=n > 0))
                np.add.at(total[:, k], language, (n > 0)[:, 0])
                at += width
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["language", "total"])

    sums = stats.select("language", "classes", "common", "n_words", "n_repeat_words").mapInArrow(run, "language int, total array<double>")
    width = 2 + N_CLASSES + N_WORDS
    # A row for each language, whatever the corpus.
    added = sums.groupBy("language").agg(*(F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width))).collect()
    out = np.zeros((len(LANGUAGES) + 1, width))
    for r in added:
        out[r["language"]] = r[1:]
    return out


@own_id("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "character_distance", "word_distance", "kept", "language", "classes", "common")
def judge(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """A row for each document: id, the base counts, base_failed, character_distance, word_distance and kept."""
    stats = materialise(measured(df, id_col, text_col, lang_col), "quality")
    reference, n_known = references(stats)  # (languages + 1) x (classes + words) at most, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_repeat = (batch.column(i).to_numpy() for i in (2, 6))
            classes, common = (batch.column(7 + k).flatten().to_numpy().reshape(-1, w) for k, w in enumerate((N_CLASSES, N_WORDS)))
            by_class, by_word = np.zeros(len(n_words)), np.zeros(len(n_words))
            named = batch.column(1).to_numpy() < len(LANGUAGES)
            for rows, near in ((named, reference[: n_known or None]), (~named, reference)):
                by_class[rows], by_word[rows] = closest(classes[rows], near[:, :N_CLASSES]), closest(common[rows], near[:, N_CLASSES:])
            failed = base_failed(n_words, n_repeat)
            odd = too_far(n_words, classes.sum(axis=1), by_class, by_word)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:7], pa.array(failed), pa.array(by_class), pa.array(by_word), pa.array(~failed & ~odd)], [id_col, *_BASE, "base_failed", "character_distance", "word_distance", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    return stats.mapInArrow(run, f"`{id_col}` {kind}, " + "".join(f"{b} bigint, " for b in _BASE) + "base_failed boolean, character_distance double, word_distance double, kept boolean")
