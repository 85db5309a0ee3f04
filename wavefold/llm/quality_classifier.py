"""Quality classifier: ordinal regression with cumulative logits on hashed text.

Graded ratings (0 toxic, 1 of low quality, 2 good) train one weight for each hashed feature and the
ordered thresholds between grades; the weights are shared by all thresholds. A text's score gives its
expected grade and the probability of each tail, by which documents are chosen.

Features are the distinct words and runs of punctuation of the whole text, lower-cased, their beginnings (which inflected
forms share), and bins of its shape (shares of
capitals, of symbols, of bars, of digits and of repeated words, mean word length, length), hashed into
a table of weights of fixed size.

The fit reads at most `max_rows` labelled rows, chosen by a hash of their id, and is the work of one task
on an executor; scoring covers every document, with the weights of a fixed-size table and two thresholds.

Defined results: null text counts as empty and scores by its shape alone. Labels with a null rating or
for no document are left out; of several labels of one document the lowest counts. Without labels every
document has the highest grade, and so has every one where no labelled document is in df. An empty table has no
rows. Repeated rows are scored each by itself; df's own columns are kept, but
for those that bear the names of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavefold.llm.common import text_or_empty

BITS = 18
#: A shape counts as so many features, as it stands against hundreds of words.
SHAPE_COPIES = 8
#: Bytes in the beginnings of words.
PREFIXES = (4, 5, 6)
#: Most labelled rows that the fit reads; fewest of them that must have a feature for it to get a weight.
MAX_ROWS, MIN_ROWS = 10_000, 4
GRADES = 3
#: Most rows to a step of the fit.
BLOCK = 1_000
#: A document is kept if it is of the highest grade with at least this probability.
KEEP = 0.5
_WORD = regex.compile(rb"[a-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]{2,}").findall  # or a run of punctuation
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&<>=_^~@", np.uint8)] = True


def _bin(share: float) -> int:
    """Of a share from 0 to 1: finer near 0."""
    return int(np.sqrt(share) * 12)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """The distinct hashed features of a text, in order."""
    raw = text.encode("utf-8")
    words = _WORD(raw.lower())
    distinct = set(words)
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, letters = max(1, len(raw)), max(1, int(per_byte[65:91].sum() + per_byte[97:123].sum()))
    shape = {
        "capitals": _bin(per_byte[65:91].sum() / letters), "symbols": _bin(per_byte[_SYMBOL].sum() / n), "bars": _bin(per_byte[124] / n), "bangs": _bin(per_byte[33] / n),
        "digits": _bin(per_byte[48:58].sum() / n), "repeated": _bin(1 - len(distinct) / max(1, len(words))), "word length": min(20, n // max(1, len(words))), "length": len(words).bit_length(),
    }
    shape |= {f"{k} of {shape['length']}": shape[k] for k in ("repeated",)}
    mask = (1 << bits) - 1
    parts = distinct.union(*({b"<" + w[:k] for w in distinct} for k in PREFIXES))
    found = {xxhash.xxh3_64_intdigest(w) & mask for w in parts}
    found |= {xxhash.xxh3_64_intdigest(f"{k}={v}", 1 + i) & mask for k, v in shape.items() for i in range(SHAPE_COPIES)}
    return np.array(sorted(found), dtype=np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """For each score, the probabilities of a grade of at least 1, at least 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))


def fit(lengths: np.ndarray, flat: np.ndarray, grades: np.ndarray, n_grades: int = GRADES, bits: int = BITS, epochs: int = 30, rate: float = 0.03, ridge: float = 2e-3, min_rows: int = MIN_ROWS) -> Model:
    """Adam on the mean negative log likelihood with a ridge on the weights, block of rows by block, with a rate that falls to 0. lengths: how many of the features in flat each row has."""
    size, n = 1 << bits, len(lengths)
    if not n:
        return Model(np.zeros(size), np.full(n_grades - 1, -60.0))
    used = np.flatnonzero(np.bincount(flat, minlength=size) >= min_rows)
    column = np.full(size, -1, dtype=np.int32)
    column[used] = np.arange(len(used))
    ends, rows = np.cumsum(lengths), max(BLOCK // 20, min(BLOCK, n // 10))
    x = start(grades, len(used), n_grades)
    m, v = np.zeros_like(x), np.zeros_like(x)
    steps, t = epochs * -(-n // rows), 0
    for _ in range(epochs):
        for first in range(0, n, rows):
            here = column[flat[ends[first - 1] if first else 0 : ends[min(n, first + rows) - 1]]]
            row = np.repeat(np.arange(len(lengths[first : first + rows])), lengths[first : first + rows])[here >= 0]
            _, g = loss(x, row, here[here >= 0], grades[first : first + rows], n_grades, ridge)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x - rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weights, w = np.zeros(size), len(used)
    weights[used] = x[:w]
    return Model(weights, x[w] + np.concatenate([[0.0], np.cumsum(np.exp(x[w + 1 :]))]))


def start(grades: np.ndarray, w: int, n_grades: int) -> np.ndarray:
    """Where the fit begins: no weights, the first threshold and the logarithms of the steps to the next as the grades' shares have them."""
    share = np.clip([(grades >= k).mean() for k in range(1, n_grades)], 1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    return np.concatenate([np.zeros(w), cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))])


def loss(x: np.ndarray, row: np.ndarray, column: np.ndarray, grades: np.ndarray, n_grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """The mean negative log likelihood of some rows with half the ridge times the squared weights, and its gradient. x: weights, first threshold, logarithms of the steps; row and column of each feature."""
    n, w = len(grades), len(x) - n_grades + 1
    score = np.bincount(row, weights=x[column], minlength=n)
    gaps = np.exp(x[w + 1 :])
    cuts = np.concatenate([[-60.0], x[w] + np.concatenate([[0.0], np.cumsum(gaps)]), [60.0]])
    low, high = (1 / (1 + np.exp(-np.clip(cuts[grades + k] - score, -60, 60))) for k in (0, 1))
    p = np.maximum(high - low, 1e-12)
    d_high, d_low = high * (1 - high) / p / n, low * (1 - low) / p / n
    g_cut = np.bincount(grades + 1, weights=-d_high, minlength=n_grades + 1) + np.bincount(grades, weights=d_low, minlength=n_grades + 1)
    inner = g_cut[1:n_grades]
    g_gaps = np.cumsum(inner[::-1])[::-1][1:] * gaps
    g = np.concatenate([np.bincount(column, weights=(d_high - d_low)[row], minlength=w) + ridge * x[:w], [inner.sum()], g_gaps])
    return float(-np.log(p).mean() + ridge / 2 * (x[:w] ** 2).sum()), g


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 of low quality, 2 good; null if either rating is."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(toxic > 0, 0).when(quality <= 0, 1).otherwise(2)


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: Column, max_rows: int = MAX_ROWS) -> Model:
    """Fits on at most max_rows labelled rows of df, those with the least hash of their id."""
    graded = labels.select(F.col(id_col).alias("id"), grade_col.cast("int").alias("grade")).dropna().groupBy("id").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "grade", "text")  # at most max_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))], ["id", "grade", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(1).to_numpy(), b.column(2)) for b in batches]
        lengths = np.concatenate([np.zeros(0, np.int64), *(np.asarray(f.value_lengths()) for _, f in parts)])
        model = fit(lengths, np.concatenate([np.zeros(0, np.int32), *(np.asarray(f.flatten()) for _, f in parts)]), np.concatenate([np.zeros(0, np.int64), *(g.astype(np.int64) for g, _ in parts)]))
        at = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32)]), pa.array([model.weights[at]]), pa.array([model.thresholds])], ["at", "weights", "thresholds"])

    kind = df.schema[id_col].dataType.simpleString()
    sample = found.mapInArrow(run, f"id {kind}, grade int, features array<int>").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    # One task fits on the sample, which has a bound; one row of at most 2 ** BITS weights comes back.
    fitted = sample.mapInArrow(learn, "at array<int>, weights array<double>, thresholds array<double>").collect()
    if not fitted:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    weights = np.zeros(1 << BITS)
    weights[np.array(fitted[0]["at"], dtype=np.int64)] = fitted[0]["weights"]
    return Model(weights, np.array(fitted[0]["thresholds"]))


def score(df: DataFrame, text_col: str, model: Model, keep: float = KEEP) -> DataFrame:
    """df with expected_grade, p_low (a grade of at least 1), p_good (the highest grade) and kept."""
    weights, thresholds = model.weights, model.thresholds  # of fixed size
    shared = df.sparkSession.sparkContext.broadcast(weights)
    names = ["expected_grade", "p_low", "p_good", "kept"]
    own = [c for c in df.columns if c not in names]
    at = own.index(text_col)
    schema = T.StructType([*(df.schema[c] for c in own), *(T.StructField(c, T.DoubleType()) for c in names[:3]), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(shared.value, thresholds)
        for batch in batches:
            scores = np.array([scorer.weights[features(t or "")].sum() for t in batch.column(at).to_pylist()], dtype=float)
            tails = scorer.tails(scores)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep)], [*own, *names])

    return df.select(*own).mapInArrow(run, schema)
