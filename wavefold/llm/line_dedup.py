"""Line deduplication by a sharded minimal perfect hash.

Every whole text is cut at line ends. A line's key is the line without white space at its ends and
with A-Z in lower case. The keys of at least `min_chars` characters found in at least `min_docs`
documents are indexed: the key's 128-bit hash chooses a shard and, by the shard's minimal perfect
hash, a slot in its arrays of fingerprints, document counts and keepers. Line hashes are sent to the
shard that may know them and probe its arrays; what comes back to a document is its list of hashes
to drop, so line texts are never joined or moved.

The arrays of one shard stay small because the number of shards follows the number of indexed keys. A
shard's arrays stand in as many copies as GROUP goes into the line hashes that are sent there, and a
document's lines go to the copy that its id and text choose, so a line found everywhere makes no task
longer than others. Nothing passes through the driver but the number of shards.

Defined results: null or empty text is one empty line. Rows that share an id are one document: a key
in them counts once, and stays in all of them if that id is the largest. A row with a null id counts as
no document and loses the lines that others hold often enough. A key's lines stay in the document with
the largest id holding it and go from all others; a text left without lines is empty. Columns of df pass
through, but for the text and for any that bear the names of the two counts; an empty table has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavefold.llm.common import materialise, text_or_empty

MIN_CHARS, MIN_DOCS = 40, 5
#: Fewest shards, most keys in a shard as it is planned, and line hashes to a copy of a shard's arrays.
SHARDS, SHARD_KEYS, GROUP = 32, 50_000, 500_000
#: Most shards whose number of copies is sent to all executors; beyond that it is joined.
SENT_SHARDS = 100_000
SPACES = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it has fewer characters than count."""
    key = line.strip(SPACES).lower()  # of bytes: A-Z only
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8")) < min_chars:
        return None
    return key


def hash_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each row of df and distinct key in it: id, t (a hash of the text), h1, h2 (the two halves of the key's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                own = {xxhash.xxh3_128_digest(key) for line in text.encode("utf-8").split(b"\n") if (key := line_key(line, min_chars)) is not None}
                row += [k] * len(own)
                found += own
            halves, at = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2), pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["id", "t", "h1", "h2"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.xxhash64(text_or_empty(text_col)), text_or_empty(text_col)).mapInArrow(run, f"id {kind}, t bigint, h1 bigint, h2 bigint")


def _spread(h: np.ndarray, level: int, width: int) -> np.ndarray:
    """A place below width for each hash, another at each level."""
    x = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) % np.uint64(width)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash in levels of bits: a key rests at the first level where it meets no other key; its slot is the number of keys that rest before it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - 1 for x in levels]

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """h: distinct 64-bit hashes."""
        levels, rest = [], h
        while len(rest):
            at = _spread(rest, len(levels), 2 * len(rest))
            bits = np.bincount(at, minlength=2 * len(rest)) == 1
            levels.append(bits)
            rest = rest[~bits[at]]
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; for one that was not built in, -1 or any slot."""
        out = np.full(len(h), -1, dtype=np.int64)
        rest = np.arange(len(h))
        for k, bits in enumerate(self.levels):
            at = _spread(h[rest], k, len(bits))
            here = bits[at]
            out[rest[here]] = self.before[k] + self.ranks[k][at[here]]
            rest = rest[~here]
        return out

    def dump(self) -> bytes:
        return b"".join(np.int64(len(x)).tobytes() + np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        levels, at = [], 0
        while at < len(raw):
            n = int(np.frombuffer(raw, np.int64, 1, at)[0])
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at + 8), count=n).astype(bool))
            at += 8 + -(-n // 8)
        return cls(levels)


def build_index(frequent: DataFrame, shards: int, id_type: T.DataType) -> DataFrame:
    """One row for each shard of the rows (h1, h2, n, keeper): its perfect hash, fingerprints, counts and keepers in slot order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Two keys whose first halves are the same can't share a shard's hash; the second takes its place by the other half.
        h1, first = np.unique(pdf["h1"].to_numpy(), return_index=True)
        late = np.setdiff1d(np.arange(len(pdf)), first)
        order = np.concatenate([first, late])
        keys = np.concatenate([h1, pdf["h2"].to_numpy()[late]])
        perfect = PerfectHash.build(keys)
        slots = perfect.slots(keys)
        place = np.empty(len(order), dtype=np.int64)
        place[slots] = order
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "hash": [perfect.dump()], "fingerprints": [pdf["h2"].to_numpy()[place].astype("<i8").tobytes()], "counts": [pdf["n"].to_numpy()[place].astype("<i8").tobytes()], "keepers": [pdf["keeper"].to_numpy()[place].tolist()]})

    return frequent.withColumn("shard", F.pmod("h1", F.lit(shards))).groupBy("shard").applyInPandas(run, f"shard bigint, hash binary, fingerprints binary, counts binary, keepers array<{id_type.simpleString()}>")


def probe(lines: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """The rows (id, t, h1, h2) of lines that a document must drop."""
    names = ["id", "t", "h1", "h2"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return left.select(names).slice(0, 0)
        fingerprints, counts = (np.frombuffer(right.column(k)[0].as_py(), "<i8") for k in ("fingerprints", "counts"))
        keepers = right.column("keepers").combine_chunks().flatten()
        perfect = PerfectHash.load(right.column("hash")[0].as_py())
        h1, h2 = (left.column(k).to_numpy() for k in ("h1", "h2"))
        ids, drop = left.column("id").combine_chunks(), np.zeros(len(h1), dtype=bool)
        for h in (h1, h2):
            slot = perfect.slots(h)
            known = np.flatnonzero((slot >= 0) & (fingerprints[slot] == h2) & (counts[slot] >= min_docs))
            own = pc.fill_null(pc.equal(keepers.take(pa.array(slot[known])), ids.take(pa.array(known))), False)
            drop[known[~np.asarray(own)]] = True
        return left.select(names).filter(pa.array(drop))

    sent = lines.withColumn("shard", F.pmod("h1", F.lit(shards)))
    # A row for each shard.
    sizes = sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).alias("copies"))
    salted = sent.join(F.broadcast(sizes) if shards <= SENT_SHARDS else sizes, "shard").select(*names, "shard", F.pmod(F.xxhash64("id", "t"), F.col("copies")).alias("copy"))
    places = sizes.select(F.col("shard").alias("__shard"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    copied = index.join(places, F.col("shard") == F.col("__shard")).select(*index.columns, "copy")
    kind = lines.schema["id"].dataType.simpleString()
    return salted.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(run, f"id {kind}, t bigint, h1 bigint, h2 bigint")


def dedup_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """df with the text rewritten, n_lines (before dropping) and n_dropped."""
    lines = materialise(hash_lines(df, id_col, text_col, min_chars), "lines")
    frequent = materialise(lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs), "frequent-lines")
    shards = max(SHARDS, math.ceil(frequent.count() / SHARD_KEYS))
    index = materialise(build_index(frequent, shards, lines.schema["id"].dataType), "line-index")
    drops = probe(lines, index, shards, min_docs)
    by_doc = drops.groupBy(F.col("id").alias("__id"), F.col("t").alias("__t")).agg(F.collect_set(F.struct("h1", "h2")).alias("__drops"))
    kept = [c for c in df.columns if c not in (lines_col, dropped_col)]
    fields = [T.StructField(c, T.StringType() if c == text_col else df.schema[c].dataType) for c in kept]
    schema = T.StructType([*fields, T.StructField(lines_col, T.LongType()), T.StructField(dropped_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index(text_col)
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                if drops:
                    gone = {np.array([d["h1"], d["h2"]], dtype="<i8").tobytes() for d in drops}
                    left = [x for x in text.encode("utf-8").split(b"\n") if (key := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(key) not in gone]
                    n_dropped[-1] = n_lines[-1] - len(left)
                    text = b"\n".join(left).decode("utf-8")
                texts.append(text)
            columns = list(batch.columns[: len(kept)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*kept, lines_col, dropped_col])

    texts = df.select(*kept).withColumn(text_col, text_or_empty(text_col))
    # By id and text, so that many rows of one id, or of none, are no one task's work.
    joined = texts.join(by_doc, (F.xxhash64(text_col) == F.col("__t")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    return joined.select(*kept, "__drops").mapInArrow(run, schema)
