"""Near-duplicate documents by order MinHash, verified by banded alignment.

A text is its words, lower-cased and without punctuation at their ends; its k-mers are runs of five
words, each labelled with how many like it came before. One sketch of a text is its few k-mers of least
hash under one hash function, kept in text order; two texts meet if a sketch is the same, which is the
likelier the smaller their edit distance. Most texts have FUNCTIONS sketches of ORDER k-mers; short ones
have shorter sketches, and texts near the border have both kinds, so that no near pair is parted by it.

Texts with the same words are one class, represented by its least id. The representatives in one bucket
(one value of a sketch) are compared in two rounds, not in all pairs. First each is compared with its
buckets' most connected member. Then, in the buckets that still hold several components, members outside
the largest component are held against all members of other components in their buckets, block by block inside tasks,
where profiles of k-mer counts rule out what can't reach the threshold and the others are aligned at once.
Whatever is in one component already, or is joined by links found before in the block, needs no more links; a
block's rows are the links that join two of its components, fewer than it has members. So no link between members of a
bucket that would join two components is left out, and a bucket of thousands of copies costs a few
comparisons each. What the second round costs grows with the square of the members of one bucket that
nothing links, but as texts compared in blocks, not as rows.

A pair is verified by aligning its k-mers: matching labelled k-mers whose positions differ by more than
the threshold allows lie outside the band, and the longest common order of the others over their union
is the similarity. It is THRESHOLD or more for a link.

Defined results: null text counts as empty; texts without words are all alike. Rows that share an id are
one document. Rows with a null id are compared with nothing, have a null class and stay. Other columns
are not read. An empty table has no rows. An id column
that bears the name of a result comes back as <name>_id. Very long texts are compared whole.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.llm.common import each_salt, materialise, own_id, salt, salts, text_or_empty
from wavefold.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
#: Sketches and k-mers in each, for texts of at least LONG k-mers and for shorter ones.
FUNCTIONS, ORDER = 48, 8
SHORT_FUNCTIONS, SHORT_ORDER, LONG = 16, 3, 24
PUNCTUATION = string.punctuation + "«»“”‘’„‚…–—¿¡·"
#: Bins of a text's k-mer profile; members of a bucket that meet in one task, of those outside the largest component and of all.
BINS, OUTSIDE, ALL = 256, 1_024, 4_096
#: About as many k-mers as these members have at most, so that long texts make smaller blocks.
OUTSIDE_MERS, ALL_MERS = 1 << 20, 1 << 22
#: Copies in which a text stands that very many are compared with.
COPIES = 1_024
_SEEDS = np.random.default_rng(11).integers(1, 2**63, size=(FUNCTIONS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of each word that has more than punctuation."""
    known: dict[str, int] = {}
    ids = [known.setdefault(w, len(known)) for w in text.lower().split()]
    if not ids:
        return np.zeros(0, np.uint32)
    words = [w.strip(PUNCTUATION) for w in known]
    hashes = np.array([xxhash.xxh32_intdigest(w) for w in words], dtype=np.uint32)[ids]
    return hashes if all(words) else hashes[np.array([w != "" for w in words])[ids]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def kmers(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of SHINGLE words with its occurrence label, in text order; a shorter text is one run."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = _mix((out ^ words[k : k + n].astype(np.uint64)) * _ODD + np.uint64(k + 1))
    order = np.argsort(out, kind="stable")
    same = np.concatenate([[False], out[order][1:] == out[order][:-1]])
    if same.any():
        at = np.arange(n)
        label = np.empty(n, dtype=np.uint64)
        label[order] = at - np.maximum.accumulate(np.where(same, 0, at))
        out = np.where(label > 0, _mix((out ^ label) * _ODD), out)
    return out


def sketches(mers: np.ndarray) -> np.ndarray:
    """The distinct sketch values of a text."""
    n = len(mers)
    if not n:
        return np.zeros(1, np.int64)
    kinds = []
    if n >= LONG * THRESHOLD:
        kinds.append((FUNCTIONS, ORDER))
    if n * THRESHOLD < LONG:
        kinds.append((SHORT_FUNCTIONS, SHORT_ORDER))
    out = []
    for functions, order in kinds:
        order = min(order, n)
        step = max(1, 2_000_000 // n)  # of functions at once, so that a long text needs no more memory than a short one
        for begin in range(0, functions, step):
            seeds = _SEEDS[begin : min(functions, begin + step)]
            hashed = (mers[None, :] ^ seeds[:, :1]) * seeds[:, 1:]
            least = np.sort(np.argpartition(hashed, order - 1, axis=1)[:, :order], axis=1) if n > order else np.tile(np.arange(n), (len(seeds), 1))
            value = seeds[:, 0] ^ np.uint64(order)
            for k in range(order):
                value = _mix((value ^ mers[least[:, k]]) * _ODD)
            out.append(value)
    return np.unique(np.concatenate(out)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """The share of labelled k-mers that a banded alignment of two texts matches; 0 where it is sure to be below the threshold."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total = len(a) + len(b)
    if len(both) < threshold * (total - len(both)) - 1e-9:
        return 0.0
    band = total - 2 * total * threshold / (1 + threshold) + 1e-9  # most k-mers left unmatched
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    at_b = at_b[np.abs(at_a - at_b) <= band]
    if (np.diff(at_b) > 0).all():
        matched = len(at_b)
    else:
        tails: list[int] = []
        for x in at_b.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        matched = len(tails)
    return matched / (total - matched)


def sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each row with an id: id, tag (a number of the row), n (k-mers), w1 and w2 (a hash of its words), keys (its sketches) and words (their 32-bit hashes as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, halves, keys, words = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = word_hashes(text)
                mers = kmers(hashes)
                n.append(len(mers))
                words.append(hashes.tobytes())
                halves.append(xxhash.xxh3_128_digest(words[-1]))
                keys.append(sketches(mers))
            w = np.frombuffer(b"".join(halves), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(tag, tag + len(n))), pa.array(n, pa.int64()), pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.binary())], ["id", "tag", "n", "w1", "w2", "keys", "words"])
            tag += len(n)

    kind = df.schema[id_col].dataType.simpleString()
    return df.filter(F.col(id_col).isNotNull()).select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"id {kind}, tag bigint, n bigint, w1 bigint, w2 bigint, keys array<bigint>, words binary")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (rep, words) are similar enough. A text that is in very many pairs as a stands in COPIES, among which they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, last, left = [], None, np.zeros(0, np.uint64)
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                if (raw := x.as_py()) != last:
                    last, left = raw, kmers(np.frombuffer(raw, np.uint32))
                kept.append(similarity(left, kmers(np.frombuffer(y.as_py(), np.uint32)), threshold) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    sides = [texts.select(F.col("rep").alias(c), F.col("words").alias(f"{c}_words")) for c in ("a", "b")]
    dealt = pairs.select("a", "b", salt("b", parts=COPIES).alias("salt"))
    left = dealt.select("a", "salt").distinct().join(sides[0], "a")  # no more rows than pairs
    return dealt.join(sides[1], "b").join(left, ["a", "salt"]).select("a", "b", "a_words", "b_words").mapInArrow(run, f"a {kind}, b {kind}")


def _mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components: key, rep, n, component, main (about the bucket's largest component) and how many blocks it fills."""
    placed = members.join(parts, "rep", "left").select("key", "salt", "rep", "n", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("mers"), salts())
    largest = sizes.groupBy("key").agg(F.max_by("component", "size").alias("main"), F.max("size").alias("most"), F.sum("size").alias("size"), F.max_by("mers", "size").alias("main_mers"), F.sum("mers").alias("mers"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    o_blocks = F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("most")) / OUTSIDE), F.ceil((F.col("mers") - F.col("main_mers")) / OUTSIDE_MERS))
    m_blocks = F.greatest(F.ceil(F.col("size") / ALL), F.ceil(F.col("mers") / ALL_MERS))
    blocks = largest.select("key", "main", o_blocks.cast("int").alias("o_blocks"), m_blocks.cast("int").alias("m_blocks"))
    back = sizes.join(blocks, "key").select("key", "component", "main", "o_blocks", "m_blocks", each_salt())
    return placed.join(back, ["key", "component", "salt"]).select("key", "rep", "n", "component", "main", "o_blocks", "m_blocks")


def profile(mers: np.ndarray) -> bytes:
    """How many k-mers fall in each bin; two profiles' lesser counts add up to no less than the k-mers that two texts share."""
    counts = np.bincount((mers >> np.uint64(17)).astype(np.int64) % BINS, minlength=BINS)
    return (counts if counts.max(initial=0) < 2**16 else np.full(BINS, 2**16 - 1)).astype("<u2").tobytes()


def _profiles(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """(rep, profile, words) of the texts whose rep is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(kmers(np.frombuffer(raw.as_py(), np.uint32))) for raw in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(1)], ["rep", "profile", "words"])

    kind = texts.schema["rep"].dataType.simpleString()
    return texts.select("rep", "words").join(needed.select("rep").distinct(), "rep", "left_semi").mapInArrow(run, f"rep {kind}, profile binary, words binary")


def _in_blocks(mixed: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (rep, a) that join components of members that meet in a bucket, of which one is outside the bucket's main component. A pair is compared in the least bucket it shares, unless links found before in its block join it."""
    rep_type = mixed.schema["rep"].dataType.simpleString()
    sized = mixed.join(_profiles(texts, mixed).join(classes.select("rep", "keys"), "rep"), "rep")
    side = lambda own, other: F.explode(F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda k: F.struct(F.pmod(F.xxhash64("rep"), F.col(own)).cast("int").alias("own"), k.alias("other"))))
    kept = ["key", "rep", "n", "component", "keys", "profile", "words"]
    outside = sized.filter(F.col("component") != F.col("main")).select(*kept, side("o_blocks", "m_blocks").alias("b")).select(*kept, F.lit(True).alias("asks"), F.col("b.own").alias("o_block"), F.col("b.other").alias("m_block"))
    members = sized.select(*kept, side("m_blocks", "o_blocks").alias("b")).select(*kept, F.lit(False).alias("asks"), F.col("b.other").alias("o_block"), F.col("b.own").alias("m_block"))

    def run(t: pa.Table) -> pa.Table:
        asks = np.asarray(t.column("asks"))
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        n = np.asarray(t.column("n")).astype(float)
        kind = t.schema.field("rep").type
        left, right = [], []
        if len(q) and len(m):
            key = t.column("key")[0].as_py()
            counts = np.frombuffer(b"".join(t.column("profile").to_pylist()), "<u2").reshape(-1, BINS)
            keys = [set(x) for x in t.column("keys").to_pylist()]
            part = t.column("component").combine_chunks().dictionary_encode().indices.to_numpy().copy()  # joined as links are found
            words = t.column("words")
            mers = cache(lambda i: kmers(np.frombuffer(words[i].as_py(), np.uint32)))
            order = m[np.argsort(n[m], kind="stable")]
            lengths = n[order]
            for i in q.tolist():
                near = slice(np.searchsorted(lengths, threshold * n[i] - 1e-6), np.searchsorted(lengths, n[i] / threshold + 1e-6, side="right"))
                others = order[near]
                others = others[part[others] != part[i]]
                shared = np.minimum(counts[i], counts[others]).sum(axis=1, dtype=np.int64)
                may = shared >= threshold * (n[i] + n[others] - shared) - 1e-9
                for j in others[may][np.argsort(-shared[may], kind="stable")].tolist():
                    if part[j] != part[i] and min(keys[i] & keys[j]) == key and similarity(mers(i), mers(j), threshold) >= threshold:
                        part[part == part[j]] = part[i]
                        left.append(i)
                        right.append(j)
        reps = t.column("rep").combine_chunks()
        return pa.table({"rep": reps.take(pa.array(left, pa.int64())), "a": reps.take(pa.array(right, pa.int64()))}, schema=pa.schema([("rep", kind), ("a", kind)]))

    return outside.unionByName(members).groupBy("key", "o_block", "m_block").applyInArrow(run, f"rep {rep_type}, a {rep_type}")


@own_id("class_id", "kept")
def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of df: id, class_id (least id of its near-duplicates) and kept (whether it is that one)."""
    docs = materialise(sketched(df, id_col, text_col).withColumn("salt", salt("id")), "sketches")
    # Texts with the same words: the least id, a row that has it, and the salts by which all are dealt.
    groups = materialise(docs.groupBy("w1", "w2").agg(F.min("id").alias("rep"), F.min_by("tag", "id").alias("tag"), salts()), "classes")
    classes = materialise(docs.select("tag", "n", "keys").join(groups.select("tag", "rep"), "tag"), "sketched")

    exploded = classes.select("rep", "n", F.explode("keys").alias("key"), salt("rep").alias("salt"))
    buckets = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), salts()).filter("size > 1")
    met = materialise(exploded.join(buckets.select("key", each_salt()), ["key", "salt"]), "met")
    often = met.groupBy("rep").agg(F.count(F.lit(1)).alias("often"))  # a text near many others is in many buckets
    members = materialise(met.join(often, "rep"), "members")
    needed = classes.select("tag", "rep").join(often.select("rep"), "rep", "left_semi")
    texts = materialise(docs.select("tag", "words").join(needed, "tag"), "words")

    centre = members.groupBy("key").agg(F.max_by("rep", "often").alias("a"), salts())
    together = members.select("key", "salt", "rep").join(centre.select("key", "a", each_salt()), ["key", "salt"]).filter(F.col("rep") != F.col("a"))
    times = together.groupBy("rep", "a").agg(F.count(F.lit(1)).alias("times"))
    # With each text the centre that it meets in the most buckets.
    tried = materialise(times.groupBy("rep").agg(F.max_by("a", "times").alias("a")).select("a", F.col("rep").alias("b")), "pairs")
    links = materialise(_verified(tried, texts, threshold), "links")
    whole = components(links, "a", "b").withColumnRenamed("id", "rep")
    mixed = materialise(_mixed(members, whole), "unresolved")
    if not mixed.isEmpty():
        more = materialise(_in_blocks(mixed, classes, texts, threshold).select("a", F.col("rep").alias("b")), "links")
        if not more.isEmpty():
            whole = components(links.union(more), "a", "b").withColumnRenamed("id", "rep")

    placed = groups.join(whole, "rep", "left").select("w1", "w2", F.coalesce("component", "rep").alias("class"), each_salt())
    by_doc = docs.select("id", "w1", "w2", "salt").join(placed, ["w1", "w2", "salt"]).groupBy("id").agg(F.min("class").alias("class_id"))
    out = df.select(F.col(id_col).alias("__id")).join(by_doc, F.col("__id") == F.col("id"), "left")
    return out.select(F.col("__id").alias(id_col), "class_id", F.coalesce(F.col("__id") == F.col("class_id"), F.lit(True)).alias("kept"))
