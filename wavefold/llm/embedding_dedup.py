"""Embedding near-deduplication by an inverted multi-index.

Vectors of length one are cut into halves, each with its own codebook; the product of the codebooks is
a grid of cells. A query traverses the cells in multi-sequence order: both halves' centroids are sorted by
their distance, and the cell with the least sum of the two is next. What it has visited is always a
staircase in the two sorted lists, and it stops at the first cell that is farther than its nearest one by
more than a neighbour at the very threshold is with the target recall. What lies in the visited cells is
compared by cosine in double precision.

Identical vectors are one class, compared once. The index is laid out by first-half centroid, and
queries go to each first-half centroid with the list of second-half cells they visit there. Both sides
of a busy centroid are cut into blocks, and a task compares a block of queries with a block of vectors.
A task returns for each query how many vectors it links, and enough edges to keep what it connects
connected, never pairs.

The codebooks grow with the square root of the number of classes, so that cells stay as small as CELL. One
task fits them on a sample, the classes with the least hash: SAMPLE of them, or SAMPLED to a centroid if
that is more. Every vector is indexed and every class is a query.

Vectors of different lengths never link; each length has codebooks and an index of its own.

Defined results: vectors that are null or zero, hold null or non-finite components, or have a null id
link with nothing. Rows that share an id share their links, and count as several vectors. An
empty table has no rows; other columns are not read. An id column
that bears the name of a result comes back as <name>_id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavefold.llm.common import each_salt, materialise, own_id, salt, salts
from wavefold.llm.components import components

THRESHOLD = 0.9
#: Share of neighbours at the threshold that the visited cells hold; classes that the codebooks are fitted on at least, and to a centroid; those of them that the bound of visits is set by.
RECALL, SAMPLE, SAMPLED, PROBES = 0.999, 16_384, 8, 2_048
#: Classes to a cell as planned, and rows of a block.
CELL, BLOCK = 12, 4_096
#: Numbers in a matrix of distances or products that is held at once.
HELD = 4_000_000


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest magnitude is taken out first, as squares of very large or small numbers are none."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _square_distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)[None, :], 0)


def _nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its square distance."""
    step, at, far = max(1, HELD // len(codes)), np.empty(len(x), np.int64), np.empty(len(x))
    for k in range(0, len(x), step):
        d = _square_distances(x[k : k + step], codes)
        at[k : k + step] = d.argmin(axis=1)
        far[k : k + step] = d.min(axis=1)
    return at, far


def fit_codes(x: np.ndarray, n: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of x by Lloyd's rounds; one that loses its points keeps its place."""
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = _nearest(x, codes)[0]
        sums = np.zeros_like(codes)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=len(codes))
        codes[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return codes


Books = tuple[np.ndarray, np.ndarray]


def own_cells(x: np.ndarray, books: Books) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroids of both halves, and the sum of their square distances."""
    half = books[0].shape[1]
    (first, a), (second, b) = _nearest(x[:, :half], books[0]), _nearest(x[:, half:], books[1])
    return first, second, a + b


def stop_bound(x: np.ndarray, books: Books, threshold: float, recall: float, seed: int = 2) -> float:
    """How much farther than a query's nearest cell the cell of a neighbour at the threshold, in a random direction, is at most with the given probability."""
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=x.shape)
    noise = _unit(noise - (noise * x).sum(axis=1, keepdims=True) * x) if x.shape[1] > 1 else np.zeros_like(x)
    first, second, _ = own_cells(threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * noise, books)
    half = books[0].shape[1]
    there = ((x[:, :half] - books[0][first]) ** 2).sum(axis=1) + ((x[:, half:] - books[1][second]) ** 2).sum(axis=1)
    return float(np.quantile(there - own_cells(x, books)[2], recall, method="higher"))


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """The cells of one query in order: (distance, first, second), from its distances to both halves' centroids. A cell is in the heap once the cells before it in either list have been visited."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], set()
    while heap:
        d, i, j = heapq.heappop(heap)
        seen.add((i, j))
        yield d, int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x == 0 or (x - 1, y) in seen) and (y == 0 or (x, y - 1) in seen):
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def staircase(first: np.ndarray, second: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What multi_sequence() visits until it stops, for many queries (rows) at once: for each query and first-half centroid in its stairs their numbers and how many of the sorted second list lie there, and that list."""
    order = np.argsort(second, axis=1, kind="stable")
    ranked = np.take_along_axis(second, order, axis=1)
    room = first.min(axis=1) + ranked[:, 0] + bound
    query, centroid = np.nonzero(first + ranked[:, :1] <= room[:, None])
    depth = np.empty(len(query), np.int64)
    begin = np.searchsorted(query, np.arange(len(first) + 1))
    for k in range(len(first)):
        mine = slice(begin[k], begin[k + 1])
        depth[mine] = np.searchsorted(ranked[k], room[k] - first[k, centroid[mine]], side="right")
    return query, centroid, np.maximum(depth, 1), order


def _join_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected with by the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer edges that connect what the edges a-b connect: each node with the least of its component."""
    names, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _join_labels(inverse[: len(a)], inverse[len(a) :], len(names))
    far = label != np.arange(len(names))
    return names[far], names[label[far]]


def compare(ids: np.ndarray, vectors: np.ndarray, visits: list[np.ndarray], other: np.ndarray, other_vectors: np.ndarray, other_cell: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many vectors each query links among the others, and edges (a, b) that connect what the links connect."""
    linked = np.zeros(len(ids), dtype=np.int64)
    query, cell = np.repeat(np.arange(len(ids)), [len(v) for v in visits]), np.concatenate(visits)
    order = np.argsort(cell, kind="stable")
    query, cell = query[order], cell[order]
    by_cell = np.argsort(other_cell, kind="stable")
    cells, begin = np.unique(other_cell[by_cell], return_index=True)
    edges = [(ids[:0], ids[:0])]
    for c, rows in zip(cells, np.split(by_cell, begin[1:]), strict=True):
        asking = query[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
        step = max(1, HELD // len(rows))
        for at in range(0, len(asking), step):
            q = asking[at : at + step]
            near = (vectors[q] @ other_vectors[rows].T >= threshold) & (ids[q][:, None] != other[rows][None, :])
            linked[q] += near @ weight[rows]
            x, y = np.nonzero(near)
            if len(x):
                edges.append(_spanning(ids[q[x]], other[rows[y]]))
    return linked, *_spanning(*(np.concatenate([e[k] for e in edges]) for k in (0, 1)))


@own_id("n_links", "component_id", "kept")
def link(df: DataFrame, id_col: str, vector_col: str, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each row of df: id, n_links (other vectors linked directly), component_id (least id reachable by links) and kept."""
    spark = df.sparkSession
    of_floats = df.schema[vector_col].dataType.elementType == T.FloatType()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if of_floats else "array<double>").alias("vector")).withColumn("salt", salt("id"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    classes = materialise(valid.groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), salts()), "vectors")
    kind = classes.schema["rep"].dataType.simpleString()
    sizes = classes.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("dim").collect()  # a row for each length
    found = spark.createDataFrame([], f"a {kind}, b {kind}, linked bigint")
    for dim, n in sizes:
        alike = classes.filter(F.size("vector") == dim).select("rep", "n", "vector")
        found = found.union(_search(alike, dim, *fit(alike, dim, n, threshold, recall), threshold))
    counts = found.filter(F.col("b").isNull()).groupBy(F.col("a").alias("rep")).agg(F.sum("linked").alias("linked"))
    parts = components(found.filter(F.col("b").isNotNull()), "a", "b").select(F.col("id").alias("rep"), "component")
    by_class = classes.join(counts, "rep", "left").join(parts, "rep", "left").select(F.col("vector").alias("__vector"), "rep", "n", "linked", "component", each_salt("__salt"))
    joined = rows.join(by_class, (F.col("vector") == F.col("__vector")) & (F.col("salt") == F.col("__salt")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "rep", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce(F.col("n") - 1 + F.coalesce("linked", F.lit(0)), F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def fit(classes: DataFrame, dim: int, n: int, threshold: float, recall: float) -> tuple[Books, float]:
    """Codebooks for n classes (rep, n, vector), and the bound at which visits stop; one task's work on the sample."""
    n_codes, half = max(2, 2 ** round(math.log2(max(1.0, math.sqrt(n / CELL))))), max(1, dim // 2)
    sample = classes.orderBy(F.xxhash64("vector"), "rep").limit(max(SAMPLE, SAMPLED * n_codes)).select("vector")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _unit(np.concatenate([np.asarray(b.column(0).flatten()) for b in batches]).reshape(-1, dim))
        books = fit_codes(x[:, :half], n_codes), fit_codes(x[:, half:], n_codes) if dim > 1 else np.zeros((1, 0))
        bound = stop_bound(x[:PROBES], books, threshold, recall) if n > PROBES else math.inf  # too few to set it by: all cells
        yield pa.RecordBatch.from_arrays([pa.array([b.ravel() for b in books], pa.list_(pa.float64())), pa.array([bound] * 2)], ["book", "bound"])

    rows = sample.mapInArrow(learn, "book array<double>, bound double").collect()  # two rows
    first, second = (np.array(r["book"]) for r in rows)
    return (first.reshape(-1, half), second.reshape(-1, dim - half) if dim > 1 else np.zeros((1, 0))), rows[0]["bound"]


def _search(classes: DataFrame, dim: int, books: Books, bound: float, threshold: float) -> DataFrame:
    """Edges (a, b) and counts (a, linked; b is null) of the classes (rep, n, vector)."""
    kind, vectors = (classes.schema[c].dataType.simpleString() for c in ("rep", "vector"))
    half, step = books[0].shape[1], max(1, HELD // (len(books[0]) + len(books[1])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of the index for each vector, and a query for each first-half centroid that it visits."""
        for batch in batches:
            for at in range(0, batch.num_rows, min(step, 512)):
                part = batch.slice(at, min(step, 512))
                x = _unit(np.asarray(part.column(2).flatten()).reshape(-1, dim))
                a, b = _square_distances(x[:, :half], books[0]), _square_distances(x[:, half:], books[1])
                query, centroid, depth, order = staircase(a, b, bound)
                own = pa.array(np.concatenate([np.arange(len(x)), query]))
                cells = [b.argmin(axis=1).astype(np.int32), *(order[q, :d].astype(np.int32) for q, d in zip(query, depth, strict=True))]
                sizes = np.cumsum(np.concatenate([[0], np.ones(len(x), np.int64), depth])).astype(np.int32)
                taken = part.take(own)
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate([a.argmin(axis=1), centroid]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(cells))), pa.array(np.arange(len(own)) >= len(x))], ["rep", "n", "vector", "centroid", "cells", "query"])

    placed = materialise(classes.mapInArrow(place, f"rep {kind}, n bigint, vector {vectors}, centroid int, cells array<int>, query boolean"), "index")
    # One row for each first-half centroid: how many blocks its vectors and its queries fill.
    blocks = placed.groupBy("centroid").agg(*(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("query") == q, 1).otherwise(0)) / BLOCK)).cast("int").alias(name) for name, q in (("v_blocks", False), ("q_blocks", True))))
    sized = placed.join(F.broadcast(blocks), "centroid")  # a row for each centroid, whose number grows with the square root of the classes
    mine, others = F.when(F.col("query"), F.col("q_blocks")).otherwise(F.col("v_blocks")), F.when(F.col("query"), F.col("v_blocks")).otherwise(F.col("q_blocks"))
    own = F.pmod(F.xxhash64("rep", "vector"), mine).cast("int")
    dealt = sized.select("rep", "n", "vector", "centroid", "cells", "query", own.alias("own"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    keyed = dealt.select("rep", "n", "vector", "centroid", "cells", "query", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("q_block"), F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("v_block"))

    def run(t: pa.Table) -> pa.Table:
        query = np.asarray(t.column("query"))
        ids, n = np.asarray(t.column("rep")), np.asarray(t.column("n"))
        x = _unit(np.asarray(t.column("vector").combine_chunks().flatten()).reshape(-1, dim))
        cells = t.column("cells").combine_chunks()
        bounds, flat = np.asarray(cells.offsets) - cells.offsets[0].as_py(), np.asarray(cells.flatten())
        q, v = np.flatnonzero(query), np.flatnonzero(~query)
        if len(q) and len(v):
            linked, a, b = compare(ids[q], x[q], [flat[bounds[i] : bounds[i + 1]] for i in q], ids[v], x[v], flat[bounds[v]], n[v], threshold)
            q = q[linked > 0]
            linked = linked[linked > 0]
        else:
            q, linked, a, b = q[:0], np.zeros(0, np.int64), ids[:0], ids[:0]
        at = t.schema.field("rep").type
        return pa.table({"a": pa.array(np.concatenate([a, ids[q]]), at), "b": pa.concat_arrays([pa.array(b, at), pa.nulls(len(q), at)]), "linked": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(linked, pa.int64())])})

    return materialise(keyed.groupBy("centroid", "q_block", "v_block").applyInArrow(run, f"a {kind}, b {kind}, linked bigint"), "found")
