"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

A bin is filled around the longest length left: a subset-sum dynamic programme over the
available lengths, one bit of an integer for each reachable sum, finds the combination that
leaves the least slack, and that combination is removed. Only lengths matter for this, and there
are at most `capacity` of them, so the plan is made on the histogram of lengths (one count for
each length, whatever the size of the corpus), and a combination is taken as often as the counts
allow. The plan has a few intervals of ranks for each length. Spark ranks the pieces within their
length and every piece looks its place up: no piece passes through the driver.

Defined results: null text counts as empty; an empty document is its end token alone; a document
longer than `capacity` is cut into pieces of `capacity` tokens, the last as long as it is. Equal
lengths are ranked by input partition and position; repeated rows and null ids are packed like
others. An empty table has no pieces. An id column
that bears the name of a result comes back as <name>_id.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavefold.llm.common import materialise, own_id, text_or_empty

CAPACITY = 2048
#: Chunks of text kept in each of the two generations of a worker's cache, and the most bytes of one that is kept: so a generation holds at most some 110 MB, whatever the text.
CACHE_WORDS, KEPT_BYTES = 250_000, 64
#: Words in one call of the tokenizer, whose results take a kilobyte or more each.
AT_ONCE = 4096
#: Texts handled at once inside a task; words joined into one call of the tokenizer.
SLICE, JOINED = 512, 64
END_PUNCTUATION = b".,!?;:#*$%&|"


class WordBpe:
    """Ids of texts by a tokenizer whose words end at white space; what stands between ASCII white space is encoded once and then kept."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own would each hold memory
        self.tokenizer = Tokenizer.from_file(path)
        # The same without normalisation, for text that is already as it would leave it.
        self.bare = Tokenizer.from_str(json.dumps(json.loads(self.tokenizer.to_str()) | {"normalizer": None}))
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache_words, self.young, self.old = cache_words, {}, {}

    def _plain(self, words: list[str]) -> list[bytes]:
        parts = (words[i : i + AT_ONCE] for i in range(0, len(words), AT_ONCE))
        return [np.array(e.ids, dtype="<u4").tobytes() for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin-1 letters alone. Each of them is one word to the tokenizer, so that several can be encoded in one text and parted where words end."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[bytes] = []
        step = max(1, AT_ONCE // JOINED)
        encoded = (e for i in range(0, len(groups), step) for e in self.bare.encode_batch_fast([" ".join(g) for g in groups[i : i + step]], add_special_tokens=False))
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(group):
                out += self._plain(group)
                continue
            raw, at = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[at:end])
                at = end
        return out

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that the young generation hasn't; they are in it afterwards."""
        if len(self.young) + len(chunks) > self.cache_words:
            self.old, self.young = self.young, {}
        known = self.old.get
        out = {c: ids for c in chunks if (ids := known(c)) is not None}
        split: list[tuple[bytes, bytes, bytes]] = []
        heads: dict[bytes, bytes] = {}
        other: dict[bytes, bytes] = {}
        get = self.young.get
        for c in chunks - out.keys():
            head = c.rstrip(END_PUNCTUATION)
            if not head.isascii() or head.isalpha():
                letters = head.lower() if head.isascii() else _latin_letters(head)
                if letters:
                    heads[letters] = get(letters) or known(letters) or b""
                    tail = c[len(head) :]
                    if tail:
                        other[tail] = b""
                    split.append((c, letters, tail))
                    continue
            other[c] = b""
            split.append((c, c, b""))
        fresh = [h for h, ids in heads.items() if not ids]
        for head, ids in zip(fresh, self._letters([h.decode("utf-8") for h in fresh]), strict=True):
            heads[head] = ids
            if len(head) <= KEPT_BYTES:
                self.young[head] = ids
        other.update(zip(other, self._plain([c.decode("utf-8") for c in other]), strict=True))
        for c, head, tail in split:
            out[c] = (heads[head] if head in heads else other[head]) + (other[tail] if tail else b"")
        self.young.update((c, x) for c, x in out.items() if len(c) <= KEPT_BYTES)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Words are told apart once for all texts; an empty one has no ids."""
        words = pc.ascii_split_whitespace(pa.array(map(_lowered, texts), pa.string()))
        coded = words.flatten().dictionary_encode()
        chunks = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.young.get, chunks))
        if missing := {c for c, x in zip(chunks, ids, strict=True) if x is None}:
            learnt = self._learn(missing)
            ids = [learnt[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]
        offsets = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
        spread = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))).take(coded.indices)
        raw, bounds = np.asarray(spread.flatten(), dtype="<i4").tobytes(), 4 * np.concatenate([[0], np.cumsum(np.diff(offsets)[np.asarray(coded.indices)])])[np.asarray(words.offsets)]
        return [raw[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]


def _lowered(text: str) -> str:
    """A text in lower case, as the tokenizer will have it, where all characters are Latin-1, for which that is a matter of each character by itself; others as they are."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _latin_letters(head: bytes) -> bytes:
    """A word of Latin-1 letters in lower case; nothing if it has other characters."""
    word = head.decode("utf-8")
    return word.lower().encode("utf-8") if word.isalpha() and max(word) <= "ÿ" else b""


_here: dict[str, WordBpe] = {}


def _codec(path: str) -> WordBpe:
    if path not in _here:
        _here[path] = WordBpe(path)
    return _here[path]


def fullest(available: dict[int, int], room: int) -> Counter[int]:
    """The combination of available lengths with the largest sum that is at most room; as few and as long pieces as the order of trial gives."""
    steps: list[tuple[int, int, int]] = []  # length, copies, sums reachable before
    sums, mask = 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, copies = min(available[length], room // length), 1
        while left and not sums >> room & 1:
            copies = min(copies, left)
            steps.append((length, copies, sums))
            sums |= sums << length * copies & mask
            left, copies = left - copies, copies * 2
        if sums >> room & 1:
            break
    target, taken = sums.bit_length() - 1, Counter()
    for length, copies, before in reversed(steps):
        if not before >> target & 1:
            taken[length] += copies
            target -= length * copies
    return taken


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[Counter[int], int]]:
    """Combinations of lengths and how many bins are filled by each; they use up all counts."""
    left, plan = dict(counts), []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        combination = Counter({longest: 1}) + fullest({x: n for x, n in rest.items() if n}, capacity - longest)
        bins = min(left[x] // n for x, n in combination.items())
        plan.append((combination, bins))
        for x, n in combination.items():
            left[x] -= n * bins
            if not left[x]:
                del left[x]
    return plan


def intervals(plan: list[tuple[Counter[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, copies in a bin, first bin, offset in the bin) in order of rank."""
    used: Counter[int] = Counter()
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    first = 0
    for combination, bins in plan:
        offset = 0
        for length in sorted(combination, reverse=True):
            copies = combination[length]
            rows[length].append((used[length], copies, first, offset))
            used[length] += copies * bins
            offset += copies * length
        first += bins
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pieces(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """Documents as token pieces: id, piece, start, length, ids_crc32, part (input partition), nth (among the pieces of that length there) and, if asked for, ids."""
    names = [id_col, "piece", "start", "length", "ids_crc32", "part", "nth", "ids"][: 7 + with_ids]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen, part, width = _codec(tokenizer_path), Counter(), TaskContext.get().partitionId(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                here = batch.slice(at, SLICE)
                row, rows = [], []
                for k, raw in enumerate(codec.encode(here.column(1).to_pylist())):
                    raw += end
                    for n, begin in enumerate(range(0, len(raw), width)):
                        cut = raw[begin : begin + width]
                        length = len(cut) // 4
                        row.append(k)
                        rows.append((n, begin // 4, length, zlib.crc32(cut), part, seen[length], cut))
                        seen[length] += 1
                cols = list(zip(*rows, strict=True))
                out = [here.column(0).take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64())]
                if with_ids:
                    ends = np.cumsum([0, *(len(c) // 4 for c in cols[6])], dtype=np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cols[6]), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(out, names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint" + ", ids array<int>" * with_ids
    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, schema)


@own_id("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids", "part", "n", "nth", "before", "rank")
def pack(df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids array<int>. A sequence is its pieces in order of offset."""
    cut = materialise(pieces(df, id_col, text_col, tokenizer_path, end_id, capacity, with_ids), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = df.sparkSession.sparkContext.broadcast(intervals(plan_bins(counts, capacity)))
    # One row for each input partition and length, so that the largest group is as large as the number of partitions.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    kept = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                rows = places.value[int(length)]
                k = np.searchsorted(rows[:, 0], ranks[at], side="right") - 1
                nth, copies = ranks[at] - rows[k, 0], rows[k, 1]
                sequence[at] = rows[k, 2] + nth // copies
                offset[at] = rows[k, 3] + nth % copies * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset), *batch.columns[6:]], [*kept, "sequence_id", "offset", "ids"][: 7 + with_ids])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return ranked.select(*kept, "rank", *["ids"] * with_ids).mapInArrow(run, schema)
