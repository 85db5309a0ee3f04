"""Byte-level BPE: text to ids with character offsets, and ids back to bytes.

The merges come from a rank file (one base64 token and its rank a line). Each match of the
pre-split pattern is one word for the tokenizers library, whose alphabet is the usual table of
256 printable characters for the 256 bytes. A word's ids are kept in a bounded cache, as most
words of a corpus recur.

Defined results: null text counts as empty; an empty text has no ids. The pattern has no
catastrophic cases, so very long texts only take time in proportion. Rows are never joined or
grouped, so ties, repeated rows and null keys pass through as they are; an empty table has no rows. Of df's
columns only the two named are read, so others may bear any names; the id may not be named as a result is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavefold.llm.common import text_or_empty

#: Words kept in each of the two generations of a worker's cache, and the most characters of one that is kept: so a generation holds at most some 250 MB, whatever the text.
CACHE_WORDS, KEPT_CHARS = 400_000, 64
#: Words in one call of the tokenizer, whose results take a kilobyte or more each.
AT_ONCE = 4096
#: Texts handled at once inside a task.
SLICE = 256


def byte_table() -> list[str]:
    """The printable character for each byte: itself if it is printable Latin-1, else the next free one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A tokenizers model that joins whichever neighbours make the token of lowest rank: every split of a token into two tokens is a merge, in order of rank."""
    chars = byte_table()
    say = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(len(token) - 1, 0, -1):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append([say(token[:cut]), say(token[cut:])])
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {say(t): r for t, r in ranks.items()}, "merges": merges}
    split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": split, "post_processor": None, "decoder": split, "model": model})


class ByteBpe:
    """Encodes and decodes; ids are little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, model: str, pattern: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own would each hold memory
        self.tokenizer = Tokenizer.from_str(model)
        self.find = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(byte_table())}
        vocab = self.tokenizer.get_vocab()
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for shown, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in shown)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.cache_words, self.young, self.old = cache_words, {}, {}

    def _learn(self, words: set[str]) -> None:
        """Puts every one of the words into the young generation."""
        if len(self.young) + len(words) > self.cache_words:
            self.old, self.young = self.young, {}
        old, fresh = self.old, []
        for w in words:
            known = old.get(w)
            if known is None:
                fresh.append(w)
            else:
                self.young[w] = known
        for i in range(0, len(fresh), AT_ONCE):
            part = fresh[i : i + AT_ONCE]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.young[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.find(t) for t in texts]
        young = self.young
        if missing := {w for ws in words for w in ws if w not in young}:
            here = {w for ws in words for w in ws} if len(young) + len(missing) > self.cache_words else missing
            self._learn(here)
            young = self.young
        out = [b"".join([young[w] for w in ws]) for ws in words]
        for w in missing:
            if len(w) > KEPT_CHARS:
                del young[w]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids. A character that several tokens share is whole again once its tokens stand together; a text cut inside one decodes with errors="replace"."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last for each id; tokens that share a character both cover it."""
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.lengths[ids])
        return char[ends - self.lengths[ids]], char[ends - 1] + 1


_here: dict[tuple[int, str], ByteBpe] = {}


def _codec(model: str, pattern: str) -> ByteBpe:
    """One for each worker process, so that its cache outlives a task."""
    key = (hash(model), pattern)
    if key not in _here:
        _here[key] = ByteBpe(model, pattern)
    return _here[key]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    for at in range(0, batch.num_rows, SLICE):
        part = batch.slice(at, SLICE)
        yield part.column(0), part.column(1).to_pylist()


def encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str, offsets: bool = True) -> DataFrame:
    """One row for each row of df: its id, ids array<int> and, if asked for, starts and ends array<int> (character offsets)."""
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            for keys, texts in _texts(batch):
                ids = [np.frombuffer(x, dtype="<u4") for x in codec.encode(texts)]
                cols = [keys, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                if offsets:
                    spans = [codec.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                    cols += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "ids", "starts", "ends"][: len(cols)])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def decode(df: DataFrame, id_col: str, ids_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """One row for each row of df: its id, the decoded bytes, and text, where bytes that end inside a character become U+FFFD. Null ids count as none."""
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            raw = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], [id_col, "decoded", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, decoded binary, text string")


def round_trip(df: DataFrame, id_col: str, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes in one pass: id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes decoded from those ids)."""
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in batches:
            for keys, texts in _texts(batch):
                ids = codec.encode(texts)
                back = [hashlib.sha256(codec.decode(np.frombuffer(x, dtype="<u4").tolist())).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
