"""License scans by conditional compression.

Wordings are texts, headers, SPDX tags and the statements that a rule makes of names (see license_texts.py).
Around every word that licences use, a candidate block is cut from the text. Of the wordings of which it has enough words, all places are sought
where the words stand in order, however many of them are the share that counts: how many a stretch
of the template's length can match at most is counted exactly, and the stretches that may hold enough are
confirmed, best first, by the exact differences in wording. Each place is compressed by itself and with
the wording as a raw dictionary; where places of several wordings overlap, the one wins that makes its place
smaller by most, less what its differences in wording take to state, and the others are sought again in the
words that are left.

Defined results: a null or empty text has no findings, and neither has an empty table. Blocks overlap no
other, so a very long text is handled block by block. Rows are scanned one by one: repeated rows have
their findings each, and a null id is passed on. Columns other than the two named are not read. An id column
that bears the name of a result comes back as <name>_id.
"""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavefold.llm.common import own_id
from wavefold.llm.license_texts import templates

#: Words that open a candidate block.
ANCHOR = regex.compile(r"licen[sc]e|copyright|permission (?:is |to use)|redistributions? |public domain|free software|creative commons|spdx|software is provided|be useful|(?:released|distributed|available|published) under|under (?:the |a )?(?:apache|mit|isc|bsd|gnu|l?gpl|agpl|mozilla|mpl|eclipse|epl|eupl|cc[ -]by|cc0|wtfpl|unlicense|boost)\b", regex.I)
#: Characters before and after an anchor that belong to its block.
BEFORE, AFTER = 700, 900
#: Least share of a template's words found, less words put between them; words that may stand between without telling anything.
MIN_FOUND = 0.85
NEUTRAL = frozenset("a an the this that of and or terms conditions provisions its license licence licensed under v version international unported".split())
_WORD = regex.compile(r"[\p{L}\p{N}_]+(?:[.-][\p{N}]+)*")
_LEVEL = 3


def blocks(text: str) -> list[tuple[int, int]]:
    """Where candidate blocks begin and end; blocks that would touch are one."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        begin, end = max(0, m.start() - BEFORE), min(len(text), m.end() + AFTER)
        if out and begin <= out[-1][1]:
            out[-1][1] = end
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


class Template:
    """A wording's words and compressor. A place lies in a stretch of reach words: the wording's length and some slack at both ends."""

    def __init__(self, license_id: str, kind: str, text: str) -> None:
        self.key, self.text, self.words = (license_id, kind), text, [w.lower() for w in _WORD.findall(text)]
        self.slack = max(2, len(self.words) // 5)
        self.reach, self.need = len(self.words) + 2 * self.slack, ceil(MIN_FOUND * len(self.words))
        self.any = self.words.count("_")
        self.bits: dict[str, int] = {}
        for k, w in enumerate(self.words):
            self.bits[w] = self.bits.get(w, 0) | 1 << k

    @cached_property
    def compressor(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(self.text.encode("utf-8"), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def most(self, words: list[str], low: int) -> int:
        """How many of the wording's words the stretch from low on matches in order, at most."""
        full = left = (1 << len(self.words)) - 1
        for w in words[low : low + self.reach]:
            if at := self.bits.get(w):
                both = left & at
                left = (left + both | left - both) & full
        return len(self.words) - left.bit_count() + self.any

    def places(self, words: list[str], known: np.ndarray) -> list[tuple[int, int, int, list[str]]]:
        """All places of the wording, none overlapping another, as differences() has them; known: which words are any of the wording's."""
        until = np.concatenate([[0], np.cumsum(known)])
        lows = np.arange(len(words))
        lows = lows[until[np.minimum(lows + self.reach, len(words))] - until[:-1] >= self.need - self.any]
        queue = [(-n, low) for low in lows.tolist() if (n := self.most(words, low)) >= self.need]
        heapq.heapify(queue)
        free, out, failed = list(words), [], set()
        while queue:
            n, low = heapq.heappop(queue)
            now = self.most(free, low)
            if now < -n:  # some of its words are taken by now
                if now >= self.need:
                    heapq.heappush(queue, (-now, low))
                continue
            run = difflib.SequenceMatcher(None, self.words, free[low : low + self.reach], autojunk=False).find_longest_match()
            begins = [x for x in (low + run.b - run.a - self.slack, low) if x not in failed]
            matches = [m for begin in begins if (m := differences(self.words, free, begin)) and m[2] >= self.need]
            if matches:
                best = a, b, _, _ = max(matches, key=lambda m: (m[2], -len(m[3])))
                free[a:b] = [""] * (b - a)
                out.append(best)
                failed.difference_update(range(a - 2 * self.reach, b + self.reach))
                heapq.heappush(queue, (n, low))  # may hold another
            else:
                failed.update(begins)
        return out


class Pack:
    """All wordings, and which words of the pack each has how often."""

    def __init__(self) -> None:
        self.plain = zstandard.ZstdCompressor(level=_LEVEL, write_content_size=False)
        self.templates = [Template(*key, text) for key, texts in templates().items() for text in texts]
        self.ids = {w: k for k, w in enumerate(sorted({w for t in self.templates for w in t.bits}))}
        self.has = np.zeros((len(self.ids) + 1, len(self.templates)), dtype=np.int16)  # the last row: all other words
        for k, t in enumerate(self.templates):
            for w in t.words:
                self.has[self.ids[w], k] += 1
        self.need = np.array([t.need - t.any for t in self.templates])

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Wordings of which enough words are among those with the given ids."""
        return np.flatnonzero(self.has[np.unique(ids)].sum(axis=0) >= self.need)


@lru_cache(maxsize=1)
def _pack() -> Pack:
    return Pack()


def differences(template: list[str], words: list[str], begin: int) -> tuple[int, int, int, list[str]] | None:
    """The place that the template matches in the stretch from begin on: first and last word, template words found less words put between them (but for neutral ones), and what differs; None if nothing matches."""
    low = max(0, begin)
    part = words[low : max(low, begin + len(template) + 2 * max(2, len(template) // 5))]
    steps = difflib.SequenceMatcher(None, template, part, autojunk=False).get_opcodes()
    equal = [s for s in steps if s[0] == "equal"]
    if not equal:
        return None
    first, last = equal[0][3], equal[-1][4]
    found, said, put_in = sum(s[2] - s[1] for s in equal), [], 0
    for kind, a, b, c, d in steps:
        if kind != "equal" and (a < b or first <= c and d <= last):
            ours, theirs = template[a:b], part[c : min(d, c + b - a)] if d > last else part[c:d]
            if "_" in ours and set(ours) <= {"_"}:
                found += len(ours)
            else:
                said.append(f"-{' '.join(ours)} +{' '.join(theirs)}")
                put_in += max(0, sum(w not in NEUTRAL for w in theirs) - len(ours))
    return low + first, low + last, found - put_in, said


def scan(text: str) -> list[dict]:
    """The findings in a text."""
    pack = _pack()
    out = []
    for begin, end in blocks(text):
        block = text[begin:end]
        spans = [(m.start(), m.end()) for m in _WORD.finditer(block)]
        words = [block[a:b].lower() for a, b in spans]
        other = len(pack.ids)
        ids = np.array([pack.ids.get(w, other) for w in words], dtype=np.int64)
        sought = pack.candidates(ids) if len(ids) else ()
        while len(sought):
            ranked = []
            for k in sought:
                t = pack.templates[k]
                for match in t.places(words, pack.has[ids, k] > 0):
                    raw = block[spans[match[0]][0] : spans[match[1] - 1][1]].encode("utf-8")
                    gain = len(pack.plain.compress(raw)) - len(t.compressor.compress(raw))
                    ranked.append((sum(map(len, match[3])) - gain, len(match[3]), k, gain, match))
            taken, again = np.zeros(len(words), dtype=bool), set()
            for _, _, k, gain, (a, b, found, said) in sorted(ranked, key=lambda x: x[:3] + x[4][:2]):
                if taken[a:b].any():
                    again.add(k)
                    continue
                taken[a:b] = True
                license_id, kind = pack.templates[k].key
                out.append({"license": license_id, "wording": kind, "start": begin + spans[a][0], "end": begin + spans[b - 1][1], "gain": gain, "found": found / len(pack.templates[k].words), "n_differences": len(said), "differences": said})
            for at in np.flatnonzero(taken):
                words[at] = ""
            ids[taken] = other
            sought = sorted(again & set(pack.candidates(ids)))
    return sorted(out, key=lambda x: (x["start"], x["license"], x["wording"]))


@own_id("license", "wording", "start", "end", "gain", "found", "n_differences", "differences")
def scan_licenses(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each finding: id, license, wording, start and end (characters), gain (bytes by which the template makes the place smaller), found (share of the template's words), n_differences and differences."""
    fields = pa.struct([("license", pa.string()), ("wording", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gain", pa.int64()), ("found", pa.float64()), ("n_differences", pa.int64()), ("differences", pa.list_(pa.string()))])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    here = scan(text)
                    row += [k] * len(here)
                    found += here
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *pa.array(found, fields).flatten()], [id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, license string, wording string, `start` bigint, `end` bigint, gain bigint, found double, n_differences bigint, differences array<string>")
