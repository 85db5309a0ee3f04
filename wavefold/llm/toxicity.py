"""Toxicity by a weighted finite-state grammar of clauses.

A text is cut into clauses at `.,;:!?`, brackets, double quotes and line ends; words are runs of letters in lower case.
Five transducers read a clause one after another and are composed into one table beforehand:

* insult: reads a word letter by letter along a trie of stems and writes I with the weight of the longest stem (a log-odds
  against clean text), or the class of a threat (H), target (T), negation (N), verb of reporting (R) or other word (o);
* negation: insults and threats within 3 words behind a negation become negated ones;
* reported speech: those behind a verb of reporting become reported ones, to the end of the clause;
* target: an insult within 4 words of someone spoken to or of, before or behind it, is aimed;
* threat: a threat counts with someone it is aimed at, within 4 words behind it.

What a text matches is summed up by kind of clause and goes into a logistic score with a weight for each kind. Isolated
words thus count by how they are used; a negated or quoted insult needs more beside it than one that is aimed.

Learning. The fixed words below are where stems begin; labels add stems of 3 to 10 letters (inflected and invented
words share them) and correct those that clean texts use too: a stem's share of toxic documents is drawn towards that of the
stem one letter shorter. Documents that share the least hash of their runs of three words (copies) count once. The weights of the kinds are fitted, drawn towards fixed
ones, on scores that each half of the rows gets by stems of the other half. At most MAX_ROWS labelled rows are
read, chosen by a hash of their ids, and at most MAX_STEMS stems kept, those that most toxic documents have.

Defined results: a null or empty text matches nothing and has the score of that. Labels that are null are left out, of several for one document
the highest counts; without labels the fixed words and weights score. Whole texts are read, in time proportional to
their length. Repeated rows are scored each by itself, an empty table has no rows; df's own columns are kept, but for those
that bear the names of the results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavefold.llm.common import materialise, text_or_empty

# Words in English, German, French and Spanish.
INSULTS = """idiot moron stupid loser scum trash pathetic worthless disgusting clown fool imbecile garbage vermin filth jerk coward disgrace
    dummkopf trottel versager abschaum widerlich wertlos erbärmlich crétin imbécile abruti débile ordure minable dégoûtant
    imbécil estúpid basura escoria inútil patétic asqueros payaso perdedor""".split()
THREATS = """kill hurt destroy beat burn shoot stab crush töten töte umbringen vernichten verprügeln tuer tuerai frapper détruire brûler
    matar mataré golpear destruir quemar""".split()
TARGETS = """you your yours he she him her his they them their du dich dir dein ihr euch sie tu toi te vous votre il elle ils elles leur
    tú usted ustedes él ella ellos ellas""".split()
NEGATIONS = "not no never nor neither cannot don doesn isn aren wasn nicht kein keine nie niemals pas jamais aucun ni nunca jamás ningún".split()
REPORTS = """said says say told called claimed wrote quoted sagte sagt behauptet schrieb nannte dit disait appelé écrit affirme
    dijo dice llamó escribió afirma""".split()

MAX_ROWS, MAX_STEMS = 10_000, 20_000
SHORTEST, LONGEST_STEM = 3, 10
#: Tasks that read the labelled rows, and stems that one holds before it passes their counts on.
TASKS, HELD = 16, 200_000
_COUNTS = ("clean0", "clean1", "toxic0", "toxic1")
#: Documents that the shorter stem's share stands for; what a fixed insult has; least weight of a stem; fewest toxic documents with it.
DRAWN, FIXED_SHARE, LEAST, MIN_TOXIC = 4.0, 0.9, 2.0, 3
#: The shorter stem's share counts as this at most, as it was taken from the same documents.
DRAWN_TO = 0.99
NEAR_NEGATION, NEAR_TARGET = 3, 4
KINDS = ["insult", "aimed", "negated", "reported", "threat", "loose threat"]
#: Where the fit of the kinds' weights begins, and is drawn to: a constant, kinds, distinct insults, clauses, share of the words.
BEGIN = np.array([-3.0, 1.5, 2.0, 0.4, 0.4, 2.0, 0.1, 0.5, 0.5, 0.2])
RIDGE = 1.0
_TOKENS = re.compile(r"[^\W\d_]+|[.,;:!?\n\r()\[\]\"“”«»]").findall
_WORDS = re.compile(r"[^\W\d_]+").findall
_ENDS = frozenset('.,;:!?\n\r()[]"“”«»')
END = "$"


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) to (state, symbols written). State 0 begins."""

    arcs: dict[tuple[int, str], tuple[int, str]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes. States are numbered as they are reached."""
        symbols = {s for _, s in self.arcs}
        states, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
        while todo:
            a, b = pair = todo.pop()
            for symbol in symbols:
                a2, written = self.arcs[a, symbol]
                b2, out = b, ""
                for s in written:
                    b2, more = other.arcs[b2, s]
                    out += more
                if (a2, b2) not in states:
                    states[a2, b2] = len(states)
                    todo.append((a2, b2))
                arcs[states[pair], symbol] = (states[a2, b2], out)
        return Transducer(arcs)


#: Of one insult or threat each: plain, negated (n, m), reported (r, q); aimed ones (A, B), and an insult aimed by a later target (a).
_BEARERS = {"I": ("n", "r"), "H": ("m", "q")}


def negation() -> Transducer:
    arcs = {}
    for left in range(NEAR_NEGATION + 1):
        for s in "oIHTR":
            arcs[left, s] = (max(0, left - 1), _BEARERS[s][0] if left and s in _BEARERS else s)
        arcs[left, "N"] = (NEAR_NEGATION, "o")
    return Transducer(arcs)


def reported() -> Transducer:
    arcs = {}
    for inside in (0, 1):
        for s in "oIHTnm":
            arcs[inside, s] = (inside, _BEARERS[s][1] if inside and s in _BEARERS else s)
        arcs[inside, "R"] = (1, "o")
    return Transducer(arcs)


def target() -> Transducer:
    """Aimed insults, and threats left for the next one: a target stays a T."""
    n, arcs = NEAR_TARGET, {}
    for since in range(n + 1):  # words that a target still reaches
        for waiting in range(n + 1):  # words in which a target would aim an insult already read
            state = since * (n + 1) + waiting
            fewer = max(0, since - 1) * (n + 1)
            for s in "oHnmrq":
                arcs[state, s] = (fewer + max(0, waiting - 1), s)
            arcs[state, "I"] = (fewer + max(0, waiting - 1), "A") if since else (fewer + n, "I")
            arcs[state, "T"] = (n * (n + 1), "aT" if waiting else "T")
    return Transducer(arcs)


def threat() -> Transducer:
    """A threat with a target behind it is aimed."""
    arcs = {}
    for waiting in range(NEAR_TARGET + 1):
        for s in "oIAanmrq":
            arcs[waiting, s] = (waiting if s == "a" else max(0, waiting - 1), "" if s == "o" else s)
        arcs[waiting, "H"] = (NEAR_TARGET, "H")
        arcs[waiting, "T"] = (0, "B" if waiting else "")
    return Transducer(arcs)


GRAMMAR = negation().then(reported()).then(target()).then(threat())
_KIND = {"I": 0, "A": 1, "n": 2, "r": 3, "B": 4, "H": 5, "m": 5, "q": 5}


class Lexicon(dict):
    """The insult transducer: a word's class, as one symbol, and for insults their weight. stems: weights by stem, whole words ending in $."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self.weights, self.longest = stems, {}, max(map(len, stems), default=0)
        self.fixed = {w: s for s, words in (("H", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}
        super().__init__(dict.fromkeys(_ENDS, 46))

    def weight(self, word: str) -> float:
        for k in range(min(len(word) + 1, self.longest), SHORTEST - 1, -1):
            found = self.stems.get((word + END)[:k])
            if found is not None:
                return found
        return 0.0

    def __missing__(self, word: str) -> int:
        symbol = self.fixed.get(word)
        if symbol is None:
            weight = self.weight(word)
            symbol = "I" if weight >= LEAST else "o"
            if weight >= LEAST and len(self.weights) < 100_000:
                self.weights[word] = weight
        if len(self) < 200_000 and len(word) <= 40:
            self[word] = ord(symbol)
        return ord(symbol)


def matches(text: str, lexicon: Lexicon) -> np.ndarray:
    """What the grammar finds in a text: weights by kind, distinct insults, clauses that match, words."""
    tokens = _TOKENS(text.lower())
    classes = bytes(map(lexicon.__getitem__, tokens))
    found, insults = np.zeros(len(KINDS) + 3), set()
    found[-1] = len(tokens)
    if b"I" not in classes and b"H" not in classes:
        return found
    at = 0
    for clause in classes.decode("ascii").split("."):
        if "I" in clause or "H" in clause:
            state, last, before = 0, 0.0, found[: len(KINDS)].sum()
            for k, symbol in enumerate(clause):
                weight = 1.0
                if symbol == "I":
                    word = tokens[at + k]
                    # A word said again adds nothing: junk repeats one word without end.
                    weight = last = 0.0 if word in insults else lexicon.weights.get(word) or lexicon.weight(word)
                    insults.add(word)
                state, out = GRAMMAR.arcs[state, symbol]
                for s in out:
                    if s == "a":  # the insult already counted as a plain one
                        found[0] -= last
                        found[1] += last
                    elif s == "B":  # so with the threat
                        found[5] -= 1.0
                        found[4] += 1.0
                    else:
                        found[_KIND[s]] += weight
            found[-2] += found[: len(KINDS)].sum() > before
        at += len(clause) + 1
    found[-3] = len(insults)
    return found


def features(found: np.ndarray) -> np.ndarray:
    """Rows of matches as columns of the score: a constant, kinds, distinct insults, clauses, share of the words."""
    total = found[:, :4].sum(axis=1)
    return np.column_stack([np.ones(len(found)), np.log1p(np.maximum(found[:, :-1], 0)), np.log1p(100 * total / (found[:, -1] + 20))])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Logistic weights by Newton's steps, drawn towards BEGIN."""
    w = BEGIN.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - BEGIN)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def stems_of(words: set[str]) -> set[str]:
    """What the words of a document can begin with, whole words too."""
    return {(w + END)[:k] for w in words for k in range(SHORTEST, min(len(w) + 1, LONGEST_STEM) + 1)}


def copy_of(words: list[str]) -> int:
    """The least hash of three words in a row, which copies of a text mostly share."""
    runs = zip(words, words[1:], words[2:], strict=False) if len(words) > 2 else [tuple(words)]
    return min(xxhash.xxh3_64_intdigest(" ".join(r)) for r in runs) - (1 << 63)


def grow_stems(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of stems from the documents that have them. Longer stems follow shorter ones, whose share they are drawn to."""
    scale = n_toxic / n_clean if n_toxic and n_clean else 1.0
    shares: dict[str, float] = {}
    out = {w: float(np.log(FIXED_SHARE / (1 - FIXED_SHARE))) for w in INSULTS}
    fixed = set(INSULTS)
    for stem in sorted({*toxic, *INSULTS}, key=lambda s: (len(s), s)):
        a, c = toxic.get(stem, 0), clean.get(stem, 0) * scale
        short = stem[:-1]
        prior = FIXED_SHARE if stem in fixed else min(max(shares.get(short, 0.5), 1 - DRAWN_TO), DRAWN_TO)
        share = (a + DRAWN * prior) / (a + c + DRAWN)
        shares[stem] = share
        weight, inherited = float(np.log(share / (1 - share))), out.get(short)
        if stem in fixed or (a >= MIN_TOXIC and (weight >= LEAST or inherited is not None)):
            out[stem] = weight
        elif inherited is not None:
            out[stem] = inherited
    return {s: w for s, w in out.items() if out.get(s[:-1]) != w}


@dataclass(frozen=True)
class Model:
    stems: dict[str, float]
    weights: np.ndarray


def held_out(id_col: str) -> Column:
    """Whether a document's labels are kept from learning."""
    return F.crc32(text_or_empty(id_col)) % 5 == 0


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = MAX_ROWS) -> Model:
    """Learns from at most max_rows labelled rows of df that aren't held out, those with the least hash of their id."""
    rated = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = rated.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id").limit(max_rows)  # at most max_rows ids

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = [copy_of(_WORDS(t.as_py().lower())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copies, pa.int64())], ["text", "toxic", "copy"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, ...] = tuple(Counter() for _ in _COUNTS)  # clean and toxic ones by half

        def out() -> pa.RecordBatch:
            stems = sorted(set().union(*seen))
            batch = pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), *(pa.array([c[s] for s in stems], pa.int64()) for c in seen)], ["stem", *_COUNTS])
            for c in seen:
                c.clear()
            return batch

        for batch in batches:
            for text, toxic, copy in zip(*batch.columns, strict=True):
                seen[2 * toxic.as_py() + copy.as_py() % 2].update(stems_of(set(_WORDS(text.as_py().lower()))))
                if sum(map(len, seen)) > HELD:
                    yield out()
        yield out()

    one = Window.partitionBy("copy", "toxic").orderBy(F.length("text"), F.xxhash64("text"))
    marked = sample.select("text", "toxic").repartition(TASKS).mapInArrow(mark, "text string, toxic boolean, copy long").withColumn("first", F.row_number().over(one) == 1)
    marked = materialise(marked.repartition(TASKS), "toxicity-sample")
    distinct = marked.filter("first").select("text", "toxic", "copy")
    half = 2 * F.col("toxic").cast("int") + F.pmod("copy", F.lit(2))
    sizes = distinct.agg(*(F.count_if(half == k).alias(c) for k, c in enumerate(_COUNTS))).first()
    counts = distinct.mapInArrow(count, "stem string, " + ", ".join(f"{c} long" for c in _COUNTS)).groupBy("stem").agg(*(F.sum(c).alias(c) for c in _COUNTS)).filter(F.col("toxic0") + F.col("toxic1") >= MIN_TOXIC)
    rows = counts.orderBy(F.desc(F.col("toxic0") + F.col("toxic1")), "stem").limit(MAX_STEMS).collect()  # of bounded length, as stems are

    def learn(half: tuple[int, ...]) -> dict[str, float]:
        toxic, clean = ({r["stem"]: sum(r[f"{k}{h}"] for h in half) for r in rows} for k in ("toxic", "clean"))
        n_toxic, n_clean = (sum(sizes[f"{k}{h}"] or 0 for h in half) for k in ("toxic", "clean"))
        return grow_stems({s: n for s, n in toxic.items() if n}, clean, n_toxic, n_clean)

    of_other = (learn((1,)), learn((0,)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(s) for s in of_other]
        for batch in batches:
            found = [matches(text.as_py(), lexicons[copy.as_py() % 2]).tolist() for text, copy in zip(batch.column(0), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["toxic", "found"])

    seen = marked.select("text", "toxic", "copy").mapInArrow(score, "toxic boolean, found array<double>").collect()  # at most max_rows rows of nine numbers
    if not any(r["toxic"] for r in seen) or all(r["toxic"] for r in seen):
        return Model(learn(()), BEGIN)
    return Model(learn((0, 1)), fit(features(np.array([r["found"] for r in seen])), np.array([float(r["toxic"]) for r in seen])))


def score(df: DataFrame, text_col: str, model: Model) -> DataFrame:
    """df with score, the probability of label 1, predicted, and the weights of the matched clauses by kind."""
    names = ["score", "predicted", "matched"]
    own = [c for c in df.columns if c not in names or c == text_col]
    at = own.index(text_col)
    kinds = T.StructType([T.StructField(k.replace(" ", "_"), T.DoubleType()) for k in KINDS])
    schema = T.StructType([*(df.schema[c] for c in own), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("matched", kinds)])
    shared = df.sparkSession.sparkContext.broadcast((model.stems, model.weights))  # at most MAX_STEMS short stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems, weights = shared.value
        lexicon = Lexicon(stems)
        for batch in batches:
            found = np.array([matches(t.as_py() or "", lexicon) for t in batch.column(at)]).reshape(-1, len(KINDS) + 3)
            p = 1 / (1 + np.exp(-np.clip(features(found) @ weights, -30, 30)))
            by_kind = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(KINDS))], [f.name for f in kinds])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), by_kind], schema.names)

    return df.select(*own).mapInArrow(run, schema)
