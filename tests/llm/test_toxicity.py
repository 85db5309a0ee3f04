"""Toxicity: the grammar against plain rules, learning on held-out rows, odd tables."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from wavefold.llm import toxicity

SCHEMA = "doc_id long, text string, score string, lang string"


def found(text, stems=None):
    return dict(zip([*toxicity.KINDS, "distinct", "clauses", "words"], toxicity.matches(text, toxicity.Lexicon(toxicity.grow_stems({}, {}, 0, 0) if stems is None else stems)), strict=True))


def test_clauses_are_told_apart():
    kinds = {
        "What an idiot": "insult", "You are such an idiot": "aimed", "idiot that you are": "aimed", "he is not an idiot": "negated", "She said that this idiot": "reported",
        "I will kill you": "threat", "we kill time": "loose threat", "du bist kein idiot": "negated", "tu es un crétin": "aimed", "dijo que es un payaso": "reported",
        "The Idiots won": "insult",
    }
    for text, kind in kinds.items():
        got = found(text)
        assert {k for k in toxicity.KINDS if got[k] > 0} == {kind}, (text, got)
    assert found("You came. An idiot")["aimed"] == 0 and found("They said so. idiot")["reported"] == 0  # clauses end
    assert found("You, idiot! moron; scum")["clauses"] == 3
    assert not any(found("A plain text of no kind at all, 12 34.")[k] for k in [*toxicity.KINDS, "clauses"])


def plain(symbols):
    """Kinds of a clause by looking around each word."""
    out = dict.fromkeys(toxicity.KINDS, 0)
    reach_n, reach_t = toxicity.NEAR_NEGATION, toxicity.NEAR_TARGET
    used = set()
    for i, s in enumerate(symbols):
        if s not in "IH":
            continue
        if "N" in symbols[max(0, i - reach_n) : i]:
            kind = "negated" if s == "I" else "loose threat"
        elif "R" in symbols[:i]:
            kind = "reported" if s == "I" else "loose threat"
        elif s == "I":
            kind = "insult"
            if "T" in symbols[max(0, i - reach_t) : i]:
                kind = "aimed"
            else:
                used.add(i)
        else:
            used.add(i)
            kind = "loose threat"
        out[kind] += 1
    # A target aims what was read last: one insult within reach, one threat.
    for kind, aimed, symbol in (("insult", "aimed", "I"), ("loose threat", "threat", "H")):
        waiting = None
        for i, s in enumerate(symbols):
            if s == symbol and i in used:
                waiting = i
            if s == "T":
                if waiting is not None and i - waiting <= reach_t:
                    out[kind] -= 1
                    out[aimed] += 1
                waiting = None
    return out


def test_the_composed_table_equals_plain_rules():
    word = {"o": "xx", "I": "idiot", "H": "kill", "T": "you", "N": "not", "R": "said"}
    rng = random.Random(2)
    cases = [*itertools.product("oIHTNR", repeat=3), *(rng.choices("oooIHTNR", k=rng.randint(4, 12)) for _ in range(600))]
    for symbols in cases:
        if "".join(symbols).count("I") > 1:
            continue  # a word said again adds nothing
        got = found(" ".join(word[s] for s in symbols))
        unit = toxicity.Lexicon(toxicity.grow_stems({}, {}, 0, 0)).weight("idiot")
        want = plain("".join(symbols))
        assert all(np.isclose(got[k], want[k] * (unit if k in ("insult", "aimed", "negated", "reported") else 1)) for k in toxicity.KINDS), symbols


def test_composition_is_one_after_another():
    def run(t, symbols):
        state, out = 0, ""
        for s in symbols:
            state, more = t.arcs[state, s]
            out += more
        return out

    rng = random.Random(1)
    for _ in range(200):
        symbols = "".join(rng.choices("oIHTNR", k=15))
        want = symbols
        for t in (toxicity.negation(), toxicity.reported(), toxicity.target(), toxicity.threat()):
            want = run(t, want)
        assert run(toxicity.GRAMMAR, symbols) == want


def test_shared_stems_are_learnt_and_corrected():
    stems = toxicity.grow_stems({"blor": 40, "blora": 12, "blore": 12, "blor$": 4, "tion": 30}, {"blor": 6, "blor$": 40, "tion": 300}, 40, 400)
    lexicon = toxicity.Lexicon(stems)
    assert lexicon["blora"] == lexicon["blorzzz"] == ord("I") and lexicon["blor"] == ord("o") and lexicon["tion"] == ord("o")
    assert lexicon["idiots"] == ord("I")


def corpus(n=600):
    rng = random.Random(5)
    words = [a + b for a in ["ba", "ti", "lo", "re", "nu"] for b in ["ma", "ki", "so", "ve", "x", "qua"]]
    rows, labels = [], []
    for i in range(n):
        text, toxic = rng.choices(words, k=rng.randint(5, 60)), rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randint(0, len(text)), rng.choice(["Idiot", "grumpf" + rng.choice(["a", "en", "isch", "os"]), "scum"]))
        rows.append((i, " ".join(text).replace("x ", "x. "), "s", "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_rows(spark):
    rows, labels = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    # Labels of held-out rows are turned round: they must not be read.
    table = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("told", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.train(df, table, "doc_id", "text", "told")
    got = toxicity.score(df, "text", model).withColumn("held", toxicity.held_out("doc_id")).join(table, "doc_id").filter("held").collect()
    assert len(got) > 80 and np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = spark.createDataFrame([(1, None, "a", "en"), (2, "", "b", None), (2, "", "b", None), (None, "You idiot, moron, scum. You trash!", "c", "en"), (3, "idiot " * 50_000, "d", "en")], SCHEMA)
    model = toxicity.train(df, none, "doc_id", "text", "toxic")
    assert np.array_equal(model.weights, toxicity.BEGIN)
    got = toxicity.score(df, "text", model)
    assert got.columns == ["doc_id", "text", "lang", "score", "predicted", "matched"]
    rows = got.collect()
    assert len(rows) == 5 and rows[0]["score"] == rows[1]["score"] < 0.1 and rows[3]["predicted"] == 1
    assert toxicity.score(df.limit(0), "text", model).collect() == []
    twice = spark.createDataFrame([(1, 0), (1, 1), (1, None), (9, 1)], "doc_id long, toxic int")
    assert toxicity.train(df, twice, "doc_id", "text", "toxic").stems  # one labelled row, of one class
