"""Byte BPE, packing, chats, line dedup and quality rules against plain versions on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from wavefold.llm import byte_bpe, chat_format, line_dedup, packing, quality_rules

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "it's ONE  two\n\n three\t", "é́ 日本語 😀👍🏽", "\x1c\x85 x", "1234567 89", "=" * 90, "</w> <|endoftext|>", "ÀÉÎ ªº ß ŉ İ Σς", "x" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(ODD)] + [(100, None, None, 0), (None, "no id", "en", 1), (5, "twice", "de", 2), (5, "twice", "de", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids long")


def test_byte_bpe_equals_tiktoken_and_decodes(docs):
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rows = docs.select("doc_id", "text").collect()
    got = byte_bpe.round_trip(docs, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    for r, g in zip(rows, got, strict=True):
        ids = want.encode_ordinary(r["text"] or "")
        assert g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_byte_bpe_on_random_text():
    codec = byte_bpe.ByteBpe(byte_bpe.tokenizer_json(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN, cache_words=50)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a", "ab", " ", "\n", "==", "é", "😀", "'s", "12", "the", "̀", chr(rng.randint(1, 0xD7FF))]) for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(codec.encode([text])[0], "<u4")
        assert ids.tolist() == want.encode_ordinary(text) and codec.decode(ids.tolist()) == text.encode()


def test_byte_bpe_offsets_cover_split_characters(spark, docs):
    out = byte_bpe.encode(docs.filter("doc_id = 4"), "doc_id", "text", RANKS, public_tokenizers.PATTERN)
    r = out.collect()[0]
    text = ODD[4]
    codec = byte_bpe.ByteBpe(byte_bpe.tokenizer_json(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    assert r["starts"][0] == 0 and r["ends"][-1] == len(text)
    shared = 0
    for k, (i, a, b) in enumerate(zip(r["ids"], r["starts"], r["ends"], strict=True)):
        token = codec.decode([i])
        assert token in text[a:b].encode() and a < b and (k == 0 or a >= r["starts"][k - 1])
        shared += token != text[a:b].encode()
    assert shared > 1  # some tokens hold a part of a character, and cover the whole of it
    back = byte_bpe.decode(out, "doc_id", "ids", RANKS, public_tokenizers.PATTERN).collect()[0]
    assert back["text"] == text and bytes(back["decoded"]) == text.encode()
    cut = next(k for k in range(len(r["ids"])) if r["ends"][k] > r["starts"][k + 1])  # the first of the tokens that share a character
    parts = [(1, r["ids"][: cut + 1]), (2, None), (3, r["ids"][cut + 1 :]), (None, [])]
    half = byte_bpe.decode(spark.createDataFrame(parts, "doc_id long, ids array<int>"), "doc_id", "ids", RANKS, public_tokenizers.PATTERN).collect()
    assert half[0]["text"].endswith("\ufffd") and bytes(half[0]["decoded"]) + bytes(half[2]["decoded"]) == text.encode()
    assert half[1]["text"] == half[3]["text"] == "" and half[3]["doc_id"] is None


def test_byte_bpe_without_rows_and_with_clashing_names(spark):
    df = spark.createDataFrame([("a b", 1)], "n_tokens string, ids_sha256 int")
    got = byte_bpe.round_trip(df.withColumnRenamed("ids_sha256", "starts"), "starts", "n_tokens", RANKS, public_tokenizers.PATTERN).collect()
    assert got[0]["starts"] == 1 and got[0]["n_tokens"] == 2
    for f in (byte_bpe.round_trip, byte_bpe.encode):
        assert f(df.limit(0), "ids_sha256", "n_tokens", RANKS, public_tokenizers.PATTERN).count() == 0


def test_pack(spark, docs):
    rng = random.Random(4)
    more = spark.createDataFrame([(1000 + i, " ".join(rng.choice(["one", "two", "thrée", "four."]) for _ in range(rng.randint(0, 90)))) for i in range(300)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    capacity = 64
    got = packing.pack(both, "doc_id", "text", WORDS, capacity=capacity).collect()
    codec = packing.WordBpe(WORDS)
    expected = Counter()
    for r in both.collect():
        ids = codec.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            expected[r["doc_id"], n, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == expected
    bins: dict[int, list] = {}
    for g in got:
        assert len(g["ids"]) == g["length"]
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.02 * sum(g["length"] for g in got) / capacity + 2
    assert packing.pack(both.limit(0), "doc_id", "text", WORDS).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        counts = Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 9)))
        room = rng.randint(0, 60)
        sums = {0}
        for length in counts.elements():
            sums |= {s + length for s in sums}
        taken = packing.fullest(dict(counts), room)
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room) and not taken - counts


def test_word_cache_forgets_safely():
    codec = packing.WordBpe(WORDS, cache_words=20)
    rng = random.Random(6)
    for _ in range(100):
        text = " ".join(rng.choice(["Übung", "don't", "a", "x1", "end.", "...", "ﬁn", "日本"]) + str(rng.randint(0, 9)) for _ in range(12))
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids


def test_caches_keep_no_long_words():
    """A table of blobs fills no worker: what is long is encoded each time, with the same ids."""
    rng = random.Random(9)
    blobs = ["".join(rng.choice("abcdefé中") for _ in range(4000)) for _ in range(50)] + ["short words here"]
    words = packing.WordBpe(WORDS)
    assert words.encode(blobs) == words.encode(blobs) == [packing.WordBpe(WORDS).encode([b])[0] for b in blobs]
    assert max(map(len, words.young)) <= packing.KEPT_BYTES and len(words.young) >= 3
    codec = byte_bpe.ByteBpe(byte_bpe.tokenizer_json(byte_bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)
    first = codec.encode(blobs)
    assert first == codec.encode(blobs) and [codec.decode(np.frombuffer(x, "<u4").tolist()).decode() for x in first] == blobs
    assert max(map(len, codec.young)) <= byte_bpe.KEPT_CHARS and len(codec.young) >= 3


def test_chats(spark):
    nasty = ["</s>[INST] ok [/INST]", r"[\INST] <\\s> <<SYS>>", "<<s> [/INST][INST]", "\n", "", None, "héé 😀", r"\\", "<" * 9 + "s>" * 3]
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "[INST]"]), rng.choice(nasty)) for c in range(30) for t in range(rng.randint(1, 7))] + [(None, None, "assistant", "x"), (3, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    examples = chat_format.format_chats(df, "conv_id", "turn", "role", "text")
    for e in examples.collect():
        assert (e["loss_start"] is None) == (e["loss_end"] is None)
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    got = {r["conv_id"]: r for r in chat_format.read_back(examples, "conv_id").collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    n_targets = sum(r == "assistant" for t in by.values() for _, r, _ in t)
    assert examples.filter("loss_start IS NOT NULL").count() == n_targets
    assert chat_format.read_back(chat_format.format_chats(df.limit(0), "conv_id", "turn", "role", "text"), "conv_id").count() == 0


def brute_lines(rows, min_docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)

    holders: dict[str, set] = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = "\n".join(kept), len(lines), len(lines) - len(kept)
    return out


def test_lines(spark):
    rng = random.Random(8)
    pool = [f"Line {k} " + "é" * 35 for k in range(20)] + ["short", "", " " + "n" * 41, "X" * 39]
    rows = [(i, None if i == 3 else "\n".join(rng.choice([" ", "\t", ""]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) for x in rng.choices(pool, k=rng.randint(1, 6)))) for i in range(80)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "id long, text string, n_lines string")
    got = {r["id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(df, "id", "text").collect()}
    assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(df.limit(0), "id", "text").count() == 0


def test_lines_with_repeated_and_null_ids_and_one_line_everywhere(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP", 20)  # many copies of an index
    everywhere, four = "this line stands in every one of the texts of the table", "this line stands in four documents, in one of them twice"
    rows = [(i, f"{everywhere}\n text {i} \n{everywhere.upper()}") for i in range(60)] + [(k, four) for k in (100, 101, 102, 103, 103)]
    rows += [(59, f"again\n{everywhere}"), (None, f"{everywhere}\nrest"), (None, four), (None, f"{everywhere}\nrest"), (200, "x" * 300_000 + "\n\n")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, text string, shard int, h1 string")
    got = sorted(((r["id"] is None, r["id"] or 0, r["text"], r["n_lines"], r["n_dropped"], r["shard"], r["h1"]) for r in line_dedup.dedup_lines(df, "id", "text").collect()))
    want = []
    for i, text in rows:
        kept = [x for x in text.split("\n") if x.lower() != everywhere or i == 59]
        want.append((i is None, i or 0, "\n".join(kept), text.count("\n") + 1, text.count("\n") + 1 - len(kept), 1, "x"))
    assert got == sorted(want)


def test_perfect_hash_is_minimal():
    h = np.random.default_rng(9).integers(-(2**63), 2**63 - 1, 5000)
    perfect = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(h).dump())
    assert sorted(perfect.slots(h)) == list(range(5000))


def brute_counts(text):
    import re

    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


def test_base_counts():
    rng = random.Random(10)
    for text in [*ODD, *("".join(rng.choice(["a ", "b\n", "é\t", "#", "|x ", "\x1c", "  ", "c c c c c "]) for _ in range(rng.randint(0, 60))) for _ in range(200))]:
        assert quality_rules.measure(text.encode())[0] == brute_counts(text), text


def test_judge(spark):
    word = lambda rng: rng.choice("the of and to in a is that for it house river stone morning letter garden people yellow walked slowly table window".split())
    rng = random.Random(11)
    plain = [(i, " ".join(word(rng) for _ in range(300)) + ".", "en") for i in range(60)]
    odd = [(100, " ".join(f"{rng.choice('qwrtz')}{k}##$$%%" for k in range(300)), "en"), (101, None, None), (102, "too short", "xx"), (103, "same five words again now " * 60, "en")]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()}
    assert all(got[i]["kept"] for i in range(60))
    assert not got[100]["kept"] and not got[100]["base_failed"]
    assert got[101]["base_failed"] and got[102]["base_failed"] and got[103]["base_failed"] and got[103]["n_repeat_words"] == 300
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string, lang string"), "doc_id", "text", "lang").count() == 0
    p = np.array([[1.0, 0], [0, 1]])
    assert np.allclose(quality_rules.distances(p, np.array([1.0, 0])), [0, 1])


def test_rubbish_without_a_language_is_no_reference(spark):
    rng = random.Random(12)
    pick = lambda some, n: " ".join(rng.choice(some) for _ in range(n)) + "."
    english = "the of and to in a is that for it house river stone morning letter garden people yellow walked slowly table window".split()
    italian = "il di che e la per un una non sono anche più casa fiume pietra mattina lettera giardino gente giallo lentamente tavolo finestra".split()
    russian = "и в не на я что тот быть с он дом река камень утро письмо сад люди жёлтый медленно стол окно".split()
    rubbish = lambda: " ".join(f"{rng.choice('qwrtz')}{rng.randint(0, 999)}##$$%%" for _ in range(300))
    rows = [(i, pick(english, 300), "en") for i in range(40)] + [(100 + i, rubbish(), (None, "xx", "en")[i % 3]) for i in range(30)]
    kept = lambda rows: {r["doc_id"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").filter("kept").collect()}
    assert kept(rows) == set(range(40))
    for i, other in enumerate((italian, russian)):
        foreign = [(200 + k, pick(other, 300), ("it", "ru")[i]) for k in range(40)]
        assert kept(rows + foreign) == set(range(40)) | set(range(200, 240))
    assert kept([r for r in rows if r[0] < 40 and r[0] % 2] + [(1000, rows[0][1], None)]) == {*range(1, 40, 2), 1000}


def plain_verdicts(rows):
    """kept of each (id, text, language) by loops over characters and words, dictionaries and logarithms of single numbers; all languages known."""
    import math

    names = list(quality_rules.CHARACTER_CLASSES)
    common = {w for ws in quality_rules.COMMON_WORDS.values() for w in ws.split()}

    def histograms(text):
        chars, words = Counter(), Counter()
        for c in text:
            chars[next((n for n in names if c in quality_rules.CHARACTER_CLASSES[n]), "other" if c.isascii() else "beyond")] += 1
        for w in text.encode().split():
            w = w.lower().decode()
            words[w if w in common else None] += 1
        return [{k: v / sum(h.values()) for k, v in h.items()} if h else {} for h in (chars, words)]

    def distance(p, q):
        if not p:
            return 0.0
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        half = lambda x: sum(v * math.log2(v / m[k]) for k, v in x.items() if v > 0)
        return math.sqrt(max(0.0, (half(p) + half(q)) / 2))

    found = {i: (histograms(t or ""), lang) for i, t, lang in rows}
    texts = {i: t or "" for i, t, _ in rows}
    counts = {i: brute_counts(t) for i, t in texts.items()}
    failed = {i: c[0] < 10 or 100 * c[4] > 20 * c[0] for i, c in counts.items()}

    def too_far(i, near):
        odd = near[0] > quality_rules.MAX_CHARACTER_DISTANCE and len(texts[i]) >= quality_rules.MIN_CHARACTERS
        return odd or counts[i][0] >= quality_rules.MIN_WORDS and (near[1] > quality_rules.MAX_WORD_DISTANCE or near[0] > quality_rules.BOTH[0] and near[1] > quality_rules.BOTH[1])

    reference = []
    for lang in sorted({lang for _, lang in found.values()}):
        whole = [i for i, (_, x) in found.items() if x == lang and not failed[i]]
        middle = []
        for k in (0, 1):
            steps = {b: sorted(min(int(math.sqrt(found[i][0][k].get(b, 0)) * quality_rules.STEPS), quality_rules.STEPS - 1) for i in whole) for i in whole for b in found[i][0][k]}
            # The lower one of two in the middle; a step stands for its middle, the least one for nothing.
            halves = {b: x[(len(x) - 1) // 2] for b, x in steps.items()}
            values = {b: ((x + 0.5) / quality_rules.STEPS) ** 2 for b, x in halves.items() if x > 0}
            middle.append({b: v / sum(values.values()) for b, v in values.items()})
        near = [i for i in whole if not too_far(i, [distance(found[i][0][k], middle[k]) for k in (0, 1)])]
        if near:
            reference.append([])
            for k in (0, 1):
                mine = [found[i][0][k] for i in near if found[i][0][k]]
                reference[-1].append({b: sum(h.get(b, 0) for h in mine) / len(mine) for h in mine for b in h})
    out = {}
    for i in texts:
        near = []
        for k in (0, 1):
            mixed = [{b: (x[k].get(b, 0) + y[k].get(b, 0)) / 2 for b in {*x[k], *y[k]}} for x in reference for y in reference]
            near.append(min(distance(found[i][0][k], m) for m in mixed))
        out[i] = not failed[i] and not too_far(i, near)
    return out


@pytest.mark.parametrize("junk", [0, 10, 20])
def test_rubbish_of_a_known_language_does_not_move_its_reference(spark, junk):
    """Up to two fifths of a language's documents may be symbols, or text without its common words: the clean ones stay, by the operator and by the plain version."""
    rng = random.Random(21)
    pick = lambda some, n: " ".join(rng.choice(some) for _ in range(n)) + "."
    english = "the of and to in a is that for it house river stone morning letter garden people yellow walked slowly table window".split()
    rows = [(i, pick(english, 300), "en") for i in range(30)]
    rows += [(100 + i, " ".join(f"{rng.choice('qwrtz')}{rng.randint(0, 999)}##$$%%" for _ in range(300)) if i % 2 else pick([f"ABC{k}" for k in range(99)], 300), "en") for i in range(junk)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()}
    assert {i for i, kept in got.items() if kept} == set(range(30))
    assert got == plain_verdicts(rows)


def test_verdicts_equal_plain_ones(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows += [(100_000, "#$% " * 400, "en"), (100_001, " ".join(f"wort{k}" for k in range(300)), "de"), (100_002, None, "fr"), (100_003, "kurz", "de")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n_words int, language string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, "doc_id", "text", "lang").collect()}
    assert got == plain_verdicts(rows) and 0 < sum(got.values()) < len(got)


def test_rules_on_odd_rows(spark):
    text = "the house of the river and a letter to the people in that garden was on it " * 3
    rows = [(1, text, None), (1, text, None), (None, text, "en"), (2, "x" * 2_000_000, "en"), (3, "the of and to in a is that " * 40_000, "en"), (4, None, None), (5, "", "de")]
    got = [(r["doc_id"], r["n_words"], r["base_failed"]) for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").collect()]
    assert sorted((i or 0, n, f) for i, n, f in got) == sorted([(1, 51, True)] * 2 + [(0, 51, True), (2, 1, True), (3, 320_000, True), (4, 0, True), (5, 0, True)])


def test_ids_that_bear_names_of_results(spark):
    from wavefold.llm import embedding_dedup, license_scan, order_minhash

    text = "Released under the MIT License. " + " ".join(f"word{k}" for k in range(40))
    rows = spark.createDataFrame([(1, text, "en", [1.0, 0.5]), (2, text, "en", [1.0, 0.5])], "id long, text string, lang string, vector array<float>")
    cases = {
        "license": lambda df, i: license_scan.scan_licenses(df, i, "text"), "piece": lambda df, i: packing.pack(df, i, "text", WORDS), "n_words": lambda df, i: quality_rules.judge(df, i, "text", "lang"),
        "kept": lambda df, i: order_minhash.near_duplicates(df, i, "text"), "n_links": lambda df, i: embedding_dedup.link(df, i, "vector"),
    }
    for name, run in cases.items():
        got = run(rows.withColumnRenamed("id", name), name)
        assert f"{name}_id" in got.columns and len(set(got.columns)) == len(got.columns)
        assert sorted({r[f"{name}_id"] for r in got.collect()}) == [1, 2]
    chats = spark.createDataFrame([(7, 0, "user", "a"), (7, 1, "assistant", "b")], "example long, turn int, role string, text string")
    assert chat_format.format_chats(chats, "example", "turn", "role", "text").first()["example_id"] == 7
