"""The operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import chat, components, decontamination, language_model, line_dedup, mixing, near_dedup, quality_model, quality_rules, substring_dedup, token_output

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon été über".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mix_size string, sig string, kept string, did string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    rng = random.Random(11)
    texts = [None, "", "   ", "one two", "One TWO", "\n", prose(rng, 20_000)]
    base = prose(rng, 120)
    texts += [base, base, base.replace("alpha", "ALPHA")]
    for _ in range(8):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = prose(rng, 90)
    texts += [prose(rng, 60) + " " + passage + " " + prose(rng, 60) for _ in range(4)]
    texts += ["Ai. " * 300, "Ai. " * 300 + "x", prose(rng, 70) + "\n" + "Same line of text here\n" * 3]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(25)]
    rows = [(i, t, "en", [None, "a", "b", "b", "b"][i % 5], 0, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return [*rows, rows[12], (None, "no id " * 60, None, None, None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- 1


def test_mix(docs, none):
    mixed = mixing.mix(docs).cache()
    rows = mixed.collect()
    assert len(rows) == len(ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    weight = dict(zip(order, (5, 2, 1), strict=False))
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    for r in rows:
        assert r.mix_source_size == sizes[r.source] and math.isclose(r.mix_target, target[r.source])
        rate = r.mix_target / r.mix_source_size
        assert math.floor(rate) <= r.mix_copies <= min(2, math.floor(rate) + 1)
    assert mixing.emit(mixed).columns == [c for c in docs.columns if c != "mix_size"]
    assert mixing.emit(mixed).count() == sum(r.mix_copies for r in rows)
    assert mixing.mix(none).count() == 0


# ---- 2


def test_quality_model(spark, none):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(240)] + [(999, None), (998, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality_model.score(table, labels).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 40 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality_model.score(table, flipped).collect()} == {r.doc_id: r.score for r in got}
    assert {r.score for r in quality_model.score(table, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score(none, labels).count() == 0


def test_vectors_and_pooling(spark, monkeypatch):
    """Word vectors, pooling weights, features and scores by their definitions; very long texts, repeated rows, clashing columns."""
    rng = random.Random(22)
    texts = [None, "", " \n", "one", "one two", prose(rng, 12_000), *(prose(rng, rng.randrange(1, 80)) for _ in range(60))]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(8, texts[8], "x", 1.0), (None, texts[9], "x", 1.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, pooled string, score double").repartition(3)
    row = lambda w: quality_model.Buckets()[w.encode()]
    sums, seen = np.zeros((quality_model.VOCABULARY, quality_model.WIDTH)), Counter()
    for _, t, *_ in rows:
        ids = [row(w) for w in words(t)]
        seen.update(ids)
        for i, a in enumerate(ids):
            for j in range(max(0, i - quality_model.REACH), min(len(ids), i + quality_model.REACH + 1)):
                if j != i:
                    for k in (0, 1):
                        sums[a, quality_model._PLACES[k][ids[j]]] += quality_model._SIGNS[k][ids[j]]
    total = sum(seen.values())
    unit = {a: sums[a] / max(np.sqrt((sums[a] ** 2).sum()), 1e-9) for a in seen}
    weight = {a: quality_model.COMMON / (quality_model.COMMON + n / total) for a, n in seen.items()}
    vectors, weights = quality_model.word_vectors(table)
    assert set(np.flatnonzero(vectors.any(axis=1))) <= set(seen) and len(seen) > 500
    assert all(np.allclose(vectors[a], unit[a], atol=1e-5) and math.isclose(weights[a], weight[a], rel_tol=1e-5) for a in seen)

    def features(t):
        ids = [row(w) for w in words(t)]
        if not ids:
            return np.zeros(quality_model.FEATURES)
        share = np.array([weight[a] for a in ids])
        share /= share.sum()
        v = np.array([unit[a] for a in ids])
        mean = (share[:, None] * v).sum(axis=0)
        return np.concatenate([mean, np.sqrt((share[:, None] * (v - mean) ** 2).sum(axis=0))])

    labels = spark.createDataFrame([(i, i % 2, "y", 0.5) for i in range(len(texts))] + [(8, 1, "y", 0.5)], "doc_id long, quality int, text string, score double")
    _, network = quality_model.fit(table.select("doc_id", "text"), labels)
    got = quality_model.score(table, labels).collect()
    assert len(got) == len(rows)
    by_id = dict(enumerate(texts)) | {None: texts[9]}
    for r in got:
        x = features(by_id[r.doc_id])
        hidden = np.tanh((x - network.mean) / network.scale @ network.w1 + network.b1)
        logit = float((hidden @ network.w2 + network.b2)[0]) / network.temperature
        assert math.isclose(r.score, 1 / (1 + math.exp(-logit)), abs_tol=1e-3)


# ---- 3


def shingle_set(text):
    w = words(fold(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, percent):
    ids = [(r[0], shingle_set(r[1])) for r in ROWS]
    group = {i: i for i, _ in ids if i is not None}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in ids:
        for j, b in ids:
            if i is not None and j is not None and i < j and a & b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    want = sorted((i if i is not None else -1, len(s), root(i) if i is not None else -1, i is None or root(i) == i) for i, s in ids)
    got = near_dedup.near_duplicates(docs, percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in got) == want


@pytest.mark.parametrize(("chunk", "size"), [(40, 1 << 25), (2048, 40_000)])
def test_a_crowd_is_joined_by_confirmed_links(spark, monkeypatch, chunk, size):
    """A family around one text: some are linked with it alone, some only with a partner, the others with nothing. Chunks by number and by bytes."""
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    monkeypatch.setattr(near_dedup, "CHUNK_BYTES", size)
    rng = random.Random(17)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def changed(words_, k):
        w = list(words_)
        for i in rng.sample(range(len(w)), k):
            w[i] = f"x{rng.randrange(10**6)}"
        return w

    texts = [base, *(changed(base, 3) for _ in range(90)), *(changed(base, 5) for _ in range(60))]
    texts += [changed(t, 2) for t in texts[-20:]]
    sets = [shingle_set(" ".join(t)) for t in texts]
    group = list(range(len(texts)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 85).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert 40 < len(set(got.values())) < 100
    sigs = near_dedup.signed(docs).select(F.col("doc_id").alias("id"), "sig", F.col("n_shingles").alias("n"), F.col("doc_id").alias("component"))
    links = near_dedup.crowded(docs, sigs.cache(), 85, near_dedup.least_depth(85)).collect()
    assert all(100 * len(sets[r.a] & sets[r.b]) >= 85 * len(sets[r.a] | sets[r.b]) for r in links)
    assert len(links) < 20 * len(texts)  # a cell's links are fewer than its classes, not its pairs


def test_several_texts_under_one_id(spark):
    """In any order of rows and partitions the same of a doc_id's texts is compared; all of them meet equal ones."""
    rng = random.Random(41)
    texts = [prose(rng, 60) for _ in range(12)]
    rows = [(i % 6, t) for i, t in enumerate(texts)] + [(20 + i, t + " end") for i, t in enumerate(texts)] + [(50, texts[11])]
    found = []
    for parts in (1, 3, 5):
        rng.shuffle(rows)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), 80).collect()
        found.append(sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    of = {i: c for i, _, c, _ in found[0]}
    for i in range(6):
        least = min((i, i + 6), key=lambda k: near_dedup.digest(near_dedup.shingles(texts[k], near_dedup.WordHashes()).tobytes()))
        assert of[20 + least] == i and of[i] == i
    assert of[50] == 5


def test_near_duplicates_of_nothing(none):
    assert near_dedup.near_duplicates(none).count() == 0


def test_neighbours_meet_across_cuts(spark):
    rows = spark.createDataFrame([(i, bytearray(200)) for i in range(30)], "id long, sig binary")
    pairs = {(r.a, r.b) for r in near_dedup.candidates(rows, 7).collect()}
    assert {(i, i + 1) for i in range(29)} <= pairs


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60, 90)] + [(5, 3), (3, 9), (9, 5), (1, 1)], "a long, b long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {i: 60 for i in range(60, 91)} | {3: 3, 5: 3, 9: 3}
    assert components.components(edges.limit(0)).count() == components.components(edges.filter("a = b")).count() == 0


# ---- 4


def test_chat(spark):
    texts = ["", "a#b ##c ####", "</turn>\n### User: x", "\\", "\\\\n</turn></turn>", chat.TRICKY, "é\n\n", "x" * 50_000, "#", "<"]
    roles = ["user", "assistant", "system", "tool: x", "User", ""]
    rows = [(c, t, roles[(c + t) % 6], texts[(3 * c + t) % len(texts)]) for c in range(12) for t in range(c % 5 + 1)] + [(50, 0, None, None)]
    made = chat.format_records(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in made.select("conv_id", chat.read_turns(F.col("chat_text")).alias("turns"), chat.read_loss(F.col("chat_text"), F.col("chat_loss")).alias("learnt")).collect():
        want = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
        assert r.learnt == "".join(t for role, t in want if role == "assistant")


def test_records_beyond_a_variant(spark, monkeypatch):
    """Where a record gives no variant for its size, lists of messages are read all the same."""
    turns = [{"role": "user", "content": "### a"}, {"role": "assistant", "content": "</turn> \\ b"}, {"role": "assistant", "content": None}]
    rows = [json.dumps({"messages": turns}), json.dumps({"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}), "{", json.dumps({"prompt": "p", "completion": "c"})]
    table = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, record string")
    usual = {r.id: r.chat_text for r in chat.format_records(table).collect()}
    monkeypatch.setattr(chat, "LONG", 0)
    monkeypatch.setattr(chat.F, "try_parse_json", lambda c: F.lit(None).cast("variant"))
    got = {r.id: r.chat_text for r in chat.format_records(table).collect()}
    assert got[0] == usual[0] and got[1] == usual[1] and usual[0] and usual[1] and got[2] is None and got[3] is None


def test_chat_layouts(spark):
    cases = {
        '{"messages":[{"content":"a","role":"user"},{"role":"assistant","content":null}]}': [("user", "a"), ("assistant", "")],
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}': [("user", "a"), ("assistant", "b")],
        '{"output":"c","instruction":"a","input":"b"}': [("user", "a\n\nb"), ("assistant", "c")],
        '{"system_prompt":"s","question":"a","answer":"b"}': [("system", "s"), ("user", "a"), ("assistant", "b")],
        '{"prompt":"a","completion":"b"}': [("user", "a"), ("assistant", "b")],
        '{"messages":[]}': [],
        '{"other":1}': None,
        "not json": None,
    }
    got = chat.format_records(spark.createDataFrame([(k,) for k in cases] + [(None,)], "record string")).collect()
    assert {r.record: r.chat_turns and [tuple(t) for t in r.chat_turns] for r in got} == cases | {None: None}


# ---- 5


def base(text):
    w = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        dup += bool(words(line)) and line in seen
        seen.add(line)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(i, 1) for i in range(20, 40)] + [(21, 0), (None, 1)], "doc_id long, quality int")
    got = quality_rules.judge(docs, labels).collect()
    raw, good = Counter(), Counter()
    grams = lambda t: [(int.from_bytes(b[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for b in [(t or "").encode()] for i in range(len(b) - 3)]
    for r in ROWS:
        raw.update(grams(r[1]))
        if r[0] is not None and 20 <= r[0] < 40 and r[0] != 21:
            good.update(grams(r[1]))
    n, m = sum(raw.values()) + 65536, sum(good.values()) + 65536
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(ROWS)
    for r, want in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(ROWS, key=key), strict=True):
        b = base(want[1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        g = grams(want[1])
        llr = sum(math.log((good[x] + 1) / m * n / (raw[x] + 1)) for x in g) / len(g) if g else 0
        assert math.isclose(r.llr, llr, abs_tol=1e-5)
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert quality_rules.judge(none, labels).count() == 0
    assert {r.llr for r in quality_rules.judge(docs, labels.limit(0)).collect()} == {0.0}


# ---- 6


def test_language_model(docs, none):
    """Against the sums of histories of up to two words, in closed form; and each history's probabilities add up to 1."""
    train = [r for r in ROWS if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 != 2]
    tokens = lambda t: ["<start>", *((w,) for w in words(fold(t))), "<end>"]
    c = Counter(tuple(t[i : i + k]) for r in train for t in [tokens(r[1])] for k in (1, 2, 3) for i in range(len(t) - k + 1))
    n, types = sum(v for k, v in c.items() if len(k) == 1) - len(train), [k[0] for k in c if len(k) == 1 and k[0] != "<start>"]

    def p(word, history):
        if not history:
            return (c[word,] + 1) / (n + len(types) + 1)
        less = p(word, history[1:])
        seen = c[history]
        trust = (seen - 1) / (seen - 1 + language_model.DOUBT) if seen >= 2 else 0
        return trust * c[*history, word] / seen + (1 - trust) * less if trust else less

    for history in [("<start>",), (("alpha1",),), *[k for k, v in c.items() if len(k) == 2 and v > 1 and k[1] != "<end>"][:5]]:
        assert math.isclose(sum(p(w, history) for w in types) + p("unknown", history), 1)
    want = []
    for r in ROWS:
        t = tokens(r[1])
        base_ = sum(math.log10(p(w, ())) for w in t[1:])
        score = sum(math.log10(p(t[i], tuple(t[max(0, i - 2) : i]))) for i in range(1, len(t)))
        want.append((-1 if r[0] is None else r[0], len(t) - 1, sum(c[w,] > 0 for w in t[1:]), n, base_, score))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.lm_scores(docs).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9) and math.isclose(g[5], w[5], rel_tol=1e-9)
    assert language_model.lm_scores(none).count() == 0


def test_shards_of_any_number_agree(docs, monkeypatch):
    """Small blocks and many shards give the same scores as few."""
    ordered = lambda: sorted((-1 if r.doc_id is None else r.doc_id, r.n_known, round(r.score, 6)) for r in language_model.lm_scores(docs).collect())
    few = ordered()
    monkeypatch.setattr(language_model, "parts_for", lambda docs, mb: 23)
    assert ordered() == few


# ---- 7


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_coder():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, token_output.BLOCK, token_output.BLOCK + 1):
        for ids in (rng.integers(0, 50_257, n), np.repeat(7, n), rng.zipf(1.3, n) % 65_536):
            known = token_output.Frequencies.counted(ids) if n else None
            assert (token_output.decode_blocks(token_output.encode_blocks(ids, known), n, known) == ids).all()
    frame = token_output.pack([1, None], [np.arange(9), np.arange(3)])
    keys, docs = token_output.unpack(frame)
    assert keys == [1, None] and [d.tolist() for d in docs] == [list(range(9)), [0, 1, 2]]
    with pytest.raises(ValueError):
        token_output.unpack(frame[:-9] + bytes([frame[-9] ^ 1]) + frame[-8:])


def test_mix_of_orders():
    """The intervals of all symbols tile the whole range, whatever the tables predict, and are found again."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 90, 3000):
        known = token_output.Frequencies(np.arange(n), rng.zipf(1.5, n) % 100_000 + 1)
        lanes = 4
        model = token_output._Model(lanes, known)
        for _ in range(300):
            model.look(lanes)
            model.learn(lanes, rng.integers(0, n, lanes) * (rng.random(lanes) < 0.5))
        model.look(lanes)
        cuts = [model.below(np.full(lanes, x), lanes) for x in range(n)]
        ends = np.zeros(lanes, np.int64)
        for start, size in cuts:
            assert (start == ends).all() and (size > 0).all()
            ends = start + size
        assert (ends == 1 << 34).all()
        for x in (0, n // 2, n - 1):
            start, size = cuts[x]
            for v in (start, start + size // 2, start + size - 1):
                assert (model.symbol_at(v, lanes) == x).all()


def test_carries():
    """Digits that are all ones take a carry from far behind: a rare id after many sure ones, in many alignments."""
    for k in range(0, 60, 4):
        ids = np.concatenate([np.repeat(9, 200 + k), np.arange(40), np.repeat(9, 900), [8, 9, 39, 9]])
        known = token_output.Frequencies.counted(ids)
        assert (token_output.decode_blocks(token_output.encode_blocks(ids, known), len(ids), known) == ids).all()


def test_mix_beats_general_compression(sf, spark, tokenizer_path):
    """Per block of 4,096 ids, the frame with all its tables takes less than the same blocks of 16-bit ids in zlib."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]
    docs = token_output.encoder(tokenizer_path).encode(texts)
    raw, block = np.concatenate(docs).astype("<u2"), token_output.BLOCK
    other = sum(len(zlib.compress(raw[i : i + block].tobytes(), 9)) for i in range(0, len(raw), block))
    assert len(token_output.pack(list(range(len(docs))), docs)) < 0.9 * other


def test_words_encode_like_texts(tokenizer_path):
    e = token_output.encoder(tokenizer_path)
    rng = random.Random(3)
    pieces = ["a", " ", "  ", "\n", "\t", "'s", "12", "é", "<|endoftext|>", " ", "###", "word", "\x1c", "日本"]
    texts = ["", *("".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(300))]
    for text, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_token_files(docs, none, tokenizer_path, tmp_path):
    some = docs.filter("doc_id IS NULL OR doc_id <> 6")
    got = token_output.encode_and_read(some, tokenizer_path, str(tmp_path / "t")).orderBy("start").collect()
    e, start = token_output.encoder(tokenizer_path).tokenizer, 0
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS if r[0] != 6), key=lambda k: (k is not None, k or 0))
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        ids = [*e.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_output.encode_and_read(none, tokenizer_path, str(tmp_path / "n")).count() == 0


# ---- 8


def test_fuzzy_lines(spark, none):
    long_line = "the quick brown fox jumps over the lazy dog near the old stone bridge by the river " * 3
    rows = [
        (3, f"{long_line}\nshort line\nshort line"),
        (1, f"own words of the first document here\n{long_line.upper()}!\nshort line"),
        (2, f"{long_line.replace('dog', 'dogs')}\nsomething else entirely that nobody has ever said"),
        (4, None),
        (5, ""),
        (None, long_line),
    ]
    got = {r.doc_id: r for r in line_dedup.drop_lines(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, line_gone string, other string, line_count string")).collect()}
    assert got[1].text == rows[1][1] and got[1].line_removed == 0 and got[1].line_count == 3 and got[1].other == "y"
    assert got[3].text == "short line\nshort line" and got[3].line_removed == 1
    assert got[4].text is None and got[5].text == "" and got[None].text == long_line
    assert got[2].text.endswith("ever said")
    assert line_dedup.drop_lines(none).count() == 0


def test_long_and_repeated_lines(spark):
    """Lines too long for edit distance, alike or not, on repeated rows; digits tell lines apart exactly, not fuzzily."""
    rng = random.Random(12)
    huge = prose(rng, 16_000)
    rows = [(1, huge), (2, huge.replace("alpha", "changed", 9)), (2, huge.replace("alpha", "changed", 9)), (3, prose(rng, 16_000)), (4, "one two three four 5\none two three four 5\nOne, two three four 5")]
    got = {(r.doc_id, r.line_removed) for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0), (2, 1), (3, 0), (4, 2)}


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def alike(a, b):
    longer = max(len(a), len(b))
    return abs(len(a) - len(b)) <= longer * 20 // 100 and edits(a, b) <= longer * 20 // 100


def test_changed_lines_are_found(spark):
    """Recall by length of line: one word changed, dropped or mistyped; pairs that brute force finds alike count."""
    rng = random.Random(21)
    words_ = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(3000)] + ["the", "of", "and"] * 300
    rows, pairs = [], {}
    for n in (5, 8, 12, 13, 20, 40, 80):
        for k in range(45):
            w = rng.choices(words_, k=n)
            i, x = rng.randrange(n), list(w)
            x[i : i + 1] = [[rng.choice(words_)], [], [x[i] + "x"]][k % 3]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(x))]
            if len(x) >= line_dedup.MIN_WORDS and alike(rows[-2][1], rows[-1][1]):
                pairs.setdefault(n, []).append(rows[-1][0])
    got = {r.doc_id: r.line_removed for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[i] for i, _ in rows[::2])
    for n, found in pairs.items():
        assert sum(got[i] for i in found) >= 0.9 * len(found), n
    again = {r.doc_id: r.line_removed for r in line_dedup.drop_lines(spark.createDataFrame(rows[::-1], "doc_id long, text string")).collect()}
    assert again == got


def test_lines_that_differ_in_several_words(spark):
    """Recall where several words are replaced, dropped, added or mistyped, up to 15 % of them, in lines of any length."""
    rng = random.Random(31)
    words_ = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(4000)]

    def replaced(w, k):
        for i in rng.sample(range(len(w)), k):
            w[i] = rng.choice(words_)

    def mistyped(w, k):
        for i in rng.sample(range(len(w)), k):
            w[i] = w[i] + "q"

    def dropped(w, k):
        for i in sorted(sorted(range(len(w)), key=lambda i: len(w[i]))[:k], reverse=True):
            del w[i]

    def added(w, k):
        for i in sorted(rng.sample(range(len(w)), k), reverse=True):
            w.insert(i, rng.choice(words_)[:3])

    cases = [(f, n, k) for n, ks in ((10, [2]), (12, [2]), (20, [3]), (40, [6]), (90, [9]), (120, [3, 6, 12, 18]), (300, [45])) for k in ks for f in (replaced, mistyped, dropped, added)]
    rows, pairs = [], {}
    for f, n, k in cases:
        for _ in range(20):
            w = rng.choices(words_, k=n)
            x = list(w)
            f(x, k)
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(x))]
            a, b = rows[-2][1], rows[-1][1]
            if alike(a, b) if max(len(a), len(b)) <= line_dedup.LONG else alike(w, x):
                pairs.setdefault((f.__name__, n, k), []).append(rows[-1][0])
    got = {r.doc_id: r.line_removed for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert not any(got[i] for i, _ in rows[::2])
    assert len(pairs) > 30
    low = {c: sum(got[i] for i in found) / len(found) for c, found in pairs.items() if sum(got[i] for i in found) < 0.9 * len(found) and len(found) > 9}
    assert not low


def test_lines_of_documents(spark, sf):
    """All pairs of lines up to 600 characters of a whole table, by brute force."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    lines = line_dedup.classes_of(line_dedup.lines_of(docs)).select("class", F.array_join("words", " ").alias("norm")).filter("length(norm) <= 600")
    classes = spark.createDataFrame(lines.collect()).repartition(8).cache()
    other = classes.select(F.col("class").alias("other"), F.col("norm").alias("text"))
    both = classes.crossJoin(other).filter("class < other").withColumn("edits", F.floor(F.greatest(F.length("norm"), F.length("text")) * 0.2).cast("int"))
    close = both.filter("abs(length(norm) - length(text)) <= edits").filter(F.expr("levenshtein(norm, text, edits) >= 0"))
    want = {frozenset((r["class"], r["other"])) for r in close.select("class", "other").collect()}
    sims = line_dedup.described(line_dedup.classes_of(line_dedup.lines_of(docs))).cache()
    shared = line_dedup.shared_buckets(sims).cache()
    pairs = line_dedup.candidates(shared).unionByName(line_dedup.crowded(shared, None)).distinct()
    links = line_dedup.verified(pairs, docs, sims)
    got = {frozenset(r) for r in links.collect()}
    small = {r["class"] for r in classes.select("class").collect()}
    assert len(want) > 20 and len(want & got) >= 0.9 * len(want)
    assert {x for x in got if x <= small} <= want


def test_all_lines_of_a_crowd_meet(spark, monkeypatch):
    """Hashes of one bucket: every pair of two groups within the bound meets, in one chunk or in several."""
    rng = random.Random(9)
    sims = {i: sum(1 << k for k in rng.sample(range(60), 16)) for i in range(60)}
    rows = spark.createDataFrame([(i, s, 100, 22, [7]) for i, s in sims.items()], "class long, sim long, chars int, most int, keys array<long>")
    label = spark.createDataFrame([(i, i // 3) for i in sims], "class long, `group` long")
    shared = line_dedup.shared_buckets(rows).cache()
    near = {(r.a, r.b) for r in line_dedup.candidates(shared).collect()}
    want = {(i, j) for i in sims for j in sims if i < j and i // 3 != j // 3 and (sims[i] ^ sims[j]).bit_count() <= 22}
    assert want - near
    for chunk in (4096, 7):
        monkeypatch.setattr(line_dedup, "CHUNK", chunk)
        got = [(r.a, r.b) for r in line_dedup.crowded(shared, label).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_crowded_lines_are_compared_where_they_meet(spark, monkeypatch):
    """With texts a crowded bucket hands on links alone, each once, the same as by verifying all its pairs; also with many chunks."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeionrst", k=rng.randint(2, 7)))
    shared_words, lines = ["characteristically", "incomprehensible"], []
    for size in (8, 60, 160):
        for _ in range(12):
            w = [word() for _ in range(size)]
            at = size // 2
            lines += [w[:at] + shared_words + w[at:], w[:at] + shared_words + w[at:-1], [word() for _ in range(size // 3)] + w[size // 3 : at] + shared_words + w[at:]]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)], "doc_id long, text string")
    sims = line_dedup.described(line_dedup.classes_of(line_dedup.lines_of(docs))).withColumn("most", F.lit(64)).cache()
    key = sims.withColumn("keys", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    bucket = line_dedup.shared_buckets(key).cache()
    texts = line_dedup.texts_of(sims.select("class"), docs, sims)
    every = line_dedup.crowded(bucket, None)
    expected = sorted((r.a, r.b) for r in line_dedup.verified(every, docs, sims).collect())
    assert 20 < len(expected) < every.count() / 4
    for chunk in (4096, 7):
        monkeypatch.setattr(line_dedup, "VERIFIED_CHUNK", chunk)
        assert sorted((r.a, r.b) for r in line_dedup.crowded(bucket, None, texts=texts).collect()) == expected


def test_beginnings_of_lines_lose_no_pair(spark):
    """Pairs at every distance about the limit, edited at their start only, are alike as by brute force."""
    rng = random.Random(5)
    rows, expected = [], []
    for n in (30, 101, 400):
        for edits in (0, n // 5 - 1, n // 5, n // 5 + 1, n // 2):
            for cut in (0, n // 10):
                a = "".join(rng.choices("abcdefgh ", k=n))
                b = "#" * edits + a[edits:][: n - edits - cut]
                rows.append((a, len(a), None, b, len(b), None))
                d = list(range(len(b) + 1))
                for i, x in enumerate(a, 1):
                    last, d[0] = d[0], i
                    for j, y in enumerate(b, 1):
                        last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
                expected.append(d[-1] <= n // 5)
    pairs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, norm1 string, size1 int, coded1 string, norm2 string, size2 int, coded2 string")
    got = [r.alike for r in pairs.select("id", line_dedup._alike(80).alias("alike")).orderBy("id").collect()]
    assert got == expected and 5 < sum(got) < len(got)


def test_simhash_is_the_majority(spark):
    import xxhash

    texts = {1: "a b c d e", 2: "x x y z q"}
    lines = line_dedup.lines_of(spark.createDataFrame(list(texts.items()) * 2, "doc_id long, text string"))
    got = line_dedup.described(line_dedup.classes_of(lines)).collect()
    assert len(got) == 2
    for r in got:
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in texts[r.doc_id].split()]
        assert r.n == 2 and r.sim % 2**64 == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


# ---- 9


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def test_decontamination(spark, docs, none):
    rng = random.Random(8)
    items = [(1, " ".join(words(ROWS[17][1])[50:75])), (2, "one two"), (3, prose(rng, 30)), (4, ""), (5, None), (6, "... "), (7, ROWS[8][1].upper()), (7, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (10_000_000, 200):
        got = decontamination.scan(docs, bench, chars=chars).collect()
        want = []
        for r in ROWS:
            w, hit, found = bench_words(r[1]), set(), set()
            for item, text in items:
                b = bench_words(text)
                n = min(10, len(b))
                windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
                for i in range(len(w) - n + 1 if n else 0):
                    if tuple(w[i : i + n]) in windows:
                        hit |= set(range(i, i + n))
                        found.add(str(item))
            want.append((-1 if r[0] is None else r[0], len(w), len(hit), sorted(found)))
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.bench_words, sum(b - a for a, b in r.bench_spans), r.bench_items) for r in got) == sorted(want)
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[2] for w in want)
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, "spans").collect()}
    assert cut[3] == "" and cut[0] is None and cut[20] == ROWS[20][1]
    assert decontamination.scan(none, bench).count() == 0
    assert decontamination.scan(docs, bench.limit(0)).filter("size(bench_spans) > 0").count() == 0


# ---- 10


def without_repeats(rows, length=400):
    """Rows (doc_id or -1, bytes, removed, runs, digest of what stays) by brute force."""
    seen = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((-1 if r[0] is None else r[0], len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(want)


def removed_of(docs):
    got = substring_dedup.remove_repeats(docs).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_repeats(docs, none):
    assert removed_of(docs) == without_repeats(ROWS)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeats_of_common_anchors(docs, spark, monkeypatch):
    """Anchors dealt to several tasks; one doc_id with several texts, which share a passage with each other and with another document."""
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    monkeypatch.setattr(substring_dedup, "SALTS", 3)
    rng = random.Random(77)
    passage = prose(rng, 80)
    more = [(900, f"{prose(rng, 40)} {passage} {prose(rng, 40)}"), (900, f"{prose(rng, 50)} {passage}"), (901, f"{passage} {prose(rng, 70)}"), (900, prose(rng, 90))]
    added = spark.createDataFrame(more, "doc_id long, text string")
    found = removed_of(docs.unionByName(added, allowMissingColumns=True))
    assert found == without_repeats([*ROWS, *more])
    assert sum(r[0] >= 900 and r[2] > 0 for r in found) == 3


def test_anchors_in_pieces(monkeypatch):
    text = prose(random.Random(4), 3000).encode()
    whole = substring_dedup.anchors(text)
    monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    parts = substring_dedup.anchors(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_columns_in_a_file(monkeypatch):
    rng = random.Random(6)
    passage = prose(rng, 100).encode()[:650]
    offsets = [240 - i for i in range(3)]
    segments = [(prose(rng, 10).encode()[:40] + passage[i:])[: at + 400] for i, at in enumerate(offsets)]
    found = substring_dedup.repeats(segments, offsets, [1] * 3)
    monkeypatch.setattr(substring_dedup, "IN_MEMORY", 0)
    assert (substring_dedup.repeats(segments, offsets, [1] * 3) == found).all() and found.any()


# ---- pipeline and queries


def test_pipeline(spark, sf, tokenizer_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.quality(spark, docs, sf).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = pipeline.near_duplicates(spark, kept, sf).cache()
    sets = [(r.doc_id, shingle_set(r.text)) for r in kept.collect()]
    linked = {i: [j for j, b in sets if j != i and a & b and 100 * len(a & b) >= 80 * len(a | b)] for i, a in sets}
    ids = {r.doc_id for r in one.collect()}
    for i, others in linked.items():
        assert (i in ids) if not others else True
        if i in ids:
            assert not any(j < i for j in others)
    clean = pipeline.decontaminate(spark, one, sf).cache()
    assert clean.columns == docs.columns and clean.count() <= len(ids)
    mixed = pipeline.mix(spark, clean, sf)
    assert mixed.columns == docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "mixing sources", "token output"]
    taken = sorted((r.doc_id, r.text or "") for r in mixed.collect())
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    tokens, start = token_output.encoder(tokenizer_path).tokenizer, 0
    got = out.orderBy("start").collect()
    assert len(got) == len(taken)
    for r, (doc_id, text) in zip(got, taken, strict=True):
        ids = [*tokens.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


CLASHES = ("dropped", "n_words", "base_failed", "llr", "component_id", "bench_spans", "bench_words", "mix_copies", "mix_copy", "mix_source", "given_0", "text_")


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "decontaminate", "mix"])
def test_stages_keep_columns(spark, docs, none, stage, tmp_path):
    """Stages on nulls, empty and long texts, repeated rows and empty tables; columns of the operators' names keep their values."""
    import corpus_pipeline as pipeline

    own, sf, bench = list(pipeline.OWN), str(tmp_path), prose(random.Random(70), 40)
    spark.createDataFrame([(1, bench), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(6, 40)] + [(6, 0), (None, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    some = docs.unionByName(spark.createDataFrame([(700, f"{bench} and more"), (701, None)], "doc_id long, text string"), allowMissingColumns=True)
    wide = some.select(*own, *(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias(c) for c in ("mix_size", "sig", "kept", "did", *CLASHES)))
    step = getattr(pipeline, stage)
    key = lambda r: tuple(str(r[c]) for c in own)
    got, plain = step(spark, wide, sf), step(spark, some.select(*own), sf)
    assert got.columns == wide.columns and plain.columns == own
    rows = got.collect()
    assert sorted(map(key, rows)) == sorted(map(key, plain.collect()))
    assert all(r[c] == ("none" if r.doc_id is None else str(r.doc_id)) for r in rows for c in wide.columns if c not in own)
    ids = Counter(r.doc_id for r in rows)
    if stage == "quality":
        assert ids and not {0, 1, 2, 3, 4, 5, 22, 700, 701, None} & set(ids)  # without text, too short, or the same words again and again
    elif stage == "near_duplicates":
        assert ids[7] == 1 and not {8, 9} & set(ids) and ids[12] in (0, 2) and {0, 1, 2, 6, 700, 701, None} <= set(ids)
    elif stage == "decontaminate":
        assert ids == Counter([*(r[0] for r in ROWS), 701])
    else:
        assert all(n <= 2 * (2 if i == 12 else 1) for i, n in ids.items())
    assert step(spark, none.select(*own), sf).count() == 0 and step(spark, none, sf).columns == none.columns


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_chat_format"])
def test_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from lattica.llm import registry

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    tidy = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    assert tidy(tuple(r[c] for c in columns) for r in df.collect()) == tidy(tuple(r[i] for i in at) for r in want.fetchall())
