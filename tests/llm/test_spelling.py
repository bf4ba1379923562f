"""Spelling variants against brute force: nulls, ties, long words, repeated rows, empty tables, clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lattica.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, wid long, key string"


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    near = defaultdict(list)
    names = sorted(n)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and edits(a, b):
                near[a].append(b)
                near[b].append(a)
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items()}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in names), key=str)


def documents():
    rng = random.Random(5)
    stems = ["colour", "flavour", "Straße", "naïveté", "aaaaaa", "abababab", "theatre", "z" * 3000, "éééééé", "grey×s"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(stems[:-3] + stems[-2:] if rng.random() < 0.97 else stems)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aobé") + w[at + 1 :], w[:at] + rng.choice("aobé") + w[at:], w.upper()])
            words.append(w)
        rows.append((i, " ".join(words), "w", 1, 2, "k"))
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, None, None), (200, None, None, None, None, None), (201, "", None, None, None, None), (202, "12 34 -", None, None, None, None)]
    return rows


@pytest.mark.parametrize("every", [97, 5])
def test_against_brute_force(spark, every):
    rows = documents()
    got = spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(3), every=every)
    got = sorted((tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)
    assert got == brute(rows, every)
    assert len(got) > 300 and sum(r[3] is not None for r in got) > 100


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, None, None, None, None), (2, "short", None, None, None, None)], SCHEMA)).count() == 0


def test_keys_agree_with_strings():
    """Deletions have equal keys if and only if they are equal strings, batches of any shape."""
    words = ["abcde", "abxde", "aabbb", "abbb", "bbbbb", "é", "thorough", "through"]
    row, kind, place, key = spelling.deletion_keys(words)
    named = defaultdict(set)
    for r, k, p, x in zip(row, kind, place, key, strict=True):
        w = words[r]
        rest = w if k == spelling.WHOLE else w[:p] + w[p + 1 :]
        named[int(x)].add((rest, int(p), len(w)) if k == spelling.REPLACED else rest)
    assert all(len(v) == 1 for v in named.values())
    assert len({next(iter(v)) for v in named.values()}) == len(named)
    alone = np.concatenate([spelling.deletion_keys([w])[3] for w in words])
    assert sorted(alone.tolist()) == sorted(key.tolist())


def test_colliding_keys_join_nothing(spark, monkeypatch):
    """With four keys in all, strings alone decide."""
    rows = documents()[:25]
    real = spelling.deletion_keys

    def few(words):
        row, kind, place, key = real(words)
        return row, kind, place, key & 3

    monkeypatch.setattr(spelling, "deletion_keys", few)
    got = spelling.variants(spark.createDataFrame(rows, SCHEMA), every=97)
    assert sorted((tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str) == brute(rows, 97)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    got, want = spelling.op11(spark, sf), con.sql(spelling.OP11_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted((tuple(r) for r in want.select(*columns).fetchall()), key=str)
