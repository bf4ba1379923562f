"""The prefix trie against brute force: nulls, ties, repeated rows, empty tables, clashing columns, opened subtrees."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from lattica.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int, sid long, n long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, every=100, heads=6):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = abs(c) // every * every * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out, total = [], {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        total[node] = (sum(total[k][0] for k in kids[node]) or 1, saved + sum(total[k][1] for k in kids[node]))
        ends = ",".join(map(str, sorted(c for c in members[node] if whole[c] == node)))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), *total[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 260), *range(-120, -90), 1001, 1205]:
        for t in range(rng.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hello", "hi", "é" * 7, "", None]), "k", 7, 8, 9))
    for c in range(300, 340):  # copies, and one long turn
        rows += [(c, t, "user", f"same {t}", "k", 7, 8, 9) for t in range(12)]
    rows += [(400, t, "user", "x" * 100_000, None, None, None, None) for t in range(2)]
    rows += [(500, t, "user", f"long {t}", None, None, None, None) for t in range(300)]
    rows += [(501, t, "user", f"long {t}" if t < 250 else "other", None, None, None, None) for t in range(300)]
    rows += [(7, None, None, None, "k", 7, 8, 9), (7, None, "user", "first", "k", 7, 8, 9), (7, 1, "user", "tie", "k", 7, 8, 9), (None, 0, "user", "nobody", "k", 7, 8, 9)]
    rows += [rows[0], rows[1], rows[1]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [20, 100_000])
def test_against_brute_force(spark, limit):
    rows = conversations()
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), limit)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(c, 0, "user", "a", None, None, None, None) for c in range(601, 612)]  # no conversation 600, some lose their turn
    assert sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(few, SCHEMA)).collect()), key=str) == brute(few)


def test_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got, want = prefix_trie.op13(spark, sf), con.sql(prefix_trie.OP13_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(r) for r in want.select(*COLUMNS).fetchall()), key=str)
