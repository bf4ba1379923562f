"""Links by prefix filter, links kept up by deltas, versions in a state store, the inverted index: each against the whole."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lattica.operators import keywords, links, postings, search, versions
from lattica.sources import notes as src
from lattica.streaming import history, linking, saves

KW = "user_id string, note_id long, keyword string, rank int"


def random_keywords(seed, notes=60, most=14, repeats=True):
    rng, rows = random.Random(seed), []
    names = ["common", "usual", *(f"w{i}" for i in range(40))]
    for n in range(notes):
        size = rng.randint(1, most)
        picked = [w for w in names[:2] if rng.random() < 0.7] + rng.sample(names[2:], size)
        picked += [rng.choice(picked).upper() for _ in range(rng.choice([0, 0, 1, 2]))] if repeats else []
        rows += [(f"u{n % 2}", n, w, i + 1) for i, w in enumerate(rng.sample(picked, len(picked)))]
    return rows


def brute_links(rows, least=0.15):
    listed, user = defaultdict(list), {}
    for u, n, w, _ in sorted(rows, key=lambda r: r[3]):
        listed[n].append(w.lower())
        user[n] = u
    out = {}
    for s in listed:
        found = []
        for t in listed:
            shared = [w for w in listed[t] if w in set(listed[s])]
            strength = round(len(shared) / len(listed[s]), 4)
            if s != t and user[s] == user[t] and strength > least:
                found.append((-strength, t, "|".join(shared)))
        out[s] = [(s, t, -x, w) for x, t, w in sorted(found)[:8]]
    return sorted(x for v in out.values() for x in v)


@pytest.mark.parametrize("repeats", [False, True])
def test_prefix_filter(spark, monkeypatch, repeats):
    monkeypatch.setattr(links, "NOTES_TOGETHER", 7)  # common keywords are dealt to several tasks
    rows = random_keywords(1, repeats=repeats)
    got = links.own_links(spark.createDataFrame(rows, KW))
    assert sorted((r.source, r.target, r.strength, r.shared) for r in got.collect()) == brute_links(rows)


def test_prefix_filter_compares_fewer_pairs(spark):
    """With ten keywords two must be shared, so nobody looks for others by the keyword that all have."""
    rows = [("u", n, w, i) for n in range(100) for i, w in enumerate(["everyone", *(f"w{n % 20}-{k}" for k in range(9))])]
    every = links.cards(spark.createDataFrame(rows, KW)).cache()
    assert links.overlaps(every, every).count() == 20 * 5 * 4  # those that share nine more
    probes = every.select(F.explode(F.slice("rarest", 1, F.size("rarest") - links.needed(F.size("listed"), 0.15) + 1)).alias("k"))
    assert probes.filter("k = 'everyone'").count() == 0


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))


def changed_notes(spark, rng, ids, at):
    names = [f"word{i}" for i in range(25)]
    rows = [(n, f"u{n % 2}", f"Title {rng.choice(names)}", " ".join(rng.choice(names) for _ in range(rng.randint(0, 14))), at) for n in ids]
    return spark.createDataFrame(rows, "note_id long, user_id string, title string, content_text string, at long").select("note_id", "user_id", "title", "content_text", F.timestamp_seconds("at").alias("updated_at"))


def test_links_by_deltas(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "links")
    notes = changed_notes(spark, rng, range(60), 100)
    linking.build(notes, path, 8)
    whole = lambda n: links.final_links(links.own_links(keywords.keywords(n, keep=("updated_at",))))
    assert same(linking.final_links(spark, path), whole(notes))
    state = {r.note_id: r for r in notes.collect()}
    for step in range(2):
        ids = rng.sample(range(70), 6)
        batch, gone = changed_notes(spark, rng, ids, 200 + step), rng.sample(sorted(set(state) - set(ids)), 3)
        linking.apply(batch, spark.createDataFrame([(g,) for g in gone], "note_id long"), path, 8)
        state = {k: v for k, v in state.items() if k not in gone} | {r.note_id: r for r in batch.collect()}
        after = spark.createDataFrame(list(state.values()), batch.schema)
        assert same(linking.final_links(spark, path), whole(after))
        linking.apply(batch, None, path, 8)  # the batch once more changes nothing
        assert same(linking.final_links(spark, path), whole(after))
    linking.apply(changed_notes(spark, rng, [ids[0]], 1), None, path, 8)  # older than what is there
    assert same(linking.final_links(spark, path), whole(after))


def test_a_batch_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "links")
    rows = [(n, "u", f"alpha{n // 4} beta{n // 4}", f"gamma{n // 4}", n) for n in range(80)]
    notes = spark.createDataFrame(rows, "note_id long, user_id string, title string, content_text string, at long").select("note_id", "user_id", "title", "content_text", F.timestamp_seconds("at").alias("updated_at"))
    linking.build(notes, path, 32)
    before = files(path)
    linking.apply(notes.filter("note_id = 5").withColumn("updated_at", F.timestamp_seconds(F.lit(999))), None, path, 32)
    kept = {f for f, t in files(path).items() if before.get(f) == t}
    assert len(kept) > 0.6 * len(before)


def test_a_failed_batch_is_applied_again(spark, tmp_path, monkeypatch):
    rng, path = random.Random(4), str(tmp_path / "links")
    notes = changed_notes(spark, rng, range(40), 100)
    batch = changed_notes(spark, rng, [1, 5, 9, 50], 200)
    after = notes.join(batch, "note_id", "left_anti").unionByName(batch)
    want = links.final_links(links.own_links(keywords.keywords(after, keep=("updated_at",)))).cache()
    real = linking._replace
    for fails_at in ("own", "held", "cards"):
        here = f"{path}-{fails_at}"
        linking.build(notes, here, 8)

        def broken(path, table, *rest, at=fails_at):
            if table == at:
                raise OSError("lost")
            real(path, table, *rest)

        monkeypatch.setattr(linking, "_replace", broken)
        with pytest.raises(OSError):
            linking.apply(batch, None, here, 8)
        monkeypatch.setattr(linking, "_replace", real)
        linking.apply(batch, None, here, 8)
        assert same(linking.final_links(spark, here), want)


def test_stream_of_saves(spark, tmp_path):
    path = str(tmp_path / "links")
    rng = random.Random(6)
    notes = changed_notes(spark, rng, range(20), 100)
    linking.build(notes, path, 8)
    for i, at in enumerate((300, 200, 400)):  # the second file comes late
        batch = changed_notes(spark, rng, [1, 2, 30 + i], at).withColumnRenamed("updated_at", "saved_at")
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    saves.start(stream, path, str(tmp_path / "cp"), 8, availableNow=True).awaitTermination()
    last = saves.newest(stored)
    after = notes.join(last, "note_id", "left_anti").unionByName(last)
    assert same(linking.final_links(spark, path), links.final_links(links.own_links(keywords.keywords(after, keep=("updated_at",)))))


def test_versions_in_any_split_and_after_a_restart(spark, tmp_path):
    rng = random.Random(8)
    rows = [(n, rng.randrange(60), rng.choice([f"t{i}", None, ""])) for n, m in ((1, 45), (2, 21), (3, 3), (4, 20)) for i in range(m)]
    rng.shuffle(rows)
    kind = "note_id long, at long, content_text string"
    given = lambda part: spark.createDataFrame(part, kind).select("note_id", F.timestamp_seconds("at").alias("saved_at"), "content_text")
    want = versions.versions(given(rows))
    stream = spark.readStream.schema(given(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet
    cut = sorted(rng.sample(range(1, len(rows)), 3))
    parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)], strict=True)]
    for half in (parts[:2], parts[2:]):  # the query stops between them and goes on from its checkpoint
        for part in half:
            given(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        history.start(stream(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert same(history.current(spark, str(tmp_path / "out")), want)
    assert same(history.replayed(given(rows), 5), want)


def test_index_equals_the_scan(spark, sf, tmp_path):
    notes, path = src.notes(spark, sf), str(tmp_path / "postings")
    postings.write(notes, path, 16)
    asked = ["thion ouer", "thion thion thion erst", "the and", "", "nosuchword", "Thing, heou: onthe!"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = postings.search(spark, path, queries, 7, 16)
    for i, q in enumerate(asked):
        want = [(r.note_id, r.score) for r in search.relevant(notes, q, 7).collect()]
        assert [(r.note_id, r.score) for r in got.filter(F.col("query_id") == i).orderBy("place").collect()] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:60]


def test_answers_of_long_notes(spark):
    """Counting words once: a text of 200,000 words is a matter of a second, not of hours."""
    text = " ".join(f"word{i % 5000} filler" for i in range(100_000))
    assert search.query_keywords(text, 2) == ["filler", "word1000"]
