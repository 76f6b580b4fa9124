"""Fills with many shards, backfills, court pages, gates."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import embedding, mappings, text
from inkwell.operators import changes, retrieval, upkeep


def first_fit(sizes, budgets):
    room, out = list(budgets), []
    for n in sizes:
        k = -1 if n is None else next((k for k, left in enumerate(room) if left >= n), -1)
        if k >= 0:
            room[k] -= n
        out.append(k)
    return out


def test_rooms():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 64, 100):
        budgets = [rng.randint(0, 300) for _ in range(n)]
        sizes = [rng.choice([None, 0, rng.randint(1, 120)]) for _ in range(400)]
        rooms = upkeep.Rooms(budgets)
        assert [rooms.take(s) for s in sizes] == first_fit(sizes, budgets)


def test_fills_stream_through_groups(spark):
    rng = random.Random(3)
    rows = [(g, k, rng.choice([None, rng.randint(1, 50)]), f"x{k}") for g in ("a", None, "b") for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int, n bigint, more string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # many batches a group
    got = {(r["g"], r["k"]): r["shard"] for r in upkeep.greedy_fill(df, "n", "k", [900, 0, 500, 7000], "g").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for g in ("a", None, "b"):
        assert [got[g, k] for k in range(2000)] == first_fit([r[2] for r in rows if r[0] == g], [900, 0, 500, 7000])
    assert upkeep.greedy_fill(df.limit(0), "n", "k", [1], "g").count() == 0


def test_backfill(spark):
    docs = spark.createDataFrame([(1, False), (2, False), (3, True), (4, None)], "id int, is_current boolean")
    chunks = spark.createDataFrame([(2,)], "document_id int")
    nodes = spark.createDataFrame([(k, f"a/{k}/{p}", p, p) for k in (1, 2, 3) for p in "xy"], "document_id int, path string, heading string, ord string")
    fragments = spark.createDataFrame([("a/1/x/1", 1, "one"), ("a/1/x", 0, "zero"), ("a/1/y/1", 2, " "), ("a/2/x", 1, "no"), ("a/3/y", 1, "no")], "path string, ord int, text string")
    made = changes.backfilled(docs, chunks, nodes, fragments)
    assert [tuple(r) for r in made.select("document_id", "chunk_index", "heading", "content").collect()] == [(1, 0, "x", "zero one")]
    assert changes.backfilled(docs, chunks.unionByName(made.select("document_id")), nodes, fragments).count() == 0


def test_court_page(spark):
    page = "<td>Spisova znacka</td>\n <td>I. ÚS 5/10 </td><td>Vyznam</td><td>2</td> Text dokumentu<p>První  řádek</p> \n<p>druhý</p>Ustavni soud, Jostova 8 dál"
    rows = spark.createDataFrame([(1, page), (2, "bez"), (3, None), (4, "Text dokumentu <b> </b>"), (5, "Text dokumentu Vytah z dokumentu neni k dispozici"), (6, "Text dokumentu x")], "k int, html string")
    got = {r["k"]: r["c"] for r in rows.select("k", text.court_page("html").alias("c")).collect()}
    assert got[1]["sp_zn"] == "I. ÚS 5/10" and got[1]["vyznam"] == "2" and got[1]["ecli"] is None and got[1]["body"] == "První řádek\n druhý"
    assert [got[k] for k in (2, 3, 4, 5)] == [None] * 4 and got[6]["body"] == "x" and got[6]["sp_zn"] is None
    assert len(text.COURT_FIELDS) == 13


def test_gates():
    every = retrieval.gated(None)
    assert len(every) == 15 and retrieval.gated([]) == [] and retrieval.gated(["none"]) == []
    assert retrieval.gated(["zakon", "judikat"]) == ["ns", "judikaty", "zakony"] and retrieval.gated(["b"], {"a": ["1"], "b": ["2", "3"]}) == ["2", "3"]


def test_archive_keys_without_a_version(spark):
    rows = spark.createDataFrame([("k", None, 1), ("k", None, 2), ("k", "v" * 50, 3)], "key string, v string, n int")
    got = [r[0] for r in rows.select(mappings.archive_key(F.col("key"), F.col("v"), F.col("n"))).collect()]
    assert len(set(got)) == 3 and got[2] == "k#hist-" + "v" * 40


def test_keys_rotate_until_all_are_spent(spark):
    calls = []
    quota = {"a": 2, "b": 1, "c": 3}

    def call(key, texts):
        calls.append(key)
        if quota[key] == 0:
            raise embedding.KeySpent
        quota[key] -= 1
        return [[1.0]] * len(texts)

    service = embedding.Rotation(["a", "b", "c"], call)
    assert [service(["x"]) for _ in range(6)] == [[[1.0]]] * 6
    assert calls == ["a", "b", "c", "a", "b", "c", "a", "c"]
    for _ in range(2):
        with pytest.raises(embedding.AllSpent):
            service(["x"])
    assert calls[8:] == ["c"]  # c was found to be spent; then no key is asked any more
    with pytest.raises(ValueError):
        embedding.Rotation([], call)

    def down(key, texts):
        raise embedding.KeySpent if key == "a" else OSError

    rows = spark.createDataFrame([(k, "t") for k in range(6)], "k int, t string").coalesce(1)
    got = rows.select(embedding.embedded(F.col("t"), embedding.Rotation(["a"], down), at_once=1, wait=0.001).alias("v")).collect()
    assert [r["v"] for r in got] == [None] * 6
