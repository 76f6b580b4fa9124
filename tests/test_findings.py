"""Rows of small tables on which queries differed from their SQL, or did more than their input asks for."""

from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from inkwell.functions import chunking, embedding, text
from inkwell.operators import changes, postings, upkeep
from inkwell.plans import feature_queries, registry
from inkwell.streaming import stateful, usage


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over these tables, sorted."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows) if isinstance(rows, list) else rows, f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = registry.queries()[name](spark, str(folder))
    wanted = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr), sorted(wanted.fetchall(), key=repr)


def test_halves_in_vector_texts(spark, tmp_path):
    rows = [[1 / 128, -3 / 128], [0.5, -0.25], [0.1, 0.00005], [0.03125, 0.00032], [1e-9, 123456.75]]
    vectors = pa.table({"vec_id": pa.array(range(len(rows))), "embedding": pa.array(rows, pa.list_(pa.float32()))})
    got, want = both(spark, tmp_path, "vector_texts", embeddings=vectors)
    assert got == want and got[0][1] == "[0.007812,-0.023438]"
    doubles = spark.createDataFrame([([0.1234565, 0.0000005, 0.3], 1), ([None, 1 / 128], 2), (None, 3)], "v array<double>, k int")
    said = [r[0] for r in doubles.orderBy("k").select(text.vector_text("v")).collect()]
    assert said == [f"[{0.1234565:.6f},{0.0000005:.6f},0.300000]", "[null,0.007812]", None]


def test_first_of_texts_at_one_time(spark, tmp_path):
    at = datetime(1995, 1, 2)
    line = lambda key, quantity, when=at: {"l_orderkey": key, "l_linenumber": 1, "l_linestatus": "F", "l_quantity": float(quantity), "l_shipdate": when}
    lines = [line(1, 5), line(2, 9), line(1, 7), line(3, 4, None), line(2, 3), line(1, 6), line(3, 8), line(2, 3), line(3, 1)]
    got, want = both(spark, tmp_path, "wanted_texts", lineitem=lines, orders=[{"o_orderkey": k, "o_orderstatus": "F"} for k in (1, 2, 3)])
    assert got == want == [(1, "F5"), (2, "F9"), (3, "F8")]


def test_no_fragment_is_read_where_nothing_is_lacking(spark):
    docs = spark.createDataFrame([(1, False), (2, True)], "id int, is_current boolean")
    nodes = spark.createDataFrame([(1, "o/1/a", "a", 1), (2, "o/2", "b", 1)], "document_id int, path string, heading string, ord int")
    fragments = spark.createDataFrame([("o/1/a/x", 1, "x"), ("o/1/a", 2, "y"), ("o/2", 1, "z"), ("o/1/ab", 3, "no")], "path string, ord int, text string")
    none = spark.createDataFrame([], "document_id int")
    assert [tuple(r) for r in changes.backfilled(docs, none, nodes, fragments).collect()] == [(1, 0, "a", 0, "x y")]
    unread = fragments.withColumn("text", F.raise_error(F.lit("read")).cast("string"))
    assert changes.backfilled(docs, docs.select(F.col("id").alias("document_id")), nodes, unread).count() == 0


def test_one_group_is_filled_by_many_tasks(spark):
    rows = spark.range(4000).selectExpr("id as k", "1 as g", "case when id % 97 = 0 then null else 1 + pmod(xxhash64(id), 60) end as n")
    rows = rows.unionByName(spark.range(50).selectExpr("id as k", "case when id < 25 then null else 2 end as g", "id + 1 as n"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = upkeep.greedy_fill(rows, "n", "k", [40_000, 30, 20_000, 700], "g").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    rooms = {g: upkeep.Rooms([40_000, 30, 20_000, 700]) for g in (None, 1, 2)}
    want = {(r["g"], r["k"]): rooms[r["g"]].take(r["n"]) for r in sorted(rows.collect(), key=lambda r: r["k"])}
    assert {(r["g"], r["k"]): r["shard"] for r in got} == want
    assert len({r["task"] for r in got if r["g"] == 1}) > 1


def test_a_move_is_counted_in_one_pass(spark):
    source = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "id int, t string")
    target = spark.createDataFrame([(2, "x"), (9, "y"), (None, "z")], "id int, t string")
    _, _, report = changes.moved(source, target, spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "id int"), "id")
    assert sorted(tuple(r) for r in report.collect()) == [(1, 2, 2, True), (2, 1, 2, False)]
    assert "Join" not in report._jdf.queryExecution().toString()


def test_hard_chunks_stay_in_the_jvm(spark):
    texts = ["", " \n ", "abcdefghij\n\nk", "ab\n \ncd\n\n\nef", "a b c d e f g h i j k\n\n" * 5, "x" * 23, "abc  \n\n      " + " y" * 9, "ab\n\ncdef\n\ng" * 7]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").select("k", *[chunking.blank_line_paragraphs("t", m).alias(f"c{m}") for m in (4, 5, 10, 100)])
    assert "Python" not in rows._jdf.queryExecution().toString()
    for r in rows.collect():
        for m in (4, 5, 10, 100):
            assert r[f"c{m}"] == (None if r["k"] == len(texts) else chunking.hard_chunks(texts[r["k"]], m))


def test_texts_of_a_call_alone_are_strings(spark):
    rows = spark.createDataFrame([(k, None if k % 5 == 0 else " " if k % 7 == 0 else "x" * k) for k in range(50)], "k int, t string")
    vectors = rows.select("k", embedding.embedded(F.col("t"), lambda texts: [[len(texts), len(t)] for t in texts], at_once=4).alias("v"))
    assert "pd" not in embedding.embedded.__globals__  # no Series of a whole batch
    got = {r["k"]: r["v"] for r in vectors.collect()}
    assert all((got[k] is None) == (k % 5 == 0 or k % 7 == 0) for k in got) and all(v[1] == k and v[0] <= 4 for k, v in got.items() if v)


def test_listed_breaks_are_the_class_of_the_sql(spark):
    rows = spark.range(1, 0x30000).filter("(id < 55296 or id > 57343) and id <> 65279").selectExpr("id", "decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') as c")
    split = lambda pattern: F.split("c", pattern)
    assert rows.filter(~split(text.WORD_BREAKS).eqNullSafe(split(text._LISTED_BREAKS))).isEmpty() and rows.filter("length(c) <> 1").isEmpty()
    assert "á-ě" not in rows.select(text.words("c"))._jdf.queryExecution().toString()  # asked range after range it takes six times as long
    said = spark.createDataFrame([("Žluťoučký KŮŇ, x1-y2\n ×že÷ ĚÉ ˇ",)], "t string").select(text.words("t")).first()[0]
    assert said == ["žluťoučký", "kůň", "x1", "y2", "×že÷", "ěé"]


def test_lists_of_an_index_are_merged_whole(spark, tmp_path):
    index = postings.Index.created(spark, str(tmp_path / "i"), parts=2, span=100)
    docs = spark.range(-150, 350).selectExpr("id as doc_id", "concat('a', if(id % 3 = 0, ' b', '')) as text")
    index.add(docs)
    index.add(docs.filter("doc_id % 7 = 0").withColumn("text", F.lit("c")))
    index.remove(docs.filter("pmod(doc_id, 64) = 63 or doc_id = 0"))
    index.add(docs.filter("doc_id between 100 and 199 and doc_id % 2 = 0"))
    seen, write = [], postings.Index._write
    postings.Index._write = lambda self, found, segment: (seen.append(found), write(self, found, segment))[1]
    try:
        merged = index.merged(str(tmp_path / "m"))
    finally:
        postings.Index._write = write
    assert "Generate" not in seen[0]._jdf.queryExecution().toString().split("Join")[0]  # no list is exploded to its offsets
    for word in "abc":
        assert sorted(r[0] for r in merged.documents([word]).collect()) == sorted(r[0] for r in index.documents([word]).collect())
    last = {k: None if k % 64 == 63 or k == 0 else "c" if k % 7 == 0 else "ab" if k % 3 == 0 else "a" for k in range(-150, 350)}
    last |= {k: "ab" if k % 3 == 0 else "a" for k in range(100, 200, 2)}
    assert sorted(r[0] for r in merged.documents(["b"]).collect()) == [k for k, w in last.items() if w == "ab"]


def test_keyed_streams_get_their_state_with_their_rows(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id as event_id", "id % 9 as user_id", "timestamp_micros(id) as at")
    stream = feature_queries._landed(spark, rows, str(tmp_path / "in"), 3)
    wide = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 3 * wide > 3  # no task writes or reads all rows of a micro-batch
    seen = []
    usage.worked_off(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "check"))
    assert len(seen) == 3 and sum(seen) == 1000
    chunks = stream.selectExpr("user_id as document_id", "event_id as chunk_id", "event_id as seq", "'insert' as op", "true as embedded", "at")
    for df in (stateful.decided(stream, 3), stateful.pending_chunks(chunks)):
        plan = df._jdf.queryExecution().logical().toString()
        assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan


def test_windows_are_rolled_from_stored_hours(spark):
    events = spark.range(300).selectExpr("timestamp_seconds(1700000000 + pmod(xxhash64(id), 500000)) as at", "id % 4 as user_id")
    want = usage.rolling_counts(events).collect()
    hours = usage.step_counts(events)
    rolled = usage.rolled(hours.repartition("user_id"), 24)
    assert sorted(map(tuple, rolled.collect())) == sorted(map(tuple, want))
    stored = spark.createDataFrame(hours.collect(), hours.schema).repartition("user_id")
    plan = usage.rolled(stored, 24)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # rows are shuffled before they become 24


def test_pages_are_row_groups_of_few_files(spark, tmp_path, monkeypatch):
    rows = spark.range(0, 4600, 1, 2).withColumn("x", F.col("id") % 7)
    for part in (rows.filter("x < 3"), rows.filter("x >= 3"), rows.limit(0)):
        changes.append_pages(part, str(tmp_path / "pages"), 100)
    pages = changes.pages_written(spark, str(tmp_path / "pages")).collect()
    assert sum(r.n for r in pages) == 4600 and max(r.n for r in pages) == 100
    assert len({(r.file, r.page) for r in pages}) == len(pages) >= 46 and len({r.file for r in pages}) == 4  # one for each task
    assert spark.read.parquet(str(tmp_path / "pages")).exceptAll(rows).isEmpty()
    monkeypatch.setattr(changes, "PAGES", 5)  # a file ends after so many
    changes.append_pages(rows, str(tmp_path / "short"), 100)
    pages = changes.pages_written(spark, str(tmp_path / "short")).collect()
    assert sum(r.n for r in pages) == 4600 and max(r.page for r in pages) == 4
