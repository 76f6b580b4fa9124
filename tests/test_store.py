"""Stored tables: only buckets that a change meets are rewritten, failures leave nothing, versions come back, digests add up."""

import glob
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from inkwell.operators import digests, versions
from inkwell.operators import store as store_module
from inkwell.operators.store import HEAD, Store


def orders(spark, n=2000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 3).cast("string").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("b"))


def files(path):
    found = glob.glob(f"{path}/data/**/*.parquet", recursive=True)
    return {f: hashlib.md5(open(f, "rb").read()).hexdigest() for f in found}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    store = Store.created(orders(spark), path, "k", 64)
    before, entries = files(path), store.entries()
    new = spark.createDataFrame([(5, "x", 1.0), (17, "y", None), (-3, "z", 2.0)], "k bigint, a string, b double")
    assert store.changed(lambda old: versions.upserted(old, new, "k"), new) == 2
    after = files(path)
    assert {f: after[f] for f in before} == before  # byte for byte
    met = {r[0] for r in new.select(store._bucket()).collect()}
    later = store.entries()
    assert {b for b in entries if b != HEAD and later[b].commit != entries[b].commit} == met and len(met) == 3
    assert len({f.split("__bucket=")[1].split("/")[0] for f in set(after) - set(before)}) == 3
    want = [r for r in rows(orders(spark)) if r[0] not in (5, 17)] + rows(new)
    assert rows(store.rows()) == sorted(want, key=repr) and rows(store.rows(1)) == rows(orders(spark))
    assert store.digest() == tuple(int(x) for x in digests.digests(store.rows()).first())
    # the rows of three keys are read from their buckets alone
    assert rows(store.looked_up(new)) == rows(new)
    read = {f.split("__bucket=")[1].split("/")[0] for f in store.looked_up(new).inputFiles()}
    assert read == {str(b) for b in met}


@pytest.mark.parametrize("copied, listed", [(1, 1000), (10**9, 1000), (1, 0)])
def test_rows_that_stay_go_past_a_change(spark, tmp_path, monkeypatch, copied, listed):
    monkeypatch.setattr(store_module, "COPIED_ROWS", copied)
    monkeypatch.setattr(store_module, "COPIED_FILES", 2)
    monkeypatch.setattr(store_module, "LISTED", listed)
    none = spark.createDataFrame([(None, "none", 0.0)], "k bigint, a string, b double")
    store = Store.created(orders(spark, 1000).unionByName(none), str(tmp_path / "t"), "k", 4)
    given = []
    for at in range(4):
        new = orders(spark, 1000).filter(f"k % 100 = {at}").withColumn("a", F.lit("new"))
        new = new.unionByName(new.limit(1).withColumn("k", F.lit(-1 - at).cast("bigint")))
        store.changed(lambda old, new=new: (given.append(old.count()), versions.upserted(old, new, "k"))[1], new)
        # large buckets' rows aren't dealt anew, until these have too many files
        held = store.rows().groupBy(F.input_file_name()).agg(F.count_if(F.col("a") == "new").alias("new"), F.count("*").alias("n")).collect()
        if at == 0:
            assert all(r.new in (0, r.n) for r in held) == (copied == 1 and listed > 0)
        assert len(held) <= 12
    assert (max(given) <= 11) == (listed > 0)
    want = [(k, "new" if k % 100 < 4 else a, b) for k, a, b in rows(orders(spark, 1000))]
    got = rows(store.rows())
    assert [r for r in got if r[0] is None] == rows(none) and [r for r in got if r[0] is not None and r[0] >= 0] == sorted(want, key=repr)
    assert sorted(r[0] for r in got if r[0] is not None and r[0] < 0) == [-4, -3, -2, -1]
    assert store.digest() == tuple(int(x) for x in digests.digests(store.rows()).first())


def test_what_changes_nothing_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    store = Store.created(orders(spark, 300), path, "k", 8)
    same = orders(spark, 300).filter("k < 40")
    assert store.changed(lambda old: versions.upserted(old, same, "k"), same) == 1 and store.versions() == [1]
    none = same.limit(0)
    assert store.changed(lambda old: versions.upserted(old, none, "k"), none) == 1
    gone = same.select("k")
    assert store.changed(lambda old: old.join(gone, "k", "left_anti"), gone) == 2
    assert rows(store.rows()) == rows(orders(spark, 300).filter("k >= 40"))
    everything = orders(spark, 300).select("k")
    store.changed(lambda old: old.limit(0), everything)
    assert store.rows().count() == 0 and store.digest() == (0, 0, 0) and store.rows().columns == ["k", "a", "b"]
    store.changed(lambda old: versions.upserted(old, same, "k"), same)
    assert rows(store.rows()) == rows(same)


def test_a_killed_task_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    store = Store.created(orders(spark, 500), path, "k", 16)
    before = files(path)
    new = orders(spark, 500).filter("k % 10 = 1").withColumn("a", F.lit("new"))

    @F.udf("string")
    def dies(x):
        os._exit(1)

    def killed(old):
        # most buckets are written, the worker of one is killed
        return versions.upserted(old, new, "k").withColumn("a", F.when(F.col("k") == 491, dies("a")).otherwise(F.col("a")))

    with pytest.raises(Exception, match="(?i)worker|crash|exit"):
        store.changed(killed, new)
    again = Store.opened(spark, path)
    assert again.versions() == [1] and rows(again.rows()) == rows(orders(spark, 500))
    assert {f: h for f, h in files(path).items() if f in before} == before
    again.changed(lambda old: versions.upserted(old, new, "k"), new)
    want = rows(orders(spark, 500).filter("k % 10 <> 1").unionByName(new))
    assert rows(again.rows()) == want
    assert again.prune(keep=1) > 0 and rows(again.rows()) == want


def test_named_changes_count_once(spark, tmp_path):
    store = Store.created(orders(spark, 10), str(tmp_path / "t"), "k", 4)
    more = spark.createDataFrame([(99, "m", 0.0)], "k bigint, a string, b double")
    add = lambda old: old.unionByName(more)
    assert [store.changed(add, more, name="batch-1") for _ in range(2)] == [2, 2] and store.rows().count() == 11
    assert store.changed(lambda old: old.filter("k <> 99"), more, name="batch-2") == 3
    assert store.changed(add, more, name="batch-1") == 3 and store.rows().count() == 10
    with pytest.raises(ValueError, match="listed"):
        store.changed(lambda old: old.unionByName(orders(spark, 200)), more)
    assert store.versions() == [1, 2, 3]
    with pytest.raises(ValueError):
        store.changed(add, more, name="../x")


def test_null_and_compound_keys(spark, tmp_path):
    df = spark.createDataFrame([(None, "a", 1), (1, None, 2), (None, None, 3), (1, "a", 4)], "k bigint, l string, `v.x` int")
    store = Store.created(df, str(tmp_path / "t"), ["k", "l"], 4)
    assert rows(store.rows()) == rows(df)
    gone = spark.createDataFrame([(None, None)], "k int, l string")
    store.changed(lambda old: old.filter("k is not null or l is not null"), gone)
    assert rows(store.rows()) == rows(df.filter("`v.x` <> 3"))
    with pytest.raises(ValueError):
        Store.created(df.withColumn("__BUCKET", F.lit(1)), str(tmp_path / "u"), "k")


def test_backups_share_files_and_restore(spark, tmp_path):
    path = str(tmp_path / "t")
    runs = [orders(spark, 400), orders(spark, 400).withColumn("a", F.when(F.col("k") == 7, "new").otherwise(F.col("a"))), orders(spark, 390)]
    store = Store.created(runs[0], path, "k", 32)
    first = files(path)
    store.becomes(runs[1])
    assert len({f.split("__bucket=")[1].split("/")[0] for f in set(files(path)) - set(first)}) == 1  # one bucket was written
    store.becomes(runs[2])
    wanted = [tuple(int(x) for x in digests.digests(r).first()) for r in runs]
    assert [store.digest(v) for v in (1, 2, 3)] == wanted
    store.prune(keep=2)
    assert store.versions() == [2, 3] and [rows(store.rows(v)) for v in (2, 3)] == [rows(runs[1]), rows(runs[2])]
    store.becomes(runs[0])
    store.prune(keep=2)
    assert store.versions() == [3, 4]
    for v, want in ((3, wanted[2]), (4, wanted[0])):
        assert tuple(int(x) for x in digests.digests(store.rows(v)).first()) == want == store.digest(v)
    needed = {(e.commit, b) for v in (3, 4) for b, e in store.entries(v).items() if b != HEAD}
    assert {tuple(f.split("__commit=")[1].split("/")[:2]) for f in files(path)} == {(c, f"__bucket={b}") for c, b in needed}
    with pytest.raises(ValueError):
        store.prune(keep=0)
    with pytest.raises(ValueError):
        store.entries(1)


def test_two_writers_are_found_out(spark, tmp_path):
    path = str(tmp_path / "t")
    store = Store.created(orders(spark, 20), path, "k", 4)
    spark.read.parquet(f"{path}/manifest/version=1").write.mode("append").parquet(f"{path}/manifest/version=1")
    with pytest.raises(ValueError, match="two writers"):
        store.rows()


def test_digests(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", "x", 2), ("b", "x", 2), (None, "y", None)], "g string, s string, v int")
    whole = {r["g"]: tuple(r)[1:] for r in digests.digests(df, "g").collect()}
    assert whole["b"][0] == 2 and whole["a"][0] == 2
    # a null isn't its neighbour's value, repeated rows count, order and partitions don't
    swapped = spark.createDataFrame([("a", "1", None), ("a", None, "1")], "g string, s string, v string")
    assert len({tuple(r) for r in swapped.select(digests.row_hash(["s", "v"], 1)).collect()}) == 2
    assert {r["g"]: tuple(r)[1:] for r in digests.digests(df.select("v", "g", "s").repartition(3), "g").collect()} == whole
    parts = digests.added(digests.digests(df.filter("v = 1"), "g"), digests.digests(df.filter("v is null or v <> 1"), "g"), by=["g"])
    assert digests.compared(digests.digests(df, "g"), parts, "g").filter("not equal or n_left <> n_right").count() == 0
    touched = df.withColumn("s", F.when(F.col("g") == "b", "X").otherwise(F.col("s")))
    got = {r["g"]: r["equal"] for r in digests.compared(digests.digests(df, "g"), digests.digests(touched, "g"), "g").collect()}
    assert got == {"a": True, "b": False, None: True}
    lost = digests.compared(digests.digests(df, "g"), digests.digests(df.filter("g = 'a'"), "g"), "g").collect()
    assert sorted((tuple(r) for r in lost), key=repr) == sorted([("a", 2, 2, True), ("b", 2, 0, False), (None, 1, 0, False)], key=repr)
    assert digests.compared(digests.digests(df), digests.digests(df.distinct())).first()["equal"] is False


def test_late_rows_of_a_stream_never_replace_newer_ones(spark, tmp_path):
    from inkwell.streaming import usage

    schema = "k bigint, seq bigint, v string"
    batches = [[(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], [(1, 1, "late"), (3, 1, "d")], [(2, 6, "e"), (3, 1, "tie")]]
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    sink = usage.upserted_by_batch(str(tmp_path / "out"), "k", "seq", buckets=4)
    usage.worked_off(stream, sink, str(tmp_path / "check"))
    store = Store.opened(spark, str(tmp_path / "out"))
    assert {r[0]: r[1] for r in rows(store.rows())} == {1: 2, 2: 6, 3: 1} and len(store.versions()) == 4
    sink(spark.createDataFrame([(1, 99, "again")], schema), 2)  # a batch that was done
    assert {r[0]: r[1] for r in rows(store.rows())} == {1: 2, 2: 6, 3: 1}
