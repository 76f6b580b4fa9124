"""Lists in JSON documents, streamed: any shape and cut, early exit, bounded memory, conditions that reach the source."""

import gzip
import json
import os
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.sources import lists

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


def cut(data: bytes, size: int):
    return [data[k : k + size] for k in range(0, len(data), size)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(max_size=5), VALUES, max_size=3), st.lists(VALUES, max_size=5), st.integers(1, 30), st.booleans(), st.sampled_from([None, 2]))
def test_items_of_any_document(before, wanted, size, escaped, indent):
    before.pop("položky", None)
    data = json.dumps({**before, "položky": wanted, "after": [1, {"položky": [9]}]}, ensure_ascii=escaped, indent=indent).encode()
    got = list(lists.items(cut(data, size), "položky"))
    assert [x for x, _ in got] == wanted and [json.loads(t) for _, t in got] == wanted
    assert [x for x, _ in lists.items(lists.unpacked(cut(gzip.compress(data[:40]) + gzip.compress(data[40:]), size)), "položky")] == wanted


def test_odd_documents():
    assert list(lists.items([b'{"a": 1}'], "b")) == [] and list(lists.items([b"{}"], "b")) == [] and list(lists.items([b'{"b": null}'], "b")) == []
    assert [x for x, _ in lists.items([b"\xef\xbb\xbf [1, 23", b"4, -5] "], None)] == [1, 234, -5] and list(lists.items([b"[]"], None)) == []
    for bad in (b'{"b": [1 2]}', b'{"b": [1', b'{"b": 3}', b"[1]", b"", b'{"b": [{"x": tru}]}'):
        with pytest.raises(ValueError):
            list(lists.items([bad], "b"))
    assert list(lists.unpacked([b""])) == [b""]


def test_reading_stops_when_all_were_seen():
    taken = []

    def pieces():
        yield b'{"head": {"x": [1, 2, {"y": []}]}, "l": ['
        for k in range(1000):
            taken.append(k)
            yield b'{"id": %d, "t": "x"},' % k
        yield b"0]}"

    got = list(lists.chosen(lists.items(pieces(), "l"), "id", frozenset({"3", "41"}), True))
    assert [k for k, _ in got] == ["3", "41"] and len(taken) <= 43
    assert list(lists.chosen(lists.items([b'[{"id": "a"}, {"id": "a"}, 5, {"x": 1}]'], None), "id", frozenset({"a"}), False)) == [("a", '{"id": "a"}')] * 2


def test_memory_is_that_of_a_piece():
    """200 MB of one list pass through a process that grows by less than 40 MB."""
    code = """
import resource, gzip
from inkwell.sources import lists
def pieces():
    yield b'{"other": [' + b'[1, 2, 3],' * 100 + b'0], "l": ['
    for k in range(200):
        yield b''.join(b'{"id": %d, "t": "%s"},' % (k * 1000 + i, b'x' * 1000) for i in range(1000))
    yield b'{"id": -1, "t": ""}]}'
n, before = 0, None
for x, t in lists.items(pieces(), "l"):
    n += 1
    if n == 5000:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)), check=True).stdout.split()
    assert int(out[0]) == 200_001 and int(out[1]) < 40_000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("lists")
    for f in range(2):
        found = [{"klíč": f"k{f}-{k}", "n": k, "t": os.urandom(60).hex()} for k in range(60_000)]
        with gzip.open(path / f"{f}.json.gz", "wb") as out:
            out.write(json.dumps({"meta": {"x": 1}, "položky": found}, ensure_ascii=False).encode())
    return str(path)


def test_wanted_items(spark, folder):
    schema = "`klíč` string, n int"
    wanted = spark.createDataFrame([("k0-5",), ("k1-7",), ("k0-5",), (None,), ("none",)], "k string")
    want = [("k0-5", 5), ("k1-7", 7)]
    assert sorted(map(tuple, lists.wanted_items(spark, folder, "položky", "klíč", schema, wanted).collect())) == want
    assert sorted(map(tuple, lists.wanted_items(spark, folder, "položky", "klíč", schema, wanted, most_listed=2).collect())) == want
    assert lists.wanted_items(spark, folder, "položky", "klíč", schema, wanted.limit(0)).count() == 0
    all_rows = lists.json_list(spark, folder, "položky", "klíč")
    assert all_rows.count() == 120_000 and all_rows.rdd.getNumPartitions() == 2
    assert all_rows.select("key", F.from_json("value", schema)["klíč"].alias("k")).filter("key <> k").count() == 0


def test_bytes_are_left_unread(spark, folder):
    # one file: its two keys are near the beginning
    early = lists.json_list(spark, folder + "/0.json.gz", "položky", "klíč", unique=True, wanted=["k0-3", "k0-900"]).collect()
    assert len(early) == 2 and all(r["bytes"] > 4_000_000 and r["bytes_read"] <= 2 * lists.PIECE for r in early)
    late = lists.json_list(spark, folder + "/0.json.gz", "položky", "klíč", unique=True, wanted=["k0-59999"]).collect()
    assert late[0]["bytes_read"] == late[0]["bytes"]


def test_conditions_reach_the_source(spark, folder):
    spark.conf.set(lists.PUSHDOWN, "true")
    try:
        rows = lists.json_list(spark, folder + "/0.json.gz", "položky", "klíč", unique=True)
        got = rows.filter(F.col("key").isin("k0-1", "k0-2") & (F.col("key") != "k0-2")).collect()
        assert [r["key"] for r in got] == ["k0-1"] and got[0]["bytes_read"] < got[0]["bytes"]
        assert rows.filter("key = 'k0-4' and key = 'k0-5'").count() == 0
        assert rows.filter("bytes_read >= 0").count() == 60_000
    finally:
        spark.conf.unset(lists.PUSHDOWN)
