"""The stored word index: the rows of a search that reads every text, from the parts of the asked words alone."""

import glob
import random
import re
import shutil

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import postings, retrieval
from inkwell.operators.postings import Index

WORDS = ["zákon", "obec", "lhůta", "x1", "a", "že", "soud", "všude"]
#: The word class of the search text, written out for Python.
BREAK = re.compile(text.WORD_BREAKS)


def made(n, seed):
    rng = random.Random(seed)
    return [(k * 3 - 50, "Všude, " + " ".join(rng.choice(WORDS[:7]) + rng.choice([" ", "-", ".\n"]) for _ in range(rng.randint(0, 5)))) for k in range(n)]


def plain(docs, terms, every=False):
    have = {}
    for k, t in docs:
        have.setdefault(k, set()).update(BREAK.split((t or "").lower()))
    return sorted(k for k, ws in have.items() if k is not None and (set(terms) <= ws if every else set(terms) & ws))


def ids(df):
    out = [r["id"] for r in df.collect()]
    assert len(out) == len(set(out))
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


ODD = [(None, "soud"), (100_000, None), (100_001, ""), (100_002, "  \n"), (7, "soud"), (7, "obec"), (-(10**12), "x1 " * 5000)]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = made(400, 1) + ODD
    path = str(tmp_path_factory.mktemp("index") / "i")
    index = Index.created(spark, path, parts=16, span=32)
    assert index.add(frame(spark, docs)) == 1
    return Index.opened(spark, path), docs


@pytest.mark.parametrize("terms", [["soud"], ["Soud", "obec"], ["všude", "x1", "že"], ["nikde"], ["nikde", "soud"], ["a", "a"]])
def test_searches(built, terms):
    index, docs = built
    low = [t.lower() for t in terms]
    assert ids(index.documents(terms)) == plain(docs, low)
    assert ids(index.documents(terms, every=True)) == plain(docs, low, every=True)
    for k in (1, 12, 10_000):
        assert [r["id"] for r in index.first(terms, k).collect()] == plain(docs, low)[:k]
    assert {r["term"]: r["n"] for r in index.counts(terms).collect()} == {t: n for t in set(low) if (n := len(plain(docs, [t])))}
    pieces = [t[:2] for t in low]
    has = lambda t, p: p in (t or "").lower()
    assert ids(index.containing(pieces)) == sorted({k for k, t in docs if k is not None and any(has(t, p) for p in pieces)})


def test_no_words(built):
    index, _ = built
    assert index.documents([]).count() == 0 and index.first([], 5).count() == 0
    with pytest.raises(ValueError):
        index.documents([], every=True)
    with pytest.raises(ValueError):
        index.containing([])


def test_only_the_parts_of_the_words_are_read(spark, built, tmp_path):
    index, docs = built
    path = str(tmp_path / "copy")
    shutil.copytree(index.path, path)
    lone = Index.opened(spark, path)
    part = lone.spark.range(1).select(lone._part(F.lit("soud"))).first()[0]
    gone = [f for f in glob.glob(f"{path}/postings/segment=1/part=*") if not f.endswith(f"part={part}")]
    for f in gone:
        shutil.rmtree(f)
    assert len(gone) >= 4 and ids(lone.documents(["soud"])) == plain(docs, ["soud"])
    assert re.search(rf"PartitionFilters: \[[^\]]*part#\d+ (= {part}\)|IN \({part}\))", index._of(["soud"])._jdf.queryExecution().toString())
    # the first documents of a frequent word are found in its first blocks
    plan = index.first(["všude"], 5)._jdf.queryExecution().toString()
    assert "block" in plan and re.search(r"LessThanOrEqual\(block,-?\d+\)", plan)


def test_segments_replace_and_remove(spark, tmp_path):
    docs = dict(made(200, 2))
    index = Index.created(spark, str(tmp_path / "i"), parts=8, span=64)
    index.add(frame(spark, list(docs.items())), new=True)
    for seed, n in ((3, 60), (4, 30)):
        again = {k: t + " nové" for k, t in made(n, seed)}
        index.add(frame(spark, list(again.items())))
        docs |= again
    gone = [k for k in docs if k % 4 == 1]
    index.remove(frame(spark, [(k, None) for k in gone]))
    docs = {k: t for k, t in docs.items() if k not in gone}
    index.add(frame(spark, [(gone[0], "soud zpět")]))
    docs[gone[0]] = "soud zpět"
    # a segment that wasn't finished has no line: its postings count for nothing
    index._write(spark.createDataFrame([("soud", 0, [1, 2, 3])], "term string, block bigint, ids array<int>"), 6)
    assert index._next() == 6
    merged = index.merged(str(tmp_path / "m"))
    for one in (index, merged):
        for terms in (["soud"], ["soud", "nové"], ["zpět", "všude"]):
            assert ids(one.documents(terms)) == plain(list(docs.items()), terms)
            assert ids(one.documents(terms, every=True)) == plain(list(docs.items()), terms, every=True)
            assert [r["id"] for r in one.first(terms, 9).collect()] == plain(list(docs.items()), terms)[:9]
    assert sum(r["n"] for r in merged.counts(["všude"]).collect()) == len(plain(list(docs.items()), ["všude"]))
    assert merged._segments().count() == 1


def test_the_same_words_as_the_search_of_texts(spark, built):
    index, docs = built
    rows = frame(spark, [d for d in docs if d[0] is not None])
    for every in (False, True):
        want = retrieval.keyword_hits(rows, "text", ["soud", "že"], "doc_id", k=10_000, every=every).select("doc_id").distinct()
        got = {r["id"] for r in index.documents(["soud", "že"], every).collect()}
        assert {r[0] for r in want.collect()} == got - ({7} if every else set())


def test_staged(spark, built):
    index, docs = built
    exact = spark.createDataFrame([(7,), (999_999,)], "n int")
    got = {r["id"]: (r["stage"], r["match"]) for r in postings.staged(index, exact, ["soud", "obec"]).collect()}
    every, any_ = plain(docs, ["soud", "obec"], True), plain(docs, ["soud", "obec"])
    assert got == {k: (2, "fulltext_volne") for k in any_} | {k: (1, "fulltext") for k in every} | {7: (0, "cislo"), 999_999: (0, "cislo")}
