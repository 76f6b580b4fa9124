"""Filter audit, fingerprints and centroid clusters: brute force, SQL, odd rows."""

import base64
import hashlib
import itertools
import re
import struct

import brute
import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkwell.llm import audit, centroids, queries
from inkwell.llm import fingerprint as fp
from inkwell.session import table

SF = "/root/testdata/sf0.001"


def sql_rows(name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    return [d[0] for d in cursor.description], sorted(cursor.fetchall())


def walked(docs, labels):
    """The audit, document by document, order by order. docs: (doc_id, text, source), labels: (doc_id, quality, toxic)."""
    texts = {}
    for k, t, _ in docs:
        texts.setdefault(t or "", []).append(k)
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    rows = []
    for k, t, s in docs:
        t = t or ""
        words = brute.VISIBLE.findall(t)
        n = len(words)
        same = texts[t]
        copy = any(x is not None for x in same) if k is None else any(x is not None and x < k for x in same)
        fails = {x for x, bad in zip("ABCDE", (n < 50, 100 * len(set(words)) < 65 * n, 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), copy), strict=True) if bad}
        rows.append((s or "", fails, k in good, k in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                kept = [r for r in left if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                out[part, "".join(order), step] = [len(kept), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[f] += len(gone)
                left = kept
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return sorted((*k, *v) for k, v in out.items())


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_query(spark):
    got = sorted(tuple(r) for r in queries.op11_filter_audit(spark, SF).select(*AUDIT).collect())
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in table(spark, SF, "labels").select("doc_id", "quality", "toxic").collect()]
    assert got == walked(docs, labels)
    names, want = sql_rows("op11_filter_audit")
    assert got == sorted(tuple(r[names.index(c)] for c in AUDIT) for r in want)


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [
        (1, None, None), (2, "", ""), (None, "", "a"), (3, " \t\n", "a"), (4, "A B", "b"), (4, "A B", "b"), (5, "A B", "a"), (6, long, "c"), (7, long + " #", "c"),
        (8, "one one " * 60, "c"), (None, "lonely", "b"), (None, "lonely", "b"), (9, "Žluť   x y", None), (2, "", "a"),
    ]
    marks = [(5, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (4, 1, None), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit("x") for c in ("key", "n", "part", "words", "digest", "Fails", "good", "a.b", "edge")})
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").withColumn("Key", F.lit(1))
    got = audit.audit(docs, labels)
    assert sorted(tuple(r) for r in got.select(*AUDIT).collect()) == walked(rows, marks)
    assert got.filter("substring(filter_order, step, 1) <> filter").count() == 0
    assert audit.audit(docs.limit(0), labels).count() == 0
    bare = audit.audit(docs)
    assert bare.count() == 600 * 4 and bare.filter("good_lost + toxic_lost > 0").count() == 0
    assert audit.audit(docs, labels.limit(0)).exceptAll(bare).count() == 0


def test_audit_with_other_filters(spark):
    """Filters are a parameter; any number of them, with or without that of copies."""
    docs = spark.createDataFrame([(1, "x", "s"), (2, "x", "s"), (3, "xy", "s")], "doc_id bigint, text string, source string")
    got = audit.audit(docs, filters={"X": lambda text, words: F.length(text) == 1}, copies=None)
    assert [tuple(r[c] for c in AUDIT) for r in got.collect()] == [("s", "X", 1, 1, 2, 0, 2, 0, 0, 2)]
    got = audit.audit(docs, filters={"X": lambda text, words: F.length(text) == 1}, copies="D")
    assert sorted(tuple(r[c] for c in AUDIT) for r in got.collect()) == [("s", "DX", 1, 2, 1, 0, 0, 0, 0, 1), ("s", "DX", 2, 1, 1, 1, 1, 0, 0, 3), ("s", "XD", 1, 1, 2, 0, 1, 0, 0, 3), ("s", "XD", 2, 1, 0, 1, 0, 0, 0, 1)]
    with pytest.raises(ValueError):
        audit.audit(docs, copies="A")


def plain_sketch(text, k=fp.SIZE, width=fp.WIDTH):
    words = brute.VISIBLE.findall((text or "").translate(brute.LOWER))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashed = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    found = set()
    for place in range(max(1, len(hashed) - width + 1)) if hashed else ():
        seed = 42
        for h in hashed[place : place + width]:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed)
        found.add(signed(seed))
    return sorted(found)[:k]


def likeness(a, b, k=fp.SIZE):
    union = sorted(set(a) | set(b))[:k]
    return len([x for x in union if x in a and x in b]) / len(union) if union else 1.0


def fingerprints(docs):
    """By descending key (null last), then text; the first follows the last."""
    ordered = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for place, (key, text) in enumerate(ordered):
        text, after = text or "", ordered[(place + 1) % len(ordered)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(after)
        shown = [base64.b64encode(b"".join(struct.pack(">q", x) for x in s)).decode() for s in (a, b)]
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), *shown, likeness(a, b), likeness(a, c)))
    return sorted(out, key=repr)


PRINTS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def test_fingerprint_query(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op12_fingerprints(spark, SF).select(*PRINTS).collect()), key=repr)
    assert got == fingerprints(docs)
    enough = [r for r in got if r[1] >= 400]
    assert sum(r[5] > r[6] for r in enough) >= 0.97 * len(enough)


@pytest.mark.parametrize("range_rows", [1, 2, 5, 1000])
def test_fingerprints_of_odd_rows(spark, range_rows):
    long = " ".join(f"slovo{k}" for k in range(20_000))
    rows = [(5, None), (7, ""), (7, "b"), (7, "a"), (7, "a"), (None, "bez klíče"), (None, None), (3, " \t"), (2, "jedno dvě"), (1, long), (0, "😀" * 10), (-4, "x y z " * 50), (9, "A B C d e f"), (8, "a b c D E F")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("key", "range", "sketch", "ahead", "a.b", "Text2")})
    found = fp.edited_pairs(docs, range_rows=range_rows)
    got = found.select("key", "n_chars", F.sha2("edited", 256), fp.written_out(F.col("sketch")), fp.written_out(F.col("edited_sketch")), fp.resemblance(F.col("sketch"), F.col("edited_sketch")), fp.resemblance(F.col("sketch"), F.col("next_sketch")))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == fingerprints(rows)
    assert fp.edited_pairs(docs.limit(0), range_rows=range_rows).count() == 0
    assert fp.edited_pairs(docs.filter("doc_id = 1"), range_rows=range_rows).select("edited").first()[0] == long[: len(long) - len(long) // 3] + long[: len(long) // 3]


def test_neighbours_across_many_ranges(spark):
    rows = spark.range(3000).select((F.col("id") * 7 - 900).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = fp.with_next(rows, range_rows=10)
    assert got.select("range").distinct().count() > 100
    got = got.withColumn("after", F.lead("text").over(fp.following())).filter("not ahead")
    assert {(r["text"], r["after"]) for r in got.collect()} == {(str(k), str((k - 1) % 3000)) for k in range(3000)}


def test_sketches_estimate_and_merge(spark):
    rng = np.random.default_rng(7)
    left = [f"v{x}" for x in rng.integers(0, 10**6, 6000)]
    right = left[2000:] + [f"u{x}" for x in rng.integers(0, 10**6, 4000)]
    rows = spark.createDataFrame([(" ".join(left), " ".join(right))], "a string, b string")
    a, b = (fp.sketch(F.col(c), 512) for c in "ab")
    r = rows.select(fp.resemblance(a, b, 512).alias("r"), fp.containment(a, b, 512).alias("c"), fp.distinct_count(a, 512).alias("n"), fp.merged(a, b, 512).alias("m"), a.alias("a"), b.alias("b")).first()
    assert r["r"] == pytest.approx(0.4, abs=0.09) and r["c"] == pytest.approx(2 / 3, abs=0.12) and r["n"] == pytest.approx(5996, rel=0.15)
    assert r["m"] == sorted(set(plain_sketch(" ".join(left), 512)) | set(plain_sketch(" ".join(right), 512)))[:512]
    docs = table(spark, SF, "documents").select("source", "text")
    got = {x["source"]: x["sketch"] for x in fp.merged_by(docs.select("source", fp.sketch(F.col("text")).alias("sketch")), "source").collect()}
    want = {}
    for x in docs.collect():
        want.setdefault(x["source"], set()).update(plain_sketch(x["text"]))
    assert got == {s: sorted(v)[: fp.SIZE] for s, v in want.items()}
    back = docs.select(fp.sketch(F.col("text")).alias("s")).filter(~F.col("s").eqNullSafe(fp.read_back(fp.written_out(F.col("s")))))
    assert back.count() == 0
    none = spark.createDataFrame([("", None, "x")], "a string, b string, c string").select(*[fp.sketch(F.col(c)).alias(c) for c in "abc"])
    assert tuple(none.select(fp.resemblance(F.col("a"), F.col("b")), fp.resemblance(F.col("a"), F.col("c")), fp.containment(F.col("b"), F.col("c")), fp.distinct_count(F.col("a"))).first()) == (1.0, 0.0, 1.0, 0.0)


CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_query(spark):
    got = sorted(tuple(r) for r in queries.op13_centroid_clusters(spark, SF).select(*CLUSTERS).collect())
    names, want = sql_rows("op13_centroid_clusters")
    assert got == sorted(tuple(r[names.index(c)] for c in CLUSTERS) for r in want)


def plain_clusters(rows, k, rounds=10, size=64, seed=3):
    """rows: (vec_id, list). All distances of all vectors, with Python's integers."""
    kept = [(key, [int(np.floor(1024 * float(x))) for x in v]) for key, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(members[n]) for x in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centres)]
    found = [(key, *nearest(v)[::-1]) for key, v in kept]
    total = {}
    for _, c, d in found:
        total[c] = total.get(c, 0) + d
    return sorted(((key, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for key, c, d in found), key=repr)


def test_clusters_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(centroids, "TREE_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(k % 5 * 3, 0.05, 64)]) for k in range(150)]
    rows += [(500 + k, [0.5] * 64) for k in range(60)] + [(7, [-0.0005] * 64), (7, [-0.0005] * 64), (None, [1.0] * 64), (None, [2.0] * 64)]
    bad = [(900, None), (901, [1.0] * 63), (902, []), (903, [1.0] * 63 + [None]), (904, [1.0] * 63 + [float("nan")]), (905, [float("-inf")] * 64), (906, [1.0] * 65)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("key", "v", "x", "Cluster", "a.b")}).repartition(3)
    got = sorted((tuple(r) for r in centroids.clustered(df).select(*CLUSTERS).collect()), key=repr)
    assert got == plain_clusters(rows + bad, 8)
    few = df.filter("vec_id in (1, 2, 903)")
    assert sorted((tuple(r) for r in centroids.clustered(few).collect()), key=repr) == plain_clusters([r for r in rows + bad if r[0] in (1, 2, 903)], 8)
    empty = centroids.clustered(df.filter("vec_id = 901"))
    assert empty.count() == 0 and empty.columns == list(CLUSTERS)
    big = spark.createDataFrame([(1, [1e9] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(big).collect()


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.uniform(-60_000, 60_000, 64)]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    with pytest.raises(OverflowError):
        centroids.clustered(df.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), k=1).collect()
    assert sorted((tuple(r) for r in centroids.clustered(df, k=3).collect()), key=repr) == plain_clusters(rows, 3)


def test_balls_are_assigned_whole():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-40, 40, (400, 64)) + 4000 * k for k in range(4)]).astype(np.int32)
    tree, order = centroids.Tree.built(points)
    assert sorted(order) == list(range(1600)) and (tree.points == points[order]).all()
    for (begin, end, _), radius, total in zip(tree.nodes, tree.radius, tree.sums, strict=True):
        part = tree.points[begin:end]
        assert (total == part.sum(axis=0)).all()
        assert np.sqrt(((part - total / (end - begin)) ** 2).sum(axis=1)).max() <= radius
    fixed = np.array([points[0], points[400], points[800], points[1200]], dtype=np.int64)
    whole, owner, single = tree.walked(fixed)
    assert len(single) == 0 and len(whole) <= 16 and tree.counts[whole].sum() == 1600
    near = np.array([points[0], points[1], points[2], points[3]], dtype=np.int64)
    whole, owner, single = tree.walked(near)
    assert len(single) > 0 and tree.counts[whole].sum() + len(single) == 1600
    for node, c in zip(whole, owner, strict=True):
        begin, end, _ = tree.nodes[node]
        assert (tree.nearest(np.arange(begin, end), near)[0] == c).all()
