"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing extra columns: each operator's defined results."""

import math
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import chat, common, components, decontam, dedup, license, lm, mixing, neardup, tokens, toxicity, warc

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "slovo " * 60_000 + "konec"


def frame(spark, *rows):
    """doc_id, text, and columns that are called like things operators make."""
    full = [(k, t, None, s, None) for k, t, s in rows]
    df = spark.createDataFrame(full, DOC)
    return df.withColumns({c: F.lit("x") for c in ("row", "n", "score", "rid", "digest", "n_tokens", "kept", "size", "copies", "items", "draw")})


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "jedno slovo", "b"), (5, "jedno  slovo", None), (5, "jedno  slovo", None), (None, "jedno slovo", "b"), (7, LONG, "c"), (8, LONG + " x", "c"))


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark).limit(0)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_exact_dedup(spark, odd, none):
    got = collected(dedup.decisions(odd), "doc_id", "keep_id", "group_size", "kept")
    by = {}
    for row in got:
        by.setdefault(row[0], []).append(row[1:])
    assert by[1] == [(1, 2, True)] and by[2] == [(1, 2, False)] and by[3] == [(3, 1, True)]
    assert by[4] == [(4, 4, True)] and by[5] == [(4, 4, False)] * 2 and by[None] == [(4, 4, False)]
    kept = dedup.deduplicated(odd)
    assert kept.columns == odd.columns and collected(kept, "doc_id") == [(1,), (3,), (4,), (7,), (8,)]
    assert dedup.decisions(none).count() == 0 and dedup.deduplicated(none).count() == 0
    same = frame(spark, (9, "a", None), (9, "a", None), (None, "b", None), (None, "b", None))
    assert collected(dedup.deduplicated(same), "doc_id") == [(9,), (None,)]


def test_exact_dedup_separates_texts_of_one_digest(spark, monkeypatch):
    monkeypatch.setattr(dedup.F, "sha2", lambda c, n: F.lpad(F.hex(F.length(c).cast("long")), 64, "0"))
    docs = frame(spark, (1, "aa", None), (2, "bb", None), (3, "aa", None), (4, "bb", None), (5, "cc", None))
    assert collected(dedup.decisions(docs), "doc_id", "keep_id", "group_size") == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 2, 2), (5, 5, 1)]


def test_exact_dedup_in_batches(spark):
    """Batches, however many, give what one gives; runs that hold nothing of a batch are skipped by their filters."""
    texts = {1: ["a", "b", "c", "c"], 2: ["d", "e"], 3: ["b", "f", "a"], 4: ["g"], 5: ["g", "c"], 6: ["h"]}
    rows, key = [], 100
    for batch, found in texts.items():
        for t in found:
            rows.append((key, t, batch))
            key -= 1
    table = spark.createDataFrame(rows, "id bigint, text string, batch int").withColumn("digest", dedup.digest_of(F.col("text")))
    whole, index = dedup.Index(), dedup.Index()
    whole.insert(table.select("digest", "id"))
    for batch in texts:
        index.insert(table.filter(F.col("batch") == batch).select("digest", "id"))
    assert collected(index.groups()) == collected(whole.groups()) and len(collected(whole.groups())) == 4
    # 1 has nothing of 2; 1 is read for 3; 2 and 4 hold nothing of what follows; four runs became one
    assert index.merges == 1 and [len(level) for level in index.levels] == [2, 1]
    assert index.skipped >= 6 and index.looked_up >= 2 and index.looked_up + index.skipped == 0 + 1 + 2 + 3 + 1 + 2
    docs = table.select(F.col("id").alias("doc_id"), "text").repartition(3)
    assert collected(dedup.decisions(docs, batches=1)) == collected(dedup.decisions(docs, batches=5))


def test_exact_dedup_needs_its_look_ups(spark, monkeypatch):
    """10,000 rows with copies near and far: several levels at the end, ranges that are skipped, and no group without a hit."""
    rows = spark.range(10_000).select((9_999 - F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") % 2500 == 17, F.lit(17)).when(F.col("id").isin(41, 42, 8000), F.lit(-1)).otherwise(F.col("id")).cast("string")).alias("text"))
    seen = []

    class Watched(dedup.Index):
        def groups(self):
            seen.append(self)
            return super().groups()

    monkeypatch.setattr(dedup, "Index", Watched)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in dedup.decisions(rows).filter("group_size > 1").collect()}
    first, second = [9_999 - 17 - 2500 * k for k in range(4)], [9_999 - k for k in (41, 42, 8000)]
    assert got == {k: (min(g), len(g), k == min(g)) for g in (first, second) for k in g}
    assert seen[0].merges == 1 and seen[0].skipped + seen[0].looked_up == 0 + 1 + 2 + 3 + 1 + 2
    assert seen[0].ranges_read <= 12 and seen[0].ranges_read + seen[0].ranges_skipped == 9 * 8

    class Blind(dedup.Index):
        """An index whose look-ups find nothing in other batches."""

        def _look_up(self, batch):
            return ([],)

    monkeypatch.setattr(dedup, "Index", Blind)
    assert dedup.decisions(rows).filter("group_size > 1").count() < len(got)


def test_near_duplicates(spark, odd, none):
    got = collected(neardup.near_duplicates(odd, width=4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True), (7, 2, 7, True), (8, 3, 8, True)], key=repr)
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.deduplicated(odd, width=4)
    assert kept.columns == odd.columns and kept.count() == 7


def _family(n, words=120, changes=6, seed=0):
    """n near copies of one text, each with other words at some places."""
    import random

    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(words), rng.randrange(changes)):
            copy[at] = f"v{rng.randrange(5000)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    texts = [t for seed in range(6) for t in _family(25, seed=seed)]
    shared = " ".join(f"p{k}" for k in range(30))
    texts += [shared + " " + " ".join(f"q{seed}x{k}" for k in range(60)) for seed in range(80)]
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.near_duplicates(rows)
    assert collected(neardup.near_duplicates(docs, width=4), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    # the same by the ways that large groups and nodes take
    monkeypatch.setattr(neardup, "GROUP_ROWS", 10)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    monkeypatch.setattr(neardup, "LEAF_PAIRS", 30)
    monkeypatch.setattr(neardup, "GROUP_PAIRS", 30)
    monkeypatch.setattr(neardup, "LEVELS", 2)
    assert collected(neardup.near_duplicates(docs, width=4), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)


@pytest.mark.parametrize("waiting", [1 << 24, 0])
def test_leaves_of_all_levels_are_compared_at_once(spark, monkeypatch, waiting):
    shared = " ".join(f"p{k}" for k in range(30))
    rows = list(enumerate([shared + " " + " ".join(f"q{seed}x{k}" for k in range(60)) for seed in range(60)] + _family(30), 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    names, write = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name, *more, **named: (names.append(name), write(df, name, *more, **named))[1])
    monkeypatch.setattr(neardup, "LEAF_PAIRS", 30)
    monkeypatch.setattr(neardup, "WAITING_ROWS", waiting)
    got = collected(neardup.near_duplicates(docs, width=4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute.near_duplicates(rows), key=repr)
    assert "path-live3" in names and (names.count("path-leaves") == 1) == (waiting > 0)
    # a pair's marks are a byte for each token
    assert {len(r[0]) for r in neardup.sketches(docs, 4).select("marks").collect()} == {neardup.TOKENS}


@pytest.mark.parametrize("one_task", [1000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = dict(collected(components.components(chain), "hi", "lo"))
    assert got == {k: 1 for k in range(2, 21)} | {101: 100}
    assert components.components(chain.limit(0)).count() == 0


def taken(f):
    """Bytes that f takes at most, and what it returns."""
    tracemalloc.start()
    try:
        out = f()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_components_of_one_task_take_a_hundred_bytes_a_link():
    n, rows = 30_000, np.random.default_rng(1).permutation(60_000)
    links = [pa.RecordBatch.from_arrays([pa.array(rows[k : k + 500]), pa.array(rows[n + k : n + k + 500])], names=["hi", "lo"]) for k in range(0, n, 500)]
    most, out = taken(lambda: list(components._joined(iter(links))))
    got = {x: y for b in out for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert got == {max(x, y): min(x, y) for x, y in zip(rows[:n].tolist(), rows[n:].tolist(), strict=True)}
    assert most <= 100 * n
    chain = pa.RecordBatch.from_arrays([pa.array(rows[1:]), pa.array(rows[:-1])], names=["hi", "lo"])
    assert sum(b.num_rows for b in components._joined(iter([chain]))) == 59_999 and {y for b in components._joined(iter([chain])) for y in b.column(1).to_pylist()} == {0}
    assert list(components._joined(iter([]))) == []


def test_a_group_of_full_sets_takes_few_times_its_bytes(monkeypatch):
    draw, m, k = np.random.default_rng(2), 400, 500
    sets = np.tile(draw.integers(0, 1 << 63, k, dtype=np.uint64), (m, 1))
    for row in sets:
        row[draw.integers(0, k, 80)] = draw.integers(0, 1 << 63, 80, dtype=np.uint64)
    sets[m // 2 :] ^= np.uint64(1)
    sets.sort(axis=1)
    blobs = [x.tobytes() for x in sets]
    ids = np.arange(m)
    parts = (pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), dtype=np.int64)), pa.array(x), pa.array([blobs[i] for i in x], pa.binary())], names=["grp", "rid", "set"]) for x in np.split(ids, 8))
    before = pa.total_allocated_bytes()
    for group in neardup.grouped(parts, ["grp"]):
        # the last part, in its own memory, may stay; the others are gone
        assert pa.total_allocated_bytes() - before <= 1.3 * sets.nbytes
        members, n = neardup._views(group.column("set").slice(1))
        assert (n == k).all() and (members.reshape(-1, k) == sets[1:]).all()
        members, n = neardup._views(group.column("set"))
        results = []
        for counted in (1 << 12, 1 << 30):
            monkeypatch.setattr(neardup, "COUNTED", counted)
            most, out = taken(lambda: neardup.exact_links(members, n, ids, ids, 50))
            results.append(out)
            assert most <= 4.2 * sets.nbytes or counted > 1 << 12
        assert results[0] == results[1] and len(results[0]) == m - 2 and {(x < m // 2) == (y < m // 2) for x, y in results[0]} == {True}


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "Slovo slovo"), (2, None), (3, ""), (None, "konec"), (10, "slovo slovo")], "item_id bigint, text string")
    items = [("1", "Slovo slovo"), ("", "konec"), ("10", "slovo slovo")]
    got = decontam.matched(odd, bench)
    want = brute.decontamination([(r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in odd.collect()], items)
    rows = collected(got, F.coalesce("row.c0", F.lit(-1)).alias("d"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"))
    assert rows == sorted(((w[0], w[1], w[2], w[3]) for w in want), key=repr)
    assert decontam.matched(none, bench).count() == 0
    assert decontam.decontaminated(odd, bench.limit(0)).count() == odd.count()
    kept = decontam.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.filter("doc_id in (7, 8)").count() == 0


def test_decontamination_in_blocks_and_spans(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(["x", *words[3:40], "y", *words[20:34]])), (2, " ".join(words[:12])), (3, "a b")], "doc_id bigint, text string")
    items = [("i1", " ".join(words)), ("i2", " ".join(words[18:36])), ("i3", "b"), ("i4", "zz")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = decontam.matched(docs, bench)
    first = {r["row"]["c0"]: r for r in whole.collect()}
    spans = sorted((s["item_id"], s["item_word"], s["doc_word"], s["n_words"]) for s in first[1]["spans"])
    assert max(n for *_, n in spans) >= 33 and first[1]["items"] == ["i1", "i2"] and first[2]["n_hit"] == 0 and first[3]["items"] == ["i3"]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    for r in decontam.matched(docs, bench).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == (first[r["row"]["c0"]]["n_words"], first[r["row"]["c0"]]["n_hit"], first[r["row"]["c0"]]["items"])


def test_decontamination_spans_are_longest_matches(spark):
    """An item whose middle also stands in an earlier item is still found as a whole; no span is part of another of its diagonal."""
    a, b = [f"a{k}" for k in range(20)], [f"b{k}" for k in range(40)]
    shared = [f"m{k}" for k in range(15)]
    items = [("i1", " ".join([*a, *shared, "z"])), ("i2", " ".join([*b[:20], *shared, *b[20:]]))]
    docs = spark.createDataFrame([(1, "x " + items[1][1] + " y")], "doc_id bigint, text string")
    row = decontam.matched(docs, spark.createDataFrame(items, "item_id string, text string")).first()
    spans = sorted((s["item_id"], s["item_word"], s["doc_word"], s["n_words"]) for s in row["spans"])
    assert spans == [("i1", 20, 21, 15), ("i2", 0, 1, 55)]


def test_suffix_array_cut_with_overlap(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(decontam, "POSITION_BITS", 6)
    words = [f"w{k % 37}" for k in range(500)]
    items = [("a", " ".join(words[100:120])), ("b", " ".join(words[5:9]))]
    test = decontam.index_items([i for i, _ in items], pa.array([t for _, t in items]))
    found = decontam.scan(pa.array([" ".join(words)]), test)
    want = brute.decontamination([(1, " ".join(words))], items)[0]
    assert (int(found.n_words[0]), int(found.n_hit[0])) == want[1:3]


def test_lm_walks_states_and_reads_each_range_once(spark, monkeypatch):
    """The automaton of a pass: its arcs, failure arcs and links, step by step; a range's file is opened once for all texts."""
    import pyarrow as pa

    from inkwell.llm import artifacts

    monkeypatch.setattr(lm, "RANGE_BYTES", 256)
    texts = ["a b c a b d", "a b c", "b c a", "", "x y a b c c", "c c c b a"]
    model = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    assert 1 << model.range_bits >= 4
    read = []
    monkeypatch.setattr(artifacts, "read", lambda uri, kind, plain=artifacts.read: read.append(uri) or plain(uri, kind))
    asked = ["a b c", "b x c a b", "", "never seen", "a b d a"] * 30
    hashes, first = lm.tokens(pa.array(asked))
    local = lm.Local.built(model, hashes, first)
    assert len(read) == len(set(read)) <= 3 << model.range_bits
    docs = [(5 * k, t) for k, t in enumerate(texts)]  # keys whose remainders don't matter here
    monkeypatch.setattr(brute, "remainder", lambda k: 0 if k < 1000 else 1)
    want = [r[6] for r in brute.lm(docs + [(1000 + k, t) for k, t in enumerate(asked)])[len(docs) :]]
    assert local.walked(first) == pytest.approx(want, rel=1e-12)
    # "a b" was seen four times: what a word without an arc costs there
    a, b, c = (int(lm.tokens(pa.array([x]))[0][0]) for x in "abc")
    pair = local.at[1][1]
    assert (hashes[0], hashes[1], hashes[2]) == (a, b, c) and local.met[2][local.at[2][2]]
    assert local.fail[1][pair] == pytest.approx(math.log10(3 / (4 + 3)))


def test_lm(spark, odd, none):
    rows = [(r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in odd.filter("doc_id is not null").collect()]
    docs = odd.filter("doc_id is not null")
    for order in (1, 2, 3, 4):
        model = lm.train(docs.filter(~lm.held_out()), order=order)
        got = collected(lm.scored(docs, model), "doc_id", "n_tokens", "n_known", "score")
        want = sorted(((w[0], w[2], w[3], w[6]) for w in brute.lm(rows, order=order)), key=repr)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9, abs=1e-9)
    nothing = lm.train(none)
    assert collected(lm.scored(odd.limit(1), nothing), "n_known", "score") == [(0, 0.0)]
    assert lm.scored(none, nothing).count() == 0


def test_lm_sums_to_one(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b a b c", "a b d", "c a b a", "b b a"] * 3)], "doc_id bigint, text string")
    model = lm.train(docs, order=2)
    # P(w | a) over all words, the end and the unknown class
    ends = spark.createDataFrame([(k, t) for k, t in enumerate(["a a", "a b", "a c", "a d", "a", "a zz"])], "k int, text string")
    single = {r["k"]: r["score"] for r in lm.scored(ends, model).collect()}
    begin = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "c", "d", "zz"])], "k int, text string")
    alone = {r["k"]: r["score"] for r in lm.scored(begin, model).collect()}
    # scores of "a w" minus that of the end after w are those of a and w after it
    import math

    def end_after(word):
        return {"a": alone[0], "b": alone[1], "c": alone[2], "d": alone[3], "zz": alone[4]}[word]

    first = math.log10(model_share(model, docs, "a"))
    parts = [10 ** (single[k] - first - (end_after(w) - math.log10(model_share(model, docs, w)))) for k, w in ((0, "a"), (1, "b"), (2, "c"), (3, "d"), (5, "zz"))]
    parts.append(10 ** (single[4] - first))
    assert sum(parts) == pytest.approx(1, abs=1e-9)


def model_share(model, docs, word):
    from collections import Counter

    counts = Counter(w for r in docs.collect() for w in [*r["text"].split(), None])
    once = max(1, sum(c == 1 for c in counts.values()))
    return (counts[word] or once) / (model.n + once)


def test_toxicity(spark, odd, none):
    good, bad = "the weather is nice today my friend", "you stupid moron go away now please"
    docs = spark.createDataFrame([(k, (bad if k % 3 == 0 else good) + f" {k}") for k in range(200)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id bigint, toxic int"))
    model = toxicity.fit(toxicity.sample(labels, docs, held_out=toxicity.held_out()))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert all((s >= 0.5) == (k % 3 == 0) for k, s in got.items())
    scores = toxicity.scored(odd, model)
    assert scores.count() == odd.count() and scores.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.scored(none, model).count() == 0
    untrained = toxicity.fit(toxicity.sample(labels.limit(0), docs))
    assert {r["score"] for r in toxicity.scored(odd, untrained).collect()} == {0.5}


def test_toxicity_equals_a_plain_version(spark):
    """Features, ratios and scores as sets and sums of Python's integers give them; characters, not bytes; factors that fit."""
    words = ["ŽLUŤ", "kůň", "你好世界", "river", "garden", "nice", "day", "\t\n", "😀😀😀", "weather"]
    rows = [(" ".join(words[(k * 7 + j * j) % 10] for j in range(k % 9 + (k % 3 == 0) * 3)) + (" moron idiot" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(120)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"))
    want = brute.toxicity_features(rows)
    assert set(model.features.tolist()) == set(want)
    weights = dict(zip(model.features.tolist(), model.weights.astype(float).tolist(), strict=True))
    texts = [t for t, _ in rows] + ["", None, "ab", "Moron", "MORON\tidiot", "你好 moron", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert got == pytest.approx({k: brute.toxicity_score(t, weights, model.bias) for k, t in enumerate(texts)}, rel=1e-5)
    assert all((got[k] >= 0.5) == bool(y) for k, (_, y) in enumerate(rows))


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "x" * 10) for k in range(50)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert toxicity.sample(labels, docs).count() == 50
    assert toxicity.sample(labels, docs, max_labelled=20).count() == 20
    assert toxicity.sample(labels, docs, max_bytes=155).count() == 15


def test_token_counts(spark, odd, none):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["<|endoftext|> x<|endoftext|>", "a\u2003b  c", "日本語 text", "it's  \n\n we'll", "x" * 3000, LONG]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    args = {"ranks": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN, "special": ("<|endoftext|>",)}
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = [(k, len(plain.encode(t, add_special_tokens=False).ids)) for k, t in enumerate(texts)]
    assert collected(tokens.token_counts(docs, public.path("byte_bpe_50k.json"), **args), "doc_id", "n_tokens") == want
    assert collected(tokens.token_counts(docs, public.path("byte_bpe_50k.json")), "doc_id", "n_tokens") == want
    got = tokens.token_counts(odd, public.path("byte_bpe_50k.json"), **args)
    assert got.count() == odd.count() and collected(got.filter("doc_id <= 2"), "n_bytes", "n_tokens") == [(0, 0), (0, 0)]
    assert tokens.token_counts(none, public.path("byte_bpe_50k.json"), **args).count() == 0


def test_token_counts_split_at_safe_places(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    text = "One two  three's\n\nfour <|endoftext|> five 123 six. " * 40
    whole = tokens.counter(public.path("byte_bpe_50k.json"))([text])
    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    assert tokens.counter(public.path("byte_bpe_50k.json"))([text]) == whole
    assert "".join(tokens.boundaries(text, 50)) == text


def test_both_libraries_count_alike_in_the_compared_range():
    public = pytest.importorskip("public_tokenizers")
    slow = tokens.counter(public.path("byte_bpe_50k.json"))
    fast = tokens._ranks(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    letters = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x2010, 0x2028)] + ["€"]
    texts = [shape.replace("_", c) for c in letters for shape in ("a_b", " _ x", "_1_\n_ y", "x  _")]
    assert slow(texts) == [len(fast.encode_ordinary(t)) for t in texts]


def test_mixing(spark, odd, none):
    got = mixing.mixed(odd)
    assert got.count() == odd.count() and got.filter("taken > 2 * size or taken is null").count() == 0
    want = brute.mixing_targets([(r["source"], len(brute.VISIBLE.findall(r["text"] or ""))) for r in odd.collect()])
    for r in got.collect():
        assert r["target"] == pytest.approx(next(t for n, t in want.values() if n == r["source_size"]))
    assert mixing.mixed(none).count() == 0
    assert mixing.mixed(frame(spark, (1, "", "a"), (2, None, None))).filter("taken = 0 and target = 0").count() == 2


def test_mixing_comes_near(spark):
    rows = [(k, "w " * (1 + k * 7919 % 300), f"s{k % 6}" if k % 3 else "s0") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = mixing.taken_rows(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    assert all(abs(r["taken"] - r["target"]) <= 0.001 * r["target"] + 1 for r in taken.collect())


def test_mixing_row_by_row(spark):
    """Each document's words, as a plain version with another solver deals them; rates rise or fall with the length."""
    sizes = [1 + k * 7919 % 400 if k % 5 else 1 + k * 31 % 9 for k in range(900)]
    rows = [(k, f"s{k % 7}" if k % 4 else None, n * (3 if k % 7 == 2 else 1)) for k, n in enumerate(sizes)] + [(5000, "s1", 60_000), (5001, "long", 70_000), (5002, "none", 0)]
    docs = spark.createDataFrame([(k, "w " * n, s) for k, s, n in rows], "doc_id bigint, text string, source string")
    want = brute.mixing(rows)
    got = dict(collected(mixing.mixed(docs), "doc_id", "taken"))
    assert got == want
    targets, taken = brute.mixing_targets([(s, n) for _, s, n in rows]), {}
    for k, s, _ in rows:
        taken[s] = taken.get(s, 0) + got[k]
    assert all(abs(taken[s] - t) <= 0.001 * t + 10 for s, (_, t) in targets.items() if s not in ("s1", "long"))


def test_mixing_goes_on_past_documents_that_do_not_fit(spark):
    """Long documents early in the order leave the others their share; equal lots go together; short sources take second copies."""
    rows = [("s", 100, k * 1000) for k in range(400)] + [("s", 60_000, 4_500)] + [("t", 37, k * 1000 + 1) for k in range(200)] + [("t", 9_000, 7), ("t", 41, 99), ("t", 41, 99)] + [("u", 10, k) for k in range(5)] + [("u", 300, 9)]
    light = spark.createDataFrame([(s, n, 0 if n != 37 else 1, (1 << 40) + d, (1 << 30) + d) for s, n, d in rows], "source string, size bigint, base bigint, draw bigint, lot bigint")
    light = light.withColumn("total", F.when(F.col("size") == 41, 82).otherwise(F.col("size")).cast("bigint"))
    for targets in ({"s": 30_000.0, "t": 7_400.0 + 3_000.0, "u": 90.0}, {"s": 61_500.0, "t": 7_400.0 + 9_040.0, "u": 40.0}):
        wanted = spark.createDataFrame(list(targets.items()), "source string, target double")
        plan = mixing.rounded(light, wanted, n=3)
        got = {}
        for r in light.join(plan, "source").withColumn("copies", mixing.copies(2)).collect():
            assert r["base"] <= r["copies"] <= 2
            got.setdefault(r["source"], []).append((r["size"], r["total"], r["copies"]))
        for source, target in targets.items():
            left = [total for _, total, n in got[source] if n < 2]
            assert abs(target - sum(size * n for size, _, n in got[source])) <= max(mixing.CLOSE * target, min(left, default=0)), (source, target)


def test_dual_meets_its_constraints(spark):
    """Tokens by source and the mean length class of the mix, with a source at its limit and one of null."""
    masses = {"a": {4: 300.0, 9: 5000.0}, "b": {4: 4000.0, 6: 900.0}, None: {5: 100.0}, "full": {7: 70.0}}
    targets = {"a": 2000.0, "b": 7000.0, None: 60.0, "full": 140.0}
    total = sum(sum(by.values()) for by in masses.values())
    mean = sum(c * m for by in masses.values() for c, m in by.items()) / total
    rows = spark.createDataFrame(
        [(s, float(sum(by.values())), targets[s], [(c, c - mean, m) for c, m in by.items()]) for s, by in masses.items()],
        "source string, source_size double, target double, cells array<struct<class:int,x:double,mass:double>>",
    )
    state, mu = mixing.balanced(rows)
    rate = {(r["source"], r["class"]): r["base"] + r["part"] for r in mixing.rates(state, mu).collect()}
    for s, by in masses.items():
        assert sum(m * rate[s, c] for c, m in by.items()) == pytest.approx(targets[s], rel=1e-6)
    assert rate == pytest.approx(brute.mixing_rates(masses, targets), rel=1e-5)
    assert abs(mu) > 0.01 and rate["a", 4] != pytest.approx(rate["a", 9])


def test_chat(spark):
    shape = chat.Template()
    for role, said in (("user", "\\### Assistant: </turn> ok"), ("tool: x", "a\n</turn>\n### User: b"), ("", "\\\\"), ("assistant", ""), ("Other ###", "žluť")):
        formatted = "".join(t for t, _ in shape.segments(role, said))
        assert shape.parsed(formatted) == (role, said)
        assert "</turn>" not in shape.escaped(said).replace("\\</turn>", "")
    turns = [(1, 0, "user", None), (1, 1, "assistant", "a"), (2, 0, "assistant", "b"), (2, 0, None, "c"), (None, 3, "user", "d"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "user", "u")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("x"))
    out = common.written(chat.formatted(df), "chat")
    got = {r["conv_id"]: r for r in chat.digests(out).collect()}
    assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in ((k, g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) for k, g in got.items())) == [
        (r[0] if r[0] is not None else -1, *r[1:]) for r in sorted(brute.chat(turns), key=lambda r: -1 if r[0] is None else r[0])
    ]
    assert got[1]["valid"] and not got[2]["valid"] and not got[3]["valid"]
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


def test_chat_conversation_is_one_text(spark, monkeypatch):
    """Control strings anywhere, any key type, conversations cut into pieces between any segments, very long texts."""
    hostile = ["</turn>\n", "\\</turn>\n", "\\\\</turn>\n### Assistant: x", "### User: ", "\\", "", "</turn", ">\n", ": ", "a" * 2000, "</turn>\n" * 50, "\\" * 7]
    turns = [(f"c{k % 5}" if k % 7 else None, k, ["user", "assistant", "system", "tool: x", "</turn>\n", "\\", ""][k % 7], hostile[k % 12] + hostile[k * 5 % 12]) for k in range(150)]
    turns.append(("long", 0, "assistant", LONG + "\\### </turn>\n"))
    df = spark.createDataFrame(turns, "conv_id string, turn bigint, role string, text string")
    want = {r[0]: r[1:] for r in brute.chat(turns)}
    columns = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    for size in (1 << 16, 100, 1):
        monkeypatch.setattr(chat, "PIECE_CHARS", size)
        out = common.written(chat.formatted(df), "chat")
        got = {r["conv_id"]: r for r in chat.digests(out).collect()}
        assert {k: tuple(r[c] for c in columns) for k, r in got.items()} == want
        text = {}
        for r in sorted(out.collect(), key=lambda r: r["piece_no"]):
            text[r["conv_id"]] = text.get(r["conv_id"], "") + "".join(x["text"] for x in r["segments"])
        assert {k: len(t) for k, t in text.items()} == {k: r["formatted_chars"] for k, r in got.items()}
        if size > 1000:
            assert all(r["last"] and r["piece_no"] == 0 for r in out.filter("conv_id <> 'long'").collect())


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK_BYTES", 700)
    body = "čau " * 400
    pages = [(1, "http://a/\n", body), (2, None, body), (None, "u", body), (4, "u", None), (5, "u", "x" * 10), (6, "u", "x" * 10), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    folder = common.new_folder(spark, "warc-test")
    manifest = warc.write_archives(warc.with_revisits(df), folder, file_bytes=500)
    assert manifest.agg(F.sum("records")).first()[0] == 7
    chunks = warc.read_archives(spark, manifest)
    got = {r["page_id"]: r for r in warc.records(chunks).collect()}
    assert got[2]["record_type"] == "response" and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2 and got[None]["refers_to"] == 2
    assert got[5]["record_type"] == got[6]["record_type"] == "response" and got[4]["payload_bytes"] == 0
    rows = chunks.filter("page_id = 7").orderBy("chunk_no").collect()
    assert b"".join(r["data"] for r in rows).decode() == pages[-1][2] and rows[-1]["bytes_so_far"] == len(pages[-1][2])
    empty = warc.write_archives(warc.with_revisits(df.limit(0)), folder)
    assert warc.read_archives(spark, empty).count() == 0


def test_license(spark, odd, none):
    model = license.trained()
    texts = ["Licensed under CC BY-NC 4.0.\nby the sea", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "He came by train with his license", "SPDX-License-Identifier: Apache-2.0", "mit der Bahn", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("licences", F.lit(1))
    got = {r["doc_id"]: [x["family"] for x in r["licences"]] for r in license.scanned(docs).collect()}
    assert got == {0: ["CC-BY-NC"], 1: ["GPL"], 2: ["MIT"], 3: [], 4: ["Apache-2.0"], 5: [], 6: [], 7: []}
    for k, t in enumerate(texts):
        plain = [license.classified(line, model)[0] for line in (t or "").split("\n")]
        assert [f for f in plain if f != "unknown"] == got[k]
    assert license.scanned(odd).filter("doc_id <= 2").agg(F.sum("n_paragraphs")).first()[0] == 0
    assert license.scanned(none).count() == 0


def test_license_notices_may_be_wrapped_or_stand_in_long_lines(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License."
    prose = "slova jdou dál a nikdo neví kam vedou " * 40
    texts = [gpl, bsd, apache, f"{prose}\n \n\n{bsd}\n{prose}", prose + gpl.replace("\n# ", " ") + " " + prose, "Released under the GPLv3.", "Released under the MIT Licence", prose + "\nSPDX-License-Identifier: MIT\n" + prose, prose, "He lost his driving licence\nby the river"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in license.scanned(docs).collect()}
    assert [sorted({x["family"] for x in got[k]["licences"]}) for k in range(len(texts))] == [["GPL"], ["BSD"], ["Apache-2.0"], ["BSD"], ["GPL"], ["GPL"], ["MIT"], ["MIT"], [], []]
    assert got[3]["n_paragraphs"] == 2 and all(x["line"] >= 3 for x in got[3]["licences"])
    assert all(len(w) <= most - step for most, step in license.WINDOWS[:1] for t in license.TEMPLATES.values() for w in map(license.words_of, t))


def test_license_model():
    """What the model was trained on is known; negations, mentions and statements worded otherwise are what they are."""
    model = license.trained()
    assert not [t for f, texts in license.TEMPLATES.items() for t in texts if license.classified(t, model)[0] != f]
    assert all(license.classified(t, model)[0] == "unknown" for t in license.OTHERS)
    against = ["This text is not licensed under the MIT license", "The work is not released under the GPL version 2 or later", "not licensed under CC BY 4.0", "Nothing here is not available under the Creative Commons Attribution license"]
    assert all(license.classified(t, model)[0] == "unknown" for t in against)
    for t, family in (("This module is licensed under the terms of the MIT license.", "MIT"), ("The code is licensed under the Apache License, Version 2.0", "Apache-2.0"), ("All of it is licensed under the EUPL, Version 1.2 or later, since 2020", "EUPL"), ("Our book: all rights reserved. No part of this publication may be reproduced without permission", "proprietary")):
        assert license.classified(t, model)[0] == family


def test_license_probabilities_hold_on_statements_left_out():
    """A model without one statement of each family: mean probability of its answers on those is near the share that is right."""
    families = (*license.TEMPLATES, license.UNKNOWN)
    for place in (0, 1):
        part = {f: [t for k, t in enumerate(texts) if k != place] for f, texts in license.TEMPLATES.items()}
        weights, bias = license._fitted(license._rows(part, license.OTHERS[1::2], families), len(families), 300, 1e-5)
        held = [(texts[place], f) for f, texts in license.TEMPLATES.items()] + [(t, license.UNKNOWN) for t in license.OTHERS[::2]]
        sure, right = 0.0, 0
        for text, family in held:
            p = license._softmax([s / license.trained().temperature for s in license._scores(weights, bias, license.features_of(license.words_of(text)))])
            best = max(range(len(p)), key=lambda k: p[k])
            sure, right = sure + p[best], right + (families[best] == family)
        assert right >= 0.4 * len(held) and abs(sure - right) <= 0.15 * len(held), (sure, right, len(held))


def test_license_scan_equals_a_plain_version(spark):
    model = license.trained()
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    prose = "words go on and by the sea nobody has a license " * 30
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\n ", gpl, f"{prose}\n\n{gpl}\n \n{prose}Licensed under the MIT license {prose}", "Released under the GPLv3.\nReleased under the MIT Licence\n\nReleased under the MIT License", LONG + " SPDX-License-Identifier: ISC"]
    texts += [t for texts_ in license.TEMPLATES.values() for t in texts_]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in license.scanned(docs).collect():
        n, candidates, found = brute.licences(texts[r["doc_id"]], model)
        assert (r["n_paragraphs"], r["candidates"]) == (n, candidates)
        got = sorted((x["line"], x["family"], round(x["probability"], 9), round(x["overlap"], 9)) for x in r["licences"])
        assert got == pytest.approx(found) if not found else [g[:2] for g in got] == [f[:2] for f in found]
        assert [g[2:] for g in got] == [pytest.approx(f[2:], rel=1e-6) for f in found]


ODD_NAMES = ("my col", "n-chars", "a.b", "Score", "N_Tokens", "Row", "KEPT", "ß `x`"[:4], "Keep_ID", "taken ", "Licences", "N_Words", "C0", "part")


def _oddly_named(spark, rows):
    """documents (doc_id, text, source) with columns of other kinds of names."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.select("doc_id", *[F.lit(k).alias(name) for k, name in enumerate(ODD_NAMES)], "text", F.struct(F.lit(1).alias("p q")).alias("nested one"), "source")


OPERATORS = {
    "tokens": lambda docs, none: tokens.token_counts(docs, pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")),
    "toxicity": lambda docs, none: toxicity.scored(docs, toxicity.Model(none, none.astype("float32"), 0.1)),
    "lm": lambda docs, none: lm.scored(docs, lm.train(docs)),
    "license": lambda docs, none: license.scanned(docs),
    "decontam": lambda docs, none: decontam.decontaminated(docs, docs.select(F.col("doc_id").alias("item_id"), "text").filter("doc_id = 3")),
    "dedup": lambda docs, none: dedup.deduplicated(docs),
    "dedup decisions": lambda docs, none: dedup.decisions(docs),
    "neardup": lambda docs, none: neardup.deduplicated(docs),
    "neardup rows": lambda docs, none: neardup.near_duplicates(docs),
    "mixing": lambda docs, none: mixing.taken_rows(docs),
    "mixing rows": lambda docs, none: mixing.mixed(docs),
    "warc": lambda docs, none: warc.with_revisits(docs.withColumns({"page_id": F.col("doc_id"), "url": F.col("source"), "html": F.col("text")})).drop("payload"),
    "chat": lambda docs, none: chat.digests(common.written(chat.formatted(docs.withColumns({"conv_id": F.col("source"), "turn": F.col("doc_id"), "role": F.lit("user")})), "chat")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_any_column_names_and_empty_tables(spark, tmp_path, name):
    import numpy as np

    nothing = np.zeros(0, dtype=np.int64)
    text = " ".join(f"slovo{k}" for k in range(30))
    rows = [(1, text, "a"), (2, text, None), (3, "jiná " * 20, "a"), (None, None, None), (3, "", "b")]
    docs = _oddly_named(spark, rows)
    found = OPERATORS[name](docs, nothing)
    found.write.parquet(str(tmp_path / "out"))  # names that Spark takes for one can't be written
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    kept = [c for c in found.columns if c in docs.columns and c not in ("doc_id", "text", "source")]
    if name in ("tokens", "toxicity", "license", "decontam", "dedup", "neardup", "mixing"):
        assert {"my col", "a.b", "nested one"} <= set(kept)
    empty = OPERATORS[name](docs.limit(0), nothing)
    assert empty.columns == found.columns and empty.count() == 0


def test_string_keys_where_keys_may_be_any(spark):
    docs = spark.createDataFrame([("x", "a b"), ("y", "a  b"), (None, "c")], "doc_id string, text string").withColumn("source", F.lit("s"))
    assert collected(dedup.decisions(docs), "doc_id", "keep_id", "kept") == sorted([("x", "x", True), ("y", "x", False), (None, None, True)], key=repr)
    assert mixing.mixed(docs).count() == 3 and lm.scored(docs, lm.train(docs)).count() == 3
