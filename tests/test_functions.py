"""Scalars, chunkers and operators on small literals."""

import io
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import chunking, dates, text, vector
from inkwell.operators import retrieval, upkeep, versions
from inkwell.sources import files, pages


def one(spark, column, *values):
    names = "abcdefgh"[: len(values)]
    schema = ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def test_chunkers(spark):
    three = "aa\n\nbb\n\ncc"
    assert one(spark, chunking.fixed("a", 3), "abcdefg") == ["abc", "def", "g"]
    assert one(spark, chunking.fixed("a", 3), "") == []
    assert one(spark, chunking.paragraphs("a", 5), three) == ["aa", "bb", "cc"]
    assert one(spark, chunking.paragraphs_loose("a", 5), three) == ["aa\n\nbb", "cc"]
    assert one(spark, chunking.paragraphs("a", 3), "abcdef\n\ng") == ["abcdef", "g"]
    assert one(spark, chunking.paragraphs_cut("a", 4), "ab\n\nabcdefghi\n\nc\n\nd") == ["ab", "abcd", "efgh", "i", "c\n\nd"]
    assert one(spark, chunking.lines("a", 5), "aa\nbb\ncc") == ["aa\nbb", "cc"]
    assert one(spark, chunking.lines("a", 5), " \n ") == [" \n "]
    assert one(spark, chunking.titled("a", "b", 20), "T", "x\ny") == ["T\nx\ny"]
    assert one(spark, chunking.titled("a", "b", 20), "T", "") == ["T"]
    assert one(spark, chunking.titled("a", "b", 20), "T", "in T\ny") == ["in T\ny"]
    assert one(spark, chunking.sliding("a", 20), "Prvni veta. Druha veta je delsi.") == ["Prvni veta.", "Druha veta je delsi."]
    assert one(spark, chunking.blank_line_paragraphs("a", 4), "abcdefghij\n\nk") == ["abcd", "efgh", "ij", "k"]
    assert chunking.hard_chunks("ab\n \ncd", 10) == ["ab\n\ncd"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=200), st.integers(8, 40))
def test_sliding_loses_nothing(value, most):
    chunks = chunking.sliding_chunks(value, most)
    assert all(len(c) <= most for c in chunks)
    bare = lambda s: "".join(s.split())
    assert bare("".join(chunks)) == bare(value)
    assert bare("".join(chunking.hard_chunks(value, most))) == bare(value)


def test_text(spark):
    assert [one(spark, text.stem("a"), w) for w in ("byt", "bytu", "bytech")] == ["byt"] * 3
    assert one(spark, text.stem("a"), "stůl") == "stol"
    assert one(spark, text.act_number("a")["year"], "89/2012 Sb.") == 2012
    assert one(spark, text.act_number("a")["number"], "abc") is None
    assert one(spark, text.strict_citation("a")["number"], "262/2006 Sb.") == 262
    assert one(spark, text.paragraphs("a"), "§ 12a, § 3 a paragraf 12a") == ["12a", "3"]
    assert one(spark, text.is_section_heading("a"), "Čl. IV") and not one(spark, text.is_section_heading("a"), "§ 4 odst. 1")
    assert one(spark, text.html_text("a"), "<nav>x</nav><p>A&amp;B</p><p> c </p><!-- n -->") == "A&B\nc"
    assert one(spark, text.html_text("a", True), "<body>x<main><p>y</p></main></body>") == "y"
    assert one(spark, text.keywords("a"), "Jaká je lhůta, lhůta pro odvolání?") == ["jaká", "lhůta", "odvolání"]
    assert one(spark, text.field("a", "Sp. zn."), "x\nSp. zn.: 1 As 2/2020 \ny") == "1 As 2/2020"
    assert one(spark, text.between("a", "od", ("do",)), "xx od tady do konce") == "od tady"
    assert one(spark, text.guessed_title("a", F.lit("f")), "S o u d n í\nRozhodnutí soudu o věci\nx") == "Rozhodnutí soudu o věci"
    assert one(spark, text.guessed_title("a", F.lit("f")), "x") == "f"
    assert one(spark, text.is_letter_spaced("a"), "S o u d")
    assert one(spark, text.highlighted("a", "nájemní"), "Nájemné <b>") == "<mark>Nájemné</mark> &lt;b&gt;"
    assert one(spark, text.cited("a"), "[1] a [2][W3]") == [1, 2]
    assert one(spark, text.file_stem("a"), "/x/y.tar.gz/") == "y.tar"
    assert one(spark, text.embedded_text("a", F.lit(None).cast("string"), "b"), "T", "c") == "T: c"
    assert one(spark, text.parsed_vector("a"), "[0.5,1]") == [0.5, 1.0] and one(spark, text.parsed_vector("a"), "") is None
    assert one(spark, text.is_superseded("a"), "bylo ZRUŠENO") and one(spark, text.without_diacritics("a"), "Říjen") == "rijen"


def test_dates(spark):
    ask = dates.asked_date("a", text.CITATION)
    assert one(spark, ask, "stav k 1. 3. 2020") == "2020-03-01"
    assert one(spark, ask, "v roce 2019") == "2019-12-31"
    assert one(spark, ask, "bez data") is None
    assert [one(spark, dates.case_year("a"), x) for x in ("a/79", "b/80", "c/2016", "d")] == [2079, 1980, 2016, None]
    assert str(one(spark, dates.named_date("a"), "5. května 2021")) == "2021-05-05"
    assert one(spark, dates.numeric_date("a"), "31. 2. 2020") is None
    assert one(spark, dates.split_iso("a"), "5.1.2020") == "2020-01-05"
    assert dates.month_range(2024, 2, 2024, 2) == ("2024-02-01", "2024-02-29")
    assert dates.year_range("od:2018", 2020) == [2018, 2019, 2020]
    assert [str(r[0]) for r in dates.days_back(spark, "2024-03-01", 2).collect()] == ["2024-02-29", "2024-03-01"]


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<float>, z array<float>")
    got = row.select(vector.norm("v").alias("n"), vector.cosine("v", "z").alias("c"), vector.cosine_to("v", [4.0, 3.0]).alias("d"), vector.l2_normalised("v").alias("u"), vector.truncated("v", 1).alias("t")).first()
    assert got["n"] == 5.0 and got["c"] is None and abs(got["d"] - 0.96) < 1e-12 and got["u"] == [0.6, 0.8] and got["t"] == [1.0]


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, True, None, None), (2, False, "2019-01-01", "2019-12-31"), (3, None, "2020-01-01", None)], "id int, is_current boolean, f string, u string")
    rows = rows.withColumns({"valid_from": F.to_date("f"), "valid_until": F.to_date("u")})
    ids = lambda day: sorted(r["id"] for r in rows.filter(retrieval.valid_at(day)).collect())
    assert ids(None) == [1] and ids("2019-12-31") == [1, 2] and ids("2020-01-01") == [1, 3]
    hits = spark.createDataFrame([("1", "zakon", 0.7), ("2", "metodika_fs", 0.6)], "id string, doc_type string, similarity double")
    assert retrieval.needs_clarification(hits, "jaká je lhůta", special=["metodika_fs"]).first()["clarify"]
    assert not retrieval.needs_clarification(hits, "jaká je sazba DPH", special=["metodika_fs"]).first()["clarify"]
    listed = hits.select(F.lit("t").alias("title"), F.lit("h").alias("heading"), F.lit("c").alias("content"), "similarity", F.col("id").cast("int").alias("citation"), (F.col("id") == "1").alias("is_direct"))
    assert retrieval.context(listed).first()["context"] == "[1] (exact) (relevance 70 %) t - h\nc\n\n[2] (relevance 60 %) t - h\nc"
    documents = spark.createDataFrame([("d1", "89/2012 Sb.", "OZ", True)], "id string, external_id string, title string, is_current boolean")
    chunks = spark.createDataFrame([("c1", "d1", 0, "§ 1"), ("c2", "d1", 1, "§ 10")], "id string, document_id string, chunk_index int, heading string")
    assert [r["id"] for r in retrieval.citation_lookup(documents, chunks, 89, 2012, ["1"]).collect()] == ["c1"]


def test_upkeep(spark):
    got = upkeep.schedule(spark.createDataFrame([("a", 1), ("b", 2), ("c", 0)], "key string, weight int")).orderBy("slot").collect()
    assert [r["key"] for r in got] == ["a", "b", "b"]
    shard = upkeep.year_shard(F.col("a"))
    assert [one(spark, shard, y) for y in (1997, 1998, 2020, 2021)] == ["do1997", "1998_2007", "2008_2020", "2021_dosud"]
    assert list(upkeep.page_of_shards([("a", 10), ("b", 5), ("c", 9)], 8, 9)) == [("a", 8, 2), ("b", 0, 5), ("c", 0, 2)]
    assert upkeep.clamped(None, -3) == (20, 0) and upkeep.clamped(1000, 2) == (100, 2)
    assert one(spark, upkeep.smoothed_limit(F.array(F.lit(100), F.lit(50))), "x") == 75.0
    down = spark.createDataFrame([("unavailable",)] * 4 + [("ok",)], "outcome string")
    assert upkeep.mostly_failing(down).first()["down"]


def test_versions(spark):
    old = spark.createDataFrame([("d", None, "x", 0, [1.0]), ("d", None, "x", 3, [2.0]), ("d", "h", "y", 1, None)], "document_id string, heading string, content string, chunk_index int, embedding array<float>")
    new = old.drop("embedding").filter("chunk_index < 3")
    got = {r["chunk_index"]: r["embedding"] for r in versions.reused_embeddings(old, new).collect()}
    assert got == {0: [2.0], 1: None}
    paths = spark.createDataFrame([("a/v1/x",), ("a/v1-x/y",), ("b",)], "path string")
    known = spark.createDataFrame([("a/v1",), ("a/v1-x",)], "version string")
    assert {r["path"]: r["of"] for r in versions.predecessors(paths, known).collect()} == {"a/v1/x": "a/v1", "a/v1-x/y": "a/v1-x", "b": None}


def test_rolled_keeps_one_current_row(spark):
    schema = "id string, version string, valid_from date, valid_until date, is_current boolean, status string, superseded_by string"
    live = spark.createDataFrame([("a", "v1", None, None, True, "platny", None), ("b", "v1", None, None, True, "platny", None)], schema)
    new = spark.createDataFrame([("a", "v2", None), ("b", "v3", None), ("c", "v1", None)], "id string, version string, valid_from date")
    counts = spark.createDataFrame([("a", 3), ("b", 0), ("c", 2)], "id string, n int")
    rows = versions.rolled(live, new, "id", "version", "2026-01-01", content_counts=counts).collect()
    assert sorted((r["id"], r["version"], r["is_current"]) for r in rows) == [("a", "v2", True), ("a#hist-v1", "v1", False), ("b", "v1", True), ("c", "v1", True)]


def test_sources(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"položky": [{"a": 1}, {"a": 2}]}', encoding="utf-8")
    assert files.json_items(spark, str(tmp_path / "x.json")).count() == 2
    (tmp_path / "s.json").write_text('{"key": "K", "chunks": [{"heading": "h", "content": "c"}, {"heading": null, "content": "d"}]}', encoding="utf-8")
    assert [(r["chunk_index"], r["heading"], r["content"]) for r in files.standards(spark, str(tmp_path / "s.json")).collect()] == [(0, "h", "c"), (1, None, "d")]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Ahoj</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "d.docx").write_bytes(data.getvalue())
    got = files.binary_files(spark, str(tmp_path), "*.docx").select(files.docx("content").alias("t")).first()["t"]
    lines = files.binary_files(spark, str(tmp_path), "*.docx").select(files.docx("content", cells="\n").alias("t")).first()["t"]
    assert lines == got.replace(" | ", "\n") and " | " in got
    assert got == "Ahoj\na | b"
    raw = spark.createDataFrame([(bytearray("č".encode("cp1250")),), (bytearray("č".encode()),)], "b binary")
    assert [r["t"] for r in raw.select(files.decoded("b").alias("t")).collect()] == ["č", "č"]
    xml = spark.createDataFrame([("<loc>https://x/2020/3</loc><loc> https://x/2021/1 </loc><loc>https://x/2021/1</loc>",)], "value string")
    assert [r["loc"] for r in pages.sitemap(xml).collect()] == ["https://x/2021/1", "https://x/2020/3"]
    html = spark.createDataFrame([(1, "https://h.cz/a", '<a href="/x/">1</a><a href="https://o.cz/y#f">2</a>')], "page_id int, url string, html string")
    assert [r["target"] for r in pages.links(html, same_host=True).collect()] == ["/x"]
    found = files.sections(spark.createDataFrame([("d", 1, "obsah"), ("d", 2, "Zpráva x"), ("d", 3, "yyy"), ("d", 4, "zzz")], "document_id string, page_no int, text string"), "^Zpráva", 10)
    assert sorted(r["page_no"] for r in found.collect()) == [2, 3]


def test_section_parts_hold_whole_texts(spark):
    from inkwell.operators import versions

    texts = {k: None if k == 9 else " " * (k % 7 == 0) + f"text {k} " * (1 + k * 37 % 90) for k in range(60)}
    source = lambda k: "big" if k % 3 else "small"
    fragments = spark.createDataFrame([(f"a/{source(k)}/{k}", k, t) for k, t in texts.items()], "path string, ord bigint, text string")
    nodes = spark.createDataFrame([(1, "a", "all", 0), (1, "a/big", "big", 1), (1, "a/none", "none", 2), (1, "a/small", "small", 3)], "document_id int, path string, heading string, ord int")
    rows = sorted(versions.section_parts(nodes, fragments, part_chars=500, span=8).collect(), key=lambda r: (r["chunk_index"], r["part"]))
    longest = max(len(t or "") for t in texts.values())
    assert len(rows) > 20 and all(len(r["content"]) <= 500 + longest for r in rows)
    for at, inside in ((0, lambda k: True), (1, lambda k: source(k) == "big"), (2, lambda k: False), (3, lambda k: source(k) == "small")):
        want = " ".join(t.strip(" ") for k, t in texts.items() if inside(k) and t and t.strip(" "))
        assert " ".join(r["content"] for r in rows if r["chunk_index"] == at) == want


def test_descendant_text_whole_loses_nothing(spark):
    from inkwell.plans import registry
    from inkwell.session import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "source", "text").collect()
    rows = registry.queries()["descendant_text_whole"](spark, "/root/testdata/sf0.001").collect()
    for source in {r["source"] for r in docs}:
        want = " ".join(r["text"].strip(" ") for r in sorted(docs, key=lambda r: r["doc_id"]) if r["source"] == source and (r["text"] or "").strip(" "))
        assert " ".join(r["content"] for r in sorted(rows, key=lambda r: r["part"]) if r["heading"] == source) == want


def test_embedding_calls_are_tried_again(spark):
    from inkwell.functions import embedding

    def flaky(texts):
        if any("bad" in t for t in texts):
            raise TimeoutError
        return [[len(t), 1] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, " "), (4, "bad"), (5, "x" * 9000)], "k int, t string").coalesce(1)
    got = {r["k"]: r["v"] for r in rows.select("k", embedding.embedded(F.col("t"), flaky, at_once=1, attempts=2, wait=0.01).alias("v")).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: None, 4: None, 5: [8000.0, 1.0]}


def test_every_entity_is_unescaped_once(spark):
    assert one(spark, text.unescaped("a"), "&eacute;&#8211;&#x41;&amp;eacute;") == "é–A&eacute;"
    assert one(spark, text.unescaped("a"), "&amp;lt; &quot;") == '&lt; "'
    assert one(spark, vector.l2_normalised(F.array(F.col("a"), F.col("a"))), 0) == [0.0, 0.0]
    assert one(spark, vector.l2_normalised(F.array(F.col("a"), F.lit(4)), unless_length=2), 3) == [3.0, 4.0]


def test_an_entity_that_was_cut_stays(spark):
    assert one(spark, text.unescaped("a"), "cut&amp and&amp;") == "cut&amp and&"
    assert one(spark, text.unescaped("a"), "&eacute;&amp &notit; &copy=1 &amp;") == "é&amp &notit; &copy=1 &"
    assert one(spark, text.inline_text("a"), "<h1>a &am</h1><b>&#39</b>") == "a &am &#39"


def test_old_encoding_first(spark):
    rows = spark.createDataFrame([(b"\xe8",), ("č\x81".encode(),)], "b binary")
    assert rows.select(files.decoded("b", old_first=True).alias("t")).first()["t"] == "č"


def test_running_sums_over_ranges(spark):
    from inkwell.operators import prefix

    rows = spark.range(1000).selectExpr("id", "id % 3 as g", "id % 7 as n").repartition(6)
    got = sorted((r["g"], r["id"], r["b"]) for r in prefix.running(rows, F.col("n"), F.desc("id"), group=("g",), name="b").collect())
    want, sums = [], {}
    for k in range(999, -1, -1):
        want.append((k % 3, k, sums.get(k % 3, 0)))
        sums[k % 3] = sums.get(k % 3, 0) + k % 7
    assert got == sorted(want)
