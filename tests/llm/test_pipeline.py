"""The pipeline's rows against the plain versions of its stages."""

import brute
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import toxicity
from inkwell.session import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.sample(labels, docs, held_out=toxicity.held_out()))
    kept = {r["doc_id"]: r for r in toxicity.scored(docs, model).filter(F.col("score") < 0.5).collect()}
    seen = {}
    for k in sorted(kept):
        body = " ".join(brute.re.split(r"[\x20\x09-\x0D]+", kept[k]["text"] or ""))
        seen.setdefault(body, k)
    kept = {k: kept[k] for k in seen.values()}
    near = brute.near_duplicates([(k, r["text"]) for k, r in kept.items()], width=5)
    kept = {k: kept[k] for k, _, _, keep in near if keep}
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    clean = {r[0] for r in brute.decontamination([(k, r["text"]) for k, r in kept.items()], items) if not r[5]}
    taken = brute.mixing([(k, kept[k]["source"], len(brute.VISIBLE.findall(kept[k]["text"] or ""))) for k in sorted(clean)])
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {k: n for k, n in taken.items() if n}
    want = brute.mixing_targets([(kept[k]["source"], len(brute.VISIBLE.findall(kept[k]["text"] or ""))) for k in clean])
    for r in rows:
        assert r["text"] == kept[r["doc_id"]]["text"] and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert abs(r["target"] - want[r["source"]][1]) <= 1e-6 * want[r["source"]][1]


def test_run_on_odd_rows(spark, tmp_path):
    """Null, empty, long, repeated and tied rows, null keys and sources, clashing and odd column names; and empty tables."""
    long = "dlouhý text " * 30_000
    item = " ".join(f"zkouška{k}" for k in range(30))
    rows = [(1, None, None), (2, "", "a"), (3, "stejný text tady", "a"), (4, "stejný  text tady", "b"), (4, "stejný  text tady", "b"), (None, "bez klíče je tohle", "a"), (5, long, "c"), (6, f"úvod {item}", "a"), (7, "něco jiného o počasí", "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"lang": F.lit("cs"), "n_chars": F.length("text").cast("bigint"), "Toxicity_Score": F.lit("x"), "my col": F.lit(1), "a.b": F.lit(2), "Copies": F.lit(3), "kept": F.lit(4)})
    for folder, part in (("some", docs), ("none", docs.limit(0))):
        part.write.parquet(str(tmp_path / folder / "documents.parquet"))
        spark.createDataFrame([(9, item), (10, None)], "item_id bigint, text string").write.parquet(str(tmp_path / folder / "benchmark.parquet"))
        spark.createDataFrame([(3, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / folder / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert out.columns[: len(docs.columns)] == docs.columns and "taken" in out.columns and [c for c in out.columns if c.lower() == "copies"] == ["Copies"]
    found = {r["doc_id"] for r in out.collect()}
    assert 6 not in found and 4 not in found and found <= {3, None, 5, 7} and len(found) >= 3
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
