"""The registered queries on the small tables, against plain versions of the same contracts."""

import hashlib

import brute
import pytest

from inkwell.llm import queries
from inkwell.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_decontamination(spark, docs):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    got = rows(queries.op2_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.decontamination(docs, items)
    assert any(r[5] for r in got)


def test_chat(spark):
    turns = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    turns += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = rows(queries.op3_chat_format(spark, SF), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert got == brute.chat(turns)


def test_warc(spark):
    pages = [tuple(r) for r in table(spark, SF, "pages").select("page_id", "html").collect()]
    newest = {}
    for page_id, html in pages:
        body = (html or "").encode()
        newest[body] = max(page_id, newest.get(body, page_id))
    want = []
    for page_id, html in pages:
        body = (html or "").encode()
        again = len(body) >= 1000 and newest[body] != page_id
        want.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", newest[body] if again else None))
    got = queries.op4_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])


def test_mixing(spark):
    SF = "/root/testdata/sf0.01"
    sizes = [(r["doc_id"], r["source"], len(brute.VISIBLE.findall(r["text"] or ""))) for r in table(spark, SF, "documents").collect()]
    want = brute.mixing_targets([(s, n) for _, s, n in sizes])
    got = {r["doc_id"]: r for r in queries.op5_mixing(spark, SF).collect()}
    taken = dict.fromkeys(want, 0)
    for doc_id, source, size in sizes:
        r = got[doc_id]
        assert (r["size"], r["source_size"]) == (size, want[source][0])
        assert r["target"] == pytest.approx(want[source][1])
        assert 0 <= r["taken"] <= 2 * size
        taken[source] += r["taken"]
    smallest = {s: min(n for _, x, n in sizes if x == s) for s in want}
    for s, n in taken.items():
        assert abs(n - want[s][1]) <= max(smallest[s], 0.01 * want[s][1])
    assert rows(queries.op5_mixing(spark, SF), "doc_id", "taken") == sorted((k, r["taken"]) for k, r in got.items())


def test_near_duplicates(spark, docs):
    got = rows(queries.op6_near_dedup(spark, SF), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(docs)
    assert not all(r[3] for r in got)


def test_lm(spark, docs):
    got = rows(queries.op7_lm_score(spark, SF), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = brute.lm(docs)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=1e-9)


def test_toxicity(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF.replace("0.001", "0.01"), "labels").collect()}
    got = queries.op9_toxicity(spark, SF.replace("0.001", "0.01")).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (brute.remainder(r["doc_id"]) == 0) for r in got)


def test_toxicity_recall_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in queries.op9_toxicity(spark, sf).filter("held_out").collect() if r["doc_id"] in labels]
    toxic, found = sum(b for _, b in held), sum(a for a, _ in held)
    both = sum(a and b for a, b in held)
    assert toxic >= 50 and both >= 0.85 * toxic and both >= 0.9 * found


def test_token_counts(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in docs)
    got = rows(queries.op10_token_counts(spark, SF), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert got == [(*w, w[2] > 512) for w in want]
