"""The pipeline's stages against plain versions of what they decide, and on odd rows."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import byte_bpe, mixing, secret_scan, simhash_dedup
from tessera.llm._shared import table, written
from tests.llm.test_operators import ODD, brute_simhash, forest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def after_each(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def stages(spark, sf):
    return [table(spark, sf, "documents"), *after_each(spark, sf)]


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "secret_scan", "source_mixing", "byte_bpe"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_language_keeps_documents_of_the_languages(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == {r.doc_id for r in stages[0].collect() if any(c.isalpha() for c in r.text)}


def test_one_document_of_each_class_stays(stages):
    rows = stages[1].collect()
    codes = {r.doc_id: brute_simhash(r.text) for r in rows}
    ids = sorted(codes)
    comp = forest([(a, b) for k, a in enumerate(ids) for b in ids[:k] if (codes[a] ^ codes[b]).bit_count() <= 4], ids)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(comp.values()))
    before = {r.doc_id: r for r in rows}
    assert all(before[r.doc_id] == r for r in stages[2].collect())


def test_secrets_are_gone_and_all_documents_stay(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert after[i].text == secret_scan.redacted(t, [(a, b) for a, b, _ in secret_scan.spans(t)], "[secret]")
        assert after[i].n_chars == len(after[i].text) and (after[i].text == t) == (not secret_scan.spans(t))


def test_mixture_repeats_whole_documents(stages):
    before, after = stages[3].collect(), Counter(map(tuple, stages[4].collect()))
    assert set(after) <= set(map(tuple, before)) and max(after.values()) <= 2
    copies = {r.id: r.copies for r in mixing.mix(stages[3]).collect()}
    assert all(after[tuple(r)] == copies[r.doc_id] for r in before)


def test_tokens_round_trip(stages):
    v = byte_bpe.default_vocabulary()
    of_id = dict(zip(v.ids, v.keys, strict=True))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages[4].collect())
    for r in rows:
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert r.round_trip and len(ids) == r.n_tokens and b"".join(of_id[k] for k in ids).decode() == texts[r.doc_id]


def test_run_is_the_stages(spark, sf, stages):
    digest = lambda df: Counter((r.doc_id, r.n_tokens, hashlib.sha256(r.token_ids).digest()) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, sf)) == digest(stages[5])


def test_odd_rows_and_nothing(spark, tmp_path):
    rows = [(i, t, *(rest or ("en", "s")), len(t or "")) for i, t, *rest in ODD]
    for k, own in enumerate((rows, [])):
        spark.createDataFrame(own, KIND).write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        got = after_each(spark, str(tmp_path / str(k)))
        counts = [d.count() for d in got]
        assert counts[0] >= counts[1] == counts[2] and counts[4] == counts[3]
        if own:
            kept = {r.doc_id for r in got[0].collect()}
            assert {6, None} <= kept <= {4, 5, 6, 7, 8, None}  # what little is learned here doesn't cover every text
            assert sorted(str(r.doc_id) for r in got[1].collect()) == sorted(map(str, kept))
        else:
            assert counts == [0] * 5


def test_clashing_columns_pass_through(spark, tmp_path):
    clash = ", ".join(f"{c} string" for c in ("doc", "found", "none", "key", "keep", "first", "copies", "id", "col", "lang_pred", "secret_spans", "component_id", "size"))
    rows = [(k, f"some words of document {k} and more of them " * 3, "en", "ab"[k % 2], 0, *"mnopqrstuvwxy") for k in range(40)]
    docs = spark.createDataFrame(rows, f"{KIND}, {clash}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "clash")
        assert docs.columns == [c.split()[0] for c in f"{KIND}, {clash}".split(", ")]
        assert docs.count() > 0 and all(tuple(r)[5:] == tuple("mnopqrstuvwxy") for r in docs.collect())
    assert corpus_pipeline.token_stage(spark, docs, str(tmp_path)).where("not round_trip").count() == 0


def test_each_null_id_stays(spark, tmp_path):
    rows = [(None, "same words in both of these", "en", "s", 27), (None, "same words in both of these", "en", "s", 27), (3, "same words in both of these", "en", "s", 27), (4, "same words in both of these", "en", "s", 27)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, KIND), str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "None", "None"]


def test_rows_that_share_an_id_are_told_apart(spark, tmp_path):
    a, b, c = ("one clean text of its own about gardens", "quite another text which speaks of ships", "a third one that has to do with trains")
    rows = [(3, b, "en", "s", 40), (3, a, "en", "s", 39), (4, b, "en", "s", 40), (5, c, "en", "s", 38), (5, c, "en", "t", 38), (2, c, "en", "s", 38), (6, None, "en", "s", 0), (6, "", "en", "s", 0)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, KIND), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id != 6) == [(2, c), (3, a), (3, b)] and sum(r.doc_id == 6 for r in got) == 1


def test_null_and_repeated_ids_are_mixed_row_by_row(spark, tmp_path):
    sources = ["a"] * 60 + ["b"] * 25 + ["c"] * 15
    for ids in ([None] * 100, [7] * 100):
        rows = [(i, f"ten words of text number {k} are in this row", "en", s, 45) for k, (i, s) in enumerate(zip(ids, sources, strict=True))]
        docs = spark.createDataFrame(rows, KIND)
        want = {r.source: r.copies for r in mixing.mix(docs).groupBy("source").agg({"copies": "sum"}).toDF("source", "copies").collect()}
        got = Counter(r.source for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect())
        assert got == {s: n for s, n in want.items() if n} and len(set(want.values())) > 1


def test_chunks_spread_null_and_repeated_ids(spark):
    rows = [(i, k, 100) for k, i in enumerate([None] * 100 + [7] * 100 + list(range(100, 200)))]
    got = mixing.dealt(spark.createDataFrame(rows, "id long, uid long, n_docs long"), 10).collect()
    most = {name: max(Counter(r.chunk for r in got if has(r.id)).values()) for name, has in (("null", lambda i: i is None), ("repeated", lambda i: i == 7), ("own", lambda i: i is not None and i > 7))}
    assert len(got) == 300 and max(most.values()) <= 30, most


def test_unlabelled_documents(spark, tmp_path):
    spark.createDataFrame([(1, "some words", None, None, 10), (2, "12", None, None, 2)], KIND).write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in corpus_pipeline.language_stage(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)).collect()] == [1]


def test_components_of_the_query_are_those_of_the_stage(spark, sf, stages):
    found = simhash_dedup.op8_simhash_dedup(spark, sf).collect()
    classes = defaultdict(set)
    for r in found:
        classes[r.component_id].add(r.doc_id)
    assert all(min(c) == k for k, c in classes.items())
