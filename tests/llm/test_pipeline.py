"""The pipeline's stages against brute-force versions of what they decide."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import quality, secrets
from tests.llm.test_resemblance import brute as alike


def brute_repeats(rows, window=20):
    first = {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i : i + window]), (d, i))
    out = {}
    for d, t in rows:
        w = split[d]
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        out[d] = b" ".join(x for x, g in zip(w, gone) if not g).decode() if any(gone) else t
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "token = 'abcdef1234567890abcdef'", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).repartition(3)
    kept = {r.doc_id for r in quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep").collect()}
    columns = docs.columns
    one = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept and len(kept) > 100
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = corpus_pipeline.near_duplicates(spark, one, sf_dir).cache()
    assert two.columns == columns and sorted((r.doc_id, r.text) for r in two.where("doc_id < 9000").collect()) == sorted(r for r in alike(rows) if r[0] < 9000)
    assert len({r.doc_id for r in two.where("doc_id IN (9000, 9001)").collect()}) == 1  # null and empty are alike
    three = corpus_pipeline.substrings(spark, two, sf_dir).cache()
    want = brute_repeats([(r.doc_id, r.text) for r in two.collect()])
    assert three.columns == columns and {r.doc_id: r.text for r in three.collect()} == want
    four = corpus_pipeline.secrets(spark, three, sf_dir).cache()
    assert four.columns == columns
    before = {r.doc_id: r for r in three.collect()}
    for r in four.collect():
        old = before[r.doc_id]
        assert (r.lang, r.source) == (old.lang, old.source) and (r.text is None) == (old.text is None)
        if r.text is not None:
            assert r.n_chars == len(r.text) and not secrets.base_spans(r.text)
            assert r.text == old.text or secrets.base_spans(old.text) or "[random]" in r.text
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.packing(spark, four, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for r in four.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for p in pieces[r.doc_id]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
        assert sum(p.length for p in pieces[r.doc_id]) == len(ids)


def test_odd_tables(spark, sf_dir):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "mine", 1, None), (1, text, "mine", 1, None), (2, text + " more", "mine2", 2, 7), (None, None, None, None, None), (None, "Other " + text, "x", 3, 8), (3, "x " * 40_000, "y", 4, 9)]
    names = "doc_id long, text string, __text_is_null string, row int, n_chars int"
    docs = spark.createDataFrame(rows, names)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).cache()
    assert sorted((r.doc_id or 0, r["row"] or 0) for r in kept.collect()) == [(0, 0), (1, 1), (3, 4)]
    for stage in (corpus_pipeline.quality, corpus_pipeline.substrings, corpus_pipeline.secrets):
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns and {r["__text_is_null"] for r in out.collect()} <= {"mine", "mine2", None, "x", "y"}
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    cut = {(r.doc_id, r["row"]): r for r in corpus_pipeline.substrings(spark, docs, sf_dir).collect()}
    assert cut[1, 1].n_chars == len(text) and cut[2, 2].text == "more" and cut[None, None].text is None and cut[None, 3].text == "Other"
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), sf_dir).collect() == []
    assert corpus_pipeline.packing(spark, docs.limit(0), sf_dir).collect() == []
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, sf_dir).collect()} == {1, 2, 3, None}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
