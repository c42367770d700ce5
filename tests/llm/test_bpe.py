"""Byte-level BPE against the tiktoken library, and the round trip."""

import base64
import hashlib

import public_tokenizers
import tiktoken

from tessera.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_pattern_is_the_public_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_matches_library(spark, sf_dir):
    with open(VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [None, "", " ", "a" * 400, " " * 70 + "x\n\n  y", "日本語テキスト 🙂🙂 ok", "it's we'LL 123 4567 ___ \x1c a\x85b", "q" * 300 + "-" * 300, "<|endoftext|> b", " a \xa0b"]
    texts = odd + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    frame = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode(frame, VOCABULARY).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_words_merge_alike():
    encoder = bpe.Encoder(VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    for word in ("a" * 50_000, "ab" * 300 + "abc" * 200, "=" * 2001, "überlänge" * 400, "\n" * 999):
        assert encoder.long_merged(word.encode()) == (",".join(map(str, library.encode_ordinary(word))), word.encode())
    some = [b"contraction", b"mississippi", "über".encode(), b"aaaaaaaaaaaaa"]
    assert [encoder.long_merged(w) for w in some] == encoder.merged(some)


def test_generations_keep_results(spark, monkeypatch):
    encoder = bpe.Encoder(VOCABULARY)
    monkeypatch.setattr(bpe, "KEEP_WORDS", 3)
    for words in ({"alpha", "beta", " gamma", "ħ"}, {"delta", "alpha"}, {"alpha", "eps"}):
        encoder.learn(words)
        assert words <= encoder.young.keys()
    assert encoder.young["alpha"][1] == b"alpha" and len(encoder.young) < 5


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []
