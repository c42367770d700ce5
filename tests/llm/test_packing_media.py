"""Packing against the tokenizers library; media against the definition."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import media, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a" * 400, "日本語テキスト 🙂🙂 ok", "it's we'LL 123 4567 ___ \x1c a\x85b\xa0c ²³ª", "x <|endoftext|> y", "é\n\n  — b"]


def texts(spark, sf_dir):
    return ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_fast_ids_are_the_library_s():
    rng = np.random.default_rng(4)
    tokens, library = packing.Tokens.of(PATH), Tokenizer.from_file(PATH)
    for _ in range(300):
        text = "".join(map(chr, rng.choice(256, int(rng.integers(0, 60))).tolist()))
        assert tokens.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts():
    for n in [1, 2, 255, 256, 257, 511, 2047, 2048, 2049, 9999]:
        assert sum(packing.cuts(n)) == n and max(packing.cuts(n)) <= 2048 and min(packing.cuts(n)) > 0


def test_pieces(spark, sf_dir):
    rows = texts(spark, sf_dir)
    library = Tokenizer.from_file(PATH)
    frame = spark.createDataFrame([(i, t, 5, "q") for i, t in enumerate(rows)], "doc_id long, text string, length int, ids string").repartition(4)
    got = packing.pack(frame, PATH).collect()
    of_doc, of_bin = defaultdict(list), defaultdict(list)
    for r in got:
        of_doc[r.doc_id].append(r)
        of_bin[r.sequence_id].append(r)
    assert set(of_doc) == set(range(len(rows)))
    total = 0
    for i, t in enumerate(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(of_doc[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        at = 0
        for r in own:
            assert (r.start, r.length, r.doc_tokens) == (at, len(r.ids), len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        total += len(ids)
    for own in of_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(of_bin) * 2048 <= total * 1.03 + 2 * 2048


def test_media(spark, sf_dir):
    rows = texts(spark, sf_dir) + ["same", "same", "x" * 64, "y" * 5000]
    frame = spark.createDataFrame([(i, t, b"1") for i, t in enumerate(rows)], "doc_id long, text string, media binary").repartition(3)
    got = {r.doc_id: r for r in media.fingerprint_media(frame).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert media.from_wav(bytes(r.media)) == payload and len(payload) % 64 == 0 and payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert len(r.times) == len(r.hashes) and list(r.times) == sorted(r.times)
    same = [i for i, t in enumerate(rows) if t == "same"]
    assert got[same[0]].feature == got[same[1]].feature
    long = [r for r in got.values() if r.n_bytes > 3000]
    assert len({r.feature for r in long}) > len(long) * 0.8


def plain_feature(payload):
    """Peaks, time-coded pairs and the feature by loops over frames and bands."""
    x = [float(b) - 128 for b in payload]
    x += [0.0] * (256 - len(x))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 255) for i in range(256)]
    best = []
    for at in range(0, len(x) - 255, 128):
        power = np.abs(np.fft.rfft([v * w for v, w in zip(x[at : at + 256], window)])) ** 2
        best.append([max(((power[f], -f) for f in range(a, b))) for a, b in ((2, 16), (16, 40), (40, 76), (76, 129))])
    peaks = []
    for t, row in enumerate(best):
        for k, (p, f) in enumerate(row):
            before, after = (best[t + d][k][0] for d in (-1, -2) if t + d >= 0), (best[t + d][k][0] for d in (1, 2) if t + d < len(best))
            if p > 0 and all(p > q for q in before) and all(p >= q for q in after):
                peaks.append((t, -f))
    pairs = sorted((t, f << 13 | peaks[i + s][1] << 5 | peaks[i + s][0] - t) for i, (t, f) in enumerate(peaks) for s in (1, 2, 3) if i + s < len(peaks) and peaks[i + s][0] - t <= 24)
    sketch = sorted((h * 0x9E3779B97F4A7C15 % 2**64) >> 32 for h in {h for _, h in pairs})[:16]
    return pairs, f"{len(peaks)}:{len(pairs)}:" + ",".join(f"{v:08x}" for v in sketch)


def test_features_are_the_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = ["", "same", *("".join(map(chr, rng.integers(97, 123, int(n)).tolist())) for n in rng.integers(1, 4000, 12))]
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*rows, rows[2]])], "doc_id long, text string, feature int")
    for r in media.fingerprint_media(frame, keep_media=False).collect():
        raw = [*rows, rows[2]][r.doc_id].encode()
        pairs, feature = plain_feature(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
        assert list(zip(r.times, r.hashes)) == pairs and r.feature == feature


def test_peaks_find_a_tone():
    n = np.arange(8000)
    time, frequency = media.peaks((128 + 100 * np.sin(2 * np.pi * n * 30 / media.FRAME)).astype(np.uint8))
    assert 30 in frequency.tolist()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH).collect() == []
    assert media.fingerprint_media(empty).collect() == []
