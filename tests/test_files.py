"""Sinks with commit and abort, grey maps, the binary message, and settings kept as state."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import raster, setting_state
from tessera.sources import files, messages


def names_in(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_chunks_are_appended_in_order(spark, tmp_path):
    rows = [(f"f{k}", i, bytearray(f"{k}:{i};".encode())) for k in range(3) for i in range(20)] + [("empty", 0, None)]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "out")
    files.write_chunks(spark.createDataFrame(rows, "name string, ord long, content binary").repartition(5), path)
    assert names_in(path) == ["empty", "f0", "f1", "f2"]
    assert (tmp_path / "out/f1").read_text() == "".join(f"1:{i};" for i in range(20)) and (tmp_path / "out/empty").read_bytes() == b""
    files.write_chunks(spark.createDataFrame([("f1", 0, bytearray(b"new"))], "name string, ord long, content binary"), f"file://{path}")
    assert (tmp_path / "out/f1").read_text() == "new" and len(names_in(path)) == 4


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = F.when(F.col("id") == 37, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("binary")
    rows = spark.range(40).select((F.col("id") % 4).cast("string").alias("name"), F.col("id").alias("ord"), bad.alias("content"))
    with pytest.raises(Exception, match="no"):
        files.write_chunks(rows, path)
    assert names_in(path) == []


def test_rasters_round_trip(spark, tmp_path):
    draw = np.random.default_rng(2)
    want, rows = {}, []
    for s in (3, 4):
        image = draw.integers(0, 255, (48, 64), dtype=np.uint8)
        image[16:32, 32:48] = 0  # a block that isn't there
        want[str(s)] = image
        rows += [(s, bx + 5, by - 2, bytearray(image[by * 16 : by * 16 + 16, bx * 16 : bx * 16 + 16].tobytes()), 16) for by in range(3) for bx in range(4) if (by, bx) != (1, 2)]
    blocks = spark.createDataFrame(rows, "section_id long, bx long, by long, data binary, width int")
    path = str(tmp_path / "r")
    files.write_rasters(blocks, path)
    got = {r.name: r for r in files.read_rasters(spark, path).collect()}
    assert names_in(path) == ["3.pgm", "4.pgm"]
    assert all((np.frombuffer(got[k].data, np.uint8).reshape(got[k].height, got[k].width) == v).all() for k, v in want.items())
    px = raster.pixels(files.read_rasters(spark, path).where("name = '3'").select(F.lit(3).alias("section_id"), "data", "width"), ["section_id"]).where("value > 0")
    again = raster.to_blocks(px, ["section_id"], 16)
    assert sum(int(np.frombuffer(r.data, np.uint8).sum(dtype=int)) for r in again.collect()) == int(want["3"].sum(dtype=int))


@pytest.mark.parametrize("raw", [b"P6\n2 2\n255\n0123", b"P5\n2 2\n255\n012", b"P5\nx 2\n255\n0123"])
def test_odd_rasters_are_refused(spark, tmp_path, raw):
    (tmp_path / "a.pgm").write_bytes(raw)
    with pytest.raises(Exception, match="no grey map|pixels"):
        files.read_rasters(spark, str(tmp_path)).collect()


def some_tiles(spark):
    rows = [(s, 10 * s + i, i, 7, 100 * i, 100 * i + 50, 20 * s, 20 * s + 9, f"/t/ä{i}" if i else None, i / 4 if i % 2 else None) for s in range(3) for i in range(5)]
    return rows, spark.createDataFrame(rows, "section_id long, tile_id long, mfov long, tile_index long, x_start long, x_finish long, y_start long, y_finish long, filepath string, offset_x double")


def test_messages_round_trip(spark, tmp_path):
    rows, frame = some_tiles(spark)
    path = str(tmp_path / "m")
    messages.write_messages(frame, path)
    got = sorted(map(tuple, messages.read_messages(spark, path).collect()), key=lambda r: r[:2])
    assert got == [(*r, None) for r in rows]
    messages.write_messages(frame, path, name="part.pb", box=(100, 350, 0, 35))
    part = messages.read_messages(spark, path, "part.pb").collect()
    assert sorted((r.section_id, r.tile_id) for r in part) == [(r[0], r[1]) for r in rows if r[4] >= 100 and r[5] <= 350 and r[7] <= 35]


def test_unknown_fields_are_skipped_and_cut_messages_refused(tmp_path):
    tile = messages.encoded_tile({"tile_id": 4, "x_start": 1, "x_finish": 2, "y_start": 3, "y_finish": 4, "filepath": "f"})
    odd = messages.tagged(99, messages.BYTES, b"?") + tile + messages.tagged(77, messages.FIXED32, b"abcd") + messages.tagged(78, messages.FIXED64, b"abcdefgh") + messages.tagged(50, messages.VARINT, messages.varint(-1))
    section = messages.tagged(1, messages.VARINT, messages.varint(300)) + messages.tagged(messages.TILE, messages.BYTES, odd)
    one = messages.tagged(messages.SECTION, messages.BYTES, section)
    assert messages.decoded(one + messages.tagged(3, messages.BYTES, b"dir")) == [(300, 4, None, None, 1, 2, 3, 4, "f", None, None)]
    several = messages.tagged(5, 0, messages.varint(1)) + messages.tagged(6, 0, messages.varint(1)) + one + one.replace(b"f", b"g") + one
    assert [r[8] for r in messages.decoded(several)] == ["g"]
    assert messages.decoded(b"") == []
    for raw in (one[:-1], one[:1], b"\xff" * 11, messages.tagged(1, 3, b"")):
        with pytest.raises(ValueError):
            messages.decoded(raw)
    for n in (0, 1, 127, 128, 300, 1 << 40, (1 << 63) - 1):
        assert list(messages.fields(messages.tagged(1, 0, messages.varint(n)))) == [(1, n)]


def test_any_split_into_batches_gives_the_same_state(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.randrange(4), draw.choice("ab"), draw.random() < 0.6, round(draw.random() * 9, 6)) for _ in range(900)] + [(0, "a", None, None), (None, "b", True, 1.0)]
    frame = spark.createDataFrame(rows, "f int, k string, ok boolean, cost double")
    found = []
    for n in (1, 2, 5):
        path = str(tmp_path / f"s{n}")
        for part in range(n):
            state = setting_state.upsert(frame.where(F.pmod(F.xxhash64("cost", "f", "ok"), F.lit(n)) == part), path, ["f", "k"], "ok", "cost")
        found.append(sorted(map(tuple, state.collect()), key=repr))
        assert setting_state.versions(spark, path) == list(range(max(1, n - 1), n + 1))
    assert found[0] == found[1] == found[2] and sum(r[2] for r in found[0]) == 902
    one = next(r for r in setting_state.statistics(state, ["f", "k"]).collect() if (r.f, r.k) == (1, "b"))
    own = [(ok, c) for f, k, ok, c in rows if (f, k) == (1, "b")]
    assert one.trials == len(own) and one.accuracy == pytest.approx(np.mean([ok for ok, _ in own])) and one.cost == pytest.approx(np.mean([c for _, c in own])) and one.cost_std == pytest.approx(np.std([c for _, c in own], ddof=1))
    assert setting_state.current(spark, str(tmp_path / "none")) is None


def test_one_beaten_setting_goes_at_a_time(spark):
    rows = [(i, *draw) for i, draw in enumerate([(300, 150, 10), (300, 150, 10), (300, 200, 5), (100, 1, 99), (250, 100, 20), (400, 390, 50)])]
    sums = spark.createDataFrame([(i, n, s, float(n * c), float(n * c * c), False) for i, n, s, c in rows], "id int, trials long, successes long, cost_sum double, cost_squares double, pruned boolean")
    gone, state = [], sums
    for _ in range(4):
        state = setting_state.pruned_one(state, ["id"])
        gone.append(sorted(r.id for r in state.where("pruned").collect()))
    def beaten(alive):  # the first that another is as good as
        big = [(i, s / n, c) for i, n, s, c in rows if i in alive and n >= 200]
        return next((i for i, a, c in big if any(j != i and a <= b and c >= d for j, b, d in big)), None)
    alive, want = {r[0] for r in rows}, []
    for _ in range(4):
        i = beaten(alive)
        alive -= {i}
        want.append(sorted({r[0] for r in rows} - alive))
    assert gone == want and gone[-1] == [0, 1, 4]
