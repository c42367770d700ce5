"""Operators against numpy and plain loops: geometry, joins, consensus, graphs, meshes, sources."""

import inspect
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import aggregates, graph, learning, matching, mesh, raster, selection, spatial, volume
from tessera.plans import lenses, pipelines, queries, section_queries
from tessera.sources import tilespecs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_transforms(spark):
    m, n = (2.0, 0.5, 3.0, -1.0, 1.0, 4.0), (0.0, 1.0, -2.0, 1.0, 0.0, 5.0)
    both = one(spark, *g.affine(1.5, -2.0, g.compose(m, n)))
    first = one(spark, *g.affine(1.5, -2.0, n))
    assert tuple(both) == tuple(one(spark, *g.affine(first[0], first[1], m)))
    folded = one(spark, g.fold_affines(F.array(F.array(*map(F.lit, m)), F.array(*map(F.lit, n)))).alias("m")).m
    assert folded == list(one(spark, *g.compose(m, n)))
    x, y = one(spark, *g.rotate(1.0, 0.0, math.pi / 2))
    assert abs(x) < 1e-12 and abs(y - 1) < 1e-12
    assert one(spark, g.scaled(-7.0, 2.0), g.scaled(7.0, 2.0))[:] == (-3, 4)
    assert [round(v) for v in one(spark, g.angle_degrees(0.0, -1.0), g.angle_degrees(-1.0, 0.0))] == [270, 180]
    assert list(one(spark, *g.affine_box(0.0, 0.0, 2.0, 1.0, (0.0, -1.0, 0.0, 1.0, 0.0, 0.0)))) == [-1.0, 0.0, 0.0, 2.0]
    assert one(spark, g.huber(3.0, 2.0), g.huber(-1.0, 2.0))[:] == (4.0, 0.5)
    assert g.parsed_box("1,2,3,4") == (1, 2, 3, 4)
    with pytest.raises(ValueError):
        g.parsed_box("1,2,3")


def test_quantized_wraps(spark):
    assert one(spark, g.quantized(F.array(*map(F.lit, [127.9, 128.0, 255.0, -129.0]))).alias("q")).q == [127, -128, -1, 127]
    assert one(spark, g.padded(F.lit("7"), 3), g.padded(F.lit("12345"), 3))[:] == ("007", "12345")
    assert one(spark, g.parsed_affine(F.lit("1 2 3 4 5 6")).alias("m")).m == [1.0, 3.0, 5.0, 2.0, 4.0, 6.0]
    assert one(spark, g.parsed_rigid(F.lit("0 5 6")).alias("m")).m == [1.0, 0.0, 5.0, 0.0, 1.0, 6.0]


def boxes(spark, n=120, seed=0):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = draw.uniform(-4000, 9000, 2)
        w, h = draw.uniform(1, 3000, 2)
        rows.append((int(i % 2), i, float(x), float(x + w), float(y), float(y + h)))
    return spark.createDataFrame(rows, "section_id long, tile_id long, x_start double, x_finish double, y_start double, y_finish double"), rows


def test_binned_join_is_the_nested_loop(spark):
    frame, rows = boxes(spark)
    cut = [(s, i, *map(int, r)) for s, i, *r in rows]
    for least in (None, 50):
        want = set()
        for a in cut:
            for b in cut:
                meets = a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and a[3] > b[2] and a[4] < b[5] and a[5] > b[4]
                if meets and (least is None or min(a[3] - b[2], b[3] - a[2]) >= least <= min(a[5] - b[4], b[5] - a[4])):
                    want.add((a[0], a[1], b[1]))
        for cell in (700, 5000):
            got = [tuple(r) for r in spatial.overlap_pairs(frame, least=least, cell=cell).select("section_id", "a", "b").collect()]
            assert len(got) == len(set(got)) and set(got) == want
    half = spatial.overlap_pairs(frame, canonical=True).count()
    assert half * 2 == spatial.overlap_pairs(frame).count()
    moved = frame.withColumns({"x_start": F.col("x_start") + 12345, "x_finish": F.col("x_finish") + 12345})
    assert moved.count() == frame.count()
    plan = spatial.overlap_pairs(frame)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_consensus_matches_loops(spark):
    draw = np.random.default_rng(1)
    rows = [(int(p), i, float(draw.normal(p, 4)), float(draw.normal(-p, 4))) for i, p in enumerate(draw.integers(0, 4, 300))]
    frame = spark.createDataFrame(rows, "pair long, ord long, dx double, dy double")
    for strict in (False, True):
        got = {r.pair: (r.dx, r.dy, r.support, r.total) for r in matching.consensus(frame, ["pair"], 3.0, strict=strict).collect()}
        for p in range(4):
            own = [r for r in rows if r[0] == p]
            near = lambda r: sum(((r[2] - m[2]) ** 2 + (r[3] - m[3]) ** 2) < 9 or (not strict and ((r[2] - m[2]) ** 2 + (r[3] - m[3]) ** 2) == 9) for m in own)
            best = max(own, key=lambda r: (near(r), -r[1]))
            assert got[p] == (best[2], best[3], near(best), len(own))


def test_large_pairs_are_scored_alike(spark):
    draw = np.random.default_rng(3)
    rows = [(int(p), i, int(x), int(y)) for i, (p, x, y) in enumerate(draw.integers(0, 12, (400, 3)))]
    frame = spark.createDataFrame(rows, "pair long, ord long, dx long, dy long")
    got = [sorted(tuple(r) for r in matching.consensus(frame, ["pair"], 2.0, few=few).collect()) for few in (0, 20, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 12


def test_affine_fits(spark):
    draw = np.random.default_rng(2)
    m = np.array([[1.1, 0.2, 5.0], [-0.3, 0.9, -7.0]])
    rows = []
    for i in range(60):
        x, y = draw.uniform(-100, 100, 2)
        u, v = m @ [x, y, 1]
        if i % 3 == 0:
            u += 500
        rows.append((0, float(x), float(y), float(u), float(v)))
    frame = spark.createDataFrame(rows, "pair long, x double, y double, u double, v double")
    model = matching.affine_consensus(frame, ["pair"], 1.0, trials=40).first()
    assert model.inliers == 40 and model.total == 60
    assert np.allclose([model.a00, model.a01, model.tx, model.a10, model.a11, model.ty], m.ravel(), atol=1e-6)
    good = [r for i, r in enumerate(rows) if i % 3]
    fit = matching.fit_affine(spark.createDataFrame(good, frame.schema), ["pair"]).first()
    assert np.allclose([fit.a00, fit.a01, fit.tx, fit.a10, fit.a11, fit.ty], m.ravel(), atol=1e-6)
    assert matching.fit_affine(spark.createDataFrame(good[:2], frame.schema), ["pair"]).first().a00 is None


def test_nearest_two_needs_two(spark):
    q = spark.createDataFrame([(0, 1, [0.0, 0.0]), (1, 2, [0.0, 0.0])], "k long, q long, v array<double>")
    c = spark.createDataFrame([(0, 5, [3.0, 4.0]), (0, 4, [3.0, 4.0]), (0, 9, [0.0, 1.0]), (1, 3, [1.0, 0.0])], "k long, c long, v array<double>")
    assert [tuple(r) for r in matching.nearest_two(q, c, ["k"]).collect()] == [(0, 1, 9, 1.0, 4, 5.0)]


def test_relaxation_settles_at_the_solution(spark):
    draw = np.random.default_rng(3)
    n = 12
    pairs = [(i, j) for i in range(n) for j in range(i) if draw.random() < 0.4 or j == i - 1]
    x = draw.uniform(0, 100, (n, 2))
    ideal = np.array([x[i] - x[j] + draw.normal(0, 2, 2) for i, j in pairs])
    a, b = (np.array([p[k] for p in pairs] + [p[1 - k] for p in pairs]) for k in (0, 1))
    both = np.concatenate([ideal, -ideal])
    off = graph.solved_offsets(a, b, both, x)
    degree = np.bincount(a, minlength=n)
    assert np.allclose((off * degree[:, None]).sum(0), 0, atol=1e-9)
    step, moved = 0.3, np.zeros((n, 2))
    for _ in range(8000):
        grad = np.zeros((n, 2))
        np.add.at(grad, a, (x[a] + moved[a]) - (x[b] + moved[b]) - both)
        moved -= step * grad / degree[:, None]
    assert np.allclose(off, moved, atol=1e-6)
    edges = spark.createDataFrame([(0, int(i), int(j), float(d[0]), float(d[1])) for (i, j), d in zip(pairs, ideal)], "section_id long, a long, b long, ideal_dx double, ideal_dy double")
    tiles = spark.createDataFrame([(0, i, float(p[0]), float(p[1])) for i, p in enumerate(x)], "section_id long, tile_id long, x double, y double")
    got = {r.tile_id: (r.x, r.y) for r in graph.solve_positions(graph.symmetric(edges, ["section_id"]), tiles, ["section_id"]).collect()}
    assert np.allclose([got[i] for i in range(n)], x + off, atol=1e-9)


def test_large_sections_settle_like_small_ones(spark):
    """A path of 30 tiles that starts far from its ideal, a second component, a tile without edges, another section."""
    draw = np.random.default_rng(8)
    rows = [(0, i, i + 1, float(100 + draw.normal()), float(draw.normal())) for i in range(29)] + [(0, 5, 12, 640.0, 3.0), (0, 40, 41, 90.0, 1.0), (1, 0, 1, 50.0, 0.0), (1, 1, 2, 51.0, 2.0), (1, 0, 2, 99.0, 1.0)]
    edges = spark.createDataFrame(rows, "section_id long, a long, b long, ideal_dx double, ideal_dy double")
    places = [(0, i) for i in [*range(30), 40, 41, 50]] + [(1, i) for i in range(3)]
    tiles = spark.createDataFrame([(s, i, *map(float, draw.normal(0, 1000, 2))) for s, i in places], "section_id long, tile_id long, x double, y double")
    both = graph.symmetric(edges, ["section_id"])
    small, large = ({(r.section_id, r.tile_id): (r.x, r.y) for r in graph.solve_positions(both, tiles, ["section_id"], most_tiles=n).collect()} for n in (100, 1))
    assert small.keys() == large.keys() and len(small) == len(places)
    assert np.allclose([small[p] for p in places], [large[p] for p in places], atol=1e-6)


def test_sections_of_many_edges_are_large(spark, monkeypatch):
    """A task's edges are bounded, not only its tiles."""
    given, plain = [], graph.solve_distributed
    monkeypatch.setattr(graph, "solve_distributed", lambda e, t, k: given.append(t.count()) or plain(e, t, k))
    edges = spark.createDataFrame([(0, 0, 1, 5.0, 0.0), (0, 1, 2, 4.0, 1.0), (0, 0, 2, 9.0, 0.0), (1, 0, 1, 3.0, 1.0)], "section_id long, a long, b long, ideal_dx double, ideal_dy double")
    tiles = spark.createDataFrame([(s, i, 10.0 * i * i, 3.0 * i) for s in (0, 1, 2) for i in range(3)], "section_id long, tile_id long, x double, y double")
    both = graph.symmetric(edges, ["section_id"])
    whole = {(r.section_id, r.tile_id): (r.x, r.y) for r in graph.solve_positions(both, tiles, ["section_id"]).collect()}
    parted = {(r.section_id, r.tile_id): (r.x, r.y) for r in graph.solve_positions(both, tiles, ["section_id"], most_edges=4).collect()}
    assert given == [3] and len(whole) == 9 and parted.keys() == whole.keys()
    assert np.allclose([parted[k] for k in sorted(whole)], [whole[k] for k in sorted(whole)], atol=1e-6)


def test_large_keys_get_the_same_affine(spark, monkeypatch):
    monkeypatch.setattr(matching, "POOL", 40)
    draw = np.random.default_rng(10)
    rows = [(k, *map(float, np.r_[p, 2 * p[0] + p[1] + draw.normal() * 3, p[1] - p[0] + (500 if i % 3 == 0 else 0)])) for k in range(3) for i, p in enumerate(draw.uniform(0, 300, (90, 2)))]
    frame = spark.createDataFrame(rows + [(3, 1.0, 1.0, 2.0, None)], "pair long, x double, y double, u double, v double")
    got = [sorted(tuple(r) for r in matching.affine_consensus(frame, ["pair"], 6.0, trials=60, most=most).collect()) for most in (1000, 20)]
    assert got[0] == got[1] and len(got[0]) == 3 and all(r[2] > 40 and r[3] == 90 for r in got[0])


def test_nearest_two_in_blocks(spark):
    draw = np.random.default_rng(7)
    v = draw.integers(0, 4, (150, 3)).astype(float)  # with many ties
    q = spark.createDataFrame([(i % 2, i, v[i].tolist()) for i in range(60)] + [(0, 999, None)], "k long, q long, v array<double>")
    c = spark.createDataFrame([(i % 2, i, v[i].tolist()) for i in range(60, 150)], "k long, c long, v array<double>")
    want = {}
    for i in range(60):
        d = sorted((float(np.sqrt(((v[i] - v[j]) ** 2).sum())), j) for j in range(60, 150) if j % 2 == i % 2)
        want[i] = (d[0][1], d[0][0], d[1][1], d[1][0])
    for block in (1, 7, 512):
        assert {r["query"]: (r.c1, r.d1, r.c2, r.d2) for r in matching.nearest_two(q, c, ["k"], block=block).collect()} == want


def test_overlap_with_the_slip(spark):
    def ref(a, b):
        return not (a[1] < b[0] or b[1] < b[0]) and not (a[3] < b[2] or b[3] < b[2])

    draw = np.random.default_rng(1)
    rows = [tuple(map(float, r)) for r in draw.integers(0, 30, (200, 8))] + [(10.0, 20.0, 0.0, 10.0, 0.0, 15.0, 0.0, 10.0), (50.0, 60.0, 50.0, 60.0, 0.0, 10.0, 0.0, 10.0)]
    names = [f"{s}{i}" for s in "ab" for i in range(4)]
    got = spark.createDataFrame(rows, names).select(*names, g.overlaps_compat(names[:4], names[4:]).alias("ok")).collect()
    assert len(got) == 202 and all(r.ok == ref(r[:4], r[4:8]) for r in got) and got[-1].ok


def test_only_free_points_of_a_border_move(spark):
    extent = spark.createDataFrame([(0, 0.0, 30.0, 0.0, 20.0)], "section_id long, x_start double, x_finish double, y_start double, y_finish double")
    grid = mesh.hex_grid(extent, ["section_id"], 10.0, pad=1)
    tris = mesh.hex_triangles(grid, ["section_id"])
    pulled = grid.select("section_id", "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.when(F.col("c") > 0, 0).otherwise(3)).alias("x"), "y", (F.col("c") == 0).alias("free"))
    got = mesh.border_settled(pulled, tris, ["section_id"]).join(pulled.select("idx", "free", F.col("x").alias("was")), "idx").collect()
    assert any(r.free for r in got) and all(r.x == r.was for r in got if not r.free)
    assert all(r.settled and abs(r.x - r.x0) < 0.3 for r in got if r.free)  # back at rest, from 3 away


def test_sections_follow_the_known_steps(spark, sf_dir):
    rows = section_queries.aligned_sections(spark, sf_dir).collect()
    assert {r.section_id for r in rows} == {1, 2}
    inside = [r for r in rows if 2000 < r.x0 < 18_000 and 2000 < r.y0 < 18_000]  # others lie beyond the matches, or the neighbour's mesh
    assert len(inside) > 10
    for r in inside:  # points move by about 120 and 80 from a section to the next
        assert abs(r.x - r.x0 + 122 * r.section_id) < 15 and abs(r.y - r.y0 - 79 * r.section_id) < 15


def test_box_matches_for_new_keypoints(spark, sf_dir):
    left, right = section_queries._sides(spark, sf_dir)
    boxes = volume._boxes(volume.extent_of_points(left), 24_000, 24_000, 0)
    found = volume.box_matches(boxes, left, right, ratio=0.65, least=12, share=0.05).collect()  # C8
    assert len(found) > 700 and all(r.a == r.b and r.a % 10 for r in found)
    tiles = spark.createDataFrame([(0, 1, 100.0, 50.0)], "section_id long, tile_id long, x_start double, y_start double")
    kp = spark.createDataFrame([(0, 1, 1.0, 2.0)], "section_id long, tile_id long, x double, y double")
    assert volume.stack_keypoints(kp, tiles).first()[:] == (0, 1, 101.0, 52.0)  # C20


def test_affine_consensus_finds_few_inliers(spark):
    draw = np.random.default_rng(9)
    rows = []
    for pair in range(6):  # 30 of 200 points follow the model
        p = draw.uniform(0, 1000, (200, 4))
        p[:30, 2], p[:30, 3] = 2 * p[:30, 0] + 0.5 * p[:30, 1] + 7, p[:30, 1] - p[:30, 0]
        rows += [(pair, *map(float, r)) for r in p]
    rows += [(10, 0.0, 0.0, 1.0, 2.0), (10, 1.0, 0.0, 2.0, 2.0), (10, 0.0, 1.0, 1.0, 3.0), (11, 0.0, 0.0, 1.0, 2.0)]
    got = {r.pair: r for r in matching.affine_consensus(spark.createDataFrame(rows, "pair long, x double, y double, u double, v double"), ["pair"], 0.5).collect()}
    assert sorted(got) == [*range(6), 10] and got[10].inliers == got[10].total == 3
    assert all(got[i].inliers >= 30 and got[i].total == 200 and np.allclose([got[i].a00, got[i].a01, got[i].tx, got[i].a10, got[i].a11, got[i].ty], [2, 0.5, 7, -1, 1, 0], atol=1e-6) for i in range(6))


def test_colours_differ_along_edges(spark, sf_dir):
    edges = lenses.edges(spark, sf_dir)
    colour = {(r.section_id, r.tile_id): r.colour for r in graph.greedy_colours(edges, ["section_id"]).collect()}
    assert all(colour[e.section_id, e.a] != colour[e.section_id, e.b] for e in edges.collect())


def test_colours_are_those_of_the_sequential_order(spark):
    draw = np.random.default_rng(12)
    pairs = {(s, int(a), int(b)) for s in range(3) for a, b in draw.integers(0, 40, (50, 2))} | {(5, i, i + 1) for i in range(6)} | {(6, 3, 3)}
    near = {}
    for s, a, b in pairs:
        near.setdefault((s, a), set()).add(b)
        near.setdefault((s, b), set()).add(a)
    want = {}
    for s, v in sorted(near):
        used = {want[s, w] for w in near[s, v] if w != v and (s, w) in want}
        want[s, v] = next(c for c in range(len(used) + 1) if c not in used)
    frame = spark.createDataFrame(sorted(pairs), "section_id long, a long, b long")
    assert {(r.section_id, r.tile_id): r.colour for r in graph.greedy_colours(frame, ["section_id"]).collect()} == want


def test_jiggle_is_the_sequential_one(spark):
    draw = np.random.default_rng(13)
    rows = [(s, i, float(x), float(x + 100), float(y), float(y + 80)) for s in range(2) for i, (x, y) in enumerate(draw.integers(0, 500, (20, 2)))]
    frame = spark.createDataFrame(rows, "section_id long, tile_id long, x_start double, x_finish double, y_start double, y_finish double").repartition(3)
    moves = {(r.section_id, r.tile_id): (r.dx, r.dy) for r in frame.select("section_id", "tile_id", *((2 * g.draw(3, "section_id", "tile_id", F.lit(w)) - 1).alias(f"d{w}") for w in "xy")).collect()}
    for allow_new in (True, False):
        got = {tuple(r)[:2]: tuple(r)[2:] for r in graph.jiggle(frame, ["section_id"], 20.0, seed=3, allow_new=allow_new, cell=150).collect()}
        box = {r[:2]: list(r[2:]) for r in rows}

        def met(key, own):
            out = set()
            for other, b in box.items():
                w, h = min(b[1], own[1]) - max(b[0], own[0]), min(b[3], own[3]) - max(b[2], own[2])
                if other[0] == key[0] and other != key and w > 0 and h > 0 and w * h / (2 * 100 * 80) > 0.008:
                    out.add(other)
            return out

        moved = 0
        for key in sorted(box):
            dx, dy = (20.0 * d for d in moves[key])
            new = [box[key][0] + dx, box[key][1] + dx, box[key][2] + dy, box[key][3] + dy]
            before, after = met(key, box[key]), met(key, new)
            if not before - after and (allow_new or not after - before):
                box[key] = new
                moved += 1
        assert 5 < moved <= 40 and all(np.allclose(got[k], box[k], atol=1e-9) for k in box)


def test_rounds_follow_the_number_of_tiles(spark, monkeypatch):
    """Not the longest chain of dependencies, and blocks of any size give the same."""
    made, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: made.append(name) or plain(df, name))
    chain = spark.createDataFrame([(0, i, i + 1) for i in range(60)], "section_id long, a long, b long")
    assert {r.tile_id: r.colour for r in graph.greedy_colours(chain, ["section_id"]).collect()} == {i: i % 2 for i in range(61)}
    row = spark.createDataFrame([(0, i, 50.0 * i, 50.0 * i + 100, 0.0, 80.0) for i in range(60)], "section_id long, tile_id long, x_start double, x_finish double, y_start double, y_finish double")
    whole = sorted(graph.jiggle(row, ["section_id"], 30.0, allow_new=False, cell=150).collect())
    assert len(made) <= 6
    assert sorted(graph.jiggle(row, ["section_id"], 30.0, allow_new=False, cell=150, at_once=13).collect()) == whole
    drawn = np.random.default_rng(2).integers(0, 50, (300, 2)).tolist()
    dense = spark.createDataFrame([(s, a, b) for s in (0, 1) for a, b in drawn], "section_id long, a long, b long")
    assert sorted(graph.greedy_colours(dense, ["section_id"]).collect()) == sorted(graph.greedy_colours(dense, ["section_id"], at_once=11).collect())


def test_mesh_covers_and_moves(spark):
    extent = spark.createDataFrame([(0, 0.0, 30000.0, 0.0, 20000.0)], "section_id long, x_start double, x_finish double, y_start double, y_finish double")
    grid = mesh.hex_grid(extent, ["section_id"], 6000.0)
    tris = mesh.hex_triangles(grid, ["section_id"])
    points = grid.select("section_id", "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 10).alias("x"), (F.col("y") * 2).alias("y"))
    draw = np.random.default_rng(4)
    own = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(draw.uniform(0, 20000, (200, 2)))], "section_id long, point_id long, x double, y double")
    before = {r.point_id: r for r in own.collect()}
    for r in mesh.elastic_transform(own, tris, points, ["section_id"], 6000).collect():
        assert r.moved and abs(r.x - before[r.point_id].x - 10) < 1e-6 and abs(r.y - 2 * before[r.point_id].y) < 1e-6
    far = spark.createDataFrame([(0, 1, 1e7, 1e7)], own.schema)
    assert mesh.elastic_transform(far, tris, points, ["section_id"], 6000).first()[:] == (0, 1, 1e7, 1e7, False)
    assert mesh.flips(tris, points.withColumn("x", -F.col("x")), ["section_id"]).first().flipped == tris.count()
    n_points, n_edges, n_tris = points.count(), mesh.mesh_edges(tris, ["section_id"]).count(), tris.count()
    assert n_points - n_edges + n_tris == 1  # a disc


def test_elastic_descent_follows_links():
    x0 = np.array([[i * 10.0, j * 10.0] for j in range(4) for i in range(4)])
    tris = np.array([t for j in range(3) for i in range(3) for t in ((4 * j + i, 4 * j + i + 1, 4 * j + i + 4), (4 * j + i + 1, 4 * j + i + 5, 4 * j + i + 4))])
    pairs = np.unique(np.sort(np.concatenate([tris[:, [0, 1]], tris[:, [1, 2]], tris[:, [0, 2]]]), axis=1), axis=0)
    weights = np.full((len(tris), 3), 1 / 3)
    target = x0[tris].mean(1) + [3.0, -2.0]
    x = mesh.elastic_descent(x0, pairs, tris, (np.arange(len(tris)), weights, target), most=3000)
    assert np.abs(x - x0 - [3.0, -2.0]).max() < 0.05


def test_query_meshes_are_those_of_a_long_run(spark, sf_dir, monkeypatch):
    rows = queries.elastic_mesh(spark, sf_dir).collect()
    run = mesh.elastic_meshes
    monkeypatch.setattr(mesh, "elastic_meshes", lambda *a, **k: run(*a, **k | {"most": 60_000}))
    long = {(r.section_id, r.idx): (r.x, r.y) for r in queries.elastic_mesh(spark, sf_dir).collect()}
    assert len(rows) == len(long) > 0 and all(r.settled for r in rows)
    assert np.allclose([(r.x, r.y) for r in rows], [long[r.section_id, r.idx] for r in rows], atol=1e-3)
    monkeypatch.setattr(mesh, "elastic_meshes", lambda *a, **k: run(*a, **k | {"turns": 1}))
    assert not any(r.settled for r in queries.elastic_mesh(spark, sf_dir).collect())


def test_pareto_matches_loops(spark):
    draw = np.random.default_rng(5)
    rows = [(i, int(a), int(c)) for i, (a, c) in enumerate(draw.integers(0, 12, (80, 2)))]
    got = {r.id for r in selection.pareto_front(spark.createDataFrame(rows, "id long, accuracy long, cost long")).collect()}
    assert got == {i for i, a, c in rows if not any(x >= a and y <= c and (x > a or y < c) for _, x, y in rows)}


def test_cascade_and_labels(spark):
    fast = spark.createDataFrame([(1, 0.0, 0.0, True), (2, 5.0, 0.0, False), (3, 1.0, 1.0, None)], "id long, dx double, dy double, ok boolean")
    out = learning.cascade(fast, F.col("ok"), lambda rest: rest.withColumn("dx", F.lit(9.0)))
    assert {r.id: r.dx for r in out.collect()} == {1: 0.0, 2: 9.0, 3: 9.0}
    more = pipelines.recover(fast.fillna({"ok": False}), ["id"], "ok", lambda rest: rest.withColumn("ok", F.lit(True)))
    assert more.count() == 3 and more.where("ok").count() == 3


def test_match_pairs_finds_the_offset(spark):
    draw = np.random.default_rng(6)
    v = draw.normal(size=(40, 8))
    rows = [(0, i, float(draw.uniform(0, 500)), float(draw.uniform(0, 500)), v[i].tolist()) for i in range(40)]
    left = spark.createDataFrame(rows, "pair long, id long, x double, y double, v array<double>")
    right = left.select("pair", (F.col("id") + 100).alias("id"), (F.col("x") + 17).alias("x"), (F.col("y") - 4).alias("y"), "v")
    r = pipelines.match_pairs(left, right, ["pair"], threshold=1.0).first()
    assert (round(r.dx), round(r.dy), r.accepted) == (17, -4, True) and r.support == r.total == 40


def coarse_sides(spark, n=60, tiles=3):
    draw = np.random.default_rng(8)
    rows = [(0, i % tiles, i, float(draw.uniform(0, 500)), float(draw.uniform(0, 500)), 10.0 ** (i % tiles), draw.normal(size=8).tolist()) for i in range(n)]
    left = spark.createDataFrame(rows, "pair long, tile_id int, id long, x double, y double, response double, v array<double>")
    return left, left.withColumns({"x": F.col("x") * 1.1 + F.col("y") * 0.1 + 3, "y": F.col("y") * 0.9 - 5})


def test_coarse_affine(spark):
    left, right = coarse_sides(spark)  # each tile's strongest keypoint is its own
    r = pipelines.coarse_affine(left, right, ["pair"], threshold=1.0).first()
    assert r.n == 60 and np.allclose([r.a00, r.a01, r.tx, r.a10, r.a11, r.ty], [1.1, 0.1, 3, 0, 0.9, -5], atol=1e-6)
    weak = left.withColumn("response", F.when(F.col("id") % 5 == 0, F.col("response") * 0.98).otherwise(F.col("response")))
    assert pipelines.coarse_affine(weak, right, ["pair"], threshold=1.0).first().n == 48


def test_coarse_affine_needs_its_matches(spark):
    left, right = coarse_sides(spark, 31)  # under 32 after the first consensus
    assert pipelines.coarse_affine(left, right, ["pair"], threshold=1.0).collect() == []
    assert pipelines.coarse_affine(left, right, ["pair"], threshold=1.0, least=(31, 12)).first().n == 31
    assert pipelines.coarse_affine(left, right, ["pair"], threshold=1.0, least=(31, 32)).collect() == []


def test_coarse_models_try_again(spark):
    left, right = coarse_sides(spark)
    left, right = left.withColumnRenamed("pair", "section_id"), right.withColumnRenamed("pair", "section_id")
    seeds = []

    def coarse(a, b, keys, seed):
        seeds.append(seed)
        found = pipelines.coarse_affine(a, b, keys, threshold=1.0, seed=seed)
        return found if seed == 4 else found.limit(0)

    assert volume.coarse_models(left, right, coarse).count() == 1 and seeds == [1, 2, 3, 4]
    seeds.clear()
    assert volume.coarse_models(left, right, lambda *a, seed: coarse(*a, seed=seed + 20)).count() == 0 and len(seeds) == 10


def test_affine_consensus_is_dealt_out(spark):
    rows = spark.range(4000).select((F.col("id") % 400).alias("pair"), *((F.col("id") * k % 97).cast("double").alias(c) for k, c in ((7, "x"), (11, "y"), (13, "u"), (17, "v"))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    found = matching.affine_consensus(rows, ["pair"], 2.0)
    assert found.count() == 400
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_winner_is_a_plain_count():
    draw = np.random.default_rng(6)
    p = draw.uniform(0, 50, (3000, 4)).round()
    p[: len(p) // 3, 2:] = p[: len(p) // 3, :2] + 4
    ordinal, models = matching._triple_models(p[:40], 200, 3)
    counts = [int(((m[0] * p[:, 0] + m[1] * p[:, 1] + m[2] - p[:, 2]) ** 2 + (m[3] * p[:, 0] + m[4] * p[:, 1] + m[5] - p[:, 3]) ** 2 <= 9).sum()) for m in models]
    assert matching._winner(p, models, 3.0) == (int(np.argmax(counts)), max(counts)) and len(ordinal) > 100


def test_rasters(spark):
    image = np.zeros((40, 50), np.uint8)
    image[10:20, 15:30] = 200
    frame = spark.createDataFrame([(1, 7, bytearray(image.tobytes()), 50), (1, 8, None, 50)], "section_id long, tile_id long, data binary, width int")
    px = raster.pixels(frame, ["section_id", "tile_id"])
    assert px.count() == 2000 and px.where("value = 200").count() == 150
    drawn = spark.createDataFrame([(s, x, y, 0 if s == 1 and (x, y) == (2, 2) else 10 * s) for s in (0, 1, 2) for x in range(5) for y in range(5)], "section_id long, x long, y long, value int")
    assert raster.patched(drawn, "section_id").where("section_id = 1 AND x = 2 AND y = 2").first().value == 20


def test_histogram_and_balance(spark):
    df = spark.createDataFrame([(0.5,), (3.2,), (3.9,), (70.0,)], "e double")
    assert [tuple(r) for r in aggregates.histogram(df, F.floor("e"), 5, dense=True).orderBy("bucket").collect()] == [(0, 1), (1, 0), (2, 0), (3, 2), (4, 0), (5, 1)]
    skewed = spark.range(4000).select((F.col("id") % 40 == 0).alias("l"))
    kept = []
    for parts in (1, 4, 7):
        rows = spark.range(4000).repartition(parts).select("id", (F.col("id") % 40 == 0).alias("l"))
        kept.append(sorted(r.id for r in aggregates.balanced(rows, F.col("l"), 5.0, ["id"]).collect()))
    assert kept[0] == kept[1] == kept[2] and 450 < len(kept[0]) < 750 and skewed.where("l").count() == sum(i % 40 == 0 for i in kept[0])


SPEC = """total-tiles: 2
tile-start: [0]
    tile-section: 1
    tile-mfov: 4
    tile-index: 7
    tile-bbox: [10][3138][-5][2719]
    tile-filepath: /a/b.bmp
tile-end: [0]
tile-start: [1]
    tile-section: 2
    tile-mfov: 1
    tile-index: 8
    tile-bbox: [0][3128][0][2724]
    tile-filepath: /a/c.bmp
tile-end: [1]
"""


def test_sources(spark, tmp_path):
    (tmp_path / "t.txt").write_text(SPEC)
    rows = [tuple(r) for r in tilespecs.read_text(spark, str(tmp_path / "t.txt")).orderBy("tile_ord").collect()]
    assert rows == [(0, 0, 4, 7, 10.0, 3138.0, -5.0, 2719.0, "/a/b.bmp"), (1, 1, 1, 8, 0.0, 3128.0, 0.0, 2724.0, "/a/c.bmp")]
    assert tilespecs.read_text(spark, str(tmp_path / "t.txt"), first=1, count=1).count() == 1
    (tmp_path / "j").mkdir()
    (tmp_path / "j/s.json").write_text(
        '[{"bbox":[5,15,7,17],"height":10,"width":10,"layer":3,"mfov":1,"tile_index":2,"mipmapLevels":{"0":{"imageUrl":"u"}},"transforms":[{"className":"x.AffineModel2D","dataString":"1 0 0 1 2 3"}]},'
        '{"bbox":[6,16,9,19],"height":10,"width":10,"layer":3,"mfov":2,"tile_index":3,"transforms":[{"className":"x.RigidModel2D","dataString":"0 4 5"}]}]'
    )
    tiles = tilespecs.read_json(spark, str(tmp_path / "j")).orderBy("tile_index").collect()
    assert [(t.x_start, t.y_finish, t.filepath, t.transform) for t in tiles] == [(0.0, 10.0, "u", [1.0, 0.0, 2.0, 0.0, 1.0, 3.0]), (1.0, 12.0, None, [1.0, 0.0, 4.0, 0.0, 1.0, 5.0])]
    assert tilespecs.read_json(spark, str(tmp_path / "j"), mfov=2).count() == 1
    (tmp_path / "c/d").mkdir(parents=True)
    (tmp_path / "c/d/image_coordinates.txt").write_text("000001\\002_000003_000004_x.bmp\t1.5\t2.5\t0\n")
    assert tuple(tilespecs.read_coordinates(spark, str(tmp_path / "c")).first())[:5] == (2, 3, 4, 1.5, 2.5)
    (tmp_path / "log.txt").write_text("12 bad size 30\nnothing\n")
    assert [tuple(r) for r in tilespecs.read_log(spark, str(tmp_path / "log.txt")).collect()] == [(12, 30)]
    assert one(spark, *tilespecs.named_box(F.lit("/s/10_20_30_40.png")))[:] == (10.0, 40.0, 20.0, 60.0)
    frame, _ = boxes(spark, 10)
    made = []
    path = str(tmp_path / "sections")
    for _ in range(2):
        got = tilespecs.cached_sections(spark, path, lambda: made.append(1) or frame)
        assert tilespecs.sections(got, 1, 1).count() == 5
    assert len(made) == 1


def test_transforms_default_to_identity(spark):
    frame, _ = boxes(spark, 4)
    m = spark.createDataFrame([(1, [2.0] * 6)], "section_id long, m array<double>")
    assert {r.section_id: r.m for r in tilespecs.with_transforms(frame, m).collect()} == {0: list(g.IDENTITY), 1: [2.0] * 6}


def test_nearest_two_of_one_key_by_groups_in_all_tasks(spark):
    """A key's rows are dealt out; vectors that aren't finite are left out, not their block."""
    draw = np.random.default_rng(8)
    v = draw.normal(size=(900, 6))
    odd = [(0, 5000, [float("nan")] * 6), (0, 5001, [float("inf")] * 6)]
    q = spark.createDataFrame([(0, i, v[i].tolist()) for i in range(300)] + odd, "k long, q long, v array<double>")
    c = spark.createDataFrame([(0, i, v[i].tolist()) for i in range(300, 900)] + odd, "k long, c long, v array<double>")
    found = matching.nearest_two(q, c, ["k"], block=64)
    d = np.sqrt(((v[:300, None] - v[None, 300:]) ** 2).sum(2))
    near = np.argsort(d, axis=1)[:, :2] + 300
    assert sorted((r["query"], r.c1, r.c2) for r in found.collect()) == [(i, *near[i].tolist()) for i in range(300)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_cb" in plan and "FlatMapCoGroupsInArrow" in plan  # block by block, whatever the key


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e4, 1e-3), (0.0, 1e12), (3e8, 1.0), (0.0, 1e-30)])
def test_two_of_block_is_exact_in_single_precision(shift, scale):
    draw = np.random.default_rng(11)
    q, c = (draw.integers(0, 5, (n, 4)) * scale + draw.normal(size=(n, 4)) * scale * 1e-6 + shift for n in (40, 130))
    ids = draw.permutation(130)
    at, got, d = matching._two_of_block(q, c, ids)
    exact = np.sqrt(((q[:, None] - c[None]) ** 2).sum(2))
    want = [(i, int(ids[j]), exact[i, j]) for i in range(40) for j in np.lexsort((ids, exact[i]))[:2]]
    assert list(zip(at.tolist(), got.tolist(), d.tolist())) == want


def test_a_section_takes_its_edges_batch_by_batch(spark, monkeypatch):
    """Over 8 million edges of one section used to need the joins of ``solve_distributed``; what a task holds of an edge is a place."""
    assert inspect.signature(graph.solve_positions).parameters["most_edges"].default > 8_683_360  # a section at 6 copies of sf0.1
    monkeypatch.setattr(graph, "solve_distributed", None)
    draw = np.random.default_rng(5)
    places = [(s, i, *map(float, draw.normal(0, 1000, 2))) for s in (0, 1, 2) for i in range(40)] + [(1, None, 3.0, 4.0)]
    pairs = [(s, i, j, float(draw.normal()), float(draw.normal())) for s in (0, 1) for i in range(40) for j in range(i) if draw.random() < 0.3] + [(1, 3, 99, 5.0, 5.0), (1, 98, 99, 5.0, 5.0), (1, None, 3, 5.0, 5.0)]
    tiles = spark.createDataFrame(places, "section_id long, tile_id int, x double, y float")
    edges = graph.symmetric(spark.createDataFrame(pairs, "section_id long, a long, b long, ideal_dx double, ideal_dy double"), ["section_id"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = graph.solve_positions(edges, tiles, ["section_id"])
        assert found.schema == tiles.schema
        got = {(r.section_id, r.tile_id): (r.x, r.y) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(places) and got[1, None] == (3.0, 4.0)
    for s in (0, 1, 2):
        own, x = [(i, j, u, v) for t, i, j, u, v in pairs if t == s and i is not None and max(i, j) < 40], np.array([p[2:] for p in places if p[0] == s and p[1] is not None])
        a, b = (np.array([e[k] for e in own] + [e[1 - k] for e in own], int) for k in (0, 1))
        ideal = np.array([e[2:] for e in own]).reshape(-1, 2)
        want = x + graph.solved_offsets(a, b, np.concatenate([ideal, -ideal]), x)
        assert np.allclose([got[s, i] for i in range(40)], want, atol=1e-3)


def test_relaxation_finds_edges_again_instead_of_joining_them(spark, sf_dir):
    """The edges of all tiles used to go through a shuffle by tile each step; now none leaves its task."""
    keys, edges = ["section_id"], graph.symmetric(lenses.edges(spark, sf_dir), ["section_id"])
    places = lenses.positions(spark, sf_dir)
    asked = []

    def again(now):
        asked.append(now)
        return graph.symmetric(lenses.edges(spark, sf_dir, now=now), keys, ends=("x", "y"))

    got, want = ({(r.section_id, r.tile_id): (r.x, r.y) for r in graph.relax(e, places, keys, 3).collect()} for e in (again, edges))
    assert len(asked) == 3 and got.keys() == want.keys()
    assert np.allclose([got[k] for k in want], list(want.values()), atol=1e-8)


def test_jiggle_writes_no_neighbours(spark, monkeypatch):
    """What is written is tiles, never pairs of them; sections take turns where they have many tiles at once."""
    made, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: made.append((name, df.count())) or plain(df, name))
    monkeypatch.setattr(graph, "shared_dir", None)  # pairs were written there
    draw = np.random.default_rng(3)
    rows = [(s, i, float(x), float(x + 100), float(y), float(y + 80)) for s in range(5) for i, (x, y) in enumerate(draw.integers(0, 120, (30, 2)))]
    frame = spark.createDataFrame(rows, "section_id long, tile_id long, x_start double, x_finish double, y_start double, y_finish double")
    whole = sorted(graph.jiggle(frame, ["section_id"], 20.0, allow_new=False, cell=150).collect())
    assert len(whole) == len(rows) and max(n for _, n in made) <= len(rows)
    assert sorted(graph.jiggle(frame, ["section_id"], 20.0, allow_new=False, cell=150, at_once=17, turns=30).collect()) == whole


def test_colours_by_place_are_those_of_the_edges(spark, sf_dir, monkeypatch):
    """No edge is written: tables are no longer than the tiles."""
    tiles = lenses.tiles(spark, sf_dir)
    want = sorted(graph.greedy_colours(lenses.edges(spark, sf_dir), ["section_id"]).collect())
    crowd = tiles.withColumns({x: F.col(x) / 5 + (2502.4 if x == "x_finish" else 2179.2 if x == "y_finish" else 0) for x in spatial.BOX})
    near = spatial.overlap_pairs(crowd, least=50, canonical=True).select("section_id", "a", "b")
    dense, edges = sorted(graph.greedy_colours(near, ["section_id"]).collect()), near.count()
    made, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: made.append(df.count()) or plain(df, name))
    monkeypatch.setattr(graph, "shared_dir", None)  # edges were written there
    got = queries.greedy_color(spark, sf_dir)
    assert sorted(got.collect()) == want and got.schema == graph.tile_colours(tiles.limit(0), ["section_id"], 50).schema
    assert sorted(graph.tile_colours(crowd, ["section_id"], 50, at_once=13, turns=40).collect()) == dense
    assert max(r.colour for r in dense) > 5 and max(made) <= tiles.count() < edges
