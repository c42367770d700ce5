"""Pairs of dense tiles: dealt out before they are made, and joined with nothing afterwards."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import graph, raster, spatial
from tessera.operators.spatial import BOX
from tessera.plans import lenses as ls
from tessera.plans.registry import load

KEYS = ["section_id"]


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_cells_are_not_merged_by_bytes(spark, sf_dir):
    tiles = ls.tiles(spark, sf_dir).coalesce(1)
    assert spatial.overlap_pairs(tiles).select(F.spark_partition_id().alias("p")).distinct().count() > 2


#: The joins that make pairs, and those of tiles by their keys.
MOST = {"close_tiles_with_self": 1, "edge_symmetrize": 2, "either_direction_semi": 2, "failed_neighbors_anti": 1, "graph_energy": 2, "incident_bad_edges": 2, "neighbor_success": 2, "overlap_keypoints": 3, "alignment_compare_hist": 6}


@pytest.mark.parametrize("name", sorted(MOST))
def test_pairs_are_joined_with_nothing(spark, sf_dir, name):
    assert joins(load()[0][name](spark, sf_dir)) <= MOST[name]


def test_bad_tiles_by_flags_found_again(spark, sf_dir):
    tiles = ls.tiles(spark, sf_dir)
    edges = graph.with_deviation(graph.symmetric(ls.edges(spark, sf_dir, carry=True), KEYS, ends=("x", "y")))

    def flagged(one):
        return spatial.overlap_pairs(tiles.join(one, ["section_id", "tile_id"]), least=g.MIN_OVERLAP, carry=["own"]).select("section_id", "a", F.col("b_own").alias("other"))

    want = sorted(graph.mark_bad(edges, KEYS, 11).collect())
    assert sorted(graph.mark_bad(edges, KEYS, 11, flagged=flagged).collect()) == want and len({r.bad for r in want}) == 2


def test_points_carried_with_pairs(spark, sf_dir):
    t = ls.tiles(spark, sf_dir)
    points = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("section_id", "tile_id", (F.col("x_start") + F.col("i") * 900).alias("x"), (F.col("y_start") + F.col("i") * 800).alias("y"))
    own = points.groupBy("section_id", "tile_id").agg(F.collect_list(F.struct("x", "y")).alias("points"))
    pairs = spatial.overlap_pairs(t.join(own, ["section_id", "tile_id"]), canonical=True, carry=["points"])
    want = raster.in_padded_overlap(points, pairs, KEYS).groupBy("section_id", "a", "b").agg(F.count("*").alias("n"))
    assert sorted(raster.count_in_padded_overlap(pairs, KEYS).collect()) == sorted(want.collect()) and want.count() > 0


def test_pairs_of_uneven_boxes_by_brute_force(spark):
    boxes = [(i, float(i * 7919 % 9000 - 3000), float(i * 104729 % 7000 - 2000), 10.0 + i * 37 % 4000, 10.0 + i * 53 % 3000) for i in range(120)]
    tiles = spark.createDataFrame([(0, i, x, x + w, y, y + h) for i, x, y, w, h in boxes], "section_id long, tile_id long, x_start double, x_finish double, y_start double, y_finish double")
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] != b[0] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]}
    for cell in (500, 3000, 20_000):
        met = [tuple(r) for r in spatial.overlap_pairs(tiles, cell=cell).select("a", "b").collect()]
        assert len(met) == len(want) and set(met) == want
        a, b = spatial.sides()
        some = spatial.with_any(tiles, tiles, KEYS, cell, g.overlaps(a, b) & (F.col("a.tile_id") != F.col("b.tile_id")))
        assert some.columns == tiles.columns and {r.tile_id for r in some.collect()} == {a for a, _ in want}


def test_cross_groups_make_no_pairs(spark, sf_dir):
    plan = load()[0]["cross_group_overlap"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and joins(load()[0]["cross_group_overlap"](spark, sf_dir)) == 1


def test_whole_coordinates_are_cut_before_tiles_meet(spark, sf_dir):
    plan = spatial.overlap_pairs(ls.tiles(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    met = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "_whole_x_start" in met and "cast(" not in met.lower() and "floor" not in met.lower()


@pytest.mark.parametrize("n", [0, 7, 8, 9, 23])
def test_few_and_many_points_carried_with_pairs(spark, sf_dir, n):
    t = ls.tiles(spark, sf_dir)
    own = t.select("section_id", "tile_id", F.transform(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda i: F.struct((F.col("x_start") + i * 200).alias("x"), (F.col("y_start") + i * 170).alias("y"))).alias("points"))
    pairs = spatial.overlap_pairs(t.join(own, ["section_id", "tile_id"]), canonical=True, carry=["points"])
    points = own.select("section_id", "tile_id", F.inline("points"))
    want = raster.in_padded_overlap(points, pairs, KEYS).groupBy("section_id", "a", "b").agg(F.count("*").alias("n"))
    assert sorted(raster.count_in_padded_overlap(pairs, KEYS).collect()) == sorted(want.collect()) and bool(want.count()) == bool(n)


def test_points_of_pairs_are_counted_by_batches(spark, sf_dir):
    plan = load()[0]["overlap_keypoints"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "filter(" not in plan


def test_boxes_meet_by_their_roles(spark, sf_dir):
    """Only the owner cell's boxes meet, and a canonical pair is found one way."""
    t = ls.tiles(spark, sf_dir)
    plan = spatial.overlap_pairs(t, canonical=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "_role" in next(line for line in plan.splitlines() if "Join Inner" in line)
    both = spatial.overlap_pairs(t, carry=["bad"]).where("b < a")
    once = spatial.overlap_pairs(t, canonical=True, carry=["bad"])
    assert once.columns == both.columns and sorted(once.collect()) == sorted(both.collect()) and once.count() > 0


def test_ordered_pairs_of_uneven_boxes_by_brute_force(spark):
    boxes = [(i * 31 % 97, float(i * 7919 % 9000 - 3000), float(i * 104729 % 7000 - 2000), 10.0 + i * 37 % 4000, 10.0 + i * 53 % 3000) for i in range(120)]  # some ids repeat
    tiles = spark.createDataFrame([(0, i, x, x + w, y, y + h) for i, x, y, w, h in boxes], "section_id long, tile_id long, x_start double, x_finish double, y_start double, y_finish double")
    want = sorted((a[0], b[0], a[1], b[1]) for a in boxes for b in boxes if b[0] < a[0] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4])
    for cell in (500, 3000, 20_000):
        met = spatial.overlap_pairs(tiles, cell=cell, canonical=True)
        assert sorted((r.a, r.b, r.a_x_start, r.b_x_start) for r in met.collect()) == want


def test_pair_features_by_columns(spark, sf_dir):
    plan = load()[0]["pair_features"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array(" not in plan


def test_pairs_counted_by_distinct_boxes(spark):
    rows = [(i % 2, None if i % 29 == 0 else i * 7 % 61, float(i % 9 * 700), float(i % 9 * 700 + 1500), float(i % 5 * 600), float(i % 5 * 600 + 900)) for i in range(160)]  # boxes and ids repeat
    rows += [(0, 900, 1.0, 1.5, 1.0, 2.5), (0, 901, 1.0, 1.5, 1.0, 2.5)]  # nothing is left when cut
    tiles = spark.createDataFrame(rows, "section_id long, tile_id long, x_start double, x_finish double, y_start double, y_finish double")

    def counts(pairs, n):
        boxes = [F.array_sort(F.array(*(F.struct(*(F.col(f"{s}_{c}").alias(c) for c in spatial.BOX)) for s in "ab"))).alias("boxes")]
        return sorted(map(str, pairs.groupBy("section_id", *boxes).agg(F.sum(n).alias("n")).where("n <> 0").collect()))

    want = counts(spatial.overlap_pairs(tiles, canonical=True), F.lit(1))
    assert counts(spatial.overlap_counts(tiles), F.col("n")) == want and len(want) > 9


def test_copies_of_tiles_make_no_more_pairs(spark, sf_dir):
    t = ls.tiles(spark, sf_dir)
    many = t.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("tile_id", F.col("tile_id") * 10 + F.col("k"))
    one, five = (spatial.overlap_counts(x).where("a_x_start <> b_x_start") for x in (t, many))
    assert five.count() == one.count() > 0 and five.agg(F.sum("n")).first()[0] == 25 * one.agg(F.sum("n")).first()[0]


def test_draws_are_a_column_of_their_own(spark, sf_dir):
    plan = load()[0]["sampled_pairs"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    sort = next(line for line in plan.splitlines() if "Sort " in line)
    assert "md5" not in sort and "conv(" not in plan


def test_feature_numbers_of_a_tile_are_computed_for_tiles(spark, sf_dir):
    plan = load()[0]["feature_vectors"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()[0]
    assert "array(" not in plan.split("Join")[0] and "round(response_a" not in top and top.count("round(") <= 6 * 2


def test_whole_numbers_are_rounded_as_they_are(spark):
    values = [0.0, -0.0, 1.0, -3.0, 0.1234565, -2.5000005, 1e18, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(g.rounded("v", 6).alias("a"), F.round("v", 6).alias("b"))
    assert [str(r.a) for r in df.collect()] == [str(r.b) for r in df.collect()] or all(r.a == r.b or str(r.a) == str(r.b) for r in df.collect())


def test_compare_alignments_groups_tiles_of_one_box_that_moved_alike(spark):
    """pairs of groups, not of tiles; the counts are those of a loop over all pairs of tiles."""
    from tessera.plans.pipelines import _moved_groups, compare_alignments

    rng = random.Random(3)
    first, second = [], []
    for i in range(240):
        x, y = (rng.randrange(4) * 2100, rng.randrange(3) * 2700) if i % 3 else (rng.randrange(7000), rng.randrange(7000))
        dx, dy = (rng.randrange(-40, 41), rng.randrange(-40, 41)) if i % 5 else (rng.randrange(-3000, 3000), rng.randrange(-3000, 3000))
        key = (i % 2, i if i != 7 else 9)  # two tiles of one id are no pair
        first.append((*key, float(x), float(x + 3128), float(y), float(y + 2724), i % 11 == 0))
        second.append((*key, float(x + dx), float(x + dx + 3128), float(y + dy), float(y + dy + 2724), False))
    schema = "section_id long, tile_id long, x_start double, x_finish double, y_start double, y_finish double, bad boolean"
    one, two = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    joined = [(a[:2], a[2:6], b[2:6]) for a in first if not a[6] for b in second if a[:2] == b[:2]]

    def over(a, b):
        w, h = min(a[1], b[1]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[2], b[2])
        return w > 0 and h > 0 and w * h / (2 * 3128 * 2724) > 0.008

    want = Counter()
    for n, (ka, a, oa) in enumerate(joined):
        for kb, b, ob in joined[:n]:
            if ka[0] == kb[0] and ka != kb and (over(a, b) or over(oa, ob)):
                moved = math.hypot((oa[0] - ob[0]) - (a[0] - b[0]), (oa[2] - ob[2]) - (a[2] - b[2]))
                want[ka[0], min(int(moved), 999)] += 1
    got = {(r.section_id, r.bucket): r.n for r in compare_alignments(one, two).collect()}
    assert got == dict(want)
    alike = one.limit(1).crossJoin(spark.range(500)).select("section_id", *BOX, *((F.col(c) + F.col("id") % 9).alias(f"o_{c}") for c in BOX))
    assert [(r.n, len(r.moves)) for r in _moved_groups(alike, [f"o_{c}" for c in BOX]).selectExpr("aggregate(at, 0L, (s, o) -> s + o.n) n", "moves").collect()] == [(500, 9)]
