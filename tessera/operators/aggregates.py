"""Aggregations: extents, histograms, confusion counts, sweeps, running statistics, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators.spatial import BOX


def extent(tiles: DataFrame, keys: Sequence[str] = (), *, bad: str | None = None, first_id: str | None = None) -> DataFrame:
    """A1, A2: bounding box of the tiles of each key, bad ones left out.

    ``first_id`` gives the compatible form: if the tile of least id is bad, the box also holds
    the origin.
    """
    good = ~F.col(bad) if bad else F.lit(True)
    box = [F.min(F.when(good, F.col(BOX[0]))), F.max(F.when(good, F.col(BOX[1]))), F.min(F.when(good, F.col(BOX[2]))), F.max(F.when(good, F.col(BOX[3])))]
    named = [e.alias(c) for e, c in zip(box, BOX)]
    if first_id is None or bad is None:
        return tiles.groupBy(*keys).agg(*named)
    out = tiles.groupBy(*keys).agg(*named, F.min_by(F.col(bad), first_id).alias("seed"))
    fix = {c: F.when(F.col("seed"), (F.least if i % 2 == 0 else F.greatest)(F.lit(0.0), F.col(c))).otherwise(F.col(c)) for i, c in enumerate(BOX)}
    return out.withColumns(fix).drop("seed")


def histogram(df: DataFrame, bucket: Column, most: int, *, dense: bool = False, rows: str | None = None) -> DataFrame:
    """Rows by integer bucket, the last one open; ``dense`` also has the empty buckets
    below the largest; ``rows`` is the column of how many a row stands for.  Returns bucket, n."""
    counts = df.groupBy(F.least(bucket.cast("int"), F.lit(most)).alias("bucket")).agg((F.sum(rows) if rows else F.count("*")).alias("n"))
    counts = counts.where("n <> 0") if rows else counts
    if not dense:
        return counts
    top = counts.agg(F.max("bucket").alias("top"))
    steps = top.select(F.explode(F.sequence(F.lit(0), "top")).alias("bucket"))
    return steps.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion(df: DataFrame, predicted: Column, actual: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts tp, tn, fp, fn."""
    kinds = {"tp": predicted & actual, "tn": ~predicted & ~actual, "fp": predicted & ~actual, "fn": ~predicted & actual}
    return df.groupBy(*keys).agg(*(F.count_if(c).alias(k) for k, c in kinds.items()))


def cutoff_sweep(df: DataFrame, score: Column, actual: Column, cutoffs: Sequence[float]) -> DataFrame:
    """Confusion counts and accuracy for each cutoff (predicted: score at the cutoff or
    over).  Rows are counted between cutoffs first; running sums over these few give the rest."""
    at = F.lit(0)
    for c in cutoffs:
        at = at + (score >= c).cast("int")
    counted = df.groupBy(at.alias("passed")).agg(F.count_if(actual).alias("p"), F.count_if(~actual).alias("n"))
    steps = df.sparkSession.createDataFrame([(i + 1, float(c)) for i, c in enumerate(sorted(cutoffs))], "step int, cutoff double")
    over = F.col("passed") >= F.col("step")
    out = steps.join(F.broadcast(counted), how="cross").groupBy("step", "cutoff")  # both as many rows as there are cutoffs
    out = out.agg(*(F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).alias(k) for k, c, v in (("tp", over, "p"), ("fp", over, "n"), ("fn", ~over, "p"), ("tn", ~over, "n"))))
    return out.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).drop("step")


def threshold_counts(df: DataFrame, value: Column, keys: Sequence[str], thresholds: Sequence[float] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Rows over each threshold, by key."""
    return df.groupBy(*keys).agg(*(F.count_if(value > t).alias(f"over_{t:g}") for t in thresholds))


def running_totals(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Totals up to each row; for reports with a row for each section."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"total_{c}": F.sum(c).over(w) for c in columns})


def largest_error(edges: DataFrame, keys: Sequence[str], error: str, *, over: float = 1.0, bad: str | None = None) -> DataFrame:
    """Largest error over ``over`` of each tile's edges, zero if none; bad tiles left out."""
    use = edges if bad is None else edges.where(~F.col(bad))
    return use.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(error) > over, F.col(error))), F.lit(0.0)).alias("max_error"))


def success_statistics(df: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """Share of successes and its sample deviation; every trial is a batch of its own."""
    return running_statistics(df.withColumn("_ok", ok.cast("double")), keys, "_ok").withColumnsRenamed({"n": "trials", "mean": "accuracy"})


def setting_table(sweep: DataFrame, keys: Sequence[str], correct: str, time: str, trials: int = 1000) -> DataFrame:
    """Accuracy (correct answers of ``trials``) and cost (mean time) of each setting."""
    out = sweep.groupBy(*keys).agg(F.sum(correct).alias("correct"), F.avg(time).alias("cost"))
    return out.withColumn("accuracy", F.col("correct") / trials)


def running_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean and sample deviation, as an online update would give them."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def radius_filter(tiles: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """Tiles whose centre is nearer than ``radius`` to the mean centre of their key."""
    cx, cy = g.centre(*BOX)
    own = tiles.withColumns({"centre_x": cx, "centre_y": cy})
    mean = own.groupBy(*keys).agg(F.avg("centre_x").alias("mean_x"), F.avg("centre_y").alias("mean_y"))
    joined = own.join(mean, list(keys))
    return joined.where(g.distance("centre_x", "centre_y", "mean_x", "mean_y") < radius)


def compared(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows joined by key, with the differences d_<column>."""
    other = right.select(*keys, *(F.col(c).alias(f"other_{c}") for c in columns))
    return left.join(other, list(keys)).withColumns({f"d_{c}": F.col(c) - F.col(f"other_{c}") for c in columns})


def difference_report(compared_rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Number, largest difference, sum and sum of squares over the columns."""
    d = [F.col(f"d_{c}") for c in columns]
    total = sum((F.abs(x) for x in d[1:]), F.abs(d[0]))
    squares = sum((x * x for x in d[1:]), d[0] * d[0])
    largest = F.greatest(*(F.abs(x) for x in d)) if len(d) > 1 else F.abs(d[0])
    return compared_rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(largest).alias("largest"), F.sum(total).alias("total"), F.sum(squares).alias("squares"))


def balanced(df: DataFrame, label: Column, ratio: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """If one class has over ``ratio`` times the rows of the other, drop rows of it by a draw
    over their ``keys`` until the ratio is met on average."""
    n = df.agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n")).first()
    few, many = sorted((n.p, n.n))
    if not few or many <= ratio * few:
        return df
    major = label if n.p > n.n else ~label
    return df.where(~major | (g.draw(seed, *keys) >= (many - ratio * few + 1) / many))


def informative(df: DataFrame, label: Column, error: str, sigmas: float = 2.0) -> DataFrame:
    """Positives, and negatives whose error is over mean + ``sigmas`` deviations."""
    limit = df.agg((F.avg(error) + sigmas * F.stddev_samp(error)).alias("limit"))
    return df.join(F.broadcast(limit), how="cross").where(label | (F.col(error) > F.col("limit"))).drop("limit")  # one row
