"""M7 as state: outcomes of settings, merged into a stored table batch by batch.

A batch is summed by setting and joined to the latest version; sums are exact decimals, so any split
of the outcomes into batches gives the same table.  A version is written whole before it counts, and
the one before it stays until then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.tables import delete

#: Fixed value: trials that a setting needs before another can take its place.
ENOUGH = 200
#: Versions that stay.
KEPT = 2
SUMS = ("trials", "successes", "cost_sum", "cost_squares")


def summed(outcomes: DataFrame, keys: Sequence[str], success, cost) -> DataFrame:
    """Sums of a batch of outcomes by setting: keys and ``SUMS``; costs count in millionths.  A null cost
    counts as none, a null success as a failure."""
    c = F.coalesce(F.col(cost) if isinstance(cost, str) else cost, F.lit(0)).cast("decimal(18,6)")
    s = F.coalesce((F.col(success) if isinstance(success, str) else success).cast("boolean"), F.lit(False)).cast("long")
    return outcomes.groupBy(*keys).agg(F.count("*").alias("trials"), F.sum(s).alias("successes"), F.sum(c).cast("decimal(38,6)").alias("cost_sum"), F.sum((c * c).cast("decimal(38,12)")).cast("decimal(38,12)").alias("cost_squares"))


def merged(state: DataFrame | None, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state with a batch's sums: keys, ``SUMS``, pruned.  A pruned setting stays pruned."""
    fresh = batch.withColumn("pruned", F.lit(False))
    if state is None:
        return fresh
    both = state.select(*keys, *SUMS, "pruned").unionByName(fresh)
    types = {f.name: f.dataType for f in fresh.schema}
    return both.groupBy(*keys).agg(*(F.sum(c).cast(types[c]).alias(c) for c in SUMS), F.max("pruned").alias("pruned"))


def statistics(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, mean cost and its sample deviation of the settings that aren't pruned."""
    n, s, q = F.col("trials").cast("double"), F.col("cost_sum").cast("double"), F.col("cost_squares").cast("double")
    deviation = F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1)))
    return state.where(~F.col("pruned")).select(*keys, "trials", (F.col("successes") / n).alias("accuracy"), (s / n).alias("cost"), deviation.alias("cost_std"))


def pruned_one(state: DataFrame, keys: Sequence[str], enough: int = ENOUGH) -> DataFrame:
    """The state with one setting pruned: the first (by ``keys``) of ``enough`` trials that another of as
    many is at least as accurate as, and as cheap; none, if there is no such.  Of two alike the first goes.

    Settings in falling accuracy, rising cost: one is beaten if any before it costs no more.  The window
    spans the settings (hundreds), never the outcomes."""
    stats = statistics(state, keys).where(F.col("trials") >= enough)
    order = Window.orderBy(F.desc("accuracy"), "cost", *(F.desc(k) for k in keys)).rowsBetween(Window.unboundedPreceding, -1)
    beaten = stats.withColumn("least", F.min("cost").over(order)).where(F.col("least") <= F.col("cost"))
    gone = beaten.orderBy(*keys).limit(1).select(*keys, F.lit(True).alias("_gone"))
    return state.join(gone, list(keys), "left").withColumn("pruned", F.col("pruned") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole, in order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    found = []
    for status in store.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("version-") and store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.removeprefix("version-")))
    return sorted(found)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version, None if there is none."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/version-{found[-1]}") if found else None


def stored(state: DataFrame, path: str) -> DataFrame:
    """The state as the next version; older ones than the last ``KEPT`` go."""
    spark = state.sparkSession
    found = versions(spark, path)
    number = found[-1] + 1 if found else 1
    state.write.mode("overwrite").parquet(f"{path}/version-{number}")
    delete(spark, *(f"{path}/version-{v}" for v in found[: 1 - KEPT]))
    return spark.read.parquet(f"{path}/version-{number}")


def upsert(outcomes: DataFrame, path: str, keys: Sequence[str], success, cost) -> DataFrame:
    """A batch of outcomes merged into the table at ``path``."""
    return stored(merged(current(outcomes.sparkSession, path), summed(outcomes, keys, success, cost), keys), path)
