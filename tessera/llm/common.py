"""Shared pieces of the training-data operators: tables, written intermediates, text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.  Only a local session without
    one (tests) gets a temporary folder; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Paths of the tables that ``materialize`` writes while ``recorded`` is active.
_records: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts lineage and survives
    lost executors.  What is still there goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    for record in _records:
        record.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


@contextmanager
def recorded(record: list[str]) -> Iterator[None]:
    """Note the tables that are written meanwhile, for ``release``."""
    _records.append(record)
    try:
        yield
    finally:
        _records.remove(record)


def release(record: list[str], docs: DataFrame) -> None:
    """Delete the noted tables that ``docs`` doesn't read."""
    if record:
        read = docs.inputFiles()
        kept = [path for path in record if any(path.rsplit("/", 1)[-1] in file for file in read)]
        for path in record:
            if path not in kept:
                _delete(docs.sparkSession, path)
        record[:] = kept


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; a null counts as empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offs) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 4 << 20, max_rows: int = 4096):
    """Cut a record batch into runs of rows with about ``max_bytes`` of text (one row at least)."""
    _, offs = text_buffer(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + max_bytes, side="right")) - 1
        stop = max(start + 1, min(stop, start + max_rows, n))
        yield batch.slice(start, stop - start)
        start = stop


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
