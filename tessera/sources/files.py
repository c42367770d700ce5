"""Files written and read whole: images, messages, and what else Spark has no format for.

``write_chunks`` is a sink with commit and abort: tasks write below a folder of the job's own, and
only what a finished job names gets its place, so a failed task or job leaves no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tessera.operators.raster import image_of


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are, and their names."""

    files: list[tuple[str, str]]


class ChunkWriter(DataSourceWriter):
    """Rows (name, ord, content), those of a file one after another: contents are appended."""

    def __init__(self, path: str):
        self.path, self.pending = path.rstrip("/"), f"_pending-{uuid.uuid4().hex}"

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator) -> Written:
        store, root = self._place()
        store.create_dir(f"{root}/{self.pending}")
        files, out, name = [], None, None
        try:
            for row in rows:
                if out is None or row["name"] != name:
                    if out is not None:
                        out.close()
                    name, part = row["name"], f"{root}/{self.pending}/{uuid.uuid4().hex}"
                    files.append((part, name))
                    out = store.open_output_stream(part)
                out.write(row["content"] or b"")
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, root = self._place()
        for message in messages:
            for part, name in message.files if message else []:
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                    store.delete_file(f"{root}/{name}")
                store.move(part, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, root = self._place()
        if store.get_file_info(f"{root}/{self.pending}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.pending}")


class Chunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_chunks"

    def writer(self, schema, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"])


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Files below ``path``, one for each ``name``: its ``content`` bytes in the order of ``ord``.  A file
    of that name is replaced; a job that fails leaves none."""
    spark = chunks.sparkSession
    spark.dataSource.register(Chunks)
    together = chunks.select("name", "ord", "content").repartition("name").sortWithinPartitions("name", "ord")
    together.write.format("tessera_chunks").mode("append").save(path)


def write_rasters(blocks: DataFrame, path: str, keys: Sequence[str] = ("section_id",)) -> None:
    """One grey-map file for each key (the keys joined by "_", .pgm) of rendered blocks (keys, bx,
    by, data, width).  Blocks that are not there are black.  A row of blocks is put together at a time, so
    no task holds a whole image."""
    names = list(keys)
    size = blocks.groupBy(*names).agg(*(f(c).alias(f"{n}_{c}") for c in ("bx", "by") for f, n in ((F.min, "lo"), (F.max, "hi"))), F.max("width").alias("block"))
    name = F.concat(F.concat_ws("_", *(F.col(k).cast("string") for k in names)), F.lit(".pgm"))
    wide, high = ((F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1) * F.col("block") for c in ("bx", "by"))
    head = size.select(name.alias("name"), F.lit(-1).cast("long").alias("ord"), F.format_string("P5\n%d %d\n255\n", wide, high).cast("binary").alias("content"))
    whole = size.withColumn("by", F.explode(F.sequence("lo_by", "hi_by"))).join(blocks.select(*names, "bx", "by", "data"), [*names, "by"], "left")
    rows = whole.select(name.alias("name"), (F.col("by") - F.col("lo_by")).cast("long").alias("ord"), (F.col("bx") - F.col("lo_bx")).alias("at"), (F.col("hi_bx") - F.col("lo_bx") + 1).alias("n"), "block", "data")

    def line(group: pa.Table) -> pa.Table:
        block, n = group.column("block")[0].as_py(), group.column("n")[0].as_py()
        out = np.zeros((block, n * block), np.uint8)
        for at, raw in zip(group.column("at").to_pylist(), group.column("data").to_pylist()):
            if raw is not None:
                out[:, at * block : (at + 1) * block] = image_of(raw, block)
        return pa.table({"name": group.column("name").slice(0, 1), "ord": group.column("ord").slice(0, 1), "content": pa.array([out.tobytes()], pa.binary())})

    write_chunks(head.unionByName(rows.groupBy("name", "ord").applyInArrow(line, "name string, ord long, content binary")), path)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Grey-map files: name (without the ending), data, width, height.  A file that is no grey map, or is
    shorter than it says, is refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").load(path).select(F.regexp_extract("path", r"([^/]*)\.pgm$", 1).alias("name"), "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, raw in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                head = raw.split(maxsplit=3)
                if len(head) < 4 or head[0] != b"P5" or not (head[1] + head[2]).isdigit() or head[3][:3] != b"255":
                    raise ValueError(f"{name} is no grey map")
                width, height = int(head[1]), int(head[2])
                at = raw.index(b"255", len(head[0]) + len(head[1]) + len(head[2])) + 4
                if len(raw) - at < width * height:
                    raise ValueError(f"{name} has {len(raw) - at} of {width * height} pixels")
                out.append((name, raw[at : at + width * height], width, height))
            types = (pa.string(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], names=["name", "data", "width", "height"])

    return files.mapInArrow(parse, "name string, data binary, width int, height int")
