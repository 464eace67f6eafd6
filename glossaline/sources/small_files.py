"""Folders of very many small files: read in few tasks of about equal weight, written one file per row.

A scan of one file per task spends its time on starting tasks, and a listing by the driver with one
split per file on planning them.  Here tasks list the folders, level by level, and files are packed into a stated
number of partitions by their size; the driver knows the partitions, not the files.  Conditions on the path leave files unread.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from ..plans.scan import scan
from ..session import materialize, new_shared_path

NAME = "small_files"
OPENING = 1 << 16  # bytes that opening a file weighs as much as reading
CHUNK = 1 << 23  # bytes of a batch handed on
FEW = 10_000  # files that the driver may pack by itself
LISTED_ROWS = 10_000  # entries of a batch handed on


def _files(uri: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def packed(files: list[tuple[str, int]], partitions: int) -> list[list[str]]:
    """Files in at most so many partitions: the heaviest first, each to the lightest partition so far."""
    bins = [(0, i, []) for i in range(max(1, min(partitions, len(files))))]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        weight, i, held = heapq.heappop(bins)
        held.append(path)
        heapq.heappush(bins, (weight + size + OPENING, i, held))
    return [held for _, _, held in sorted(bins, key=lambda b: b[1])]


def _entries(files, folder: str) -> Iterator[tuple[str, int | None]]:
    """(path, size) of a folder's files and folders; folders have no size.  A folder that is gone has none."""
    import pyarrow.fs as fs

    if isinstance(files, fs.LocalFileSystem):
        # One after the other: a folder may hold millions.
        try:
            with os.scandir(folder) as found:
                for entry in found:
                    if entry.is_dir():
                        yield entry.path, None
                    elif entry.is_file():
                        yield entry.path, entry.stat().st_size
        except FileNotFoundError:
            return
    else:
        for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if i.type in (fs.FileType.Directory, fs.FileType.File):
                yield i.path, None if i.type == fs.FileType.Directory else i.size


def list_files(spark: SparkSession, uri: str, name: str = "") -> DataFrame:
    """(path, size) of all files below a folder, or of those of one name.  Each level of folders is dealt to tasks, which list them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        files, _ = _files(uri)
        rows: list[tuple[str, int | None]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["path", "size"])

        for given in batches:
            for folder in given.column(0):
                for path, size in _entries(files, folder.as_py()):
                    if size is None or not name or path.rsplit("/", 1)[-1] == name:
                        rows.append((path, size))
                    if len(rows) >= LISTED_ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    level = spark.createDataFrame([(_files(uri)[1].rstrip("/") or "/",)], "path string")
    found = spark.createDataFrame([], "path string, size bigint")
    tasks = 4 * spark.sparkContext.defaultParallelism
    while folders := level.count():
        held = materialize(level.repartition(min(tasks, folders)).mapInArrow(run, "path string, size bigint"), "listed")
        found = found.unionByName(held.filter("size IS NOT NULL"))
        level = held.filter("size IS NULL").select("path")
    return found


def pack_files(found: DataFrame, partitions: int) -> str:
    """Write the files (path, size) packed into partitions of about equal weight; returns the folder, which holds ``bin=k`` for each.

    Few files are packed by the driver, the heaviest first.  Of more, each gets its place by the weight of those before it, in
    an order that has nothing to do with folders, so that conditions on the path leave the partitions even.
    """
    spark = found.sparkSession
    weight = F.col("size") + OPENING
    count, total = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    if count <= FEW:
        bins = packed([(r.path, r.size) for r in found.collect()], partitions)
        placed = spark.createDataFrame([(i, path) for i, held in enumerate(bins) for path in held], "bin int, path string")
    else:
        weighed = found.select("path", weight.alias("_weight"), F.xxhash64("path").alias("_order"))
        placed = scan(
            weighed, [], ["_order", "path"], ["_upto"], lambda rows, before, same: {"_upto": rows["_weight"].to_numpy(np.int64)}, ["_weight"]
        ).select(F.floor((F.col("_upto") - F.col("_weight")) / total * partitions).cast("int").alias("bin"), "path")
    folder = new_shared_path(spark, "packed-files")
    placed.write.partitionBy("bin").parquet(folder)
    return folder


class Packed(InputPartition):
    """Files of a partition, as the folder of their paths."""

    def __init__(self, folder: str | None) -> None:
        self.folder = folder


class SmallFilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.packed = options["path"], options["packed"]
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, path: str) -> bool:
        tests = {
            EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value),
            StringEndsWith: lambda f: path.endswith(f.value), StringContains: lambda f: f.value in path,
        }
        return all(tests[type(f)](f) for f in self.filters)

    def paths(self, folder: str) -> Iterator[str]:
        """Wanted paths of a partition, one after the other."""
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        files, _ = _files(self.packed)
        for i in files.get_file_info(fs.FileSelector(folder)):
            if i.path.endswith(".parquet"):
                with files.open_input_file(i.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(columns=["path"]):
                        yield from filter(self.wanted, batch.column(0).to_pylist())

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as fs

        files, folder = _files(self.packed)
        bins = [i.path for i in files.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.Directory and i.base_name.startswith("bin=")]
        held = sorted(path for path in bins if not self.filters or next(self.paths(path), None) is not None)
        return [Packed(path) for path in held] or [Packed(None)]

    def read(self, partition: Packed) -> Iterator:
        import pyarrow as pa

        files, _ = _files(self.root)

        def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([len(c) for _, c in rows], pa.int64()), pa.array([c for _, c in rows], pa.binary())], ["path", "length", "content"])

        rows, held = [], 0
        for path in self.paths(partition.folder) if partition.folder else ():
            with files.open_input_file(path) as f:
                rows.append((path, f.read()))
            held += len(rows[-1][1]) + len(path)
            if held >= CHUNK:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


class SmallFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path STRING, length BIGINT, content BINARY"

    def reader(self, schema) -> DataSourceReader:
        return SmallFilesReader(self.options)


def read_files(spark: SparkSession, path: str, name: str = "", partitions: int | None = None) -> DataFrame:
    """(path, length, content) of all files below a folder, or of those of one name, as they are listed now; conditions on ``path`` are met before reading."""
    spark.dataSource.register(SmallFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    count = partitions or 4 * spark.sparkContext.defaultParallelism
    return spark.read.format(NAME).option("packed", pack_files(list_files(spark, path, name), count)).load(path)


def write_files(df: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """Write each row's text as a UTF-8 file of its own, with ``\\n`` line ends; folders are made.  Returns the number of files.

    A task that runs again writes the same files again.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        files, base = _files(root)
        for batch in batches:
            for where, content in zip(batch["path"], batch["text"]):
                target = f"{base}/{where}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(target) as f:
                    f.write(content.encode("utf-8", "replace"))
            yield pd.DataFrame({"n": [len(batch)]})

    done = df.select(F.col(path).alias("path"), plain.alias("text")).mapInPandas(write, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
