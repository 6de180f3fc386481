"""Directory trees, hidden names included, as tables.

Spark's file readers leave out names that begin with ``_`` or ``.``, and source trees are full of them
(``__init__.py``, ``_app.tsx``, ``.github``). Here tasks list folders and read files through ``pyarrow.fs``, which knows
local, HDFS, S3 and GCS paths; no listing passes through the driver.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesift.functions import paths
from codesift.session import new_table_path

#: ``modified`` is in nanoseconds since 1970.
ENTRIES = "path STRING, is_dir BOOLEAN, is_link BOOLEAN, length LONG, modified LONG"
BYTES_PER_TASK = 128 * 1024 * 1024
#: What opening a file costs, in bytes that could be read meanwhile.
BYTES_PER_OPEN = 64 * 1024
#: Rows whose sizes are added up side by side before the parts are put one after the other.
PACKING_BUCKETS = 4096
_BATCH_ROWS = 10_000
_BATCH_BYTES = 16 * 1024 * 1024


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the root's path on it."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = root.removeprefix("file:")
    system, base = fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    return system, base.rstrip("/")


def _children(system: fs.FileSystem, base: str, folder: str) -> Iterator[tuple[str, bool, bool, fs.FileInfo]]:
    """(path below the root, is a folder, is a link, details) of what lies in one folder."""
    where = f"{base}/{folder}" if folder else base
    for entry in system.get_file_info(fs.FileSelector(where, allow_not_found=True)):
        if entry.type == fs.FileType.NotFound:  # a link to nothing
            continue
        path = f"{folder}/{entry.base_name}" if folder else entry.base_name
        link = system.type_name == "local" and os.path.islink(entry.path)
        yield path, entry.type == fs.FileType.Directory, link, entry


def _text(system: fs.FileSystem, base: str, path: str) -> tuple[str | None, str | None]:
    """A file as UTF-8 text without the bytes that are not, or why there is none.

    Files that are gone or may not be read are told; other errors end the task, which Spark runs again.
    """
    try:
        with system.open_input_stream(f"{base}/{path}", compression=None) as stream:
            return stream.read().decode("utf-8", errors="ignore"), None
    except FileNotFoundError:
        return None, "missing"
    except PermissionError:
        return None, "denied"


def walk(
    spark: SparkSession, root: str, skip_dirs: Sequence[str] = (), listings: Accumulator | None = None
) -> DataFrame:
    """Every file and folder below ``root``. One job per level of depth, folders spread over the tasks.

    Each level is a table on the shared folder, so a lost executor costs no more than its own folders. Links to folders
    and folders named in ``skip_dirs`` are listed and not entered. A file that vanishes while the walk runs may or may not
    be listed. ``listings`` counts the folders that were listed.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(root)
        names = ["path", "is_dir", "is_link", "length", "modified"]
        rows: list[tuple[str, bool, bool, int, int]] = []
        for batch in batches:
            for folder in batch["path"]:
                if listings is not None:
                    listings.add(1)
                for path, is_dir, link, entry in _children(system, base, folder):
                    rows.append((path, is_dir, link, entry.size or 0, entry.mtime_ns or 0))
                    if len(rows) == _BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    target = new_table_path(spark, "tree")
    tasks = 4 * spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([("",)], "path STRING")
    levels: list[str] = []
    while not folders.isEmpty():
        levels.append(f"{target}/{len(levels)}")
        spread = folders if len(levels) == 1 else folders.repartition(tasks)
        spread.mapInPandas(listed, ENTRIES).write.parquet(levels[-1])
        found = spark.read.schema(ENTRIES).parquet(levels[-1]).filter("is_dir AND NOT is_link")
        folders = found.filter(~paths.file_name(F.col("path")).isin(list(skip_dirs))).select("path")
    return spark.read.schema(ENTRIES).parquet(*levels)


def packed(
    listing: DataFrame, path_col: str = "path", size_col: str = "length", bytes_per_task: int = BYTES_PER_TASK
) -> tuple[DataFrame, int]:
    """``listing`` with the number of a task per row (``_task``), and how many tasks there are.

    Rows are laid end to end by their bytes and cut every ``bytes_per_task``, so no task gets more than that and the file
    it begins with. Sizes are added up within a fixed number of buckets of paths, then over the buckets; only sums leave
    the executors, one row for each bucket.
    """
    bucket = F.pmod(F.xxhash64(path_col), F.lit(PACKING_BUCKETS))
    weighed = listing.withColumn("_bytes", F.col(size_col) + F.lit(BYTES_PER_OPEN)).withColumn("_bucket", bucket)
    sums = weighed.groupBy("_bucket").agg(F.sum("_bytes").alias("_sum"))  # at most PACKING_BUCKETS rows
    before = F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")
    offsets = sums.select("_bucket", before.alias("_before"))
    total = sums.agg(F.sum("_sum")).first()[0] or 0
    tasks = max(1, math.ceil(total / bytes_per_task))
    in_bucket = F.sum("_bytes").over(Window.partitionBy("_bucket").orderBy(path_col, size_col)) - F.col("_bytes")
    placed = weighed.withColumn("_within", in_bucket).join(F.broadcast(offsets), "_bucket")
    task = F.floor((F.col("_before") + F.col("_within")) / bytes_per_task).cast("int")
    return placed.select(*listing.columns, task.alias("_task")), tasks


def read_texts(rows: DataFrame, root: str, path_col: str = "path") -> DataFrame:
    """``rows`` with the ``code`` of each file, or null and the ``problem`` (missing, denied)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(root)
        for batch in batches:
            start, held = 0, 0
            texts: list[tuple[str | None, str | None]] = []
            for at, path in enumerate(batch[path_col]):
                texts.append(_text(system, base, path))
                held += len(texts[-1][0] or "")
                if held >= _BATCH_BYTES or at + 1 == len(batch):
                    code, problem = zip(*texts, strict=True)
                    yield batch.iloc[start : at + 1].assign(code=code, problem=problem)
                    start, texts, held = at + 1, [], 0

    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema)
    return rows.mapInPandas(read, f"{fields}, code STRING, problem STRING")


def with_text(
    chosen: DataFrame, root: str, path_col: str = "path", size_col: str = "length",
    bytes_per_task: int = BYTES_PER_TASK,
) -> DataFrame:
    """``chosen`` (a listing) with the ``code`` and ``problem`` of each file; nothing else is opened.

    Small listings get smaller tasks, so that all cores read.
    """
    cores = chosen.sparkSession.sparkContext.defaultParallelism
    total, files = chosen.agg(F.sum(size_col), F.count("*")).first()
    share = math.ceil(((total or 0) + files * BYTES_PER_OPEN) / (2 * cores))
    rows, tasks = packed(chosen, path_col, size_col, max(1, min(bytes_per_task, share)))
    return read_texts(rows.repartitionById(tasks, F.col("_task")).drop("_task"), root, path_col)


def write_tree(files: DataFrame, root: str) -> None:
    """Write the ``code`` of each row (path, code) as a file below ``root``. A repeated task writes the same again."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(root)
        for batch in batches:
            for path, code in zip(batch["path"], batch["code"], strict=True):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target, compression=None) as stream:
                    stream.write(code.encode("utf-8"))
            yield pd.DataFrame({"files": [len(batch)]})

    files.select("path", "code").mapInPandas(write, "files long").agg(F.sum("files")).collect()
