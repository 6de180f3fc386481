"""A durable log of the files that were found below a root: what was listed, kept as tables on a shared folder.

A file stream that goes by modification times loses files that arrive with an older one. Here every listing is compared
with all that was logged before, and what is new (by path, length and time) is written as the next batch of entries. The
entries are a table that grows by whole files, so a stream over them reads each file once, whatever its time, and a
restarted stream goes on where its checkpoint ends.

``<folder>/entries/<batch>`` holds the entries, ``<folder>/known/<batch>`` now and then all entries up to a batch in one
table, so that the comparison reads few files. Entries that a broken run left behind count as logged: they are whole
files, and the stream has seen them or will.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codesift.functions import paths
from codesift.session import new_table_path
from codesift.sources.tree import BYTES_PER_TASK, _opened, packed, walk

ENTRY = "path STRING, length LONG, modified LONG, task INT"
_KEYS = ["path", "length", "modified"]
#: Reading tasks whose entries share a file of the log.
_TASKS_PER_FILE = 64


@dataclass(frozen=True)
class FileLog:
    """The log of one root. One process at a time may update it; any number may read it."""

    spark: SparkSession
    root: str
    folder: str
    compact_every: int = 20
    bytes_per_task: int = BYTES_PER_TASK

    @property
    def entries(self) -> str:
        return f"{self.folder}/entries"

    def create(self) -> None:
        system, base = _opened(self.folder)
        system.create_dir(f"{base}/entries", recursive=True)

    def update(
        self, settle_seconds: float = 60, skip_dirs: Sequence[str] = (), listings: Accumulator | None = None
    ) -> int:
        """List the root once, each folder by one task, and log the source files that are new; how many there were.

        A file that was written within the last ``settle_seconds`` is left to the next update. One that was written
        anew, or that has another name, is new.
        """
        self.create()
        settled = time.time_ns() - int(settle_seconds * 1e9)
        listed = walk(self.spark, self.root, skip_dirs, listings).filter(
            ~F.col("is_dir") & (F.col("modified") <= settled) & paths.language_of(F.col("path")).isNotNull()
        )
        found = listed.select(*_KEYS).join(self.logged(), _KEYS, "left_anti")
        path = new_table_path(self.spark, "new-files")  # read for the sums and for the rows
        found.write.parquet(path)
        found = self.spark.read.schema(found.schema).parquet(path)
        count = found.count()
        if count:
            rows, tasks = packed(found, bytes_per_task=self.bytes_per_task)
            rows = rows.withColumnRenamed("_task", "task")
            batch = max(self._batches("entries"), default=-1) + 1
            files = math.ceil(tasks / _TASKS_PER_FILE)
            rows.repartitionByRange(files, "task").write.parquet(f"{self.entries}/{batch:012d}")
            self._compact()
        return count

    def logged(self) -> DataFrame:
        """(path, length, modified) of everything logged so far, each once."""
        since, tables = -1, []
        for number in sorted(self._batches("known", whole=True), reverse=True)[:1]:
            since = number
            tables.append(self.spark.read.schema(ENTRY).parquet(f"{self.folder}/known/{number:012d}"))
        later = [f"{self.entries}/{number:012d}" for number in sorted(self._batches("entries")) if number > since]
        if later:
            tables.append(self.spark.read.schema(ENTRY).parquet(*later))
        if not tables:
            return self.spark.createDataFrame([], ENTRY).select(*_KEYS)
        whole = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
        return whole.select(*_KEYS)

    def _batches(self, name: str, whole: bool = False) -> list[int]:
        """Numbers of the tables under a name; ``whole`` ones only where their job has ended."""
        system, base = _opened(self.folder)
        listed = system.get_file_info(fs.FileSelector(f"{base}/{name}", allow_not_found=True))
        numbers = [int(entry.base_name) for entry in listed if entry.base_name.isdigit()]
        if not whole:
            return numbers
        return [
            number for number in numbers
            if system.get_file_info(f"{base}/{name}/{number:012d}/_SUCCESS").type == fs.FileType.File
        ]

    def _compact(self) -> None:
        """Write all that is logged as one table once enough batches have come, and remove the tables before the last."""
        batches, known = self._batches("entries"), sorted(self._batches("known", whole=True))
        last = max(batches)
        if last - (known[-1] if known else -1) < self.compact_every:
            return
        # Of entries that a broken run and its successor both hold, one.
        everything = self.logged().withColumn("task", F.lit(0))
        everything.write.mode("overwrite").parquet(f"{self.folder}/known/{last:012d}")
        system, base = _opened(self.folder)
        for number in known[:-1]:
            system.delete_dir(f"{base}/known/{number:012d}")

    def stream(self, files_per_trigger: int = 16) -> DataFrame:
        """The entries as they are logged; a trigger takes at most so many files of the log."""
        self.create()
        return (
            self.spark.readStream.schema(ENTRY).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", files_per_trigger).parquet(self.entries)
        )

    def follow(self, query: StreamingQuery, every_seconds: float = 60, settle_seconds: float = 60) -> None:
        """Update the log until a query over it ends."""
        while not query.awaitTermination(every_seconds):
            self.update(settle_seconds)
