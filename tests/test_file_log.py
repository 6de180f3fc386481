"""The log of landed files, reading by bytes, and files that vanish."""

import os

import pytest
from pyspark.sql import functions as F

from codesift.sources.file_log import FileLog
from codesift.sources.files import repo_listing, source_files, source_files_stream
from codesift.sources.tree import BYTES_PER_OPEN, packed, walk


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "repos"
    for path in ("one/a.py", "one/pkg/b.py", "two/c.js", "top.py", "one/readme.md"):
        _put(folder, path)
    return folder


def _put(folder, path, text="x = 1\n", age=None):
    target = folder / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    if age:
        stamp = target.stat().st_mtime - age
        os.utime(target, (stamp, stamp))


def _run(spark, root, tmp_path):
    """Everything the stream has written after another start with the same checkpoint."""
    out = str(tmp_path / "out")
    query = (
        source_files_stream(spark, str(root), str(tmp_path / "log"), settle_seconds=0)
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return sorted((r["repo"], r["path"], r["size_bytes"]) for r in spark.read.parquet(out).collect())


def test_late_renamed_and_top_files_are_read_once(spark, root, tmp_path):
    first = [("", "top.py", 6), ("one", "a.py", 6), ("one", "pkg/b.py", 6), ("two", "c.js", 6)]
    assert _run(spark, root, tmp_path) == first
    assert _run(spark, root, tmp_path) == first  # nothing new, nothing twice
    _put(root, "one/old.py", age=10**6)  # lands late, with an old time
    (root / "one" / "a.py").rename(root / "one" / "moved.py")
    _put(root, "two/c.js", "const a = 1;\n")  # written anew
    _put(root, "three/new.ts")
    expected = sorted([*first, ("one", "old.py", 6), ("one", "moved.py", 6), ("two", "c.js", 13), ("three", "new.ts", 6)])
    assert _run(spark, root, tmp_path) == expected
    assert _run(spark, root, tmp_path) == expected


def test_each_folder_is_listed_once(spark, root, tmp_path):
    listings = spark.sparkContext.accumulator(0)
    log = FileLog(spark, str(root), str(tmp_path / "log"))
    assert log.update(0, listings=listings) == 4
    assert listings.value == 4  # the root, one, one/pkg, two
    assert log.update(0, listings=listings) == 0
    assert listings.value == 8


def test_the_log_is_compacted_and_survives_broken_runs(spark, root, tmp_path):
    log = FileLog(spark, str(root), str(tmp_path / "log"), compact_every=2)
    for number in range(6):
        _put(root, f"one/n{number}.py")
        assert log.update(0) == (5 if number == 0 else 1)
        # What broken runs leave: entries without the mark of an ended job, and a table of which nothing is whole.
        (tmp_path / "log" / "entries" / f"{number:012d}" / "_SUCCESS").unlink()
        (tmp_path / "log" / "known" / "000000000099").mkdir(parents=True, exist_ok=True)
    assert log.logged().count() == 10 and log.update(0) == 0
    assert sorted(p.name for p in (tmp_path / "log" / "known").iterdir())[:-1] == ["000000000003", "000000000005"]


def test_files_being_written_are_left_to_the_next_listing(spark, root, tmp_path):
    log = FileLog(spark, str(root), str(tmp_path / "log"))
    _put(root, "one/done.py", age=7200)
    assert log.update(settle_seconds=3600) == 1
    assert log.update(settle_seconds=0) == 4


def test_packing_by_bytes(spark):
    sizes = [10**9] + [10**6] * 500 + [0] * 2000
    listing = spark.createDataFrame([(f"d/{n}.py", size) for n, size in enumerate(sizes)], "path string, length long")
    share = 10**8
    rows, tasks = packed(listing, bytes_per_task=share)
    load = {r["_task"]: (r["bytes"], r["largest"]) for r in rows.withColumn("b", F.col("length") + BYTES_PER_OPEN)
            .groupBy("_task").agg(F.sum("b").alias("bytes"), F.max("b").alias("largest")).collect()}
    assert max(load) < tasks and sum(b for b, _ in load.values()) == sum(sizes) + len(sizes) * BYTES_PER_OPEN
    assert all(b <= share + largest for b, largest in load.values()) and len(load) >= 6
    assert rows.repartitionById(tasks, F.col("_task")).rdd.getNumPartitions() == tasks
    empty, tasks = packed(listing.limit(0))
    assert tasks == 1 and empty.count() == 0


def test_a_file_that_vanishes_is_told_and_left_out(spark, root):
    listing = repo_listing(spark, str(root))
    listing.cache().count()
    (root / "one" / "a.py").unlink()
    assert sorted(r["path"] for r in source_files(spark, str(root), listing=listing).collect()) == [
        "c.js", "pkg/b.py", "top.py"]
    told = source_files(spark, str(root), listing=listing, problems=True).filter("problem IS NOT NULL").collect()
    assert [(r["repo"], r["path"], r["code"], r["problem"]) for r in told] == [("one", "a.py", None, "missing")]


def test_a_missing_root_is_empty(spark, tmp_path):
    assert walk(spark, str(tmp_path / "nowhere")).count() == 0
