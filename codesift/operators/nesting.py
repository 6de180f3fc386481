"""Nearest marked directory above others, by paths in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_marked(dirs: DataFrame, marks: DataFrame, levels: int) -> DataFrame:
    """(repo, dir, root): the nearest of ``marks`` (repo, ancestor) at or above each of ``dirs`` (repo, dir).

    The directory itself counts as the first of ``levels``; directories without a mark so near are left out. In order of
    their paths, what lies below a directory follows it without a gap, so marked directories are nested intervals: a task
    streams through its rows with the open ones on a stack. No directory is taken apart into its parents. A repository is
    split by its top folders; a mark at its root, which stands above all of them, is joined by itself.
    """
    key = F.concat("dir", F.lit("/"))
    rows = dirs.select("repo", "dir", F.lit(False).alias("marks")).unionByName(
        marks.select("repo", F.col("ancestor").alias("dir"), F.lit(True).alias("marks"))
    ).filter("dir <> ''")
    in_order = (
        rows.withColumn("key", key)
        .repartition("repo", F.substring_index("dir", "/", 1))
        .sortWithinPartitions("repo", "key", F.desc("marks"))
    )

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, open_marks = None, []
        for batch in batches:
            roots = []
            for own, path, marked in zip(batch["repo"], batch["key"], batch["marks"], strict=True):
                if own != repo:
                    repo, open_marks = own, []
                while open_marks and not path.startswith(open_marks[-1]):
                    open_marks.pop()
                if marked:
                    open_marks.append(path)
                near = open_marks and path.count("/") - open_marks[-1].count("/") < levels
                roots.append(open_marks[-1][:-1] if near else None)
            yield batch.assign(root=roots)[~batch["marks"]][["repo", "dir", "root"]]

    below = in_order.mapInPandas(matched, "repo string, dir string, root string")
    top = dirs.filter("dir = ''").select("repo", "dir", F.lit(None).cast("string").alias("root"))
    at_root = marks.filter("ancestor = ''").select("repo", F.lit("").alias("_root")).distinct()
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))
    near_root = F.when(depth < levels, F.col("_root"))
    return (
        below.unionByName(top).join(at_root, "repo", "left")
        .select("repo", "dir", F.coalesce("root", near_root).alias("root"))
        .filter("root IS NOT NULL")
    )
