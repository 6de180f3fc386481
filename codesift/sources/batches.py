"""Repository lists from numbered result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift import schemas


def load_repo_batches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(batch_no, position, owner, repo) from JSON files with a ``results`` array.

    The batch number of a row is the place of its file in ``paths``.
    """
    files = [  # one scan per file, so that equal base names in different folders stay apart
        spark.read.schema(schemas.REPO_BATCH_FILE).option("multiLine", "true").json(path)
        .select(F.lit(number).alias("batch_no"), "results")
        for number, path in enumerate(paths, start=1)
    ]
    rows = reduce(DataFrame.unionByName, files)
    return rows.select(
        "batch_no", F.posexplode("results").alias("position", "result")
    ).select("batch_no", "position", "result.owner", "result.repo")


def dedupe_repos(batches: DataFrame) -> DataFrame:
    """First occurrence of each ``owner/repo``, compared without case."""
    key = F.lower(F.concat_ws("/", "owner", "repo"))
    return (
        batches.groupBy(key.alias("repo_key"))
        .agg(F.min(F.struct("batch_no", "position", "owner", "repo")).alias("first"))
        .select("repo_key", "first.owner", "first.repo", "first.batch_no")
    )
