"""Scanning files as they land, and publishing what changes.

Most findings depend on their own file only and are published with it. Access findings and unknown packages depend on the
other files of their repository: an auth word or a settings module that lands later changes findings that were published,
or were not. So these few rows are kept as state, in buckets of repositories, and a batch looks again at the repositories
it touches and at no others: it publishes the difference between what their files say with the batch and without it.

Every table has a folder for each batch, which a repeated batch writes anew from the batches before it; so a change is
published once, whatever fails.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from codesift.operators.catalog import attach_metadata
from codesift.operators.detectors import DETECTORS
from codesift.operators.engine import detect
from codesift.operators.facts import RAW, Facts, file_facts, stored_facts
from codesift.operators.packages import drop_aliased, missing_imports, unknown_imports
from codesift.operators.repo_rules import (
    ACCESS,
    first_access_finding_per_file,
    lower_django_routes,
)
from codesift.session import written_table

#: Repositories are dealt into so many folders of state.
BUCKETS = 64
_RAW = (
    "repo STRING, path STRING, language STRING, line_no INT, rule_id STRING, severity STRING, variant STRING, "
    "evidence STRING, line STRING"
)
CHANGES = f"{_RAW}, op INT, batch LONG"
_PLACE = "bucket INT, batch LONG"
_STATE = {
    "files": f"repo STRING, path STRING, language STRING, size_bytes LONG, has_auth BOOLEAN, {_PLACE}",
    "findings": f"{_RAW}, {_PLACE}",
    "imports": (
        "repo STRING, path STRING, language STRING, ecosystem STRING, package STRING, line_no INT, line STRING, "
        f"{_PLACE}"
    ),
}


def findings_stream(files: DataFrame) -> DataFrame:
    """Findings of the per-file rules. They keep no state, so this is a plain projection.

    A file may have several access findings here; ``scan_stream`` keeps the first.
    """
    return detect(files, list(DETECTORS.values()))


def scan_stream(
    files: DataFrame, folder: str, registry: DataFrame | None = None, listing: DataFrame | None = None
) -> DataStreamWriter:
    """Publish the changes of each batch of files below ``folder``; ``published_findings`` adds them up.

    A file that lands again replaces its earlier version. Without a registry packages are not checked. Without a listing
    (repo, path, is_dir) the paths that have landed stand for it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        publish_batch(batch, batch_id, folder, registry, listing)

    return files.writeStream.foreachBatch(write)


def publish_batch(
    batch: DataFrame, batch_id: int, folder: str, registry: DataFrame | None = None, listing: DataFrame | None = None
) -> None:
    """Write the facts of a batch, its state, and what it changes in the published findings.

    The text is read once. Besides the batch, work grows with the state of the repositories that it touches.
    """
    spark = batch.sparkSession
    facts = stored_facts(file_facts(batch, list(DETECTORS.values())), f"{folder}/facts/batch={batch_id}")
    own = {
        "files": facts.files,
        "findings": first_access_finding_per_file(facts.findings),
        "imports": _watched_imports(facts, registry),
    }
    for name, rows in own.items():
        placed = rows.withColumn("bucket", _bucket()).withColumn("batch", F.lit(batch_id))
        (
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch").parquet(f"{folder}/state/{name}")
        )
    repos = written_table(facts.files.select("repo").distinct(), "repos-of-batch")
    buckets = [row["bucket"] for row in repos.select(_bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS

    def state(name: str) -> DataFrame:
        whole = spark.read.schema(_STATE[name]).parquet(f"{folder}/state/{name}")
        near = whole.filter(F.col("bucket").isin(buckets) & (F.col("batch") <= batch_id))
        return near.join(repos, "repo", "left_semi")

    versions = written_table(
        state("files").withColumn("latest", F.max("batch").over(Window.partitionBy("repo", "path"))).withColumn(
            "earlier", F.max(F.when(F.col("batch") < batch_id, F.col("batch"))).over(Window.partitionBy("repo", "path"))
        ), "versions",
    )
    replaced = versions.filter((F.col("latest") == batch_id) & (F.col("batch") == F.col("earlier")))
    gone = state("findings").filter(F.col("rule_id") != ACCESS).join(
        replaced.select("repo", "path", "batch"), ["repo", "path", "batch"], "left_semi"
    )
    added = own["findings"].filter(F.col("rule_id") != ACCESS)
    views = []
    for sign, version in ((1, "latest"), (-1, "earlier")):
        files = versions.filter(F.col("batch") == F.col(version))
        chosen = files.select("repo", "path", "batch")
        access = state("findings").filter(F.col("rule_id") == ACCESS).join(chosen, ["repo", "path", "batch"], "left_semi")
        imports = state("imports").join(chosen, ["repo", "path", "batch"], "left_semi").drop("bucket", "batch")
        view = repository_view(access.select(*RAW), imports, files, registry, listing)
        views.append(view.withColumn("op", F.lit(sign)))
    of_repos = (
        views[0].unionByName(views[1]).groupBy(*RAW).agg(F.sum("op").cast("int").alias("op")).filter("op <> 0")
    )
    changes = (
        added.select(*RAW, F.lit(1).alias("op")).unionByName(gone.select(*RAW, F.lit(-1).alias("op")))
        .unionByName(of_repos)
    )
    changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")


def _bucket():
    return F.pmod(F.xxhash64("repo"), F.lit(BUCKETS)).cast("int")


def _watched_imports(facts: Facts, registry: DataFrame | None) -> DataFrame:
    """Imports that may be unknown packages: of them only those the registry calls absent."""
    imports = facts.imports
    return imports.limit(0) if registry is None else drop_aliased(missing_imports(imports, registry))


def repository_view(
    access: DataFrame, imports: DataFrame, files: DataFrame, registry: DataFrame | None, listing: DataFrame | None = None
) -> DataFrame:
    """The findings that the rules across files give for these access findings, imports and files."""
    if listing is None:
        listing = files.select("repo", "path", F.lit(False).alias("is_dir"))
    auth = files.filter("has_auth").select("repo").distinct()
    found = lower_django_routes(written_table(access, "access"), listing).join(auth, "repo", "left_semi")
    if registry is not None:
        found = found.unionByName(unknown_imports(imports, registry, listing))
    return found.select(*RAW)


def changes(spark: SparkSession, folder: str, batches: Sequence[int] = ()) -> DataFrame:
    """What batches changed in the published findings: ``op`` is 1 for a new one, -1 for one taken back."""
    log = spark.read.schema(CHANGES).parquet(f"{folder}/changes")
    return log.filter(F.col("batch").isin(list(batches))) if batches else log


def published_findings(spark: SparkSession, folder: str) -> DataFrame:
    """What ``scan`` finds in the files that have landed so far under the directory profile's repository rules."""
    left = changes(spark, folder).groupBy(*RAW).agg(F.sum("op").alias("n")).filter("n > 0")
    return attach_metadata(left.select(*RAW, F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select(*RAW))
