"""Where findings, scan history and registry snapshots are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift import schemas
from codesift.functions import patterns as P
from codesift.functions.text import strip
from codesift.operators.packages import fresh_registry


def export_findings(findings: DataFrame) -> DataFrame:
    """The twelve fields of the export, with the stripped line as ``code``."""
    return findings.select(
        "repo",
        F.col("path").alias("file"),
        F.col("line_no").alias("line"),
        "rule_id",
        "severity",
        "vuln_class",
        "title",
        "detail",
        "fix",
        strip(F.col("line")).alias("code"),
        "cwe",
        "owasp_category",
        "owasp_rank",
    )


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Write the export. Rows are not partitioned by repository, which would make millions of
    folders; readers prune on the sorted ``repo`` column instead."""
    export_findings(findings).sortWithinPartitions("repo", "file").write.format(fmt).mode(
        mode
    ).save(path)


def load_package_registry(
    spark: SparkSession, path: str, as_of: Column, max_age: int = P.REGISTRY_TTL_SECONDS
) -> DataFrame:
    """Registry snapshot without entries older than ``max_age`` seconds."""
    return fresh_registry(spark.read.schema(schemas.PACKAGE_REGISTRY).parquet(path), as_of, max_age)


def scan_log_rows(summary: DataFrame, ts: Column) -> DataFrame:
    """One history row per scanned repository."""
    return summary.select(
        "repo",
        F.col("total_findings").alias("findings"),
        F.col("files_scanned").alias("files"),
        ts.cast("timestamp").alias("ts"),
    )


def append_scan_log(summary: DataFrame, path: str, ts: Column, batch: int) -> None:
    """Append the scans of a batch. A batch that is repeated replaces what it wrote before, so it counts once.

    Each batch has a folder of its own: no other batch is read or written, and two may be written at the same time.
    """
    scan_log_rows(summary, ts).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def load_scan_log(spark: SparkSession, path: str) -> DataFrame:
    """All scans that were appended."""
    return spark.read.schema(f"{schemas.SCAN_LOG}, batch LONG").parquet(path).drop("batch")
