"""One pass over the text: all that a scan needs to know of a file, as tagged rows.

A file gives one ``file`` row (size, and whether it has an auth word), a ``finding`` row for each finding of the line
rules and an ``import`` row for each import. They come from the same blocks of lines: a file is read and split once. The
rows, which hold no text but single lines, are stored, and all rules and reports that look beyond a file start from them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions import paths
from codesift.functions.text import split_lines
from codesift.operators.detectors.access import has_auth_words
from codesift.operators.engine import (
    Detector,
    file_flags,
    finding_columns,
    has_detector_words,
    interesting,
    is_skipped_path,
    line_blocks,
    own_lines,
    path_flags,
    report,
    shown_line,
)
from codesift.operators.packages import IMPORT_HINT, import_of, is_migration
from codesift.session import new_table_path

FILE, IMPORT, FINDING = "file", "import", "finding"
FACTS = (
    "repo STRING, path STRING, language STRING, size_bytes LONG, has_auth BOOLEAN, line_no INT, rule_id STRING, "
    "severity STRING, variant STRING, evidence STRING, line STRING, kind STRING"
)
RAW = ["repo", "path", "language", "line_no", "rule_id", "severity", "variant", "evidence", "line"]


def file_facts(
    files: DataFrame, detectors: Sequence[Detector], skip_minified: bool = True, denied_suffixes: Sequence[str] = (),
    policy: bool = True,
) -> DataFrame:
    """The facts of source files, without an exchange. Access findings are all there; reports keep a file's first.

    Files that no line rule reads (generated, vendored, denied, minified) have imports and a file row all the same;
    imports of migrations are left out.
    """
    before, after = max(d.before for d in detectors), max(d.after for d in detectors)
    code, path, at = F.col("code"), F.col("path"), F.col("at")
    ruled = has_detector_words(code, detectors)
    if skip_minified:
        ruled = ruled & ~is_skipped_path(path, denied_suffixes)
    imported = code.rlike(IMPORT_HINT) & ~is_migration(path)
    own = ["repo", "path", "language", "size_bytes"]
    if "size_bytes" not in files.columns:
        files = files.withColumn("size_bytes", F.octet_length("code").cast("long"))
    rows = files.select(*own, "code", ruled.alias("_ruled"), imported.alias("_imported"))
    rows = rows.select("*", F.when(F.col("_ruled") | F.col("_imported"), split_lines(code)).alias("lines"))
    if skip_minified:
        rows = rows.withColumn("_ruled", F.col("_ruled") & ~paths.has_long_line(F.col("lines")))
    flags = file_flags(detectors)
    rows = rows.select(
        *own, "lines", "_ruled", "_imported", has_auth_words(code).alias("has_auth"), *path_flags(),
        *[F.when(F.col("_ruled"), flag.column()).alias(name) for name, flag in flags.items()],
    )
    kept = [name for name in rows.columns if name != "lines"]
    wanted = (F.col("_ruled") | F.col("_imported")) & (F.size("lines") > 0)
    blocks = line_blocks(rows, kept, wanted, before, after).select(*kept, "block.*")
    is_first = F.col("low").isNull() | ((F.col("base") == 0) & (F.col("low") == 0))
    # A null line before the first stands for the file itself.
    lines = F.concat(
        F.when(is_first, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")),
        F.coalesce(own_lines(), F.array().cast("array<string>")),
    )
    hits = blocks.select("*", is_first.cast("int").alias("_head"), F.posexplode_outer(lines).alias("_k", "line"))
    text = F.col("line")
    hits = hits.filter(
        text.isNull() | (F.col("_ruled") & interesting(text, detectors)) | (F.col("_imported") & text.rlike(IMPORT_HINT))
    )
    place = F.when(text.isNull(), F.lit(-1)).otherwise(F.col("low") + F.col("_k") - F.col("_head"))
    hits = hits.select(*kept, "segment", "base", "line", place.alias("at")).select(
        *kept, "segment", "line", "at", F.when(at >= 0, F.col("base") + at + 1).alias("line_no")
    )
    findings, windows = finding_columns(files.sparkSession, detectors, policy)
    told = F.array(
        *[F.when((at >= 0) & F.col("_ruled"), finding) for finding in findings],
        F.when((at >= 0) & F.col("_imported"), _import_fact()),
        F.when(at < 0, report(FILE, "")),
    )
    facts = hits.select("*", *windows).select(*own, "has_auth", "line_no", "line", told.alias("told"))
    facts = facts.select(*own, "has_auth", "line_no", "line", F.explode_outer("told").alias("finding"))
    rule = F.col("finding.rule_id")
    return facts.filter(F.col("finding").isNotNull()).select(
        *own, "has_auth", "line_no", "finding.*", shown_line(detectors).alias("line"),
        F.when(rule.isin(FILE, IMPORT), rule).otherwise(F.lit(FINDING)).alias("kind"),
    )


def _import_fact() -> Column:
    found = import_of(F.col("line"), F.col("language"))
    return F.when(found.isNotNull(), report(IMPORT, "", found["ecosystem"], found["package"]))


@dataclass(frozen=True)
class Facts:
    """A table of facts (``FACTS``), read by kind."""

    table: DataFrame

    @property
    def files(self) -> DataFrame:
        return self.table.filter(F.col("kind") == FILE).select("repo", "path", "language", "size_bytes", "has_auth")

    @property
    def findings(self) -> DataFrame:
        return self.table.filter(F.col("kind") == FINDING).select(*RAW)

    @property
    def imports(self) -> DataFrame:
        return self.table.filter(F.col("kind") == IMPORT).select(
            "repo", "path", "language", F.col("variant").alias("ecosystem"), F.col("evidence").alias("package"),
            "line_no", "line",
        )

    @property
    def auth_repos(self) -> DataFrame:
        """Repositories in which any file has an auth word."""
        return self.files.filter("has_auth").select("repo").distinct()


def read_facts(spark: SparkSession, *folders: str) -> Facts:
    return Facts(spark.read.schema(FACTS).parquet(*folders))


def stored_facts(facts: DataFrame, folder: str | None = None) -> Facts:
    """Facts written once, by kind, to the cluster's shared folder (or ``folder``) and read from there."""
    folder = folder or new_table_path(facts.sparkSession, "facts")
    facts.write.mode("overwrite").partitionBy("kind").parquet(folder)
    return read_facts(facts.sparkSession, folder)
