"""Aggregations over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.functions import patterns as P


def severity_view(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity") == severity)


def scan_summary(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """Counts per repository; ``scope`` brings files_scanned and truncated, also for clean ones."""
    counts = findings.groupBy("repo").agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")],
    )
    return scope.join(counts, "repo", "left").na.fill(
        0, ["total_findings", "high", "medium", "low"]
    ).select("repo", "files_scanned", "total_findings", "high", "medium", "low", "truncated")


def scope_of(files: DataFrame) -> DataFrame:
    """Scope of files that were all read: (repo, files_scanned, truncated)."""
    return files.groupBy("repo").agg(F.count("*").alias("files_scanned"), F.lit(False).alias("truncated"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts per repository and severity with sub-totals."""
    return findings.rollup("repo", "severity").agg(F.count("*").alias("findings"))


def severity_gate(findings: DataFrame, scope: DataFrame) -> DataFrame:
    """Exit code per repository: 1 with any high finding, else 0."""
    high = findings.groupBy("repo").agg(
        F.max(F.when(F.col("severity") == "high", 1).otherwise(0)).alias("exit_code")
    )
    return scope.select("repo").join(high, "repo", "left").na.fill(0, ["exit_code"])


def files_with_findings(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo", "path").agg(F.count("*").alias("findings"))


def nested_results(findings: DataFrame) -> DataFrame:
    """One row per file with its findings as an ordered array."""
    entry = F.struct("sev_rank", "line_no", "rule_seq", "rule_id", "severity", "line")
    return findings.groupBy("repo", "path", "language").agg(
        F.sort_array(F.collect_list(entry)).alias("findings")
    )


def fleet_report(findings: DataFrame, attempted: DataFrame) -> DataFrame:
    """One row about all repositories; ``attempted`` has ``repo`` and ``scanned``.

    Percentages are of the scanned repositories, rounded half up to one place,
    and 0 when none was scanned.
    """
    per_repo = findings.groupBy("repo").agg(
        F.bool_or(F.col("severity") == "high").alias("has_high"),
        F.bool_or(F.col("severity") == "medium").alias("has_medium"),
    )
    scanned = F.col("scanned")

    def percent(condition):
        share = F.count_if(scanned & condition) * 100 / F.nullif(F.count_if(scanned), F.lit(0))
        return F.coalesce(F.round(share, 1), F.lit(0.0))

    return attempted.join(per_repo, "repo", "left").agg(
        F.count("*").alias("total_repos_attempted"),
        F.count_if(scanned).alias("total_scanned"),
        F.count_if(~scanned).alias("failed_to_reclone"),
        percent(F.col("has_high")).alias("pct_high"),
        percent(F.col("has_medium")).alias("pct_medium"),
        percent(F.col("has_high").isNull()).alias("pct_clean"),
    )


def top_rules(findings: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent rules, ties by rule."""
    return (
        findings.groupBy("rule_id")
        .agg(F.count("*").alias("findings"))
        .orderBy(F.desc("findings"), "rule_id")
        .limit(k)
    )


def scan_totals(scan_log: DataFrame) -> DataFrame:
    return scan_log.agg(F.count("*").alias("total_scans"))


def recent_scans(
    scan_log: DataFrame, stored: int = P.RECENT_SCANS_STORED, shown: int = P.RECENT_SCANS_SHOWN
) -> DataFrame:
    """The newest scans, ties by repository."""
    return scan_log.orderBy(F.desc("ts"), "repo").limit(min(stored, shown))


def scan_log_rollup(scan_log: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Scans and findings per time bucket; works on a stream as well."""
    return (
        scan_log.groupBy(F.window("ts", bucket).alias("bucket"))
        .agg(
            F.count("*").alias("scans"),
            F.sum("findings").alias("findings"),
            F.sum("files").alias("files"),
        )
        .select(F.col("bucket.start").alias("bucket_start"), "scans", "findings", "files")
    )


def regression_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Multiset difference on (repo, rule_id, severity): what is missing and what is new."""
    keys = ["repo", "rule_id", "severity"]
    counted = actual.select(*keys, F.lit(1).alias("n")).unionByName(
        expected.select(*keys, F.lit(-1).alias("n"))
    )
    return (
        counted.groupBy(*keys)
        .agg(F.sum("n").alias("surplus"))
        .filter("surplus <> 0")
        .select(
            *keys,
            F.when(F.col("surplus") > 0, "unexpected").otherwise("missing").alias("kind"),
            F.abs("surplus").alias("findings"),
        )
    )


def rule_evaluation(
    findings: DataFrame, cases: DataFrame, max_fp_rate: float = 0.10, min_cases: int = 10,
    min_repos: int = 20,
) -> DataFrame:
    """Hits, false alarms and misses per rule over labelled cases.

    ``cases`` has ``repo, path, rule_id, expect_fire``, one row per case.
    """
    fired = findings.select("repo", "path", "rule_id").distinct().withColumn("fired", F.lit(True))
    judged = cases.join(fired, ["repo", "path", "rule_id"], "left").withColumn(
        "fired", F.coalesce("fired", F.lit(False))
    )
    counted = judged.groupBy("rule_id").agg(
        F.count("*").alias("cases"),
        F.countDistinct("repo").alias("repos"),
        F.count_if(F.col("fired") & F.col("expect_fire")).alias("true_positives"),
        F.count_if(F.col("fired") & ~F.col("expect_fire")).alias("false_positives"),
        F.count_if(~F.col("fired") & F.col("expect_fire")).alias("false_negatives"),
    )
    raised = F.col("true_positives") + F.col("false_positives")
    rate = F.when(raised > 0, F.col("false_positives") / raised).otherwise(F.lit(0.0))
    return counted.withColumn("fp_rate", F.round(rate, 4)).withColumn(
        "accepted",
        (rate < max_fp_rate) & (F.col("cases") >= min_cases) & (F.col("repos") >= min_repos),
    )
