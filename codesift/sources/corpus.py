"""A code corpus that grows with the ``part`` table: every part key becomes one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions import paths
from codesift.sources.cases import cases
from codesift.sources.files import spread

GHOSTS = 97
REGISTRY_AS_OF = "2024-01-02 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _snippets(spark: SparkSession) -> DataFrame:
    rows = [(c["number"], c["case_id"], c["repo_kind"], c["path"], c["code"]) for c in cases()]
    return spark.createDataFrame(
        rows, "number INT, case_id STRING, repo_kind STRING, path STRING, code STRING"
    )


def _with_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys joined to the fixed snippet table (a few dozen kilobytes, so broadcast)."""
    number = (F.col("p_partkey") % len(cases())).cast("int").alias("number")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_size", number)
    # Each key stands for a whole file, so even a small key table is spread before it grows.
    parts = spread(parts, "p_partkey")
    joined = parts.join(F.broadcast(_snippets(spark)), "number")

    def filled(name: str):
        keyed = F.replace(F.col(name), F.lit("{key}"), F.col("p_partkey").cast("string"))
        ghost = (F.col("p_partkey") % GHOSTS).cast("string")
        return F.replace(keyed, F.lit("{ghost}"), ghost).alias(name)

    return joined.select(
        F.concat("repo_kind", F.col("p_size").cast("string")).alias("repo"),
        filled("path"), filled("code"), "case_id", "p_partkey", "p_size",
    )


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-file rows."""
    return _with_case(spark, sf_dir).select(
        "repo",
        "path",
        paths.language_of(F.col("path")).alias("language"),
        F.octet_length("code").cast("long").alias("size_bytes"),
        "code",
    )


def code_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as three batches that land one after the other (``batch``); the last empties some files of the first."""
    rows = _with_case(spark, sf_dir).select(
        "repo", "path", paths.language_of(F.col("path")).alias("language"),
        F.octet_length("code").cast("long").alias("size_bytes"), "code", "p_partkey",
    )
    key = F.col("p_partkey")
    emptied = rows.filter(key % 6 == 0).withColumn("code", F.lit("")).withColumn("size_bytes", F.lit(0).cast("long"))
    return rows.withColumn("batch", (key % 3).cast("int")).unionByName(emptied.withColumn("batch", F.lit(2))).drop("p_partkey")


def expected_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, rule_id, severity, line_no) the cases promise for the corpus."""
    rows = [
        (c["case_id"], rule, severity, line)
        for c in cases() for rule, severity, line in c["expected"]
    ]
    promised = spark.createDataFrame(
        rows, "case_id STRING, rule_id STRING, severity STRING, line_no INT"
    )
    return _with_case(spark, sf_dir).join(F.broadcast(promised), "case_id").select(
        "repo", "path", "rule_id", "severity", "line_no"
    )


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, rule_id, expect_fire): each file judged by the rule its case is about."""
    rows = [
        (c["case_id"], c["case_id"].split("-")[0].upper(),
         any(rule == c["case_id"].split("-")[0].upper() for rule, _, _ in c["expected"]))
        for c in cases() if c["case_id"][1:4].isdigit()
    ]
    labels = spark.createDataFrame(rows, "case_id STRING, rule_id STRING, expect_fire BOOLEAN")
    return _with_case(spark, sf_dir).join(F.broadcast(labels), "case_id").select(
        "repo", "path", "rule_id", "expect_fire"
    )


def code_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the corpus plus project files of some of its repositories."""
    rows = _with_case(spark, sf_dir)
    extra = F.array_compact(
        F.array(
            F.when(F.col("p_size") % 2 == 0, F.lit("site/core/settings.py")),
            F.when(F.col("p_size") % 3 != 0, F.lit("package.json")),
            F.lit("site/core/localmod.py"),
            F.lit("ghost_3/core.py"),
        )
    )
    repos = rows.select("repo", "p_size").distinct()
    return rows.select("repo", "path").unionByName(
        repos.select("repo", F.explode(extra).alias("path"))
    ).withColumn("is_dir", F.lit(False))


def package_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry answers derived from part keys, several ages per package."""
    key = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        F.when(key % 2 == 0, "pypi").otherwise("npm").alias("ecosystem"),
        F.concat(F.lit("ghost_"), (key % GHOSTS).cast("string")).alias("name"),
        (key % 3 != 0).alias("exists"),
        F.timestamp_add("HOUR", -(key % 30).cast("int"), F.lit(REGISTRY_AS_OF).cast("timestamp")).alias(
            "checked_at"
        ),
    )


def large_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, size_bytes) of few, large repositories made of order lines: a third of all rows in one of them,
    skipped folders, other suffixes, and sizes on both sides of the limit."""
    key = F.col("l_orderkey")
    folder = F.element_at(
        F.array(*[F.lit(name) for name in ("src", "venv", "lib", "app/vendor", "app", "web")]), (key % 6 + 1).cast("int")
    )
    suffix = F.element_at(
        F.array(*[F.lit(name) for name in (".py", ".js", ".PY", ".md", ".ts")]), (F.col("l_linenumber") % 5 + 1).cast("int")
    )
    return _table(spark, sf_dir, "lineitem").select(
        F.when(key % 3 == 0, F.lit("mono")).otherwise(F.concat(F.lit("r"), (key % 4).cast("string"))).alias("repo"),
        F.concat(folder, F.lit("/f"), key.cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), suffix).alias("path"),
        ((F.col("l_partkey") * 131) % 260_000).cast("long").alias("size_bytes"),
    ).groupBy("repo", "path").agg(F.max("size_bytes").alias("size_bytes"))


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan history derived from the event stream: one scan per event."""
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("repo"), (F.col("user_id") % 50).cast("string")).alias("repo"),
        (F.col("event_id") % 7).alias("findings"),
        (F.col("event_id") % 300).alias("files"),
        "ts",
    )
