"""Rules that look beyond one line: first route per file, repository auth, project settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions import paths
from codesift.functions import patterns as P
from codesift.operators.detectors.access import has_auth_words
from codesift.operators.nesting import nearest_marked


ACCESS = "A001"


def is_access() -> Column:
    return F.col("rule_id") == ACCESS


def first_of_each_file(access: DataFrame) -> DataFrame:
    """The first row of each file, by partial aggregation: of a task's part of a file one row is shuffled."""
    names = [name for name in access.columns if name not in ("repo", "path")]
    return (
        access.groupBy("repo", "path").agg(F.min_by(F.struct(*names), "line_no").alias("first"))
        .select("repo", "path", "first.*").select(*access.columns)
    )


def first_access_finding_per_file(findings: DataFrame) -> DataFrame:
    """Keep every other finding and the first A001 of each file. Only access findings are shuffled.

    ``findings`` is read twice, so it should be a table.
    """
    return findings.filter(~is_access()).unionByName(first_of_each_file(findings.filter(is_access())))


def repos_with_auth(files: DataFrame) -> DataFrame:
    """Repositories in which any file has an auth word (partial aggregation per task)."""
    return files.filter(has_auth_words(F.col("code"))).select("repo").distinct()


def drop_access_findings_without_auth(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Drop A001 in repositories where no file has an auth word.

    A left join on a flag table with one row per repository: small tables are
    broadcast by size, large ones shuffle with the skew join splitting hot repositories.
    """
    return drop_access_findings_outside(findings, repos_with_auth(files))


def drop_access_findings_outside(findings: DataFrame, auth_repos: DataFrame) -> DataFrame:
    """Drop A001 in repositories that ``auth_repos`` (one row each) does not name. Only A001 is joined."""
    access = findings.filter(is_access()).join(auth_repos, "repo", "left_semi")
    return findings.filter(~is_access()).unionByName(access.select(*findings.columns))


def settings_roots(listing: DataFrame) -> DataFrame:
    """Directories from which a settings module is visible: beside, or one visible child below."""
    path = F.col("path")
    holder = F.when(
        path.rlike(r"(?:^|/)settings\.py$"), paths.directory_of(path)
    ).when(
        path.rlike(r"(?:^|/)settings/[^/]+\.py$"), paths.directory_of(paths.directory_of(path))
    )
    return (
        listing.select("repo", holder.alias("holder"))
        .filter(F.col("holder").isNotNull())
        .select(
            "repo",
            F.explode(
                F.when(
                    (F.col("holder") == "") | paths.file_name(F.col("holder")).startswith("."),
                    F.array("holder"),
                ).otherwise(F.array("holder", paths.directory_of(F.col("holder"))))
            ).alias("ancestor"),
        )
        .distinct()
    )


def dirs_with_settings(listing: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """Those of ``dirs`` (repo, dir; by default of all Python files) that see a settings module in themselves or above.

    Derived from the listing alone, so file contents are not read a second time.
    """
    if dirs is None:
        dirs = listing.filter(F.col("path").endswith(".py")).select(
            "repo", paths.directory_of(F.col("path")).alias("dir")
        ).distinct()
    return nearest_marked(dirs, settings_roots(listing), P.MAX_ANCESTORS).select("repo", "dir")


def lower_django_routes(access: DataFrame, listing: DataFrame) -> DataFrame:
    """Access findings, of which those on Python routes of a project with a settings module become low.

    Only their repositories are looked up in the listing. ``access`` is read three times, so it should be a table.
    """
    routes = access.withColumn("dir", paths.directory_of(F.col("path")))
    dirs = routes.filter("language = 'python'").select("repo", "dir").distinct()
    near = listing.join(dirs.select("repo").distinct(), "repo", "left_semi")
    seen = dirs_with_settings(near, dirs).withColumn("_django", F.lit(True))
    hit = F.col("_django") & (F.col("language") == "python")
    return (
        routes.join(seen, ["repo", "dir"], "left")
        .withColumn("severity", F.when(hit, "low").otherwise(F.col("severity")))
        .withColumn("variant", F.when(hit, "route-django").otherwise(F.col("variant")))
        .select(*access.columns)
    )
