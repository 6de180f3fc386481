"""From source files to the ordered findings of a scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesift.operators.catalog import attach_metadata
from codesift.operators.detectors import DETECTORS
from codesift.operators.engine import Detector
from codesift.operators.facts import Facts, file_facts, stored_facts
from codesift.operators.packages import unknown_imports
from codesift.operators.repo_rules import first_of_each_file, is_access, lower_django_routes
from codesift.session import written_table
from codesift.sources.files import Profile, select_files


def path_listing(files: DataFrame) -> DataFrame:
    """Listing made of the files themselves, where no fuller one is at hand."""
    return files.select("repo", "path", F.lit(False).alias("is_dir"))


def scan_facts(
    files: DataFrame, detectors: Sequence[Detector] | None = None, skip_minified: bool = True,
    denied_suffixes: Sequence[str] = (),
) -> Facts:
    """The facts of the files, found in one pass over their text and stored."""
    return stored_facts(file_facts(files, list(detectors or DETECTORS.values()), skip_minified, denied_suffixes))


def line_findings(
    facts: Facts, listing: DataFrame | None = None, auth_repos: DataFrame | None = None
) -> DataFrame:
    """Findings of the line rules with every rule of one file or one project applied.

    Access findings, the few that depend on other files, are a table of their own; all others go straight through. With
    ``auth_repos`` access findings elsewhere are dropped.
    """
    listing = path_listing(facts.files) if listing is None else listing
    access = written_table(first_of_each_file(facts.findings.filter(is_access())), "access")
    access = lower_django_routes(access, listing)
    if auth_repos is not None:
        access = access.join(auth_repos, "repo", "left_semi")
    return facts.findings.filter(~is_access()).unionByName(access)


def raw_findings(
    files: DataFrame,
    detectors: Sequence[Detector] | None = None,
    listing: DataFrame | None = None,
    skip_minified: bool = True,
    denied_suffixes: Sequence[str] = (),
) -> DataFrame:
    """``line_findings`` of files."""
    return line_findings(scan_facts(files, detectors, skip_minified, denied_suffixes), listing)


def scan(
    files: DataFrame,
    profile: Profile | None = None,
    listing: DataFrame | None = None,
    registry: DataFrame | None = None,
    detectors: Sequence[Detector] | None = None,
    skip_minified: bool = True,
    denied_suffixes: Sequence[str] = (),
) -> DataFrame:
    """Findings with metadata. The text is read once, here; what is returned starts from the stored facts.

    Without a profile all files are read and no repository-wide filter applies.
    """
    if profile is not None:
        files = select_files(files, profile)
    return found_in(scan_facts(files, detectors, skip_minified, denied_suffixes), profile, listing, registry)


def found_in(
    facts: Facts, profile: Profile | None = None, listing: DataFrame | None = None, registry: DataFrame | None = None,
) -> DataFrame:
    """What a scan under a profile finds in files whose facts are stored."""
    paths = path_listing(facts.files) if listing is None else listing
    needs_auth = profile is not None and profile.needs_repo_auth
    found = line_findings(facts, paths, facts.auth_repos if needs_auth else None)
    if registry is not None and (profile is None or profile.checks_packages):
        found = found.unionByName(unknown_imports(facts.imports, registry, paths))
    return attach_metadata(found)


def order_findings(findings: DataFrame) -> DataFrame:
    """Place of each finding within its file: severity, then line, then rule order."""
    in_file = Window.partitionBy("repo", "path").orderBy("sev_rank", "line_no", "rule_seq")
    return findings.withColumn("position", F.row_number().over(in_file))


def report_order(findings: DataFrame) -> DataFrame:
    """High, medium and low blocks across files, as a range-partitioned sort."""
    return findings.orderBy("sev_rank", "repo", "path", "line_no", "rule_seq")
