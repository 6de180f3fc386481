"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions import identifiers, paths, values
from codesift.functions import patterns as P
from codesift.functions.imports import normalize_package
from codesift.functions.repos import normalize_repo_url, repo_name
from codesift.functions.taint import has_taint
from codesift.functions.text import matches, split_lines, strip, window_text
from codesift.operators import packages, reports, repo_rules
from codesift.operators.catalog import attach_metadata
from codesift.operators.detectors import DETECTORS, access
from codesift.operators.detectors.crypto import DIGEST_NAMES
from codesift.operators.detectors.injection import assigned_sql_above
from codesift.operators.engine import Detector, Line, candidates, detect, report, scannable
from codesift.operators.extension import FunctionRule, RuleSpec, detect_by_function, detector_of, validate_rule
from codesift.operators.rate_limit import rate_limit
from codesift.operators.facts import Facts
from codesift.plans.scan import found_in, line_findings, order_findings, raw_findings, report_order, scan_facts
from codesift.session import new_table_path, written_table
from codesift.sources import corpus
from codesift.sources.batches import dedupe_repos
from codesift.sources.files import (
    PROFILES, cap_files, scan_scope, select_files, source_files, source_files_stream, text_corpus,
)
from codesift.sources.sinks import append_scan_log, export_findings, load_scan_log
from codesift.sources.tree import write_tree
from codesift.streaming.scan import changes, publish_batch

Query = Callable[[SparkSession, str], DataFrame]

DETECTOR_COLUMNS = ["repo", "path", "line_no", "rule_id", "severity", "variant", "evidence", "line"]
DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_corpus(
        table(spark, sf_dir, "pages"), "page_id", "html", None, "javascript", ".html"
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn(
        "place", F.concat_ws("-", "conv_id", "turn")
    )
    return text_corpus(turns, "place", "text", "role")


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of the corpus under the directory profile."""
    return _found_in(spark, sf_dir, _directory_facts(spark, sf_dir))


def _directory_facts(spark: SparkSession, sf_dir: str) -> Facts:
    """The facts of the files that the directory profile reads."""
    return scan_facts(select_files(corpus.code_corpus(spark, sf_dir), PROFILES["directory"]))


def _found_in(spark: SparkSession, sf_dir: str, facts: Facts) -> DataFrame:
    registry = packages.fresh_registry(corpus.package_registry(spark, sf_dir), _as_of())
    return found_in(facts, PROFILES["directory"], _listing(spark, sf_dir), registry)


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing as a table, as a walk leaves it."""
    return written_table(corpus.code_listing(spark, sf_dir), "listing")


def _as_of() -> Column:
    return F.lit(corpus.REGISTRY_AS_OF).cast("timestamp")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_findings(corpus.code_corpus(spark, sf_dir), listing=_listing(spark, sf_dir))


# --- sources -------------------------------------------------------------------


def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.posexplode_outer(split_lines(F.col("code"))).alias("position", "line")
    return (
        documents(spark, sf_dir)
        .select("repo", "path", lines)
        .filter(F.col("line").isNotNull())
        .select("repo", "path", (F.col("position") + 1).alias("line_no"), "line")
    )


def _selected(profile: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = select_files(corpus.code_corpus(spark, sf_dir), PROFILES[profile])
        return chosen.select("repo", "path", "language", "size_bytes")

    return query


def _selected_large(profile: str) -> Query:
    """The files of few, large repositories that a profile reads: its cap, its size rule and their order show."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select_files(corpus.large_listing(spark, sf_dir), PROFILES[profile])

    return query


def _scope_large(profile: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan_scope(corpus.large_listing(spark, sf_dir), PROFILES[profile])

    return query


def scan_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_scope(corpus.code_corpus(spark, sf_dir), PROFILES["service"])


def capped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_files(corpus.code_corpus(spark, sf_dir).select("repo", "path"), 10)


def file_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return corpus.code_corpus(spark, sf_dir).select(
        "repo",
        "path",
        "language",
        paths.is_minified(path, split_lines(F.col("code"))).alias("is_minified"),
        paths.is_test_file(path).alias("is_test"),
        paths.is_vendor_file(path).alias("is_vendor"),
        paths.is_demo_path(path).alias("is_demo"),
        paths.is_benchmark_path(path).alias("is_benchmark"),
    )


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    tail = F.element_at(F.array(F.lit(".git"), F.lit("/"), F.lit(""), F.lit("/tree/x")),
                        (F.col("page_id") % 4 + 1).cast("int"))
    raw = F.concat(F.lit(" https://github.com/"), host, F.lit("/r"), F.col("page_id").cast("string"), tail)
    url = normalize_repo_url(raw)
    return table(spark, sf_dir, "pages").select(
        "page_id", url.alias("url"), repo_name(url).alias("repo")
    )


def deduped_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    owner = F.when(F.col("page_id") % 2 == 1, F.upper(host)).otherwise(host)
    batches = table(spark, sf_dir, "pages").select(
        (F.col("page_id") % 10).cast("int").alias("batch_no"),
        F.col("page_id").alias("position"),
        owner.alias("owner"),
        F.lit("site").alias("repo"),
    )
    return dedupe_repos(batches)


# --- windows and scalar functions -------------------------------------------------


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = split_lines(F.col("code"))
    rows = documents(spark, sf_dir).select("path", lines.alias("lines"))
    windows = F.transform(
        "lines",
        lambda line, at: F.struct(
            (at + 1).alias("line_no"),
            F.md5(window_text(F.col("lines"), at, 4, 5)).alias("around"),
            F.md5(window_text(F.col("lines"), at, -1, 3)).alias("below"),
        ),
    )
    return (
        rows.select("path", F.explode_outer(windows).alias("w"))
        .filter(F.col("w").isNotNull())
        .select("path", "w.*")
    )


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("code", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return (
        corpus.code_corpus(spark, sf_dir)
        .select(F.explode_outer(found).alias("name"))
        .groupBy("name")
        .agg(F.count("*").alias("uses"))
        .filter(F.col("name").isNotNull())
    )


def split_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_join(identifiers.split_identifier(F.col("name")), "|")
    return _identifiers(spark, sf_dir).select("name", "uses", words.alias("words"))


def security_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identifiers(spark, sf_dir).select(
        "name", "uses", identifiers.is_security_target(F.col("name")).alias("is_target")
    )


def _corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.posexplode_outer(split_lines(F.col("code"))).alias("position", "line")
    return (
        corpus.code_corpus(spark, sf_dir)
        .select("repo", "path", "language", lines)
        .filter(F.col("line").isNotNull())
        .withColumn("line_no", F.col("position") + 1)
    )


def line_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.explode_outer(values.string_values(F.col("line"))).alias("value")
    value = F.col("value")
    return (
        _corpus_lines(spark, sf_dir)
        .select("repo", "path", "line_no", identifiers.assigned_name(F.col("line")).alias("target"), quoted)
        .filter(value.isNotNull())
        .select(
            "*",
            values.is_non_ascii(value).alias("non_ascii"),
            values.is_status_word(value).alias("status_word"),
            values.is_safe_default(value).alias("safe_default"),
            values.is_placeholder(value).alias("placeholder"),
            values.is_bcrypt(value).alias("bcrypt"),
            values.is_env_name(value).alias("env_name"),
            values.looks_like_label(value).alias("label"),
        )
    )


def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("line")
    return _corpus_lines(spark, sf_dir).select(
        "repo", "path", "line_no", F.md5(strip(line)).alias("stripped_md5"),
        matches(line, P.COMMENT_CREDENTIAL).alias("credential_family"),
        matches(line, P.COMMENT_COMMON).alias("common_family"),
        matches(line, P.COMMENT_SCRIPT).alias("script_family"),
        matches(line, P.COMMENT_ROUTE).alias("route_family"),
    )


def taint_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the corpus whose five-line neighbourhood carries a caller's value."""
    lines = split_lines(F.col("code"))
    tainted = F.transform("lines", lambda _, at: has_taint(window_text(F.col("lines"), at, 4, 5)))
    return (
        corpus.code_corpus(spark, sf_dir)
        .select("repo", "path", lines.alias("lines"))
        .select("repo", "path", F.posexplode_outer(tainted).alias("at", "tainted"))
        .filter(F.col("tainted"))
        .select("repo", "path", (F.col("at") + 1).alias("line_no"))
    )


def digest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a digest or a MAC, with the line from which they do."""
    files = scannable(corpus.code_corpus(spark, sf_dir)).select(
        "repo", "path", "code", split_lines(F.col("code")).alias("lines")
    )
    names = files.filter(~paths.has_long_line(F.col("lines"))).select(
        "repo", "path", DIGEST_NAMES.column().alias("names")
    )
    entries = F.concat(
        F.transform("names.digests", lambda d: F.struct(F.lit("digest").alias("kind"), d["name"], d["since"])),
        F.transform("names.macs", lambda d: F.struct(F.lit("mac").alias("kind"), d["name"], d["since"])),
    )
    return (
        names.select("repo", "path", F.explode_outer(entries).alias("entry"))
        .filter(F.col("entry").isNotNull())
        .select("repo", "path", "entry.*")
    )


# --- detectors -----------------------------------------------------------------


def _detector(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect(corpus.code_corpus(spark, sf_dir), [DETECTORS[name]])
        return found.select(*DETECTOR_COLUMNS)

    return query


def strict_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(corpus.code_corpus(spark, sf_dir), [access.ROUTE_STRICT]).select(*DETECTOR_COLUMNS)


def findings_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select(*DETECTOR_COLUMNS)


def denied_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors without the files whose path ends as a deny list says."""
    found = detect(
        corpus.code_corpus(spark, sf_dir), list(DETECTORS.values()),
        denied_suffixes=["users.js", "/db.py"],
    )
    return found.select("repo", "path", "line_no", "rule_id", "severity")


def first_access_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written_table(detect(corpus.code_corpus(spark, sf_dir), [DETECTORS["open_route"]]), "routes")
    return repo_rules.first_access_finding_per_file(found).select("repo", "path", "line_no")


def sql_var_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed names with their SQL assignment in the 14 lines above, on every line of every file."""
    every_line = Detector("I001", (), "", lambda line: report("I001", "high"), before=14)
    rows = candidates(corpus.code_corpus(spark, sf_dir), [every_line], skip_minified=False)
    return rows.filter(assigned_sql_above(Line())).select("repo", "path", "line_no")


def _text_scan(build: Callable[[SparkSession, str], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect(build(spark, sf_dir), list(DETECTORS.values()), skip_minified=False)
        return found.select(*DETECTOR_COLUMNS)

    return query


def secret_scan_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(documents(spark, sf_dir), list(DETECTORS.values()))
    return found.select(*DETECTOR_COLUMNS)


def rule_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule given as data, over the documents: a secret-looking token outside a list."""
    spec = RuleSpec(
        "X001", r"\btoken\s*=", "medium", before=1, after=1,
        cleared_by_window=(r"^\s*[-*]\s",), skip_tests=False,
    )
    found = detect(documents(spark, sf_dir), [detector_of(spec)], skip_minified=False)
    return found.select(*DETECTOR_COLUMNS)


def rule_spec_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages with an inline script, unless they belong to a German page."""
    spec = RuleSpec(
        "X002", r"<script>", "low", words=("<script>",), cleared_by_line=(r'<html lang="de">',), skip_tests=False
    )
    return detect(pages(spark, sf_dir), [detector_of(spec)], skip_minified=False).select(*DETECTOR_COLUMNS)


def rule_spec_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of turns with one French word and without another near them."""
    spec = RuleSpec(
        "X003", r"(?:^|\s)que\s", "low", before=1, after=2, cleared_by_window=(r"(?:^|\s)dans\s",), skip_tests=False
    )
    found = detect(conversations(spark, sf_dir), [detector_of(spec)], skip_minified=False)
    return found.select(*DETECTOR_COLUMNS)


def _repeats(lines: list[str], language: str, path: str):
    """Lines of some length that stand in the file before, with the number of the first one."""
    first: dict[str, int] = {}
    for number, line in enumerate(lines, 1):
        if len(line) >= 20 and first.setdefault(line, number) != number:
            yield number, "low", "", str(first[line])


def function_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule across lines, given as a function, over the documents: lines that repeat."""
    rule = FunctionRule("X010", _repeats, skip_tests=False)
    return detect_by_function(documents(spark, sf_dir), rule, skip_minified=False).select(*DETECTOR_COLUMNS)


def rule_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new rule judged over the labelled corpus before it is added."""
    files = corpus.code_corpus(spark, sf_dir)
    spec = RuleSpec("C003", r"verify\s*=\s*False", words=("verify",), languages=("python",))
    return validate_rule(files, [detector_of(spec)], corpus.labelled_cases(spark, sf_dir).filter("rule_id = 'C003'"))


# --- repository rules and packages ------------------------------------------------


def repo_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.code_corpus(spark, sf_dir)
    return files.groupBy("repo").agg(
        F.bool_or(access.has_auth_words(F.col("code"))).alias("has_auth")
    )


def repo_auth_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = scan_facts(corpus.code_corpus(spark, sf_dir))
    return line_findings(facts, _listing(spark, sf_dir), facts.auth_repos).select("repo", "path", "line_no", "rule_id", "severity")


def django_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_rules.dirs_with_settings(corpus.code_listing(spark, sf_dir))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.import_lines(corpus.code_corpus(spark, sf_dir)).select(
        "repo", "path", "ecosystem", "package", "line_no", "line"
    )


def distinct_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packages.import_lines(corpus.code_corpus(spark, sf_dir))
    return packages.distinct_imports_per_file(found).select(
        "repo", "path", "ecosystem", "package", "line_no", "line",
        normalize_package(F.col("package"), F.col("ecosystem")).alias("registry_name"),
    )


def unaliased_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packages.drop_aliased(packages.import_lines(corpus.code_corpus(spark, sf_dir)))
    return found.select("repo", "path", "package", "line_no")


def registry_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.fresh_registry(corpus.package_registry(spark, sf_dir), _as_of()).select(
        "ecosystem", "name", F.col("exists").alias("is_known"),
        F.col("checked_at").cast("timestamp_ntz").alias("checked_at"),
    )


def missing_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = packages.fresh_registry(corpus.package_registry(spark, sf_dir), _as_of())
    found = packages.import_lines(corpus.code_corpus(spark, sf_dir))
    return packages.missing_imports(found, registry).select("repo", "path", "package", "line_no")


def project_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.project_roots(corpus.code_listing(spark, sf_dir))


def local_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packages.import_lines(corpus.code_corpus(spark, sf_dir))
    kept = packages.drop_local_packages(found, _listing(spark, sf_dir))
    return kept.select("repo", "path", "package", "line_no")


def unknown_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = packages.fresh_registry(corpus.package_registry(spark, sf_dir), _as_of())
    found = packages.unknown_packages(
        corpus.code_corpus(spark, sf_dir), registry, _listing(spark, sf_dir)
    )
    return found.select(*DETECTOR_COLUMNS)


# --- whole scans and reports --------------------------------------------------------


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_scope(corpus.code_corpus(spark, sf_dir), PROFILES["directory"])


def scan_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_findings(corpus_scan(spark, sf_dir)).select(
        "repo", "path", "line_no", "rule_id", "severity", "sev_rank", "vuln_class", "cwe",
        "owasp_rank", "line", "position",
    )


def exported_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_findings(corpus_scan(spark, sf_dir)).select(
        "repo", "file", "line", "rule_id", "severity", "vuln_class", "title", "detail", "fix", "code", "cwe",
        "owasp_category", "owasp_rank",
    )


def attached_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_metadata(_raw(spark, sf_dir)).select(
        "repo", "path", "line_no", "rule_id", "rule_seq", "vuln_class", "cwe", "owasp_category",
        "owasp_rank", "title",
    )


def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report: high, medium and low blocks over all files."""
    return report_order(attach_metadata(_raw(spark, sf_dir))).select(
        "sev_rank", "severity", "repo", "path", "line_no", "rule_id"
    )


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _directory_facts(spark, sf_dir)
    return reports.scan_summary(_found_in(spark, sf_dir, facts), reports.scope_of(facts.files))


def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_gate(_raw(spark, sf_dir), _scope(spark, sf_dir))


def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_rollup(_raw(spark, sf_dir))


def _severity(severity: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = reports.severity_view(_raw(spark, sf_dir), severity)
        return view.select("repo", "path", "line_no", "rule_id")

    return query


def files_with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.files_with_findings(_raw(spark, sf_dir))


def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = reports.nested_results(attach_metadata(_raw(spark, sf_dir)))
    listed = F.transform(
        "findings", lambda f: F.concat_ws(":", f["rule_id"], f["severity"], f["line_no"])
    )
    return nested.select("repo", "path", F.array_join(listed, ";").alias("findings"))


def fleet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.code_corpus(spark, sf_dir)
    attempted = files.groupBy("repo").agg(
        (F.pmod(F.length("repo") + F.count("*"), F.lit(5)) != 0).alias("scanned")
    )
    return reports.fleet_report(_raw(spark, sf_dir), attempted)


def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_rules(_raw(spark, sf_dir))


def regression_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.regression_diff(_raw(spark, sf_dir), corpus.expected_findings(spark, sf_dir))


def rule_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rule_evaluation(_raw(spark, sf_dir), corpus.labelled_cases(spark, sf_dir))


# --- trees and streams ---------------------------------------------------------------


def published_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three batches of files changes in the published findings."""
    folder = new_table_path(spark, "published")
    batches = corpus.code_batches(spark, sf_dir)
    registry = written_table(packages.fresh_registry(corpus.package_registry(spark, sf_dir), _as_of()), "registry")
    for number in range(3):
        publish_batch(batches.filter(F.col("batch") == number).drop("batch"), number, folder, registry)
    return changes(spark, folder).select(
        F.col("batch").cast("int").alias("batch"), "op", "repo", "path", "line_no", "rule_id", "severity", "variant"
    )


def scan_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan history appended in batches of events, one of which is repeated."""
    path = new_table_path(spark, "scan-log")
    log = corpus.scan_log(spark, sf_dir).select(
        "repo", F.col("findings").alias("total_findings"), F.col("files").alias("files_scanned"), "ts"
    )
    part = F.pmod(F.col("total_findings"), F.lit(3))
    for number in (0, 1, 2, 1):
        append_scan_log(log.filter(part == number), path, F.col("ts"), number)
    return load_scan_log(spark, path).select("repo", "findings", "files", F.col("ts").cast("timestamp_ntz").alias("ts"))


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """The corpus as files below a folder that all executors share."""
    root = new_table_path(spark, "tree-of-files")
    files = corpus.code_corpus(spark, sf_dir).select(F.concat_ws("/", "repo", "path").alias("path"), "code")
    write_tree(files, root)
    return root


def _shown_files(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", "language", "size_bytes", F.md5("code").alias("code_md5"))


def directory_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a directory tree, read back by bytes."""
    return _shown_files(source_files(spark, _tree(spark, sf_dir)))


def file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream over the log of two listings; each is read once."""
    root, log, out = _tree(spark, sf_dir), new_table_path(spark, "file-log"), new_table_path(spark, "file-stream")
    for _ in range(2):
        query = (
            _shown_files(source_files_stream(spark, root, log, settle_seconds=0)).writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", f"{log}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.parquet(out)


# --- history and rate limits ----------------------------------------------------------


def scan_log_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_log_rollup(corpus.scan_log(spark, sf_dir))


def recent_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recent_scans(corpus.scan_log(spark, sf_dir))


def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_totals(corpus.scan_log(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("user_id") % 11 != 0, F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        key.alias("key"), "ts", F.col("event_id").alias("request_id")
    )


def rate_limit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit(_requests(spark, sf_dir), 5, DAY)


def rate_limit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few, very hot keys: event types, five per hour."""
    requests = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("key"), "ts", F.col("event_id").alias("request_id")
    )
    return rate_limit(requests)


def rate_limit_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut into ranges of time, with a low bound for what one task may see of a key."""
    requests = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("key"), "ts", F.col("event_id").alias("request_id")
    )
    return rate_limit(requests, 20, 5 * DAY, range_requests=1000)


QUERIES: dict[str, Query] = {
    "lines_explode": lines_explode,
    **{f"select_files_{name}": _selected(name) for name in PROFILES},
    **{f"select_large_{name}": _selected_large(name) for name in PROFILES},
    **{f"scan_scope_{name}": _scope_large(name) for name in PROFILES},
    "scan_scope": scan_scopes,
    "cap_files": capped_files,
    "file_classify": file_classify,
    "repo_urls": repo_urls,
    "dedupe_repos": deduped_repos,
    "context_window": context_window,
    "split_identifier": split_identifier,
    "security_target": security_target,
    "line_values": line_values,
    "comment_lines": comment_lines,
    "taint_windows": taint_windows,
    "digest_names": digest_names,
    **{f"detect_{name}": _detector(name) for name in list(DETECTORS)},
    "detect_open_route_strict": strict_routes,
    "findings_policy": findings_policy,
    "denied_paths": denied_paths,
    "first_access_finding": first_access_finding,
    "sql_var_lookback": sql_var_lookback,
    "secret_scan_documents": _text_scan(documents),
    "secret_scan_documents_skipping": secret_scan_skipping,
    "secret_scan_pages": _text_scan(pages),
    "secret_scan_conversations": _text_scan(conversations),
    "rule_spec_documents": rule_spec,
    "function_rule": function_rule,
    "rule_validation": rule_validation,
    "rule_spec_pages": rule_spec_pages,
    "rule_spec_conversations": rule_spec_conversations,
    "repo_has_auth": repo_auth,
    "repo_auth_filter": repo_auth_filter,
    "django_settings": django_settings,
    "imports": imports,
    "distinct_imports": distinct_imports,
    "unaliased_imports": unaliased_imports,
    "registry_fresh": registry_fresh,
    "missing_imports": missing_imports,
    "project_roots": project_roots,
    "local_packages": local_packages,
    "unknown_packages": unknown_packages,
    "scan_directory": scan_directory,
    "export_findings": exported_findings,
    "attach_metadata": attached_metadata,
    "report_blocks": report_blocks,
    "scan_summary": scan_summary,
    "severity_gate": severity_gate,
    "severity_rollup": severity_rollup,
    **{f"severity_{name}": _severity(name) for name in ("high", "medium", "low")},
    "files_with_findings": files_with_findings,
    "nested_results": nested_results,
    "fleet_report": fleet_report,
    "top_rules": top_rules,
    "regression_diff": regression_diff,
    "rule_evaluation": rule_evaluation,
    "published_changes": published_changes,
    "scan_log_append": scan_log_append,
    "directory_files": directory_files,
    "file_stream": file_stream,
    "scan_log_rollup": scan_log_rollup,
    "recent_scans": recent_scans,
    "scan_totals": scan_totals,
    "rate_limit_events": rate_limit_events,
    "rate_limit_types": rate_limit_types,
    "rate_limit_hot_keys": rate_limit_hot_keys,
}
