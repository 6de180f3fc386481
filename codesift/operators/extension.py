"""Rules added by users: as data, as a detector, or as a function over a file's lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions import paths
from codesift.functions import patterns as P
from codesift.functions.taint import has_taint
from codesift.functions.text import has_word, is_comment, matches, split_lines, strip
from codesift.operators.catalog import RuleText, add_rule
from codesift.operators.detectors import DETECTORS
from codesift.operators.engine import Detector, Line, detect, path_flags, report, scannable
from codesift.operators.reports import rule_evaluation


@dataclass(frozen=True)
class RuleSpec:
    """A simple rule as data: a trigger, a window and the patterns that clear it."""

    rule_id: str
    trigger: str
    severity: str = "high"
    words: tuple[str, ...] = ()
    before: int = 0
    after: int = 0
    languages: tuple[str, ...] = ()
    cleared_by_line: tuple[str, ...] = ()
    cleared_by_window: tuple[str, ...] = ()
    needs_taint: bool = False
    skip_tests: bool = True


def rule_specs(table: DataFrame) -> list[RuleSpec]:
    """Rules from a table with a column per field of ``RuleSpec`` (nulls take the default).

    A rule table is configuration: every row becomes part of the plan, so it is read on the driver.
    """
    return [
        RuleSpec(**{
            name: tuple(value) if isinstance(value, list) else value
            for name, value in row.asDict().items() if value is not None
        })
        for row in table.collect()
    ]


def detector_of(spec: RuleSpec) -> Detector:
    """Columns for a rule given as data. Without ``words`` every line is tested."""
    if spec.severity not in ("high", "medium", "low"):
        raise ValueError(f"unknown severity {spec.severity!r}")
    if spec.before < 0 or spec.after < 0:
        raise ValueError("a window cannot end before it begins")

    def finding(line: Line) -> Column:
        fires = matches(line.text, spec.trigger) & ~is_comment(line.text, P.COMMENT_COMMON)
        if spec.languages:
            fires = fires & line.language.isin(list(spec.languages))
        for pattern in spec.cleared_by_line:
            fires = fires & ~matches(line.text, pattern)
        window = line.window(spec.before, spec.after)
        for pattern in spec.cleared_by_window:
            fires = fires & ~matches(window, pattern)
        if spec.needs_taint:
            fires = fires & has_taint(window)
        return F.when(fires, report(spec.rule_id, spec.severity))

    return Detector(
        spec.rule_id, tuple(w.lower() for w in spec.words), "", finding, spec.before, spec.after,
        allowed=(lambda: ~F.col("is_test")) if spec.skip_tests else None,
    )


def register_detector(name: str, detector: Detector | RuleSpec, text: RuleText | None = None) -> None:
    """Add a rule to the scan, with what it says. Existing names are kept as they are.

    Without a text the rule's name is its class and title.
    """
    if name in DETECTORS:
        raise ValueError(f"a detector named {name!r} exists")
    DETECTORS[name] = detector if isinstance(detector, Detector) else detector_of(detector)
    add_rule(detector.rule_id, text or RuleText(name, {"": (name, "", "")}))


@dataclass(frozen=True)
class FunctionRule:
    """A rule that columns cannot say, such as one that relates distant lines: a generator over the lines of a file.

    ``find(lines, language, path)`` yields (line number from 1, severity, variant, evidence). Files without any of
    ``words`` (lower case), of other ``languages`` or, with ``skip_tests``, of tests never reach it.
    """

    rule_id: str
    find: Callable[[list[str], str, str], Iterable[tuple[int, str, str, str]]]
    words: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    skip_tests: bool = True


def detect_by_function(
    files: DataFrame, rule: FunctionRule, skip_minified: bool = True, denied_suffixes: Sequence[str] = ()
) -> DataFrame:
    """Findings of a rule given as a function, in the shape of ``detect``'s.

    The function runs as a Python table function over Arrow batches; files are chosen, split and policed by columns before
    it, and what it yields must be a finding: a line that the file has and a known severity, else the job fails with the
    rule's name. A file is held as a whole by its task.
    """
    if skip_minified:
        files = scannable(files, denied_suffixes)
    wanted = F.lit(True)
    if rule.words:
        wanted = wanted & has_word(F.col("code"), rule.words)
    if rule.languages:
        wanted = wanted & F.col("language").isin(list(rule.languages))
    if rule.skip_tests:
        wanted = wanted & ~paths.is_test_file(F.col("path"))
    rows = files.filter(wanted).select("repo", "path", "language", *path_flags(), split_lines(F.col("code")).alias("lines"))
    if skip_minified:
        rows = rows.filter(~paths.has_long_line(F.col("lines")))
    find, rule_id = rule.find, rule.rule_id

    class Findings:
        def eval(self, lines, language, path):
            lines = list(lines)
            for line_no, severity, variant, evidence in find(lines, language, path):
                if not 1 <= line_no <= len(lines) or severity not in ("high", "medium", "low"):
                    raise ValueError(f"{rule_id} reports line {line_no}, severity {severity!r} in {path}")
                yield int(line_no), severity, str(variant), str(evidence)

    table = F.udtf(Findings, returnType="line_no int, severity string, variant string, evidence string", useArrow=True)
    found = rows.lateralJoin(table(F.col("lines").outer(), F.col("language").outer(), F.col("path").outer()))
    return found.select(
        "repo", "path", "language", "is_test", "is_demo", "line_no", F.lit(rule_id).alias("rule_id"), "severity",
        "variant", "evidence", strip(F.element_at("lines", F.col("line_no"))).alias("line"),
    )


def validate_rule(
    files: DataFrame, detectors: Sequence[Detector], labels: DataFrame, **limits
) -> DataFrame:
    """Judge detectors over labelled files: ``labels`` has repo, path, rule_id, expect_fire."""
    return rule_evaluation(detect(files, detectors), labels, **limits)
