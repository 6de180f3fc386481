"""One pass from file rows to findings.

A file row is cut into blocks of lines that overlap by the widest window any
detector needs, so neither a window nor a hot, very long file ever requires a
shuffle or a large row. Lines that pass a cheap literal prefilter become
candidate rows; every selected detector is then evaluated on the candidate in
one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.functions import paths
from codesift.functions.text import (
    FOLDING_LETTERS,
    has_word,
    rstrip,
    split_lines,
    strip,
    window_text,
)

BLOCK_LINES = 256

# White space as a hint sees it: any number of ASCII blanks and of characters outside ASCII.
GAP = r"(?:\s|[^\x00-\x7F])*"


@dataclass(frozen=True)
class FileFlag:
    """A whole-file fact over ``lines`` and ``code``, evaluated once per file.

    ``words`` (lower case) restrict the costly part: without any of them in the
    file the flag is ``otherwise``.
    """

    name: str
    build: Callable[[], Column]
    words: tuple[str, ...] = ()
    otherwise: Callable[[], Column] = lambda: F.lit(False)

    def column(self) -> Column:
        if not self.words:
            return self.build()
        found = has_word(F.col("code"), self.words)
        return F.when(found, self.build()).otherwise(self.otherwise())


class Line:
    """The candidate line a detector looks at, and the windows it asks for.

    Windows are columns of their own: several detectors share them, and expressions
    over them stay small.
    """

    def __init__(self) -> None:
        self.windows: dict[str, tuple[int, int]] = {}
        self.text = F.col("line")
        self.number = F.col("line_no")
        self.language = F.col("language")
        self.path = F.col("path")
        self.is_python = F.col("language") == "python"
        self.is_script = F.col("language").isin("javascript", "typescript")

    def window(self, before: int, after: int) -> Column:
        name = f"window_{before}_{after}".replace("-", "minus")
        self.windows[name] = (before, after)
        return F.col(name)

    def flag(self, name: str) -> Column:
        return F.col(name)


@dataclass(frozen=True)
class Detector:
    """A rule: when it may run, what it looks for, what it reports.

    Every line the rule can report contains one of ``words`` (lower case, compared
    without case; none means any line may be reported) and matches ``hint``; every
    such file contains one of ``file_words`` (by default the same words). ``gate``
    tests the flags of the file before its lines are candidates.
    ``finding`` returns a struct made by ``report`` or null. ``allowed`` is the file
    policy of the rule over ``is_test`` and the other path flags.
    """

    rule_id: str
    words: tuple[str, ...]
    hint: str
    finding: Callable[[Line], Column]
    before: int = 0
    after: int = 0
    flags: tuple[FileFlag, ...] = ()
    gate: Callable[[], Column] | None = None
    file_words: tuple[str, ...] = ()
    allowed: Callable[[], Column] | None = None
    keep_indent: bool = False


def report(
    rule_id: str, severity: Column | str, variant: Column | str = "", evidence: Column | str = ""
) -> Column:
    """The struct a detector returns; ``variant`` selects the message of the rule."""

    def column(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        column(severity).alias("severity"),
        column(variant).alias("variant"),
        column(evidence).alias("evidence"),
    )


def _may_interest(text: Column, detectors: Sequence[Detector]) -> Column:
    """The text has a word of some detector and, line by line, its hint."""
    hints = dict.fromkeys(d.hint for d in detectors)
    hint = "(?i)" + "|".join([*hints, f"[{FOLDING_LETTERS}]"])
    if not all(d.words for d in detectors):
        return text.rlike(hint)
    return has_word(text, [w for d in detectors for w in d.words]) & text.rlike(hint)


def has_detector_words(code: Column, detectors: Sequence[Detector]) -> Column:
    if not all(d.words for d in detectors):
        return F.lit(True)
    return has_word(code, [w for d in detectors for w in d.file_words or d.words])


def is_skipped_path(path: Column, denied_suffixes: Sequence[str] = ()) -> Column:
    """Files that no line rule reads: generated, vendored, on the deny list."""
    skip = paths.is_generated_path(path) | paths.is_vendor_file(path)
    for ending in denied_suffixes:
        skip = skip | F.translate(path, "\\", "/").endswith(ending)
    return skip


def scannable(files: DataFrame, denied_suffixes: Sequence[str] = ()) -> DataFrame:
    """Files the line rules look at."""
    return files.filter(~is_skipped_path(F.col("path"), denied_suffixes))


def file_flags(detectors: Sequence[Detector]) -> dict[str, FileFlag]:
    return {flag.name: flag for d in detectors for flag in d.flags}


def path_flags() -> list[Column]:
    path = F.col("path")
    return [
        paths.is_test_file(path).alias("is_test"),
        paths.in_example_dir(path).alias("is_example"),
        paths.is_demo_path(path).alias("is_demo"),
        paths.is_benchmark_path(path).alias("is_benchmark"),
    ]


def candidates(
    files: DataFrame, detectors: Sequence[Detector], skip_minified: bool = True
) -> DataFrame:
    """One row per line that may interest a detector, with its block of neighbours."""
    flags = file_flags(detectors)
    before = max(d.before for d in detectors)
    after = max(d.after for d in detectors)

    # Not a filter: Catalyst would move the search below a shuffle that spreads a small input,
    # and into the scan's single task.
    searched = F.when(has_detector_words(F.col("code"), detectors), split_lines(F.col("code")))
    rows = files.select("repo", "path", "language", "code", searched.alias("lines"))
    rows = rows.select(
        "repo",
        "path",
        "language",
        "lines",
        *path_flags(),
        *[F.when(F.col("lines").isNotNull(), flag.column()).alias(name) for name, flag in flags.items()],
    )

    no_rows = F.size("lines") == 0
    if skip_minified:
        no_rows = no_rows | paths.has_long_line(F.col("lines"))
    kept = ["repo", "path", "language", "is_test", "is_example", "is_demo", "is_benchmark", *flags]
    blocks = line_blocks(rows, kept, ~no_rows, before, after).filter(F.col("block").isNotNull())
    blocks = blocks.select(*kept, "block.*")
    hits = blocks.select("*", F.posexplode_outer(own_lines()).alias("_k", "line"))
    hits = hits.filter(F.col("line").isNotNull() & interesting(F.col("line"), detectors))
    at = F.col("low") + F.col("_k")
    return hits.select(*kept, "segment", at.alias("at"), (F.col("base") + at + 1).alias("line_no"), "line")


def line_blocks(rows: DataFrame, kept: Sequence[str], wanted: Column, before: int, after: int) -> DataFrame:
    """``kept`` columns with a ``block`` of ``lines`` per row, where a file is ``wanted``; else one row with null.

    Blocks overlap by what a window needs before and after a line; ``low`` to ``high`` are the lines that are theirs.
    """
    lines = F.col("lines")

    def block(start: Column) -> Column:
        first = F.greatest(start - before, F.lit(0))
        last = F.least(start + BLOCK_LINES - 1, F.size(lines) - 1)
        stop = F.least(last + after, F.size(lines) - 1)
        return F.struct(
            first.alias("base"),
            (start - first).alias("low"),
            (last - first).alias("high"),
            F.slice(lines, first + 1, stop - first + 1).alias("segment"),
        )

    starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(BLOCK_LINES))
    # The outer form keeps Catalyst from inferring a size filter that would split twice.
    return rows.select(*kept, F.explode_outer(F.when(wanted, F.transform(starts, block))).alias("block"))


def own_lines() -> Column:
    """The lines of a block that are its own. Exploded and filtered in one stage of generated code, they cost no row each
    and no copy of their block."""
    return F.slice("segment", F.col("low") + 1, F.col("high") - F.col("low") + 1)


def interesting(text: Column, detectors: Sequence[Detector]) -> Column:
    """A line may interest a detector whose gate the file passes."""
    by_gate: dict[Callable[[], Column] | None, list[Detector]] = {}
    for detector in detectors:
        by_gate.setdefault(detector.gate, []).append(detector)
    found = F.lit(False)
    for gate, group in by_gate.items():
        hit = _may_interest(text, group)
        found = found | (hit if gate is None else gate() & hit)
    return found


_findings: dict[tuple, tuple[Column, dict, Detector]] = {}


def _finding(
    spark: SparkSession, detector: Detector, policy: bool
) -> tuple[Column, dict[str, tuple[int, int]]]:
    """The detector as one column, with the windows it reads.

    Kept per application, because a stream builds its plan for every batch.
    """
    key = (spark.sparkContext.applicationId, id(detector), policy)
    if key not in _findings:
        line = Line()
        # The detector's own hint first: most candidates interest only one detector.
        wanted = _may_interest(line.text, [detector])
        if detector.gate is not None:
            wanted = detector.gate() & wanted
        if policy and detector.allowed is not None:
            wanted = wanted & detector.allowed()
        # The detector is kept alive with its column, so that its id stays unique.
        finding = F.when(wanted, detector.finding(line))
        _findings[key] = (finding, line.windows, detector)
    return _findings[key][:2]


def detect(
    files: DataFrame,
    detectors: Sequence[Detector],
    skip_minified: bool = True,
    policy: bool = True,
    denied_suffixes: Sequence[str] = (),
) -> DataFrame:
    """Findings of the selected detectors, file policy applied, metadata not yet attached."""
    if skip_minified:
        files = scannable(files, denied_suffixes)
    findings, windows = finding_columns(files.sparkSession, detectors, policy)
    kept = ["repo", "path", "language", "is_test", "is_demo", "line_no", "line"]
    # The plain array is its own projection, which is compiled; a higher-order function around
    # it, or the generator itself, would interpret every pattern test.
    found = candidates(files, detectors, skip_minified).select("*", *windows)
    found = found.select(*kept, F.array(*findings).alias("findings"))
    found = found.select(*kept, F.explode_outer("findings").alias("finding"))
    found = found.filter(F.col("finding").isNotNull())
    return found.select(
        "repo", "path", "language", "is_test", "is_demo", "line_no", "finding.*",
        shown_line(detectors).alias("line"),
    )


def finding_columns(
    spark: SparkSession, detectors: Sequence[Detector], policy: bool
) -> tuple[list[Column], list[Column]]:
    """Each detector's finding, and the windows that they read."""
    findings = []
    windows: dict[str, tuple[int, int]] = {}
    for detector in detectors:
        finding, used = _finding(spark, detector, policy)
        findings.append(finding)
        windows |= used
    return findings, [
        window_text(F.col("segment"), F.col("at"), before, after).alias(name)
        for name, (before, after) in windows.items()
    ]


def shown_line(detectors: Sequence[Detector]) -> Column:
    """The line as a finding shows it."""
    indented = [d.rule_id for d in detectors if d.keep_indent]
    return F.when(F.col("finding.rule_id").isin(indented), rstrip(F.col("line"))).otherwise(
        strip(F.col("line"))
    )
