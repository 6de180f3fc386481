"""Columns that classify a repository-relative path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.text import matches


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _segment_pattern(segments: list[str]) -> str:
    return "/(?:" + "|".join(re.escape(s) for s in segments) + ")/"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parts(path: Column) -> Column:
    """All segments of a path."""
    return F.array_remove(F.array_remove(F.split(path, "/"), ""), ".")


def directories(path: Column) -> Column:
    """The directory segments of a path."""
    segments = parts(path)
    return F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))


def directory_of(path: Column) -> Column:
    """Directory of a path, ``''`` for the repository root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def language_of(path: Column, fold_case: bool = True) -> Column:
    """Language by suffix, null for other files."""
    end = F.lower(suffix(path)) if fold_case else suffix(path)
    chain = F.lit(None).cast("string")
    for ending, language in P.LANGUAGE_BY_SUFFIX.items():
        chain = F.when(end == ending, F.lit(language)).otherwise(chain)
    return chain


def in_skip_dir(path: Column, skip_dirs: list[str]) -> Column:
    return F.arrays_overlap(parts(path), _strings(skip_dirs))


def is_generated_path(path: Column) -> Column:
    """Minified file names and compiled-output directories (a slash before is needed)."""
    ending = "(?:" + "|".join(re.escape(s) for s in P.MINIFIED_SUFFIXES) + ")$"
    return path.rlike(ending) | F.translate(path, "\\", "/").rlike(
        _segment_pattern(P.GENERATED_SEGMENTS)
    )


def has_long_line(lines: Column) -> Column:
    return F.exists(lines, lambda line: F.length(line) > P.MINIFIED_LINE_LENGTH)


def is_minified(path: Column, lines: Column) -> Column:
    return is_generated_path(path) | has_long_line(lines)


def _lower_directories(path: Column) -> Column:
    return directories(F.lower(path))


def is_test_file(path: Column) -> Column:
    stem = F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")
    return F.arrays_overlap(_lower_directories(path), _strings(P.TEST_DIRS)) | matches(
        stem, P.TEST_STEM
    )


def in_example_dir(path: Column) -> Column:
    return F.arrays_overlap(_lower_directories(path), _strings(P.EXAMPLE_DIRS))


def is_vendor_file(path: Column) -> Column:
    return F.arrays_overlap(_lower_directories(path), _strings(P.VENDOR_DIRS))


def is_demo_path(path: Column) -> Column:
    return F.lower(path).rlike("|".join(re.escape(s) for s in P.DEMO_PATH_PARTS))


def is_benchmark_path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/")).rlike(_segment_pattern(P.BENCHMARK_SEGMENTS))


def ancestors(directory: Column) -> Column:
    """The directory and its parents up to the root ``''``, nearest first, at most ten."""
    segments = F.when(directory == "", F.array().cast("array<string>")).otherwise(
        F.split(directory, "/")
    )
    depth = F.size(segments)
    return F.transform(
        F.sequence(depth, F.greatest(depth - (P.MAX_ANCESTORS - 1), F.lit(0)), F.lit(-1)),
        lambda n: F.array_join(F.slice(segments, 1, n), "/"),
    )
