"""Columns over identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.text import extract


def split_identifier(name: Column) -> Column:
    """Lower-case words of a camelCase, snake_case or kebab-case name."""
    spaced = F.regexp_replace(name, "([a-z0-9])(?=[A-Z])", "$1 ")
    return F.array_remove(F.split(F.lower(F.regexp_replace(spaced, r"(?U)[\s_-]+", " ")), " "), "")


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_security_target(name: Column) -> Column:
    """True where the words of a name say that it holds a secret and not a quantity."""
    parts = split_identifier(name)
    fires = F.arrays_overlap(parts, _words(P.RANDOM_FIRE_WORDS))
    qualified = F.arrays_overlap(parts, _words(["key", "id"])) & F.arrays_overlap(
        parts, _words(P.RANDOM_QUALIFIERS)
    )
    return ~F.arrays_overlap(parts, _words(P.RANDOM_QUANTITIES)) & (fires | qualified)


def assigned_name(line: Column) -> Column:
    return extract(line, P.ASSIGN_TARGET, 1)
