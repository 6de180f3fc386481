"""Columns over lines and windows of lines."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P

_SEPARATOR_AT_END = "(?:" + P.LINE_SEPARATOR + r")\z"
_NO_LINES = "array<string>"


def matches(text: Column, pattern: str) -> Column:
    """True where a shared pattern occurs anywhere in ``text``."""
    return text.rlike(P.rx(pattern))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a shared pattern (or one of its groups), ``''`` when there is none."""
    return F.regexp_extract(text, P.rx(pattern), group)


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(P.rx(pattern)), F.lit(group))


def words(text: Column) -> Column:
    """Maximal runs of word characters; ``\\bname\\b`` occurs iff ``name`` is one of them."""
    return extract_all(text, r"\w+")


# Unicode case folding maps these four letters to i, k and s.
FOLDING_LETTERS = "\u0130\u0131\u017f\u212a"


def _by_first_letter(words: Iterable[str]) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        groups.setdefault(word[:1], []).append(word[1:])
    return groups


def _prefix_tree(words: Iterable[str]) -> str:
    groups = _by_first_letter(words)
    if "" in groups:
        return ""
    branches = [re.escape(first) + _prefix_tree(rest) for first, rest in groups.items()]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def word_search(words: Iterable[str]) -> str:
    """Pattern that finds any of the (lower-case) words without case, as a prefilter.

    Shared prefixes are merged and the first letter is tested as a set, because a
    plain alternation tries every word at every position.
    """
    words = list(words)
    first = "".join(sorted({re.escape(c) for w in words for c in (w[0], w[0].upper())}))
    return f"(?i)(?=[{first}]){_prefix_tree(words)}"


def has_word(text: Column, words: Iterable[str]) -> Column:
    """The text may hold one of the words: it does in ASCII, or has a letter that folds to one."""
    found = text.rlike(word_search(words))
    for letter in FOLDING_LETTERS:
        found = found | F.contains(text, F.lit(letter))
    return found


def search(text: Column, words: Iterable[str], pattern: str) -> Column:
    """``matches`` behind a quick search for words of which every match contains one."""
    return has_word(text, words) & matches(text, pattern)


def any_match(text: Column, patterns: list[str]) -> Column:
    hit = matches(text, patterns[0])
    for pattern in patterns[1:]:
        hit = hit | matches(text, pattern)
    return hit


def normalize_newlines(code: Column) -> Column:
    """``\\r\\n`` and ``\\r`` become ``\\n``, as when a text file is read."""
    return F.when(
        F.contains(code, F.lit("\r")), F.regexp_replace(code, "\r\n?", "\n")
    ).otherwise(code)


def split_lines(code: Column) -> Column:
    """Lines as ``str.splitlines`` gives them: ten separators, no trailing empty line."""
    body = F.regexp_replace(code, _SEPARATOR_AT_END, "")
    return F.when(F.length(code) == 0, F.array().cast(_NO_LINES)).otherwise(
        F.split(body, P.LINE_SEPARATOR, -1)
    )


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` only removes spaces)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def window_text(lines: Column, at: Column, before: int, after: int) -> Column:
    """Lines ``at-before .. at+after`` (0-based, both ends included, clipped), joined by newline.

    A negative ``before`` or ``after`` starts below or ends above the line itself.
    """
    first = F.greatest(at - before, F.lit(0))
    last = F.least(at + after, F.size(lines) - 1)
    return F.array_join(F.slice(lines, first + 1, F.greatest(last - first + 1, F.lit(0))), "\n")


def is_comment(line: Column, family: str) -> Column:
    return matches(line, family)
