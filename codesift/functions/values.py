"""Tests on the literal value of a suspected credential."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.text import extract_all, matches


def is_non_ascii(value: Column) -> Column:
    return value.rlike(r"[^\x00-\x7F]")


def is_status_word(value: Column) -> Column:
    return F.lower(value).isin(P.STATUS_WORDS)


def is_safe_default(value: Column) -> Column:
    return matches(value, P.SAFE_DEFAULT)


def is_placeholder(value: Column) -> Column:
    return matches(value, P.PLACEHOLDER_VALUE)


def is_bcrypt(value: Column) -> Column:
    return matches(value, P.BCRYPT_HASH)


def is_env_name(value: Column) -> Column:
    return matches(value, P.ENV_NAME_VALUE)


def looks_like_label(value: Column) -> Column:
    """ASCII text without digits whose words are all lower, all upper or Capitalized.

    Once everything but letters is gone, a word breaks that rule exactly when an
    upper letter follows a lower one, or two upper letters precede a lower one.
    """
    letters = F.regexp_replace(value, r"[^A-Za-z\s]", "")
    return (
        (value != "")
        & ~is_non_ascii(value)
        & ~value.rlike("[0-9]")
        & ~letters.rlike("[a-z][A-Z]|[A-Z][A-Z][a-z]")
    )


def string_values(line: Column) -> Column:
    """Quoted values of at least four characters."""
    return extract_all(line, P.QUOTED_VALUE, 1)
