"""Columns over repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.text import matches, strip


def normalize_repo_url(url: Column) -> Column:
    """Cleaned ``https://github.com/owner/repo`` address, null when it is not one."""
    cleaned = F.regexp_replace(strip(url), "/+$", "")
    return F.when(
        matches(cleaned, P.REPO_URL), F.regexp_replace(cleaned, r"\.git$", "")
    )


def repo_name(url: Column) -> Column:
    """``owner/repo`` of a normalized address."""
    return F.regexp_extract(url, r"([^/]+/[^/]+)$", 1)
