"""Columns that read import statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.text import extract


def raw_import(line: Column, language: Column) -> Column:
    """The imported module as written, ``''`` when the line imports nothing."""
    return F.when(language == "python", extract(line, P.PY_IMPORT, 1)).otherwise(
        extract(line, P.JS_IMPORT, 1)
    )


def package_of(module: Column, language: Column) -> Column:
    """Top-level package: first dotted name, or the npm name with its scope."""
    scoped = F.substring_index(module, "/", 2)
    return (
        F.when(language == "python", F.substring_index(module, ".", 1))
        .when(module.startswith("@"), scoped)
        .otherwise(F.substring_index(module, "/", 1))
    )


def ecosystem_of(language: Column) -> Column:
    return F.when(language == "python", F.lit("pypi")).otherwise(F.lit("npm"))


def normalize_package(name: Column, ecosystem: Column) -> Column:
    """PyPI names are compared in lower case with ``_``; npm names as written."""
    return F.when(ecosystem == "pypi", F.lower(F.translate(name, "-", "_"))).otherwise(name)
