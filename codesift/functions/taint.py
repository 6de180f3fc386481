"""Does a window of code carry a value the caller controls?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.text import extract, matches, strip


def _parameter_name(parameter: Column) -> Column:
    """``name: type = default`` without annotation and default."""
    before_type = F.substring_index(strip(parameter), ":", 1)
    return strip(F.substring_index(strip(before_type), "=", 1))


def _any_name(parameters: Column, harmless: list[str]) -> Column:
    return F.exists(
        F.split(parameters, ","),
        lambda p: (_parameter_name(p) != "") & ~_parameter_name(p).isin(harmless),
    )


def has_taint(window: Column) -> Column:
    """Web input in the window, or a first function signature with a caller-supplied parameter.

    Only the first Python signature and the first JavaScript signature of the
    window are read.
    """
    # Exactly one of the two JavaScript groups takes part in a match.
    js_parameters = F.concat(
        extract(window, P.JS_SIGNATURE, 1), extract(window, P.JS_SIGNATURE, 2)
    )
    return (
        matches(window, P.WEB_INPUT)
        | _any_name(extract(window, P.PY_SIGNATURE, 1), ["self"])
        | _any_name(js_parameters, P.UNTAINTED_JS_PARAMS)
    )
