"""C001 (fallback and raw credentials) and C002 (session secrets)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions import values
from codesift.functions.text import extract, is_comment, matches, strip
from codesift.operators.engine import GAP, Detector, Line, report


def _is_real_default(value: Column) -> Column:
    return ~(
        values.is_safe_default(value) | values.is_non_ascii(value) | values.is_status_word(value)
    )


def _named_default(line: Column, pattern: str) -> Column:
    value = strip(extract(line, pattern, 2))
    named = matches(extract(line, pattern, 1), P.CREDENTIAL_NAME)
    return F.when(named & _is_real_default(value), value)


def fallback_value(line: Column) -> Column:
    """Literal default of a credential's environment lookup, null when there is none.

    Four forms in order; a form that does not survive its tests passes on to the next.
    """
    js_value = strip(extract(line, P.FALLBACK_JS, 1))
    js_found = matches(line, P.FALLBACK_JS) & matches(line, P.CREDENTIAL_NAME)
    return F.coalesce(
        F.when(js_found & _is_real_default(js_value), js_value),
        _named_default(line, P.FALLBACK_PY),
        _named_default(line, P.FALLBACK_PY_OR),
        _named_default(line, P.FALLBACK_DESTRUCTURED),
    )


def _c001_skips(line: Line) -> Column:
    return is_comment(line.text, P.COMMENT_CREDENTIAL) | matches(line.text, P.DOC_EXAMPLE)


def _shown_as_demo() -> Column:
    return F.col("is_demo") & ~F.col("is_test")


def fallback_secret(line: Line) -> Column:
    value = fallback_value(line.text)
    severity = F.when(_shown_as_demo(), "low").otherwise("medium")
    variant = F.when(_shown_as_demo(), "fallback-demo").otherwise("fallback")
    return F.when(
        ~_c001_skips(line) & value.isNotNull(), report("C001", severity, variant, value)
    )


def first_raw_credential(line: Column) -> Column:
    """(position, description, literal) of the first pattern that matches."""
    forms = [
        F.when(
            matches(line, pattern),
            F.struct(
                F.lit(position).alias("position"),
                F.lit(description).alias("description"),
                F.coalesce(
                    F.try_element_at(values.string_values(extract(line, pattern)), F.lit(-1)), F.lit("")
                ).alias("value"),
            ),
        )
        for position, (pattern, description) in enumerate(P.RAW_CREDENTIALS)
    ]
    return F.coalesce(*forms)


def _is_harmless_value(line: Column, value: Column) -> Column:
    key = F.when(F.instr(line, ":") > 0, F.substring_index(line, ":", 1)).otherwise(
        F.substring_index(line, "=", 1)
    )
    label = values.looks_like_label(value) & (
        (F.instr(value, " ") > 0) | matches(key, P.UI_KEY_HINT)
    )
    return (value != "") & (
        values.is_placeholder(value)
        | values.is_non_ascii(value)
        | values.is_status_word(value)
        | label
        | values.is_bcrypt(value)
        | values.is_env_name(value)
    )


def raw_credential(line: Line) -> Column:
    """The first matching pattern decides; a suppressor ends the line."""
    text = line.text
    first = first_raw_credential(text)
    in_dict = len(P.RAW_CREDENTIALS) - 1
    quiet_line = (
        _c001_skips(line)
        | matches(text, P.SAFE_SOURCE)
        | matches(text, P.PLACEHOLDER_NAME)
        | matches(text, P.API_DOC_CONTEXT)
        | (F.instr(text, P.SAMPLE_JWT) > 0)
    )
    quiet_window = (
        matches(line.window(5, 0), P.API_DOC_CONTEXT)
        | matches(line.window(4, 2), P.PUBLIC_SEARCH_KEY)
        | matches(line.window(19, 0), P.ENUM_CLASS)
    )
    message = F.exists(values.string_values(text), lambda v: matches(v, P.VALIDATION_MESSAGE))
    session = (first["position"] == in_dict) & matches(line.window(5, 2), P.SESSION_CONTEXT)
    severity = F.when(_shown_as_demo(), "low").otherwise("high")
    variant = F.when(_shown_as_demo(), "raw-demo").otherwise("raw")
    fires = (
        ~quiet_line
        & first.isNotNull()
        & fallback_value(text).isNull()
        & ~quiet_window
        & ~message
        & ~_is_harmless_value(text, first["value"])
        & ~matches(text, P.REDACTION_ASSERT)
        & ~session
    )
    return F.when(fires, report("C001", severity, variant, first["description"]))


def _credential_policy() -> Column:
    """Test files keep only fixed key formats, example directories nothing."""
    fixed = F.lit(False)
    for mark in P.FIXED_FORMAT_MARKS:
        fixed = fixed | F.contains(F.col("line"), F.lit(mark))
    return ~F.col("is_test") | (~F.col("is_example") & fixed)


def session_secret(line: Line) -> Column:
    text = line.text
    config_value = extract(text, P.PY_APP_CONFIG_SECRET, 1)
    is_config = line.is_python & (config_value != "")
    config_fires = ~matches(text, P.ENV_SOURCE) & ~values.is_safe_default(config_value)

    assignment = F.coalesce(
        F.when(matches(text, P.SESSION_SECRET), extract(text, P.SESSION_SECRET)),
        F.when(matches(text, P.COOKIE_PARSER_SECRET), extract(text, P.COOKIE_PARSER_SECRET)),
        F.when(line.is_python & matches(text, P.PY_SECRET_KEY), extract(text, P.PY_SECRET_KEY)),
    )
    value = extract(assignment, P.QUOTED_VALUE, 1)
    harmless = (value != "") & (
        values.is_safe_default(value)
        | values.is_placeholder(value)
        | values.is_non_ascii(value)
        | values.is_status_word(value)
        | values.is_bcrypt(value)
        | values.is_env_name(value)
    )
    plain_fires = (
        assignment.isNotNull()
        & ~matches(text, P.SAFE_SOURCE)
        & ~matches(text, P.PLACEHOLDER_NAME)
        & matches(line.window(4, 1), P.SESSION_CONTEXT)
        & ~harmless
    )
    fires = ~is_comment(text, P.COMMENT_COMMON) & F.when(is_config, config_fires).otherwise(
        plain_fires
    )
    return F.when(fires, report("C002", "high"))


_CREDENTIAL_HINT = (
    "(?:password|passwd|pwd|secret|api_?key|auth_token|access_token|private_key|token|key)"
    "[\"']?" + GAP + "[=:]|[sr]k_live_|AKIA|aws|ghp_|github_pat_|eyJ"
)

FALLBACK_SECRET = Detector(
    "C001", ("process.env", "environ.get", "getenv"), r"process\.env|environ\.get|getenv",
    fallback_secret, allowed=_credential_policy,
)
RAW_CREDENTIAL = Detector(
    "C001",
    ("password", "passwd", "pwd", "secret", "token", "key", "sk_live_", "rk_live_", "akia", "aws",
     "ghp_", "github_pat_", "eyj"),
    _CREDENTIAL_HINT, raw_credential, before=19, after=2, allowed=_credential_policy,
)
SESSION_SECRET = Detector(
    "C002", ("secret", "cookieparser"), "secret|cookieParser", session_secret, before=4, after=1,
    allowed=lambda: ~F.col("is_test"),
)
