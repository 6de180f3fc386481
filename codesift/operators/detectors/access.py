"""A001: routes and serverless handlers without access control."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.text import is_comment, matches, search, strip
from codesift.operators.engine import GAP, Detector, FileFlag, Line, report

def has_auth_words(text: Column) -> Column:
    return search(text, P.AUTH_HINTS, P.AUTH_WORDS)


LOOK_BACK = 60
LOOK_AHEAD = 29


def _text() -> Column:
    return F.array_join("lines", "\n")


def _router_level_auth() -> Column:
    """Central auth in the first 50 lines or on any import line."""
    lines = F.col("lines")
    head = F.array_join(F.slice(lines, 1, 50), "\n")

    def import_line(line: Column) -> Column:
        text = strip(line)
        is_import = text.startswith("import ") | text.startswith("from ")
        return (is_import | F.contains(text, F.lit("require("))) & matches(
            text, P.ROUTER_LEVEL_AUTH
        )

    return matches(head, P.ROUTER_LEVEL_AUTH) | F.exists(lines, import_line)


def _handler_line() -> Column:
    """Number of the first line that exports a serverless handler, else null."""
    hits = F.transform("lines", lambda line: matches(line, P.SERVERLESS_EXPORT))
    position = F.array_position(hits, F.lit(True)).cast("int")
    is_script = F.col("language").isin("javascript", "typescript")
    return F.when(is_script & matches(_text(), P.SERVERLESS_EXPORT), F.nullif(position, F.lit(0)))


def _open_handler_file() -> Column:
    """A sensitive operation and no auth word left once outbound credentials are removed."""
    text = _text()
    inbound = F.regexp_replace(text, P.rx(P.OUTBOUND_AUTH), "")
    has_auth = has_auth_words(text) & has_auth_words(inbound)
    is_handler = matches(text, P.SERVERLESS_EXPORT)
    return is_handler & matches(text, P.SENSITIVE_OPERATION) & ~has_auth


_HANDLER_WORDS = ("module.exports", "export", "exports.handler")
ROUTER_AUTH = FileFlag("router_auth", _router_level_auth, tuple(P.ROUTER_LEVEL_HINTS))
HANDLER_LINE = FileFlag(
    "handler_line", _handler_line, _HANDLER_WORDS, lambda: F.lit(None).cast("int")
)
OPEN_HANDLER = FileFlag("open_handler", _open_handler_file, _HANDLER_WORDS)


def _has_handler() -> Column:
    return F.col("handler_line").isNotNull()


def _no_handler() -> Column:
    return F.col("handler_line").isNull()


def _is_excluded_path(path: Column) -> Column:
    slashed = F.translate(path, "\\", "/")
    return (
        matches(slashed, P.ROUTE_UTILITY_DIRS)
        | matches(slashed, P.ROUTE_UTILITY_FILES)
        | matches(slashed, P.ROUTE_PUBLIC_DIRS)
    )


def open_serverless_handler(line: Line) -> Column:
    fires = (
        (line.number == line.flag("handler_line"))
        & line.flag("open_handler")
        & ~_is_excluded_path(line.path)
        & ~matches(line.window(-1, 10), P.INLINE_AUTH)
    )
    low = line.flag("router_auth")
    return F.when(
        fires,
        report(
            "A001",
            F.when(low, "low").otherwise("medium"),
            F.when(low, "handler-router").otherwise("handler"),
        ),
    )


def _is_route(line: Line) -> Column:
    return (
        F.when(line.language == "python", matches(line.text, P.ROUTES["python"]))
        .when(line.language == "typescript", matches(line.text, P.ROUTES["typescript"]))
        .otherwise(matches(line.text, P.ROUTES["javascript"]))
    )


def _has_auth(line: Line) -> Column:
    """Auth words on the route, below it, or above it as far as the enclosing class.

    Above, the search starts at the last class line of the look-back; the ten lines
    before that class (its decorators) count as well.
    """
    at = F.col("at")
    start = F.greatest(at - LOOK_BACK, F.lit(0))
    above = F.slice("segment", start + 1, at - start)
    class_hits = F.transform(above, lambda text: matches(text, P.CLASS_LINE))
    last_class = F.when(
        F.array_contains(class_hits, True),
        F.size(above) - F.array_position(F.reverse(class_hits), F.lit(True)).cast("int"),
    )
    back_from = F.greatest(F.coalesce(last_class, F.lit(0)) - 10, F.lit(0))
    body = F.array_join(
        F.slice(above, F.coalesce(last_class, F.lit(0)) + 1, F.size(above)), "\n"
    )
    decorators = F.array_join(
        F.slice(above, back_from + 1, F.coalesce(last_class, F.lit(0)) - back_from), "\n"
    )
    return (
        matches(line.text, P.ROUTE_LINE_AUTH)
        | has_auth_words(line.window(0, LOOK_AHEAD))
        | matches(line.window(-1, 10), P.INLINE_AUTH)
        | has_auth_words(body)
        | has_auth_words(decorators)
    )


def open_route(line: Line, strict: bool = False) -> Column:
    """``strict`` also reports decorators whose only argument is a quoted path."""
    text = line.text
    public = P.PUBLIC_ROUTE_STRICT if strict else P.PUBLIC_ROUTE
    fires = (
        _is_route(line)
        & line.flag("handler_line").isNull()
        & ~_is_excluded_path(line.path)
        & ~is_comment(text, P.COMMENT_ROUTE)
        & ~matches(text, P.WILDCARD_ROUTE)
        & ~matches(text, public)
        & ~matches(text, P.HEALTH_ROUTE)
        & ~matches(text, P.HIDDEN_ROUTE)
        & matches(line.window(0, LOOK_AHEAD), P.SENSITIVE_OPERATION)
        & ~_has_auth(line)
        & ~matches(line.window(3, 0), P.PUBLIC_NOTE)
    )
    named_public = matches(text, P.PUBLIC_BY_NAME)
    limited = matches(line.window(10, 9), P.RATE_LIMIT_SIGN)
    variant = (
        F.when(line.flag("router_auth"), "route-router")
        .when(named_public & limited, "route-public-limited")
        .when(named_public, "route-public")
        .when(limited, "route-limited")
        .otherwise("route")
    )
    severity = F.when(variant == "route", "medium").otherwise("low")
    return F.when(fires, report("A001", severity, variant))


def _not_test() -> Column:
    return ~F.col("is_test")


SERVERLESS = Detector(
    "A001", ("export",), "export", open_serverless_handler, after=10,
    flags=(ROUTER_AUTH, HANDLER_LINE, OPEN_HANDLER), gate=_has_handler,
    allowed=_not_test,
)
_ROUTE_HINT = (
    r"(?:app|router|fastify|blueprint)\.(?:route|get|post|put|patch|delete)" + GAP + r"\(|"
    r"@(?:get|post|put|patch|delete)\(|api_view\(|def (?:get|post|put|patch|delete)\(self"
)
_ROUTE_WORDS = (
    "app.", "router.", "fastify.", "blueprint.", "@get(", "@post(", "@put(", "@patch(", "@delete(",
    "api_view(", "def get(self", "def post(self", "def put(self", "def patch(self", "def delete(self",
)
ROUTE = Detector(
    "A001", _ROUTE_WORDS, _ROUTE_HINT, open_route, before=LOOK_BACK, after=LOOK_AHEAD,
    flags=(ROUTER_AUTH, HANDLER_LINE), gate=_no_handler, allowed=_not_test,
)
ROUTE_STRICT = Detector(
    "A001", _ROUTE_WORDS, _ROUTE_HINT, lambda line: open_route(line, strict=True), before=LOOK_BACK,
    after=LOOK_AHEAD, flags=(ROUTER_AUTH, HANDLER_LINE), gate=_no_handler,
    allowed=_not_test,
)
