"""The registered queries once more, as SQL over the same tables.

The vocabulary (patterns, word lists, labelled snippets) is shared with the
Spark side; everything built from it is written separately here, on joins,
list slices and recursive queries.
"""

from __future__ import annotations

from codesift.functions import patterns as P
from codesift.operators.catalog import MESSAGES, RULES
from codesift.sources.cases import cases
from codesift.sources.corpus import GHOSTS, REGISTRY_AS_OF
from codesift.sources.files import PROFILES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def x(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {q(pattern)}, {group})"


def any_of(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(m(text, p) for p in patterns) + ")"


def words_in(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def rstrip(text: str) -> str:
    return f"regexp_replace({text}, '\\s+$', '')"


def win(before: int, after: int) -> str:
    return (
        f"array_to_string(lines[greatest(1, n - ({before})) : least(len(lines), n + ({after}))], chr(10))"
    )


def lines_of(code: str) -> str:
    sep = P.LINE_SEPARATOR
    body = f"regexp_replace({code}, {q('(?:' + sep + ')$')}, '')"
    return (
        f"CASE WHEN {code} = '' THEN []::VARCHAR[] "
        f"ELSE string_split_regex({body}, {q(sep)}) END"
    )


def taint(window: str) -> str:
    def name(p: str) -> str:
        first = strip(f"split_part({strip(p)}, ':', 1)")
        return strip(f"split_part({first}, '=', 1)")

    js = f"({x(window, P.JS_SIGNATURE, 1)} || {x(window, P.JS_SIGNATURE, 2)})"
    py_hit = f"{name('p')} NOT IN ('', 'self')"
    js_hit = f"{name('p')} NOT IN {words_in(['', *P.UNTAINTED_JS_PARAMS])}"
    return (
        f"({m(window, P.WEB_INPUT)}"
        f" OR len(list_filter(string_split({x(window, P.PY_SIGNATURE, 1)}, ','), lambda p: {py_hit})) > 0"
        f" OR len(list_filter(string_split({js}, ','), lambda p: {js_hit})) > 0)"
    )


# --- tables ----------------------------------------------------------------------


def _snippet_values() -> str:
    rows = [
        f"({c['number']}, {q(c['case_id'])}, {q(c['repo_kind'])}, {q(c['path'])}, {q(c['code'])})"
        for c in cases()
    ]
    return ",\n".join(rows)


def _filled(column: str) -> str:
    return (
        f"replace(replace({column}, '{{key}}', CAST(p_partkey AS VARCHAR)), '{{ghost}}', "
        f"CAST(p_partkey % {GHOSTS} AS VARCHAR))"
    )


_SUFFIX_CASE = "CASE {suffix} " + " ".join(
    f"WHEN {q(s)} THEN {q(l)}" for s, l in P.LANGUAGE_BY_SUFFIX.items()
) + " END"
_SUFFIX = r"regexp_extract(path, '[^/](\.[^./]+)$', 1)"
_LANGUAGE = _SUFFIX_CASE.format(suffix=f"lower({_SUFFIX})")

CORPUS = f"""
snippets(number, case_id, repo_kind, spath, scode) AS (VALUES
{_snippet_values()}),
corpus AS (
  SELECT repo_kind || CAST(p_size AS VARCHAR) AS repo, {_filled('spath')} AS path,
         {_filled('scode')} AS code, case_id, p_partkey, p_size
  FROM part JOIN snippets ON number = p_partkey % {len(cases())}),
files AS (
  SELECT repo, path, {_LANGUAGE} AS language, strlen(code) AS size_bytes, code FROM corpus)"""

TEXTS = {
    "documents": """
files AS (
  SELECT source AS repo, CAST(doc_id AS VARCHAR) || '.txt' AS path, 'python' AS language, text AS code
  FROM documents)""",
    "pages": """
files AS (
  SELECT 'html' AS repo, CAST(page_id AS VARCHAR) || '.html' AS path, 'javascript' AS language,
         html AS code FROM pages)""",
    "conversations": """
files AS (
  SELECT role AS repo, conv_id || '-' || turn || '.txt' AS path, 'python' AS language, text AS code
  FROM conversations)""",
}


def _segment(segments: list[str], text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '/{s}/')" for s in segments) + ")"


def _dir_in(names: list[str]) -> str:
    """Any directory part of the path is one of the names, without case."""
    return f"list_has_any(list_slice(string_split(lower(path), '/'), 1, -2), {listed(names)})"


_STEM = r"regexp_replace(regexp_extract(path, '[^/]*$'), '^(.+)\.[^.]+$', '\1')"
_IS_TEST = f"({_dir_in(P.TEST_DIRS)} OR {m(_STEM, P.TEST_STEM)})"
_IS_VENDOR = _dir_in(P.VENDOR_DIRS)
_IS_EXAMPLE = _dir_in(P.EXAMPLE_DIRS)
_IS_DEMO = "(" + " OR ".join(f"contains(lower(path), {q(p)})" for p in P.DEMO_PATH_PARTS) + ")"
_IS_BENCH = _segment(P.BENCHMARK_SEGMENTS, "lower(path)")
_IS_GENERATED = (
    "(" + " OR ".join(f"ends_with(path, {q(s)})" for s in P.MINIFIED_SUFFIXES) + " OR "
    + _segment(P.GENERATED_SEGMENTS, "path") + ")"
)
_LONG_LINE = f"(len(list_filter(lines, lambda l: length(l) > {P.MINIFIED_LINE_LENGTH})) > 0)"

SPLIT = f"""
split AS (SELECT *, {lines_of('code')} AS lines FROM files)"""


def scanned(skip: bool = True) -> str:
    """Flags per file and one row per line of the files that are scanned."""
    where = f"WHERE NOT {_IS_GENERATED} AND NOT {_IS_VENDOR} AND NOT {_LONG_LINE}" if skip else ""
    return f"""{SPLIT},
flagged AS (
  SELECT repo, path, language, code, lines, array_to_string(lines, chr(10)) AS txt,
         {_IS_TEST} AS is_test, {_IS_EXAMPLE} AS is_example, {_IS_DEMO} AS is_demo,
         {_IS_BENCH} AS is_bench
  FROM split {where}),
ln AS (
  SELECT f.*, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM flagged f)"""


def with_(ctes: list[str], select: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",".join(c.strip("\n") for c in ctes) + "\n" + select


_KEYS = "repo, path, CAST(n AS INTEGER) AS line_no"


def found(rule: str, severity: str, variant: str, evidence: str, source: str, where: str,
          line: str | None = None) -> str:
    return (
        f"SELECT {_KEYS}, '{rule}' AS rule_id, {severity} AS severity, {variant} AS variant, "
        f"{evidence} AS evidence, {line or strip('line')} AS line FROM {source} WHERE {where}"
    )


# --- detectors: (extra tables, select) -----------------------------------------------

_SCRIPT = "language IN ('javascript', 'typescript')"
_PYTHON = "language = 'python'"
_BY_LANGUAGE = f"CASE WHEN {_PYTHON} THEN 'python' ELSE 'script' END"


def _not(*conditions: str) -> str:
    return " AND ".join(f"NOT ({c})" for c in conditions)


def _real(value: str) -> str:
    return (
        f"NOT ({m(value, P.SAFE_DEFAULT)} OR {m(value, '[^\\x00-\\x7F]')} "
        f"OR lower({value}) IN {words_in(P.STATUS_WORDS)})"
    )


def _fallback() -> str:
    js = strip(x("line", P.FALLBACK_JS, 1))
    branches = [
        f"WHEN {m('line', P.FALLBACK_JS)} AND {m('line', P.CREDENTIAL_NAME)} AND {_real(js)} THEN {js}"
    ]
    for pattern in (P.FALLBACK_PY, P.FALLBACK_PY_OR, P.FALLBACK_DESTRUCTURED):
        value = strip(x("line", pattern, 2))
        branches.append(
            f"WHEN {m(x('line', pattern, 1), P.CREDENTIAL_NAME)} AND {_real(value)} THEN {value}"
        )
    return "CASE " + " ".join(branches) + " END"


_FIXED = "(" + " OR ".join(f"contains(line, {q(k)})" for k in P.FIXED_FORMAT_MARKS) + ")"
_CREDENTIALS_ALLOWED = f"(NOT is_test OR (NOT is_example AND {_FIXED}))"
_DEMO = "(is_demo AND NOT is_test)"
_C001_LINES = f"""
cred AS (
  SELECT *, {_fallback()} AS fallback FROM ln
  WHERE NOT {m('line', P.COMMENT_CREDENTIAL)} AND NOT {m('line', P.DOC_EXAMPLE)}
    AND {_CREDENTIALS_ALLOWED})"""


def fallback_secret():
    return [_C001_LINES], found(
        "C001", f"CASE WHEN {_DEMO} THEN 'low' ELSE 'medium' END",
        f"CASE WHEN {_DEMO} THEN 'fallback-demo' ELSE 'fallback' END", "fallback", "cred",
        "fallback IS NOT NULL",
    )


def _harmless(value: str, extra: list[str]) -> str:
    tests = [
        m(value, P.PLACEHOLDER_VALUE), m(value, "[^\\x00-\\x7F]"),
        f"lower({value}) IN {words_in(P.STATUS_WORDS)}", m(value, P.BCRYPT_HASH),
        m(value, P.ENV_NAME_VALUE), *extra,
    ]
    return f"(coalesce({value}, '') <> '' AND (" + " OR ".join(tests) + "))"


_LABEL = (
    "(value <> '' AND NOT regexp_matches(value, '[^\\x00-\\x7F]|[0-9]') AND len(list_filter("
    "string_split(value, ' '), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g') NOT IN ("
    "lower(regexp_replace(w, '[^A-Za-z]', '', 'g')), upper(regexp_replace(w, '[^A-Za-z]', '', 'g')), "
    "upper(left(regexp_replace(w, '[^A-Za-z]', '', 'g'), 1)) || "
    "lower(substr(regexp_replace(w, '[^A-Za-z]', '', 'g'), 2))))) = 0)"
)


def raw_credential():
    which = "CASE " + " ".join(
        f"WHEN {m('line', p)} THEN {i}" for i, (p, _) in enumerate(P.RAW_CREDENTIALS)
    ) + " END"
    span = "CASE which " + " ".join(
        f"WHEN {i} THEN {x('line', p)}" for i, (p, _) in enumerate(P.RAW_CREDENTIALS)
    ) + " END"
    names = "CASE which " + " ".join(
        f"WHEN {i} THEN {q(d)}" for i, (_, d) in enumerate(P.RAW_CREDENTIALS)
    ) + " END"
    key = "split_part(line, CASE WHEN contains(line, ':') THEN ':' ELSE '=' END, 1)"
    label = f"({_LABEL} AND (contains(value, ' ') OR {m(key, P.UI_KEY_HINT)}))"
    message = (
        f"len(list_filter(regexp_extract_all(line, {q(P.QUOTED_VALUE)}, 1), "
        f"lambda v: {m('v', P.VALIDATION_MESSAGE)})) > 0"
    )
    tables = [
        _C001_LINES,
        f"raw1 AS (SELECT *, {which} AS which FROM cred WHERE fallback IS NULL)",
        f"raw2 AS (SELECT *, {span} AS span, {names} AS form FROM raw1 WHERE which IS NOT NULL)",
        f"raw3 AS (SELECT *, regexp_extract_all(span, {q(P.QUOTED_VALUE)}, 1)[-1] AS value FROM raw2)",
    ]
    where = _not(
        m("line", P.SAFE_SOURCE), m("line", P.PLACEHOLDER_NAME), m("line", P.API_DOC_CONTEXT),
        m(win(5, 0), P.API_DOC_CONTEXT), f"contains(line, {q(P.SAMPLE_JWT)})",
        m(win(4, 2), P.PUBLIC_SEARCH_KEY), m(win(19, 0), P.ENUM_CLASS), message,
        f"coalesce({_harmless('value', [label])}, false)", m("line", P.REDACTION_ASSERT),
        f"which = {len(P.RAW_CREDENTIALS) - 1} AND {m(win(5, 2), P.SESSION_CONTEXT)}",
    )
    return tables, found(
        "C001", f"CASE WHEN {_DEMO} THEN 'low' ELSE 'high' END",
        f"CASE WHEN {_DEMO} THEN 'raw-demo' ELSE 'raw' END", "form", "raw3", where,
    )


def session_secret():
    value = x("assigned", P.QUOTED_VALUE, 1)
    tables = [
        f"""ses AS (
  SELECT *, CASE WHEN {_PYTHON} THEN {x('line', P.PY_APP_CONFIG_SECRET, 1)} ELSE '' END AS cfg,
         CASE WHEN {m('line', P.SESSION_SECRET)} THEN {x('line', P.SESSION_SECRET)}
              WHEN {m('line', P.COOKIE_PARSER_SECRET)} THEN {x('line', P.COOKIE_PARSER_SECRET)}
              WHEN {_PYTHON} AND {m('line', P.PY_SECRET_KEY)} THEN {x('line', P.PY_SECRET_KEY)}
         END AS assigned
  FROM ln WHERE NOT {m('line', P.COMMENT_COMMON)} AND NOT is_test)"""
    ]
    config = f"cfg <> '' AND NOT {m('line', P.ENV_SOURCE)} AND NOT {m('cfg', P.SAFE_DEFAULT)}"
    plain = (
        "cfg = '' AND assigned IS NOT NULL AND "
        + _not(m("line", P.SAFE_SOURCE), m("line", P.PLACEHOLDER_NAME),
               _harmless(value, [m(value, P.SAFE_DEFAULT)]))
        + f" AND {m(win(4, 1), P.SESSION_CONTEXT)}"
    )
    return tables, found("C002", "'high'", "''", "''", "ses", f"({config}) OR ({plain})")


def _security_name(name: str) -> str:
    words = (
        f"string_split(lower(replace(regexp_replace({name}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), "
        "'-', '_')), '_')"
    )
    return (
        f"(NOT list_has_any({words}, {listed(P.RANDOM_QUANTITIES)}) AND "
        f"(list_has_any({words}, {listed(P.RANDOM_FIRE_WORDS)}) OR "
        f"(list_has_any({words}, ['key', 'id']) AND "
        f"list_has_any({words}, {listed(P.RANDOM_QUALIFIERS)}))))"
    )


def weak_randomness():
    call = "CASE " + " ".join(
        f"WHEN {m('line', p)} THEN {q(name)}" for p, name in P.WEAK_RANDOM
    ) + " END"
    low = f"({m('line', P.ANALYTICS_ID)} OR {m(win(2, 2), P.DRAFT_CONTEXT)})"
    tables = [f"rnd AS (SELECT *, {call} AS call, {low} AS low FROM ln WHERE NOT is_bench)"]
    where = (
        "call IS NOT NULL AND "
        + _not(
            m("line", P.COMMENT_COMMON), m("line", P.RANDOM_SAFE_LINE), m(win(2, 2), P.CRYPTO_GUARD),
            f"{m('line', P.USE_STATE)} AND NOT {_security_name(x('line', P.USE_STATE_NAME, 1))}",
        )
        + f" AND {_security_name(x('line', P.ASSIGN_TARGET, 1))}"
    )
    return tables, found(
        "R001", "CASE WHEN low THEN 'low' ELSE 'high' END",
        f"CASE WHEN low THEN 'low-' ELSE 'high-' END || {_BY_LANGUAGE}", "call", "rnd", where,
    )


def timing_comparison():
    """Recursive: digest assignments of a file are walked in order, collecting the MAC names."""
    name = f"{x('line', P.DIGEST_ASSIGN, 1)} || {x('line', P.DIGEST_ASSIGN, 2)}"
    right = f"regexp_replace(line, {q('^.*?(?:' + P.DIGEST_ASSIGN + ')')}, '')"
    tables = [
        f"""dig AS (
  SELECT repo, path, n, {name} AS name, {m('line', P.HMAC_CALL)} AS direct,
         regexp_extract_all({right}, '\\w+') AS uses,
         row_number() OVER (PARTITION BY repo, path ORDER BY n) AS k
  FROM ln WHERE {m('line', P.DIGEST_CALL)} AND NOT {m('line', P.COMMENT_COMMON)} AND {name} <> '')""",
        """walk(repo, path, k, names, since) AS (
  SELECT repo, path, CAST(0 AS BIGINT), []::VARCHAR[], []::BIGINT[] FROM dig WHERE k = 1
  UNION ALL
  SELECT d.repo, d.path, d.k,
         CASE WHEN d.direct OR list_has_any(w.names, d.uses) THEN list_append(w.names, d.name) ELSE w.names END,
         CASE WHEN d.direct OR list_has_any(w.names, d.uses) THEN list_append(w.since, d.n) ELSE w.since END
  FROM walk w JOIN dig d ON d.repo = w.repo AND d.path = w.path AND d.k = w.k + 1)""",
        """macs AS (
  SELECT repo, path, unnest(names) AS name, unnest(since) AS since FROM walk w
  WHERE k = (SELECT max(k) FROM dig d WHERE d.repo = w.repo AND d.path = w.path))""",
        f"""cmp AS (
  SELECT *, regexp_extract_all(line, '\\w+') AS used, {m(win(2, 3), P.REQUEST_VALUE)} AS near
  FROM ln WHERE {m('line', P.EQUALITY)} AND NOT {m('line', P.COMMENT_COMMON)})""",
    ]
    mac = (
        "EXISTS (SELECT 1 FROM macs a WHERE a.repo = c.repo AND a.path = c.path AND a.since <= c.n "
        "AND list_contains(c.used, a.name))"
    )
    digest = (
        "EXISTS (SELECT 1 FROM dig a WHERE a.repo = c.repo AND a.path = c.path AND a.n <= c.n "
        "AND list_contains(c.used, a.name))"
    )
    literal = (
        f"{m('line', P.LITERAL_COMPARE)} AND {m('line', P.WEBHOOK_LITERAL_COMPARE)} "
        f"AND NOT {m('line', P.REQUEST_VALUE)}"
    )
    where = (
        f"({m('line', P.DIGEST_CALL)} OR {mac} OR (near AND {digest}) "
        f"OR (near AND {m('line', P.WEBHOOK_NAME)})) AND "
        + _not(m(win(2, 3), P.CONSTANT_TIME_CALL), m("line", P.TYPEOF_GUARD), literal)
    )
    return tables, found("R002", "'high'", _BY_LANGUAGE, "''", "cmp c", where)


def gcm_tag_length():
    where = (
        f"{_SCRIPT} AND NOT is_test AND {m('line', P.GCM_DECIPHER)} AND "
        + _not(m("line", P.COMMENT_SCRIPT), m(win(-1, 20), P.GCM_TAG_LENGTH))
    )
    return [], found("R003", "'high'", "''", "''", "ln", where)


def unverified_token():
    where = (
        f"({_PYTHON} AND {m('line', P.JWT_DECODE_PYTHON)}) OR ({_SCRIPT} AND {m('txt', P.JWT_IMPORT)} "
        f"AND NOT {m('txt', P.JWT_VERIFY)} AND {m('line', P.JWT_DECODE)})"
    )
    return [], found("A002", "'high'", _BY_LANGUAGE, "''", "ln", where, rstrip("line"))


def tls_disabled():
    way = (
        f"CASE WHEN {_SCRIPT} AND {m('line', P.TLS_REJECT_FLAG)} THEN 'script' "
        f"WHEN {_SCRIPT} AND {m('line', P.TLS_REJECT_ENV)} THEN 'env' "
        f"WHEN {_PYTHON} AND {m('line', P.TLS_PYTHON)} THEN 'python' END"
    )
    # The guard is looked up with a window frame here.
    tables = [
        f"""tls AS (
  SELECT *, {way} AS way, {m('''string_agg(line, chr(10)) OVER (
           PARTITION BY repo, path ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)''', P.TLS_DEV_GUARD)} AS guarded
  FROM ln WHERE NOT is_test)"""
    ]
    return tables, found(
        "C003", "CASE WHEN guarded THEN 'low' ELSE 'high' END",
        "way || CASE WHEN guarded THEN '-guarded' ELSE '' END", "''", "tls",
        f"way IS NOT NULL AND NOT {m('line', P.COMMENT_COMMON)}", rstrip("line"),
    )


def sql_injection():
    quiet = f"({m('line', P.COMMENT_COMMON)} OR {m('line', P.REPORTING_LINE)})"

    def sql_taint(window: str) -> str:
        return f"({taint(window)} OR ({_PYTHON} AND {m(window, P.SQL_SETTINGS)}))"

    direct = (
        f"{any_of('line', P.SQL_BUILDERS)} AND "
        + _not(m("line", P.SQL_TAGGED_TEMPLATE), m("line", P.BROWSER_DIALOG))
        + f" AND {m('w', P.SQL_CONTEXT)} AND {sql_taint('w')}"
    )
    # Band join: the assignment lies 1 to 14 lines above the call.
    tables = [
        f"sqlf AS (SELECT *, {win(4, 5)} AS w, {win(19, 2)} AS wide FROM ln WHERE {m('txt', P.SQL_SINK)})",
        f"""asg AS (
  SELECT repo, path, n, {x('line', P.SQL_FSTRING_ASSIGN, 1)} AS var FROM sqlf
  UNION ALL SELECT repo, path, n, {x('line', P.SQL_CONCAT_ASSIGN, 1)} FROM sqlf)""",
        f"""via AS (
  SELECT DISTINCT c.repo, c.path, c.n
  FROM sqlf c JOIN asg a ON a.repo = c.repo AND a.path = c.path AND a.n BETWEEN c.n - 14 AND c.n - 1
    AND a.var = {x('c.line', P.EXECUTED_NAME, 1)} AND a.var <> '')""",
        f"""sql2 AS (
  SELECT s.*, CASE WHEN {direct} THEN 'direct'
         WHEN v.n IS NOT NULL AND {sql_taint('wide')} THEN 'variable' END AS way
  FROM sqlf s LEFT JOIN via v ON v.repo = s.repo AND v.path = s.path AND v.n = s.n WHERE NOT {quiet})""",
    ]
    return tables, found("I001", "'high'", "way", "''", "sql2", "way IS NOT NULL")


def command_injection():
    where = (
        f"NOT is_test AND {any_of('line', P.COMMAND_CALLS)} AND "
        + _not(m("line", P.COMMENT_COMMON), m("line", P.REPORTING_LINE), m(win(4, 5), P.SHELL_WRAPPER))
        + f" AND {taint(win(4, 5))}"
    )
    return [], found("I002", "'high'", "''", "''", "ln", where)


def code_injection():
    where = (
        f"NOT is_bench AND {any_of('line', P.CODE_CALLS)} AND "
        + _not(
            m("line", P.COMMENT_COMMON), m("line", P.REPORTING_LINE), m("line", P.EVAL_IN_STRING),
            m("line", P.BROWSER_EVAL), m("line", P.LITERAL_IMPORT), m(win(4, 5), P.SHELL_WRAPPER),
            m(win(19, 3), P.BUILTIN_SHADOW),
        )
        + f" AND {taint(win(4, 5))}"
    )
    return [], found("I003", "'high'", "''", "''", "ln", where)


def nosql_injection():
    where = (
        f"{any_of('line', P.NOSQL_CALLS)} AND NOT {m('line', P.COMMENT_COMMON)} "
        f"AND {taint(win(4, 5))}"
    )
    return [], found("I004", "'high'", "''", "''", "ln", where)


def prototype_pollution():
    tables = [
        f"""brk AS (
  SELECT *, {x('line', P.BRACKET_ASSIGN, 1)} AS receiver, {x('line', P.BRACKET_ASSIGN, 2)} AS key,
         {win(15, 0)} AS w
  FROM ln WHERE {_SCRIPT} AND NOT is_test AND {m('line', P.BRACKET_ASSIGN)}
    AND NOT {m('line', P.COMMENT_SCRIPT)})""",
        f"""typed AS (
  SELECT *, regexp_extract_all(w, {q(P.TYPED_DECLARATION)}, 1) AS names,
         regexp_extract_all(w, {q(P.TYPED_DECLARATION)}, 2) AS types FROM brk)""",
    ]
    base = "split_part(receiver, '.', 1)"
    closed = (
        f"len(list_filter(range(1, len(names) + 1), lambda i: names[i] = {base} "
        f"AND NOT {m('types[i]', P.OPEN_TYPE)})) > 0"
    )
    where = (
        _not(
            f"receiver IN {words_in(P.DECLARATION_WORDS + P.SAFE_RECEIVER_NAMES)}",
            m("key", "^\\d+$"), m("key", P.LOOP_INDEX), m("receiver", P.SAFE_RECEIVER),
            m("w", P.OWN_PROPERTY_CHECK), m("w", P.ALLOW_LIST_CHECK), m("w", P.NULL_PROTOTYPE),
            f"{x('w', P.MAP_DECLARATION, 1)} = {base}", closed,
        )
        + f" AND ({m('key', P.REQUEST_KEY)} OR {m('w', P.WEB_INPUT)} "
        f"OR ({m('w', P.HANDLER_SIGNATURE)} AND {taint('w')}))"
    )
    return tables, found("I005", "'high'", "''", "''", "typed", where)


def path_traversal():
    where = (
        f"{m('line', P.FILE_SINK)} AND {m('line', P.PATH_BUILD)} AND "
        + _not(m("path", P.PACKAGING_FILES), m("line", P.COMMENT_COMMON), m(win(5, 6), P.PATH_SANITIZER))
        + f" AND {taint(win(5, 6))}"
    )
    return [], found("T001", "'high'", "''", "''", "ln", where)


def _access_tables() -> list[str]:
    import_line = (
        f"(regexp_matches({strip('l')}, '^(?:import |from )') OR contains(l, 'require(')) "
        f"AND {m(strip('l'), P.ROUTER_LEVEL_AUTH)}"
    )
    return [
        f"""hnd AS (
  SELECT repo, path, min(n) AS handler FROM ln
  WHERE {_SCRIPT} AND {m('line', P.SERVERLESS_EXPORT)} GROUP BY repo, path)""",
        f"""acc AS (
  SELECT l.*, h.handler,
         {m('array_to_string(l.lines[1:50], chr(10))', P.ROUTER_LEVEL_AUTH)}
         OR len(list_filter(l.lines, lambda l: {import_line})) > 0 AS central
  FROM ln l LEFT JOIN hnd h ON h.repo = l.repo AND h.path = l.path
  WHERE NOT is_test AND {_not(m('l.path', P.ROUTE_UTILITY_DIRS), m('l.path', P.ROUTE_UTILITY_FILES),
                              m('l.path', P.ROUTE_PUBLIC_DIRS))})""",
    ]


def open_serverless_handler():
    inbound = f"regexp_replace(txt, {q(P.OUTBOUND_AUTH)}, '', 'g')"
    where = (
        f"n = handler AND {m('txt', P.SENSITIVE_OPERATION)} "
        f"AND NOT ({m('txt', P.AUTH_WORDS)} AND {m(inbound, P.AUTH_WORDS)}) "
        f"AND NOT {m(win(-1, 10), P.INLINE_AUTH)}"
    )
    return _access_tables(), found(
        "A001", "CASE WHEN central THEN 'low' ELSE 'medium' END",
        "CASE WHEN central THEN 'handler-router' ELSE 'handler' END", "''", "acc", where,
    )


def open_route(public: str = P.PUBLIC_ROUTE):
    is_route = (
        f"CASE language WHEN 'python' THEN {m('line', P.ROUTES['python'])} "
        f"WHEN 'typescript' THEN {m('line', P.ROUTES['typescript'])} "
        f"ELSE {m('line', P.ROUTES['javascript'])} END"
    )
    tables = _access_tables() + [
        f"""rt AS (
  SELECT *, greatest(1, n - 60) AS top,
         list_max(list_filter(range(greatest(1, n - 60), n), lambda i: {m('lines[i]', P.CLASS_LINE)})) AS cls
  FROM acc WHERE handler IS NULL AND {is_route} AND {_not(
      m('line', P.COMMENT_ROUTE), m('line', P.WILDCARD_ROUTE), m('line', public),
      m('line', P.HEALTH_ROUTE), m('line', P.HIDDEN_ROUTE))})""",
        f"""rt2 AS (
  SELECT *, CASE WHEN central THEN 'route-router'
         WHEN {m('line', P.PUBLIC_BY_NAME)} AND {m(win(10, 9), P.RATE_LIMIT_SIGN)} THEN 'route-public-limited'
         WHEN {m('line', P.PUBLIC_BY_NAME)} THEN 'route-public'
         WHEN {m(win(10, 9), P.RATE_LIMIT_SIGN)} THEN 'route-limited' ELSE 'route' END AS way
  FROM rt WHERE {m(win(0, 29), P.SENSITIVE_OPERATION)} AND {_not(
      m('line', P.ROUTE_LINE_AUTH), m(win(0, 29), P.AUTH_WORDS), m(win(-1, 10), P.INLINE_AUTH),
      m("array_to_string(lines[coalesce(cls, top) : n - 1], chr(10))", P.AUTH_WORDS),
      "cls IS NOT NULL AND "
      + m("array_to_string(lines[greatest(top, cls - 10) : cls - 1], chr(10))", P.AUTH_WORDS),
      m(win(3, 0), P.PUBLIC_NOTE))})""",
    ]
    return tables, found(
        "A001", "CASE WHEN way = 'route' THEN 'medium' ELSE 'low' END", "way", "''", "rt2", "true"
    )


_DETECTORS = {
    "fallback_secret": fallback_secret,
    "raw_credential": raw_credential,
    "weak_randomness": weak_randomness,
    "timing_comparison": timing_comparison,
    "gcm_tag_length": gcm_tag_length,
    "unverified_token": unverified_token,
    "tls_disabled": tls_disabled,
    "sql_injection": sql_injection,
    "command_injection": command_injection,
    "code_injection": code_injection,
    "nosql_injection": nosql_injection,
    "prototype_pollution": prototype_pollution,
    "path_traversal": path_traversal,
    "session_secret": session_secret,
    "open_serverless_handler": open_serverless_handler,
    "open_route": open_route,
}


def _detector_sql(source: str, name: str, skip: bool = True) -> str:
    tables, select = _DETECTORS[name]()
    return with_([source, scanned(skip), *tables], select, recursive=name == "timing_comparison")


def all_findings(source: str, skip: bool = True) -> list[str]:
    """Tables up to ``found_all``: the findings of every detector."""
    tables: list[str] = []
    selects: list[str] = []
    for build in _DETECTORS.values():
        extra, select = build()
        tables += [t for t in extra if t not in tables]
        selects.append(select)
    # The route variant of the shared line tables is computed once.
    unique: dict[str, str] = {}
    for table in tables:
        unique.setdefault(table.strip().split(" AS ", 1)[0], table)
    return [source, scanned(skip), *unique.values(), "found_all AS (" + "\nUNION ALL\n".join(selects) + ")"]


# --- repository rules ------------------------------------------------------------------

LISTING = """
listing AS (
  SELECT repo, path FROM corpus
  UNION ALL SELECT DISTINCT repo, 'site/core/settings.py' FROM corpus WHERE p_size % 2 = 0
  UNION ALL SELECT DISTINCT repo, 'package.json' FROM corpus WHERE p_size % 3 <> 0
  UNION ALL SELECT DISTINCT repo, 'site/core/localmod.py' FROM corpus
  UNION ALL SELECT DISTINCT repo, 'ghost_3/core.py' FROM corpus)"""


def _dir(path: str) -> str:
    return f"regexp_extract({path}, '^(.*)/[^/]*$', 1)"


def _climb(source: str) -> str:
    """(repo, dir, depth, anc): the directory and up to nine parents."""
    segs = "(CASE WHEN dir = '' THEN []::VARCHAR[] ELSE string_split(dir, '/') END)"
    return (
        f"SELECT repo, dir, d AS depth, array_to_string({segs}[1:len({segs}) - d], '/') AS anc "
        f"FROM {source}, (SELECT unnest(range(0, {P.MAX_ANCESTORS})) AS d) WHERE d <= len({segs})"
    )


DJANGO = f"""
holders AS (
  SELECT DISTINCT repo, CASE WHEN regexp_matches(path, '(?:^|/)settings\\.py$') THEN {_dir('path')}
    ELSE {_dir(_dir('path'))} END AS holder
  FROM listing WHERE regexp_matches(path, '(?:^|/)settings\\.py$|(?:^|/)settings/[^/]+\\.py$')),
anchors AS (
  SELECT repo, holder AS anc FROM holders
  UNION SELECT repo, {_dir('holder')} FROM holders
  WHERE holder <> '' AND NOT regexp_matches(holder, '(?:^|/)\\.[^/]*$')),
pydirs AS (SELECT DISTINCT repo, {_dir('path')} AS dir FROM listing WHERE ends_with(path, '.py')),
pyclimb AS ({_climb('pydirs')}),
django AS (SELECT DISTINCT c.repo, c.dir FROM pyclimb c JOIN anchors a ON a.repo = c.repo AND a.anc = c.anc)"""

RAW = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo, path, rule_id ORDER BY line_no) AS rk FROM found_all),
raw AS (
  SELECT r.repo, r.path, r.line_no, r.rule_id,
    CASE WHEN d.dir IS NOT NULL AND r.rule_id = 'A001' AND r.path LIKE '%.py' THEN 'low' ELSE r.severity END AS severity,
    CASE WHEN d.dir IS NOT NULL AND r.rule_id = 'A001' AND r.path LIKE '%.py' THEN 'route-django' ELSE r.variant END AS variant,
    r.evidence, r.line
  FROM ranked r LEFT JOIN django d ON d.repo = r.repo AND d.dir = {_dir('r.path')}
  WHERE r.rule_id <> 'A001' OR r.rk = 1)"""


def raw_tables() -> list[str]:
    return [*all_findings(CORPUS), LISTING, DJANGO, RAW]


def raw_sql(select: str, *more: str) -> str:
    return with_([*raw_tables(), *more], select, recursive=True)


REGISTRY = f"""
registry AS (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem,
         'ghost_' || (p_partkey % {GHOSTS}) AS name, p_partkey % 3 <> 0 AS is_known,
         TIMESTAMP '{REGISTRY_AS_OF}' - to_hours(CAST(p_partkey % 30 AS INTEGER)) AS checked_at
  FROM part),
fresh AS (
  SELECT ecosystem, name, is_known, checked_at FROM (
    SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY checked_at DESC, is_known DESC) AS rk
    FROM registry) WHERE rk = 1 AND checked_at >= TIMESTAMP '{REGISTRY_AS_OF}' - INTERVAL 24 HOURS)"""

_MODULE = f"CASE WHEN {_PYTHON} THEN {x('line', P.PY_IMPORT, 1)} ELSE {x('line', P.JS_IMPORT, 1)} END"
IMPORTS = f"""{SPLIT},
every AS (SELECT repo, path, language, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM split),
mods AS (SELECT *, {_MODULE} AS module FROM every),
imps AS (
  SELECT repo, path, CASE WHEN {_PYTHON} THEN 'pypi' ELSE 'npm' END AS ecosystem,
         CASE WHEN {_PYTHON} THEN split_part(module, '.', 1)
              WHEN module LIKE '@%' AND contains(module, '/')
              THEN split_part(module, '/', 1) || '/' || split_part(module, '/', 2)
              WHEN module LIKE '@%' THEN module
              ELSE split_part(module, '/', 1) END AS package,
         CAST(n AS INTEGER) AS line_no, {strip('line')} AS line
  FROM mods
  WHERE module <> '' AND CASE WHEN {_PYTHON} THEN split_part(module, '.', 1) NOT IN {words_in(P.PYTHON_STDLIB)}
        ELSE module NOT IN {words_in(P.JS_BUILTINS)} AND module NOT LIKE '@/%' END),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, ecosystem, package ORDER BY line_no) AS rk
                 FROM imps) WHERE rk = 1),
unaliased AS (
  SELECT * FROM imps WHERE ecosystem = 'npm' OR (package NOT IN {words_in(list(P.IMPORT_ALIASES))}
    AND lower(package) NOT IN {words_in(list(P.IMPORT_ALIASES))}))"""

ROOTS = f"""
dirs AS (SELECT DISTINCT repo, {_dir('path')} AS dir FROM listing),
climb AS ({_climb('dirs')}),
marked AS (
  SELECT DISTINCT repo, {_dir('path')} AS anc FROM listing
  WHERE regexp_extract(path, '[^/]*$') IN {words_in(P.ROOT_MARKERS)}),
roots AS (
  SELECT c.repo, c.dir, arg_min(c.anc, c.depth) AS root
  FROM climb c JOIN marked k ON k.repo = c.repo AND k.anc = c.anc GROUP BY c.repo, c.dir),
prefixes AS (SELECT DISTINCT repo, anc FROM (
  SELECT repo, array_to_string(string_split(dir, '/')[1:k], '/') AS anc
  FROM dirs, (SELECT unnest(range(1, 20)) AS k) WHERE dir <> '' AND k <= len(string_split(dir, '/')))),
modules AS (
  SELECT repo, {_dir('anc')} AS dir, regexp_extract(anc, '[^/]*$') AS module FROM prefixes
  UNION SELECT repo, {_dir('path')}, regexp_extract(path, '([^/]+)\\.py$', 1) FROM listing
  WHERE regexp_matches(path, '[^/]\\.py$'))"""

LOCAL = f"""
nonlocal AS (
  SELECT i.* FROM unaliased i LEFT JOIN roots r ON r.repo = i.repo AND r.dir = {_dir('i.path')}
  WHERE NOT EXISTS (SELECT 1 FROM modules k WHERE k.repo = i.repo AND k.dir = r.root AND k.module = i.package)
    AND NOT EXISTS (SELECT 1 FROM modules k WHERE k.repo = i.repo AND r.root IS NOT NULL
                    AND k.dir = {_dir('i.path')} AND k.module = i.package))"""

UNKNOWN = f"""
unknown AS (
  SELECT repo, path, line_no, 'P001' AS rule_id, 'high' AS severity, ecosystem AS variant,
         package AS evidence, line
  FROM (SELECT l.*, row_number() OVER (PARTITION BY l.repo, l.path, l.package ORDER BY l.line_no) AS rk
        FROM nonlocal l JOIN fresh f ON f.ecosystem = l.ecosystem AND NOT f.is_known
         AND f.name = CASE WHEN l.ecosystem = 'pypi' THEN lower(replace(l.package, '-', '_')) ELSE l.package END
        WHERE NOT (list_contains(string_split(l.path, '/'), 'migrations') AND l.path LIKE '%.py'))
  WHERE rk = 1)"""


# --- whole scans -------------------------------------------------------------------------

_RULE_ROWS = ", ".join(
    f"({q(r)}, {s}, {q(c)}, {q(w)}, {q(o)}, {k})" for r, s, c, w, o, k in RULES
)
_MESSAGE_ROWS = ", ".join(
    f"({q(r)}, {q(v)}, {q(t)}, {q(d)}, {q(f)})" for r, v, t, d, f in MESSAGES
)
_SEV = "CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


LARGE = """
files AS (
  SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'mono' ELSE 'r' || (l_orderkey % 4) END AS repo,
         ['src', 'venv', 'lib', 'app/vendor', 'app', 'web'][l_orderkey % 6 + 1] || '/f' || l_orderkey || '_' || l_linenumber
         || ['.py', '.js', '.PY', '.md', '.ts'][l_linenumber % 5 + 1] AS path,
         CAST(max(l_partkey * 131 % 260000) AS BIGINT) AS size_bytes FROM lineitem GROUP BY 1, 2)"""


def _scope_sql(name: str, source: str) -> str:
    limit = PROFILES[name].max_files
    cut = f"any_value(s.n > {limit})" if limit else "false"
    counted = "inscope" if not PROFILES[name].size_before_cap else f"(SELECT * FROM inscope WHERE {_small(name)})"
    return _selected_sql(
        name, f"SELECT s.repo, count(c.path) AS files_scanned, {cut} AS truncated FROM "
        f"(SELECT repo, count(*) AS n FROM {counted} GROUP BY repo) s LEFT JOIN chosen c ON s.repo = c.repo GROUP BY s.repo",
        source,
    )


def _small(name: str) -> str:
    limit = PROFILES[name].max_bytes
    return f"size_bytes <= {limit}" if limit else "true"


def _selected_sql(name: str, select: str | None = None, source: str = CORPUS) -> str:
    """Files a profile reads, as a chain of tables ending in ``chosen``."""
    profile = PROFILES[name]
    suffix = f"lower({_SUFFIX})" if profile.fold_suffix_case else _SUFFIX
    tables = [
        source,
        f"""inscope AS (
  SELECT * FROM files WHERE {_SUFFIX_CASE.format(suffix=suffix)} IS NOT NULL
    AND NOT list_has_any(string_split(path, '/'), {listed(list(profile.skip_dirs))}))""",
    ]
    small = f"size_bytes <= {profile.max_bytes}" if profile.max_bytes else "true"
    before = small if profile.size_before_cap else "true"
    tables.append(
        f"""chosen AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS rk
                 FROM inscope WHERE {before})
  WHERE {small} AND rk <= {profile.max_files or 10**9})"""
    )
    return with_(tables, select or "SELECT repo, path, language, size_bytes FROM chosen")


_DIR_SKIP = f"NOT list_has_any(string_split(path, '/'), {listed(P.DIRECTORY_SKIP_DIRS)})"


def directory_tables() -> list[str]:
    """The directory profile end to end: ``scanned_files`` and ``final`` findings."""
    source = CORPUS.replace(
        "files AS (\n  SELECT repo, path,", f"files AS (\n  SELECT * FROM (SELECT repo, path,"
    ).rstrip(")") + f") WHERE language IS NOT NULL AND {_DIR_SKIP})"
    chain = [*all_findings(source), LISTING, DJANGO, RAW]
    imports = IMPORTS.replace(SPLIT + ",", "")
    return [
        *chain, REGISTRY, imports, ROOTS, LOCAL, UNKNOWN,
        f"authed AS (SELECT DISTINCT repo FROM files WHERE {m('code', P.AUTH_WORDS)})",
        """final0 AS (
  SELECT * FROM raw WHERE rule_id <> 'A001' OR repo IN (SELECT repo FROM authed)
  UNION ALL SELECT repo, path, line_no, rule_id, severity, variant, evidence, line FROM unknown)""",
        f"rules(rule_id, rule_seq, vuln_class, cwe, owasp_category, owasp_rank) AS (VALUES {_RULE_ROWS})",
        f"""final AS (
  SELECT f.*, CAST({_SEV} AS INTEGER) AS sev_rank, r.rule_seq, r.vuln_class, r.cwe, r.owasp_category,
         CAST(r.owasp_rank AS INTEGER) AS owasp_rank
  FROM final0 f JOIN rules r ON r.rule_id = f.rule_id)""",
    ]


def directory_sql(select: str, *more: str) -> str:
    return with_([*directory_tables(), *more], select, recursive=True)


#: The corpus as it stands after each of three batches: the step is part of the repository's name.
STEPS = CORPUS.replace(
    "SELECT repo_kind || CAST(p_size AS VARCHAR) AS repo,",
    "SELECT repo_kind || CAST(p_size AS VARCHAR) || '#' || CAST(step AS VARCHAR) AS repo,",
).replace(
    f"{_filled('scode')} AS code,",
    f"CASE WHEN step = 2 AND p_partkey % 6 = 0 THEN '' ELSE {_filled('scode')} END AS code,",
).replace("FROM part JOIN", "FROM (VALUES (0), (1), (2)) AS steps(step) JOIN part ON p_partkey % 3 <= step JOIN")


def changes_sql() -> str:
    columns = "repo, path, line_no, rule_id, severity, variant, evidence, line"
    return with_(
        [
            *all_findings(STEPS), "listing AS (SELECT repo, path FROM corpus)", DJANGO, RAW, REGISTRY,
            IMPORTS.replace(SPLIT + ",", ""), ROOTS, LOCAL, UNKNOWN,
            f"authed AS (SELECT DISTINCT repo FROM files WHERE {m('code', P.AUTH_WORDS)})",
            f"""tagged AS (
  SELECT {columns} FROM raw WHERE rule_id <> 'A001' OR repo IN (SELECT repo FROM authed)
  UNION ALL SELECT {columns} FROM unknown)""",
            f"""views AS (
  SELECT CAST(split_part(repo, '#', 2) AS INTEGER) AS step, split_part(repo, '#', 1) AS repo,
         {columns.removeprefix('repo, ')} FROM tagged)""",
            f"""signed AS (
  SELECT step, 1 AS op, {columns} FROM views
  UNION ALL SELECT step + 1, -1, {columns} FROM views WHERE step < 2)""",
        ],
        f"SELECT step AS batch, CAST(sum(op) AS INTEGER) AS op, {columns.removesuffix(', evidence, line')} "
        f"FROM signed GROUP BY step, {columns} HAVING sum(op) <> 0", recursive=True,
    )


_PAGE_HOST = "regexp_extract(url, '^https?://([^/]+)/', 1)"
_NAMES = """
names AS (
  SELECT name, count(*) AS uses FROM (
    SELECT unnest(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM files)
  GROUP BY name)"""
_EVERY = f"""{SPLIT},
every AS (SELECT repo, path, language, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM split)"""
_SCAN_LOG = """
scan_log AS (
  SELECT 'repo' || (user_id % 50) AS repo, event_id % 7 AS findings, event_id % 300 AS files, ts FROM events)"""


def _rate_limit_sql(key: str, limit: int, seconds: int) -> str:
    """Walk the requests of each key in time order, carrying the accepted times."""
    return f"""WITH RECURSIVE req AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, request_id) AS k FROM (
    SELECT {key} AS key, ts, event_id AS request_id FROM events)),
live AS (
  SELECT key, k, ts, request_id, true AS accepted, [ts] AS hits FROM req WHERE k = 1 AND key IS NOT NULL
  UNION ALL
  SELECT key, k, ts, request_id, len(kept) < {limit},
         CASE WHEN len(kept) < {limit} THEN list_append(kept, ts) ELSE kept END
  FROM (SELECT r.key, r.k, r.ts, r.request_id,
               list_filter(l.hits, lambda h: r.ts - h < INTERVAL {seconds} SECONDS) AS kept
        FROM live l JOIN req r ON r.key = l.key AND r.k = l.k + 1))
SELECT key, ts, request_id, accepted FROM live
UNION ALL SELECT key, ts, request_id, true FROM req WHERE key IS NULL"""


def _text_scan_sql(table: str, skip: bool) -> str:
    return with_(
        all_findings(TEXTS[table], skip), "SELECT * FROM found_all", recursive=True
    )


def _evaluated() -> str:
    rows = []
    for c in cases():
        if c["case_id"][1:4].isdigit():
            rule = c["case_id"].split("-")[0].upper()
            fire = any(r == rule for r, _, _ in c["expected"])
            rows.append(f"({q(c['case_id'])}, {q(rule)}, {str(fire).lower()})")
    return "labels_(case_id, rule_id, expect_fire) AS (VALUES " + ", ".join(rows) + ")"


def _promised() -> str:
    rows = [
        f"({q(c['case_id'])}, {q(r)}, {q(s)}, {n})" for c in cases() for r, s, n in c["expected"]
    ]
    return "promised(case_id, rule_id, severity, line_no) AS (VALUES " + ", ".join(rows) + ")"


_EVALUATION = """SELECT rule_id, cases, repos, true_positives, false_positives, false_negatives,
  round(CASE WHEN true_positives + false_positives > 0 THEN false_positives / (true_positives + false_positives) ELSE 0 END, 4) AS fp_rate,
  CASE WHEN true_positives + false_positives > 0 THEN false_positives / (true_positives + false_positives) ELSE 0 END < 0.1
    AND cases >= 10 AND repos >= 20 AS accepted
FROM (SELECT rule_id, count(*) AS cases, count(DISTINCT repo) AS repos,
   count(*) FILTER (fired AND expect_fire) AS true_positives,
   count(*) FILTER (fired AND NOT expect_fire) AS false_positives,
   count(*) FILTER (NOT fired AND expect_fire) AS false_negatives
  FROM (SELECT c.repo, c.path, l.rule_id, l.expect_fire,
          EXISTS (SELECT 1 FROM raw r WHERE r.repo = c.repo AND r.path = c.path AND r.rule_id = l.rule_id) AS fired
        FROM corpus c JOIN labels_ l USING (case_id)) GROUP BY rule_id)"""


def _build() -> dict[str, str]:
    sql: dict[str, str] = {}
    docs = TEXTS["documents"]
    sql["lines_explode"] = with_(
        [docs, _EVERY], "SELECT repo, path, CAST(n AS INTEGER) AS line_no, line FROM every"
    )
    for name in PROFILES:
        sql[f"select_files_{name}"] = _selected_sql(name)
        sql[f"select_large_{name}"] = _selected_sql(name, "SELECT repo, path, size_bytes FROM chosen", LARGE)
        sql[f"scan_scope_{name}"] = _scope_sql(name, LARGE)
    sql["scan_scope"] = _selected_sql(
        "service",
        "SELECT c.repo, count(*) AS files_scanned, "
        f"any_value(s.n > {P.SERVICE_MAX_FILES}) AS truncated FROM chosen c JOIN "
        "(SELECT repo, count(*) AS n FROM inscope GROUP BY repo) s ON s.repo = c.repo GROUP BY c.repo",
    )
    sql["cap_files"] = with_(
        [CORPUS],
        "SELECT repo, path FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) "
        "AS rk FROM files) WHERE rk <= 10",
    )
    sql["file_classify"] = with_(
        [CORPUS, SPLIT],
        f"SELECT repo, path, language, {_IS_GENERATED} OR {_LONG_LINE} AS is_minified, "
        f"{_IS_TEST} AS is_test, {_IS_VENDOR} AS is_vendor, {_IS_DEMO} AS is_demo, "
        f"{_IS_BENCH} AS is_benchmark FROM split",
    )
    sql["repo_urls"] = f"""
SELECT page_id, url, CASE WHEN url IS NOT NULL THEN {_PAGE_HOST.replace('url', 'page_url')} || '/r' || page_id END AS repo
FROM (SELECT page_id, url AS page_url, CASE WHEN page_id % 4 <> 3
        THEN 'https://github.com/' || {_PAGE_HOST} || '/r' || page_id END AS url FROM pages)"""
    sql["dedupe_repos"] = f"""
WITH b AS (SELECT page_id % 10 AS batch_no, page_id AS position,
  CASE WHEN page_id % 2 = 1 THEN upper({_PAGE_HOST}) ELSE {_PAGE_HOST} END AS owner, 'site' AS repo FROM pages)
SELECT lower(owner) || '/site' AS repo_key, owner, repo, CAST(batch_no AS INTEGER) AS batch_no FROM (
  SELECT *, row_number() OVER (PARTITION BY lower(owner) ORDER BY batch_no, position) AS rk FROM b) WHERE rk = 1"""
    frame = "string_agg(line, chr(10)) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN {0})"
    sql["context_window"] = with_(
        [docs, _EVERY],
        "SELECT path, CAST(n AS INTEGER) AS line_no, "
        f"md5({frame.format('4 PRECEDING AND 5 FOLLOWING')}) AS around, "
        f"md5(coalesce({frame.format('1 FOLLOWING AND 3 FOLLOWING')}, '')) AS below FROM every",
    )
    words = (
        "list_filter(string_split(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '_'), "
        "lambda w: w <> '')"
    )
    sql["split_identifier"] = with_(
        [CORPUS, _NAMES], f"SELECT name, uses, array_to_string({words}, '|') AS words FROM names"
    )
    sql["security_target"] = with_(
        [CORPUS, _NAMES], f"SELECT name, uses, {_security_name('name')} AS is_target FROM names"
    )
    sql["line_values"] = with_(
        [CORPUS, _EVERY,
         f"vals AS (SELECT repo, path, n, {x('line', P.ASSIGN_TARGET, 1)} AS target, "
         f"unnest(regexp_extract_all(line, {q(P.QUOTED_VALUE)}, 1)) AS value FROM every)"],
        f"""SELECT repo, path, CAST(n AS INTEGER) AS line_no, target, value,
  regexp_matches(value, '[^\\x00-\\x7F]') AS non_ascii, lower(value) IN {words_in(P.STATUS_WORDS)} AS status_word,
  {m('value', P.SAFE_DEFAULT)} AS safe_default, {m('value', P.PLACEHOLDER_VALUE)} AS placeholder,
  {m('value', P.BCRYPT_HASH)} AS bcrypt, {m('value', P.ENV_NAME_VALUE)} AS env_name, {_LABEL} AS label FROM vals""",
    )
    sql["comment_lines"] = with_(
        [CORPUS, _EVERY],
        f"""SELECT repo, path, CAST(n AS INTEGER) AS line_no, md5({strip('line')}) AS stripped_md5,
  {m('line', P.COMMENT_CREDENTIAL)} AS credential_family, {m('line', P.COMMENT_COMMON)} AS common_family,
  {m('line', P.COMMENT_SCRIPT)} AS script_family, {m('line', P.COMMENT_ROUTE)} AS route_family FROM every""",
    )
    for name in _DETECTORS:
        sql[f"detect_{name}"] = _detector_sql(CORPUS, name)
    tables, select = open_route(P.PUBLIC_ROUTE_STRICT)
    sql["detect_open_route_strict"] = with_([CORPUS, scanned(), *tables], select)
    sql["taint_windows"] = with_(
        [CORPUS, SPLIT,
         "ln AS (SELECT repo, path, lines, unnest(range(1, len(lines) + 1)) AS n FROM split)",
         f"near AS (SELECT repo, path, n, {win(4, 5)} AS w FROM ln)"],
        f"SELECT repo, path, CAST(n AS INTEGER) AS line_no FROM near WHERE {taint('w')}",
    )
    digest_tables, _ = timing_comparison()
    sql["digest_names"] = with_(
        [CORPUS, scanned(), *digest_tables[:3]],
        "SELECT repo, path, 'digest' AS kind, name, CAST(min(n) AS INTEGER) AS since FROM dig GROUP BY ALL "
        "UNION ALL SELECT repo, path, 'mac', name, CAST(min(since) AS INTEGER) FROM macs GROUP BY ALL",
        recursive=True,
    )
    sql["findings_policy"] = raw_sql("SELECT * FROM raw")
    sql["denied_paths"] = with_(
        all_findings(CORPUS),
        "SELECT repo, path, line_no, rule_id, severity FROM found_all "
        "WHERE NOT ends_with(path, 'users.js') AND NOT ends_with(path, '/db.py')",
        recursive=True,
    )
    route_tables, route_select = open_route()
    sql["first_access_finding"] = with_(
        [CORPUS, scanned(), *route_tables, f"routes AS ({route_select})"],
        "SELECT repo, path, min(line_no) AS line_no FROM routes GROUP BY repo, path",
    )
    extra, _ = sql_injection()
    sql["sql_var_lookback"] = with_(
        [CORPUS, scanned(False), "sqlf AS (SELECT * FROM ln)", *extra[1:3]], "SELECT repo, path, CAST(n AS INTEGER) AS line_no FROM via"
    )
    sql["secret_scan_documents"] = _text_scan_sql("documents", False)
    sql["secret_scan_documents_skipping"] = _text_scan_sql("documents", True)
    sql["secret_scan_pages"] = _text_scan_sql("pages", False)
    sql["secret_scan_conversations"] = _text_scan_sql("conversations", False)
    sql["rule_spec_documents"] = with_(
        [docs, scanned(False)],
        found("X001", "'medium'", "''", "''", "ln",
              m("line", "\\btoken\\s*=") + " AND " + _not(
                  m("line", P.COMMENT_COMMON), m(win(1, 1), "^\\s*[-*]\\s"))),
    )
    sql["rule_spec_pages"] = with_(
        [TEXTS["pages"], scanned(False)],
        found("X002", "'low'", "''", "''", "ln",
              "contains(line, '<script>') AND " + _not(m("line", P.COMMENT_COMMON), m("line", '<html lang="de">'))),
    )
    sql["rule_spec_conversations"] = with_(
        [TEXTS["conversations"], scanned(False)],
        found("X003", "'low'", "''", "''", "ln",
              m("line", "(?:^|\\s)que\\s") + " AND " + _not(
                  m("line", P.COMMENT_COMMON), m(win(1, 2), "(?:^|\\s)dans\\s"))),
    )
    sql["function_rule"] = with_(
        [docs, _EVERY, "marked AS (SELECT *, min(n) OVER (PARTITION BY path, line) AS earliest FROM every)"],
        f"SELECT repo, path, CAST(n AS INTEGER) AS line_no, 'X010' AS rule_id, 'low' AS severity, '' AS variant, "
        f"CAST(earliest AS VARCHAR) AS evidence, {strip('line')} AS line FROM marked WHERE length(line) >= 20 AND n > earliest",
    )
    verify = found("C003", "'high'", "''", "''", "ln", f"NOT is_test AND {_PYTHON} AND " + m("line", "verify\\s*=\\s*False")
                   + " AND " + _not(m("line", P.COMMENT_COMMON)))
    sql["rule_validation"] = with_(
        [CORPUS, scanned(), f"raw AS ({verify})", _evaluated()], _EVALUATION.replace(
            "JOIN labels_ l USING (case_id)", "JOIN labels_ l USING (case_id) WHERE l.rule_id = 'C003'"
        ),
    )
    sql["repo_has_auth"] = with_(
        [CORPUS], f"SELECT repo, bool_or({m('code', P.AUTH_WORDS)}) AS has_auth FROM files GROUP BY repo"
    )
    sql["repo_auth_filter"] = raw_sql(
        "SELECT repo, path, line_no, rule_id, severity FROM raw WHERE rule_id <> 'A001' OR repo IN "
        f"(SELECT repo FROM files WHERE {m('code', P.AUTH_WORDS)})"
    )
    sql["django_settings"] = with_([CORPUS, LISTING, DJANGO], "SELECT repo, dir FROM django")
    sql["imports"] = with_(
        [CORPUS, IMPORTS], "SELECT repo, path, ecosystem, package, line_no, line FROM imps"
    )
    sql["distinct_imports"] = with_(
        [CORPUS, IMPORTS],
        "SELECT repo, path, ecosystem, package, line_no, line, CASE WHEN ecosystem = 'pypi' "
        "THEN lower(replace(package, '-', '_')) ELSE package END AS registry_name FROM firsts",
    )
    sql["unaliased_imports"] = with_(
        [CORPUS, IMPORTS], "SELECT repo, path, package, line_no FROM unaliased"
    )
    sql["registry_fresh"] = with_([REGISTRY], "SELECT ecosystem, name, is_known, checked_at FROM fresh")
    sql["missing_imports"] = with_(
        [CORPUS, IMPORTS, REGISTRY],
        "SELECT i.repo, i.path, i.package, i.line_no FROM imps i JOIN fresh f ON f.ecosystem = i.ecosystem "
        "AND NOT f.is_known AND f.name = CASE WHEN i.ecosystem = 'pypi' "
        "THEN lower(replace(i.package, '-', '_')) ELSE i.package END",
    )
    sql["project_roots"] = with_([CORPUS, LISTING, ROOTS], "SELECT repo, dir, root FROM roots")
    sql["local_packages"] = with_(
        [CORPUS, LISTING, IMPORTS.replace("unaliased AS", "unaliased_ AS"), ROOTS,
         "unaliased AS (SELECT * FROM imps)", LOCAL],
        "SELECT repo, path, package, line_no FROM nonlocal",
    )
    sql["unknown_packages"] = with_(
        [CORPUS, LISTING, REGISTRY, IMPORTS, ROOTS, LOCAL, UNKNOWN], "SELECT * FROM unknown"
    )
    sql["scan_directory"] = directory_sql(
        "SELECT repo, path, line_no, rule_id, severity, sev_rank, vuln_class, cwe, owasp_rank, line, "
        "CAST(row_number() OVER (PARTITION BY repo, path ORDER BY sev_rank, line_no, rule_seq) AS INTEGER) "
        "AS position FROM final"
    )
    sql["export_findings"] = directory_sql(
        "SELECT f.repo, f.path AS file, f.line_no AS line, f.rule_id, f.severity, vuln_class, "
        "replace(t.title, '{evidence}', f.evidence) AS title, replace(t.detail, '{evidence}', f.evidence) AS detail, "
        f"t.fix, {strip('f.line')} AS code, cwe, "
        "owasp_category, owasp_rank FROM final f JOIN texts t ON t.rule_id = f.rule_id AND t.variant = f.variant",
        f"texts(rule_id, variant, title, detail, fix) AS (VALUES {_MESSAGE_ROWS})",
    )
    rules = (
        "rules(rule_id, rule_seq, vuln_class, cwe, owasp_category, owasp_rank) AS "
        f"(VALUES {_RULE_ROWS})"
    )
    sql["attach_metadata"] = raw_sql(
        "SELECT repo, path, line_no, rule_id, CAST(rule_seq AS INTEGER) AS rule_seq, vuln_class, cwe, "
        "owasp_category, CAST(owasp_rank AS INTEGER) AS owasp_rank, "
        "replace(t.title, '{evidence}', evidence) AS title "
        "FROM raw JOIN rules USING (rule_id) JOIN texts t USING (rule_id, variant)",
        rules, f"texts(rule_id, variant, title, detail, fix) AS (VALUES {_MESSAGE_ROWS})",
    )
    sql["report_blocks"] = raw_sql(
        f"SELECT CAST({_SEV} AS INTEGER) AS sev_rank, severity, repo, path, line_no, rule_id FROM raw "
        "ORDER BY sev_rank, repo, path, line_no"
    )
    counts = ", ".join(
        f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("high", "medium", "low")
    )
    sql["scan_summary"] = directory_sql(
        "SELECT s.repo, s.files_scanned, coalesce(c.total, 0) AS total_findings, coalesce(high, 0) AS high, "
        "coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, false AS truncated "
        "FROM (SELECT repo, count(*) AS files_scanned FROM files GROUP BY repo) s "
        f"LEFT JOIN (SELECT repo, count(*) AS total, {counts} FROM final GROUP BY repo) c ON c.repo = s.repo"
    )
    sql["severity_gate"] = raw_sql(
        "SELECT repo, CAST(CASE WHEN repo IN (SELECT repo FROM raw WHERE severity = 'high') THEN 1 ELSE 0 END "
        f"AS INTEGER) AS exit_code FROM (SELECT DISTINCT repo FROM files WHERE {_DIR_SKIP})"
    )
    sql["severity_rollup"] = raw_sql(
        "SELECT repo, severity, count(*) AS findings FROM raw GROUP BY ROLLUP (repo, severity)"
    )
    for severity in ("high", "medium", "low"):
        sql[f"severity_{severity}"] = raw_sql(
            f"SELECT repo, path, line_no, rule_id FROM raw WHERE severity = '{severity}'"
        )
    sql["files_with_findings"] = raw_sql(
        "SELECT repo, path, count(*) AS findings FROM raw GROUP BY repo, path"
    )
    sql["nested_results"] = raw_sql(
        "SELECT r.repo, r.path, string_agg(r.rule_id || ':' || severity || ':' || line_no, ';' "
        f"ORDER BY {_SEV}, line_no, k.rule_seq) AS findings FROM raw r JOIN rules k ON k.rule_id = r.rule_id "
        "GROUP BY r.repo, r.path",
        f"rules(rule_id, rule_seq, vuln_class, cwe, owasp_category, owasp_rank) AS (VALUES {_RULE_ROWS})",
    )
    sql["fleet_report"] = raw_sql(
        """SELECT (SELECT count(*) FROM att) AS total_repos_attempted, count(*) AS total_scanned,
  (SELECT count(*) FROM att WHERE NOT scanned) AS failed_to_reclone,
  round(100.0 * count(*) FILTER (high) / count(*), 1) AS pct_high,
  round(100.0 * count(*) FILTER (medium) / count(*), 1) AS pct_medium,
  round(100.0 * count(*) FILTER (high IS NULL) / count(*), 1) AS pct_clean
FROM att LEFT JOIN sevs USING (repo) WHERE scanned""",
        "att AS (SELECT repo, (length(repo) + count(*)) % 5 <> 0 AS scanned FROM files GROUP BY repo)",
        "sevs AS (SELECT repo, bool_or(severity = 'high') AS high, bool_or(severity = 'medium') AS medium "
        "FROM raw GROUP BY repo)",
    )
    sql["top_rules"] = raw_sql(
        "SELECT rule_id, count(*) AS findings FROM raw GROUP BY rule_id ORDER BY findings DESC, rule_id LIMIT 10"
    )
    sql["regression_diff"] = raw_sql(
        """SELECT coalesce(a.repo, e.repo) AS repo, coalesce(a.rule_id, e.rule_id) AS rule_id,
  coalesce(a.severity, e.severity) AS severity,
  CASE WHEN coalesce(a.n, 0) > coalesce(e.n, 0) THEN 'unexpected' ELSE 'missing' END AS kind,
  abs(coalesce(a.n, 0) - coalesce(e.n, 0)) AS findings
FROM (SELECT repo, rule_id, severity, count(*) AS n FROM raw GROUP BY ALL) a
FULL JOIN (SELECT c.repo, p.rule_id, p.severity, count(*) AS n FROM corpus c JOIN promised p USING (case_id)
           GROUP BY ALL) e ON a.repo = e.repo AND a.rule_id = e.rule_id AND a.severity = e.severity
WHERE coalesce(a.n, 0) <> coalesce(e.n, 0)""",
        _promised(),
    )
    sql["rule_evaluation"] = raw_sql(
        _EVALUATION,
        _evaluated(),
    )
    sql["published_changes"] = changes_sql()
    sql["scan_log_append"] = with_([_SCAN_LOG], "SELECT repo, findings, files, ts FROM scan_log")
    for name in ("directory_files", "file_stream"):
        sql[name] = with_([CORPUS], "SELECT repo, path, language, size_bytes, md5(code) AS code_md5 FROM files")
    sql["scan_log_rollup"] = with_(
        [_SCAN_LOG],
        "SELECT date_trunc('hour', ts) AS bucket_start, count(*) AS scans, CAST(sum(findings) AS BIGINT) AS findings, "
        "CAST(sum(files) AS BIGINT) AS files FROM scan_log GROUP BY 1",
    )
    sql["recent_scans"] = with_([_SCAN_LOG], "SELECT * FROM scan_log ORDER BY ts DESC, repo LIMIT 20")
    sql["scan_totals"] = with_([_SCAN_LOG], "SELECT count(*) AS total_scans FROM scan_log")
    sql["rate_limit_events"] = _rate_limit_sql(
        "CASE WHEN user_id % 11 <> 0 THEN CAST(user_id AS VARCHAR) END", 5, 86_400
    )
    sql["rate_limit_hot_keys"] = _rate_limit_sql("event_type", 20, 5 * 86_400)
    sql["rate_limit_types"] = _rate_limit_sql("event_type", P.SCAN_LIMIT, P.SCAN_WINDOW_SECONDS)
    return sql


ORACLES = _build()
