"""I001 SQL, I002 commands, I003 code, I004 NoSQL, I005 prototypes, T001 paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions import patterns as P
from codesift.functions.taint import has_taint
from codesift.functions.text import any_match, extract, extract_all, is_comment, matches
from codesift.operators.engine import GAP, Detector, FileFlag, Line, report

_SINK_WORDS = ("execute", "cursor.", "db.query", "db.run", ".raw", "knex.", "sequelize.", "prisma.")
SQL_SINK = FileFlag(
    "sql_sink", lambda: matches(F.array_join("lines", "\n"), P.SQL_SINK), _SINK_WORDS
)


def _is_quiet(line: Line) -> Column:
    return is_comment(line.text, P.COMMENT_COMMON) | matches(line.text, P.REPORTING_LINE)


def _sql_taint(line: Line, window: Column) -> Column:
    return has_taint(window) | (line.is_python & matches(window, P.SQL_SETTINGS))


def _built_sql(line: Line) -> Column:
    window = line.window(4, 5)
    return (
        any_match(line.text, P.SQL_BUILDERS)
        & ~matches(line.text, P.SQL_TAGGED_TEMPLATE)
        & ~matches(line.text, P.BROWSER_DIALOG)
        & matches(window, P.SQL_CONTEXT)
        & _sql_taint(line, window)
    )


def assigned_sql_above(line: Line, reach: int = 14) -> Column:
    """The executed variable was given a built SQL string in the ``reach`` lines above."""
    name = extract(line.text, P.EXECUTED_NAME, 1)
    first = F.greatest(F.col("at") - reach, F.lit(0))
    above = F.slice("segment", first + 1, F.col("at") - first)
    assigned = F.exists(
        above,
        lambda text: (extract(text, P.SQL_FSTRING_ASSIGN, 1) == name)
        | (extract(text, P.SQL_CONCAT_ASSIGN, 1) == name),
    )
    return (name != "") & assigned


def sql_injection(line: Line) -> Column:
    """Built SQL on the line itself; else a built SQL string executed through a variable."""
    through_variable = assigned_sql_above(line) & _sql_taint(line, line.window(19, 2))
    way = F.when(_built_sql(line), F.lit("direct")).when(through_variable, F.lit("variable"))
    return F.when(
        line.flag("sql_sink") & ~_is_quiet(line) & way.isNotNull(), report("I001", "high", way)
    )


def command_injection(line: Line) -> Column:
    window = line.window(4, 5)
    fires = (
        any_match(line.text, P.COMMAND_CALLS)
        & ~_is_quiet(line)
        & ~matches(window, P.SHELL_WRAPPER)
        & has_taint(window)
    )
    return F.when(fires, report("I002", "high"))


def code_injection(line: Line) -> Column:
    window = line.window(4, 5)
    fires = (
        any_match(line.text, P.CODE_CALLS)
        & ~_is_quiet(line)
        & ~matches(line.text, P.EVAL_IN_STRING)
        & ~matches(line.text, P.BROWSER_EVAL)
        & ~matches(line.text, P.LITERAL_IMPORT)
        & ~matches(window, P.SHELL_WRAPPER)
        & ~matches(line.window(19, 3), P.BUILTIN_SHADOW)
        & has_taint(window)
    )
    return F.when(fires, report("I003", "high"))


def nosql_injection(line: Line) -> Column:
    fires = (
        any_match(line.text, P.NOSQL_CALLS)
        & ~is_comment(line.text, P.COMMENT_COMMON)
        & has_taint(line.window(4, 5))
    )
    return F.when(fires, report("I004", "high"))


def _has_closed_type(window: Column, name: Column) -> Column:
    """The receiver is declared in the window with a specific type."""
    declared = F.arrays_zip(
        extract_all(window, P.TYPED_DECLARATION, 1).alias("name"),
        extract_all(window, P.TYPED_DECLARATION, 2).alias("type"),
    )
    return F.exists(
        declared, lambda d: (d["name"] == name) & ~matches(d["type"], P.OPEN_TYPE)
    )


def prototype_pollution(line: Line) -> Column:
    text = line.text
    receiver = extract(text, P.BRACKET_ASSIGN, 1)
    key = extract(text, P.BRACKET_ASSIGN, 2)
    base = F.substring_index(receiver, ".", 1)
    window = line.window(15, 0)
    harmless = (
        receiver.isin(P.DECLARATION_WORDS)
        | matches(key, r"^\d+$")
        | matches(key, P.LOOP_INDEX)
        | matches(receiver, P.SAFE_RECEIVER)
        | receiver.isin(P.SAFE_RECEIVER_NAMES)
    )
    guarded = (
        matches(window, P.OWN_PROPERTY_CHECK)
        | matches(window, P.ALLOW_LIST_CHECK)
        | matches(window, P.NULL_PROTOTYPE)
        | (extract(window, P.MAP_DECLARATION, 1) == base)
        | _has_closed_type(window, base)
    )
    tainted = (
        matches(key, P.REQUEST_KEY)
        | matches(window, P.WEB_INPUT)
        | (matches(window, P.HANDLER_SIGNATURE) & has_taint(window))
    )
    fires = (
        line.is_script
        & (receiver != "")
        & ~is_comment(text, P.COMMENT_SCRIPT)
        & ~harmless
        & ~guarded
        & tainted
    )
    return F.when(fires, report("I005", "high"))


def path_traversal(line: Line) -> Column:
    window = line.window(5, 6)
    fires = (
        matches(line.text, P.FILE_SINK)
        & matches(line.text, P.PATH_BUILD)
        & ~matches(line.path, P.PACKAGING_FILES)
        & ~is_comment(line.text, P.COMMENT_COMMON)
        & ~matches(window, P.PATH_SANITIZER)
        & has_taint(window)
    )
    return F.when(fires, report("T001", "high"))


_SQL_HINT = (
    r"select|insert|update|delete|drop|create|where|(?:query|sql|stmt)" + GAP + r"\+?=|"
    r"text" + GAP + r"\(|\.(?:execute|query|run|all)" + GAP + r"\("
)

SQL_INJECTION = Detector(
    "I001",
    ("select", "insert", "update", "delete", "drop", "create", "where", "query", "sql", "stmt",
     "text", ".execute", ".run", ".all"),
    _SQL_HINT, sql_injection, before=19, after=5, flags=(SQL_SINK,),
    gate=lambda: F.col("sql_sink"), file_words=_SINK_WORDS,
)
COMMAND_INJECTION = Detector(
    "I002",
    ("exec", "spawn", "system", "popen", "subprocess.call", "subprocess.run", "shell"),
    r"(?:exec|spawn|execFile|spawnSync|system|popen|call|run)" + GAP + r"\(|shell" + GAP + "=",
    command_injection, before=4, after=5, allowed=lambda: ~F.col("is_test"),
)
CODE_INJECTION = Detector(
    "I003", ("eval", "exec", "function", "__import__", "compile", "import_module"),
    r"(?:eval|exec|function|__import__|compile|import_module)" + GAP + r"\(",
    code_injection, before=19, after=5, allowed=lambda: ~F.col("is_benchmark"),
)
NOSQL_INJECTION = Detector(
    "I004",
    ("$where", "mapreduce", ".find", ".deleteone", ".deletemany", ".updateone", ".updatemany", ".count"),
    r"\$where|mapReduce|(?:find|delete|update|count)\w*" + GAP + r"\(.*req",
    nosql_injection, before=4, after=5,
)
PROTOTYPE_POLLUTION = Detector(
    "I005", ("]",), r"\]" + GAP + "=", prototype_pollution, before=15, after=0,
    allowed=lambda: ~F.col("is_test"),
)
PATH_TRAVERSAL = Detector(
    "T001",
    ("sendfile", "createreadstream", "createwritestream", "readfile", "writefile", "unlink", "open",
     "send_file", "send_from_directory", "fileresponse", "read_text", "read_bytes", "write_text",
     "write_bytes", "shutil."),
    r"(?:sendFile|ReadStream|WriteStream|readFile|readFileSync|writeFile|writeFileSync|unlink|"
    r"unlinkSync|open|send_file|send_from_directory|FileResponse|read_text|read_bytes|write_text|"
    r"write_bytes|copy|move|rmtree)" + GAP + r"\(",
    path_traversal, before=5, after=6,
)
