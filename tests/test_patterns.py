"""Patterns that are put together from word tables."""

import re

import pytest

from codesift.functions import patterns as P

CASES = {
    "VALIDATION_MESSAGE": (
        ["Name is required", "does not match", "DO NOT MATCH", "confirm password", "please enter a name", "is too long"],
        ["is fine", "a password", "they match", "is nothing", "done not  match"],
    ),
    "SAFE_DEFAULT": (
        ["", "none", "ES384", "127.0.0.1:80/x", "0.0.0.0:1", "1.5", "30s", "sqlite+aiosqlite:///a", "/a/b", "your-key", "change_me",
         "todo replace", "https://x", "*", "vi", "replace with"],
        ["ES385", "127x0.0.1", "1.", "30w", "sqlite://a", "your-", "hunter2", "/A b", "vi m", "0.0.0.0/x"],
    ),
    "SQL_CONTEXT": (
        ["db.run (x)", "a query b", "x.raw(", "pg.Client", "PRISMA", "join t", "x.execute("],
        ["prerun(x)", "queries", "pgx", "rejoined", "dbs", ".running("],
    ),
    "AUTH_WORDS": (
        ["requireAuth", "JwtAuthGuard", "OrganizationActionGuard", "isauthenticated", "middleware = x", "x.headers['auth']",
         "protect(", "@Public()", "session[0]", "user = Depends(x)", "constructEvent (", "isAuth;", "@Roles('a')"],
        ["protection", "@Publication", "session", "middlewares", "author", "isAuthor", "depends", "constructEvents"],
    ),
    "PUBLIC_ROUTE": (
        ['"/health"', "'/signup'", '"/reset-password"', '"/public/x"', "'/api/auth/x'", '"/")', "'/openapi.json'", '"/.well-known/a"'],
        ['"/users"', '"/publican"', "/health", '"/signed"', "'/openapiXjson'", '"/password"', "'/authors'"],
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_word_tables(name):
    hits, misses = CASES[name]
    pattern = re.compile(getattr(P, name))
    assert [text for text in hits if not pattern.search(text)] == []
    assert [text for text in misses if pattern.search(text)] == []


SQL_HITS = [
    '''q = "SELECT a FROM t WHERE b=" + b''', '''f"SELECT {a}"''', '''f'drop  table {a}\'''', '''"insert %s" % (a)''',
    '''"x WHERE a={}".format (a)''', '''`UPDATE t SET a=${b}`''', '''sql = f"x"''', '''stmt += a + b''', '''query = sql + x''',
    '''text( f"{a}")''', '''text(a + b)''', '''`${a ? "DELETE" : ""}`''',
]
SQL_MISSES = [
    '''"SELECT a FROM t"''', '''f"SELECT a"''', '''f"DELETE {a}"''', '''"update %s" % a''', '''`SELECTED ${a}`''', '''stmt = f"x"''',
    '''sql = "x"''', '''context(a)''', '''"DROP {}".format(a)''',
]


def test_sql_builders():
    found = [text for text in SQL_HITS + SQL_MISSES if any(re.search(form, text) for form in P.SQL_BUILDERS)]
    assert found == SQL_HITS


def test_words_stand_for_themselves():
    words = ["a.b", "c(", "d[0]", "e|f", "g\\h", "i*"]
    assert all(re.fullmatch(pattern, word) for pattern, word in zip(P.literal(words), words, strict=True))
    assert not re.fullmatch(P.literal(["a.b"])[0], "axb")
