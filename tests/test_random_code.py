"""Detectors on random code against the SQL form of the same rules.

The files are token soup: statements, guards and sources of every rule in random
order, long enough to span several blocks.
"""

import random

import duckdb
import pytest

from codesift import oracles
from codesift.operators.detectors import DETECTORS
from codesift.operators.detectors import access
from codesift.operators.engine import detect
from codesift.plans.scan import raw_findings
from codesift.sources.cases import cases

COLUMNS = ["repo", "path", "line_no", "rule_id", "severity", "variant", "evidence", "line"]
DIRECTORIES = ["src", "tests", "web/demo", "perf/bench", "src/utils", "examples", "app/api/health", "lib"]


def _fragments():
    lines = {line for c in cases() for line in c["code"].splitlines() if len(line) < 200}
    lines |= {
        "", "step();", "x = 1", "if settings.DEBUG:", "// @public", "class Foo:", "  class Bar(Enum):",
        "const name = req.query.name;", "def run(self):", "def run(cmd, x=1):", "return request.user",
        "const h = hmac_obj.update(x).digest('hex');", "if (h == sig) go();", "rateLimit(req);",
        "docsearch({", "setAuthTagLength(16)", "import x from 'y'; router.use(z)", "path.basename(x)",
        "function (res, next) {", "const f = async (a, b) => {", "throw Error('é' + eval(x))",
    }
    return sorted(line.replace("{key}", "7").replace("{ghost}", "5") for line in lines)


def _soup(count, seed):
    rng = random.Random(seed)
    fragments = _fragments()
    rows = []
    for number in range(count):
        suffix, language = rng.choice(
            [(".py", "python"), (".js", "javascript"), (".ts", "typescript")]
        )
        length = rng.choice([3, 10, 40, 700])
        weight = rng.choice([0.1, 0.5, 1.0])
        body = [
            rng.choice(fragments) if rng.random() < weight else "step();" for _ in range(length)
        ]
        path = f"{rng.choice(DIRECTORIES)}/f{number}{suffix}"
        rows.append((f"r{number % 5}", path, language, "\n".join(body)))
    return rows


@pytest.fixture(scope="module")
def soup():
    return _soup(260, 11)


def _sql(soup, select_tables, select, recursive=True):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE soup (repo VARCHAR, path VARCHAR, language VARCHAR, code VARCHAR)")
    duck.executemany("INSERT INTO soup VALUES (?, ?, ?, ?)", soup)
    result = duck.execute(oracles.with_(select_tables, select, recursive))
    names = [d[0] for d in result.description]
    return sorted(tuple(dict(zip(names, row))[c] for c in COLUMNS) for row in result.fetchall())


SOURCE = "files AS (SELECT repo, path, language, code FROM soup)"


def test_every_detector_agrees_with_sql(spark, soup):
    files = spark.createDataFrame(soup, "repo string, path string, language string, code string")
    got = sorted(tuple(r) for r in detect(files, list(DETECTORS.values())).select(*COLUMNS).collect())
    expected = _sql(soup, oracles.all_findings(SOURCE), "SELECT * FROM found_all")
    assert {r[3] for r in got} == {c["case_id"].split("-")[0].upper() for c in cases()
                                  if c["case_id"][1:4].isdigit()}
    assert len(got) > 1000
    assert set(got) - set(expected) == set()
    assert set(expected) - set(got) == set()
    assert got == expected


def test_strict_routes_agree_with_sql(spark, soup):
    from codesift.functions import patterns as P

    files = spark.createDataFrame(soup, "repo string, path string, language string, code string")
    got = sorted(tuple(r) for r in detect(files, [access.ROUTE_STRICT]).select(*COLUMNS).collect())
    tables, select = oracles.open_route(P.PUBLIC_ROUTE_STRICT)
    assert got == _sql(soup, [SOURCE, oracles.scanned(), *tables], select, False)


def test_order_and_partitions_do_not_matter(spark, soup):
    schema = "repo string, path string, language string, code string"
    shuffled = soup[:]
    random.Random(3).shuffle(shuffled)
    one = raw_findings(spark.createDataFrame(soup, schema).coalesce(1)).select(*COLUMNS).collect()
    many = raw_findings(spark.createDataFrame(shuffled, schema).repartition(8)).select(*COLUMNS).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
