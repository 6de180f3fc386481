"""Project settings, packages, reports and user rules on small tables."""

import pytest
from pyspark.sql import functions as F

from codesift.functions import paths
from codesift.functions.repos import normalize_repo_url, repo_name
from codesift.operators import packages, reports
from codesift.operators.catalog import RuleText, attach_metadata
from codesift.operators.detectors import DETECTORS
from codesift.operators.engine import detect
from codesift.operators.extension import (
    FunctionRule, RuleSpec, detect_by_function, detector_of, register_detector, rule_specs, validate_rule,
)
from codesift.operators.repo_rules import (
    dirs_with_settings, drop_access_findings_without_auth, first_access_finding_per_file,
)
from codesift.plans.scan import order_findings, raw_findings, report_order

LISTING = "repo string, path string, is_dir boolean"
CODE = "repo string, path string, language string, code string"


def _listing(spark, *entries):
    return spark.createDataFrame([(r, p, False) for r, p in entries], LISTING)


def _dirs(spark, *entries):
    return sorted((r["repo"], r["dir"]) for r in dirs_with_settings(_listing(spark, *entries)).collect())


def test_settings_beside_above_and_one_below(spark):
    assert _dirs(spark, ("r", "site/settings.py"), ("r", "site/app/v.py")) == [
        ("r", "site"), ("r", "site/app")]
    assert _dirs(spark, ("r", "proj/settings/base.py"), ("r", "app/v.py")) == [
        ("r", "app"), ("r", "proj/settings")]
    assert _dirs(spark, ("r", "a/b/settings.py"), ("r", "app/v.py")) == [("r", "a/b")]
    assert _dirs(spark, ("r", ".hidden/settings.py"), ("r", "app/v.py")) == [("r", ".hidden")]
    assert _dirs(spark, ("q", "settings.py"), ("r", "app/v.py")) == [("q", "")]


def test_settings_are_seen_ten_levels_up(spark):
    deep = "/".join("abcdefghi")
    assert ("r", deep) in _dirs(spark, ("r", "settings.py"), ("r", f"{deep}/v.py"))
    assert ("r", f"{deep}/j") not in _dirs(spark, ("r", "settings.py"), ("r", f"{deep}/j/v.py"))


def test_ancestors(spark):
    frame = spark.createDataFrame([("",), ("a",), ("a/b/c",)], "d string")
    got = [r[0] for r in frame.select(paths.ancestors(F.col("d"))).collect()]
    assert got == [[""], ["a", ""], ["a/b/c", "a/b", "a", ""]]


VIEW = "class V(View):\n    def get(self, request):\n        return Order.objects.filter(id=1)"


def test_django_lowers_python_routes_only(spark):
    files = spark.createDataFrame(
        [("r", "site/v.py", "python", VIEW),
         ("r", "site/r.js", "javascript", "router.get('/a', (q, s) => s.json(Order.find()));")], CODE)
    listing = _listing(spark, ("r", "site/v.py"), ("r", "site/r.js"), ("r", "site/settings.py"))
    got = {r["path"]: (r["severity"], r["variant"]) for r in raw_findings(files, listing=listing).collect()}
    assert got == {"site/v.py": ("low", "route-django"), "site/r.js": ("medium", "route")}


def test_access_findings_need_auth_somewhere(spark):
    route = "router.get('/a', (q, s) => s.json(Order.find()));\neval(req.body.x);"
    files = spark.createDataFrame(
        [("open", "a.js", "javascript", route), ("guarded", "a.js", "javascript", route),
         ("guarded", "b.py", "python", "current_user = 1")], CODE)
    found = first_access_finding_per_file(detect(files, list(DETECTORS.values())))
    kept = drop_access_findings_without_auth(found, files).collect()
    assert sorted((r["repo"], r["rule_id"]) for r in kept) == [
        ("guarded", "A001"), ("guarded", "I003"), ("open", "I003")]


def test_denied_files_and_minified_option(spark):
    files = spark.createDataFrame(
        [("r", "docs/rules_text.py", "python", "s.verify = False"),
         ("r", "a.py", "python", "s.verify = False\n" + "x" * 600)], CODE)
    tls = [DETECTORS["tls_disabled"]]
    assert detect(files, tls, denied_suffixes=["docs/rules_text.py"]).count() == 0
    assert detect(files, tls).count() == 1
    assert detect(files, tls, skip_minified=False).count() == 2


def _packages(spark, code, absent, listing=(), path="src/a.py", language="python"):
    files = spark.createDataFrame([("r", path, language, code)], CODE)
    ecosystem = "pypi" if language == "python" else "npm"
    registry = spark.createDataFrame(
        [(ecosystem, n, False) for n in absent] + [(ecosystem, "known", True)],
        "ecosystem string, name string, exists boolean")
    entries = _listing(spark, ("r", path), *[("r", p) for p in listing])
    found = packages.unknown_packages(files, registry, entries).collect()
    return sorted((r["evidence"], r["line_no"]) for r in found)


def test_unknown_packages(spark):
    code = "import os\nimport ghost\nfrom ghost.sub import x\nimport known\nimport unlisted"
    assert _packages(spark, code, ["ghost", "os"]) == [("ghost", 2)]
    assert _packages(spark, "import yaml\nimport PIL\nimport SKLEARN", ["yaml", "pil", "sklearn"]) == []
    assert _packages(spark, "import Big_Name", ["big_name"]) == [("Big_Name", 1)]
    assert _packages(spark, "import ghost", ["ghost"], path="app/migrations/a.py") == []


def test_local_modules_need_a_marked_root(spark):
    ghost = ["ghost"]
    assert _packages(spark, "import ghost", ghost, ["ghost/core.py"]) == [("ghost", 1)]
    assert _packages(spark, "import ghost", ghost, ["ghost/core.py", "setup.py"]) == []
    assert _packages(spark, "import ghost", ghost, ["ghost.py", ".git/HEAD"]) == []
    assert _packages(spark, "import ghost", ghost, ["src/ghost.py", "setup.py"]) == []
    assert _packages(spark, "import ghost", ghost, ["lib/ghost.py", "setup.py"]) == [("ghost", 1)]
    # The nearest marker is the root: a package above it does not count.
    assert _packages(spark, "import ghost", ghost, ["ghost/a.py", "setup.py", "src/setup.cfg"]) == [("ghost", 1)]


def test_javascript_imports(spark):
    code = "const a = require('ghost/sub');\nimport '@acme/ui/x';\nimport b from 'plain';\nimport('fs')"
    got = _packages(spark, code, ["ghost", "@acme/ui", "plain", "fs"], path="a.js", language="javascript")
    assert got == [("@acme/ui", 2), ("ghost", 1)]


def test_repo_urls(spark):
    urls = ["https://github.com/a/b", " http://github.com/a/b.git/ ", "https://github.com/a/b/c",
            "https://example.com/a/b", "https://github.com/a-1/b.c_d.git"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    clean = normalize_repo_url(F.col("u"))
    assert [tuple(r) for r in frame.select(clean, repo_name(clean)).collect()] == [
        ("https://github.com/a/b", "a/b"), ("http://github.com/a/b", "a/b"), (None, None),
        (None, None), ("https://github.com/a-1/b.c_d", "a-1/b.c_d")]


FINDINGS = "repo string, path string, line_no int, rule_id string, severity string"


def test_summary_keeps_clean_repositories(spark):
    found = spark.createDataFrame(
        [("a", "x", 1, "C001", "high"), ("a", "x", 2, "A001", "low")], FINDINGS)
    scope = spark.createDataFrame(
        [("a", 3, False), ("b", 2, True)], "repo string, files_scanned long, truncated boolean")
    got = sorted(tuple(r) for r in reports.scan_summary(found, scope).collect())
    assert got == [("a", 3, 2, 1, 0, 1, False), ("b", 2, 0, 0, 0, 0, True)]
    gate = {r["repo"]: r["exit_code"] for r in reports.severity_gate(found, scope).collect()}
    assert gate == {"a": 1, "b": 0}


def test_fleet_report_of_nothing_is_zero(spark):
    found = spark.createDataFrame([], FINDINGS)
    none = spark.createDataFrame([("a", False)], "repo string, scanned boolean")
    assert tuple(reports.fleet_report(found, none).first()) == (1, 0, 1, 0.0, 0.0, 0.0)
    some = spark.createDataFrame([("a", True), ("b", True), ("c", True)], "repo string, scanned boolean")
    found = spark.createDataFrame([("a", "x", 1, "C001", "high")], FINDINGS)
    assert tuple(reports.fleet_report(found, some).first()) == (3, 3, 0, 33.3, 0.0, 66.7)


def test_regression_diff_counts_copies(spark):
    schema = "repo string, rule_id string, severity string"
    actual = spark.createDataFrame([("r", "C001", "high")] * 2 + [("r", "A001", "low")], schema)
    expected = spark.createDataFrame([("r", "C001", "high"), ("r", "A001", "medium")], schema)
    got = sorted(tuple(r) for r in reports.regression_diff(actual, expected).collect())
    assert got == [("r", "A001", "low", "unexpected", 1), ("r", "A001", "medium", "missing", 1),
                   ("r", "C001", "high", "unexpected", 1)]
    assert reports.regression_diff(actual, actual).count() == 0


def test_findings_are_ordered_within_a_file(spark):
    code = ("s.verify = False\n" "password = 'Tr0ub4dor&3x'\n\n" "if settings.DEBUG:\n    t.verify = False\n"
            "def f(c):\n    os.system('a' + c); eval(c)")
    files = spark.createDataFrame([("r", "a.py", "python", code)], CODE)
    found = attach_metadata(raw_findings(files))
    rows = order_findings(found).orderBy("position").collect()
    assert [(r["rule_id"], r["line_no"], r["severity"]) for r in rows] == [
        ("C003", 1, "high"), ("C001", 2, "high"), ("I002", 7, "high"), ("I003", 7, "high"),
        ("C003", 5, "low")]
    assert [r["sev_rank"] for r in report_order(found).collect()] == [0, 0, 0, 0, 2]


def test_every_variant_has_a_message(spark):
    from codesift.sources.cases import cases

    rows = [(f"r{c['number']}", c["path"].replace("{key}", "7"), c["code"]) for c in cases()]
    files = spark.createDataFrame(rows, "repo string, path string, code string").withColumn(
        "language", paths.language_of(F.col("path")))
    bad = attach_metadata(raw_findings(files)).filter(
        "title is null or detail is null or fix is null or cwe is null or title like '%{evidence}%'")
    assert bad.count() == 0


def test_rules_as_data(spark):
    files = spark.createDataFrame(
        [("r", "a.py", "python", "def f(x):\n    danger(x)\n    # danger(x)\n    danger(1) # fine"),
         ("r", "b.py", "python", "danger(2)"), ("r", "tests/c.py", "python", "def g(x):\n    danger(x)")], CODE)
    spec = RuleSpec("Z001", r"danger\(", "medium", ("danger(",), before=2, languages=("python",),
                    cleared_by_line=(r"fine",), needs_taint=True)
    got = [(r["path"], r["line_no"], r["severity"]) for r in detect(files, [detector_of(spec)]).collect()]
    assert got == [("a.py", 2, "medium")]
    labels = spark.createDataFrame(
        [("r", "a.py", "Z001", True), ("r", "b.py", "Z001", True)],
        "repo string, path string, rule_id string, expect_fire boolean")
    row = validate_rule(files, [detector_of(spec)], labels, min_cases=2, min_repos=1).first()
    assert (row["true_positives"], row["false_negatives"], row["accepted"]) == (1, 1, True)


def test_rules_from_a_table(spark):
    table = spark.createDataFrame(
        [("Z002", "low", r"danger\(", ["danger("], 0, 0, ["python"], None, None, False, True)],
        "rule_id string, severity string, trigger string, words array<string>, before int, after int, "
        "languages array<string>, cleared_by_line array<string>, cleared_by_window array<string>, "
        "needs_taint boolean, skip_tests boolean")
    files = spark.createDataFrame([("r", "a.py", "python", "x\ndanger(1)")], CODE)
    found = detect(files, [detector_of(spec) for spec in rule_specs(table)])
    assert [(r["rule_id"], r["severity"], r["line_no"]) for r in found.collect()] == [("Z002", "low", 2)]
    assert len(rule_specs(spark.range(2000).selectExpr("cast(id as string) rule_id", "'x' trigger"))) == 2000


def test_registered_rules_have_metadata(spark):
    spec = RuleSpec("Z003", r"danger\(", "low", after=400)
    text = RuleText("danger", {"": ("Dangerous call", "It is one.", "Leave it out.")}, "CWE-1")
    register_detector("danger", spec, text)
    try:
        files = spark.createDataFrame([("r", "a.py", "python", "x\ndanger(1)")], CODE)
        row = order_findings(attach_metadata(detect(files, [DETECTORS["danger"]]))).first()
    finally:
        del DETECTORS["danger"]
    assert (row["title"], row["detail"], row["fix"], row["cwe"]) == (
        "Dangerous call", "It is one.", "Leave it out.", "CWE-1")
    assert row["rule_seq"] > 15 and row["vuln_class"] == "danger" and row["owasp_rank"] is None


def test_bad_specs_and_names_are_refused():
    with pytest.raises(ValueError):
        detector_of(RuleSpec("Z", "x", severity="fatal"))
    with pytest.raises(ValueError):
        detector_of(RuleSpec("Z", "x", before=-1))
    with pytest.raises(ValueError):
        register_detector("open_route", RuleSpec("Z", "x"))


def test_rules_as_functions(spark):
    """A function sees whole files of its languages that hold its words, and may only report what is there."""
    files = spark.createDataFrame(
        [("r", "a.py", "python", "open(x)\npass\nclose(x)\n  open(y)"), ("r", "b.py", "python", "nothing"),
         ("r", "tests/c.py", "python", "open(z)"), ("r", "d.js", "javascript", "open(z)"), ("r", "e.py", "python", ""),
         ("r", "pkg/dist/f.py", "python", "open(z)"), ("r", "g.py", "python", "open(q)\n" + "x" * 600)], CODE)

    def unclosed(lines, language, path):
        text = "\n".join(lines)
        for number, line in enumerate(lines, 1):
            name = line.strip().removeprefix("open(").removesuffix(")")
            if "open(" in line and f"close({name})" not in text:
                yield number, "medium", language, name

    rule = FunctionRule("X020", unclosed, ("open",), ("python",))
    found = detect_by_function(files, rule)
    assert [tuple(r) for r in found.select("path", "line_no", "severity", "evidence", "line").collect()] == [
        ("a.py", 4, "medium", "y", "open(y)")]
    assert found.columns == detect(files, [DETECTORS["tls_disabled"]]).columns
    assert {r["path"] for r in detect_by_function(files, rule, skip_minified=False).collect()} == {"a.py", "pkg/dist/f.py", "g.py"}
    for bad in ((9, "low", "", ""), (1, "severe", "", "")):
        wrong = FunctionRule("X021", lambda lines, language, path, bad=bad: [bad])
        with pytest.raises(Exception, match="X021"):
            detect_by_function(files, wrong).collect()
