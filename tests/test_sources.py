"""Files from directories, profiles, sinks and batches."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codesift.operators.detectors import DETECTORS
from codesift.operators.facts import file_facts
from codesift.operators.repo_rules import dirs_with_settings
from codesift.plans.scan import scan
from codesift.queries import scan_summary
from codesift.sources.batches import dedupe_repos, load_repo_batches
from codesift.sources.files import (
    PROFILES, cap_files, repo_listing, scan_scope, select_files, source_files, spread,
)
from codesift.sources.sinks import (
    append_scan_log, export_findings, load_package_registry, load_scan_log, write_findings,
)

FILES = "repo string, path string, size_bytes long"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repos"
    for path, content in {
        "one/app/main.py": b"s.verify = False\r\npassword = 'a\xff8Tr0ub4dor'\n",
        "one/app/settings.py": b"DEBUG = True\n",
        "one/node_modules/x.js": b"eval(req.body.x)",
        "one/README.md": b"# no code",
        "two/web/A.JS": b"eval(req.body.x)",
        "two/web/view.TSX": b"const a = 1;",
    }.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    return str(root)


def test_directory_source(spark, tree):
    rows = {(r["repo"], r["path"]): r for r in source_files(spark, tree).collect()}
    assert set(rows) == {
        ("one", "app/main.py"), ("one", "app/settings.py"), ("one", "node_modules/x.js"),
        ("two", "web/A.JS"), ("two", "web/view.TSX"),
    }
    main = rows["one", "app/main.py"]
    # The bad byte is dropped, line ends are normalized, the size is that of the file.
    assert main["code"] == "s.verify = False\npassword = 'a8Tr0ub4dor'\n"
    assert main["size_bytes"] == 44 and main["language"] == "python"


HIDDEN = {
    "one/pkg/__init__.py": "", "one/_app.tsx": "const a = 1;", "one/.github/x.py": "s.verify = False\n",
    "one/__tests__/a.js": "eval(req.body.x)", "one/odd.pY": "a = '\ufffd'\r\n", "one/odd.jSx": "", "one/.git/HEAD": "ref",
    "one/pkg/.py": "not a suffix", "one/main.py": "import pkg\nimport gone\n", "loose.py": "a = 1\n",
    "_two/.hidden/_deep/_x.ts": "eval(req.body.x)",
}


@pytest.fixture
def hidden_tree(tmp_path):
    root = tmp_path / "hidden"
    for path, content in HIDDEN.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content.encode())
    (root / "one" / "loop").symlink_to(root / "one", target_is_directory=True)
    (root / "one" / "nothing.py").symlink_to(root / "absent.py")
    return str(root)


def test_hidden_names_are_read(spark, hidden_tree):
    rows = {(r["repo"], r["path"]): r["code"] for r in source_files(spark, hidden_tree).collect()}
    assert set(rows) == {
        ("one", "pkg/__init__.py"), ("one", "_app.tsx"), ("one", ".github/x.py"), ("one", "__tests__/a.js"),
        ("one", "odd.pY"), ("one", "odd.jSx"), ("one", "main.py"), ("", "loose.py"), ("_two", ".hidden/_deep/_x.ts"),
    }
    assert rows["one", "odd.pY"] == "a = '\ufffd'\n"
    listing = {(r["repo"], r["path"], r["is_dir"]) for r in repo_listing(spark, hidden_tree).collect()}
    assert listing >= {("one", ".git", True), ("one", ".git/HEAD", False), ("one", "pkg", True), ("one", "loop", True)}
    assert not any(path.startswith("loop/") for _, path, _ in listing)


def test_a_profile_chooses_before_files_are_opened(spark, hidden_tree):
    service = source_files(spark, hidden_tree, profile=PROFILES["service"])
    assert {(r["repo"], r["path"]) for r in service.collect()} >= {("one", "_app.tsx"), ("one", "pkg/__init__.py")}
    assert ("one", "odd.pY") not in {(r["repo"], r["path"]) for r in service.collect()}
    whole = source_files(spark, hidden_tree, listing=repo_listing(spark, hidden_tree))
    chosen = select_files(whole, PROFILES["service"])
    assert sorted(map(str, service.collect())) == sorted(map(str, chosen.collect()))


def test_a_package_that_only_holds_init_is_local(spark, hidden_tree):
    registry = spark.createDataFrame(
        [("pypi", "pkg", False, datetime(2024, 1, 1)), ("pypi", "gone", False, datetime(2024, 1, 1))],
        "ecosystem string, name string, exists boolean, checked_at timestamp",
    )
    found = scan(source_files(spark, hidden_tree), PROFILES["directory"], repo_listing(spark, hidden_tree), registry)
    missing = found.filter("rule_id = 'P001'").select("path", "line_no").collect()
    assert [tuple(r) for r in missing] == [("main.py", 2)]


def test_an_empty_directory_is_an_empty_table(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert source_files(spark, str(tmp_path / "empty")).count() == 0
    assert repo_listing(spark, str(tmp_path / "empty")).count() == 0


def test_one_repository(spark, tree):
    listing = repo_listing(spark, f"{tree}/two", repo="second").filter("size_bytes <= 100")
    rows = source_files(spark, f"{tree}/two", repo="second", listing=listing)
    assert {(r["repo"], r["path"]) for r in rows.collect()} == {
        ("second", "web/A.JS"), ("second", "web/view.TSX")}


def test_directory_scan(spark, tree):
    files = source_files(spark, tree)
    found = scan(files, PROFILES["directory"], repo_listing(spark, tree)).collect()
    assert sorted((r["repo"], r["path"], r["line_no"], r["rule_id"]) for r in found) == [
        ("one", "app/main.py", 1, "C003"),
        ("one", "app/main.py", 2, "C001"),
        ("two", "web/A.JS", 1, "I003"),
    ]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_the_text_is_read_once(spark, tree, tmp_path):
    """One scan reads the code, without an exchange; what a scan returns starts from the stored facts."""
    source_files(spark, tree).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    plan = _plan(file_facts(files, list(DETECTORS.values())))
    assert plan.count("code:string") == 1 and "Exchange" not in plan
    registry = spark.createDataFrame([("pypi", "x", False)], "ecosystem string, name string, exists boolean")
    found = scan(files, PROFILES["directory"], registry=registry)
    assert "code:string" not in _plan(found) and found.count() == 3
    assert "code:string" not in _plan(scan_summary(spark, "/root/testdata/sf0.001"))


def test_listing_reads_paths_only(spark, tree):
    listing = repo_listing(spark, tree)
    assert {r["path"] for r in listing.collect()} >= {"README.md", "app/settings.py"}
    assert listing.columns == ["repo", "path", "is_dir", "size_bytes"]
    assert [(r["repo"], r["dir"]) for r in dirs_with_settings(listing).collect()] == [("one", "app")]


def test_profiles_differ_in_suffix_case_and_size(spark):
    rows = [("r", "a.PY", 10), ("r", "b.py", 10), ("r", "c.py", 200_001), ("r", "vendor/d.py", 10),
            ("r", "env/e.py", 10)]
    frame = spark.createDataFrame(rows, FILES)

    def chosen(name):
        return {r["path"] for r in select_files(frame, PROFILES[name]).collect()}

    assert chosen("directory") == {"a.PY", "b.py", "c.py", "vendor/d.py"}
    assert chosen("local") == {"b.py", "env/e.py"}
    assert chosen("service") == {"b.py", "env/e.py"}


def test_size_limit_before_or_after_the_cap(spark):
    big = [("r", f"a{i:03}.py", 300_000) for i in range(5)]
    small = [("r", f"b{i:03}.py", 10) for i in range(300)]
    frame = spark.createDataFrame(big + small + [("q", "x.py", 1)], FILES)
    # Oversize files use up places of the rescan cap, but not of the local one.
    assert select_files(frame, PROFILES["local"]).filter("repo = 'r'").count() == 300
    assert select_files(frame, PROFILES["rescan"]).filter("repo = 'r'").count() == 295
    scope = {r["repo"]: tuple(r)[1:] for r in scan_scope(frame, PROFILES["rescan"]).collect()}
    assert scope == {"r": (295, True), "q": (1, False)}


def test_cap_is_exact_for_a_hot_repository(spark):
    rows = [("hot", f"{i:05}.py", 1) for i in range(3000)] + [("cold", "a.py", 1)]
    frame = spark.createDataFrame(rows, FILES).repartition(7)
    got = sorted((r["repo"], r["path"]) for r in cap_files(frame.select("repo", "path"), 25).collect())
    assert got == [("cold", "a.py")] + [("hot", f"{i:05}.py") for i in range(25)]


def test_only_small_tables_are_spread(spark):
    frame = spark.range(10).select(F.col("id"))
    assert spread(frame.coalesce(1), "id").rdd.getNumPartitions() > 1
    enough = frame.repartition(spark.sparkContext.defaultParallelism)
    assert spread(enough, "id") is enough


def test_findings_are_written_and_read(spark, tree, tmp_path):
    found = scan(source_files(spark, tree), PROFILES["directory"])
    for fmt in ("parquet", "json"):
        write_findings(found, str(tmp_path / fmt), fmt)
        back = spark.read.format(fmt).load(str(tmp_path / fmt))
        assert set(back.columns) == set(export_findings(found).columns)
        assert back.count() == 3


def test_a_repeated_batch_of_the_scan_log_counts_once(spark, tmp_path):
    summary = spark.createDataFrame([("r", 3, 9)], "repo string, total_findings long, files_scanned long")
    for batch in (1, 2, 1):
        append_scan_log(summary, str(tmp_path / "log"), F.lit(datetime(2024, 1, 1, batch)), batch)
    rows = load_scan_log(spark, str(tmp_path / "log")).collect()
    assert sorted((r["repo"], r["findings"], r["files"], r["ts"].hour) for r in rows) == [
        ("r", 3, 9, 1), ("r", 3, 9, 2)
    ]


def test_registry_snapshot_expires(spark, tmp_path):
    now = datetime(2024, 1, 2)
    rows = [("npm", "fresh", False, now - timedelta(hours=24)),
            ("npm", "old", False, now - timedelta(hours=24, seconds=1)),
            ("npm", "changed", False, now - timedelta(hours=3)),
            ("npm", "changed", True, now - timedelta(hours=1))]
    spark.createDataFrame(
        rows, "ecosystem string, name string, exists boolean, checked_at timestamp"
    ).write.parquet(str(tmp_path / "reg"))
    got = load_package_registry(spark, str(tmp_path / "reg"), F.lit(now)).collect()
    assert sorted((r["name"], r["exists"]) for r in got) == [("changed", True), ("fresh", False)]


def test_repo_batches(spark, tmp_path):
    files = []
    for number, results in enumerate(
        [[{"owner": "Ann", "repo": "Tool", "stars": 3}, {"owner": "bob", "repo": "x"}],
         [{"owner": "ann", "repo": "tool"}, {"owner": "cy", "repo": "y"}]]
    ):
        file = tmp_path / f"batch-{number}.json"
        file.write_text(json.dumps({"results": results}, indent=1))
        files.append(str(file))
    batches = load_repo_batches(spark, files)
    assert batches.count() == 4
    got = sorted((r["repo_key"], r["owner"], r["batch_no"]) for r in dedupe_repos(batches).collect())
    assert got == [("ann/tool", "Ann", 1), ("bob/x", "bob", 1), ("cy/y", "cy", 2)]
