"""File streams give what the batch gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codesift.functions import paths
from codesift.operators.detectors import DETECTORS
from codesift.operators.engine import detect
from codesift.operators.packages import fresh_registry
from codesift.plans.scan import scan
from codesift.sources.cases import cases
from codesift.sources.files import PROFILES, file_table_stream, source_files_stream
from codesift.streaming.history import answer_changes, answers_stream, current_answers, scan_log_rollup_stream
from codesift.streaming.scan import changes, publish_batch, published_findings, scan_stream


def _files(spark):
    rows = [
        (f"r{c['number'] % 6}", f"{c['number']}/" + c["path"].replace("{key}", "7"), c["code"])
        for c in cases()
    ]
    frame = spark.createDataFrame(rows, "repo string, path string, code string")
    return frame.select(
        "repo", "path", paths.language_of(F.col("path")).alias("language"),
        F.length("code").cast("long").alias("size_bytes"), "code",
    )


def test_scan_stream_publishes_the_batch_findings(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    extra = [
        ("dj", "app/settings.py", "DEBUG = True"),
        ("dj", "app/views.py", "import gone\nimport app\nclass V(View):\n    def get(self, request):\n"
         "        return Order.objects.filter(id=1)\n"),
        ("dj", "auth.py", "@login_required\ndef f():\n    pass\n"),
        ("dj", "app/migrations/m.py", "import gone\n"), ("dj", "setup.py", ""),
    ]
    more = spark.createDataFrame(extra, "repo string, path string, code string").select(
        "repo", "path", paths.language_of(F.col("path")).alias("language"),
        F.length("code").cast("long").alias("size_bytes"), "code",
    )
    files = _files(spark).unionByName(more)
    registry = spark.createDataFrame(
        [("pypi", name, False, datetime(2024, 1, 1)) for name in ("gone", "app")],
        "ecosystem string, name string, exists boolean, checked_at timestamp",
    )
    files.repartition(3).write.parquet(source)
    stream = file_table_stream(spark, source, max_files=1)
    query = (
        scan_stream(stream, folder, registry)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    got = published_findings(spark, folder)
    whole = scan(files, PROFILES["directory"], registry=registry)
    assert sorted(got.columns) == sorted(whole.columns)
    kept = [c for c in whole.columns if c != "evidence"]
    left, right = (sorted(map(str, frame.select(*kept).collect())) for frame in (got, whole))
    assert left == right and len(left) > 100
    rules = {(r["path"], r["rule_id"], r["severity"]) for r in got.filter("repo = 'dj'").collect()}
    assert ("app/views.py", "A001", "low") in rules and ("app/views.py", "P001", "high") in rules
    assert not any(path == "app/migrations/m.py" for path, _, _ in rules)


def test_binary_files_stream(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "one" / "src").mkdir(parents=True)
    (root / "one" / "src" / "a.py").write_bytes(b"s.verify = False\r\n")
    (root / "one" / ".github" / "_x").mkdir(parents=True)
    (root / "one" / ".github" / "_x" / "__init__.PY").write_bytes(b"\ns.verify = False\n")
    (root / "one" / ".github" / "_x" / "notes.md").write_bytes(b"s.verify = False\n")
    stream = source_files_stream(spark, str(root), str(tmp_path / "log"), settle_seconds=0)
    query = (
        detect(stream, [DETECTORS["tls_disabled"]])
        .writeStream.format("memory").queryName("tls_found").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    rows = spark.table("tls_found").collect()
    assert sorted((r["repo"], r["path"], r["line_no"], r["rule_id"]) for r in rows) == [
        ("one", ".github/_x/__init__.PY", 2, "C003"), ("one", "src/a.py", 1, "C003"),
    ]


def test_binary_files_stream_goes_on(spark, tmp_path):
    """A restarted stream reads what landed since, once."""
    root, out = tmp_path / "tree", str(tmp_path / "out")
    for name in ("a.py", "_b.py"):
        (root / "one").mkdir(parents=True, exist_ok=True)
        (root / "one" / name).write_bytes(b"x = 1\n")
        query = (
            source_files_stream(spark, str(root), str(tmp_path / "log"), settle_seconds=0).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
    assert sorted(r["path"] for r in spark.read.parquet(out).collect()) == ["_b.py", "a.py"]


def test_scan_log_rollup_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(f"r{i}", i, 10, start + timedelta(minutes=7 * i)) for i in range(60)]
    rows.append(("end", 0, 0, start + timedelta(days=3)))
    schema = "repo string, findings long, files long, ts timestamp"
    folder = str(tmp_path / "log")
    for part in (rows[:30], rows[30:60], rows[60:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    query = (
        scan_log_rollup_stream(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {r["bucket_start"]: (r["scans"], r["findings"]) for r in spark.read.parquet(out).collect()}
    expected = {}
    for _, findings, _, ts in rows[:60]:
        hour = ts.replace(minute=0)
        scans, total = expected.get(hour, (0, 0))
        expected[hour] = (scans + 1, total + findings)
    assert got == expected


def test_registry_answers_are_renewed(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("npm", "left", True, start), ("npm", "left", True, start),
            ("npm", "left", True, start + timedelta(hours=20)), ("pypi", "left", True, start)]
    schema = "ecosystem string, name string, exists boolean, checked_at timestamp"
    folder = str(tmp_path / "registry")
    spark.createDataFrame(rows, schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    query = (
        answers_stream(stream).writeStream.format("memory").queryName("answers")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert spark.table("answers").count() == 3
    now = F.lit(start + timedelta(hours=30))
    fresh = fresh_registry(spark.table("answers"), now).collect()
    assert [(r["ecosystem"], r["name"]) for r in fresh] == [("npm", "left")]


def _code(spark, *rows):
    return spark.createDataFrame(list(rows), "repo string, path string, code string").select(
        "repo", "path", paths.language_of(F.col("path")).alias("language"), "code"
    )


def test_later_files_change_only_their_repository(spark, tmp_path):
    """An auth word, a settings module, a rewritten file and a package of the project that land later."""
    folder = str(tmp_path / "out")
    view = "class V(View):\n    def get(self, request):\n        return Order.objects.filter(id=1)\n"
    registry = spark.createDataFrame(
        [("pypi", "gone", False, datetime(2024, 1, 1))],
        "ecosystem string, name string, exists boolean, checked_at timestamp",
    )
    batches = [
        _code(spark, ("a", "v.py", view), ("b", "v.py", view + "import gone\n"), ("c", "x.py", "s.verify = False\n")),
        _code(spark, ("a", "auth.py", "current_user = 1\n"), ("c", "y.py", "import gone\n"), ("c", "setup.py", "")),
        _code(spark, ("a", "settings.py", "D = 1\n"), ("c", "gone.py", ""), ("c", "x.py", "\ns.verify = False\n")),
        _code(spark, ("d", "empty.py", "")),
    ]
    for number, batch in enumerate(batches):
        for _ in range(1 + (number == 1)):  # the second batch is repeated, as after a failure
            publish_batch(batch, number, folder, registry)
    found = sorted(
        (r["batch"], r["op"], r["repo"], r["path"], r["line_no"], r["rule_id"], r["severity"])
        for r in changes(spark, folder).collect()
    )
    assert found == [
        (0, 1, "b", "v.py", 4, "P001", "high"), (0, 1, "c", "x.py", 1, "C003", "high"),
        (1, 1, "a", "v.py", 2, "A001", "medium"), (1, 1, "c", "y.py", 1, "P001", "high"),
        (2, -1, "a", "v.py", 2, "A001", "medium"), (2, -1, "c", "x.py", 1, "C003", "high"),
        (2, -1, "c", "y.py", 1, "P001", "high"), (2, 1, "a", "v.py", 2, "A001", "low"),
        (2, 1, "c", "x.py", 2, "C003", "high"),
    ]
    left = sorted((r["repo"], r["rule_id"], r["severity"]) for r in published_findings(spark, folder).collect())
    assert left == [("a", "A001", "low"), ("b", "P001", "high"), ("c", "C003", "high")]


def test_expired_answers_are_told(spark, tmp_path):
    """At every batch, the changes so far add up to the fresh registry as of the watermark."""
    start, schema = datetime(2024, 1, 1), "ecosystem string, name string, exists boolean, checked_at timestamp"
    hours = [[("left", True, 0), ("right", False, 1)], [("left", False, 20), ("late", True, 19.5)], [("x", True, 26)],
             [("right", True, 46), ("left", False, 46)], [("y", False, 72)], [("y", True, 72)], [("z", True, 100)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen, everything = [], []
    for rows in hours:
        rows = [("npm", name, exists, start + timedelta(hours=hour)) for name, exists, hour in rows]
        everything += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = (
            answer_changes(stream, lateness="1 hour").writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(180)
        told = spark.read.parquet(out)
        mark = max(row[3] for row in everything) - timedelta(hours=1)
        fresh = fresh_registry(spark.createDataFrame(everything, schema), F.lit(mark))
        got, expected = (
            sorted((r["name"], r["exists"], r["checked_at"]) for r in frame.collect())
            for frame in (current_answers(told), fresh)
        )
        assert got == expected
        seen.append(told.filter("expired").count())
    assert seen[-1] > seen[3] > 0
