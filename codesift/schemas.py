"""Schemas of the tables that enter and leave the jobs."""

from __future__ import annotations

SOURCE_FILES = "repo STRING, path STRING, language STRING, size_bytes LONG, code STRING"
LINES = "repo STRING, path STRING, language STRING, line_no INT, line STRING"
FINDINGS = (
    "repo STRING, path STRING, language STRING, line_no INT, rule_id STRING, severity STRING, "
    "sev_rank INT, vuln_class STRING, title STRING, detail STRING, fix STRING, line STRING, "
    "cwe STRING, owasp_category STRING, owasp_rank INT"
)
PACKAGE_REGISTRY = "ecosystem STRING, name STRING, exists BOOLEAN, checked_at TIMESTAMP"
REPO_LISTING = "repo STRING, path STRING, is_dir BOOLEAN"
SCAN_LOG = "repo STRING, findings LONG, files LONG, ts TIMESTAMP"
EXPECTED_FINDINGS = "repo STRING, rule_id STRING, severity STRING, file_suffix STRING"
RULE_CASES = (
    "case_id STRING, path STRING, language STRING, code STRING, rule_id STRING, "
    "expect_fire BOOLEAN, expect_severity STRING, expect_line INT"
)
REQUESTS = "key STRING, ts TIMESTAMP, request_id LONG"
REPO_BATCH_FILE = "results ARRAY<STRUCT<owner: STRING, repo: STRING>>"

FINDING_KEYS = ["repo", "path", "line_no", "rule_id", "severity"]
