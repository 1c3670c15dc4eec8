"""Queries over tool output: test runs, lint lines and diffs written from parts; the SQL states the numbers that went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import lint as L
from sparkloom.operators import runners as R

# Output of a run with p passed, f failed and s skipped tests, and what a summary of it says: passed, failed, skipped, ms, failures.
RUNS = {
    "dotnet_test": ("'Failed My.Test.Case [1 s]' || chr(10) || 'Total tests: 9' || chr(10) || 'Passed: ' || p || chr(10) || 'Failed: ' || f || chr(10) || 'Skipped: ' || s || chr(10) || 'Total time: 2.5 S'", ("p", "f", "s", "2500", "['My.Test.Case']")),
    "cargo_test": ("'running 3 tests' || chr(10) || '---- a::b stdout ----' || chr(10) || 'test result: FAILED. ' || p || ' passed; ' || f || ' failed; ' || s || ' ignored; 0 measured; finished in 1.5s' || chr(10) || 'test result: ok. 2 passed; 1 failed; 1 ignored; finished in 9s'", ("p + 2", "f + 1", "s + 1", "1500", "['a::b']")),
    "googletest": ("'[==========] 9 tests ran. (12 ms total)' || chr(10) || '[  PASSED  ] ' || p || ' tests.' || chr(10) || '[  SKIPPED ] ' || s || ' tests' || chr(10) || '[  FAILED  ] ' || f || ' tests, listed below:' || chr(10) || '[  FAILED  ] Suite.Case'", ("p", "f", "s", "12", "['Suite.Case']")),
    "catch2": ("'a.cpp:12: FAILED:' || chr(10) || 'test cases: 9 | ' || p || ' passed | ' || f || ' failed | ' || s || ' skipped' || chr(10) || 'assertions: 4 | 4 passed'", ("p", "f", "s", "NULL", "['a.cpp:12']")),
    "swift_testing": ("'Test run with ' || (p + f) || ' tests completed after 0.5 seconds with ' || f || ' issues.'", ("p", "f", "0", "500", "[]")),
    "xctest": ("'Test Case ''-[A b]'' failed (0.1 seconds)' || chr(10) || 'Executed 1 test, with 0 failures (0 unexpected) in 9.0 (9.1) seconds' || chr(10) || 'Executed ' || (p + f) || ' tests, with ' || f || ' failures (0 unexpected) in 0.25 (0.3) seconds'", ("p", "f", "0", "250", "['-[A b]']")),
    "vitest": ("' Test Files  1 failed' || chr(10) || '  Tests  ' || f || ' failed | ' || p || ' passed | ' || s || ' skipped | 2 todo' || chr(10) || '  × adds up' || chr(10) || ' × x.test.ts (3)' || chr(10) || ' Duration  1.25s'", ("p", "f", "s + 2", "1250", "['adds up']")),
    "jest": ("'Test Suites: 1 failed' || chr(10) || '● sum › adds' || chr(10) || 'Tests:       ' || (f + 1) || ' failed, ' || p || ' passed, ' || (p + f + 1) || ' total' || chr(10) || 'Time:        3.5s'", ("p", "f + 1", "0", "3500", "['sum › adds']")),
    "exunit": ("'  1) test greets (MyTest)' || chr(10) || '     test/my_test.exs:5' || chr(10) || 'Finished in 0.75 seconds' || chr(10) || (p + f) || ' tests, ' || f || ' failures, ' || s || ' excluded, 1 skipped'", ("p", "f", "s + 1", "750", "['greets']")),
    "go_test": ("'--- PASS: TestA (0.00s)' || chr(10) || '--- FAIL: TestB (0.00s)' || chr(10) || '--- SKIP: TestC (0.00s)' || chr(10) || 'ok  ' || chr(9) || 'pkg' || chr(9) || '0.5s'", ("1", "1", "1", "500", "['TestB']")),
    "pytest": ("'collected 9 items' || chr(10) || 'FAILED tests/test_a.py::test_b - assert' || chr(10) || '==== ' || f || ' failed, ' || p || ' passed, ' || s || ' skipped in 0.5s ===='", ("p", "f", "s", "500", "['test_b']")),
}
NAMES = list(RUNS)
NUMBERS = "SELECT p_partkey AS id, p_partkey % 12 AS kind, CAST(p_size AS BIGINT) AS p, p_partkey % 4 AS f, p_partkey % 3 AS s FROM part"
TEXT = "CASE kind " + " ".join(f"WHEN {k} THEN {RUNS[n][0]}" for k, n in enumerate(NAMES)) + " ELSE 'nothing here' END"

LINT = """SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, string_agg_(CASE p_partkey % 5 WHEN 0 THEN 'src/f' || (p_size % 3) || '.py:10:5: E50' || (p_size % 4) || ' Line too long ' || p_partkey
 WHEN 1 THEN 'warning[W' || (p_size % 3) || ']: unused thing' || chr(10) || '  --> src/lib.rs:1:1' WHEN 2 THEN 'A' || (p_size % 2) || '.cs(10,5): ' || CASE WHEN p_size % 2 = 0 THEN 'error' ELSE 'warning' END || ' CA182' || (p_size % 3) || ': message ' || p_partkey ELSE 'nothing to see' END) AS text FROM part GROUP BY 1"""
DIFF = """SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS doc, string_agg_('diff --git a/x b/x' || chr(10) || '--- a/x' || chr(10) || '+++ b/' || CASE p_size % 3 WHEN 0 THEN 'Cargo.lock' ELSE 'src/f' || p_partkey || '.rs' END || chr(10) || '@@ -1 +1 @@' || chr(10)
 || CASE p_size % 4 WHEN 0 THEN '+   ' || chr(10) || '-' WHEN 1 THEN '+x' || repeat(chr(10) || '-y', 90) ELSE '+new' || chr(10) || ' same' END) AS text FROM part GROUP BY 1"""
IN_ORDER = {"spark": "array_join(transform(array_sort(collect_list(struct(p_partkey, {x} AS v))), e -> e.v), chr(10))", "duck": "string_agg({x}, chr(10) ORDER BY p_partkey)"}


def ordered(sql: str, engine: str) -> str:
    """SQL with `string_agg_(x)` written as an aggregate of an engine that joins lines by key."""
    at = sql.index("string_agg_(")
    depth, end = 0, at + len("string_agg_")
    while True:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
        if not depth:
            break
    return sql[:at] + IN_ORDER[engine].format(x=sql[at + len("string_agg_(") : end - 1]) + sql[end:]


def view(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf}/part.parquet"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, f"SELECT id, {TEXT} AS text FROM ({NUMBERS})")


def lint(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, ordered(LINT, "spark"))


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, ordered(DIFF, "spark"))


QUERIES = {
    "a15_runner": lambda s, d: runs(s, d).select("id", R.runner(F.col("text")).alias("runner")),
    "a16_a26_run_summaries": lambda s, d: R.summarize(runs(s, d)),
    "a10_lint_entries": lambda s, d: L.entries(lint(s, d)).groupBy("file", "rule", "severity").agg(F.count("*").alias("n"), F.min("message").alias("least"), F.max("message").alias("most")),
    "a11_lint_groups": lambda s, d: L.grouped(L.entries(lint(s, d))),
    "a12_diff_files": lambda s, d: L.diff_files(diffs(s, d)).select("doc", "file_no", "file", "skipped", "collapsed", F.length("output").alias("chars")),
    "a14_diff_stats": lambda s, d: L.diff_files(diffs(s, d)).groupBy("doc").agg(F.count_if(~F.col("skipped")).alias("kept"), F.count_if(F.col("skipped")).alias("skipped"), F.sum("collapsed").alias("collapsed")),
}




ENTRIES = """e AS (SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS doc, p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'src/f' || (p_size % 3) || '.py' WHEN 1 THEN 'unknown' ELSE 'A' || (p_size % 2) || '.cs' END AS file,
 CASE p_partkey % 5 WHEN 0 THEN 'E50' || (p_size % 4) WHEN 1 THEN 'W' || (p_size % 3) ELSE 'CA182' || (p_size % 3) END AS rule, CASE WHEN p_partkey % 5 = 2 AND p_size % 2 = 0 THEN 'error' ELSE 'warning' END AS severity,
 CASE p_partkey % 5 WHEN 0 THEN 'Line too long ' || p_partkey WHEN 1 THEN 'u' ELSE 'message ' || p_partkey END AS message FROM part WHERE p_partkey % 5 < 3)"""
FILES = """SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS doc, row_number() OVER (PARTITION BY floor(p_partkey / 10) ORDER BY p_partkey) AS file_no, CASE p_size % 3 WHEN 0 THEN 'Cargo.lock' ELSE 'src/f' || p_partkey || '.rs' END AS file,
 p_size % 3 = 0 OR p_size % 4 = 0 AS skipped, CAST(p_size % 4 = 1 AS BIGINT) AS collapsed, length(CASE p_size % 3 WHEN 0 THEN 'Cargo.lock' ELSE 'src/f' || p_partkey || '.rs' END) + CASE p_size % 4 WHEN 0 THEN 53 WHEN 1 THEN 71 ELSE 57 END AS chars FROM part"""

ORACLES = {
    "a15_runner": "SELECT id, CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + f" END AS runner FROM ({NUMBERS})",
    "a16_a26_run_summaries": " UNION ALL ".join(f"SELECT id, '{n}' AS runner, CAST({RUNS[n][1][0]} AS BIGINT) AS passed, CAST({RUNS[n][1][1]} AS BIGINT) AS failed, CAST({RUNS[n][1][2]} AS BIGINT) AS skipped, CAST({RUNS[n][1][3]} AS BIGINT) AS duration_ms, CAST({RUNS[n][1][4]} AS VARCHAR[]) AS failures FROM ({NUMBERS}) WHERE kind = {k}" for k, n in enumerate(NAMES)),
    "a10_lint_entries": f"WITH {ENTRIES} SELECT file, rule, severity, count(*) AS n, min(message) AS least, max(message) AS most FROM e GROUP BY ALL",
    "a11_lint_groups": f"WITH {ENTRIES}, f AS (SELECT doc, rule, severity, file, min(k) AS k, arg_min(message, k) AS message, count(*) AS n FROM e GROUP BY ALL) SELECT doc, rule, severity, arg_min(message, k) AS message, CAST(sum(n) AS BIGINT) AS n, list(file ORDER BY k) AS files FROM f GROUP BY doc, rule, severity",
    "a12_diff_files": FILES,
    "a14_diff_stats": f"SELECT doc, count(*) FILTER (NOT skipped) AS kept, count(*) FILTER (skipped) AS skipped, CAST(sum(collapsed) AS BIGINT) AS collapsed FROM ({FILES}) GROUP BY doc",
}
