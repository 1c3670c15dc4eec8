"""Summaries of test runs from the text that runners print, one row for each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import first_group, lines, trim


def has(text: Column, *words: str) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & text.contains(w)
    return out


def runner(text: Column) -> Column:
    """The runner that wrote a text, the first that fits; null if none does."""
    return (
        F.when(has(text, "Test Run Successful") | has(text, "Test Run Failed") | has(text, "Total tests:"), "dotnet_test")
        .when(has(text, "running ", "test result:"), "cargo_test")
        .when(has(text, "[==========]", "[  PASSED  ]"), "googletest")
        .when(has(text, "test cases:", "assertions:"), "catch2")
        .when(has(text, "Test run", "tests completed"), "swift_testing")
        .when(has(text, "Executed", "tests, with", "failure"), "xctest")
        .when(has(text, "Test Files") & (has(text, "Duration") | has(text, "Start at")), "vitest")
        .when(has(text, "Tests:", "Suites:"), "jest")
        .when(~has(text, "test cases:") & (has(text, "tests,") | has(text, "test,")) & (has(text, "failure") | has(text, "Finished in")), "exunit")
        .when(has(text, "--- PASS:") | has(text, "--- FAIL:") | has(text, "PASS\nok") | has(text, "ok  \t"), "go_test")
        .when(has(text, "passed") & (has(text, "====") | has(text, "collected") | has(text, "pytest")), "pytest")
    )


def number(text: Column, pattern: str, group: int = 1) -> Column:
    """A number of the first match, zero without one."""
    return F.coalesce(first_group(text, pattern, group).try_cast("bigint"), F.lit(0))


def last_number(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.element_at(F.concat(F.array(F.lit("0")), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))), -1).try_cast("bigint"), F.lit(0))


def total(text: Column, pattern: str, group: int) -> Column:
    """Sum over all matches."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def seconds(text: Column, pattern: str, group: int = 1) -> Column:
    """Milliseconds from the first match in seconds; null without one."""
    return (first_group(text, pattern, group).try_cast("double") * 1000).cast("bigint")


def names(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


CARGO = r"test result: \w+\.\s+([0-9]+) passed;\s+([0-9]+) failed;\s+([0-9]+) ignored"
JEST = r"Tests:\s+(?:([0-9]+) failed,\s+)?(?:([0-9]+) skipped,\s+)?(?:([0-9]+) passed,\s+)?([0-9]+) total"
XCTEST = r"Executed ([0-9]+) tests?, with ([0-9]+) failures? \([0-9]+ unexpected\) in ([0-9]+\.?[0-9]*) \("
SWIFT = r"Test run with ([0-9]+) tests? completed after ([0-9]+\.?[0-9]*) seconds? with ([0-9]+) issues?"
SECONDS = r"in ([0-9]+\.?[0-9]*)s"


def summaries(text: Column) -> dict[str, tuple[Column, Column, Column, Column, Column]]:
    """For each runner: passed, failed, skipped, milliseconds, failed tests."""
    tests_line = F.coalesce(F.get(F.filter(F.transform(lines(text), trim), lambda x: x.startswith("Tests")), 0), F.lit(""))
    detail = F.regexp_extract(text, r"test cases:\s+[0-9]+\s+\|(.+)", 1)
    swift_marks = F.regexp_count(text, F.lit("✔ Test (.+?) passed")), F.regexp_count(text, F.lit("✘ Test (.+?) failed"))
    swift_any = swift_marks[0] + swift_marks[1] > 0
    zero = F.lit(0).cast("bigint")
    less = lambda a, b: F.greatest(zero, a - b)
    xc = F.filter(F.transform(names(text, "Test Case '(.+)' failed"), lambda x: x), lambda x: x != "")
    return {
        "dotnet_test": (number(text, r"Passed:\s*([0-9]+)"), number(text, r"Failed:\s*([0-9]+)"), number(text, r"Skipped:\s*([0-9]+)"), seconds(text, r"(?:Duration|Total time):\s*([0-9]+\.?[0-9]*)\s*[sS]"), names(text, r"(?m)^\s*Failed\s+([\w.]+)")),
        "cargo_test": (total(text, CARGO, 1), total(text, CARGO, 2), total(text, CARGO, 3), seconds(text, r"finished in ([0-9]+\.?[0-9]*)s"), names(text, r"---- ([\w:]+) stdout ----")),
        "googletest": (number(text, r"\[\s+PASSED\s+\]\s+([0-9]+) tests?"), number(text, r"\[\s+FAILED\s+\]\s+([0-9]+) tests?,\s+listed below"), number(text, r"\[\s+SKIPPED\s+\]\s+([0-9]+) tests?"), first_group(text, r"\[==========\].*\(([0-9]+) ms total\)").try_cast("bigint"), F.filter(names(text, r"(?m)^\[\s+FAILED\s+\]\s+(\S+)\s*$"), lambda x: ~x.contains(","))),
        "catch2": (number(detail, "([0-9]+) passed"), number(detail, "([0-9]+) failed"), number(detail, "([0-9]+) skipped"), seconds(text, SECONDS), names(text, r"(?m)^(.+:[0-9]+): FAILED:")),
        "swift_testing": (F.when(swift_any, swift_marks[0]).otherwise(less(number(text, SWIFT, 1), number(text, SWIFT, 3))), F.when(swift_any, swift_marks[1]).otherwise(number(text, SWIFT, 3)), zero, seconds(text, SWIFT, 2), names(text, "✘ Test (.+?) failed")),
        "xctest": (less(last_number(text, XCTEST, 1), last_number(text, XCTEST, 2)), last_number(text, XCTEST, 2), F.regexp_count(text, F.lit("Test Case .+ skipped")).cast("bigint"), (F.element_at(F.concat(F.array(F.lit(None).cast("string")), names(text, XCTEST, 3)), -1).cast("double") * 1000).cast("bigint"), F.filter(xc, lambda x, i: F.coalesce(x != F.get(xc, i - 1), F.lit(True)))),
        "vitest": (number(tests_line, r"Tests\s+.*?([0-9]+) passed"), number(tests_line, r"Tests\s+.*?([0-9]+) failed"), number(tests_line, r"Tests\s+.*?([0-9]+) skipped") + number(tests_line, r"Tests\s+.*?([0-9]+) todo"), seconds(text, r"Duration\s+([0-9]+\.?[0-9]*)s"), F.filter(F.transform(names(text, r"(?m)^\s*[×✗]\s+(.+)"), trim), lambda x: ~(x.contains(".test.") | x.contains(".spec.") | x.endswith(")")))),
        "jest": (number(text, JEST, 3), number(text, JEST, 1), number(text, JEST, 2), seconds(text, r"Time:\s+([0-9]+\.?[0-9]*)s"), names(text, "● (.+)")),
        "exunit": (less(number(text, r"([0-9]+) tests?,\s+([0-9]+) failures?", 1), number(text, r"([0-9]+) tests?,\s+([0-9]+) failures?", 2)), number(text, r"([0-9]+) tests?,\s+([0-9]+) failures?", 2), number(text, "([0-9]+) excluded") + number(text, "([0-9]+) skipped"), seconds(text, r"Finished in ([0-9]+\.?[0-9]*) seconds?"), names(text, r"(?m)^\s+[0-9]+\)\s+test (.+?)(?:\s+\(\S+\))?\s*\n\s+\S+\.exs?:[0-9]+")),
        "go_test": (F.regexp_count(text, F.lit(r"--- PASS: \S+")).cast("bigint"), F.regexp_count(text, F.lit(r"--- FAIL: \S+")).cast("bigint"), F.regexp_count(text, F.lit(r"--- SKIP: \S+")).cast("bigint"), seconds(text, r"ok\s+\S+\s+([0-9]+\.?[0-9]*)s"), names(text, r"--- FAIL: (\S+)")),
        "pytest": (number(text, "([0-9]+) passed"), number(text, "([0-9]+) failed"), number(text, "([0-9]+) skipped"), seconds(text, SECONDS), names(text, r"FAILED [\w/\\.]+::(\w+)")),
    }


def summarize(runs: DataFrame) -> DataFrame:
    """(id, runner, passed, failed, skipped, duration_ms, failures) of texts (id, text) of a known runner."""
    kind = runner(F.col("text"))
    fields = ("passed", "failed", "skipped", "duration_ms", "failures")
    out = None
    for name, values in summaries(F.col("text")).items():
        found = F.struct(*(v.cast("array<string>" if f == "failures" else "bigint").alias(f) for f, v in zip(fields, values)))
        out = F.when(F.col("runner") == name, found) if out is None else out.when(F.col("runner") == name, found)
    return runs.withColumn("runner", kind).where("runner is not null").withColumn("s", out).select("id", "runner", *(F.col(f"s.{f}").alias(f) for f in fields))
