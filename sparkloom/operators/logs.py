"""Log analytics on tables of numbered lines (doc, line_no, line).

Windows partition by document, never globally: neighbours, runs and last-k are per log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sparkloom.functions.text import trim, truncate_utf8

TIMESTAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[.,]?[0-9]*\s*|\[[0-9]{2}:[0-9]{2}:[0-9]{2}\]\s*)"

# Words that tell what a line reports, tried in this order.
RESOURCE = ("out of memory", "oom", "cannot allocate", "memory allocation failed")
DISK = ("no space left on device", "disk full", "disk quota exceeded")
TIMEOUT = ("timed out", "timeout", "deadline exceeded")
HANDLES = ("too many open files", "ulimit")
FAILURE = ("build failed", "compilation failed", "exit code 1", "exit status 1", "fatal error", "panic", "segfault")
COMPLETION = ("build succeeded", "build successful", "compilation successful")
TESTS_DONE = ("tests passed", "successfully deployed", "deploy complete")
ERRORS = ("error", "failed", "panic", "fatal", "exception")


def by_line() -> WindowSpec:
    return Window.partitionBy("doc").orderBy("line_no")


def any_of(line: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | line.contains(w)
    return out


def is_noise(line: Column) -> Column:
    """Progress bars, lines of nothing but a timestamp, blank lines."""
    bar = line.contains("[==") | line.contains("[##") | (line.contains("...") & line.endswith("%"))
    return bar | line.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\s*\z") | (trim(line) == "")


def is_error(line: Column) -> Column:
    low = F.lower(line)
    return any_of(low, ERRORS) | low.startswith("e ")


def is_warning(line: Column) -> Column:
    low = F.lower(line)
    return low.contains("warn") | low.startswith("w ")


def distill(lines: DataFrame, context: int = 2) -> DataFrame:
    """Errors, else warnings, among lines that are not noise, each with up to `context` lines around it (timestamps cut, blanks left out)."""
    cleaned = F.regexp_replace("line", TIMESTAMP, "")
    near = lambda a, b: F.collect_list("line").over(by_line().rowsBetween(a, b))
    around = lines.withColumn("near", F.concat(near(-context, -1), near(1, context))) if context else lines.withColumn("near", F.array().cast("array<string>"))
    kind = F.when(is_noise(F.col("line")), None).when(is_error(F.col("line")), "error").when(is_warning(F.col("line")), "warning")
    shown = F.filter(F.transform("near", lambda x: F.regexp_replace(x, TIMESTAMP, "")), lambda x: trim(x) != "")
    return around.select("doc", "line_no", kind.alias("kind"), F.col("line").alias("text"), shown.alias("context")).where("kind is not null")


def classify(line: Column) -> Column:
    """What a line reports, the first that holds; null for nothing."""
    low = F.lower(line)
    return (
        F.when(any_of(low, RESOURCE) | any_of(low, DISK), "resource_warning")
        .when(any_of(low, TIMEOUT), "timeout")
        .when(any_of(low, HANDLES) | (low.contains("killed") & low.contains("signal 9")), "resource_warning")
        .when(low.startswith("test result: fail") | any_of(low, FAILURE) | (low.contains("abort") & ~low.contains("aborted")), "failure")
        .when(any_of(low, COMPLETION) | (low.contains("finished") & low.contains("target")) | low.startswith("test result: ok") | (low.contains("passed") & low.contains("failed")) | any_of(low, TESTS_DONE), "completion")
        .when(low.startswith("error") | any_of(low, ("error[", "error:")) | (low.contains("exception") & ~low.contains("no exception")) | low.contains("traceback"), "error")
        .when(low.startswith("warning") | any_of(low, ("warning:", "deprecated")), "warning")
    )


def stalls(lines: DataFrame, threshold: int = 5) -> DataFrame:
    """The first line of each log at which an equal line (blank ones aside) has come `threshold` times in a row."""
    kept = lines.withColumn("line", trim(F.col("line"))).where("line <> ''")
    changed = kept.withColumn("new", F.coalesce(F.col("line") != F.lag("line").over(by_line()), F.lit(True)).cast("int"))
    runs = changed.withColumn("run", F.sum("new").over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    counted = runs.withColumn("n", F.row_number().over(Window.partitionBy("doc", "run").orderBy("line_no")))
    return counted.where(F.col("n") >= threshold).groupBy("doc").agg(F.min(F.struct("line_no", "line")).alias("first")).select("doc", "first.line_no", "first.line")


def repeated(lines: DataFrame, threshold: int = 3) -> DataFrame:
    """Lines that come at least `threshold` times in a log."""
    kept = lines.withColumn("line", trim(F.col("line"))).where("line <> ''")
    found = kept.groupBy("doc", "line").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).where(F.col("n") >= threshold)
    return found.select("doc", truncate_utf8(F.col("line"), 100).alias("text"), "n", "first_line", "last_line")


def monitor(lines: DataFrame, max_events: int = 50, threshold: int = 5) -> DataFrame:
    """One report for each log: counts of its last events, whether it stalled, and its status."""
    stall = stalls(lines, threshold).select("doc", F.col("line_no").alias("stall_line"))
    events = lines.select("doc", "line_no", classify(F.col("line")).alias("kind"), F.lit(0).alias("seq")).where("kind is not null")
    events = events.unionByName(stall.select("doc", F.col("stall_line").alias("line_no"), F.lit("stall").alias("kind"), F.lit(1).alias("seq")))
    last = events.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("line_no"), F.desc("seq")))).where(F.col("rank") <= max_events)
    kinds = ("failure", "resource_warning", "timeout", "completion", "error", "warning")
    counts = last.groupBy("doc").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    report = lines.groupBy("doc").agg(F.count("*").alias("n_lines")).join(counts, "doc", "left").join(stall, "doc", "left")
    report = report.select("doc", "n_lines", *(F.coalesce(k, F.lit(0)).alias(k) for k in kinds), F.col("stall_line").isNotNull().alias("stalled"))
    status = F.when(F.col("failure") > 0, "failed").when((F.col("resource_warning") > 0) | (F.col("timeout") > 0), "resource_warning").when(F.col("stalled"), "stalled").when(F.col("completion") > 0, "completed").when(F.col("error") > 0, "errors").otherwise("healthy")
    return report.withColumn("status", status)
