"""Usage analytics over logs of filtered commands.

A log has ts, command, filter_name, mode, project, input_bytes, output_bytes, duration_ms, failed, error_message. All
are aggregations with partial sums; top-k reports are TakeOrdered, so no full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens


def compression_ratio(log: DataFrame) -> DataFrame:
    return log.withColumn("ratio", F.when(F.col("input_bytes") > 0, F.col("output_bytes") / F.col("input_bytes")).otherwise(0.0))


def totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("invocations"))


def by_filter(log: DataFrame) -> DataFrame:
    """Per filter; the ratio is of the sums, savings may be negative."""
    return log.groupBy("filter_name").agg(
        F.count("*").alias("invocations"),
        F.sum("input_bytes").alias("input_bytes"),
        F.sum("output_bytes").alias("output_bytes"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.sum(F.when(F.col("failed"), 1).otherwise(0)).alias("failures"),
    ).select(
        "*",
        F.when(F.col("input_bytes") > 0, F.col("output_bytes") / F.col("input_bytes")).otherwise(0.0).alias("ratio"),
        tokens(F.col("input_bytes")).alias("input_tokens"),
        tokens(F.col("input_bytes") - F.col("output_bytes")).alias("saved_tokens"),
    )


def saved(n_in: Column, n_out: Column) -> Column:
    """Tokens saved, not under zero."""
    return tokens(F.greatest(F.lit(0), n_in - n_out))


def by_mode(log: DataFrame) -> DataFrame:
    return log.groupBy("mode").agg(F.count("*").alias("invocations"), saved(F.sum("input_bytes"), F.sum("output_bytes")).alias("saved_tokens"))


def by_project(log: DataFrame, k: int = 10) -> DataFrame:
    """The k projects with most invocations, each with its most frequent filter (ties by name)."""
    counted = log.where(F.col("project").isNotNull()).groupBy("project", "filter_name").agg(F.count("*").alias("n"), F.sum("input_bytes").alias("i"), F.sum("output_bytes").alias("o"))
    return counted.groupBy("project").agg(F.sum("n").alias("invocations"), saved(F.sum("i"), F.sum("o")).alias("saved_tokens"), F.min_by("filter_name", F.struct(-F.col("n"), F.col("filter_name"))).alias("top_filter")).orderBy(F.desc("invocations"), "project").limit(k)


def last_failures(log: DataFrame, k: int = 20) -> DataFrame:
    return log.where("failed").select("ts", "event_id", "filter_name", F.coalesce("error_message", F.lit("unknown")).alias("error_message")).orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def both_logs(filters: DataFrame, commands: DataFrame) -> DataFrame:
    """Rows of two logs with their source, to be aggregated together."""
    names = ["ts", "input_bytes", "output_bytes"]
    return filters.select(*names, F.lit("filter").alias("source")).unionByName(commands.select(*names, F.lit("command").alias("source")))


def combined_totals(rows: DataFrame) -> DataFrame:
    sums = rows.agg(F.count("*").alias("invocations"), F.sum("input_bytes").alias("input_bytes"), F.sum("output_bytes").alias("output_bytes"))
    return sums.withColumn("savings_pct", F.when(F.col("input_bytes") > 0, 100.0 * (F.col("input_bytes") - F.col("output_bytes")) / F.col("input_bytes")).otherwise(0.0))


def by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("invocations"), saved(F.sum("input_bytes"), F.sum("output_bytes")).alias("saved_tokens"))


def daily(rows: DataFrame, days: int = 30) -> DataFrame:
    """The last days, newest first: sums by source and day, then by day."""
    parts = rows.groupBy(F.to_date("ts").alias("day"), "source").agg(F.count("*").alias("n"), F.sum("input_bytes").alias("i"), F.sum("output_bytes").alias("o"))
    out = parts.groupBy("day").agg(F.sum("n").alias("invocations"), saved(F.sum("i"), F.sum("o")).alias("saved_tokens"))
    return out.orderBy(F.desc("day")).limit(days)


def session(log: DataFrame, session_id: int) -> DataFrame:
    """What a session did, newest first."""
    return log.where(F.col("session_id") == session_id).orderBy(F.desc("ts"), F.desc("event_id"))


def census(entities: DataFrame, kind: str, state: str) -> DataFrame:
    """Counts in total, by kind, by state and by both, in one pass; `level` tells which."""
    return entities.cube(kind, state).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def board(tasks: DataFrame, statuses: list[str], limit: int = 500) -> DataFrame:
    """Tasks by status, in a board that takes the first `limit` by id."""
    taken = tasks.orderBy("task_id").limit(limit).where(F.col("status").isin(statuses))
    return taken.groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("task_id")).alias("tasks"))


def top_extensions(files: DataFrame, k: int = 15) -> DataFrame:
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).orderBy(F.desc("files"), "ext").limit(k)


def staleness(items: DataFrame, age: Column) -> DataFrame:
    """Numbers by age in days, and the oldest."""
    n = lambda c: F.count_if(c)
    return items.agg(n(age <= 30).alias("fresh"), n((age > 30) & (age <= 90)).alias("months"), n((age > 90) & (age <= 365)).alias("year"), n(age > 365).alias("older"), F.max(age).alias("oldest"))


def rollup(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by keys from left to right, with totals."""
    return findings.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def suggested_bump(changes: DataFrame) -> DataFrame:
    counts = changes.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("breaking", "minor", "patch")))
    return counts.withColumn("bump", F.when(F.col("breaking") > 0, "major").when(F.col("minor") > 0, "minor").otherwise("patch"))


def run_account(outcomes: DataFrame) -> DataFrame:
    """Outcomes of a run; candidates are those extracted, skipped or failed."""
    counts = outcomes.agg(*(F.count_if(F.col("outcome") == s).alias(s) for s in ("extracted", "skipped", "failed", "timeout")))
    return counts.withColumn("candidates", F.col("extracted") + F.col("skipped") + F.col("failed"))
