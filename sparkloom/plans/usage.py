"""Usage queries: the event stream read as a log of filtered commands, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import usage as U

LOG = """WITH log AS (SELECT ts, event_id, event_type AS filter_name, user_id % 4 AS mode, user_id % 12 AS project,
  user_id AS session_id, CAST(floor(value * 100) AS BIGINT) AS input_bytes, CAST(floor(value * 37) AS BIGINT) AS output_bytes,
  event_id % 1000 AS duration_ms, event_type = 'error' AS failed, CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS error_message FROM events),
commands AS (SELECT o_orderdate AS ts, CAST(floor(o_totalprice) AS BIGINT) AS input_bytes, CAST(floor(o_totalprice / 3) AS BIGINT) AS output_bytes FROM orders),
both_logs AS (SELECT ts, input_bytes, output_bytes, 'filter' AS source FROM log UNION ALL SELECT ts, input_bytes, output_bytes, 'command' FROM commands)
"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        "ts", "event_id", F.col("event_type").alias("filter_name"), (F.col("user_id") % 4).alias("mode"), (F.col("user_id") % 12).alias("project"), F.col("user_id").alias("session_id"),
        F.floor(F.col("value") * 100).alias("input_bytes"), F.floor(F.col("value") * 37).alias("output_bytes"), (F.col("event_id") % 1000).alias("duration_ms"),
        (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("error_message"),
    )


def commands(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_orderdate").alias("ts"), F.floor("o_totalprice").alias("input_bytes"), F.floor(F.col("o_totalprice") / 3).alias("output_bytes"))


def both(spark: SparkSession, sf: str) -> DataFrame:
    return U.both_logs(log(spark, sf), commands(spark, sf))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"))


def files(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("ext"), F.col("n_chars").alias("loc"))


def staleness(spark: SparkSession, sf: str) -> DataFrame:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    newest = o.agg(F.max("o_orderdate").alias("newest"))
    aged = o.crossJoin(F.broadcast(newest)).select(F.datediff("newest", "o_orderdate").alias("age"))
    return U.staleness(aged, F.col("age"))


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 7 == 0, "timeout").when(F.col("event_id") % 2 == 0, "extracted").otherwise("skipped").alias("outcome"))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").select(F.when(F.col("p_size") > 40, "breaking").when(F.col("p_size") > 20, "minor").otherwise("patch").alias("severity"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_mktsegment").alias("kind"), (F.col("c_nationkey") % 3).alias("state"))


QUERIES = {
    "g1_total_invocations": lambda s, d: U.totals(log(s, d)),
    "g2_by_filter": lambda s, d: U.by_filter(log(s, d)),
    "g3_by_mode": lambda s, d: U.by_mode(log(s, d)),
    "g4_by_project": lambda s, d: U.by_project(log(s, d)),
    "g5_last_failures": lambda s, d: U.last_failures(log(s, d)),
    "g6_combined_totals": lambda s, d: U.combined_totals(both(s, d)),
    "g7_by_source": lambda s, d: U.by_source(both(s, d)),
    "g8_daily": lambda s, d: U.daily(both(s, d)),
    "g9_session": lambda s, d: U.session(log(s, d), 7).select("ts", "event_id", "filter_name", "input_bytes"),
    "g10_compression_ratio": lambda s, d: U.compression_ratio(log(s, d)).select("event_id", "ratio"),
    "g12_census_cube": lambda s, d: U.census(customers(s, d), "kind", "state"),
    "g13_board": lambda s, d: U.board(tasks(s, d), ["F", "O"]),
    "g14_top_extensions": lambda s, d: U.top_extensions(files(s, d)),
    "g15_staleness": staleness,
    "g16_severity_rollup": lambda s, d: U.rollup(customers(s, d), "kind", "state"),
    "g17_suggested_bump": lambda s, d: U.suggested_bump(changes(s, d)),
    "g18_counters": lambda s, d: log(s, d).agg(*(F.count_if(F.col("filter_name") == k).alias(k) for k in ("click", "view", "error", "purchase"))),
    "g19_run_account": lambda s, d: U.run_account(outcomes(s, d)),
}

SAVED = "CAST(trunc(greatest(0, sum({i}) - sum({o})) / 4.0) AS BIGINT)"

ORACLES = {
    "g1_total_invocations": LOG + "SELECT count(*) AS invocations FROM log",
    "g2_by_filter": LOG + """SELECT filter_name, count(*) AS invocations, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(output_bytes) AS BIGINT) AS output_bytes,
        avg(duration_ms) AS avg_duration_ms, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS failures,
        CASE WHEN sum(input_bytes) > 0 THEN sum(output_bytes) / sum(input_bytes)::DOUBLE ELSE 0.0 END AS ratio,
        CAST(trunc(sum(input_bytes) / 4.0) AS BIGINT) AS input_tokens, CAST(trunc((sum(input_bytes) - sum(output_bytes)) / 4.0) AS BIGINT) AS saved_tokens
        FROM log GROUP BY filter_name""",
    "g3_by_mode": LOG + f"SELECT mode, count(*) AS invocations, {SAVED.format(i='input_bytes', o='output_bytes')} AS saved_tokens FROM log GROUP BY mode",
    "g4_by_project": LOG + f"""SELECT project, count(*) AS invocations, {SAVED.format(i='input_bytes', o='output_bytes')} AS saved_tokens,
        (SELECT l.filter_name FROM log l WHERE l.project = log.project GROUP BY l.filter_name ORDER BY count(*) DESC, l.filter_name LIMIT 1) AS top_filter
        FROM log GROUP BY project ORDER BY invocations DESC, project LIMIT 10""",
    "g5_last_failures": LOG + "SELECT ts, event_id, filter_name, coalesce(error_message, 'unknown') AS error_message FROM log WHERE failed ORDER BY ts DESC, event_id DESC LIMIT 20",
    "g6_combined_totals": LOG + "SELECT count(*) AS invocations, CAST(sum(input_bytes) AS BIGINT) AS input_bytes, CAST(sum(output_bytes) AS BIGINT) AS output_bytes, 100.0 * (sum(input_bytes) - sum(output_bytes))::DOUBLE / sum(input_bytes) AS savings_pct FROM both_logs",
    "g7_by_source": LOG + f"SELECT source, count(*) AS invocations, {SAVED.format(i='input_bytes', o='output_bytes')} AS saved_tokens FROM both_logs GROUP BY source",
    "g8_daily": LOG + f"SELECT CAST(ts AS DATE) AS day, CAST(sum(n) AS BIGINT) AS invocations, {SAVED.format(i='i', o='o')} AS saved_tokens FROM (SELECT CAST(ts AS DATE) AS ts, source, count(*) AS n, sum(input_bytes) AS i, sum(output_bytes) AS o FROM both_logs GROUP BY 1, 2) GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
    "g9_session": LOG + "SELECT ts, event_id, filter_name, input_bytes FROM log WHERE session_id = 7",
    "g10_compression_ratio": LOG + "SELECT event_id, CASE WHEN input_bytes > 0 THEN output_bytes / input_bytes::DOUBLE ELSE 0.0 END AS ratio FROM log",
    "g12_census_cube": "SELECT c_mktsegment AS kind, c_nationkey % 3 AS state, count(*) AS n, CAST(grouping(c_mktsegment) * 2 + grouping(c_nationkey % 3) AS INT) AS level FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey % 3)",
    "g13_board": "SELECT status, count(*) AS n, list(task_id ORDER BY task_id) AS tasks FROM (SELECT o_orderkey AS task_id, o_orderstatus AS status FROM orders ORDER BY o_orderkey LIMIT 500) WHERE status IN ('F', 'O') GROUP BY status",
    "g14_top_extensions": "SELECT source AS ext, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS loc FROM documents GROUP BY source ORDER BY files DESC, ext LIMIT 15",
    "g15_staleness": """WITH a AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS age FROM orders)
        SELECT count(*) FILTER (age <= 30) AS fresh, count(*) FILTER (age > 30 AND age <= 90) AS months, count(*) FILTER (age > 90 AND age <= 365) AS year, count(*) FILTER (age > 365) AS older, CAST(max(age) AS INT) AS oldest FROM a""",
    "g16_severity_rollup": "SELECT c_mktsegment AS kind, c_nationkey % 3 AS state, count(*) AS n, CAST(grouping(c_mktsegment) * 2 + grouping(c_nationkey % 3) AS INT) AS level FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey % 3)",
    "g17_suggested_bump": "SELECT *, CASE WHEN breaking > 0 THEN 'major' WHEN minor > 0 THEN 'minor' ELSE 'patch' END AS bump FROM (SELECT count(*) FILTER (p_size > 40) AS breaking, count(*) FILTER (p_size > 20 AND p_size <= 40) AS minor, count(*) FILTER (p_size <= 20) AS patch FROM part)",
    "g18_counters": "SELECT " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "view", "error", "purchase")) + " FROM events",
    "g19_run_account": """SELECT *, extracted + skipped + failed AS candidates FROM (SELECT count(*) FILTER (o = 'extracted') AS extracted, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'timeout') AS timeout
        FROM (SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 2 = 0 THEN 'extracted' ELSE 'skipped' END AS o FROM events))""",
}
