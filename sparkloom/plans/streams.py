"""Stream queries over the event files, run to their end; SQL states the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.shared import base_dir
from sparkloom.streaming import logs as L

LINE = "CASE WHEN event_id % 10 < 7 THEN 'tick' WHEN event_id % 10 = 7 THEN '' ELSE event_type END"


def drained(spark: SparkSession, result: DataFrame, mode: str = "complete") -> DataFrame:
    return L.drain(result, f"{base_dir(spark)}/sparkloom/{uuid.uuid4().hex}", mode)


def stalls(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.events(spark, sf).select(F.col("user_id").alias("doc"), "ts", F.col("event_id").alias("seq"), F.expr(LINE).alias("line"))
    return drained(spark, L.stalls(rows), "append")


QUERIES = {
    "stream_tumbling": lambda s, d: drained(s, L.tumbling(L.events(s, d))),
    "stream_sliding": lambda s, d: drained(s, L.sliding(L.events(s, d))),
    "stream_sessions": lambda s, d: drained(s, L.sessions(L.events(s, d))),
    "stream_stalls": stalls,
}

ORACLES = {
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sliding": "SELECT start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOURS AS start FROM events, range(4) r(k)) GROUP BY start",
    "stream_sessions": """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 2 HOURS, true) AS INT) AS new FROM events)) GROUP BY user_id, s""",
    "stream_stalls": f"""WITH lines AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id, {LINE} AS line FROM events), kept AS (SELECT * FROM lines WHERE line <> ''),
        runs AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY k) - row_number() OVER (PARTITION BY doc, line ORDER BY k) AS run FROM kept), counted AS (SELECT *, row_number() OVER (PARTITION BY doc, line, run ORDER BY k) AS n FROM runs)
        SELECT doc, arg_min(event_id, k) AS seq, arg_min(line, k) AS line FROM counted WHERE n >= 5 GROUP BY doc""",
}
