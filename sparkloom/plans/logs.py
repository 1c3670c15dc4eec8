"""Log queries: each user's events written as log lines, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import explode_lines, strip_ansi
from sparkloom.operators import logs as L

TEXT = """CASE event_id % 13 WHEN 0 THEN 'error: request failed' WHEN 1 THEN 'warning: slow response' WHEN 2 THEN 'Build succeeded' WHEN 3 THEN 'connection timed out'
 WHEN 4 THEN 'OOM while sorting' WHEN 5 THEN '[====> ] 60%' WHEN 6 THEN '2024-01-01T12:00:00' WHEN 7 THEN '2024-01-01T12:00:00 W deprecated call' WHEN 8 THEN '  '
 WHEN 9 THEN 'test result: ok. 5 passed; 0 failed;' WHEN 10 THEN 'panic at main' ELSE 'user ' || event_type END"""
LINES = f"WITH lines AS (SELECT user_id AS doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no, {TEXT} AS line FROM events)\n"
#: Fewer kinds of lines, so that runs of equal ones occur.
CALM = "WITH lines AS (SELECT user_id AS doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no, CASE WHEN event_id % 10 < 7 THEN 'tick' WHEN event_id % 10 = 7 THEN '' ELSE event_type END AS line FROM events)\n"


def lines(spark: SparkSession, sf: str, text: str = TEXT) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.selectExpr("user_id AS doc", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no", f"{text} AS line")


def calm(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf, "CASE WHEN event_id % 10 < 7 THEN 'tick' WHEN event_id % 10 = 7 THEN '' ELSE event_type END")


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return explode_lines(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("doc"), "text"), "doc")


DOCUMENT_LINES = """WITH cut AS (SELECT doc_id AS doc, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS xs FROM documents WHERE text <> ''),
lines AS (SELECT doc, generate_subscripts(xs, 1) AS line_no, rtrim(unnest(xs), chr(13)) AS line FROM cut)
"""
NOISE = "(contains(line, '[==') OR contains(line, '[##') OR (contains(line, '...') AND ends_with(line, '%')) OR regexp_full_match(line, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\\s*') OR trim(line, e' \\t\\n\\r') = '')"
ERROR = "(regexp_matches(lower(line), 'error|failed|panic|fatal|exception') OR starts_with(lower(line), 'e '))"
WARNING = "(contains(lower(line), 'warn') OR starts_with(lower(line), 'w '))"
STAMP = "regexp_replace(x, '^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[.,]?[0-9]*\\s*|\\[[0-9]{2}:[0-9]{2}:[0-9]{2}\\]\\s*)', '')"
KIND = r"""CASE WHEN regexp_matches(l, 'out of memory|oom|cannot allocate|memory allocation failed|no space left on device|disk full|disk quota exceeded') THEN 'resource_warning'
 WHEN regexp_matches(l, 'timed out|timeout|deadline exceeded') THEN 'timeout'
 WHEN regexp_matches(l, 'too many open files|ulimit') OR (contains(l, 'killed') AND contains(l, 'signal 9')) THEN 'resource_warning'
 WHEN starts_with(l, 'test result: fail') OR regexp_matches(l, 'build failed|compilation failed|exit code 1|exit status 1|fatal error|panic|segfault') OR (contains(l, 'abort') AND NOT contains(l, 'aborted')) THEN 'failure'
 WHEN regexp_matches(l, 'build succeeded|build successful|compilation successful|tests passed|successfully deployed|deploy complete') OR (contains(l, 'finished') AND contains(l, 'target')) OR starts_with(l, 'test result: ok') OR (contains(l, 'passed') AND contains(l, 'failed')) THEN 'completion'
 WHEN starts_with(l, 'error') OR regexp_matches(l, 'error\[|error:|traceback') OR (contains(l, 'exception') AND NOT contains(l, 'no exception')) THEN 'error'
 WHEN starts_with(l, 'warning') OR regexp_matches(l, 'warning:|deprecated') THEN 'warning' END"""
STALLS = """, kept AS (SELECT doc, line_no, trim(line, e' \\t\\n\\r') AS line FROM lines WHERE trim(line, e' \\t\\n\\r') <> ''),
marked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) - row_number() OVER (PARTITION BY doc, line ORDER BY line_no) AS run FROM kept),
counted AS (SELECT *, row_number() OVER (PARTITION BY doc, line, run ORDER BY line_no) AS n FROM marked),
stalls AS (SELECT doc, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM counted WHERE n >= 5 GROUP BY doc)
"""
COUNTS = ", ".join(f"coalesce(max({k}), 0) AS {k}" for k in ("failure", "resource_warning", "timeout", "completion", "error", "warning"))

QUERIES = {
    "a1_strip_ansi": lambda s, d: lines(s, d).select("doc", "line_no", strip_ansi(F.concat(F.lit("\x1b[31m"), "line", F.lit("\x1b[0m\x1b[2K"))).alias("line")),
    "a2_noise": lambda s, d: lines(s, d).where(L.is_noise(F.col("line"))),
    "a3_a4_levels": lambda s, d: lines(s, d).groupBy(L.is_error(F.col("line")).alias("is_error"), L.is_warning(F.col("line")).alias("is_warning")).agg(F.count("*").alias("n")),
    "a5_distill": lambda s, d: L.distill(lines(s, d)),
    "a6_classify": lambda s, d: lines(s, d).groupBy("doc", L.classify(F.col("line")).alias("kind")).agg(F.count("*").alias("n")),
    "a7_stalls": lambda s, d: L.stalls(calm(s, d)),
    "a8_repeated_lines": lambda s, d: L.repeated(lines(s, d)),
    "a8_repeated_document_lines": lambda s, d: L.repeated(document_lines(s, d), 2).drop("text"),
    "a9_monitor": lambda s, d: L.monitor(lines(s, d)),
    "a9_monitor_calm": lambda s, d: L.monitor(calm(s, d)),
    "s1_document_lines": lambda s, d: document_lines(s, d).groupBy("doc").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"), F.count_if(F.col("line") == "").alias("empty")),
}


def monitor_sql(source: str) -> str:
    return source + STALLS + f""", events AS (SELECT doc, line_no, kind, 0 AS seq FROM (SELECT doc, line_no, {KIND} AS kind FROM (SELECT *, lower(line) AS l FROM lines)) WHERE kind IS NOT NULL
 UNION ALL SELECT doc, line_no, 'stall', 1 FROM stalls),
last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY doc ORDER BY line_no DESC, seq DESC) <= 50),
counts AS (SELECT doc, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("failure", "resource_warning", "timeout", "completion", "error", "warning"))} FROM last GROUP BY doc),
report AS (SELECT l.doc, count(*) AS n_lines, {COUNTS}, bool_or(s.doc IS NOT NULL) AS stalled FROM lines l LEFT JOIN counts c ON c.doc = l.doc LEFT JOIN stalls s ON s.doc = l.doc GROUP BY l.doc)
SELECT *, CASE WHEN failure > 0 THEN 'failed' WHEN resource_warning > 0 OR timeout > 0 THEN 'resource_warning' WHEN stalled THEN 'stalled' WHEN completion > 0 THEN 'completed' WHEN error > 0 THEN 'errors' ELSE 'healthy' END AS status FROM report"""


REPEATED = "SELECT doc, {text} count(*) AS n, min(line_no) AS first_line, max(line_no) AS last_line FROM (SELECT doc, line_no, trim(line, e' \\t\\n\\r') AS line FROM lines) WHERE line <> '' GROUP BY doc, line HAVING count(*) >= {k}"

ORACLES = {
    "a1_strip_ansi": LINES + "SELECT * FROM lines",
    "a2_noise": LINES + f"SELECT * FROM lines WHERE {NOISE}",
    "a3_a4_levels": LINES + f"SELECT {ERROR} AS is_error, {WARNING} AS is_warning, count(*) AS n FROM lines GROUP BY ALL",
    "a5_distill": LINES + f""", near AS (SELECT *, list(line) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS a, list(line) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM lines)
        SELECT doc, line_no, CASE WHEN {ERROR} THEN 'error' ELSE 'warning' END AS kind, line AS text,
        list_filter(list_transform(list_concat(coalesce(a, []), coalesce(b, [])), lambda x: {STAMP}), lambda y: trim(y, e' \\t\\n\\r') <> '') AS context FROM near WHERE NOT {NOISE} AND ({ERROR} OR {WARNING})""",
    "a6_classify": LINES + f"SELECT doc, {KIND} AS kind, count(*) AS n FROM (SELECT *, lower(line) AS l FROM lines) GROUP BY ALL",
    "a7_stalls": CALM + STALLS + "SELECT * FROM stalls",
    "a8_repeated_lines": LINES + REPEATED.format(text="line AS text,", k=3),
    "a8_repeated_document_lines": DOCUMENT_LINES + REPEATED.format(text="", k=2),
    "a9_monitor": monitor_sql(LINES),
    "a9_monitor_calm": monitor_sql(CALM),
    "s1_document_lines": DOCUMENT_LINES + "SELECT doc, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) FILTER (line = '') AS empty FROM lines GROUP BY doc",
}
