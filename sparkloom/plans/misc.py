"""Outline, settings, gate, scrub and state queries on texts made from parts and orders, with SQL for what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import misc as M
from sparkloom.operators import outline as O
from sparkloom.plans.sources import part, texts

RUST = "CASE p_partkey % 8 WHEN 0 THEN 'use std::x' || p_size || ';' WHEN 1 THEN 'pub const fn f' || p_size || '()' WHEN 2 THEN '  pub async fn g' || p_partkey || '(a: u8) {' WHEN 3 THEN 'fn h' || p_partkey || '()' WHEN 4 THEN 'pub(crate) fn i()' WHEN 5 THEN 'pub struct S' || p_size WHEN 6 THEN 'mod m' || p_size || ';' ELSE 'let x = 1;' END"
PYTHON = "CASE p_partkey % 7 WHEN 0 THEN 'class C' || p_size || ':' WHEN 1 THEN '  def _p' || p_size || '(self):' WHEN 2 THEN 'def f' || p_size || '(x):' WHEN 3 THEN 'from a import b' WHEN 4 THEN 'LIMIT_' || p_size || ' = 3' WHEN 5 THEN 'async def g():' ELSE 'x = 1' END"
SETTING = "CASE p_partkey % 10 WHEN 0 THEN 'm = \"gpt-x-' || (20240000 + p_size) || '\"' WHEN 1 THEN 'mail = \"a' || p_size || '@corp.io\"' WHEN 2 THEN 'mail = \"b@example.com\"' WHEN 3 THEN '# x = \"c@corp.io\"' WHEN 4 THEN 'k = \"gl' || 'pat-' || repeat('x', 12) || '\"' WHEN 5 THEN 'let request_timeout = ' || (p_size % 3) WHEN 6 THEN 'RETRY_FLAG = ' || p_size WHEN 7 THEN 'SOME_NUMBER: ' || p_size WHEN 8 THEN 'get(\"https://' || CASE WHEN p_size % 2 = 0 THEN 'docs.rs/a' ELSE 'corp.io/x?y=' || p_size END || '\")' ELSE 'EXIT_CODE = 7' END"
SEARCH = "CASE p_partkey % 4 WHEN 0 THEN '<b>Some</b>  &amp; text' || chr(10) || p_size WHEN 1 THEN 'the system prompt' WHEN 2 THEN repeat('long ', 60) ELSE '<script>x</script>' || p_name END"
TERMINAL = "'a' || chr(9) || chr(27) || '[31m' || p_size || chr(10) || chr(7)"
DURATION = "CASE p_partkey % 5 WHEN 0 THEN p_size || 'd' WHEN 1 THEN p_size || 'h' WHEN 2 THEN p_size || 'm' WHEN 3 THEN p_size || 's' ELSE p_size || 'x' END"


def t(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").selectExpr(*columns)


FUNCTIONS = ("p_brand AS file", "p_name || p_partkey AS name", "p_size AS cc", "p_partkey % 2 = 0 AS documented")
ITEMS = ("o_orderkey AS id", "CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'in_progress' END AS status", "'w' || o_custkey AS claimed_by", "CAST(NULL AS TIMESTAMP) AS completed_at")
CHANGES = ("l_orderkey AS id", "CASE WHEN l_linenumber % 2 = 0 THEN 'completed' ELSE 'pending' END AS status", "l_shipdate + make_interval(0, 0, 0, 0, 0, 0, l_linenumber) AS at")

QUERIES = {
    "c1_outline_rust": lambda s, d: O.outline(part(s, d, RUST), "rust"),
    "c1_outline_python": lambda s, d: O.outline(part(s, d, PYTHON), "python"),
    "c3_outline_filter": lambda s, d: O.matching(O.outline(part(s, d, RUST), "rust"), "^[gh]1"),
    "c6_lookup": lambda s, d: O.lookup(O.outline(part(s, d, RUST), "rust"), "S1").groupBy("name", "rank").agg(F.count("*").alias("n")),
    "b10_settings": lambda s, d: M.settings(part(s, d, SETTING)),
    "b18_coverage_gate": lambda s, d: M.coverage_gate(t(s, d, "part", "p_brand AS file", "p_size").groupBy("file").agg((F.count("*") * 50).alias("found"), (F.sum("p_size") + F.count("*") * 19).alias("hit")), t(s, d, "part", *FUNCTIONS)),
    "u6_scrub": lambda s, d: texts(s, d, SEARCH).select("doc", M.scrub(F.col("text")).alias("text")),
    "u10_terminal": lambda s, d: texts(s, d, TERMINAL).select("doc", M.for_terminal(F.col("text")).alias("text")),
    "u10_durations": lambda s, d: texts(s, d, DURATION).select("doc", M.seconds(F.col("text")).alias("seconds")),
    "u11_generated": lambda s, d: texts(s, d, "CASE WHEN p_size % 2 = 0 THEN chr(10) || '// @generated by x' ELSE 'code' END").select("doc", M.generated(F.concat(F.lit("a/b."), F.when(F.col("doc") % 3 == 0, "generated.").otherwise(""), F.lit("rs")), F.col("text")).alias("generated")),
    "d25_transitions": lambda s, d: M.transition(t(s, d, "orders", *ITEMS), t(s, d, "lineitem", *CHANGES)).groupBy("status", F.col("claimed_by").isNull().alias("free"), F.col("completed_at").isNull().alias("open")).agg(F.count("*").alias("n")),
    "w5_newest": lambda s, d: M.newest(t(s, d, "events", "event_type AS command", "ts", "event_id"), 20, "event_id").select("command", "event_id"),
    "w8_upsert": lambda s, d: M.upsert(t(s, d, "part", "p_partkey AS id", "p_name AS name"), t(s, d, "part", "p_partkey + 5 AS id", "p_brand AS name").where("id % 3 = 0"), "id"),
    "k10_reconcile": lambda s, d: M.reconcile(t(s, d, "part", "p_partkey AS chunk", "p_size AS sent", "p_size - p_partkey % 3 AS inserted", "p_partkey % 2 AS updated", "1 AS skipped", "0 AS failed")).select("chunk"),
}

L = "CAST(floor(p_partkey / 20) AS BIGINT) AS doc, p_partkey AS line_no"
RUST_ROWS = f"""SELECT {L}, CASE p_partkey % 8 WHEN 0 THEN 'import' WHEN 1 THEN 'constant' WHEN 2 THEN 'function' WHEN 3 THEN 'function' WHEN 5 THEN 'type' ELSE 'module' END AS kind, CASE p_partkey % 8 WHEN 2 THEN 'public' WHEN 3 THEN 'private' ELSE '' END AS visibility,
 CASE p_partkey % 8 WHEN 0 THEN 'std::x' || p_size WHEN 1 THEN 'fn' WHEN 2 THEN 'g' || p_partkey WHEN 3 THEN 'h' || p_partkey WHEN 5 THEN 'S' || p_size ELSE 'm' || p_size END AS name FROM part WHERE p_partkey % 8 NOT IN (4, 7)"""

ORACLES = {
    "c1_outline_rust": RUST_ROWS,
    "c1_outline_python": f"SELECT {L}, CASE p_partkey % 7 WHEN 0 THEN 'module' WHEN 3 THEN 'import' WHEN 4 THEN 'constant' ELSE 'function' END AS kind, CASE p_partkey % 7 WHEN 1 THEN 'private' WHEN 2 THEN 'public' ELSE '' END AS visibility, CASE p_partkey % 7 WHEN 0 THEN 'C' || p_size WHEN 1 THEN '_p' || p_size WHEN 2 THEN 'f' || p_size WHEN 3 THEN 'from a import b' ELSE 'LIMIT_' || p_size END AS name FROM part WHERE p_partkey % 7 < 5",
    "c3_outline_filter": f"SELECT * FROM ({RUST_ROWS}) WHERE regexp_matches(name, '^[gh]1')",
    "c6_lookup": f"SELECT name, CAST(name <> 'S1' AS INT) AS rank, count(*) AS n FROM ({RUST_ROWS}) WHERE contains(name, 'S1') GROUP BY ALL",
    "b10_settings": f"""WITH l AS (SELECT {L}, trim({SETTING}) AS t FROM part), c AS (SELECT * FROM l WHERE NOT regexp_matches(t, '^(//|#|\\*|/\\*|--)')), n AS (SELECT *, regexp_extract(t, '(?i)(?:(?:let|const|var|val|def|@)\\s+|^@?)([a-z_]\\w*)\\s*[=:\\s]\\s*(-?[0-9]+)', 1) AS name, regexp_extract(t, '(?i)(?:(?:let|const|var|val|def|@)\\s+|^@?)([a-z_]\\w*)\\s*[=:\\s]\\s*(-?[0-9]+)', 2) AS v FROM c)
        SELECT doc, line_no, 'model_id' AS smell, regexp_extract(t, '"gpt[-\\w]*-[0-9]{{8}}"') AS match FROM c WHERE regexp_matches(t, '"gpt[-\\w]*-[0-9]{{8}}"') UNION ALL SELECT doc, line_no, 'email', regexp_extract(t, '"[a-z0-9]+@[a-z.]+"') FROM c WHERE regexp_matches(t, '"[a-z0-9]+@[a-z.]+"') AND NOT contains(t, 'example.com')
        UNION ALL SELECT doc, line_no, 'key', regexp_extract(t, '"glpat-[a-z]+"') FROM c WHERE regexp_matches(t, '"glpat-[a-z]+"') UNION ALL SELECT doc, line_no, 'tunable', name || ' = ' || v FROM n WHERE regexp_matches(lower(name), 'timeout|retry') AND v NOT IN ('0', '1')
        UNION ALL SELECT doc, line_no, 'constant', regexp_extract(t, '^([A-Z][A-Z0-9_]+)\\s*[=:]\\s*([0-9]+)', 1) || ' = ' || regexp_extract(t, '[0-9]+$') FROM n WHERE regexp_matches(t, '^[A-Z][A-Z0-9_]{{2,}}\\s*[=:]\\s*[0-9]+') AND NOT regexp_matches(lower(name), 'timeout|retry|exit|version') AND v NOT IN ('0', '1')
        UNION ALL SELECT doc, line_no, 'url', regexp_extract(t, '"(https?://[^\\s"]+)"', 1) FROM c WHERE regexp_matches(t, '"https?://') AND NOT contains(t, 'docs.rs')""",
    "b18_coverage_gate": """WITH f AS (SELECT p_brand AS file, (sum(p_size) + count(*) * 19) / (count(*) * 50)::DOUBLE * 100 AS coverage FROM part GROUP BY 1), j AS (SELECT p_brand AS file, p_name || p_partkey AS name, p_size AS cc, p_partkey % 2 = 0 AS doc, coverage FROM part JOIN f ON f.file = p_brand)
        SELECT file, name, 'refactor' AS rule, 95.0::DOUBLE AS required FROM j WHERE cc >= 25 UNION ALL SELECT file, name, 'coverage', 90.0 FROM j WHERE cc BETWEEN 15 AND 24 AND coverage < 90 UNION ALL SELECT file, name, 'documentation', 90.0 FROM j WHERE cc BETWEEN 15 AND 24 AND NOT doc UNION ALL SELECT file, NULL, 'baseline', 80.0 FROM f WHERE coverage < 80""",
    "u6_scrub": "SELECT p_partkey AS doc, CASE p_partkey % 4 WHEN 0 THEN 'Some & text ' || p_size WHEN 2 THEN left(repeat('long ', 60), 240) || '…' WHEN 3 THEN p_name END AS text FROM part",
    "u10_terminal": "SELECT p_partkey AS doc, 'a\\t' || p_size || '\\n?' AS text FROM part",
    "u10_durations": "SELECT p_partkey AS doc, CAST(p_size * CASE p_partkey % 5 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 WHEN 3 THEN 1 END AS BIGINT) AS seconds FROM part",
    "u11_generated": "SELECT p_partkey AS doc, p_partkey % 3 = 0 OR p_size % 2 = 0 AS generated FROM part",
    "d25_transitions": """WITH c AS (SELECT l_orderkey AS id, arg_max(CASE WHEN l_linenumber % 2 = 0 THEN 'completed' ELSE 'pending' END, l_shipdate + l_linenumber * INTERVAL 1 SECOND) AS s FROM lineitem GROUP BY 1)
        SELECT coalesce(s, CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'in_progress' END) AS status, s IS NOT NULL AS free, s IS NULL OR s <> 'completed' AS open, count(*) AS n FROM orders LEFT JOIN c ON id = o_orderkey GROUP BY ALL""",
    "w5_newest": "SELECT command, event_id FROM (SELECT event_type AS command, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20",
    "w8_upsert": "SELECT p_partkey AS id, p_name AS name FROM part WHERE NOT (p_partkey % 3 = 0 AND p_partkey - 5 IN (SELECT p_partkey FROM part)) UNION ALL SELECT p_partkey + 5, p_brand FROM part WHERE (p_partkey + 5) % 3 = 0",
    "k10_reconcile": "SELECT p_partkey AS chunk FROM part WHERE p_size <> p_size - p_partkey % 3 + p_partkey % 2 + 1",
}
