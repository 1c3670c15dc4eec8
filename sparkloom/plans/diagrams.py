"""Diagram, tool-output and paper queries on texts made from parts, with SQL for what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import diagrams as D
from sparkloom.operators.web import NAMESPACE
from sparkloom.plans.sources import texts

FLOW = """CASE p_partkey % 4 WHEN 0 THEN 'graph TD' WHEN 1 THEN '%% note' || chr(10) || 'flowchart LR' WHEN 2 THEN 'sequenceDiagram' || chr(10) || 'participant A' || chr(10) || 'A->>B: hi' ELSE 'diagram' END || chr(10) || CASE p_size % 6 WHEN 0 THEN 'A[x] --> B(y)' WHEN 1 THEN 'A->B' WHEN 2 THEN 'A ----> B' WHEN 3 THEN '1x --> B' WHEN 4 THEN 'A[(x] --> B' ELSE 'A -->' END"""
TOOL = "repeat('error: e' || chr(10) || 'fine' || chr(10), p_size) || 'WARNING w'"


def papers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_name AS title", "CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi", "CAST(NULL AS STRING) AS arxiv_id", "array(named_struct('name', 'N' || p_size, 'affiliation', CASE WHEN p_size % 2 = 0 THEN p_brand END)) AS authors",
        "array(p_type, p_brand) AS keywords", "array('Intro', 'End') AS sections", "array(named_struct('title', p_name, 'doi', '10.1/' || (p_partkey + 2))) AS references")


QUERIES = {
    "a29_diagram_issues": lambda s, d: D.issues(texts(s, d, FLOW)),
    "a29_diagram_types": lambda s, d: texts(s, d, FLOW).groupBy(D.kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n")),
    "a30_tool_lines": lambda s, d: D.tool_lines(texts(s, d, TOOL)).groupBy("doc").agg(F.count("*").alias("n"), F.max("line_no").alias("last_line")),
    "k6_paper_graph": lambda s, d: D.paper_graph(papers(s, d), NAMESPACE).groupBy("edge_type", "weight").agg(F.count("*").alias("n")),
}

HEAD = "CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END"
ORACLES = {
    "a29_diagram_issues": f"""WITH p AS (SELECT p_partkey AS doc, p_partkey % 4 AS t, p_size % 6 AS k, CAST({HEAD} + 1 AS INT) AS n FROM part)
        SELECT doc, 0 AS line_no, 'UNKNOWN_TYPE' AS code FROM p WHERE t = 3 UNION ALL SELECT doc, 0, 'UNBALANCED_BRACKET' FROM p WHERE k = 4 UNION ALL SELECT doc, n, 'BAD_EDGE_SYNTAX' FROM p WHERE t < 2 AND k IN (1, 2)
        UNION ALL SELECT doc, n, 'BAD_NODE_ID' FROM p WHERE t < 2 AND k = 3 UNION ALL SELECT doc, n, 'UNTERMINATED_EDGE' FROM p WHERE k = 5 UNION ALL SELECT doc, 3, 'UNKNOWN_PARTICIPANT' FROM p WHERE t = 2 UNION ALL SELECT doc, n, 'UNKNOWN_PARTICIPANT' FROM p WHERE t = 2 AND k = 1""",
    "a29_diagram_types": "SELECT CASE p_partkey % 4 WHEN 0 THEN 'graph' WHEN 1 THEN 'flowchart' WHEN 2 THEN 'sequenceDiagram' ELSE 'diagram' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "a30_tool_lines": "SELECT p_partkey AS doc, CAST(least(20, p_size + 1) AS BIGINT) AS n, CAST(CASE WHEN p_size >= 20 THEN 39 ELSE 2 * p_size + 1 END AS INT) AS last_line FROM part",
    "k6_paper_graph": """WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey ELSE p_name END AS id, * FROM part),
        e AS (SELECT DISTINCT 'wrote' AS edge_type, 1.0::DOUBLE AS weight, 'N' || p_size AS a, id AS b FROM p UNION SELECT 'affiliated_with', 1.0, 'N' || p_size, p_brand FROM p WHERE p_size % 2 = 0 UNION SELECT 'discusses', 0.8, id, lower(p_type) FROM p UNION SELECT 'discusses', 0.8, id, lower(p_brand) FROM p
        UNION SELECT 'contains', 1.0, id, 'Intro' FROM p UNION SELECT 'contains', 1.0, id, 'End' FROM p UNION SELECT 'references', 0.5, id, '10.1/' || (p_partkey + 2) FROM p) SELECT edge_type, weight, count(*) AS n FROM e GROUP BY ALL""",
}
