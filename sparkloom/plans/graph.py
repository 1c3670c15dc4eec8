"""Graph queries on a module graph made from all parts: a tree of dependencies with shortcuts, repeated edges and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import graph as G

LABEL = "'m' || ({0} % 3) || '.p' || ({0} % 7) || '.n' || {0}"
EDGES = f"""SELECT {LABEL.format('k')} AS src, {LABEL.format('d')} AS dst, CAST(1 + k % 5 AS BIGINT) AS weight, seq, CASE WHEN k % 9 = 0 THEN 'ffi' WHEN seq = 1 THEN 'import' ELSE 'call' END AS kind FROM (
 SELECT p_partkey AS k, CAST(floor(p_partkey / 2) AS BIGINT) AS d, 1 AS seq FROM part WHERE p_partkey >= 2
 UNION ALL SELECT p_partkey, p_partkey - 5, 2 FROM part WHERE p_partkey >= 6 AND p_partkey % 11 = 0
 UNION ALL SELECT p_partkey, p_partkey, 3 FROM part
 UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 2) AS BIGINT), 4 FROM part WHERE p_partkey >= 2 AND p_size % 2 = 0
 UNION ALL SELECT CAST(floor(p_partkey / 4) AS BIGINT), p_partkey, 5 FROM part WHERE p_partkey % 40 = 0 AND p_size > 10)"""
DAG = EDGES.replace("AND p_size > 10", "AND p_size < 0")
CLUSTER = "SELECT DISTINCT node, split_part(node, '.', 2) AS cluster FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)"


def view(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf}/part.parquet"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, EDGES)


def dag(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, DAG)


def assigned(e: DataFrame, name: str = "cluster") -> DataFrame:
    return G.nodes(e).select("node", F.split_part("node", F.lit("."), F.lit(2)).alias(name))


def declarations(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.regexp_extract("node", r"n([0-9]+)\z", 1).cast("int")
    decl = G.nodes(e).select(F.concat(F.lit("crate::"), F.translate("node", ".", "_"), F.lit("::go"), k % 3).alias("name"), F.when(k % 2 == 0, "private").otherwise("public").alias("visibility"), F.col("node").alias("file"), (k % 50 == 7).alias("is_entry"), (k % 13 == 0).alias("is_test"))
    refs = G.adjacency(e).select(F.col("src").alias("file"), F.concat(F.translate("dst", ".", "_"), F.lit("::go"), F.regexp_extract("dst", r"n([0-9]+)\z", 1).cast("int") % 3).alias("symbol"))
    return decl, refs


def items(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = dag(spark, sf)
    k = F.regexp_extract("node", r"n([0-9]+)\z", 1).cast("int")
    done = F.when(k % 3 == 0, "completed").when(k % 3 == 1, "pending").otherwise("in_progress")
    return G.nodes(e).select(F.col("node").alias("id"), done.alias("status")), G.adjacency(e).select(F.col("src").alias("id"), F.col("dst").alias("needs"))


def half(e: DataFrame) -> DataFrame:
    return assigned(e, "module").where(F.regexp_extract("node", r"n([0-9]+)\z", 1).cast("int") % 5 > 0)


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).select(F.col("src").alias("child"), F.col("dst").alias("parent"))


def faulty(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items by line, some of them twice, and dependencies on the next one, on nothing and on themselves."""
    k = F.col("p_partkey")
    part = spark.read.parquet(f"{sf}/part.parquet")
    ids = part.select(F.concat(F.lit("i"), k).alias("id")).unionByName(part.where(k % 9 == 0).select(F.concat(F.lit("i"), k).alias("id"))).unionByName(part.where(k == 1).select(F.lit(" ").alias("id")))
    needs = part.select(F.concat(F.lit("i"), k).alias("id"), F.concat(F.lit("i"), F.when(k % 7 == 0, k).otherwise(k + 1)).alias("needs"))
    return ids, needs.unionByName(needs.where(F.substring("id", 2, 9).cast("int") % 5 == 0))


QUERIES = {
    "d1_adjacency": lambda s, d: G.adjacency(edges(s, d)),
    "d2_weights": lambda s, d: G.weighted(edges(s, d)),
    "d3_prefix": lambda s, d: G.adjacency(G.with_prefix(edges(s, d), "m1.")),
    "d4_aggregate": lambda s, d: G.aggregate(edges(s, d), 2),
    "d5_transpose": lambda s, d: G.transpose(G.weighted(edges(s, d))),
    "d6_merge": lambda s, d: G.merge(edges(s, d)),
    "d7_cycles": lambda s, d: G.cycles(edges(s, d)),
    "d8_tears": lambda s, d: G.tears(edges(s, d)),
    "d9_propagation_cost": lambda s, d: G.propagation_cost(edges(s, d)),
    "d9_closure": lambda s, d: G.closure(edges(s, d)),
    "d10_degrees": lambda s, d: G.degrees(edges(s, d)),
    "d11_ratings": lambda s, d: G.ratings(edges(s, d), assigned(edges(s, d))),
    "d12_layers": lambda s, d: G.partition(edges(s, d)),
    "d13_bands": lambda s, d: G.bands(edges(s, d)),
    "d14_cluster_cost": lambda s, d: G.cluster_cost(edges(s, d), assigned(edges(s, d))),
    "d15_clusters": lambda s, d: G.clusters(edges(s, d), assigned(edges(s, d))),
    "d16_dead_code": lambda s, d: G.dead_code(*declarations(edges(s, d))),
    "d17_directed": lambda s, d: G.directed(edges(s, d), half(edges(s, d))),
    "d17_affinity": lambda s, d: G.affinity(edges(s, d), half(edges(s, d))),
    "d14_search": lambda s, d: G.search_clusters(edges(s, d)),
    "d18_violations": lambda s, d: G.violations(edges(s, d), half(edges(s, d))),
    "d19_migration": lambda s, d: G.migration_plan(edges(s, d), half(edges(s, d))),
    "d20_suggestions": lambda s, d: G.suggestions(edges(s, d), assigned(edges(s, d)), half(edges(s, d))),
    "d23_batches": lambda s, d: G.batches(*items(s, d)),
    "d23_errors": lambda s, d: G.dependency_errors(*faulty(s, d)),
    "d24_ready": lambda s, d: G.ready(*items(s, d)).select("id"),
    "d26_orphans": lambda s, d: G.tag_orphans(tags(s, d), G.nodes(edges(s, d).where("src <> dst").select("dst", F.col("dst").alias("src"))).select(F.col("node").alias("tag"))),
    "d26_cycle_chains": lambda s, d: G.tag_cycles(tags(s, d)),
    "d26_all_tags": lambda s, d: G.all_tags(s.read.parquet(f"{d}/nation.parquet").select(F.lower("n_name").alias("tag")), s.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("category"), F.array("p_brand", F.lit("")).alias("tags"))),
    "d27_quorum": lambda s, d: G.quorum(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("board"), (F.col("s_acctbal") > 4000).alias("up"))),
}

E = f"WITH RECURSIVE e AS ({EDGES}), a AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), "
D = E.replace(EDGES, DAG)
W = "w AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM e WHERE src <> dst GROUP BY ALL), "
TC = "tc AS (SELECT src, dst FROM a UNION SELECT tc.src, a.dst FROM tc JOIN a ON tc.dst = a.src), "
SCC = TC + "scc AS (SELECT x.src AS node, min(x.dst) AS component FROM tc x JOIN tc y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src), "
DEG = "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, sum(o) / sum(i + o)::DOUBLE AS instability FROM (SELECT src AS node, 0 AS i, 1 AS o FROM a UNION ALL SELECT dst, 1, 0 FROM a) GROUP BY node), "
TEARS = "tears AS (SELECT component, src, dst, weight FROM (SELECT s.component, w.*, row_number() OVER (PARTITION BY s.component ORDER BY weight, w.src, w.dst) AS r FROM w JOIN scc s ON s.node = w.src JOIN scc t ON t.node = w.dst AND t.component = s.component) WHERE r = 1), "
CL = f"cl AS ({CLUSTER}), "
COMP = SCC + "comp AS (SELECT node, coalesce(component, node) AS component FROM (SELECT src AS node FROM a UNION SELECT dst FROM a) LEFT JOIN scc USING (node)), ca AS (SELECT DISTINCT x.component AS src, y.component AS dst FROM a JOIN comp x ON x.node = src JOIN comp y ON y.node = dst WHERE x.component <> y.component), "
LEVEL = COMP + "lv AS (SELECT component, 0 AS level FROM comp WHERE component NOT IN (SELECT src FROM ca) UNION SELECT ca.src, lv.level + 1 FROM lv JOIN ca ON ca.dst = lv.component), best AS (SELECT component, max(level) AS level FROM lv GROUP BY component), "
AGAINST = "agn AS (SELECT a.src, a.dst FROM a JOIN scc x ON x.node = a.src JOIN scc y ON y.node = a.dst AND y.component = x.component WHERE a.src < a.dst), "
HALF = "md AS (SELECT node, cluster AS module FROM cl WHERE CAST(regexp_extract(node, 'n([0-9]+)$', 1) AS INT) % 5 > 0), "
BOTH = "b AS (SELECT src AS node, dst AS other FROM a UNION SELECT dst, src FROM a), "
VIOLATIONS = BOTH + """cnt AS (SELECT p.node, p.module, q.module AS target, count(*) AS n FROM b JOIN md p USING (node) JOIN md q ON q.node = b.other GROUP BY ALL),
 wide AS (SELECT component, count(DISTINCT module) AS k FROM scc JOIN md USING (node) GROUP BY component HAVING count(DISTINCT module) > 1),
 vio AS (SELECT 'wrong_module' AS kind, c.node AS element, c.module, c.target, c.n AS details FROM cnt c JOIN cnt o ON o.node = c.node AND o.target = o.module WHERE c.target <> c.module AND c.n > o.n
 UNION ALL SELECT 'god_element', q.node, q.module, q.module, count(DISTINCT p.module) FROM a JOIN md p ON p.node = src JOIN md q ON q.node = dst GROUP BY q.node, q.module HAVING count(DISTINCT p.module) >= 3
 UNION ALL SELECT 'cross_module_cycle', md.node, md.module, md.module, k FROM scc JOIN md USING (node) JOIN wide USING (component)), """
PLAN = """aff AS (SELECT b.node, md.module, count(*) AS n, row_number() OVER (PARTITION BY b.node ORDER BY count(*) DESC, md.module) AS r FROM b JOIN md ON md.node = b.other WHERE b.node NOT IN (SELECT node FROM md) GROUP BY b.node, md.module),
 whole AS (SELECT node, count(*) AS whole FROM (SELECT src AS node FROM a UNION ALL SELECT dst FROM a) GROUP BY node), steps AS (
 SELECT 1 AS phase, 'extract_interface' AS action, element, module AS from_module, target AS to_module, 'medium' AS risk FROM vio WHERE kind = 'cross_module_cycle'
 UNION ALL SELECT 2, 'move_element', element, module, target, 'low' FROM vio WHERE kind = 'wrong_module'
 UNION ALL SELECT 3, 'move_element', node, NULL, module, 'low' FROM aff2 JOIN whole USING (node) WHERE n / whole > 0.6),
 mig AS (SELECT * FROM steps UNION ALL SELECT 4, 'split_element', element, module, target, 'high' FROM vio WHERE kind = 'god_element' AND element NOT IN (SELECT element FROM steps)), """.replace("steps AS (", "aff2 AS (SELECT node, module, n FROM (SELECT node, module, n, row_number() OVER (PARTITION BY node ORDER BY n DESC, module) AS q FROM (SELECT c.node, md.module, count(*) AS n FROM (SELECT src AS node, dst AS other FROM a UNION ALL SELECT dst, src FROM a) c JOIN md ON md.node = c.other WHERE c.node NOT IN (SELECT node FROM md) GROUP BY ALL)) WHERE q = 1), steps AS (")
NUM = "CAST(regexp_extract({0}, 'n([0-9]+)$', 1) AS INT)"
END = "z AS (SELECT 1) "

ORACLES = {
    "d1_adjacency": E + END + "SELECT * FROM a",
    "d2_weights": E + W + END + "SELECT * FROM w",
    "d3_prefix": E + END + "SELECT * FROM a WHERE starts_with(src, 'm1.') AND starts_with(dst, 'm1.')",
    "d4_aggregate": E + END + "SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT split_part(src, '.', 1) || '.' || split_part(src, '.', 2) AS src, split_part(dst, '.', 1) || '.' || split_part(dst, '.', 2) AS dst, weight FROM e) WHERE src <> dst GROUP BY ALL",
    "d5_transpose": E + W + END + "SELECT dst AS src, src AS dst, weight FROM w",
    "d6_merge": E + END + "SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight, coalesce(arg_max(CASE WHEN kind = 'ffi' THEN kind END, CASE WHEN kind = 'ffi' THEN seq END), arg_min(kind, seq)) AS kind FROM e GROUP BY ALL",
    "d7_cycles": E + SCC + END + "SELECT component, count(*) AS size, list(node ORDER BY node) AS members, (SELECT count(*) FROM a JOIN scc s ON s.node = a.src JOIN scc t ON t.node = a.dst WHERE s.component = q.component AND t.component = q.component) AS inner_edges FROM scc q GROUP BY component",
    "d8_tears": E + W + SCC + TEARS + END + "SELECT * FROM tears",
    "d9_propagation_cost": E + TC + END + "SELECT n, pairs, (pairs + n) / (n * n)::DOUBLE AS cost FROM (SELECT (SELECT count(*) FROM (SELECT src FROM a UNION SELECT dst FROM a)) AS n, (SELECT count(*) FROM tc WHERE src <> dst) AS pairs)",
    "d9_closure": E + TC + END + "SELECT * FROM tc",
    "d10_degrees": E + DEG + END + "SELECT * FROM deg",
    "d11_ratings": E + CL + SCC + END + """SELECT cost, CASE WHEN cost < 0.1 THEN 'good' WHEN cost < 0.3 THEN 'warning' ELSE 'critical' END AS cost_rating, largest_cycle, CASE WHEN largest_cycle <= 2 THEN 'good' WHEN largest_cycle <= 10 THEN 'warning' ELSE 'critical' END AS cycle_rating,
        quality, CASE WHEN quality > 0.8 THEN 'good' WHEN quality > 0.5 THEN 'warning' ELSE 'critical' END AS quality_rating FROM (SELECT (pairs + n) / (n * n)::DOUBLE AS cost, largest_cycle, quality FROM (SELECT (SELECT count(*) FROM (SELECT src FROM a UNION SELECT dst FROM a)) AS n, (SELECT count(*) FROM tc WHERE src <> dst) AS pairs,
        (SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM scc GROUP BY component HAVING count(*) > 1)) AS largest_cycle, (SELECT avg(CAST(x.cluster = y.cluster AS DOUBLE)) FROM a JOIN cl x ON x.node = src JOIN cl y ON y.node = dst) AS quality))""",
    "d12_layers": E + LEVEL + AGAINST + END + "SELECT node, level, CAST(row_number() OVER (PARTITION BY level ORDER BY component, node) - 1 AS INT) AS place, (SELECT count(*) FROM agn WHERE agn.src = comp.node) AS feedback FROM comp JOIN best USING (component)",
    "d13_bands": E + LEVEL + END + "SELECT node, CASE WHEN component IN (SELECT src FROM ca) THEN 1 ELSE 0 END AS band, level AS longest FROM comp JOIN best USING (component)",
    "d14_cluster_cost": E + W + CL + END + "SELECT sum(weight * pow(CASE WHEN x.cluster = y.cluster THEN (SELECT count(*) FROM cl c WHERE c.cluster = x.cluster) ELSE (SELECT count(*) FROM cl) END, 2)) AS cost FROM w JOIN cl x ON x.node = src JOIN cl y ON y.node = dst",
    "d15_clusters": E + CL + END + """SELECT cluster, size, coalesce(inner_edges, 0) AS inner_edges, coalesce(outgoing, 0) AS outgoing, coalesce(inner_edges, 0) / greatest(1, size * (size - 1))::DOUBLE AS cohesion FROM (SELECT cluster, count(*) AS size FROM cl GROUP BY cluster) s
        LEFT JOIN (SELECT x.cluster, count(*) FILTER (x.cluster = y.cluster) AS inner_edges, count(*) FILTER (x.cluster <> y.cluster) AS outgoing FROM a JOIN cl x ON x.node = src JOIN cl y ON y.node = dst GROUP BY x.cluster) t USING (cluster)""",
    "d16_dead_code": E + f"""live AS (SELECT node FROM (SELECT src AS node FROM a UNION SELECT dst FROM a) WHERE {NUM.format('node')} % 50 = 7 UNION SELECT a.dst FROM live JOIN a ON a.src = live.node), """ + END + f"""
        SELECT 'crate::' || replace(node, '.', '_') || '::go' || ({NUM.format('node')} % 3) AS name, node AS file, CASE WHEN {NUM.format('node')} % 2 = 0 THEN 'definite' ELSE 'possible' END AS confidence
        FROM (SELECT src AS node FROM a UNION SELECT dst FROM a) WHERE node NOT IN (SELECT node FROM live) AND {NUM.format('node')} % 13 <> 0""",
    "d17_directed": E + CL + HALF + END + """SELECT module, size, coalesce(inner_edges, 0) AS inner_edges, coalesce(boundary_edges, 0) AS boundary_edges, coalesce(inner_edges, 0) / greatest(1, size * (size - 1))::DOUBLE AS cohesion, coalesce(outside, 0) / greatest(1, size * ((SELECT count(*) FROM cl WHERE node IN (SELECT src FROM a UNION SELECT dst FROM a)) - size) * 2)::DOUBLE AS coupling
        FROM (SELECT module, count(*) AS size FROM md GROUP BY module) LEFT JOIN (SELECT x.module, count(*) FILTER (y.module IS NOT DISTINCT FROM x.module) AS inner_edges, count(*) FILTER (y.module IS DISTINCT FROM x.module) AS boundary_edges FROM a JOIN md x ON x.node = src LEFT JOIN md y ON y.node = dst GROUP BY x.module) USING (module)
        LEFT JOIN (SELECT x.module, count(*) AS outside FROM (SELECT src, dst FROM a UNION SELECT dst, src FROM a) b JOIN md x ON x.node = b.src LEFT JOIN md y ON y.node = b.dst WHERE x.module IS DISTINCT FROM y.module GROUP BY x.module) USING (module)""",
    "d17_affinity": E + CL + HALF + "b AS (SELECT src AS node, dst AS other FROM a UNION ALL SELECT dst, src FROM a), " + END + "SELECT node, module, n FROM (SELECT b.node, md.module, count(*) AS n, row_number() OVER (PARTITION BY b.node ORDER BY count(*) DESC, md.module) AS r FROM b JOIN md ON md.node = b.other WHERE b.node NOT IN (SELECT node FROM md) GROUP BY b.node, md.module) WHERE r = 1",
    "d18_violations": E + CL + HALF + SCC.replace("scc AS", "scc0 AS") + "scc AS (SELECT node, component FROM scc0), " + VIOLATIONS + END + "SELECT * FROM vio",
    "d19_migration": E + CL + HALF + SCC + VIOLATIONS + PLAN + END + "SELECT * FROM mig",
    "d20_suggestions": E + W + CL + HALF + SCC + TEARS + DEG + AGAINST + VIOLATIONS + PLAN + END + """SELECT CASE WHEN (SELECT max(c) FROM (SELECT count(*) AS c FROM scc GROUP BY component)) > 10 THEN 0 ELSE 1 END AS priority, 'extract_interface' AS kind, src AS source, dst AS target FROM tears
        UNION ALL SELECT 2, 'create_module_boundary', x.cluster, y.cluster FROM a JOIN cl x ON x.node = src JOIN cl y ON y.node = dst WHERE x.cluster <> y.cluster GROUP BY x.cluster, y.cluster HAVING count(*) >= 3
        UNION ALL SELECT 2, 'split_package', s.cluster, '' FROM (SELECT cluster, count(*) AS k FROM cl GROUP BY cluster) s LEFT JOIN (SELECT x.cluster, count(*) AS i FROM a JOIN cl x ON x.node = src JOIN cl y ON y.node = dst AND y.cluster = x.cluster GROUP BY x.cluster) t USING (cluster) WHERE k > 15 AND coalesce(i, 0) / greatest(1, k * (k - 1))::DOUBLE < 0.3
        UNION ALL SELECT 1, 'extract_interface', node, '' FROM deg WHERE fan_in > 20 UNION ALL SELECT 2, 'internalize_detail', node, '' FROM deg WHERE instability > 0.8 AND fan_in > 5 UNION ALL SELECT 2, 'introduce_layer', src, dst FROM agn
        UNION ALL SELECT CASE risk WHEN 'low' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, 'migration_step', element, to_module FROM mig""",
    "d23_batches": D + "lv AS (SELECT node, 0 AS level FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT src FROM a) UNION SELECT a.src, lv.level + 1 FROM lv JOIN a ON a.dst = lv.node), " + END + "SELECT node AS id, max(level) AS batch FROM lv GROUP BY node",
    "d23_errors": """WITH n AS (SELECT 'i' || p_partkey AS id, 'i' || (CASE WHEN p_partkey % 7 = 0 THEN p_partkey ELSE p_partkey + 1 END) AS needs, p_partkey AS k FROM part), m AS (SELECT id, needs FROM n UNION ALL SELECT id, needs FROM n WHERE k % 5 = 0)
        SELECT ' ' AS id, 'empty_id' AS error UNION ALL SELECT id, 'duplicate_id' FROM n WHERE k % 9 = 0 UNION ALL SELECT id, 'self' FROM m WHERE id = needs UNION ALL SELECT id, 'repeated' FROM n WHERE k % 5 = 0 UNION ALL SELECT id, 'missing' FROM m WHERE needs NOT IN (SELECT id FROM n)""",
    "d24_ready": D + END + f"SELECT node AS id FROM (SELECT src AS node FROM a UNION SELECT dst FROM a) WHERE {NUM.format('node')} % 3 = 1 AND node NOT IN (SELECT src FROM a WHERE {NUM.format('dst')} % 3 <> 0)",
    "d26_orphans": E + END + "SELECT node AS tag FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (SELECT dst FROM a)",
    "d26_cycle_chains": E + SCC + """ii AS (SELECT a.src, a.dst, x.component FROM a JOIN scc x ON x.node = src JOIN scc y ON y.node = dst AND y.component = x.component), ch AS (SELECT component, [src, dst] AS chain, dst AS last FROM ii WHERE src = component
        UNION SELECT ch.component, list_append(chain, ii.dst), ii.dst FROM ch JOIN ii ON ii.src = ch.last AND ii.component = ch.component WHERE ch.last <> ch.component AND len(chain) < 6 AND (NOT list_contains(chain, ii.dst) OR ii.dst = ch.component)), """ + END + "SELECT chain FROM (SELECT chain, row_number() OVER (PARTITION BY component ORDER BY len(chain), chain) AS r FROM ch WHERE last = component) WHERE r = 1",
    "d26_all_tags": "SELECT lower(n_name) AS tag FROM nation UNION SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') FROM part UNION SELECT p_brand FROM part",
    "d27_quorum": "SELECT s_nationkey AS board, count(*) AS total, count(*) FILTER (s_acctbal > 4000) AS n_up, CASE WHEN count(*) FILTER (s_acctbal > 4000) * 2 > count(*) THEN 'healthy' WHEN count(*) FILTER (s_acctbal > 4000) > 0 THEN 'degraded' ELSE 'critical' END AS health FROM supplier GROUP BY s_nationkey",
}
