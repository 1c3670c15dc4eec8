"""Web and snapshot queries over pages, documents and customers, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import dash, uuid5
from sparkloom.operators import snapshots as S
from sparkloom.operators import web as W


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet")


def bare(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose furniture, which holds all their links, is taken for content."""
    return pages(spark, sf).withColumn("html", F.regexp_replace("html", r"(?i)(</?)(nav|header|footer)\b", "$1div"))


def t(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").selectExpr(*columns)


OLD = "SELECT 'f::fn:' || c_custkey % 700 AS key, '(' || min(c_nationkey) || ')' AS signature FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1"
NEW = "SELECT 'f::fn:' || c_custkey % 700 AS key, '(' || min(c_nationkey) || ')' AS signature FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1"
COLUMN = "SELECT 't' || p_size AS tab, 'c' || p_partkey % 9 AS col, CASE WHEN max(p_partkey) % {m} = 0 THEN 'bigint' ELSE 'text' END AS type, min(p_partkey) % {n} = 0 AS nullable FROM part WHERE p_size {w} GROUP BY 1, 2"
BEFORE, AFTER = COLUMN.format(m=3, n=2, w="< 45"), COLUMN.format(m=4, n=3, w="> 5")
FOUND = "SELECT CASE WHEN doc_id % 10 = 1 THEN 'moved/' || doc_id ELSE 'p/' || doc_id END AS path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || '!' ELSE text END) AS sha256 FROM documents WHERE doc_id % 10 <> 3"
CACHE = "SELECT 'p/' || doc_id AS path, sha256(text) AS sha256, CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 2 END AS version, doc_id % 50 = 7 AS pending FROM documents WHERE doc_id % 10 <> 4"
CONFLICT = "SELECT CASE p_size % 4 WHEN 0 THEN 'CONFLICT (content): Merge conflict in src/' || p_partkey || '.rs' WHEN 1 THEN 'CONFLICT (modify/delete): lib/' || p_partkey || '.py deleted in HEAD' ELSE 'Auto-merging ' || p_name END AS line, 'src/' || p_partkey || '.rs' AS file FROM part"


def sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    names = [n for n in ("customer", "part", "documents", "orders", "events") if f"FROM {n}" in text]
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text.replace("sha256(CASE", "sha2(CASE").replace("END) AS sha256", "END, 256) AS sha256").replace("sha256(text)", "sha2(text, 256)"), **{n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names})


def schema(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return sql(spark, sf, text).withColumnsRenamed({"tab": "table", "col": "column"})


QUERIES = {
    "k1_uuid5": lambda s, d: pages(s, d).select("page_id", uuid5(W.NAMESPACE, F.col("url")).alias("id")),
    "k2_headings": lambda s, d: W.headings(pages(s, d)),
    "k2_sections": lambda s, d: W.sections(pages(s, d), 200).select("page_id", "pos", "heading", "level", F.length("content").alias("chars")),
    "k3_links": lambda s, d: W.links(bare(s, d)).select("page_id", "href", "text"),
    "k3_resolved_links": lambda s, d: W.links(bare(s, d)).select("page_id", "href", W.resolve(F.col("url"), F.col("href")).alias("target")),
    "k4_concepts": lambda s, d: W.concepts(W.sections(pages(s, d))),
    "k5_web_graph": lambda s, d: W.graph(bare(s, d)).groupBy("edge_type", "weight").agg(F.count("*").alias("n")),
    "k15_classify_files": lambda s, d: S.classify_files(sql(s, d, FOUND), sql(s, d, CACHE), 2),
    "k17_dash": lambda s, d: t(s, d, "part", "p_partkey", "'  ' || p_name || '!! ' || p_type || '-' AS x").select("p_partkey", dash(F.col("x")).alias("tag")),
    "k18_content_hash": lambda s, d: S.content_hash(t(s, d, "conversations", "conv_id AS id", "turn AS seq", "text AS part")),
    "k19_collisions": lambda s, d: S.collisions(t(s, d, "documents", "text"), F.sha2("text", 256)),
    "c4_common_imports": lambda s, d: S.common_imports(t(s, d, "lineitem", "l_suppkey AS file", "'use ' || l_partkey % 300 AS text")),
    "c5_budget": lambda s, d: S.budgeted(t(s, d, "documents", "doc_id AS file", "text").select("file", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level"), "text").select("file", "level", F.expr("left(text, CAST(length(text) / (1 + level) AS INT))").alias("text")), 250000),
    "c9_api_diff": lambda s, d: S.api_diff(sql(s, d, OLD), sql(s, d, NEW)),
    "c10_schema_diff": lambda s, d: S.schema_diff(schema(s, d, BEFORE), schema(s, d, AFTER)),
    "c11_set_changes": lambda s, d: S.set_changes(t(s, d, "part", "p_brand || p_size AS label", "p_partkey % 2 AS k").where("k = 0"), t(s, d, "part", "p_brand || p_size AS label", "p_partkey % 2 AS k").where("k = 1")),
    "c12_conflicts": lambda s, d: S.merge_conflicts(sql(s, d, CONFLICT)),
    "c12_clean_files": lambda s, d: S.clean_files(sql(s, d, CONFLICT).select("file"), S.merge_conflicts(sql(s, d, CONFLICT))),
    "c17_aliases": lambda s, d: S.aliases(t(s, d, "part", "p_brand AS alias", "p_name AS target", "p_size AS priority")),
    "c18_read_advice": lambda s, d: S.read_advice(t(s, d, "orders", "o_custkey % 90 AS session_id", "'f' || o_orderkey % 700 AS file", "CAST(floor(o_totalprice) AS BIGINT) AS bytes", "o_orderkey").drop("o_orderkey"), t(s, d, "orders", "o_custkey % 90 AS session_id", "'f' || o_orderkey % 700 AS file", "o_orderpriority").where("o_orderpriority = '1-URGENT'")),
    "u9_hosts": lambda s, d: pages(s, d).groupBy(W.host(F.col("url")).alias("host")).agg(F.count("*").alias("n")),
    "u9_normal_urls": lambda s, d: pages(s, d).select("page_id", W.normal_url(F.concat("url", F.lit("/?Q=1#f"))).alias("url")),
    "u12_titles": lambda s, d: pages(s, d).select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract("html", r"(?is)<meta\s+charset=\"?([^\">\s]+)", 1).alias("charset")),
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CLEAN = "html"
for _tag in W.DROPPED:
    CLEAN = f"regexp_replace({CLEAN}, {q(rf'(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>')}, '', 'g')"
CLEAN = f"regexp_replace({CLEAN}, {q(r'(?s)<!--.*?-->')}, '', 'g')"
P = f"WITH p AS (SELECT page_id, url, {CLEAN} AS html FROM pages) "
BARE = P.replace("FROM pages", "FROM (SELECT page_id, url, regexp_replace(html, '(?i)(</?)(nav|header|footer)\\b', '\\1div', 'g') AS html FROM pages)")
PLAIN = "trim(regexp_replace({0}, '<[^>]+>', '', 'g'), e' \\t\\n\\r')"
DECODED = "{0}"
for _e, _c in W.ENTITIES:
    DECODED = f"replace({DECODED}, {q(_e)}, {q(_c)})"
SECTIONS = f"""hp AS (SELECT page_id, url, html, regexp_split_to_array(html, {q(W.HEADING.replace('([1-6])', '[1-6]').replace('(.*?)', '.*?'))}) AS parts, regexp_extract_all(html, {q(W.HEADING)}, 1) AS levels, regexp_extract_all(html, {q(W.HEADING)}, 2) AS titles FROM p),
raw AS (SELECT page_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS part, levels, titles FROM hp),
named AS (SELECT page_id, pos, part, CASE WHEN pos > 0 THEN {PLAIN.format('titles[pos]')} ELSE '' END AS title, levels[pos] AS lv, len(titles) AS n FROM raw),
sec AS (SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN title <> '' THEN title WHEN n = 0 THEN 'Content' ELSE 'Introduction' END AS heading, CASE WHEN title <> '' THEN CAST(lv AS INT) ELSE 1 END AS level,
 array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(part, {q(W.BLOCK)}, 1), lambda x: {PLAIN.format('x')}), lambda y: y <> ''), lambda z: {DECODED.format('z')}), chr(10)) AS content, title FROM named),
sections AS (SELECT * FROM sec WHERE (title <> '' OR content <> '') AND pos < 200) """
WHOLE = SECTIONS.replace(" AND pos < 200", "")
LINKS = f"""lk AS (SELECT page_id, url, unnest(regexp_extract_all(html, {q(W.LINK)}, 1)) AS href, unnest(regexp_extract_all(html, {q(W.LINK)}, 2)) AS inside FROM p),
links AS (SELECT page_id, url, trim(href) AS href, {PLAIN.format('inside')} AS text FROM lk WHERE trim(href) <> '' AND NOT starts_with(trim(href), '#') AND NOT starts_with(lower(trim(href)), 'javascript:')) """
RESOLVED = r"""CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href
 WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href WHEN starts_with(href, '?') THEN regexp_extract(url, '^[^?#]*') || href
 ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*/)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*/)', 1) END || href END"""
CONCEPTS = f"""found AS (SELECT page_id, pos, 0 AS kind, 0 AS place, heading AS name FROM sections WHERE heading NOT IN ('Content', 'Introduction') UNION ALL
 SELECT page_id, pos, 1, place, name FROM (SELECT page_id, pos, generate_subscripts(xs, 1) AS place, unnest(xs) AS name FROM (SELECT page_id, pos, regexp_extract_all(content, {q(W.PHRASE)}, 1) AS xs FROM sections)) WHERE strlen(name) BETWEEN 4 AND 80),
first AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY pos, kind, place) = 1),
concepts AS (SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos, kind, place) AS INT) AS rank, name FROM first) """
UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"

ORACLES = {
    "k1_uuid5": f"SELECT page_id, {UUID} AS id FROM (SELECT page_id, sha1(unhex('{W.NAMESPACE}') || encode(url)) AS h FROM pages)",
    "k2_headings": P + f"SELECT page_id, CAST(pos AS INT) AS pos, CAST(lv AS INT) AS level, {PLAIN.format('t')} AS heading FROM (SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS lv, unnest(b) AS t FROM (SELECT page_id, regexp_extract_all(html, {q(W.HEADING)}, 1) AS a, regexp_extract_all(html, {q(W.HEADING)}, 2) AS b FROM p))",
    "k2_sections": P + ", " + SECTIONS + "SELECT page_id, pos, heading, level, CAST(length(content) AS INT) AS chars FROM sections",
    "k3_links": BARE + ", " + LINKS + "SELECT page_id, href, text FROM links",
    "k3_resolved_links": BARE + ", " + LINKS + f"SELECT page_id, href, {RESOLVED} AS target FROM links",
    "k4_concepts": P + ", " + WHOLE + ", " + CONCEPTS + "SELECT * FROM concepts",
    "k5_web_graph": BARE + ", " + WHOLE + ", " + LINKS + ", " + CONCEPTS + f""", edges AS (SELECT DISTINCT 'contains' AS edge_type, 1.0::DOUBLE AS weight, page_id::VARCHAR AS a, pos::VARCHAR AS b FROM sections
        UNION SELECT DISTINCT 'contains', 1.0, 's' || page_id || '#' || pos, lower(name) FROM concepts
        UNION SELECT DISTINCT 'related_to', 0.7, lower(x.name), lower(y.name) FROM concepts x JOIN concepts y ON x.page_id = y.page_id AND x.pos = y.pos AND x.rank < y.rank
        UNION SELECT DISTINCT 'references', 0.5, url, {RESOLVED} FROM links WHERE {RESOLVED} IS NOT NULL) SELECT edge_type, weight, count(*) AS n FROM edges GROUP BY ALL""",
    "k15_classify_files": f"""WITH f AS ({FOUND}), c AS ({CACHE}), j AS (SELECT coalesce(f.path, c.path) AS path, f.sha256 AS new, c.sha256 AS old, version, pending FROM f FULL JOIN c ON f.path = c.path),
        moved AS (SELECT came.t, went.f FROM (SELECT new AS h, max(path) AS t FROM j WHERE old IS NULL GROUP BY new) came JOIN (SELECT old AS h, min(path) AS f FROM j WHERE new IS NULL GROUP BY old) went ON came.h = went.h)
        SELECT path, CASE WHEN pending THEN 'recover' WHEN new IS NULL THEN CASE WHEN b.t IS NOT NULL THEN 'renamed_away' ELSE 'missing' END WHEN old IS NULL THEN CASE WHEN a.f IS NOT NULL THEN 'renamed' ELSE 'new' END WHEN old <> new THEN 'changed' WHEN version <> 2 THEN 'drifted' ELSE 'unchanged' END AS decision, a.f AS "from"
        FROM j LEFT JOIN moved a ON a.t = path LEFT JOIN moved b ON b.f = path""",
    "k17_dash": "SELECT p_partkey, trim(regexp_replace(lower('  ' || p_name || '!! ' || p_type || '-'), '[^a-z0-9]+', '-', 'g'), '-') AS tag FROM part",
    "k18_content_hash": "SELECT conv_id AS id, sha256(string_agg(text, chr(0) ORDER BY turn)) AS sha256 FROM conversations GROUP BY conv_id",
    "k19_collisions": "SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "c4_common_imports": "SELECT 'use ' || l_partkey % 300 AS text, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3",
    "c5_budget": "WITH x AS (SELECT level, CAST(floor(sum(strlen(left(text, CAST(floor(length(text) / (1 + level)) AS BIGINT)))) / 4) AS BIGINT) AS tokens FROM documents, (SELECT unnest(range(6)) AS level) GROUP BY level) SELECT CAST(level AS INT) AS level, tokens FROM x ORDER BY tokens > 250000, CASE WHEN tokens > 250000 THEN -level ELSE level END LIMIT 1",
    "c9_api_diff": f"SELECT *, CASE WHEN change = 'added' THEN 'minor' ELSE 'breaking' END AS severity FROM (SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'removed' WHEN a.key IS NULL THEN 'added' WHEN a.signature <> b.signature THEN 'signature_changed' END AS change, a.signature AS old, b.signature AS new FROM ({OLD}) a FULL JOIN ({NEW}) b ON a.key = b.key) WHERE change IS NOT NULL",
    "c10_schema_diff": f"""WITH a AS ({BEFORE}), b AS ({AFTER}), ta AS (SELECT DISTINCT tab FROM a), tb AS (SELECT DISTINCT tab FROM b),
        j AS (SELECT coalesce(x.tab, y.tab) AS tab, coalesce(x.col, y.col) AS col, x.type AS a_type, y.type AS b_type, x.nullable AS an, y.nullable AS bn FROM (FROM a WHERE tab IN (FROM tb)) x FULL JOIN (FROM b WHERE tab IN (FROM ta)) y ON x.tab = y.tab AND x.col = y.col),
        c AS (SELECT tab, NULL::VARCHAR AS col, 'table_dropped' AS change FROM ta WHERE tab NOT IN (FROM tb) UNION ALL SELECT tab, NULL, 'table_added' FROM tb WHERE tab NOT IN (FROM ta) UNION ALL SELECT tab, col, 'column_dropped' FROM j WHERE b_type IS NULL
        UNION ALL SELECT tab, col, CASE WHEN bn THEN 'column_added' ELSE 'required_column_added' END FROM j WHERE a_type IS NULL UNION ALL SELECT tab, col, 'type_changed' FROM j WHERE a_type <> b_type UNION ALL SELECT tab, col, CASE WHEN an THEN 'became_required' ELSE 'became_nullable' END FROM j WHERE an <> bn)
        SELECT tab AS "table", col AS "column", change, CASE WHEN change IN ('table_added', 'column_added', 'became_nullable') THEN 'minor' ELSE 'breaking' END AS severity FROM c""",
    "c11_set_changes": "SELECT label, 'removed' AS change FROM (SELECT p_brand || p_size AS label FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT p_brand || p_size FROM part WHERE p_partkey % 2 = 1) UNION ALL SELECT label, 'added' FROM (SELECT p_brand || p_size AS label FROM part WHERE p_partkey % 2 = 1 EXCEPT SELECT p_brand || p_size FROM part WHERE p_partkey % 2 = 0)",
    "c12_conflicts": "SELECT CASE p_size % 4 WHEN 0 THEN 'content' ELSE 'modify/delete' END AS kind, CASE p_size % 4 WHEN 0 THEN 'src/' || p_partkey || '.rs' ELSE 'lib/' || p_partkey || '.py' END AS file FROM part WHERE p_size % 4 < 2",
    "c12_clean_files": "SELECT 'src/' || p_partkey || '.rs' AS file FROM part WHERE p_size % 4 <> 0",
    "c17_aliases": "SELECT alias, target FROM (SELECT p_brand AS alias, p_name AS target, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name) AS r FROM part) WHERE r = 1",
    "c18_read_advice": "WITH r AS (SELECT o_custkey % 90 AS session_id, 'f' || o_orderkey % 700 AS file, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderpriority AS pr FROM orders) SELECT session_id, file, bytes, CAST(floor(bytes / 4) AS BIGINT) AS tokens FROM r WHERE floor(bytes / 4) > 8000 AND NOT EXISTS (SELECT 1 FROM r s WHERE s.pr = '1-URGENT' AND s.session_id = r.session_id AND s.file = r.file)",
    "u9_hosts": "SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "u9_normal_urls": "SELECT page_id, rtrim(lower(regexp_extract(url || '/?Q=1#f', '^[^?#]*')), '/') AS url FROM pages",
    "u12_titles": "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?is)<meta\\s+charset=\"?([^\">\\s]+)', 1) AS charset FROM pages",
}
