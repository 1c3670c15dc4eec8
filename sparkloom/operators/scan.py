"""Rule scanners. Rules are unrolled to literal patterns, each compiled once a task; only hits are exploded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import mask, satisfies
from sparkloom.operators import rules as R


def at_least(severity: str) -> list[str]:
    return list(R.SEVERITIES[R.SEVERITIES.index(severity) :])


def scan(lines: DataFrame, rules: tuple[R.Rule, ...], language: Column | None = None) -> DataFrame:
    """One row for each line and rule that matches it, with the first match; `language` limits rules to file extensions."""
    hits = []
    for rule in rules:
        applies = F.col("line").rlike(rule.pattern)
        if rule.languages and language is not None:
            applies = F.lower(language).isin([x.lower() for x in rule.languages]) & applies
        hits.append(F.when(applies, F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.category).alias("category"), F.lit(rule.severity).alias("severity"), F.lit(rule.confidence).alias("confidence"), F.regexp_extract("line", rule.pattern, 0).alias("match"))))
    return lines.select("*", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(*lines.columns, "hit.*")


def secrets(lines: DataFrame) -> DataFrame:
    """Credentials by line, shown with the match masked."""
    found = scan(lines, R.SECRETS)
    at = F.position(F.col("match"), F.col("line"))
    masked = F.concat(F.substring("line", F.lit(1), at - 1), mask(F.col("match")), F.substring("line", at + F.length("match"), F.length("line")))
    return found.select("doc", "line_no", "rule_id", "severity", masked.alias("snippet"))


def threats(lines: DataFrame, confidence: str = "medium") -> DataFrame:
    """Threats by line of source files (doc, ext, line_no, line): mutation routes only if no line of the 20 from them on logs, unsafe loading not if it is the safe form."""
    by_line = Window.partitionBy("doc").orderBy("line_no").rowsBetween(0, 19)
    marked = lines.withColumn("audited", F.bool_or(F.col("line").rlike(R.AUDIT)).over(by_line))
    levels = ("low", "medium", "high")
    rules = tuple(r for r in R.THREATS if levels.index(r.confidence) >= levels.index(confidence))
    found = scan(marked, rules, F.col("ext"))
    safe = F.col("line").contains("safe_load") & ~F.col("line").contains("pickle.loads")
    return found.where(~((F.col("rule_id") == "REPUD-001") & F.col("audited")) & ~((F.col("rule_id") == "ELEV-003") & safe)).select("doc", "line_no", "rule_id", "category", "severity")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """`text` with credentials replaced, one kind after the other, and how many were."""
    out = df.withColumn("redactions", F.lit(0))
    for (label, pattern), words in zip(R.REDACTIONS, R.REDACTION_WORDS):
        out = counted_replace(out, text, "redactions", pattern, f"<REDACTED:{label}>", words)
    return settled(out, text, "redactions")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def counted_replace(df: DataFrame, text: str, count: str, pattern: str, to: str, words: tuple[str, ...]) -> DataFrame:
    """`pattern` replaced and what went added to `count`; texts without any of the words (in lower case) are not searched."""
    may = has_any(F.lower(text), words)
    return df.withColumns({count: F.col(count) + F.when(may, F.regexp_count(F.col(text), F.lit(pattern))).otherwise(0), text: F.when(may, F.regexp_replace(text, pattern, to)).otherwise(F.col(text))})


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with `columns` made by a generator of one row, which filters on them stay above: pushed below, a filter would hold each replaced text three times and more, one in the other."""
    made = df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(F.struct(*columns))))
    return made.select(*df.columns)


def excluded(path: Column) -> Column:
    """Why a file's notes are no debt; null if they may be."""
    norm = F.regexp_replace(path, r"\\", "/")
    name = F.element_at(F.split(norm, "/"), -1)
    test = norm.rlike(r"(^|/)(tests|test|__tests__|spec|specs)(/|\z)") | name.startswith("test_") | name.rlike(r"_test\.(rs|go|py)\z|\.(test|spec)\.|_spec\.rb\z")
    return F.when(test, "test-path").when(F.lower(name).contains("fixture"), "fixture-file").when(norm.contains("todo-extract/"), "detector-source")


def debt(lines: DataFrame) -> DataFrame:
    """Notes of debt by line of (path, line_no, line), with the reason why they may not count."""
    hit = F.regexp_extract("line", R.DEBT, 1)
    found = lines.where(F.col("line").rlike(R.DEBT)).select("path", "line_no", hit.alias("kind"), F.rtrim(F.regexp_extract("line", R.DEBT, 2)).alias("note"), excluded(F.col("path")).alias("excluded"))
    return found.withColumn("actionable", F.col("excluded").isNull())


def advisories(spark: SparkSession) -> DataFrame:
    rows = ", ".join(str(r) for r in R.ADVISORIES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ecosystem, package, operator, bound, severity)")


def audit(packages: DataFrame, severity: str = "medium") -> DataFrame:
    """Packages (ecosystem, name, version) with known bad versions; the table of advisories is fixed and small."""
    known = advisories(packages.sparkSession).where(F.col("severity").isin(at_least(severity)))
    joined = packages.join(F.broadcast(known), (packages.ecosystem == known.ecosystem) & (packages.name == known.package))
    return joined.where(satisfies(F.col("version"), F.col("operator"), F.col("bound"))).select(packages.ecosystem, "name", "version", "severity", "operator", "bound")


def sanitize(df: DataFrame, text: str = "text", limit: int = 5000) -> DataFrame:
    """Web text without hidden elements, comments, invisible characters and encoded blobs, cut to `limit` bytes; counts of what went, and whether it tries to instruct."""
    from sparkloom.functions.text import truncate_utf8

    out = df.withColumn("hidden", F.lit(0))
    for word, pattern in R.HIDDEN:
        out = counted_replace(out, text, "hidden", pattern, "", (word,))
    out = out.withColumn(text, F.regexp_replace(text, R.COMMENT, ""))
    out = out.withColumns({"invisible": F.regexp_count(F.col(text), F.lit(R.SUSPICIOUS)), text: F.regexp_replace(text, R.SUSPICIOUS, "")})
    out = out.withColumn("sanitize_lower", F.lower(text))
    blocked = F.lit(False)
    for pattern, words in zip(R.INJECTIONS, R.INJECTION_WORDS):
        blocked = blocked | (has_any(F.col("sanitize_lower"), words) & F.col(text).rlike(pattern))
    out = out.withColumns({"blocked": blocked, "encoded": F.regexp_count(F.col(text), F.lit(R.BASE64)), text: F.regexp_replace(text, R.BASE64, "[base64-removed]")})
    out = out.withColumns({"encoded": F.col("encoded") + F.regexp_count(F.col(text), F.lit(R.DATA_URI)), text: F.regexp_replace(text, R.DATA_URI, "[data-uri-removed]")})
    out = settled(out.drop("sanitize_lower"), text, "hidden", "invisible", "blocked", "encoded")
    return out.withColumns({"truncated": F.octet_length(text) > limit, text: truncate_utf8(F.col(text), limit)})


def without_secrets(url: Column) -> Column:
    """A URL without query parameters whose names hold a sensitive word."""
    query = F.regexp_extract(url, r"(?s)^[^?]*\?(.*)\z", 1)
    key = lambda p: F.lower(F.regexp_extract(p, r"^[^=]*", 0))

    def sensitive(p: Column) -> Column:
        out = F.lit(False)
        for word in R.SENSITIVE:
            out = out | key(p).contains(word)
        return out

    kept = F.filter(F.split(query, "&", -1), lambda p: ~sensitive(p))
    base = F.regexp_extract(url, r"^[^?]*", 0)
    return F.when(~url.contains("?"), url).when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(kept, "&")))


def without_blocked(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that are not blocked, and edges that touch none that is."""
    blocked = entities.where("blocked").select("id")
    left = edges.join(blocked, edges.src == blocked.id, "left_anti")
    return entities.where(~F.col("blocked")), left.join(blocked, left.dst == blocked.id, "left_anti")
