"""Comparing snapshots: APIs, schemas, file caches, merges; and small catalogue operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def api_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols (key, signature) that were removed or changed (breaking) or added (minor)."""
    a, b = before.select("key", F.col("signature").alias("old")), after.select("key", F.col("signature").alias("new"))
    joined = a.withColumn("was", F.lit(True)).join(b.withColumn("is", F.lit(True)), "key", "full")
    kind = F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "signature_changed")
    return joined.select("key", kind.alias("change"), F.when(kind == "added", "minor").otherwise("breaking").alias("severity"), "old", "new").where("change is not null")


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns (table, column, type, nullable) that differ, with what a reader or writer would notice."""
    side = lambda df, p: df.select("table", "column", F.col("type").alias(p + "_type"), F.col("nullable").alias(p + "_null"))
    tables = lambda df, name: df.select("table").distinct().withColumn(name, F.lit(True))
    both = tables(before, "was").join(tables(after, "is"), "table", "full")
    whole = both.where("was is null or is is null").select("table", F.lit(None).cast("string").alias("column"), F.when(F.col("is").isNull(), "table_dropped").otherwise("table_added").alias("change"))
    common = both.where("was and is").select("table")
    cols = side(before, "a").join(common, "table", "left_semi").join(side(after, "b").join(common, "table", "left_semi"), ["table", "column"], "full")
    kinds = F.filter(F.array(
        F.when(F.col("b_type").isNull(), F.lit("column_dropped")),
        F.when(F.col("a_type").isNull(), F.when(F.col("b_null"), F.lit("column_added")).otherwise(F.lit("required_column_added"))),
        F.when(F.col("a_type") != F.col("b_type"), F.lit("type_changed")),
        F.when(F.col("a_null") & ~F.col("b_null"), F.lit("became_required")).when(~F.col("a_null") & F.col("b_null"), F.lit("became_nullable")),
    ), lambda x: x.isNotNull())
    changed = cols.select("table", "column", F.explode(kinds).alias("change"))
    severity = F.when(F.col("change").isin("table_added", "column_added", "became_nullable"), "minor").otherwise("breaking")
    return whole.unionByName(changed).withColumn("severity", severity)


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that went and came."""
    gone = before.select("label").subtract(after.select("label")).withColumn("change", F.lit("removed"))
    return gone.unionByName(after.select("label").subtract(before.select("label")).withColumn("change", F.lit("added")))


def classify_files(found: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """What a refresh does with each path: found (path, sha256) against cache (path, sha256, version, pending).

    Renames go by equal content between a path that is new and one that vanished; of several, the last new path and the
    first old one by name.
    """
    f, c = found.select("path", F.col("sha256").alias("new")), cache.select("path", F.col("sha256").alias("old"), "version", "pending")
    joined = f.join(c, "path", "full")
    came = joined.where("old is null").groupBy(F.col("new").alias("sha256")).agg(F.max("path").alias("to"))
    went = joined.where("new is null").groupBy(F.col("old").alias("sha256")).agg(F.min("path").alias("from"))
    moved = came.join(went, "sha256")
    marked = joined.join(moved.select(F.col("to").alias("path"), "from"), "path", "left").join(moved.select(F.col("from").alias("path"), "to"), "path", "left")
    decision = (
        F.when(F.col("pending"), "recover")
        .when(F.col("new").isNull(), F.when(F.col("to").isNotNull(), "renamed_away").otherwise("missing"))
        .when(F.col("old").isNull(), F.when(F.col("from").isNotNull(), "renamed").otherwise("new"))
        .when(F.col("old") != F.col("new"), "changed")
        .when(F.col("version") != version, "drifted")
        .otherwise("unchanged")
    )
    return marked.select("path", decision.alias("decision"), "from")


def merge_conflicts(lines: DataFrame) -> DataFrame:
    """(kind, file) of conflict lines of a merge."""
    form = r"^CONFLICT \(([^)]+)\): (?:Merge conflict in (.+)|(\S+) (?:deleted|renamed|added).*)\z"
    file = F.coalesce(F.nullif(F.regexp_extract("line", form, 2), F.lit("")), F.nullif(F.regexp_extract("line", form, 3), F.lit("")))
    return lines.where(F.col("line").rlike(form)).select(F.regexp_extract("line", form, 1).alias("kind"), file.alias("file"))


def clean_files(changed: DataFrame, conflicts: DataFrame) -> DataFrame:
    return changed.join(conflicts.select("file").distinct(), "file", "left_anti")


def common_imports(imports: DataFrame, least: int = 3) -> DataFrame:
    """Imports (file, text) that at least `least` files share."""
    return imports.select("file", "text").distinct().groupBy("text").agg(F.count("*").alias("files")).where(F.col("files") >= least)


def budgeted(levels: DataFrame, budget: int) -> DataFrame:
    """The most detailed level (0 first) of outlines (file, level, text) whose estimated tokens fit; the last if none does."""
    sized = levels.groupBy("level").agg(F.floor(F.sum(F.octet_length("text")) / 4).alias("tokens"))
    return sized.agg(F.min(F.struct((F.col("tokens") > budget).alias("over"), F.when(F.col("tokens") > budget, -F.col("level")).otherwise(F.col("level")).alias("k"), "level", "tokens")).alias("best")).select("best.level", "best.tokens")


def aliases(rows: DataFrame) -> DataFrame:
    """Aliases (alias, target, priority): the highest priority wins."""
    last = Window.partitionBy("alias").orderBy(F.desc("priority"), "target")
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").select("alias", "target")


def read_advice(reads: DataFrame, seen: DataFrame, tokens: int = 8000) -> DataFrame:
    """Reads (session_id, file, bytes) that are large and new to their session."""
    new = reads.join(seen.select("session_id", "file").distinct(), ["session_id", "file"], "left_anti")
    return new.withColumn("tokens", F.floor(F.col("bytes") / 4)).where(F.col("tokens") > tokens)


def collisions(names: DataFrame, key: Column) -> DataFrame:
    return names.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def content_hash(parts: DataFrame) -> DataFrame:
    """SHA-256 over the parts (id, seq, part) of an item in order, with a zero byte between."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "\0")
    return parts.groupBy("id").agg(F.sha2(joined, 256).alias("sha256"))
