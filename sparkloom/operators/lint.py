"""Lint output grouped by rule, and diffs filtered by file, on whole texts (doc, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import explode_lines, trim

# The message form is matched as short as it can be, so only its first character is kept and the file stays unknown.
COMPILER = r"(?m)^(warning|error)(?:\[([A-Za-z0-9_:]+)\])?: (.+?)(?:\n\s*--> (.+?):[0-9]+:[0-9]+)?"
COLON = r"(?m)^(.+?):([0-9]+):(?:[0-9]+:)?\s*([A-Z][0-9]{3,4})\s+(.+)$"
BRACKET = r"(?m)^(.+\.cs)\(([0-9]+),[0-9]+\):\s+(error|warning)\s+([A-Z]+[0-9]+):\s+(.+)$"
COLUMNS = r"^\s+[0-9]+:[0-9]+\s+(error|warning)\s+(.+?)\s{2,}([\w/-]+)\s*\z"
HEADER = r"^(/?\S+\.\w+)\s*\z"

# Files whose changes are generated.
GENERATED = (".lock", "package-lock.json", ".generated.*", ".snap", "yarn.lock", "Cargo.lock", "poetry.lock", "go.sum")


def parts(form: str, **groups: int | str) -> Column:
    """Array of entries of a line form: each field a group number, or a constant."""
    numbers = [k for k, v in groups.items() if isinstance(v, int)]
    zipped = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(form), F.lit(groups[k])).alias(k) for k in numbers))
    return F.transform(zipped, lambda e: F.struct(*((e[k] if k in numbers else F.lit(v)).alias(k) for k, v in groups.items())))


def entries(texts: DataFrame) -> DataFrame:
    """(doc, seq, file, rule, severity, message) of all lint lines of four formats; the column format only where it is named or no other was found."""
    plain = F.concat(
        F.transform(parts(COMPILER, file="unknown", rule=2, severity=1, message=3), lambda e: F.struct(e["file"].alias("file"), F.when(e["rule"] == "", "unknown").otherwise(e["rule"]).alias("rule"), e["severity"].alias("severity"), trim(e["message"]).alias("message"))),
        parts(COLON, file=1, rule=3, severity="warning", message=4),
        parts(BRACKET, file=1, rule=4, severity=3, message=5),
    )
    found = texts.select("doc", "text", plain.alias("plain"))
    first = found.select("doc", F.posexplode("plain").alias("seq", "e")).select("doc", "seq", "e.*")
    rest = explode_lines(found.where(F.col("text").contains("eslint") | (F.size("plain") == 0)), "doc")
    head = F.when(F.col("line").rlike(HEADER), F.regexp_extract("line", HEADER, 1))
    carried = rest.withColumn("file", F.coalesce(F.last(head, ignorenulls=True).over(Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    table = carried.where(F.col("line").rlike(COLUMNS) & ~F.col("line").rlike(HEADER))
    second = table.select("doc", (F.col("line_no") + 1_000_000).alias("seq"), "file", F.regexp_extract("line", COLUMNS, 3).alias("rule"), F.regexp_extract("line", COLUMNS, 1).alias("severity"), trim(F.regexp_extract("line", COLUMNS, 2)).alias("message"))
    return first.unionByName(second)


def grouped(found: DataFrame) -> DataFrame:
    """Entries by rule and severity: the first message, how many, and their files in order of appearance."""
    files = found.groupBy("doc", "rule", "severity", "file").agg(F.min("seq").alias("seq"), F.min_by("message", "seq").alias("message"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "file"))), lambda x: x["file"])
    return files.groupBy("doc", "rule", "severity").agg(F.min_by("message", "seq").alias("message"), F.sum("n").alias("n"), ordered.alias("files"))


def diff_files(texts: DataFrame, skip: tuple[str, ...] = GENERATED, limit: int = 80) -> DataFrame:
    """Files of diffs: (doc, file_no, file, skipped, collapsed, output), hunks of more than `limit` lines replaced by a note.

    A file is skipped if its name ends in one of `skip`, or if all its changed lines are blank.
    """
    by_line = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = explode_lines(texts, "doc").withColumn("file_no", F.sum(F.col("line").startswith("diff --git").cast("int")).over(by_line))
    in_file = Window.partitionBy("doc", "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk", F.sum(F.col("line").rlike(r"^@@.*@@").cast("int")).over(in_file))
    plus = F.col("line").startswith("+") & ~F.col("line").startswith("+++")
    minus = F.col("line").startswith("-") & ~F.col("line").startswith("---")
    changed = (plus | minus) & (trim(F.substring("line", F.lit(2), F.length("line"))) != "")
    head = F.col("line").rlike(r"^@@.*@@")
    hunks = rows.groupBy("doc", "file_no", "hunk").agg(
        F.count_if(~head).alias("body"), F.count_if(plus).alias("added"), F.count_if(minus).alias("deleted"), F.bool_or(changed).alias("changed"),
        F.max(F.when(F.col("line").startswith("+++ b/"), F.substring("line", F.lit(7), F.length("line")))).alias("to"),
        F.max(F.nullif(F.regexp_extract("line", r"^diff --git a/\S+ b/(\S+)", 1), F.lit(""))).alias("named"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("output"),
    )
    large = (F.col("hunk") > 0) & (F.col("body") > limit)
    note = F.concat(F.lit("[+"), "added", F.lit("/-"), "deleted", F.lit(" lines, "), "body", F.lit(" total — collapsed]\n"))
    hunks = hunks.withColumns({"output": F.when(large, note).otherwise(F.col("output")), "large": large})
    files = hunks.groupBy("doc", "file_no").agg(F.coalesce(F.max("to"), F.max("named"), F.lit("")).alias("file"), F.bool_or("changed").alias("changed"), F.count_if(F.col("large")).alias("collapsed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", "output"))), lambda x: x["output"]), "").alias("output"))
    suffix = F.lit(False)
    for s in skip:
        suffix = suffix | F.col("file").endswith(s)
    return files.select("doc", "file_no", "file", (suffix | ~F.col("changed")).alias("skipped"), "collapsed", "output")
