"""Source code: function spans, measures of functions, and import lists by language.

Only finding where a function ends needs Python (Arrow batches in, spans out); measures and imports are native.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import complexity

# How functions begin, and names that only look like functions.
PLAIN_FUNCTION = r"(?:pub\s+)?(?:async\s+)?(?:fn|func|def|function)\s+(\w+)\s*\(([^)]*)\)|(?:defp?\s+)(\w+)\s*\(([^)]*)\)"
MEMBER_FUNCTION = r"^\s*(?:public|private|internal|protected)\s+(?:(?:static|virtual|override|abstract|async|sealed|new)\s+)*(?:[\w<>\[\]?,]+\s+)(\w+)\s*\(([^)]*)\)"
NOT_FUNCTIONS = ("class", "struct", "interface", "record", "enum", "namespace", "if", "for", "while", "switch", "catch", "return")
SPANS = "doc long, name string, start_line int, end_line int, params int, source string"


def end_of_block(lines: list[str], start: int) -> int:
    """Index of the line that closes the first brace opened from `start`; without braces, of the last line before one indented no deeper; else of the last line."""
    depth, opened = 0, False
    for k in range(start, len(lines)):
        for mark in re.findall(r"[{}]", lines[k]):
            depth += 1 if mark == "{" else -1
            opened = opened or mark == "{"
            if opened and mark == "}" and depth == 0:
                return k
    if not opened:
        base = len(lines[start]) - len(lines[start].lstrip())
        for k in range(start + 1, len(lines)):
            if lines[k].strip() and len(lines[k]) - len(lines[k].strip()) <= base:
                return max(0, k - 1)
    return max(0, len(lines) - 1)


def span_batches(skip_bodies: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, member = re.compile(PLAIN_FUNCTION), re.compile(MEMBER_FUNCTION)
        kinds = [("doc", pa.int64()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("params", pa.int32()), ("source", pa.string())]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = (text or "").split("\n")
                lines = [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]
                free = 0
                for k, line in enumerate(lines):
                    if k < free:
                        continue
                    if m := plain.search(line):
                        name, params = m[1] or m[3], m[2] if m[1] else m[4]
                    elif (m := member.search(line)) and m[1] not in NOT_FUNCTIONS:
                        name, params = m[1], m[2]
                    else:
                        continue
                    end = end_of_block(lines, k)
                    free = end + 1 if skip_bodies else 0
                    rows.append((doc, name, k + 1, end + 1, len(params.split(",")) if params.strip() else 0, "\n".join(lines[k : end + 1])))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], schema=pa.schema(kinds))

    return run


def functions(files: DataFrame, skip_bodies: bool = False) -> DataFrame:
    """Functions of source texts (doc, text); `skip_bodies`: those inside another are left out."""
    return files.select(F.col("doc").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(span_batches(skip_bodies), SPANS)


def nesting(source: Column) -> Column:
    """Deepest brace level."""
    marks = F.split(F.regexp_replace(source, "[^{}]", ""), "")
    step = lambda a, c: F.when(c == "{", F.struct((a["now"] + 1).alias("now"), F.greatest(a["top"], a["now"] + 1).alias("top"))).when(c == "}", F.struct(F.greatest(F.lit(0), a["now"] - 1).alias("now"), a["top"].alias("top"))).otherwise(a)
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), step, lambda a: a["top"])


def smells(spans: DataFrame, lines: int = 60, cc: int = 15, depth: int = 4, params: int = 5) -> DataFrame:
    """(doc, name, start_line, smell, value) of functions over a limit."""
    measured = spans.select("doc", "name", "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), complexity(F.col("source")).alias("cc"), nesting(F.col("source")).alias("depth"), "params")
    found = F.array_compact(F.array(*(F.when(F.col(c) > limit, F.struct(F.lit(name).alias("smell"), F.col(c).alias("value"))) for name, c, limit in (("long_function", "lines", lines), ("complex_function", "cc", cc), ("deep_nesting", "depth", depth), ("many_parameters", "params", params)))))
    return measured.select("doc", "name", "start_line", F.explode(found).alias("s")).select("doc", "name", "start_line", "s.*")


def keyword_sets(spans: DataFrame, words: dict[str, tuple[str, ...]]) -> DataFrame:
    """Functions with the categories and words of `words` that their code, comment lines aside, holds."""
    code = F.lower(F.array_join(F.filter(F.split("source", "\n"), lambda x: ~x.rlike(r"^\s*(//|#|%|--)")), "\n"))
    rows = spans.withColumn("code", code)
    hit = F.array_compact(F.array(*(F.when(F.col("code").contains(w), F.struct(F.lit(c).alias("category"), F.lit(w).alias("word"))) for c, ws in words.items() for w in ws)))
    rows = rows.withColumn("hits", hit).where(F.size("hits") > 0)
    return rows.select("doc", "name", "start_line", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["category"]))).alias("categories"), F.array_sort(F.transform("hits", lambda h: h["word"])).alias("words"))


# What a dependency looks like in a line.
IMPORTS = {
    "elixir": r"^\s*(?:use|import|alias)\s+([\w.]+)",
    "rust": r"^\s*use\s+(?:crate|super)::([\w:]+)",
    "go": r"""^\s*(?:import\s+)?"([^"]+)\"""",
    "typescript": r"""(?:import|from)\s+['"](\./[^'"]+|\.\./[^'"]+)['"]""",
    "java": r"^import\s+([\w.]+);",
    "python": r"^from\s+([\w.]+)\s+import|^import\s+([\w.,\s]+)",
}


def imports(lines: DataFrame, language: str) -> DataFrame:
    """Distinct dependencies of each document in order of appearance; several in one Python line are cut apart."""
    form = IMPORTS[language]
    found = F.regexp_extract("line", form, 1)
    if language == "python":
        found = F.when(found == "", F.regexp_extract("line", form, 2)).otherwise(found)
    names = F.transform(F.split(found, ","), lambda x: F.regexp_replace(F.trim(x), r"[:,]+\z", "")) if language == "python" else F.array(F.regexp_replace(found, r"(::|,)+\z", ""))
    rows = lines.where(F.col("line").rlike(form)).select("doc", "line_no", F.posexplode(names).alias("k", "dep")).where("dep <> ''")
    return rows.groupBy("doc", "dep").agg(F.min(F.struct("line_no", "k")).alias("at")).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "dep"))), lambda x: x["dep"]).alias("depends_on"))


def elixir_modules(lines: DataFrame) -> DataFrame:
    """Dependencies of each module: those after its head and before the next."""
    module = F.regexp_extract("line", r"defmodule\s+(\S+)", 1)
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    tagged = lines.withColumn("module", F.last(F.nullif(module, F.lit("")), ignorenulls=True).over(upto)).where((module == "") & F.col("module").isNotNull())
    named = tagged.select(F.struct("doc", "module").alias("doc"), "line_no", "line")
    return imports(named, "elixir").select("doc.doc", F.rtrim(F.col("doc.module")).alias("module"), "depends_on")


def documented(lines: DataFrame, declaration: str, comment: str, between: str) -> DataFrame:
    """Declarations by line and whether the nearest line before them that is not `between` is a comment."""
    before = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(~F.col("line").rlike(between), F.col("line")), ignorenulls=True).over(before)
    return lines.withColumn("near", near).where(F.col("line").rlike(declaration)).select("doc", "line_no", F.regexp_extract("line", declaration, 1).alias("name"), F.coalesce(F.col("near").rlike(comment), F.lit(False)).alias("documented"))


def prompts(lines: DataFrame, words: tuple[str, ...], least_lines: int = 5, least_words: int = 2) -> DataFrame:
    """Blocks between triple quotes of at least `least_lines` lines that hold at least `least_words` of some words."""
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    quote = F.col("line").contains('\"\"\"') | F.col("line").contains("'''")
    rows = lines.withColumn("block", F.sum(quote.cast("int")).over(upto)).where(F.col("block") % 2 == 1)
    body = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"))
    blocks = rows.groupBy("doc", "block").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"), body.alias("body"))
    hits = sum((F.col("body").contains(w).cast("int") for w in words), F.lit(0))
    return blocks.where(F.col("n") >= least_lines).withColumn("hits", hits).where(F.col("hits") >= least_words).select("doc", "line_no", "n", "hits")
