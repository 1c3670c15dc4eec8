"""Markdown corpora, papers, descriptions: documents to sections, metadata and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import explode_lines, first_group, trim

# Signs that a model was led astray, and that it repeats its task.
ECHOES = ("write a one-sentence description", "use active voice, present tense", "max 60 words", "no code snippets")


def body(docs: DataFrame) -> DataFrame:
    """Lines of documents (doc, text) after a front matter between two --- lines, numbered anew."""
    lines = explode_lines(docs, "doc")
    rule = trim(F.col("line")) == "---"
    doc = Window.partitionBy("doc")
    marked = lines.withColumns({"opens": F.max(F.when((F.col("line_no") == 1) & rule, 1)).over(doc), "closes": F.min(F.when((F.col("line_no") > 1) & rule, F.col("line_no"))).over(doc)})
    skip = F.when((F.col("opens") == 1) & F.col("closes").isNotNull(), F.col("closes")).otherwise(0)
    return marked.where(F.col("line_no") > skip).select("doc", (F.col("line_no") - skip).cast("int").alias("line_no"), "line")


def metadata(lines: DataFrame) -> DataFrame:
    """(doc, title, author, year, publisher) of documents that begin with a title; the last value of the first 20 lines counts."""
    form = r"^\*\*(\w+):\*\*\s*(.*)\z"
    key = F.lower(F.regexp_extract("line", form, 1))
    value = lambda name: F.coalesce(F.max_by(F.when(key == name, trim(F.regexp_extract("line", form, 2))), F.when((key == name) & (F.col("line_no") <= 20), F.col("line_no"))), F.lit("")).alias(name)
    title = F.max(F.when((F.col("line_no") == 1) & F.col("line").startswith("# "), trim(F.substring("line", F.lit(3), F.length("line"))))).alias("title")
    return lines.groupBy("doc").agg(title, value("author"), value("year"), value("publisher")).where("title is not null")


def sections(lines: DataFrame) -> DataFrame:
    """(doc, pos, heading, content) of parts under second-level headings."""
    upto = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith("## ")
    rows = lines.withColumn("pos", F.sum(head.cast("int")).over(upto)).where("pos > 0")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("doc", "pos").agg(F.max(F.when(head, trim(F.substring("line", F.lit(4), F.length("line"))))).alias("heading"), trim(content).alias("content"))


def summary(parts: DataFrame) -> DataFrame:
    """The section that states the core thesis, else the first."""
    rank = F.struct((~F.lower("heading").contains("core thesis")).alias("other"), "pos")
    return parts.groupBy("doc").agg(F.min_by("heading", rank).alias("heading"), F.min_by("content", rank).alias("content"))


def chain(parts: DataFrame) -> DataFrame:
    """Edges of documents to their sections, and of sections to the next."""
    near = F.lead("pos").over(Window.partitionBy("doc").orderBy("pos"))
    holds = parts.select("doc", F.lit(0).alias("src"), F.col("pos").alias("dst"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"))
    return holds.unionByName(parts.select("doc", F.col("pos").alias("src"), near.alias("dst"), F.lit("related_to").alias("edge_type"), F.lit(0.9).alias("weight")).where("dst is not null"))


def mentions(parts: DataFrame, names: DataFrame) -> DataFrame:
    """Sections that mention known names (name) of at least four characters as whole words; words are joined by equality."""
    words = parts.select("doc", "pos", F.explode(F.array_distinct(F.split("content", r"[^A-Za-z0-9_]+"))).alias("name")).where(F.length("name") >= 4)
    return words.join(names.select("name").distinct(), "name").select("doc", "pos", "name")


def description(text: Column, words: int = 60) -> Column:
    """A description without control characters and with single blanks, cut to a number of words; null if empty or if it repeats its task."""
    low = F.lower(text)
    echo = F.lit(False)
    for e in ECHOES:
        echo = echo | low.contains(e)
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", ""), r"[\n\t ]+", " "))
    return F.when((trim(text) != "") & ~echo, F.array_join(F.slice(F.filter(F.split(clean, r"\s+"), lambda w: w != ""), 1, words), " "))


def author(name: Column) -> Column:
    """`Last, First` as `First Last`."""
    form = r"^\s*([^,]+),\s*(.+?)\s*\z"
    return F.when(name.rlike(form), F.concat(F.regexp_extract(name, form, 2), F.lit(" "), F.trim(F.regexp_extract(name, form, 1)))).otherwise(trim(name))


def paper_facts(text: Column) -> dict[str, Column]:
    """Year, DOI and arXiv id that a text names first."""
    return {"year": first_group(text, r"\b((?:19|20)[0-9]{2})\b").try_cast("int"), "doi": first_group(text, r"\b(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)"), "arxiv": first_group(text, r"(?i)arxiv:\s*([0-9]{4}\.[0-9]{4,5})")}


def chunks(items: DataFrame, max_bytes: int = 1_000_000, max_rows: int = 100) -> DataFrame:
    """Chunk number of items (batch, pos, bytes) filled in order, each chunk within both limits; an item over the limit is alone."""

    def fill(pdf):
        chunk, size, n, out = 0, 0, 0, []
        for b in pdf.sort_values("pos")["bytes"]:
            if n and (size + b > max_bytes or n == max_rows):
                chunk, size, n = chunk + 1, 0, 0
            size, n = size + b, n + 1
            out.append(chunk)
        return pdf.sort_values("pos").assign(chunk=out)[["batch", "pos", "chunk"]]

    return items.select("batch", "pos", "bytes").groupBy("batch").applyInPandas(fill, "batch long, pos long, chunk int")


def edge_chunks(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges with the later of their ends' chunks, from node chunks (id, chunk)."""
    return edges.join(placed.select(F.col("id").alias("src"), F.col("chunk").alias("a")), "src").join(placed.select(F.col("id").alias("dst"), F.col("chunk").alias("b")), "dst").select("src", "dst", F.greatest("a", "b").alias("chunk"))


def remapped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are given the ids (old, new) that a store returned; unknown ends stay."""
    one = edges.join(ids.select(F.col("old").alias("src"), F.col("new").alias("a")), "src", "left")
    both = one.join(ids.select(F.col("old").alias("dst"), F.col("new").alias("b")), "dst", "left")
    return both.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
