"""Checks of diagram texts (doc, text), papers to graphs, and tool output cut to what matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import explode_lines, lines, trim, uuid5

# Kinds of diagrams.
TYPES = ("graph", "flowchart", "sequenceDiagram", "stateDiagram", "stateDiagram-v2", "classDiagram", "erDiagram", "gantt", "pie", "journey", "gitGraph", "mindmap", "timeline", "quadrantChart", "requirementDiagram", "C4Context", "C4Container", "C4Component", "C4Dynamic")
EDGE = r"(\S+)\s*(?:-->|---|-\.->|==>|===)\s*(\S+)"
MESSAGE = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*(?:->>|-->>|->|-->|-x|--x|-\))\s*([A-Za-z_][A-Za-z0-9_]*)"
DECLARED = r"^\s*(?:participant|actor)\s+([A-Za-z_][A-Za-z0-9_]*)"


def kind(text: Column) -> Column:
    """First word of the first line that is neither blank, comment nor fence; null without one."""
    real = F.filter(F.transform(lines(text), trim), lambda x: (x != "") & ~x.startswith("%%") & ~x.startswith("```"))
    return F.regexp_extract(F.get(real, 0), r"^\S+", 0)


def balanced(text: Column) -> Column:
    """Whether brackets close in order; quoted parts, which end with their line, and comments do not count."""
    plain = F.transform(F.filter(lines(text), lambda x: ~x.rlike(r"^\s*%%")), lambda x: F.regexp_replace(F.regexp_replace(x, r""""[^"]*("|\z)|'[^']*('|\z)""", ""), r"[^()\[\]{}]", ""))
    opener = lambda c: F.translate(c, ")]}", "([{")

    def step(stack: Column, c: Column) -> Column:
        top = F.right(stack, F.lit(1))
        return F.when(stack == "!", stack).when(c.isin("(", "[", "{"), F.concat(stack, c)).when(top == opener(c), F.left(stack, F.length(stack) - 1)).otherwise("!")

    marks = F.filter(F.split(F.array_join(plain, ""), ""), lambda c: c != "")
    return F.aggregate(marks, F.lit(""), step) == ""


def issues(diagrams: DataFrame) -> DataFrame:
    """(doc, line_no, code) of everything wrong; whole texts have line 0."""
    typed = diagrams.withColumn("kind", kind(F.col("text")))
    whole = F.array_compact(F.array(F.when(~F.coalesce(F.col("kind").isin(*TYPES), F.lit(False)), "UNKNOWN_TYPE"), F.when(~balanced(F.col("text")), "UNBALANCED_BRACKET"), F.when(F.col("text").contains("```"), "FENCE")))
    out = typed.select("doc", F.lit(0).alias("line_no"), F.explode(whole).alias("code"))
    rows = explode_lines(typed.select("doc", "text"), "doc").join(typed.select("doc", "kind"), "doc")
    line, code = F.col("line"), ~F.col("line").rlike(r"^\s*(%%.*)?\z")
    flow = F.col("kind").isin("graph", "flowchart")
    ids = F.flatten(F.transform(F.array(F.lit(1), F.lit(2)), lambda g: F.when(g == 1, F.regexp_extract_all(line, F.lit(EDGE), F.lit(1))).otherwise(F.regexp_extract_all(line, F.lit(EDGE), F.lit(2)))))
    bad_id = F.exists(ids, lambda x: x.rlike(r"^[0-9]")) & ~trim(line).rlike(r"^(subgraph|end)")
    by_line = F.array_compact(F.array(
        F.when(flow & code & (line.rlike(r"[A-Za-z0-9_\])]->[A-Za-z0-9_\[(]") | line.rlike("-{4,}>")), "BAD_EDGE_SYNTAX"),
        F.when(flow & code & bad_id, "BAD_NODE_ID"),
        F.when(line.rlike(r"(-->|---)\s*\z"), "UNTERMINATED_EDGE"),
    ))
    out = out.unionByName(rows.select("doc", "line_no", F.explode(by_line).alias("code")))
    declared = rows.where(line.rlike(DECLARED)).select("doc", F.regexp_extract("line", DECLARED, 1).alias("name")).distinct()
    said = rows.where((F.col("kind") == "sequenceDiagram") & line.rlike(MESSAGE) & ~trim(line).rlike("^(participant|actor|%%)")).select("doc", "line_no", F.explode(F.array(F.regexp_extract("line", MESSAGE, 1), F.regexp_extract("line", MESSAGE, 2))).alias("name"))
    unknown = said.join(declared.select("doc").distinct(), "doc", "left_semi").join(declared, ["doc", "name"], "left_anti")
    return out.unionByName(unknown.select("doc", "line_no", F.lit("UNKNOWN_PARTICIPANT").alias("code")))


def tool_lines(texts: DataFrame, form: str = r"(?i)error|warning", keep: int = 20) -> DataFrame:
    """The first `keep` lines of each output that fit a form; an output is one text and is not sorted again."""
    numbered = F.transform(lines(F.col("text")), lambda line, at: F.struct((at + 1).alias("line_no"), line.alias("line")))
    return texts.select("doc", F.inline(F.slice(F.filter(numbered, lambda x: x["line"].rlike(form)), 1, keep)))


def paper_graph(papers: DataFrame, namespace: str) -> DataFrame:
    """Edges (src, dst, edge_type, weight) of papers (title, doi, arxiv_id, authors, keywords, sections, references): writers, their affiliations, topics, sections, cited papers; each once."""
    made = lambda of, name: uuid5(namespace, F.concat(F.lit(of + "::"), name))
    paper = made("paper", F.coalesce("doi", "arxiv_id", "title"))
    rows = papers.withColumn("paper", paper)
    edge = lambda df, src, dst, kind_, w: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind_).alias("edge_type"), F.lit(w).alias("weight"))
    by = rows.select("paper", F.explode("authors").alias("a"))
    wrote = edge(by, made("person", F.col("a.name")), F.col("paper"), "wrote", 1.0)
    at = edge(by.where("a.affiliation is not null"), made("person", F.col("a.name")), made("org", F.col("a.affiliation")), "affiliated_with", 1.0)
    topics = edge(rows.select("paper", F.explode("keywords").alias("k")), F.col("paper"), made("concept", F.lower("k")), "discusses", 0.8)
    parts = edge(rows.select("paper", F.explode("sections").alias("s")), F.col("paper"), made("section", F.concat_ws("::", "paper", "s")), "contains", 1.0)
    cited = edge(rows.select("paper", F.explode("references").alias("r")), F.col("paper"), made("paper", F.coalesce("r.doi", "r.title")), "references", 0.5)
    return wrote.unionByName(at).unionByName(topics).unionByName(parts).unionByName(cited).distinct()
