"""Quality rules as weak supervision, in DataFrame functions only.

Nine rules vote good or bad, or abstain. Vote patterns are counted over all documents, expectation-maximisation over
the (at most 3 to the 9) pattern counts gives each rule's accuracy, and the posterior probability of quality, a sum of
log-odds that stays a native expression, decides instead of all rules having to pass. Documents that fail the base
(under 50 words, or more than half of the words in repeated 3-word windows) are never kept.

The statistics of a document are computed once and written to the shared folder; there is no shuffle but the one of the
pattern counts.

Defined cases: null text has no words and is not kept; null and repeated ids are judged row by row; an empty table gives
no rows; columns other than doc_id and text are ignored; texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, table
from sparkloom.llm.weak_labels import LabelModel, decode, fit

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
KEEP_AT = 0.5


def without(text: Column, chars: str) -> Column:
    """Number of code points that are one of `chars`."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of each row of (doc_id, text)."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        without(text, SYMBOLS).cast("long").alias("n_symbols"),
        without(text, UPPER).cast("long").alias("n_upper"),
        without(text, ".!?").cast("long").alias("n_ends"),
        without(text, "!").cast("long").alias("n_shouts"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.ltrim(F.translate(x, BLANKS, " "))) > 0).alias("lines"),
        F.filter(F.split(text, SPACE, -1), lambda x: x != "").alias("words"),
    )
    words = F.col("words")
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "n_upper", "n_ends", "n_shouts",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(words).cast("long").alias("n_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        F.when(F.col("n_symbols") == 0, 0).otherwise(F.size(F.filter(words, lambda x: x.rlike("[#*$%&|<>]")))).cast("long").alias("n_symbol_words"),
        "words",
        F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).alias("hashes"),
    )
    # Without two equal hashes no window repeats. Else windows are sorted by hash, so that equal ones become neighbours;
    # where different windows have one hash, by their words.
    hashes = F.col("hashes")
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*[c for c in rows.columns if c != "hashes"], F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), by_hash).alias("windows"))
    word = lambda i, k: F.get(words, i + k)
    equal = lambda i, j: (word(i, 0) == word(j, 0)) & (word(i, 1) == word(j, 1)) & (word(i, 2) == word(j, 2))

    def neighbours(windows: Column, same: Callable[[Column, Column], Column]) -> Column:
        near = lambda x, j: F.coalesce(same(x, F.get(windows, j)), F.lit(False))
        return F.filter(windows, lambda x, j: near(x, j + 1) | near(x, j - 1))

    windows = F.col("windows")
    clash = F.exists(F.sequence(F.lit(0), F.size(windows) - 2), lambda j: (F.get(windows, j)["h"] == F.get(windows, j + 1)["h"]) & ~equal(F.get(windows, j)["i"], F.get(windows, j + 1)["i"]))
    by_words = F.sort_array(F.transform(windows, lambda x: F.struct(F.array(*(word(x["i"], k) for k in range(3))).alias("h"), x["i"].alias("i"))))
    rows = rows.withColumn("sorted", F.when(clash, by_words))
    again = F.when(F.col("sorted").isNotNull(), F.transform(neighbours(F.col("sorted"), lambda x, y: x["h"] == y["h"]), lambda x: x["i"])).otherwise(F.transform(neighbours(windows, lambda x, y: x["h"] == y["h"]), lambda x: x["i"]))
    rows = rows.select(*[c for c in rows.columns if c not in ("words", "windows", "sorted")], F.sort_array(again).alias("starts"))
    covered = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"].cast("long"))
    return rows.select(*[c for c in rows.columns if c != "starts"], F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> list[Column]:
    """Votes on the statistics; all abstain on a text without words."""
    n, lines, chars = F.col("n_words"), F.col("n_lines"), F.col("word_chars")
    votes = [
        vote(F.col("n_symbols") * 5 > n, F.col("n_symbols") * 50 <= n),
        vote(F.col("n_symbols") * 25 > chars, F.col("n_symbols") * 100 <= chars),
        vote(F.col("n_symbol_words") * 6 > n, F.col("n_symbol_words") * 50 <= n),
        vote(F.col("n_dup_lines") * 2 > lines, F.col("n_dup_lines") * 20 <= lines),
        vote(F.col("n_repeat_words") * 3 > n, F.col("n_repeat_words") * 20 <= n),
        vote(F.col("n_distinct_words") * 6 < n, F.col("n_distinct_words") * 3 >= n),
        vote(F.col("n_upper") * 4 > chars, F.col("n_upper") * 10 <= chars),
        vote((F.col("n_ends") * 200 < n) | (F.col("n_ends") > n), (F.col("n_ends") * 33 >= n) & (F.col("n_ends") * 2 <= n)),
        vote(F.col("n_shouts") * 5 > n, F.col("n_shouts") * 100 <= n),
    ]
    return [F.when(n == 0, 0).otherwise(v) for v in votes]


def code(votes: list[Column]) -> Column:
    """Votes as one number in base three."""
    total = F.lit(0)
    for v in reversed(votes):
        total = total * 3 + v + 1
    return total


def log_odds(model: LabelModel, votes: list[Column]) -> Column:
    total = F.lit(model.bias)
    for weights, v in zip(model.weights, votes):
        total = total + F.when(v == 1, weights[1]).when(v == -1, weights[-1]).otherwise(weights[0])
    return total


def judge_quality(docs: DataFrame) -> DataFrame:
    """Statistics, base verdict, posterior probability and verdict of each row of (doc_id, text)."""
    rows = materialise(statistics(docs))
    votes = rules()
    counted = rows.groupBy(code(votes).alias("code")).count().collect()
    model = fit({decode(r["code"], len(votes)): r["count"] for r in counted}, len(votes))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (1 / (1 + F.exp(-log_odds(model, votes)))).alias("p_quality"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= KEEP_AT))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return judge_quality(table(spark, sf_dir, "documents"))
