"""Quality classifier: a weak-label model teaches a hashed linear scorer.

Overlapping heuristic labellers vote good or bad, or abstain, on every document. Expectation-maximisation over the counts
of vote patterns of all documents estimates their accuracies (weak_labels); the posterior of a document's votes is its
label. Logistic regression on hashed words, word shapes and repeated words is fitted to the posteriors of a bounded sample: the
SAMPLE_ROWS documents with the least hashes, the same rule at every size, DIMENSIONS weights. The scorer then judges all.

Vote patterns (3 to the number of labellers) and the sample are all that reaches the driver; scoring is a map over rows.

Defined cases: null text has no words, gets the scorer's intercept and is rejected; null and repeated ids are judged row
by row (a repeated row counts once in the sample); an empty table gives no rows; the filter keeps all columns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, slices, table, texts
from sparkloom.llm.weak_labels import decode, encode, fit
from sparkloom.llm.wordhash import REMEMBERED, normal

SAMPLE_ROWS = 2048
DIMENSIONS = 1 << 15
#: The last position; words and shapes are hashed to those before.
REPEAT = DIMENSIONS - 1
KEEP_AT = 0.5
STEPS, RATE, PENALTY = 300, 0.5, 1e-4
#: Words of no weight that every text is taken to have: a few words say little.
SMOOTH = 10
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
ODD = b"#*$%&|<>{}[]~^=\\_@+"
DIGITS = b"0123456789"
BLANKS = b" \t\n\r\x0b\x0c"


def ratio_vote(part: float, whole: float, bad_above: float, good_below: float) -> int:
    """Bad above one share, good at or below the other, else nothing."""
    if not whole:
        return 0
    share = part / whole
    return -1 if share > bad_above else 1 if share <= good_below else 0


def votes(text: bytes) -> tuple[int, ...]:
    """The labellers' votes.

    By symbols a word, words with symbols, symbols a character; capitals, words in capitals, exclamations; equal
    neighbours, repeated three-word windows, repeated lines; sentence ends; digits.
    """
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, BLANKS))
    plain = text.translate(None, ODD)
    symbols = len(text) - len(plain)
    upper, lower = len(text) - len(text.translate(None, UPPER)), len(text) - len(text.translate(None, LOWER))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    ends = text.count(b".") + text.count(b"!") + text.count(b"?")
    windows = max(0, n - 2)
    return (
        ratio_vote(symbols, n, 0.2, 0.02),
        ratio_vote(len(SYMBOL_WORD.findall(text)) if symbols else 0, n, 0.15, 0.02),
        ratio_vote(symbols, chars, 0.05, 0.01),
        ratio_vote(upper, upper + lower, 0.5, 0.2),
        ratio_vote(sum(map(bytes.isupper, words)), n, 0.4, 0.1),
        ratio_vote(text.count(b"!"), n, 0.2, 0.02),
        0 if n < 10 else ratio_vote(sum(map(bytes.__eq__, words, words[1:])), n, 0.15, 0.02),
        0 if n < 10 else ratio_vote(windows - len(set(zip(words, words[1:], words[2:]))), windows, 0.3, 0.05),
        0 if len(lines) < 4 else ratio_vote(len(lines) - len(set(lines)), len(lines), 0.3, 0.05),
        0 if n < 30 else 1 if 0.03 <= ends / n <= 0.5 else -1 if ends / n < 0.005 or ends > n else 0,
        ratio_vote(len(text) - len(text.translate(None, DIGITS)), chars, 0.4, 0.1),
    )


SYMBOL_WORD = re.compile(rb"[^\s#*$%&|<>{}\[\]~^=\\_@+]*[#*$%&|<>{}\[\]~^=\\_@+]\S*")
VOTERS = 11
SHAPES = [(re.compile(p), s) for p, s in ((rb"[A-Z]", b"A"), (rb"[a-z\x80-\xff]", b"a"), (rb"[0-9]", b"0"), (rb"(.)\1+", rb"\1"))]


def shape(word: bytes) -> bytes:
    """Classes of characters in runs: `Thatedhe!!` is `Aa!`."""
    for pattern, to in SHAPES:
        word = pattern.sub(to, word)
    return word


def features(word: bytes) -> tuple[int, int]:
    """Hashed positions of a word's normal form and of its shape."""
    from xxhash import xxh32_intdigest

    return xxh32_intdigest(b"w" + normal(word.decode("utf-8", "replace")).encode()) % REPEAT, xxh32_intdigest(b"s" + shape(word)) % REPEAT


def repeats(words: list[bytes]) -> int:
    """Words equal to the one before: a feature of its own, at position REPEAT."""
    return sum(map(bytes.__eq__, words, words[1:]))


def vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(votes(t)) for t in texts(batch, "text")], pa.int32())], names=["h", "code"])


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vote code, and mean features as packed positions and shares."""
    for batch in slices(batches, "text"):
        rows = []
        for text in texts(batch, "text"):
            words = text.split()
            found = np.array([features(w) for w in words], np.int32).ravel()
            at, n = np.unique(np.append(found, np.full(repeats(words), REPEAT, np.int32)), return_counts=True)
            rows.append((encode(votes(text)), at.astype("<i4").tobytes(), (n / (len(words) + SMOOTH)).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["code", "at", "share"])


def train(rows: list[tuple[bytes, bytes, float]]) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression on (positions, shares, label): gradient steps with momentum."""
    weights, bias = np.zeros(DIMENSIONS), 0.0
    if not rows:
        return weights, bias
    at = [np.frombuffer(r[0], "<i4") for r in rows]
    of = np.repeat(np.arange(len(rows)), [len(x) for x in at])
    at, share = np.concatenate(at), np.concatenate([np.frombuffer(r[1], "<f4") for r in rows]).astype(float)
    label = np.array([r[2] for r in rows])
    speed, push = np.zeros(DIMENSIONS), 0.0
    for _ in range(STEPS):
        z = bias + np.bincount(of, share * weights[at], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - label
        speed = 0.9 * speed - RATE * (np.bincount(at, share * error[of], DIMENSIONS) / len(rows) * 20 + PENALTY * weights)
        push = 0.9 * push - RATE * error.mean()
        weights, bias = weights + speed, bias + push
    return weights, bias


class Scores(dict):
    """Word to the sum of its weights."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights
        self.repeat = float(weights[REPEAT])

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        a, b = features(word)
        found = self[word] = float(self.weights[a]) + float(self.weights[b])
        return found


def score(text: bytes, known: Scores, bias: float) -> float:
    """Probability of quality; that of a text without words is zero."""
    words = text.split()
    if not words:
        return 0.0
    z = bias + (sum(map(known.__getitem__, words)) + repeats(words) * known.repeat) / (len(words) + SMOOTH)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def score_batches(weights: np.ndarray, bias: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(weights)
        for batch in slices(batches, "text"):
            p = np.array([score(t, known, bias) for t in texts(batch, "text")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(p >= KEEP_AT)], names=["doc_id", "score", "kept"])

    return run


def keep_batches(weights: np.ndarray, bias: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(weights)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array([score(t, known, bias) >= KEEP_AT for t in texts(batch, "text")], pa.bool_()))

    return run


def fit_scorer(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept from the labellers' votes on all rows of (doc_id, text)."""
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))
    voted = materialise(rows.mapInArrow(vote_batches, "h long, code int"))
    model = fit({decode(r["code"], VOTERS): r["count"] for r in voted.groupBy("code").count().collect()}, VOTERS)
    last = voted.select("h").distinct().orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if last is None:
        return train([])
    sample = rows.where(F.col("h") <= last).groupBy("h").agg(F.first("text").alias("text")).select("text")
    found = sample.mapInArrow(feature_batches, "code int, at binary, share binary").collect()
    return train(sorted((bytes(r["at"]), bytes(r["share"]), model.posterior(decode(r["code"], VOTERS))) for r in found))


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, score, kept) of each row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score_batches(*fit_scorer(docs)), "doc_id long, score double, kept boolean")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that the scorer keeps."""
    return docs.mapInArrow(keep_batches(*fit_scorer(docs)), docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"))
