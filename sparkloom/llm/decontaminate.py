"""Benchmark decontamination by greedy string tiling.

Texts and test items are sequences of normal words. Shared five-word shingles are the seeds that join a document with an
item. For a pair, running Karp-Rabin matching finds the longest match of at least five words between words not yet covered
(rolling hashes of all free windows of a length, which length by bisection), marks such matches as tiles, and goes on with
shorter ones; tiles may lie in any order, so a passage whose parts were moved is covered too. An item leaks if tiles cover
at least THRESHOLD of its words.

1. Items become rows of words and seeds. A bit filter of their seeds, of bounded size, is all that is sent to every task.
2. Documents are mapped over once: those with seeds that pass the filter become rows of these seeds and of the words
   under them, with a gap between stretches. Texts are not shuffled.
3. Seeds join documents with items; pairs whose seeds cannot cover enough are left out, the others get both sequences and
   are tiled. A seed or an item that many documents have is spread over tasks.

Defined cases: null text has no words; items of fewer than five words leak where they are a whole line of a text; items
without words never leak; null and repeated document ids are judged row by row; repeated items (same id and text) count
once; empty tables give no pairs and remove nothing; other columns are ignored by pairs and kept by the filter; texts of
any length are read whole, and tiling takes time in proportion to the words under seeds, however often words repeat.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bit_filter import BitFilter, filter_of, without
from sparkloom.llm.common import fresh, materialise, slices, spread_join, table, texts
from sparkloom.llm.wordhash import WordHash, hashed, shingles

SEED_WORDS = 5
THRESHOLD = 0.5
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
ITEMS = "item long, item_id long, n_items long, item_words binary, seeds array<long>"
HITS = "uid long, doc_id long, mark long, words binary, seeds array<long>"
PAIRS = "doc_id long, item_id long, item_words long, covered_words long, n_tiles long, coverage double"


class Rolling:
    """Karp-Rabin hashes, by 2^64, of the windows of a sequence of word hashes that are free."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        factor = np.cumprod(np.full(n, BASE, np.uint64)) if n else np.zeros(0, np.uint64)
        self.words, self.used = words, np.zeros(n, bool)
        self.undo = np.cumprod(np.full(n, INVERSE, np.uint64)) if n else factor
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * factor)])

    def free(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the free windows of a length, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(taken[length:] == taken[: len(taken) - length])
        return at, (self.sums[at + length] - self.sums[at]) * self.undo[at]


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of hashes: (item position, text position, length) of disjoint matches.

    The longest match of free words comes first; of equally long ones that at the least text position, then at the least
    item position. Hashes find matches, words decide.
    """
    a, b = Rolling(item), Rolling(text)
    found: list[tuple[int, int, int]] = []
    most = min(len(item), len(text))
    while most >= least:

        def matches(length: int) -> bool:
            return bool(np.isin(b.free(length)[1], a.free(length)[1]).any())

        if not matches(least):
            break
        # If windows of a length match, so do some of each lesser length.
        low, high = least, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if matches(middle) else (low, middle - 1)
        places, hashes = a.free(low)
        at, wanted = b.free(low)
        hit = np.flatnonzero(np.isin(wanted, hashes))
        by_hash: dict[int, deque] = {}
        for k in np.flatnonzero(np.isin(hashes, wanted)).tolist():
            by_hash.setdefault(int(hashes[k]), deque()).append(int(places[k]))
        beyond = 0
        for t, h in zip(at[hit].tolist(), wanted[hit].tolist()):
            if t < beyond:
                continue
            own = by_hash[h]
            while own and (a.used[own[0]] or a.used[own[0] + low - 1]):
                own.popleft()
            if own and np.array_equal(item[own[0] : own[0] + low], text[t : t + low]):
                p, beyond = own.popleft(), t + low
                a.used[p : p + low] = b.used[t:beyond] = True
                found.append((p, t, low))
        most = low - 1
    return found


def short_seed(words: np.ndarray) -> int:
    """Seed of a whole line of less than SEED_WORDS words."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(words.astype("<u8").tobytes(), len(words))


def longs(values: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit hashes as lists of longs."""
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32)), pa.array(flat))


def item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and seeds, with repeats, of test items."""
    known = WordHash()
    for batch in slices(batches, "text"):
        words, counts = hashed(texts(batch, "text"), known)
        rolled, n = shingles(words, counts, SEED_WORDS)
        own = np.split(words, np.cumsum(counts)[:-1])
        seeds = [x if k >= SEED_WORDS else np.array([short_seed(w)], np.uint64) for x, w, k in zip(np.split(rolled, np.cumsum(n)[:-1]), own, counts)]
        keep = np.flatnonzero(counts > 0).tolist()
        columns = [batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(counts[keep]), pa.array([own[k].tobytes() for k in keep], pa.binary()), longs([seeds[k] for k in keep])]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "n_items", "item_words", "seeds"])


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct test items with words, written once."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    return materialise(rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").mapInArrow(item_batches, ITEMS))


def stretches(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The words under the seeds that start at `at`, with a zero between stretches."""
    covered = np.zeros(len(words) + 1, bool)
    for k in range(SEED_WORDS):
        covered[at + k] = True
    here = np.flatnonzero(covered)
    gap = np.flatnonzero(np.diff(here) > 1) + 1
    return np.insert(words[here], gap, np.uint64(0))


def finder(known_seeds: BitFilter, short: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents with seeds of items; `short`: there are items that a line may be."""

    def lines(text: bytes, known: WordHash) -> np.ndarray:
        rows = [r for r in text.split(b"\n") if r and len(r.split()) < 4 * SEED_WORDS]
        words, counts = hashed(rows, known)
        own = [w for w in np.split(words, np.cumsum(counts)[:-1]) if 0 < len(w) < SEED_WORDS] if rows else []
        return np.array(sorted({short_seed(w) for w in own}), np.uint64)

    def hit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 40
        for batch in slices(batches, "text"):
            rows = texts(batch, "text")
            words, counts = hashed(rows, known)
            rolled, n = shingles(words, counts, SEED_WORDS)
            hits = np.flatnonzero(known_seeds.passes(rolled))
            first_word, first_seed = np.cumsum(counts) - counts, np.cumsum(n) - n
            of = np.searchsorted(first_seed + n, hits, "right")
            extra = {r: x for r, text in enumerate(rows) if short and len(x := (s := lines(text, known))[known_seeds.passes(s)])}
            found: list[tuple[int, bytes, np.ndarray]] = []
            for r in sorted({*of.tolist(), *extra}):
                own = hits[np.searchsorted(of, r) : np.searchsorted(of, r, "right")]
                here = stretches(words[first_word[r] : first_word[r] + counts[r]], own - first_seed[r])
                found.append((r, here.tobytes(), np.unique(np.concatenate([rolled[own], extra.get(r, own[:0].astype(np.uint64))]))))
            pick = pa.array([r for r, *_ in found], pa.int64())
            ids = [batch.column(batch.schema.get_field_index(c)).take(pick) for c in ("doc_id", "mark")]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(found))), *ids, pa.array([w for _, w, _ in found], pa.binary()), longs([s for *_, s in found])], names=["uid", "doc_id", "mark", "words", "seeds"])
            uid += len(found)

    return hit_batches


def tiler(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def tile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaks among pairs (mark, doc_id, item_id, words, item_words)."""
        for batch in batches:
            kept, n_words, covered, counts = [], [], [], []
            for k, (text, item) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                item = np.frombuffer(item, np.uint64)
                made = tiles(item, np.frombuffer(text, np.uint64)) if len(item) >= SEED_WORDS else [(0, 0, len(item))]
                total = sum(n for *_, n in made)
                if total >= threshold * len(item):
                    kept.append(k)
                    n_words.append(len(item))
                    covered.append(total)
                    counts.append(len(made))
            pick = pa.array(kept, pa.int64())
            share = pa.array([c / n for c, n in zip(covered, n_words)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pick) for k in range(3)), *(pa.array(x, pa.int64()) for x in (n_words, covered, counts)), share], names=["mark", "doc_id", "item_id", "item_words", "covered_words", "n_tiles", "coverage"])

    return tile_batches


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """Leaks, with a hash of the document's row."""
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    items = items_of(benchmark)
    short = not items.where(F.col("n_items") < SEED_WORDS).isEmpty()
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("mark"), text.alias("text"))
    hits = materialise(rows.mapInArrow(finder(filter_of(items.select(F.explode("seeds"))), short), HITS))
    by_seed = items.select("item", "n_items", F.explode("seeds").alias("seed")).groupBy("seed", "item", "n_items").agg(F.count("*").alias("times"))
    joined = spread_join(hits.select("uid", F.explode("seeds").alias("seed")), "seed", "uid", by_seed)
    # Each time a seed is in the item it can bring SEED_WORDS words under tiles.
    likely = joined.groupBy("uid", "item", "n_items").agg(F.sum("times").alias("times")).where(F.col("times") * SEED_WORDS >= threshold * F.col("n_items"))
    likely = materialise(likely.select("uid", "item"))
    pairs = spread_join(likely, "item", "uid", items.select("item", "item_id", "item_words")).join(hits.drop("seeds"), "uid")
    return pairs.select("mark", "doc_id", "item_id", "words", "item_words").mapInArrow(tiler(threshold), "mark long, " + PAIRS)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles, coverage) of every leak."""
    return leaks(docs, benchmark, threshold).drop("mark")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no leak."""
    mark = fresh(docs.columns, "mark")
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    gone = materialise(leaks(docs, benchmark, threshold).select(F.col("mark").alias(mark)).distinct())
    return without(docs.withColumn(mark, F.xxhash64(doc_id, text)), mark, gone).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all test items in all documents."""
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
