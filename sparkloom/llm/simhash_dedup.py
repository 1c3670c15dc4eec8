"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less agree in two of three blocks of bits up to distance 2 once a block that holds one
of their differences is left out. So each distinct fingerprint emits, for each block left out, the rest and all variants
of it within half of that radius, one bit: 131 rows of which any linked pair shares one. Variants are shuffled and
sorted, equal ones form a group, and in a group links follow without looking at all pairs:

* equal left-out blocks: the rests differ in 2 bits at most, so the members form a class tied to its first;
* left-out blocks one bit apart: at most 3 bits in all, so the first members of both classes are linked, found by
  probing the group for each of the 22 possible flips;
* three differences in one block only: both rests are the variant itself; such members, which share over 40 bits, are
  compared by probing the three-bit flips of the block, or pairwise where a group has fewer members than flips.

Every other split of up to 3 differences over three blocks falls under the first two for some block left out. Found
pairs are verified by their distance. Links keep connectivity exactly: members of a class are all linked to one another.

Defined cases: null text counts as empty (fingerprint zero); null ids take part, and a component without any other id
has component null; repeated rows give a row each; an empty table gives no rows; other columns are ignored; texts of any
length are read whole, one at a time once they exceed a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.bit_filter import failing, filter_of, passing
from sparkloom.llm.common import fresh, materialise, slices, spread_join, table, texts
from sparkloom.llm.components import connected_components

RADIUS = 3
SEED = 42
#: First bit and number of bits of the three blocks.
BLOCKS = ((0, 22), (22, 21), (43, 21))
PAIRWISE = 48
NO_ID = 2**63 - 1


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of each 3-word shingle; of the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()
    if len(words) < 3:
        return [digest(b" ".join(words), SEED)] if words else []
    return [digest(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:]))]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of `counts` hashes: eight bits a pass, counted in byte lanes of up to 255."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    chunks = (n + 254) // 255
    chunk_first = np.cumsum(chunks) - chunks
    at = np.repeat(first, chunks) + 255 * (np.arange(int(chunks.sum())) - np.repeat(chunk_first, chunks))
    lanes = np.uint64(0x0101010101010101)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & lanes, at)
        by_byte = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), chunk_first, axis=0)
        for byte in range(8):
            out[full] |= (2 * by_byte[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def prints_of(batch: list[bytes]) -> np.ndarray:
    """Fingerprints of texts, as signed longs."""
    found = [shingle_hashes(t) for t in batch]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    hashes = np.fromiter((h for row in found for h in row), np.uint64, int(counts.sum()))
    return majority(hashes, counts).view(np.int64)


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints_of(texts(batch, "text")))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(fingerprint_batches, "doc_id long, fp long")


def grouped_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, doc_ids): the ids of equal fingerprints of a slice together, so that a fingerprint however frequent is a row a slice."""
    for batch in slices(batches, "text"):
        prints, of, counts = np.unique(prints_of(texts(batch, "text")), return_inverse=True, return_counts=True)
        ids = batch.column(0).take(pa.array(np.argsort(of, kind="stable")))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(prints), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=["fp", "doc_ids"])


def rests(prints: np.ndarray, block: int) -> np.ndarray:
    """The bits outside a block, moved together."""
    first, bits = BLOCKS[block]
    low = prints & np.uint64((1 << first) - 1)
    high = prints >> np.uint64(first + bits)
    return low | high << np.uint64(first)


def left_out(prints: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The bits of the block that each row leaves out."""
    first = np.array([b[0] for b in BLOCKS], np.uint64)[block]
    mask = np.array([(1 << b[1]) - 1 for b in BLOCKS], np.uint64)[block]
    return prints >> first & mask


def variant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp): for each block left out, the rest and the rest with each single bit flipped."""
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(prints), 20_000):
            part = prints[at : at + 20_000]
            for block, (_, bits) in enumerate(BLOCKS):
                flips = np.concatenate([[0], np.uint64(1) << np.arange(64 - bits, dtype=np.uint64)]).astype(np.uint64)
                keys = (rests(part, block)[:, None] ^ flips[None, :]) | np.uint64(block << 44)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["key", "fp"])


def probe(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into `wanted` and `known` (sorted) of equal values."""
    at = np.searchsorted(known, wanted)
    hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == wanted))
    return hit, at[hit]


def links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of whole groups, by the three cases above."""
    _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
    several = size[group] > 1
    keys, prints, group = keys[several], prints[several], group[several].astype(np.uint64)
    if not len(keys):
        return prints, prints
    block = (keys >> np.uint64(44)).astype(np.int64)
    at = group << np.uint64(22) | left_out(prints, block)
    order = np.lexsort((prints, at))
    keys, prints, block, at = keys[order], prints[order], block[order], at[order]
    head = np.ones(len(at), bool)
    head[1:] = at[1:] != at[:-1]
    first = prints[head][np.cumsum(head) - 1]
    left, right = [first[~head]], [prints[~head]]
    classes, of = at[head], prints[head]
    for bit in range(22):
        i, j = probe(classes, classes ^ np.uint64(1 << bit))
        up = classes[i] < classes[j]
        left.append(of[i[up]])
        right.append(of[j[up]])
    rest = np.choose(block, [rests(prints, b) for b in range(3)])
    middle = rest == (keys & np.uint64((1 << 44) - 1))
    at, prints = at[middle], prints[middle]
    _, member, size = np.unique(at >> np.uint64(22), return_inverse=True, return_counts=True)
    few = size[member] <= PAIRWISE
    small, of = at[few], prints[few]
    for step in range(1, min(PAIRWISE, int(size.max(initial=1)))):
        a, b = small[:-step], small[step:]
        same = np.flatnonzero((a >> np.uint64(22)) == (b >> np.uint64(22)))
        near = same[np.bitwise_count(a[same] ^ b[same]) == 3]
        left.append(of[near])
        right.append(of[near + step])
    large, of = at[~few], prints[~few]
    if len(large):
        for bits in combinations(range(22), 3):
            i, j = probe(large, large ^ np.uint64(sum(1 << b for b in bits)))
            up = large[i] < large[j]
            left.append(of[i[up]])
            right.append(of[j[up]])
    a, b = np.concatenate(left), np.concatenate(right)
    near = np.bitwise_count(a ^ b) <= RADIUS
    return a[near], b[near]


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted (key, fp) rows; a group that runs on into the next batch waits for it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def done(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = links(keys, prints)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        keys, prints = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        if not len(keys):
            continue
        if held and held[0][0][0] != keys[-1]:
            keys, prints = (np.concatenate([*(h[k] for h in held), x]) for k, x in enumerate((keys, prints)))
            held = []
        cut = 0 if held else int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield done(keys[:cut], prints[:cut])
        held.append((keys[cut:].copy(), prints[cut:].copy()))
    if held:
        yield done(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))


def linked(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to keep every component."""
    variants = distinct.select("fp").mapInArrow(variant_batches, "key long, fp long")
    ordered = variants.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(link_batches, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row of (doc_id, text).

    However many rows share a fingerprint, or fingerprints a component, joins back to them are spread over tasks.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(named.mapInArrow(grouped_batches, "fp long, doc_ids array<long>"))
    distinct = materialise(rows.groupBy("fp").agg(F.coalesce(F.min(F.array_min("doc_ids")), F.lit(NO_ID)).alias("node")))
    roots = connected_components(linked(distinct)).withColumnsRenamed({"id": "fp"})
    linked_prints = materialise(distinct.join(roots, "fp"))
    least = linked_prints.groupBy("root").agg(F.min("node").alias("component"))
    of = spread_join(linked_prints, "root", "fp", least).select("fp", "component")
    all_prints = materialise(distinct.join(of, "fp", "left").select("fp", F.coalesce("component", "node").alias("component")))
    dealt = rows.withColumn("by", F.xxhash64("doc_ids"))
    joined = spread_join(dealt, "fp", "by", all_prints).select("fp", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"), F.explode("doc_ids").alias("doc_id"))
    return joined.select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row with the least doc_id (null last; then the least hash of the row), with all columns; of rows equal throughout, one.

    A hash of all columns tells rows of one id apart, so no group of copies is gathered in one task.
    """
    key, mark = fresh(docs.columns, "key"), fresh(docs.columns, "mark")
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), mark: F.xxhash64(*docs.columns)})
    rows = materialise(keyed.select(F.col(key).alias("id"), F.col(mark).alias("mark"), F.col("text").cast("string").alias("text")).mapInArrow(row_prints, "id long, mark long, fp long"))
    distinct = materialise(rows.groupBy("fp").agg(F.min(F.struct("id", "mark")).alias("first")))
    roots = connected_components(linked(distinct)).withColumnsRenamed({"id": "fp"})
    least = materialise(distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")))
    stay = least.select(F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    # Rows that go, and those that stay in several equal copies, are few: only rows that may be among them are shuffled.
    doubtful = rows.groupBy("id", "mark").count().join(stay.withColumn("stays", F.lit(True)), ["id", "mark"], "left").where("stays is null or count > 1").select("mark")
    known = filter_of(materialise(doubtful))
    settled = passing(keyed, known, mark).join(stay.withColumnsRenamed({"id": key, "mark": mark}), [key, mark], "left_semi").dropDuplicates([key, mark])
    return failing(keyed, known, mark).select(*docs.columns).unionByName(settled.select(*docs.columns))


def row_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints_of(texts(batch, "text")))], names=["id", "mark", "fp"])


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
