"""Near copies by Jaccard similarity of 5-word shingles: candidates by MinHash bands, each link verified on the texts.

The second step of the pipeline's stage of near copies. SimHash fingerprints of texts of similarity 0.8 lie about ten
bits apart, and no ball of that radius can be enumerated; so where fingerprints end, sets of shingles go on.

PERMUTATIONS minima of hashed shingles are a text's signature. BANDS bands of ROWS minima each make a key: two texts of
similarity 0.8 share one with probability 0.99997. With the key goes one bit of every minimum, from which the similarity of
two texts is estimated within 0.05.

In a group of equal keys the first text leads: those that may be similar to it (estimate of LOOSE or more, four
deviations below 0.8) are its candidates, and those that surely are (TIGHT) need no other leader; the rest goes on with the
next leader. Of all its leaders a text keeps the nearest, so a large group of copies gives a pair a member, not all
pairs. That is done in each slice of documents first: of a group, however large, a slice sends its leaders only.

Candidates are verified on whole texts. Then texts that had a candidate are put in groups again, now with their
components. Those that may be similar to one of another component bring their hashed shingles to the group, which compares
all such pairs itself and returns links that join components only, fewer than it has components: pairs are no rows.
These links are verified on whole texts, too.

Defined cases: null text counts as empty; a text of fewer than five words is one shingle of them all; rows equal
throughout count as one text; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.bit_filter import filter_of, passing, without
from sparkloom.llm.common import fresh, materialise, slices, spread_join, texts
from sparkloom.llm.components import connected_components
from sparkloom.llm.wordhash import MULTIPLIER, REMEMBERED, shingles

WORDS = 5
SEED = 42
BANDS, ROWS, PERMUTATIONS = 20, 4, 128
#: Bits of 128 that may differ: estimated similarity of 0.58 and of 0.87 at least.
LOOSE, TIGHT = 27, 8
NO_ID = 2**63 - 1
#: `other` is set in rows that are pairs already, with how many bits differ.
BAND = "key long, node long, s0 long, s1 long, other long, apart int"
ROOTED = "key long, node long, root long, s0 long, s1 long"
PAIR = "a long, b long, apart int"
FACTORS = np.random.default_rng(SEED).integers(1, 2**63, PERMUTATIONS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class Words(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxh64_intdigest(word, SEED)
        return found


def shingle_set(text: bytes) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[k : k + WORDS]) for k in range(max(len(words) - WORDS + 1, 1))}


def shingle_rows(batch: list[bytes], known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts, text by text, and how many each has (one at least)."""
    from xxhash import xxh64_intdigest

    words = [t.lower().split() for t in batch]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter((known[w] for row in words for w in row), np.uint64, int(counts.sum()))
    rolled, n = shingles(hashes, counts, WORDS)
    short = np.flatnonzero(counts < WORDS)
    whole = np.fromiter((xxh64_intdigest(b" ".join(words[k]), SEED) for k in short), np.uint64, len(short))
    return np.insert(rolled, (np.cumsum(n) - n)[short], whole), np.maximum(n, 1)


def signatures(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (a row a text) and the 128 bits, as two numbers, of consecutive runs of `counts` hashes."""
    first = np.cumsum(counts) - counts
    mixed = hashes ^ hashes >> np.uint64(31)
    keys, bits = np.zeros((len(counts), BANDS), np.uint64), np.zeros((len(counts), 2), np.uint64)
    for k in range(PERMUTATIONS):
        least = np.minimum.reduceat(mixed * FACTORS[k], first)
        bits[:, k // 64] |= (least >> np.uint64(20) & np.uint64(1)) << np.uint64(k % 64)
        if k < BANDS * ROWS:
            band = k // ROWS
            keys[:, band] = (keys[:, band] ^ least) * MULTIPLIER + np.uint64(band)
    return keys, bits


def candidates(node: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a group: rows (leader, member, bits apart), the nearest leader of each member; and the places of leaders."""
    order = np.argsort(node, kind="stable")
    found, leaders = [], []
    while len(order):
        lead, order = order[0], order[1:]
        leaders.append(lead)
        apart = np.bitwise_count(bits[order] ^ bits[lead]).sum(axis=1).astype(np.int64)
        near = apart <= LOOSE
        if near.any():
            found.append(np.stack([np.full(int(near.sum()), node[lead]), node[order[near]], apart[near]]))
        order = order[apart > TIGHT]
    return nearest(np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1)), np.array(leaders)


def nearest(pairs: np.ndarray) -> np.ndarray:
    """Of rows (leader, member, bits apart) the nearest for each member; the least leader of equally near ones."""
    pairs = pairs[:, np.lexsort((pairs[0], pairs[2], pairs[1]))]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = pairs[1, 1:] != pairs[1, :-1]
    return pairs[:, new & (pairs[0] != pairs[1])]


def several(key: np.ndarray) -> list[tuple[int, int]]:
    """Where groups of two and more equal keys begin and end, of sorted keys."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts, stops = np.append(0, cuts), np.append(cuts, len(key))
    many = stops - starts > 1
    return list(zip(starts[many].tolist(), stops[many].tolist()))


def grouped(key: np.ndarray, node: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all groups of equal keys, and which rows lead."""
    order = np.lexsort((node, key))
    found, lead = [np.zeros((3, 0), np.int64)], np.ones(len(key), bool)
    for a, b in several(key[order]):
        own = order[a:b]
        pairs, leaders = candidates(node[own], bits[own])
        found.append(pairs)
        lead[own] = False
        lead[own[leaders]] = True
    return nearest(np.concatenate(found, axis=1)), lead


def band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the leaders of each slice of (node, text), and its pairs."""
    known = Words()
    for batch in slices(batches, "text"):
        node = batch.column(0).to_numpy()
        keys, bits = signatures(*shingle_rows(texts(batch, "text"), known))
        row = np.repeat(np.arange(len(node)), BANDS)
        pairs, lead = grouped(keys.ravel(), node[row], bits[row])
        row = row[lead]
        rows = [keys.ravel()[lead].view(np.int64), node[row], bits[row, 0].view(np.int64), bits[row, 1].view(np.int64)]
        columns = [*(pa.concat_arrays([pa.array(x), y]) for x, y in zip(rows, (pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[1]), *[pa.nulls(pairs.shape[1], pa.int64())] * 2)))]
        none = pa.nulls(len(row), pa.int64())
        columns += [pa.concat_arrays([none, pa.array(pairs[0])]), pa.concat_arrays([none.cast(pa.int32()), pa.array(pairs[2].astype(np.int32))])]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "s0", "s1", "other", "apart"])


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first column, each group of equal ones whole; one that runs on into the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if held and held[0].column(0)[0].as_py() != key[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def numbers(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(x).to_numpy() for x in names]


def pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sorted (key, node, s0, s1)."""
    for rows in whole_groups(batches):
        key, node, s0, s1 = numbers(rows, "key", "node", "s0", "s1")
        pairs, _ = grouped(key, node, np.stack([s0, s1], axis=1).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(np.int32))], names=["a", "b", "apart"])


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All keys of (node, text, root)."""
    known = Words()
    for batch in slices(batches, "text"):
        node, root = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        keys, bits = signatures(*shingle_rows(texts(batch, "text"), known))
        row = np.repeat(np.arange(len(node)), BANDS)
        columns = [keys.ravel().view(np.int64), node[row], root[row], bits[row, 0].view(np.int64), bits[row, 1].view(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "node", "root", "s0", "s1"])


def apart_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (key, node, root, s0, s1) the rows (key, node, root) that may be similar to one of another root in their group."""
    for rows in whole_groups(batches):
        key, node, root, s0, s1 = numbers(rows, "key", "node", "root", "s0", "s1")
        bits = np.stack([s0, s1], axis=1).view(np.uint64)
        kept = np.zeros(len(key), bool)
        for a, b in several(key):
            if (root[a:b] == root[a]).all():
                continue
            for k in range(a, b - 1):
                near = (np.bitwise_count(bits[k + 1 : b] ^ bits[k]).sum(axis=1) <= LOOSE) & (root[k + 1 : b] != root[k])
                kept[k] |= near.any()
                kept[k + 1 : b] |= near
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (key, node, root)], names=["key", "node", "root"])


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, its different shingle hashes as bytes) of (node, text)."""
    known = Words()
    for batch in slices(batches, "text"):
        hashes, counts = shingle_rows(texts(batch, "text"), known)
        sets = [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])


def joining(root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places of similar sets that join all similar roots: each link joins two that no earlier one has joined."""
    root, size = root.copy(), np.array([len(x) for x in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    own = np.zeros(1 + max(int(x.max()) for x in ids), bool)
    found = []
    for k in range(len(sets) - 1):
        later = k + 1 + np.flatnonzero((root[k + 1 :] != root[k]) & (5 * size[k + 1 :] >= 4 * size[k]) & (5 * size[k] >= 4 * size[k + 1 :]))
        if not len(later):
            continue
        own[ids[k]] = True
        shared = np.add.reduceat(own[np.concatenate([ids[j] for j in later])], np.cumsum(size[later]) - size[later], dtype=np.int64)
        own[ids[k]] = False
        for j in later[9 * shared >= 4 * (size[k] + size[later])].tolist():
            if root[j] != root[k]:
                found.append((k, j))
                root[root == root[j]] = root[k]
    return found


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of sorted (key, node, root, hashes) between different roots: in a group fewer than it has roots."""
    for rows in whole_groups(batches):
        key, node, root = numbers(rows, "key", "node", "root")
        found = np.zeros((0, 2), np.int64)
        for a, b in several(key):
            sets = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").slice(a, b - a).to_pylist()]
            links = np.array(joining(root[a:b], sets), np.int64).reshape(-1, 2)
            found = np.concatenate([found, node[a + links]])
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def similar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text_a, text_b) the pairs (a, b) whose shingles reach the similarity."""
    for batch in slices(batches, "text_a"):
        kept = []
        for k, (x, y) in enumerate(zip(texts(batch, "text_a"), texts(batch, "text_b"))):
            x, y = shingle_set(x), shingle_set(y)
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                kept.append(k)
        yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))


def proposed(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (node, text): for each text b the nearest leader a."""
    bands = materialise(rows.mapInArrow(band_batches, BAND))
    dealt = bands.where("other is null").select("key", "node", "s0", "s1").repartition("key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(pair_batches, PAIR).unionByName(bands.where("other is not null").select(F.col("other").alias("a"), F.col("node").alias("b"), "apart"))
    return materialise(pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select("best.a", "b"))


def between(rows: DataFrame) -> DataFrame:
    """Links (a, b) by shingle hashes between the roots of rows (node, text, root), enough to join all that are similar."""
    dealt = rows.mapInArrow(key_batches, ROOTED).repartition("key").sortWithinPartitions("key")
    apart = materialise(dealt.mapInArrow(apart_batches, "key long, node long, root long"))
    sets = rows.select("node", "text").mapInArrow(set_batches, "node long, hashes binary")
    met = apart.join(sets, "node").select("key", "node", "root", "hashes").repartition("key").sortWithinPartitions("key", "node")
    return materialise(met.mapInArrow(link_batches, "a long, b long").distinct())


def similar(rows: DataFrame) -> DataFrame:
    """Links (a, b) between rows (node, text), enough to keep every component of similarity 0.8 or more."""
    pairs = proposed(rows)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # Only texts that are in a pair are shuffled.
    known = materialise(passing(rows, filter_of(ends), "node").dropDuplicates(["node"]))

    def verified(chosen: DataFrame) -> DataFrame:
        one = spread_join(chosen, "a", "b", known.select(F.col("node").alias("a"), F.col("text").alias("text_a")))
        both = spread_join(one, "b", "a", known.select(F.col("node").alias("b"), F.col("text").alias("text_b")))
        return materialise(both.select("a", "b", "text_a", "text_b").mapInArrow(similar_batches, "a long, b long"))

    links = verified(pairs)
    roots = connected_components(links).select(F.col("id").alias("node"), "root")
    # All pairs of different components are tried here, so that a further round would find nothing new.
    others = between(known.join(roots, "node", "left").select("node", "text", F.coalesce("root", "node").alias("root")))
    return links.unionByName(verified(others))


def one_of_similar(docs: DataFrame) -> DataFrame:
    """Of each component of similar texts the row with the least doc_id (null last; then the least hash of the row), with all columns."""
    key, mark = fresh(docs.columns, "key"), fresh(docs.columns, "mark")
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), mark: F.xxhash64(*docs.columns)})
    roots = connected_components(similar(keyed.select(F.col(mark).alias("node"), F.col("text").cast("string").alias("text"))))
    ids = passing(keyed.select(F.col(key).alias("key"), F.col(mark).alias("id")), filter_of(roots.select("id")), "id")
    linked = materialise(ids.distinct().join(roots, "id"))
    stay = linked.groupBy("root").agg(F.min(F.struct("key", "id")).alias("first")).select("first.id")
    gone = materialise(linked.select("id").join(stay, "id", "left_anti").select(F.col("id").alias(mark)))
    return without(keyed, mark, gone).select(*docs.columns)
