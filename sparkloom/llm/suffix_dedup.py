"""Removal of repeated passages with longest previous factor of LENGTH bytes or more, over anchored suffixes.

A byte goes if a LENGTH-byte string that covers it also starts earlier (smaller document, or same document and earlier
start). A suffix array of the whole corpus does not fit one machine, and most suffixes repeat nowhere, so suffixes are
first divided by content: each LENGTH-byte window chooses one anchor, the least hash among its GRAM-byte strings (the
leftmost of equals). Equal windows choose equal anchors at the same offset, so repeats only occur among windows of equal
anchors; windows of one anchor occurrence are neighbours and share a context of their joined bytes.

1. Each slice of documents finds its anchors (vectorised rolling hashes and sliding minima), settles repeats inside the
   slice, and sends one row for each anchor that still has an unsettled window: however frequent a passage is, a slice
   sends it once.
2. Anchor rows are shuffled by hash and streamed; those that occur in several places ask their documents for contexts.
   An anchor of more rows than are held at once is divided into parts.
3. Contexts are shuffled by hash and part. The distinct contexts of a group are put in a suffix array (ranks by doubling,
   LCP of neighbours from the ranks of each doubling). In suffix order, the previous and the next suffix with a smaller
   position are those that a longest previous factor can start at: LPF is the greater of the least LCP towards either,
   and windows with LPF of LENGTH or more go. Equal contexts are settled as one. Of anchors in parts, contexts with a
   window left meet once more, without their parts.
4. Removed windows return to their documents, whose bytes are cut.

Hashes only bring windows together; bytes decide. Texts are shuffled once: both joins use the same exchange.

Defined cases: null text counts as empty; a null id comes after all others; rows of one id with different texts are
different documents in the order of a hash of their texts, rows equal in id and text are one document and get the same
result each; texts under LENGTH bytes keep all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, slices, table

LENGTH = 100
GRAM = 24
#: Bytes of text in a slice, and of distinct contexts in a suffix array.
SLICE, ARRAY = 2 << 20, 2 << 20
#: Low bits of a key that hold the place in a slice; they bound a slice, and with it one document, at 8 GB.
PLACE = np.uint64((1 << 33) - 1)
LAST_ID = 2**63 - 1
MULTIPLIER = 0x9E3779B97F4A7C15


def power(n: int) -> np.uint64:
    return np.uint64(pow(MULTIPLIER, n, 1 << 64))


def anchor_keys(text: np.ndarray) -> np.ndarray:
    """Mixed hash of the GRAM bytes from each place, its low bits replaced by the place."""
    one = text.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    sixteen = eight[:-8] * power(8) + eight[8:]
    h = sixteen[:-8] * power(8) + eight[16:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h &= ~PLACE
    h |= np.arange(len(h), dtype=np.uint64)
    return h


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each `width` consecutive ones, by doubling."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def gram_hashes(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM bytes at some places."""
    wide = np.lib.stride_tricks.sliding_window_view(text, GRAM)[at]
    words = np.ascontiguousarray(wide).view("<u8")
    h = np.zeros(len(at), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(MULTIPLIER)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each anchor, and first and last start of the windows that chose it, in documents that end at `ends`."""
    none = np.zeros(0, np.int64)
    if len(text) < LENGTH:
        return none, none, none
    chosen = (sliding_least(anchor_keys(text), LENGTH - GRAM + 1) & PLACE).astype(np.int64)
    valid = np.ones(len(chosen), bool)
    change = np.diff(ends, prepend=0)
    for end in ends[change > 0]:
        valid[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none
    place = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return place[first], starts[first], starts[last]


def ranks(text: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(span, rank of that many bytes from each place) for spans of 8, 16, ... and LENGTH bytes, by doubling; places near the end compare what there is."""
    rank = np.unique(words_at(text), return_inverse=True)[1].astype(np.uint64)
    span = 8
    levels = [(span, rank)]
    while span < LENGTH:
        step = min(span, LENGTH - span)
        following = np.zeros_like(rank)
        following[:-step] = rank[step:] + np.uint64(1)
        rank = np.unique(rank << np.uint64(32) | following, return_inverse=True)[1].astype(np.uint64)
        span += step
        levels.append((span, rank))
    return levels


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number, bytes in order of weight."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text)]).view(">u8").ravel().astype(np.uint64)


def common_prefix(text: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """LCP, at most LENGTH, of the suffixes at places a and b; both have LENGTH bytes at least."""
    out = np.full(len(a), LENGTH, np.int64)
    part = np.flatnonzero(levels[-1][1][a] != levels[-1][1][b])
    a, b = a[part], b[part]
    reach = np.zeros(len(part), np.int64)
    for span, rank in reversed(levels[:-1]):
        reach += span * (rank[np.minimum(a + reach, len(text) - 1)] == rank[np.minimum(b + reach, len(text) - 1)])
    words = np.concatenate([words_at(text), np.zeros(128, np.uint64)])
    differ = words[a + reach] ^ words[b + reach]
    for k in range(1, 8):
        reach += (differ >> np.uint64(64 - 8 * k) == 0) & (differ != 0)
    out[part] = np.minimum(reach, LENGTH - 1)
    return out


def towards_smaller(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """LCP of each suffix, in suffix order, with the nearest one before it of a smaller position; what is below `least` may be any value below it.

    `lcp` is that of each with its neighbour before. Pointers to nearer candidates are followed at once for all
    suffixes, with the least LCP on the way; ways on which it falls below `least` end.
    """
    before = np.arange(len(position)) - 1
    low = lcp.copy()
    walk = np.arange(len(position))
    while True:
        walk = walk[(before[walk] >= 0) & (low[walk] >= least)]
        walk = walk[position[before[walk]] >= position[walk]]
        if not len(walk):
            return np.where(before >= 0, low, 0)
        via = before[walk]
        low[walk], before[walk] = np.minimum(low[walk], low[via]), before[via]


def longest_previous_factor(position: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """LPF of each suffix in suffix order, from the LCP of each with its neighbour before; what is below `least` may be any value below it."""
    back = np.concatenate([lcp[:0:-1], lcp[:1]])
    back[1:], back[:1] = back[:-1].copy(), 0
    following = towards_smaller(position[::-1], back, least)[::-1]
    return np.maximum(towards_smaller(position, lcp, least), following)


def repeats(text: np.ndarray, at: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether each of the suffixes `at` of a text has a longest previous factor of LENGTH or more; `position` orders them."""
    levels = ranks(text)
    order = np.lexsort((position, levels[-1][1][at]))
    places = at[order]
    lcp = np.zeros(len(at), np.int64)
    lcp[1:] = common_prefix(text, levels, places[:-1], places[1:])
    out = np.zeros(len(at), bool)
    out[order] = longest_previous_factor(position[order], lcp, LENGTH) >= LENGTH
    return out


def settle(group: np.ndarray, position: np.ndarray, windows: np.ndarray, contexts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeats among anchor occurrences.

    `group` holds equal values for equal anchors, `position` orders first windows (windows follow by ones), `windows`
    counts them. Returns runs of repeated windows, as occurrence, first and last window, and which occurrences are
    repeats throughout. Equal contexts are settled as one: all but those at the first position are repeats as a whole.
    The others are put in suffix arrays with the distinct contexts of their anchor. Rows of one and the same place are
    represented by one of them.
    """
    if not len(position):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, bool)
    coded = contexts.dictionary_encode()
    kind = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((position, kind))
    head = np.ones(len(order), bool)
    head[1:] = kind[order][1:] != kind[order][:-1]
    lead = order[head]
    done = position > position[lead[kind]]
    of, first, last = [np.flatnonzero(done)], [np.zeros(int(done.sum()), np.int64)], [windows[done] - 1]
    _, of_group, distinct = np.unique(group[lead], return_inverse=True, return_counts=True)
    several = lead[distinct[of_group] > 1]
    several = several[np.argsort(group[several], kind="stable")]
    size = np.cumsum(windows[several] + (LENGTH - 1))
    ends = np.flatnonzero(np.diff(group[several], append=-1)) + 1 if len(several) else []
    at = 0
    for end in ends:
        if end < len(several) and size[end - 1] - (size[at - 1] if at else 0) < ARRAY:
            continue
        batch = several[at:end]
        at = end
        n = windows[batch]
        begin = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        again = repeats(bytes_of(coded.dictionary.take(pa.array(kind[batch]))), np.repeat(np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1), n) + inside, np.repeat(position[batch], n) + inside)
        starts = again.copy()
        starts[1:] &= ~again[:-1] | (inside[1:] == 0)
        stops = again.copy()
        stops[:-1] &= ~again[1:] | (inside[1:] == 0)
        row = np.repeat(np.arange(len(batch)), n)
        of.append(batch[row[starts]])
        first.append(inside[starts])
        last.append(inside[stops])
        done[batch[np.add.reduceat(again, begin) == n]] = True
    return np.concatenate(of), np.concatenate(first), np.concatenate(last), done


def bytes_of(values: pa.Array) -> np.ndarray:
    """The joined bytes of a binary array."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's texts, and where each text ends."""
    parts = [x or b"" for x in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))


def order_of(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rank of each (id, hash) pair, equal for equal pairs."""
    order = np.lexsort((hashes, ids))
    new = np.zeros(len(ids), np.int64)
    if len(ids) > 1:
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    rank = np.zeros(len(ids), np.int64)
    rank[order] = np.cumsum(new)
    return rank


NOTES = "h long, id long, th long, place long, span long, part int"
#: Bytes of notes and of contexts that a worker holds at once, but for a group of contexts.
HELD = 8 << 20


def notes(h: np.ndarray, ids: np.ndarray, th: np.ndarray, place: np.ndarray, span: np.ndarray, part: np.ndarray | None = None) -> pa.RecordBatch:
    part = np.full(len(h), -1) if part is None else part
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (h, ids, th, place, span)), pa.array(part.astype(np.int32))], names=["h", "id", "th", "place", "span", "part"])


def local_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of each slice with an unsettled window (span -1), and windows settled in it (span packs first and last)."""
    for batch in slices(batches, "text", SLICE):
        text, ends = joined(batch)
        ids, hashes = columns(batch, "id", "th")
        place, low, high = anchors(text, ends)
        if not len(place):
            continue
        doc = np.searchsorted(ends, low, "right")
        begin = np.concatenate([[0], ends[:-1]])[doc]
        h = gram_hashes(text, place).view(np.int64)
        _, group, n = np.unique(h, return_inverse=True, return_counts=True)
        again = np.flatnonzero(n[group] > 1)
        position = (order_of(ids, hashes)[doc] << 32) + low - begin
        view = text.tobytes()
        of, first, last, done = settle(group[again], position[again], (high - low + 1)[again], pa.array([view[a : b + LENGTH] for a, b in zip(low[again].tolist(), high[again].tolist())], pa.binary()))
        open_ = np.ones(len(place), bool)
        open_[again[done]] = False
        # Equal rows of one document need not be sent twice.
        _, once = np.unique(position, return_index=True)
        sent = np.zeros(len(place), bool)
        sent[once] = True
        send = np.flatnonzero(open_ & sent)
        yield notes(h[send], ids[doc[send]], hashes[doc[send]], (place - begin)[send], np.full(len(send), -1))
        if len(of):
            of = again[of]
            start = (low - begin)[of]
            yield notes(ids[doc[of]] * 31 + start, ids[doc[of]], hashes[doc[of]], start, (start + first) << 32 | (start + last))


def groups(batches: Iterator[pa.RecordBatch], limit: int, keys: int = 1) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted rows as tables of whole groups of their first columns, and False; a group of over `limit` bytes in several tables of its own, and True."""
    whole: list[pa.RecordBatch] = []  # groups that have ended
    own: list[pa.RecordBatch] = []  # the last group so far
    parts, key = False, None
    bytes_in = lambda held: sum(x.nbytes for x in held)
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        lead = 0 if key is None else int((marks == key[:, None]).all(axis=0).sum())
        if lead:
            own.append(batch.slice(0, lead))
        if lead < batch.num_rows:
            if parts:
                if own:
                    yield pa.Table.from_batches(own), True
            else:
                whole += own
            key = marks[:, -1]
            cut = batch.num_rows - int((marks == key[:, None]).all(axis=0).sum())
            if cut > lead:
                whole.append(batch.slice(lead, cut - lead))
            own, parts = [batch.slice(cut)], False
        full = bytes_in(own) >= limit
        if whole and (full or bytes_in(whole) >= limit):
            yield pa.Table.from_batches(whole), False
            whole = []
        if full:
            yield pa.Table.from_batches(own), True
            own, parts = [], True
    if own and parts:
        yield pa.Table.from_batches(own), True
    elif whole or own:
        yield pa.Table.from_batches(whole + own), False


def sharer(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted notes, the anchors that occur in several places, numbered by parts if they are more than `limit` bytes, and all settled windows."""
        number = 0
        for rows, in_parts in groups(batches, limit):
            h, ids, th, place, span = (rows.column(k).to_numpy() for k in ("h", "id", "th", "place", "span"))
            anchor = span == -1
            near = h[anchor][1:] == h[anchor][:-1]
            twice = np.full(int(anchor.sum()), in_parts)
            if len(twice):
                twice[1:] |= near
                twice[:-1] |= near
            keep = ~anchor
            keep[np.flatnonzero(anchor)[twice]] = True
            number += in_parts
            yield notes(h[keep], ids[keep], th[keep], place[keep], span[keep], np.full(int(keep.sum()), number if in_parts else -1))

    return shared_batches


CONTEXTS = "h long, part int, id long, th long, low long, windows int, context binary"


def context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the anchors that documents are asked for (`places`, with the parts above PLACE)."""
    for batch in slices(batches, "text", SLICE):
        text, ends = joined(batch)
        ids, hashes = columns(batch, "id", "th")
        place, low, high = anchors(text, ends)
        if not len(place):
            continue
        doc = np.searchsorted(ends, low, "right")
        begin = np.concatenate([[0], ends[:-1]])
        asked = batch.column(batch.schema.get_field_index("places"))
        flat, counts = asked.flatten().to_numpy(), asked.value_lengths().to_numpy()
        wanted, part = (flat & int(PLACE)) + np.repeat(begin, counts), (flat >> 33) - 1
        order = np.argsort(wanted, kind="stable")
        wanted, part = wanted[order], part[order]
        k = np.flatnonzero(np.isin(place, wanted))
        part = part[np.searchsorted(wanted, place[k])]
        view = text.tobytes()
        h = gram_hashes(text, place[k]).view(np.int64)
        contexts = [view[a : b + LENGTH] for a, b in zip(low[k].tolist(), high[k].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(part.astype(np.int32)), pa.array(ids[doc[k]]), pa.array(hashes[doc[k]]), pa.array((low - begin[doc])[k]), pa.array((high - low + 1)[k].astype(np.int32)), pa.array(contexts, pa.binary())], names=["h", "part", "id", "th", "low", "windows", "context"])


def whole_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted contexts as tables of whole groups of anchor and part, of about HELD bytes."""
    kept: list[pa.Table] = []
    for rows, in_parts in groups(batches, HELD, 2):
        here = rows.column("h")[0].as_py(), rows.column("part")[0].as_py()
        if kept and not (in_parts and here == of):
            yield pa.concat_tables(kept)
            kept = []
        if in_parts:
            of = here
            kept.append(rows)
        else:
            yield rows
    if kept:
        yield pa.concat_tables(kept)


SETTLED = "id long, th long, span long, " + CONTEXTS.replace("id long, th long, ", "")


def settled_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of sorted contexts (id, th, span), and the contexts of anchors in parts (span -1) that have a window left."""
    for rows in whole_contexts(batches):
        h, part, ids, th, low, windows = (rows.column(k).to_numpy() for k in ("h", "part", "id", "th", "low", "windows"))
        group = np.cumsum((np.diff(h, prepend=h[:1]) != 0) | (np.diff(part, prepend=part[:1]) != 0))
        context = rows.column("context").combine_chunks()
        context = context if isinstance(context, pa.Array) else context.chunk(0)
        of, first, last, done = settle(group, (order_of(ids, th) << 32) + low, windows.astype(np.int64), context)
        span = (low[of] + first) << 32 | (low[of] + last)
        left = np.flatnonzero((part >= 0) & ~done)
        none = len(of)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[of], ids[left]])), pa.array(np.concatenate([th[of], th[left]])), pa.array(np.concatenate([span, np.full(len(left), -1)])),
                *(pa.concat_arrays([pa.nulls(none, t), pa.array(x[left].astype(t.to_pandas_dtype()), t)]) for x, t in ((h, pa.int64()), (part, pa.int32()), (low, pa.int64()), (windows, pa.int32()))),
                pa.concat_arrays([pa.nulls(none, pa.binary()), context.take(pa.array(left)).cast(pa.binary())]),
            ],
            names=["id", "th", "span", "h", "part", "low", "windows", "context"],
        )


def covered(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes, as starts and ends, under packed spans of windows."""
    packed = np.sort(packed)
    a, b = packed >> 32, (packed & 0xFFFFFFFF) + LENGTH
    b = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    return a[new], np.append(b[:-1][new[1:]], b[-1:])


def cutter(keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * keep_text
        for batch in slices(batches, "text"):
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            parts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            found = batch.column(batch.schema.get_field_index("spans"))
            rows = []
            for doc_id, text, own in zip(doc_ids, parts, found):
                text, kept, gone, n = text or b"", text or b"", 0, 0
                if own.is_valid and len(own.values):
                    a, b = covered(own.values.to_numpy())
                    n, gone = len(a), int((b - a).sum())
                    kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)]))
                rows.append((doc_id, len(text), gone, n, hashlib.sha256(kept).hexdigest(), kept)[: len(kinds)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))

    return cut_batches


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Bytes, removed bytes, removed runs and digest of what is left of each row of (doc_id, text); the rest itself if `keep_text`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    found = named.select("id", "th", "text").mapInArrow(local_batches, NOTES)
    shared = materialise(found.repartition("h").sortWithinPartitions("h").mapInArrow(sharer(HELD), NOTES))
    asked = shared.where("span = -1").select("id", "th", F.expr("shiftleft(cast(part + 1 as bigint), 33) | place").alias("at")).groupBy("id", "th").agg(F.collect_set("at").alias("places"))
    # Both joins take the same columns of the texts, so that one exchange serves them.
    contexts = named.join(asked.hint("shuffle_hash"), ["id", "th"]).mapInArrow(context_batches, CONTEXTS)
    settled = contexts.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(settled_batches, SETTLED)
    settled = materialise(settled)
    again = settled.where("span = -1").select("h", F.lit(-1).alias("part"), "id", "th", "low", "windows", "context")
    across = again.repartition("h").sortWithinPartitions("h").mapInArrow(settled_batches, SETTLED)
    spans = [x.where("span <> -1").select("id", "th", "span") for x in (settled, across, shared)]
    gone = spans[0].unionByName(spans[1]).unionByName(spans[2]).groupBy("id", "th").agg(F.collect_set("span").alias("spans"))
    rows = named.join(gone.hint("shuffle_hash"), ["id", "th"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cutter(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to passages that start earlier."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
