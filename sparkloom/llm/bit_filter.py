"""A set of 64-bit hashes as a bit table of bounded size, for leaving out rows before a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A filter has SHARE bits for each hash, between these numbers of bits.
SHARE, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27
#: Rows that are copied at a time.
ROWS = 1000


class BitFilter:
    """Which hashes may belong to a set: one bit, chosen by the high bits of the hash. It never leaves out one that does."""

    def __init__(self, bits: int, table: np.ndarray):
        self.shift, self.table = np.uint64(65 - bits.bit_length()), table

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def filter_of(hashes: DataFrame) -> BitFilter:
    """The filter of a column of longs: its words with a bit, MOST_BITS / 64 at most, are all that is collected."""
    (column,) = hashes.columns
    n = hashes.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, SHARE * n):
        bits *= 2
    placed = hashes.select(F.shiftrightunsigned(column, 65 - bits.bit_length()).alias("at"))
    words = placed.groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return BitFilter(bits, table)


def kept_by(known: BitFilter, column: str, passing: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose `column` passes the filter, or those whose does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # A few rows at a time, so that no second copy of a large batch is held.
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                hashes = batch.column(batch.schema.get_field_index(column)).to_numpy().view(np.uint64)
                yield batch.filter(pa.array(known.passes(hashes) == passing))

    return run


def passing(rows: DataFrame, known: BitFilter, column: str) -> DataFrame:
    return rows.mapInArrow(kept_by(known, column, True), rows.schema)


def failing(rows: DataFrame, known: BitFilter, column: str) -> DataFrame:
    return rows.mapInArrow(kept_by(known, column, False), rows.schema)


def without(rows: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Rows whose long `column` is not in `gone` (one column of that name): only those that may be are shuffled."""
    known = filter_of(gone)
    return failing(rows, known, column).unionByName(passing(rows, known, column).join(gone, column, "left_anti").select(*rows.columns))
