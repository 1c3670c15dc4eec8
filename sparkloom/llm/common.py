"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands at a time; one longer row is taken alone.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch, which ends with the row that reaches them: less than a slice, so that few batches are cut.
BATCH_BYTES = SLICE_BYTES * 15 // 16
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table called `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); where it is unset, a temporary one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sparkloom/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: lineage ends there and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a materialised DataFrame that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold BATCH_BYTES or a row more, unless a limit is set. By rows alone a batch has 10000 whole texts, which executors hold outside the heap."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of `column` in each hold at most `limit` bytes, or are a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        at = 0
        while at < len(col):
            to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
            to = min(max(to, at + 1), len(col))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The strings of a column as UTF-8 bytes; null becomes empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


#: What this Python process keeps over tasks, by name; a worker that is used again finds it here.
_KEPT: dict[str, Any] = {}


def kept_in_process(name: str, make: Callable[[], Any]) -> Any:
    """What `make` returned when this process first asked for `name`."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def fresh(taken: list[str], stem: str) -> str:
    """A column name from `stem` that none of `taken` equals, whatever the case."""
    lower = {c.lower() for c in taken}
    while stem.lower() in lower:
        stem += "_"
    return stem


#: Keys that one hot key is spread over.
SALTS = 64


def spread_join(rows: DataFrame, key: str, by: str, looked_up: DataFrame, how: str = "inner") -> DataFrame:
    """Join `rows` to `looked_up` (unique `key`) where one key may hold a large part of `rows`.

    Rows of a key are dealt to SALTS tasks by the low bits of the long column `by`; which of them a key has is counted
    first (one long a key, with partial sums), and each row of `looked_up` goes to just those tasks.
    """
    salt, mask = fresh([*rows.columns, *looked_up.columns], "salt"), fresh([*rows.columns, *looked_up.columns], "mask")
    salted = rows.withColumn(salt, F.coalesce(F.col(by), F.lit(0)).bitwiseAND(SALTS - 1).cast("int"))
    present = salted.groupBy(key).agg(F.bit_or(F.expr(f"shiftleft(1L, {salt})")).alias(mask))
    dealt = looked_up.join(present, key).withColumn(salt, F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: (F.call_function("shiftright", F.col(mask), k).bitwiseAND(1) == 1)))).drop(mask)
    return salted.join(dealt, [key, salt], how).drop(salt)
