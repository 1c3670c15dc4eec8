"""Cutting lineage in iterative operators, and dealing rows to tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where it is unset, a temporary one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again."""
    path = f"{base_dir(df.sparkSession)}/sparkloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all tasks, for work that costs far more than the bytes of its input, which may lie in one small file."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def grouped(rows: DataFrame, key: str, work: Callable[[object, list[tuple]], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that `work` makes of each key and its rows (all columns, the key first): one exchange, and no frame for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    out += work(held[0][0], held)
                    held = []
                    if len(out) > 20_000:
                        yield made(out)
                        out = []
                held.append(row)
        if held:
            out += work(held[0][0], held)
        yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return rows.select(key, *[c for c in rows.columns if c != key]).repartition(key).sortWithinPartitions(key).mapInArrow(run, ddl)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete everything that `cut` has written in the shared folder: for callers who have written or read their results."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/sparkloom")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
