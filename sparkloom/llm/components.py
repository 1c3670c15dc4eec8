"""Connected components of an edge table, by alternating stars; every round is written and read again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_path, materialise, spread_join


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch's edges by stars to the least node that the batch connects them with."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        pairs = [(x, t) for x in list(root) if (t := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], schema=schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (two long columns): the root is the least id reachable.

    Self loops and repeated edges do no harm; no edges give no rows. A node's neighbours are never gathered: minima are
    aggregated with partial sums and joined back, those of a hub by many tasks, and each round at least shortens every path, so rounds grow with the
    logarithm of the longest one.
    """
    a, b = edges.columns
    spark = edges.sparkSession
    start = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    current = materialise(start.mapInArrow(forest, "u long, v long").distinct())
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = spread_join(both, "u", "v", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(down, "u", "v", small_least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = materialise(small)
        inner = following.join(following.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        several = following.groupBy("u").count().where("count > 1").limit(1).count()
        drop_path(spark, current)
        current = following
        if not inner and not several:
            break
    roots = current.select(F.col("v").alias("id")).distinct().withColumn("root", F.col("id"))
    return current.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
