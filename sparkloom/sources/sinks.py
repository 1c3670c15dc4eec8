"""Where results go: forms of reports, stores that are replaced as a whole, and loads in chunks that are counted."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.shared import grouped


def csv_lines(rows: DataFrame, order: str) -> DataFrame:
    """A table as lines of CSV (n, value), in an order: quoted where a value has a comma, a quote or a line feed, doubles with three digits."""

    def cell(name: str, kind: str):
        text = F.format_string("%.3f", F.col(name)) if kind == "double" else F.coalesce(F.col(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)

    return rows.select(F.col(order).alias("n"), F.concat_ws(",", *(cell(*t) for t in rows.dtypes)).alias("value"))


def replace_table(rows: DataFrame, path: str) -> None:
    """Write a table in the place of the one at `path`: the new files are complete before the old ones go, so readers never see half of it."""
    rows.write.mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Add records to a log."""
    rows.write.mode("append").parquet(path)


def clear_log(log: DataFrame, path: str) -> None:
    """Empty a log but keep its columns."""
    log.where("false").write.mode("overwrite").parquet(path)


def load_chunks(rows: DataFrame, send: Callable[[int, list], tuple[int, int, int]], key: str = "chunk") -> DataFrame:
    """Send the rows of each chunk by `send` (chunk, rows) -> (inserted, updated, skipped), once more one by one if that fails, and return the counts (chunk, sent, inserted, updated, skipped, failed); chunks are bounded by how they were cut."""
    columns = [c for c in rows.columns if c != key]

    def deliver(chunk: int, held: list[tuple]) -> list[tuple]:
        items = [dict(zip(columns, row[1:])) for row in held]
        try:
            done, failed = send(int(chunk), items), 0
        except Exception:  # the store says no: find out which rows it takes
            done, failed = (0, 0, 0), 0
            for item in items:
                try:
                    done = tuple(a + b for a, b in zip(done, send(int(chunk), [item])))
                except Exception:
                    failed += 1
        return [(chunk, len(items), *done, failed)]

    names = (key, "sent", "inserted", "updated", "skipped", "failed")
    return grouped(rows, key, deliver, pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} long" for n in names))


def enforcement_rules(allowed: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, other, rule): for every two modules without an allowed dependency (module, other), the line of a test that forbids it; modules are few."""
    pairs = modules.select("module").join(modules.select(F.col("module").alias("other")), F.col("module") != F.col("other"))
    rule = F.format_string('no_dependency(from = "%s..", to = "%s..")', "module", "other")
    return pairs.join(allowed, ["module", "other"], "left_anti").select("module", "other", rule.alias("rule"))
