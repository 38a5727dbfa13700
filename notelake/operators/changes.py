"""Change detection and keyed updates of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["vault_name", "path"]


def detect(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """``scan`` with status: inserted, updated, touched (same text, new time: Q9) or skipped.

    Both sides have (vault_name, path, hash, mtime_ms, file_size, model_id). A file whose time, size and model are as
    cached is skipped without a look at its hash; another model always means an update (Q8).
    """
    old = cache.select(*KEY, *[F.col(c).alias("old_" + c) for c in ("hash", "mtime_ms", "file_size", "model_id")])
    same = lambda c: F.col(c).eqNullSafe(F.col("old_" + c))
    status = (
        F.when(F.col("old_hash").isNull(), "inserted")
        .when(~same("model_id"), "updated")
        .when(same("mtime_ms") & same("file_size"), "skipped")
        .when(same("hash"), "touched")
        .otherwise("updated")
    )
    return scan.join(old, KEY, "left").withColumn("status", status).drop("old_hash", "old_mtime_ms", "old_file_size", "old_model_id")


def deleted(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached files that the (filtered) scan no longer has (Q27)."""
    return cache.join(scan.select(*KEY), KEY, "left_anti")


def tally(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("n"))


def replace(table: DataFrame, gone: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` without the rows of the keys in ``gone``, and with ``new``; columns that either lacks are null."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return replace(table, rows, rows, keys)
