"""Admission limits: a sliding window of one second, and a monthly quota."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Microseconds of a call's window, and of a slice in which pauses are looked for.
WINDOW, SLICE = 1_000_000, 600_000_000


def admit(stamps: list[int], most: int, window: int = 1_000_000, held: list[int] | None = None) -> tuple[list[bool], list[int]]:
    """Which calls (times in microseconds, ascending) pass, and the admitted times still held; rejected calls leave no trace."""
    held, out = list(held or ()), []
    for t in stamps:
        held = [h for h in held if t - h < window]
        out.append(len(held) < most)
        held += [t] * out[-1]
    return out, held


def rate_limit(events: DataFrame, key: str, most: int, *, id_col: str, ts: str = "ts") -> DataFrame:
    """(key, id, ts, admitted): each key has its own window. Calls without a time pass and leave no trace.

    A key's calls that lie a window or more apart cannot affect each other, so a key is dealt out by its pauses. They are
    found within slices of time, and between slices from a row for each; the calls between two pauses meet in one task, in
    order, beside those of others, and the task holds one batch and at most ``most`` times.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(key, F.col(id_col).alias("id"), us.alias("us"), F.col(ts).alias("ts")).withColumn("slice", F.floor(F.col("us") / SLICE))
    own, slices = Window.partitionBy(key, "slice").orderBy("us", "id"), Window.partitionBy(key).orderBy("slice")
    # the time at which a burst of calls began, as far as its slice can tell
    rows = rows.withColumn("pause", F.col("us") - F.lag("us").over(own) >= WINDOW)
    rows = rows.withColumn("began", F.last(F.when(F.col("pause"), F.col("us")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(key, "slice").agg(F.min("us").alias("least"), F.max("us").alias("greatest"), F.max("began").alias("began"))
    ends = ends.withColumn("first", F.when(F.coalesce(F.col("least") - F.lag("greatest").over(slices) >= WINDOW, F.lit(True)), F.col("least")))
    before = F.last(F.coalesce("began", "first"), ignorenulls=True).over(slices.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(F.col(key).alias("__key"), F.col("slice").alias("__slice"), F.coalesce("first", before).alias("head"))
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("__key")) & F.col("slice").eqNullSafe(F.col("__slice")), "left")
    rows = rows.select(key, "id", "ts", "us", F.coalesce("began", "head").alias("burst"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            stamps, admitted = b.column("us").to_pylist(), []
            for burst, calls in groupby(zip(b.column(key).to_pylist(), b.column("burst").to_pylist())):
                some = stamps[len(admitted) : len(admitted) + sum(1 for _ in calls)]
                if burst[1] is None:
                    admitted += [True] * len(some)
                    continue
                passed, held = admit(some, most, WINDOW, held if burst == now else [])
                admitted += passed
                now = burst
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("id"), b.column("ts"), pa.array(admitted, pa.bool_())], [key, "id", "ts", "admitted"])

    kind = dict(events.dtypes)
    rows = rows.repartition(key, "burst").sortWithinPartitions(key, "burst", "us", "id")
    return rows.mapInArrow(run, f"{key} {kind[key]}, id {kind[id_col]}, ts {kind[ts]}, admitted boolean")


def monthly_quota(events: DataFrame, limit: int, *, id_col: str, ts: str = "ts") -> DataFrame:
    """(id, month, n, admitted): the first ``limit`` requests of each month pass."""
    hour = F.date_trunc("hour", ts)
    rows = events.select(F.col(id_col).alias("id"), F.col(ts).alias("ts"), F.date_format(ts, "yyyy-MM").alias("month"), hour.alias("hour"))
    # a month is one row an hour before it is ordered, and calls are ordered within their hour
    before = F.coalesce(F.sum("size").over(Window.partitionBy("month").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = rows.groupBy("month", "hour").agg(F.count("*").alias("size")).select("month", "hour", before.alias("before"))
    n = F.col("before") + F.row_number().over(Window.partitionBy("month", "hour").orderBy("ts", "id"))
    return rows.join(hours, ["month", "hour"]).withColumn("n", n).select("id", "month", "n", (F.col("n") <= limit).alias("admitted"))


def monthly_usage(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
