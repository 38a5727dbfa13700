"""Following a vault: file events as a stream that keeps a snapshot current, and stateful limits over streams."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.limits import admit
from ..plans import index
from ..sources import vault
from ..sources.snapshot import Snapshots

#: A file event: upsert (with its text) or delete; a rename is a delete and an upsert.
EVENT = "seq long, kind string, vault_name string, path string, text string, mtime_ms long, file_size long, model_id string"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each file in a batch."""
    last = F.row_number().over(Window.partitionBy("vault_name", "path").orderBy(F.desc("seq")))
    return events.withColumn("__n", last).where("__n = 1").drop("__n")


def apply(store: Snapshots, events: DataFrame) -> None:
    """Bring a snapshot up to date with a batch of events, in one commit."""
    now = latest(events).persist()
    index.update(store, now.where("kind = 'upsert'").drop("seq", "kind"), complete=False, removed=now.where("kind = 'delete'"))
    now.unpersist()


def produce(store: Snapshots, vaults: dict[str, str], folder: str, **options) -> int:
    """Compare vaults with the index and write what changed as a file of events into ``folder``; returns their number.

    Only files whose time or size differs from the index are read. ``read_events`` streams the folder.
    """
    spark = store.spark
    seen = vault.scan(spark, vaults, **options)
    known = store.table("files").select("vault_name", "path", F.col("mtime_ms").alias("m"), F.col("file_size").alias("s"))
    both = seen.join(known, ["vault_name", "path"], "full_outer").where("m is null or mtime_ms is null or m <> mtime_ms or s <> file_size")
    came = vault.read_texts(both.where("mtime_ms is not null").select("vault_name", "path", "absolute", "mtime_ms", "file_size")).where("error is null")
    came = came.select(F.lit("upsert").alias("kind"), "vault_name", "path", "text", "mtime_ms", "file_size")
    gone = both.where("mtime_ms is null").select(F.lit("delete").alias("kind"), "vault_name", "path", F.lit(None).cast("string").alias("text"), "mtime_ms", "file_size")
    events = came.unionByName(gone).withColumn("seq", F.lit(time.time_ns())).withColumn("model_id", F.lit("none")).persist()
    n = events.count()
    if n:
        events.coalesce(1).write.mode("append").json(folder)
    events.unpersist()
    return n


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(folder)


def watch(store: Snapshots, vaults: dict[str, str], folder: str, *, every: float = 2.0, rounds: int | None = None, **options) -> int:
    """Keep the index current: look at the vaults each ``every`` seconds, and apply what changed as a stream; returns the events."""
    import os

    os.makedirs(f"{folder}/events", exist_ok=True)
    total, done = 0, 0
    while rounds is None or done < rounds:
        n = produce(store, vaults, f"{folder}/events", **options)
        if n:
            follow(read_events(store.spark, f"{folder}/events"), store, f"{folder}/checkpoint").awaitTermination()
        total, done = total + n, done + 1
        if rounds is None or done < rounds:
            time.sleep(every)
    return total


def follow(events: DataFrame, store: Snapshots, checkpoint: str):
    """Start the query that applies a stream of events; each micro-batch is one snapshot."""
    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: apply(store, batch)).start()


def route(paths: DataFrame, vaults: dict[str, str]) -> DataFrame:
    """``paths(absolute)`` with vault_name and path by the longest root that holds them; others are gone."""
    roots = sorted(((r.rstrip("/") + "/", v) for v, r in vaults.items()), key=lambda x: (-len(x[0]), x))
    hit = F.coalesce(*[F.when(F.col("absolute").startswith(r), F.struct(F.lit(v).alias("vault_name"), F.expr(f"substr(absolute, {len(r) + 1})").alias("path"))) for r, v in roots])
    return paths.withColumn("__r", hit).where("__r is not null").select("*", "__r.*").drop("__r")


def limit_stream(calls: DataFrame, most: int) -> DataFrame:
    """``calls(key string, id long, ts timestamp)`` with admitted: at most ``most`` a second for each key, over all batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        us = [int(t.value // 1000) for t in rows["ts"]]
        passed, held = admit(us, most, held=list(state.get[0]) if state.exists else [])
        state.update((held,))
        yield rows.assign(key=key[0], admitted=passed)[["key", "id", "ts", "admitted"]]

    return calls.groupBy("key").applyInPandasWithState(run, "key string, id long, ts timestamp, admitted boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Keeps the rows and the time of each micro-batch of the session's streams: ``spark.streams.addListener(Progress())``."""

    def __init__(self):
        self.batches: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "ms": p.durationMs.get("triggerExecution", 0)})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def progress(changes: DataFrame) -> DataFrame:
    """Running tallies of a stream of statuses."""
    return changes.groupBy("status").agg(F.count("*").alias("n"))
