"""The index as an object: build, search, read, list, tasks, statistics; each call returns a DataFrame or plain values."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import tokens
from .operators import bm25, notes
from .plans import index as plan
from .plans.search import Output, Request, count, search
from .sources import vault
from .sources.snapshot import Snapshots


class Notes:
    def __init__(self, spark: SparkSession, root: str, tokenizer: tokens.Tokenizer = tokens.words):
        self.spark, self.store, self.tokenizer = spark, Snapshots(spark, root), tokenizer

    def index(self, vaults: dict[str, str], *, pdf=None, vision=None, model_id: str = "none", **options) -> DataFrame:
        """Scan vaults and bring the index up to date; returns the number of files by status."""
        plan.migrate(self.store)
        texts = vault.read_texts(vault.scan(self.spark, vaults, **options), pdf, vision).where("error is null").withColumn("model_id", F.lit(model_id))
        return plan.update(self.store, texts.drop("absolute", "hash", "error"), tokenizer=self.tokenizer)

    def search(self, query: str, *, query_vector: list[float] | None = None, **knobs) -> Output:
        chunks = self.store.table("chunks")
        return search(chunks, self.text_index(), Request(query, **knobs), vector_table=self.store.table("vectors"), files=self.store.table("files"), query_vector=query_vector, tokenizer=self.tokenizer)

    def count(self, query: str, **knobs) -> int:
        return count(self.store.table("chunks"), self.text_index(), Request(query, **knobs), self.tokenizer)

    def text_index(self) -> bm25.TextIndex:
        """The stored index, of which a query reads its own terms."""
        return bm25.stored(self.store.table("postings"), self.store.table("stats"))

    def show(self, output: Output, query: str, lines: int = 5, chars: int = 200) -> list[dict]:
        """Results for people: snippets, secrets masked."""
        rows = output.results.withColumn("snippet", C.mask(C.snippet(F.col("content"), query, lines, chars)))
        return [json.loads(x) for x in rows.drop("content", "tokenized_content").toJSON().collect()]

    def tasks(self, keyword: str | None = None, include_checked: bool = False) -> DataFrame:
        return notes.find_tasks(self.store.table("tasks"), keyword, include_checked)

    def stats(self) -> DataFrame:
        return notes.statistics(self.store.table("chunks"), self.store.table("files"), self.store.table("vectors"))

    def files(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return notes.page(self.store.table("files"), ["vault_name", "path"], limit, offset)

    def history(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """Files by the time of their last change, newest first."""
        return notes.page(self.store.table("files"), [F.desc("mtime_ms"), "vault_name", "path"], limit, offset)

    def file(self, vault_name: str, path: str) -> dict | None:
        """What is known of a file."""
        row = self.store.table("files").where((F.col("vault_name") == vault_name) & (F.col("path") == path)).first()
        return row and row.asDict()

    def chunk(self, chunk_id: int) -> dict | None:
        row = self.store.table("chunks").where(F.col("chunk_id") == chunk_id).first()
        return row and row.asDict()

    def chunk_ids(self, vault_name: str, path: str) -> list[int]:
        """Ids of a file's chunks in order; only the file's bucket is read."""
        key = self.spark.createDataFrame([(vault_name, path)], "vault_name string, file_path string")
        rows = self.store.table("chunks", buckets=[key.select(self.store.bucket()).first()[0]])
        return [r.chunk_id for r in rows.where((F.col("vault_name") == vault_name) & (F.col("file_path") == path)).orderBy("chunk_index").select("chunk_id").collect()]

    def path_counts(self) -> DataFrame:
        """(vault_name, n): files of each vault."""
        return notes.path_counts(self.store.table("files"))

    def embed(self, embedder, model_id: str) -> int:
        """Vectors for chunks without one; ``embedder`` maps texts to vectors."""
        return plan.embed(self.store, embedder, model_id)

    def read(self, vault_name: str, path: str, vaults: dict[str, str] | None = None) -> DataFrame:
        """The text of a note: from its file where ``vaults`` names the vault and the file is there, else from its chunks."""
        if vaults and vault_name in vaults:
            full = vault.safe_path(vaults[vault_name], path)
            try:
                text = Path(full).read_text(encoding="utf-8")
            except (OSError, ValueError):
                text = None
            if text is not None:
                return self.spark.createDataFrame([(vault_name, path, text)], "vault_name string, file_path string, text string")
        rows = self.store.table("chunks").where((F.col("vault_name") == vault_name) & (F.col("file_path") == path))
        return notes.documents(rows)

    def context(self, chunk_id: int, window: int = 2, budget: int = 100_000) -> str:
        """A chunk among its neighbours, masked, within a budget of characters."""
        chunks = self.store.table("chunks")
        at = chunks.where(F.col("chunk_id") == chunk_id).select("vault_name", "file_path", "chunk_index")
        rows = notes.surrounding(chunks, at, window).orderBy("chunk_index").select(C.mask(F.col("content")).alias("content"), "selected").collect()
        return "\n\n".join((">>> " if r.selected else "") + r.content for r in rows)[:budget]

    def delete(self, vault_name: str, path: str) -> None:
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"not a path of a vault: {path}")
        plan.delete_files(self.store, self.spark.createDataFrame([(vault_name, path)], "vault_name string, path string"))

    def prune(self, retention_days: dict[str, int], now_ms: int, *, dry_run: bool = False) -> int:
        """Drop files that are too old, and say how many; a dry run drops none (Q14)."""
        gone = notes.expired(self.store.table("files"), retention_days, now_ms)
        n = gone.count()
        if n and not dry_run:
            plan.delete_files(self.store, gone)
        return n
