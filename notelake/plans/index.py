"""From note texts to the tables of an index, as one plan, and incremental updates of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import tokens
from ..operators import bm25, changes, notes
from ..sources.snapshot import SCHEMA_VERSION, Snapshots


def chunk_rows(texts: DataFrame, tokenizer: tokens.Tokenizer = tokens.words, entries: set[str] = frozenset()) -> DataFrame:
    """Chunks of ``texts(vault_name, path, text)`` without ids."""
    rows = texts.where("text is not null").select("vault_name", F.col("path").alias("file_path"), F.explode(C.chunks("text")).alias("c"))
    rows = rows.select("vault_name", "file_path", "c.*")
    return rows.withColumn("tokenized_content", C.tokenised(F.col("content"), tokenizer, entries)).withColumn("emphasized_text", C.emphasised(F.col("content")))


#: Groups of files in which ids are given out one by one.
GROUPS = 256


def with_ids(chunks: DataFrame, first: int) -> DataFrame:
    """Dense ids from ``first`` on: files are dealt to GROUPS by a hash, and counted group by group.

    The driver sees a number for each group; each group orders its own files, one row for each.
    """
    group = F.pmod(F.xxhash64("vault_name", "file_path"), F.lit(GROUPS)).cast("int")
    sizes = chunks.groupBy("vault_name", "file_path").agg(F.count("*").alias("size")).withColumn("g", group)
    of_group = dict(sizes.groupBy("g").agg(F.sum("size")).collect())
    starts, n = [], first
    for g in range(GROUPS):
        starts.append(n)
        n += of_group.get(g, 0)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("g").orderBy("vault_name", "file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = F.array(*map(F.lit, starts))[F.col("g")] + before
    own = chunks.join(sizes.select("vault_name", "file_path", offset.cast("long").alias("offset")), ["vault_name", "file_path"])
    return own.withColumn("chunk_id", F.col("offset") + F.col("chunk_index")).drop("offset")


def derive(texts: DataFrame, *, first_id: int = 1, tokenizer: tokens.Tokenizer = tokens.words, entries: set[str] = frozenset(), rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """files, chunks, tasks and link names of ``texts(vault_name, path, text, mtime_ms, file_size, model_id)``; ``rows`` may hold their chunk_rows."""
    chunks = with_ids(chunk_rows(texts, tokenizer, entries) if rows is None else rows, first_id)
    found = texts.where("text is not null")
    seen = F.col("vlm_hash") if "vlm_hash" in texts.columns else F.lit(None).cast("string")
    sized = notes.char_counts(chunks).withColumnRenamed("file_path", "path")
    files = found.select("vault_name", "path", F.sha2("text", 256).alias("hash"), "mtime_ms", "model_id", "file_size", seen.alias("vlm_hash")).join(sized, ["vault_name", "path"], "left")
    tasks = found.select("vault_name", F.col("path").alias("file_path"), F.explode(C.tasks(F.col("text"))).alias("t")).select("vault_name", "file_path", "t.*")
    names = found.select("vault_name", F.col("path").alias("source"), F.explode(C.wikilinks(F.col("text"))).alias("name"))
    return {"files": files, "chunks": chunks, "tasks": tasks, "names": names}


def search_tables(chunks: DataFrame) -> dict[str, DataFrame]:
    """postings and lengths of chunks."""
    text = "tokenized_content"
    own = ("chunk_id", "vault_name", "file_path")
    return {"postings": bm25.postings(chunks, text, *own), "lengths": bm25.lengths(chunks, text, *own)}


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms"))


def publish(store: Snapshots, out: DataFrame, new: dict[str, DataFrame], files: DataFrame, names: DataFrame) -> None:
    """Commit files and link names, and for the files in ``out`` what ``new`` has; all links are resolved against all files.

    Only the buckets of ``out`` are read and written; links, of which a note may gain some by another's coming, are whole.
    """
    spread = store.bucket(path="path")
    touched = sorted(r.b for r in out.select(spread.alias("b")).distinct().collect())
    of_file = out.select("vault_name", F.col("path").alias("file_path"))
    links = notes.resolve_links(names, files)
    tables = {"files": notes.backlink_counts(files, links), "names": names, "links": links}
    if touched:
        for name in ("chunks", "tasks"):
            rows = changes.replace(store.table(name, buckets=touched), of_file, new[name], ["vault_name", "file_path"])
            tables[name] = store.write(name, rows)
        # what a query searches comes from the chunks as they are written, so texts are cut and tokenised once
        for name, rows in search_tables(store.read("chunks", tables["chunks"])).items():
            tables[name] = store.write(name, rows)
        tables["vectors"] = store.table("vectors", buckets=touched).join(of_file.distinct(), ["vault_name", "file_path"], "left_anti")
        whole = [int(b) for b in store.manifest()["tables"].get("lengths", {})]
        tables["stats"] = corpus_stats(store.read("lengths", tables["lengths"]).select("dl").union(store.table("lengths", buckets=[b for b in whole if b not in touched]).select("dl")))
    store.commit(tables, touched)


def update(store: Snapshots, texts: DataFrame, *, complete: bool = True, removed: DataFrame | None = None, **options) -> DataFrame:
    """Bring a snapshot up to date with a scan, and return the number of files by status.

    ``texts`` has (vault_name, path, text, mtime_ms, file_size, model_id). If it is ``complete``, files that it lacks are
    deleted; if not, it is a batch of files that came or changed, and ``removed`` (vault_name, path) may name files that
    went. The names in links are kept, so a link to a note that comes later is found then, and any sequence of updates
    leaves the tables of one index over the last texts, but for chunk ids. Backlinks are counted anew (Q22).
    """
    old = {n: store.table(n) for n in ("files", "names")}
    scan = changes.detect(texts.withColumn("hash", F.sha2("text", 256)), old["files"]).persist()
    fresh = scan.where(F.col("status").isin("inserted", "updated") & F.col("text").isNotNull())
    touched = scan.where("status = 'touched'").select(*changes.KEY, F.col("mtime_ms").alias("new_mtime"))
    gone = changes.deleted(texts, old["files"]) if complete else old["files"].where(F.lit(False))
    if removed is not None:
        gone = gone.unionByName(old["files"].join(removed.select(*changes.KEY), changes.KEY, "left_semi")).join(texts.select(*changes.KEY), changes.KEY, "left_anti").distinct()
    tally = {r.status: r.n for r in changes.tally(scan.select("status").unionByName(gone.select(F.lit("deleted").alias("status")))).collect()}
    if set(tally) - {"skipped"} or not store.version():
        out = fresh.select(*changes.KEY).union(gone.select(*changes.KEY)).persist()
        top = store.table("chunks").agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
        rows = chunk_rows(fresh, **options).persist()
        new = derive(fresh, first_id=top + 1, rows=rows)
        files = changes.replace(old["files"], out, new["files"], changes.KEY)
        files = files.join(touched, changes.KEY, "left").withColumn("mtime_ms", F.coalesce("new_mtime", "mtime_ms")).drop("new_mtime")
        names = changes.replace(old["names"], out.select("vault_name", F.col("path").alias("source")), new["names"], ["vault_name", "source"])
        publish(store, out, new, files, names)
        rows.unpersist()
        out.unpersist()
    scan.unpersist()
    return store.spark.createDataFrame(sorted(tally.items()), "status string, n long")


def delete_files(store: Snapshots, gone: DataFrame) -> int:
    """Drop files ``(vault_name, path)`` with all that is theirs; links to them are kept by name alone."""
    gone = gone.select(*changes.KEY).distinct()
    files = store.table("files").join(gone, changes.KEY, "left_anti")
    names = store.table("names").join(gone.select("vault_name", F.col("path").alias("source")), ["vault_name", "source"], "left_anti")
    publish(store, gone, {n: store.table(n, buckets=[]) for n in ("chunks", "tasks")}, files, names)
    return store.version()


def clear_vlm_hashes(store: Snapshots, vault_name: str | None = None) -> int:
    """Forget which pages a vision model has read, in one vault or in all, so that they are read again."""
    ours = F.lit(True) if vault_name is None else F.col("vault_name") == vault_name
    return store.commit({"files": store.table("files").withColumn("vlm_hash", F.when(~ours, F.col("vlm_hash")))})


def record_usage(store: Snapshots, kind: str, model_id: str, texts: int, *, limit: int | None = None) -> int:
    """Note a call of a service, and refuse it beyond ``limit`` calls of its kind in this month; the calls so far."""
    used = store.table("usage")
    n = used.where((F.col("kind") == kind) & (F.date_trunc("month", "ts") == F.date_trunc("month", F.current_timestamp()))).count()
    if limit is not None and n >= limit:
        raise PermissionError(f"{kind}: the month's {limit} calls are used up")
    one = store.spark.createDataFrame([(kind, model_id, texts)], "kind string, model_id string, texts long").withColumn("ts", F.current_timestamp())
    store.commit({"usage": used.unionByName(one)})
    return n + 1


def forget_files(store: Snapshots, gone: DataFrame) -> int:
    """Drop files from the cache alone, so that the next scan takes them for new."""
    return store.commit({"files": store.table("files").join(gone.select(*changes.KEY), changes.KEY, "left_anti")})


def migrate(store: Snapshots) -> int:
    """Bring an index of an older schema up to date: what older versions lack is derived from their chunks."""
    if not store.version() or store.manifest()["schema_version"] >= SCHEMA_VERSION:
        return store.version()
    made = search_tables(store.table("chunks"))
    return store.commit(made | {"stats": corpus_stats(made["lengths"])})


def embed(store: Snapshots, embedder, model_id: str, batch: int = 100) -> int:
    """Vectors for chunks that have none: ``embedder`` maps a list of texts to a list of vectors, ``batch`` texts at a time."""
    missing = store.table("chunks").join(store.table("vectors"), "chunk_id", "left_anti").select("chunk_id", "content", "vault_name", "file_path")

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                vectors = embedder(part["content"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("the embedder returned another number of vectors")
                yield part[["chunk_id"]].assign(embedding=vectors, vault_name=part["vault_name"], file_path=part["file_path"])

    made = missing.mapInPandas(run, "chunk_id long, embedding array<float>, vault_name string, file_path string")
    return store.commit({"vectors": store.table("vectors").unionByName(made), "files": store.table("files").withColumn("model_id", F.lit(model_id))})
