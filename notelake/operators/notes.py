"""Relational views over the tables of an index: links, tags, tasks, statistics, context, listings, retention, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ascii_lower

#: Directory names that rarely hold notes (fixed values).
NOISE = (
    "node_modules", "dist", "build", "target", ".next", ".cache", "__pycache__", "vendor", ".venv", "env", "venv", ".env", "out", "artifacts", "tmp", "temp",
    "generated", "public", "static", "uploads", "backups", "archive", "archived", "old", "deprecated", "templates", "includes", "layouts", "partials",
)
DAY_MS = 86_400_000


def stem(path: Column) -> Column:
    """File name without its directories and last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def stem_paths(files: DataFrame) -> DataFrame:
    """(vault_name, stem, path): of each stem in lower case the shortest path by bytes, ties in alphabetical order."""
    notes = files.where(F.col("path").endswith(".md"))
    return notes.groupBy("vault_name", F.lower(stem(F.col("path"))).alias("stem")).agg(F.min_by("path", F.struct(F.octet_length("path"), "path")).alias("path"))


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links(vault_name, source, name)`` as distinct (vault_name, source, target); names without a file are gone."""
    paths = stem_paths(files).withColumnRenamed("path", "target")
    return links.withColumn("stem", F.lower("name")).join(paths, ["vault_name", "stem"]).select("vault_name", "source", "target").distinct()


def backlink_counts(files: DataFrame, links: DataFrame) -> DataFrame:
    """``files`` with backlink_count, 0 where nothing links."""
    n = links.groupBy("vault_name", F.col("target").alias("path")).agg(F.count("*").alias("backlink_count"))
    return files.drop("backlink_count").join(n, ["vault_name", "path"], "left").withColumn("backlink_count", F.coalesce("backlink_count", F.lit(0)))


def path_counts(files: DataFrame) -> DataFrame:
    """(vault_name, n): distinct paths of each vault."""
    return files.groupBy("vault_name").agg(F.count_distinct("path").alias("n"))


def tag_counts(chunks: DataFrame) -> DataFrame:
    """(vault_name, tag, count): each occurrence in each chunk's list counts."""
    spread = chunks.select("vault_name", F.explode(F.split("tags", ",")).alias("tag")).select("vault_name", F.trim("tag").alias("tag"))
    return spread.where("tag <> ''").groupBy("vault_name", "tag").agg(F.count("*").alias("count"))


def top_tags(counts: DataFrame, n: int) -> DataFrame:
    return counts.where("count > 0").orderBy(F.desc("count"), "tag", "vault_name").limit(n)


def tags_of_files(chunks: DataFrame) -> DataFrame:
    """(vault_name, file_path, tags): the lists of a file's chunks one after the other."""
    lists = F.array_sort(F.collect_list(F.when(F.col("tags") != "", F.struct("chunk_index", "tags"))))
    return chunks.groupBy("vault_name", "file_path").agg(F.array_join(F.transform(lists, lambda x: x["tags"]), ",").alias("tags"))


def find_tasks(tasks: DataFrame, keyword: str | None = None, include_checked: bool = False) -> DataFrame:
    """Tasks whose text is like the keyword (ASCII letters in any case; % and _ are wildcards), in order of place."""
    rows = tasks if include_checked else tasks.where(~F.col("checked"))
    if keyword:
        rows = rows.where(ascii_lower(F.col("content")).like(f"%{keyword.translate(str.maketrans('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))}%"))
    return rows.orderBy("vault_name", "file_path", "line_number")


def statistics(chunks: DataFrame, files: DataFrame, vectors: DataFrame, top: int = 10) -> DataFrame:
    """One row: total_chunks, total_files, vec_indexed_chunks, total_chars, total_size, last_indexed_at, top_tags."""
    tags = top_tags(tag_counts(chunks), top).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "tag", "count"))).alias("t"))
    one = chunks.agg(F.count("*").alias("total_chunks")).join(vectors.agg(F.count("*").alias("vec_indexed_chunks")))
    of_files = files.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("total_chars"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.max("mtime_ms").alias("last_indexed_at"))
    return one.join(of_files).join(tags.select(F.transform("t", lambda x: F.struct(x["tag"].alias("tag"), x["count"].alias("count"))).alias("top_tags")))


def dominant_model(files: DataFrame) -> DataFrame:
    """The model of most files, ties in alphabetical order; none without models."""
    return files.where("model_id <> 'none'").groupBy("model_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model_id").limit(1)


def char_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("vault_name", "file_path").agg(F.sum(F.char_length("content")).alias("char_count"))


def documents(chunks: DataFrame) -> DataFrame:
    """(vault_name, file_path, text): the chunks of a file in order, by lines."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("vault_name", "file_path").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("text"))


def surrounding(chunks: DataFrame, selected: DataFrame, window: int = 2, most: int = 5) -> DataFrame:
    """Chunks up to ``window`` places from the selected ones ``(vault_name, file_path, chunk_index)`` in their files."""
    w = min(max(window, 0), most)
    # each selected place names its neighbours, so the join is by equal keys
    near = selected.select("vault_name", "file_path", F.col("chunk_index").alias("centre"), F.explode(F.sequence(F.col("chunk_index") - w, F.col("chunk_index") + w)).alias("chunk_index"))
    return chunks.join(near, ["vault_name", "file_path", "chunk_index"]).withColumn("selected", F.col("chunk_index") == F.col("centre"))


def page(rows: DataFrame, order: list[str], limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    return rows.orderBy(*order).offset(min(max(offset, 0), 10_000)).limit(min(max(limit, 0), most))


def expired(files: DataFrame, retention_days: dict[str, int], now_ms: int) -> DataFrame:
    """Files that are older than their vault keeps them; other vaults keep all."""
    if not retention_days:
        return files.where(F.lit(False))
    days = F.create_map(*[F.lit(x) for pair in sorted(retention_days.items()) for x in pair])[F.col("vault_name")]
    return files.where(F.col("mtime_ms") < F.lit(now_ms) - days.cast("long") * DAY_MS)


def orphans(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors whose chunk is gone."""
    return vectors.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def noisy_directories(files: DataFrame, threshold: int, limit: int = 1000) -> DataFrame:
    """(directory, count, known): directories of noise by name, or with as many files as the threshold."""
    directory = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    counted = files.groupBy(directory.alias("directory")).agg(F.count("*").alias("count"))
    known = F.element_at(F.split("directory", "/"), -1).isin(*NOISE)
    return counted.withColumn("known", known).where(F.col("known") | (F.col("count") >= threshold)).orderBy(F.desc("count"), "directory").limit(limit)
