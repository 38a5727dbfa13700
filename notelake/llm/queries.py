"""The registered queries of this subpackage; each applies its operator to its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_filter import sql as url_filter_sql


def token_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), token_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    cut = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])[F.col("lang")] if model.thresholds else F.lit(0.7)
    scored = score(docs.select("doc_id", "text", "lang"), model, out="score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.coalesce(cut, F.lit(0.7)).alias("language_threshold"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fresh_path
    from .token_files import read, write

    path = fresh_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), token_file("byte_bpe_50k.json"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: The rules of op9 (fixed values).
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import Forest, sample_findings, scan

    return scan(table(spark, sf_dir, "documents"), Forest.fit(sample_findings(spark)), path_col="source")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kmeans_tree import search

    return search(table(spark, sf_dir, "embeddings"), every=100)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score

    return score(table(spark, sf_dir, "documents"), held_out=lambda i: zlib.crc32(str(i).encode()) % 10 == 0)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash": op4_simhash,
    "op5_neighbours": op5_neighbours,
    "op6_toxicity": op6_toxicity,
    "op7_token_ids": op7_token_ids,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_suffix_tree": op10_suffix_tree,
}
ORACLES = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
k AS (SELECT *, string_agg(word, ' ') OVER n AS run, count(*) OVER n AS size FROM t WINDOW n AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT *, size = 20 AND row_number() OVER (PARTITION BY run, size ORDER BY doc_id, pos) > 1 AS again FROM k),
g AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)""",
    "op9_url_filter": url_filter_sql(URL_RULES),
}
