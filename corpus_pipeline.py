"""A corpus pipeline over the operators of notelake.llm: each stage's rows are written as Parquet and read by the next.

Stages keep the columns of ``documents`` (packing, the last, returns pieces). Rows without an id pass all filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm.common import fresh_path
from notelake.llm.queries import table, token_file


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on all labels, scores at their language's threshold or more (0.7 if it has none).

    Null and empty texts get the score of a text without words; repeated rows are judged one by one.
    """
    from notelake.llm.toxicity import fit, score

    model = fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    cut = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])[F.col("lang")] if model.thresholds else F.lit(0.7)
    return score(docs, model, out="__score").where(F.col("__score") < F.coalesce(cut, F.lit(0.7))).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: the one with the least id (no id comes last), then the least hash of its text.

    Rows with equal ids are judged one by one by their texts; of rows with equal ids and texts one stays. Null texts count
    as empty, and texts without words are near-duplicates of each other.
    """
    from notelake.llm.similar import similar

    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    kept = similar(docs).groupBy("component").agg(F.min(order).alias("m")).select("m.id", "m.hash")
    named = docs.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    found = named.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("hash")), "left_semi")
    return found.dropDuplicates(["doc_id", "__hash"]).drop("__hash")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item. Null and empty texts leak none; repeated rows are judged one by one."""
    from notelake.llm.decontamination import leaked_udf

    out = docs
    for leaked in leaked_udf(table(spark, sf_dir, "benchmark")):
        out = out.where(~leaked(F.col("text").cast("string")))
    return out


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays, null and empty texts as they are, repeated rows one by one."""
    from notelake.llm.secrets import Forest, redact, sample_findings

    return redact(docs, Forest.fit(sample_findings(spark)), path_col="source")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids. Null texts are empty; repeated rows are packed one by one."""
    from notelake.llm.packing import pack

    pieces = pack(docs, token_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]
#: Trained models, string tiling and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
