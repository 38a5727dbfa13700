"""Vector search: exact nearest neighbours by distance or cosine, pooling and quantisation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_column(q: Column | list[float]) -> Column:
    return q if isinstance(q, Column) else F.array(*[F.lit(float(x)) for x in q])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def nearest(vectors: DataFrame, query: Column | list[float], k: int, *, metric: str = "l2", where: Column | None = None, filter_after: bool = False) -> DataFrame:
    """(chunk_id, score) of the k nearest of ``vectors(chunk_id, embedding)``; ties by id.

    A filter comes before the k are picked, so that k are found; ``filter_after`` gives what is left of the k nearest.
    """
    q = as_column(query)
    score = euclidean(F.col("embedding"), q) if metric == "l2" else cosine(F.col("embedding"), q)
    rows = vectors if where is None or filter_after else vectors.where(where)
    rows = rows.withColumn("score", score).orderBy(F.asc("score") if metric == "l2" else F.desc("score"), "chunk_id").limit(k)
    rows = rows.where(where) if where is not None and filter_after else rows
    return rows.select("chunk_id", "score")


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, *, metric: str = "l2", block: int = 256) -> DataFrame:
    """(query_id, chunk_id, score, rank) for a stated set of queries, sent to the vectors in blocks.

    A block's scores stay within a batch of vectors, of which only each query's best k leave a task.
    """
    spark = vectors.sparkSession
    rows = queries.select("query_id", "embedding").orderBy("query_id").toLocalIterator()
    out, ids, qs = None, [], []

    def run(ids: list, qs: np.ndarray) -> DataFrame:
        held = spark.sparkContext.broadcast((ids, qs))

        def scan(batches):
            ids, qs = held.value
            kept = []
            for b in batches:
                if len(b):
                    x = np.stack(b["embedding"].to_numpy()).astype(float)
                    s = np.stack([np.sqrt(((x - q) ** 2).sum(1)) for q in qs]) if metric == "l2" else -(qs @ x.T) / np.maximum(np.outer(np.linalg.norm(qs, axis=1), np.linalg.norm(x, axis=1)), 1e-300)
                    n = b["chunk_id"].to_numpy()
                    for i, row in enumerate(s):
                        top = np.lexsort((n, row))[:k]
                        kept.append(pd.DataFrame({"query_id": ids[i], "chunk_id": n[top], "score": row[top]}))
                if len(kept) > 4 * len(ids):
                    kept = [pd.concat(kept).sort_values(["query_id", "score", "chunk_id"]).groupby("query_id").head(k)]
            if kept:
                yield pd.concat(kept).sort_values(["query_id", "score", "chunk_id"]).groupby("query_id").head(k)

        return vectors.select("chunk_id", "embedding").mapInPandas(scan, "query_id long, chunk_id long, score double")

    for r in rows:
        ids.append(r.query_id)
        qs.append(r.embedding)
        if len(ids) == block:
            out = run(ids, np.array(qs, float)) if out is None else out.union(run(ids, np.array(qs, float)))
            ids, qs = [], []
    if ids or out is None:
        part = run(ids, np.array(qs, float).reshape(len(ids), -1))
        out = part if out is None else out.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "chunk_id"))
    score = F.col("score") if metric == "l2" else -F.col("score")
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "chunk_id", score.alias("score"), "rank")


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the token vectors that the mask keeps, scaled to length 1; an empty mask gives zeros."""
    kept = F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda t: t["m"] != 0)
    total = F.aggregate(kept, F.transform(F.get(states, 0), lambda _: F.lit(0.0)), lambda s, t: F.zip_with(s, t["v"], lambda a, b: a + b.cast("double")))
    mean = F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
    return F.transform(mean, lambda x: x / F.when(norm(mean) == 0, F.lit(1.0)).otherwise(norm(mean)))


def sign_bits(vector: Column) -> Column:
    """Signs as a text of 0 and 1."""
    return F.array_join(F.transform(vector, lambda x: F.when(x > 0, F.lit("1")).otherwise(F.lit("0"))), "")


def hamming_similarity(a: Column, b: Column) -> Column:
    """Share of equal signs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) == (y > 0)).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(a), F.lit(1))


def half(vector: Column) -> Column:
    """Each component as the nearest half-precision number."""

    @F.pandas_udf("array<float>")
    def udf(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))

    return udf(vector)
