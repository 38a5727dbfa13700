"""Rank fusion, boosts and diversity.

Scores of the keyword and vector modes are better when lower, those of the hybrid mode when higher; each operator takes
the mode. Re-sorting keeps the earlier order of ties, which ``ord`` carries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import any_word_in

RRF_K, TITLE, EMPHASIS, BACKLINK, MOST_DIVERSE = 60, 0.3, 0.5, 0.05, 1000


def ranked(hits: DataFrame, *, descending: bool = False) -> DataFrame:
    """``hits(chunk_id, score)`` with rank from 1; hits are a best-k list, so one task may order them."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score") if descending else F.asc("score"), "chunk_id")))


def fuse(keyword: DataFrame, vector: DataFrame, limit: int, *, alpha: float | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists (chunk_id, rank); alpha, from 0 to 1, weighs the keyword list.

    A list of weight 0 adds nothing, but its rows stay.
    """
    a = None if alpha is None else min(1.0, max(0.0, alpha))
    weight = (1.0, 1.0) if a is None else (a, 1.0 - a)
    left, right = keyword.select("chunk_id", F.col("rank").alias("r1")), vector.select("chunk_id", F.col("rank").alias("r2"))
    part = lambda c, w: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    both = left.join(right, "chunk_id", "full_outer").select("chunk_id", (part("r1", weight[0]) + part("r2", weight[1])).alias("score"))
    return both.orderBy(F.desc("score"), "chunk_id").limit(limit)


def multiply(score, factor: float, mode: str):
    """Make a score better by a factor below 1."""
    if mode == "hybrid":
        return score / factor
    return F.when(score < 0, score / factor).otherwise(score * factor)


def boost(hits: DataFrame, query: str, mode: str) -> DataFrame:
    """Better scores where the title, and again where marked text, holds a word of the query."""
    if not query.split():
        return hits
    for column, factor in (("title", TITLE), ("emphasized_text", EMPHASIS)):
        s = F.col("score")
        hits = hits.withColumn("score", F.when(any_word_in(F.coalesce(column, F.lit("")), query), multiply(s, factor, mode)).otherwise(s))
    return hits


def backlink_boost(hits: DataFrame, counts: DataFrame, mode: str) -> DataFrame:
    """Better scores for files that others link to: ``counts(vault_name, file_path, backlink_count)``."""
    n = F.coalesce("backlink_count", F.lit(0)) * BACKLINK
    joined = hits.join(counts.select("vault_name", "file_path", "backlink_count"), ["vault_name", "file_path"], "left")
    return joined.withColumn("score", F.col("score") + n if mode == "hybrid" else F.col("score") - n).drop("backlink_count")


def order(hits: DataFrame, mode: str, tie: str = "chunk_id") -> DataFrame:
    """Best first; ties by ``tie``, which is ``ord`` where rows have an earlier order to keep."""
    return hits.orderBy(F.desc("score") if mode == "hybrid" else F.asc("score"), tie)


def diversify(hits: DataFrame, query: list[float], balance: float, limit: int) -> DataFrame:
    """Maximal marginal relevance over at most 1000 rows ``(chunk_id, ord, embedding, ...)``, in their order by ``ord``.

    ``balance`` from 0 (unlike each other) to 1 (like the query). Rows without a vector have no likeness. Beyond 1000 rows
    the order stays, and the limit holds all the same (Q26).
    """
    balance = min(1.0, max(0.0, balance))
    out = "chunk_id long, pick int"

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable").reset_index(drop=True)
        if len(rows) > MOST_DIVERSE or len(rows) < 2 or not query:
            return pd.DataFrame({"chunk_id": rows["chunk_id"], "pick": np.arange(1, len(rows) + 1)}).head(limit)
        size = len(query)
        x = np.array([np.zeros(size) if v is None else np.asarray(v, float) for v in rows["embedding"]])
        unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=-1, keepdims=True)) == 0, 1, n)
        x, q = unit(x), unit(np.asarray(query, float))
        like, close, left, got = x @ q, np.zeros(len(x)), np.ones(len(x), bool), []
        while len(got) < min(limit, len(x)):
            gain = np.where(left, balance * like - (1 - balance) * close, -np.inf)
            i = int(np.argmax(gain))
            got.append(i)
            left[i] = False
            close = np.maximum(close, x @ x[i])
        return pd.DataFrame({"chunk_id": rows["chunk_id"].to_numpy()[got], "pick": np.arange(1, len(got) + 1)})

    picks = hits.select("chunk_id", "ord", "embedding").orderBy("ord").limit(MOST_DIVERSE + 1 if limit <= MOST_DIVERSE else limit).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(pick, out)
    return hits.join(F.broadcast(picks), "chunk_id").orderBy("pick")
