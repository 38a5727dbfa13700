"""The pure functions for SQL: ``register(spark)`` makes them callable by name, texts to Python in Arrow batches.

``notelake_normalise``, ``notelake_tokens``, ``notelake_snippet``, ``notelake_highlight``, ``notelake_match`` and
``notelake_cosine`` are functions of a row; ``notelake_chunks`` and ``notelake_tasks`` are table functions for LATERAL joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import markdown, snippets, tokens

CHUNK = "chunk_index int, parent_header string, content string, title string, tags string, frontmatter_date string"
TASK = "content string, checked boolean, line_number int"


class Chunks:
    def eval(self, text: str):
        for c in markdown.chunks(text or ""):
            yield tuple(c[k.split()[0]] for k in CHUNK.split(", "))


class Tasks:
    def eval(self, text: str):
        yield from markdown.tasks(text or "")


def each(f, *columns: pd.Series) -> pd.Series:
    """f of each row; null where any argument is."""
    return pd.Series([None if any(x is None for x in row) else f(*row) for row in zip(*columns)], dtype=object)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL."""

    @F.pandas_udf("string")
    def normalise(text: pd.Series) -> pd.Series:
        return each(tokens.normalise, text)

    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return each(lambda t: tokens.tokenised(t).split(), text)

    @F.pandas_udf("string")
    def snippet(text: pd.Series, query: pd.Series, lines: pd.Series, chars: pd.Series) -> pd.Series:
        return each(lambda t, q, n, m: snippets.snippet(t, q, int(n), int(m)), text, query, lines, chars)

    @F.pandas_udf("string")
    def highlight(text: pd.Series, query: pd.Series) -> pd.Series:
        return each(snippets.highlight, text, query)

    @F.pandas_udf("string")
    def match(query: pd.Series) -> pd.Series:
        return each(lambda q: tokens.match_string(tokens.expand(tokens.collect(q), {})), query)

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            size = float((x @ x) ** 0.5 * (y @ y) ** 0.5)
            return float(x @ y) / size if size else 0.0

        return each(one, a, b).astype("float64")

    for name, f in (("normalise", normalise), ("tokens", found), ("snippet", snippet), ("highlight", highlight), ("match", match), ("cosine", cosine)):
        spark.udf.register(f"notelake_{name}", f)
    spark.udtf.register("notelake_chunks", F.udtf(Chunks, returnType=CHUNK))
    spark.udtf.register("notelake_tasks", F.udtf(Tasks, returnType=TASK))
