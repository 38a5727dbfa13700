"""Ranked retrieval: one request, one plan.

Filters hold before the best are picked (Q1), the whole match set is scored (Q2), cursors compare final scores (Q3), and
diversity comes last (Q4). ``pool="reference"`` cuts each leg to its pool first and filters afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import snippets, tokens
from ..operators import bm25, ranking, vectors

MODES = ("fts", "vec", "hybrid")


@dataclass
class Request:
    query: str
    limit: int = 20
    mode: str = "hybrid"
    vault: str | None = None
    tag_filter: str | None = None
    since_date: str | None = None
    min_score: float | None = None
    fuzzy: bool = False
    user_dictionary: set[str] = field(default_factory=set)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    alpha: float | None = None
    mmr: bool = False
    mmr_lambda: float = 0.5
    backlinks: bool = True
    cursor: str | None = None
    pool: str = "all"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


@dataclass
class Output:
    results: DataFrame
    mode: str
    next_cursor: str | None = None


def groups(request: Request, tokenizer: tokens.Tokenizer = tokens.words) -> list[list[str]]:
    """The query as groups of alternatives; without tokens, its words."""
    found = tokens.collect(request.query, tokenizer)
    if request.fuzzy:
        found = [tokens.normalise(t) for t in found]
    found = tokens.merge_dictionary(found, request.user_dictionary) or request.query.split()
    return tokens.expand(found, request.synonyms)


def filtered(chunks: DataFrame, request: Request) -> DataFrame:
    if request.vault:
        chunks = chunks.where(F.col("vault_name") == request.vault)
    if request.tag_filter:
        chunks = chunks.where(C.tag_matches(F.col("tags"), request.tag_filter))
    if request.since_date:
        chunks = chunks.where(C.date_matches(F.col("frontmatter_date"), request.since_date))
    return chunks


def search(chunks: DataFrame, index: bm25.TextIndex, request: Request, *, vector_table: DataFrame | None = None, files: DataFrame | None = None, query_vector: list[float] | None = None, tokenizer: tokens.Tokenizer = tokens.words) -> Output:
    """Best chunks for a request. Without a query vector the hybrid mode falls back to keywords, and the vector mode fails."""
    has_vector = vector_table is not None and query_vector is not None
    mode = "fts" if request.mode == "hybrid" and not has_vector else request.mode
    if mode == "vec" and not has_vector:
        raise ValueError("vector search needs a query vector")
    if not request.query.strip():
        return Output(chunks.where(F.lit(False)).withColumn("score", F.lit(0.0)), mode)
    late = request.pool == "reference"
    rows = chunks if late else filtered(chunks, request)
    diverse = request.mmr and mode != "fts"
    wanted = request.limit + 1 if mode == "fts" else request.limit * (3 if diverse else 1)

    def dressed(hits: DataFrame, how: str) -> DataFrame:
        return ranking.boost(hits.join(rows, "chunk_id"), request.query, how)

    def keywords(n: int) -> DataFrame:
        hits = bm25.match(index, groups(request, tokenizer))
        if request.vault:
            hits = hits.join(chunks.where(F.col("vault_name") == request.vault).select("chunk_id"), "chunk_id", "left_semi")
        return dressed(bm25.best(hits, n) if late else hits, "fts")

    def nearest(n: int) -> DataFrame:
        pool = vector_table.select("chunk_id", "embedding").join(rows.select("chunk_id"), "chunk_id", "left_semi")
        return dressed(vectors.nearest(pool, query_vector, n), "vec")

    if mode == "hybrid":
        left = bm25.best(keywords(request.limit * 2).select("chunk_id", "score"), request.limit * 2)
        right = bm25.best(nearest(wanted).select("chunk_id", "score"), wanted)
        hits = dressed(ranking.fuse(ranking.ranked(left), ranking.ranked(right), max(wanted, request.limit), alpha=request.alpha).transform(lambda h: h if request.min_score is None else h.where(F.col("score") >= request.min_score)), "hybrid")
    else:
        hits = keywords(wanted) if mode == "fts" else nearest(wanted)
        if request.min_score is not None:
            hits = hits.where(F.col("score") <= request.min_score)
    if late:
        hits = filtered(hits, request)
    if request.backlinks and files is not None:
        counts = files.select("vault_name", F.col("path").alias("file_path"), "backlink_count")
        hits = ranking.backlink_boost(hits, counts, mode)
    if diverse:
        ordered = bm25.best(hits, wanted, descending=mode == "hybrid").join(vector_table.select("chunk_id", "embedding"), "chunk_id", "left")
        ordered = ordered.withColumn("ord", F.row_number().over(ranking.Window.orderBy(F.desc("score") if mode == "hybrid" else F.asc("score"), "chunk_id")))
        return Output(ranking.diversify(ordered, query_vector, request.mmr_lambda, request.limit).drop("embedding", "ord", "pick"), mode)
    at = snippets.decode_cursor(request.cursor) if request.cursor and mode == "fts" else None
    if at:
        hits = hits.where(bm25.after(*at))
    page = bm25.best(hits, wanted if mode == "fts" else request.limit, descending=mode == "hybrid").withColumn("search_mode", F.lit(mode))
    if mode != "fts":
        return Output(page, mode)
    # a page has one row more than asked for if another page follows
    shown = page.select("score", "chunk_id").collect()
    more = len(shown) > request.limit
    cursor = snippets.encode_cursor(shown[request.limit - 1].score, shown[request.limit - 1].chunk_id) if more else None
    return Output(page.limit(request.limit), mode, cursor)


def count(chunks: DataFrame, index: bm25.TextIndex, request: Request, tokenizer: tokens.Tokenizer = tokens.words) -> int:
    """Matches of a request with its filters and synonyms (Q16)."""
    return bm25.match(index, groups(request, tokenizer)).join(filtered(chunks, request), "chunk_id", "left_semi").count()
