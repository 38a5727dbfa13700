"""Keyword search: an inverted index as tables, and BM25 over it with phrases, alternatives and filters.

Lower scores are better, as they are negative. Statistics are those of the whole corpus whatever the filters (so filters
come before the best are picked, and a page is never short: Q1). A phrase without terms is dropped (Q7); ``strict`` keeps
it, and then nothing matches.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import terms
from ..functions.tokens import TERM

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass
class TextIndex:
    """postings(term, chunk_id, tf, positions, dl) and stats(n_docs, avgdl), one row.

    A stored index has its postings sorted by term, so a query reads those of its terms. An index that is only built in
    a plan (``build``) has the chunks too, and a query looks for its terms in their rows without any shuffle of postings.
    """

    postings: DataFrame
    stats: DataFrame
    rows: DataFrame | None = None

    def hits(self, wanted: dict[str, str]) -> DataFrame:
        """(chunk_id, dl, places...) of the chunks that have one of the terms; ``wanted`` names each term's column."""
        none = F.array().cast("array<int>")
        one = lambda t: F.coalesce(F.max(F.when(F.col("term") == t, F.col("positions"))), none)
        return self.postings.where(F.col("term").isin(list(wanted))).groupBy("chunk_id").agg(F.max("dl").alias("dl"), *[one(t).alias(c) for t, c in wanted.items()])

    def counts(self, phrases: dict[tuple[str, ...], str]) -> tuple[DataFrame, DataFrame]:
        """(chunk_id, dl, counts...) of the chunks that have one of the phrases, and one row: n_docs, avgdl, and for each count the chunks that have it.

        ``phrases`` names each phrase's column of counts. Over rows, terms stand between spaces of their own in one
        string, which a pattern for each phrase goes through, so work is in proportion to the text.
        """
        some = functools.reduce(lambda x, y: x | y, [F.col(c) > 0 for c in phrases.values()])
        each = [F.sum((F.col(c) > 0).cast("long")).alias("n" + c) for c in phrases.values()]
        if self.rows is None:
            places = {t: f"p{i}" for i, t in enumerate(sorted({t for p in phrases for t in p}))}
            hits = self.hits(places).select("chunk_id", "dl", *[occurrences([F.col(places[t]) for t in p]).alias(c) for p, c in phrases.items()])
            return hits.where(some), hits.agg(*each).join(self.stats)

        def counted(rows: DataFrame) -> DataFrame:
            split = rows.select("chunk_id", terms(F.col("text")).alias("terms"))
            joined = split.select("chunk_id", F.size("terms").cast("long").alias("dl"), F.concat(F.lit(" "), F.array_join("terms", "  "), F.lit(" ")).alias("joined"))
            pattern = lambda p: f" {p[0]} " + (f"(?= {'  '.join(p[1:])} )" if p[1:] else "")
            found = [F.when(F.contains("joined", F.lit(f" {'  '.join(p)} ")), F.regexp_count("joined", F.lit(pattern(p)))).otherwise(0).alias(c) for p, c in phrases.items()]
            # a filter on the counts is not moved below a generator, so a text is gone through once
            return joined.select("chunk_id", F.inline(F.array(F.struct("dl", *found))))

        # a text without the letters of all terms of any phrase is not split into terms at all
        low = F.lower("text")
        letters = functools.reduce(lambda x, y: x | y, [functools.reduce(lambda x, y: x & y, [F.contains(low, F.lit(t)) for t in p]) for p in phrases])
        return counted(self.rows.where(letters)).where(some), counted(self.rows).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), *each)


def lengths(chunks: DataFrame, text: str = "content", key: str = "chunk_id", *extra: str) -> DataFrame:
    """(chunk_id, dl) and columns of the chunk, counted in place: lengths need no array of terms."""
    return chunks.select(F.col(key).alias("chunk_id"), F.regexp_count(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM)).cast("long").alias("dl"), *extra)


#: Terms that a task turns into postings at once, unless one chunk has more.
TERMS_AT_ONCE = 1 << 18


def postings(chunks: DataFrame, text: str = "content", key: str = "chunk_id", *extra: str) -> DataFrame:
    """(term, chunk_id, tf, positions, dl) and columns of the chunk. A chunk's terms are sorted where the chunk is, so nothing is shuffled."""
    own = chunks.select(F.col(key).alias("chunk_id"), *extra, terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    kinds = dict(own.dtypes)
    names = ["term", "chunk_id", "dl", *extra, "tf", "positions"]
    kind = {"term": "string", "dl": "bigint", "tf": "bigint", "positions": "array<int>"} | {c: kinds[c] for c in ("chunk_id", *extra)}

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes = b.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = b.column("terms").flatten().dictionary_encode()
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        both = row * len(words.dictionary) + code
        order = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.diff(both[order], prepend=-1))
        row, code = row[order][first], code[order][first]
        ends = np.append(first, len(order))
        made = {
            "term": words.dictionary.take(pa.array(code)).cast(pa.string()), "dl": pa.array(sizes[row]), "tf": pa.array(np.diff(ends)),
            "positions": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32())),
        }
        return pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c).take(pa.array(row)) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, lo = np.cumsum(b.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while lo < len(b):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TERMS_AT_ONCE, "right")))
                yield one(b.slice(lo, hi - lo))
                lo = hi

    return own.mapInArrow(run, ", ".join(f"`{c}` {kind[c]}" for c in names))


def build(chunks: DataFrame, text: str = "content", key: str = "chunk_id") -> TextIndex:
    """An index of the plan's own."""
    stats = lengths(chunks, text, key).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return TextIndex(postings(chunks, text, key), stats, chunks.select(F.col(key).alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))


def stored(postings: DataFrame, stats: DataFrame) -> TextIndex:
    """An index of tables: ``stats`` has a row (n_docs, terms) for each part."""
    return TextIndex(postings, stats.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), (F.sum("terms") / F.sum("n_docs")).alias("avgdl")))


def document_frequencies(index: TextIndex) -> DataFrame:
    """(term, df, tf) of all terms. Counts within a task come first, so few rows are dealt out and no postings are made."""
    if index.rows is None:
        return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    own = index.rows.select(terms(F.col("text")).alias("terms"))
    kind = lambda of, n: F.transform(of, lambda t: F.struct(t.alias("term"), F.lit(n).cast("long").alias("first")))
    both = own.select(F.explode(F.concat(kind(F.col("terms"), 0), kind(F.array_distinct("terms"), 1))).alias("t"))
    return both.groupBy("t.term").agg(F.sum("t.first").alias("df"), F.sum(1 - F.col("t.first")).alias("tf"))


def phrase_terms(phrase: str) -> list[str]:
    """Terms of a phrase, as the index has them."""
    return re.findall(r"[^\W_]+", phrase.lower())


def occurrences(positions: list[Column]) -> Column:
    """How often terms with these position arrays follow each other; a term has a position once."""
    back = lambda p, by: F.transform(p, lambda x: x - by)
    starts = [positions[0], *[back(p, i) for i, p in enumerate(positions[1:], 1)]]
    return F.coalesce(F.size(functools.reduce(F.array_intersect, starts)), F.lit(0))


def match(index: TextIndex, groups: list[list[str]], *, strict: bool = False) -> DataFrame:
    """(chunk_id, score) of the chunks that have a phrase of every group; every phrase of the query adds to the score."""
    parsed = [[phrase_terms(p) for p in g] for g in groups]
    if not strict:
        parsed = [g for g in ([p for p in g if p] for g in parsed) if g]
    phrases = [tuple(p) for g in parsed for p in g if p]
    if not phrases or any(not any(g) for g in parsed):
        return index.postings.where(F.lit(False)).select("chunk_id", F.lit(0.0).alias("score"))
    counts = {p: f"f{i}" for i, p in enumerate(dict.fromkeys(phrases))}
    hits, known = index.counts(counts)
    for g in parsed:
        any_of = F.lit(False)
        for p in g:
            any_of = any_of | (F.col(counts[tuple(p)]) > 0)
        hits = hits.where(any_of)
    rows = hits.join(F.broadcast(known))
    score = F.lit(0.0)
    for p in phrases:
        f, n = F.col(counts[p]), F.coalesce(F.col("n" + counts[p]), F.lit(0))
        idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - n + 0.5) / (n + 0.5)))
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("chunk_id", score.alias("score"))


def after(rank: float, row: int) -> Column:
    """What comes behind a row in the order of score and id."""
    return (F.col("score") > rank) | ((F.col("score") == rank) & (F.col("chunk_id") > row))


def best(hits: DataFrame, limit: int, *, descending: bool = False) -> DataFrame:
    """The first rows by score, ties by id."""
    return hits.orderBy(F.desc("score") if descending else F.asc("score"), "chunk_id").limit(limit)


def idf(n_docs: int, df: int) -> float:
    return max(LEAST_IDF, math.log((n_docs - df + 0.5) / (df + 0.5)))
