"""One query for each operator, over the test tables, and the SQL that says the same.

A document is a note of one chunk: its language is the vault, ``source/doc_id.md`` the path. Notes with Markdown in them
are built from ``part`` by one expression that both engines read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import tokens
from .operators import bm25, changes, limits, notes, pdf, ranking, vectors
from .plans.index import chunk_rows, search_tables, update
from .plans.search import Request, search
from .sources.snapshot import Snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- notes ---------------------------------------------------------------------------------------------------------

#: Documents as chunks; the same text in both engines.
DOC = "doc_id AS chunk_id, lang AS vault_name, source || '/' || CAST(doc_id AS STRING) || '.md' AS file_path, text AS content, source || ', t' || CAST(doc_id % 7 AS STRING) AS tags, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '2024-0' || CAST(1 + doc_id % 9 AS STRING) || '-01' END AS frontmatter_date, substr(text, 1, 12) AS title"
NOTE = (
    "'---' || chr(10) || 'title: ' || p_name || chr(10) || 'tags: [' || p_brand || ', t' || CAST(p_size % 5 AS STRING) || ']' || chr(10) || 'date: 2024-0' || CAST(1 + p_size % 9 AS STRING) || '-15' || chr(10) || '---' || chr(10)"
    " || '# ' || p_type || chr(10) || 'Made by ==' || p_brand || '== as **' || p_name || '** for [[' || CAST((p_partkey * 7) % 500 AS STRING) || '|other]] and [[' || CAST(p_partkey % 10 AS STRING) || '#top]]' || chr(10)"
    " || '- [ ] order ' || p_name || chr(10) || '- [x] ship ' || CAST(p_size AS STRING) || chr(10) || '## Notes' || chr(10) || 'Size ' || CAST(p_size AS STRING) || ' of ' || p_type"
)
NOTE_KEYS = "'v' || CAST(p_size % 3 AS STRING) AS vault_name, 'p/' || CAST(p_partkey AS STRING) || '.md' AS path"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "documents").createOrReplaceTempView("__documents")
    return spark.sql(f"SELECT {DOC} FROM __documents").withColumn("emphasized_text", C.emphasised(F.col("content")))


def made(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "part").createOrReplaceTempView("__part")
    return spark.sql(f"SELECT {NOTE_KEYS}, {NOTE} AS text, CAST(p_partkey AS BIGINT) AS part FROM __part")


MADE = f"(SELECT {NOTE_KEYS}, {NOTE} AS text, CAST(p_partkey AS BIGINT) AS part FROM part)"
DOCS = f"(SELECT {DOC} FROM documents)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- keyword search ------------------------------------------------------------------------------------------------

TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
TOK = f"tok AS (SELECT doc_id AS chunk_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM (SELECT doc_id, {TERMS} AS ts FROM documents))"
LEN = f"len AS (SELECT doc_id AS chunk_id, len({TERMS}) AS dl FROM documents), st AS (SELECT count(*) AS n, avg(dl) AS a FROM len)"


def bm25_sql(groups: list[list[str]], final: str) -> str:
    """``final`` reads s(chunk_id, score)."""
    phrases = list(dict.fromkeys(p for g in groups for p in g))
    f = {}
    for i, p in enumerate(phrases):
        ws = bm25.phrase_terms(p)
        joins = "".join(f" JOIN tok t{j} ON t{j}.chunk_id = t0.chunk_id AND t{j}.pos = t0.pos + {j} AND t{j}.term = '{w}'" for j, w in enumerate(ws[1:], 1))
        f[p] = f"f{i} AS (SELECT t0.chunk_id, count(*) AS f FROM tok t0{joins} WHERE t0.term = '{ws[0]}' GROUP BY 1)"
    part = lambda i: f"greatest(1e-6, ln((n - (SELECT count(*) FROM f{i}) + 0.5) / ((SELECT count(*) FROM f{i}) + 0.5))) * coalesce(f{i}.f, 0) * 2.2 / (coalesce(f{i}.f, 0) + 1.2 * (0.25 + 0.75 * dl / a))"
    score = " - ".join(["0.0"] + [part(phrases.index(p)) for g in groups for p in g])
    where = " AND ".join("(" + " OR ".join(f"f{phrases.index(p)}.f IS NOT NULL" for p in g) + ")" for g in groups)
    joins = "".join(f" LEFT JOIN f{i} ON f{i}.chunk_id = len.chunk_id" for i in range(len(phrases)))
    return f"WITH {TOK}, {LEN}, {', '.join(f.values())}, s AS (SELECT len.chunk_id, {score} AS score FROM len CROSS JOIN st{joins} WHERE {where}) {final}"


AND, PHRASE, EITHER = [["der"], ["und"]], [["of the"]], [["la", "les"], ["de"]]
TOP10 = "SELECT chunk_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score, chunk_id LIMIT 10)"


def text_index(spark: SparkSession, sf: str) -> bm25.TextIndex:
    return bm25.build(table(spark, sf, "documents"), "text", "doc_id")


def top10(hits: DataFrame) -> DataFrame:
    return rounded(bm25.best(hits, 10).select("chunk_id", "score"), "score")


@query(bm25_sql(AND, TOP10))
def fts_and_top10(spark, sf):
    return top10(bm25.match(text_index(spark, sf), AND))


@query(bm25_sql([["queen"]], TOP10))
def fts_single(spark, sf):
    return top10(bm25.match(text_index(spark, sf), [["queen"]]))


@query(bm25_sql(PHRASE, TOP10))
def fts_phrase(spark, sf):
    return top10(bm25.match(text_index(spark, sf), PHRASE))


@query(bm25_sql(EITHER, TOP10))
def fts_synonym_or(spark, sf):
    return top10(bm25.match(text_index(spark, sf), tokens.expand(["la", "de"], {"la": ["les"]})))


@query(bm25_sql(AND, f"SELECT chunk_id, round(score, 6) AS score FROM (SELECT s.* FROM s JOIN {DOCS} d USING (chunk_id) WHERE vault_name = 'de' ORDER BY score, chunk_id LIMIT 10)"))
def fts_vault_filter(spark, sf):
    own = docs(spark, sf).where("vault_name = 'de'").select("chunk_id")
    return top10(bm25.match(text_index(spark, sf), AND).join(own, "chunk_id", "left_semi"))


@query(bm25_sql(AND, "SELECT count(*) AS n FROM s"))
def fts_count(spark, sf):
    return bm25.match(text_index(spark, sf), AND).agg(F.count("*").alias("n"))


@query(bm25_sql([["the"]], "SELECT chunk_id, round(score * 1000000, 4) AS score FROM (SELECT * FROM s ORDER BY score, chunk_id LIMIT 10)"))
def fts_idf_floor(spark, sf):
    return bm25.best(bm25.match(text_index(spark, sf), [["the"]]), 10).select("chunk_id", F.round(F.col("score") * 1_000_000, 4).alias("score"))


@query(bm25_sql(AND, "SELECT chunk_id, round(score, 6) AS score FROM s WHERE score <= -2.0"))
def fts_min_score(spark, sf):
    return rounded(bm25.match(text_index(spark, sf), AND).where("score <= -2.0").select("chunk_id", "score"), "score")


@query(bm25_sql(AND, f"SELECT chunk_id, round(score, 6) AS score FROM (SELECT s.* FROM s JOIN {DOCS} d USING (chunk_id) WHERE list_contains(list_transform(string_split(tags, ','), lambda t: lower(trim(t))), 't3') ORDER BY score, chunk_id LIMIT 10)"))
def fts_tag_filter(spark, sf):
    own = docs(spark, sf).where(C.tag_matches(F.col("tags"), " T3 ")).select("chunk_id")
    return top10(bm25.match(text_index(spark, sf), AND).join(own, "chunk_id", "left_semi"))


@query(bm25_sql(AND, f"SELECT chunk_id, round(score, 6) AS score FROM (SELECT s.* FROM s JOIN {DOCS} d USING (chunk_id) WHERE frontmatter_date = '' OR frontmatter_date >= '2024-05' ORDER BY score, chunk_id LIMIT 10)"))
def fts_since(spark, sf):
    own = docs(spark, sf).where(C.date_matches(F.col("frontmatter_date"), "2024-05")).select("chunk_id")
    return top10(bm25.match(text_index(spark, sf), AND).join(own, "chunk_id", "left_semi"))


BOOSTED = "CASE WHEN contains(lower(title), 'der') OR contains(lower(title), 'und') THEN (CASE WHEN score < 0 THEN score / 0.3 ELSE score * 0.3 END) ELSE score END"


@query(bm25_sql(AND, f"SELECT chunk_id, round(score, 6) AS score FROM (SELECT chunk_id, {BOOSTED} AS score FROM s JOIN {DOCS} d USING (chunk_id) ORDER BY 2, 1 LIMIT 10)"))
def fts_title_boost(spark, sf):
    rows = bm25.match(text_index(spark, sf), AND).join(docs(spark, sf).withColumn("emphasized_text", F.lit("")), "chunk_id")
    return top10(ranking.boost(rows, "der und", "fts"))


EMPHASIS_SQL = "array_to_string(list_filter(list_transform(regexp_extract_all(text, '(?s)==.*?==|\\*\\*[^*].*?\\*\\*|\\*\\*\\*\\*'), lambda m: trim(m[3:-3])), lambda m: m <> ''), ' ')"


@query(bm25_sql([["the"]], "SELECT chunk_id, round(score * 1000000, 4) AS score FROM (SELECT chunk_id, CASE WHEN contains(text, '**') AND contains(lower(e), 'the') THEN score / 0.5 ELSE score END AS score FROM s JOIN (SELECT doc_id AS chunk_id, text, " + EMPHASIS_SQL + " AS e FROM documents) USING (chunk_id) ORDER BY 2, 1 LIMIT 10)"))
def fts_emphasis_boost(spark, sf):
    rows = bm25.match(text_index(spark, sf), [["the"]]).join(docs(spark, sf).withColumn("title", F.lit("")), "chunk_id")
    return bm25.best(ranking.boost(rows, "the", "fts"), 10).select("chunk_id", F.round(F.col("score") * 1_000_000, 4).alias("score"))


@query(bm25_sql(AND, "SELECT chunk_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score, chunk_id LIMIT 10 OFFSET 10)"))
def fts_keyset_page2(spark, sf):
    chunks, index = docs(spark, sf), text_index(spark, sf)
    request = {"query": "der und", "limit": 10, "mode": "fts"}
    plain = chunks.withColumn("title", F.lit("")).withColumn("emphasized_text", F.lit(""))
    first = search(plain, index, Request(**request), tokenizer=tokens.whitespace)
    return rounded(search(plain, index, Request(**request, cursor=first.next_cursor), tokenizer=tokens.whitespace).results.select("chunk_id", "score"), "score")


@query(f"WITH {TOK} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM tok GROUP BY 1")
def term_stats(spark, sf):
    return bm25.document_frequencies(text_index(spark, sf))


@query(f"WITH {LEN} SELECT n AS n_docs, round(a, 6) AS avgdl FROM st")
def corpus_stats(spark, sf):
    return rounded(text_index(spark, sf).stats, "avgdl")


@query(f"WITH {TOK} SELECT term, chunk_id, count(*) AS tf, min(pos) - 1 AS first_position FROM tok GROUP BY 1, 2")
def postings(spark, sf):
    return text_index(spark, sf).postings.select("term", "chunk_id", "tf", F.array_min("positions").alias("first_position"))


# --- vectors and fusion --------------------------------------------------------------------------------------------


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").first().embedding]


Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
L2 = "list_distance(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))"
COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))"


@query(f"SELECT vec_id AS chunk_id, round({L2}, 6) AS score FROM embeddings, {Q} ORDER BY {L2}, vec_id LIMIT 10")
def knn_l2(spark, sf):
    return rounded(vectors.nearest(embedded(spark, sf), first_vector(spark, sf), 10), "score")


@query(f"SELECT vec_id AS chunk_id, round({COS}, 6) AS score FROM embeddings, {Q} ORDER BY {COS} DESC, vec_id LIMIT 10")
def knn_cosine(spark, sf):
    return rounded(vectors.nearest(embedded(spark, sf), first_vector(spark, sf), 10, metric="cosine"), "score")


@query(f"SELECT vec_id AS chunk_id, round({L2}, 6) AS score FROM embeddings, {Q} WHERE label = 3 ORDER BY {L2}, vec_id LIMIT 10")
def knn_filtered(spark, sf):
    return rounded(vectors.nearest(embedded(spark, sf), first_vector(spark, sf), 10, where=F.col("label") == 3), "score")


@query(f"SELECT chunk_id, round(score, 6) AS score FROM (SELECT vec_id AS chunk_id, label, {L2} AS score FROM embeddings, {Q} ORDER BY 3, 1 LIMIT 50) WHERE label = 3")
def knn_filter_after(spark, sf):
    return rounded(vectors.nearest(embedded(spark, sf), first_vector(spark, sf), 50, where=F.col("label") == 3, filter_after=True), "score")


@query("SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) WHERE rank <= 5")
def knn_batch(spark, sf):
    e = embedded(spark, sf)
    asked = e.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return rounded(vectors.nearest_of_each(e, asked, 5), "score")


LEGS = f"k AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS r1 FROM s QUALIFY r1 <= 20), v AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY {L2}, vec_id) AS r2 FROM embeddings, {Q} QUALIFY r2 <= 20)"


def fused_sql(a: str, b: str, final: str = "SELECT chunk_id, round(score, 6) AS score FROM (SELECT * FROM f ORDER BY score DESC, chunk_id LIMIT 10)") -> str:
    return bm25_sql([["the"], ["of"]], f", {LEGS}, f AS (SELECT chunk_id, coalesce({a} / (60 + r1), 0) + coalesce({b} / (60 + r2), 0) AS score FROM k FULL OUTER JOIN v USING (chunk_id)) {final}").replace(") , k AS", "), k AS")


def legs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    left = bm25.best(bm25.match(text_index(spark, sf), [["the"], ["of"]]), 20)
    return ranking.ranked(left), ranking.ranked(vectors.nearest(embedded(spark, sf), first_vector(spark, sf), 20))


@query(fused_sql("1.0", "1.0"))
def rrf(spark, sf):
    return rounded(ranking.fuse(*legs(spark, sf), 10), "score")


@query(fused_sql("0.7", "0.3"))
def rrf_weighted(spark, sf):
    return rounded(ranking.fuse(*legs(spark, sf), 10, alpha=0.7), "score")


@query(fused_sql("0.0", "1.0", "SELECT chunk_id, round(score, 6) AS score FROM (SELECT * FROM f ORDER BY score DESC, chunk_id LIMIT 40)"))
def rrf_one_sided(spark, sf):
    return rounded(ranking.fuse(*legs(spark, sf), 40, alpha=0.0), "score")


@query(fused_sql("0.5", "0.5").replace("QUALIFY r2 <= 20", "WHERE vec_id IN (SELECT doc_id FROM documents) QUALIFY r2 <= 10"))
def hybrid(spark, sf):
    # titles and marks are empty, so no boost changes the legs; documents without a vector come from keywords alone
    chunks = docs(spark, sf).withColumn("title", F.lit("")).withColumn("emphasized_text", F.lit(""))
    request = Request("the of", limit=10, alpha=0.5, backlinks=False)
    out = search(chunks, text_index(spark, sf), request, vector_table=embedded(spark, sf).select("chunk_id", "embedding"), query_vector=first_vector(spark, sf), tokenizer=tokens.whitespace)
    return rounded(out.results.select("chunk_id", "score"), "score")


TITLED = "contains(lower(title), 'the') OR contains(lower(title), 'of')"


@query(bm25_sql([["the"], ["of"]], f", b AS (SELECT chunk_id, CASE WHEN {TITLED} THEN (CASE WHEN score < 0 THEN score / 0.3 ELSE score * 0.3 END) ELSE score END AS score FROM s JOIN {DOCS} d USING (chunk_id)), k AS (SELECT chunk_id, row_number() OVER (ORDER BY score, chunk_id) AS r1 FROM b QUALIFY r1 <= 20), n AS (SELECT vec_id AS chunk_id, title, {L2} AS l2 FROM embeddings JOIN {DOCS} d ON d.chunk_id = vec_id, {Q} ORDER BY l2, 1 LIMIT 10), v AS (SELECT chunk_id, row_number() OVER (ORDER BY CASE WHEN {TITLED} THEN l2 * 0.3 ELSE l2 END, chunk_id) AS r2 FROM n), f AS (SELECT chunk_id, coalesce(1.0 / (60 + r1), 0) + coalesce(1.0 / (60 + r2), 0) AS score FROM k FULL OUTER JOIN v USING (chunk_id) ORDER BY 2 DESC, 1 LIMIT 10) SELECT chunk_id, round(CAST(CASE WHEN {TITLED} THEN score / 0.3 ELSE score END + 0.05 * (chunk_id % 5) AS DOUBLE), 6) AS score FROM f JOIN {DOCS} d USING (chunk_id)").replace(") , b AS", "), b AS"))
def hybrid_boosted(spark, sf):
    """Boosts of titles in both legs and after fusion, and of backlinks at the end."""
    chunks = docs(spark, sf).withColumn("emphasized_text", F.lit(""))
    linked = chunks.select("vault_name", F.col("file_path").alias("path"), (F.col("chunk_id") % 5).alias("backlink_count"))
    out = search(chunks, text_index(spark, sf), Request("the of", limit=10), vector_table=embedded(spark, sf).select("chunk_id", "embedding"), files=linked, query_vector=first_vector(spark, sf), tokenizer=tokens.whitespace)
    return rounded(out.results.select("chunk_id", "score"), "score")


@query(bm25_sql(AND, f"SELECT chunk_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score, chunk_id LIMIT 41) JOIN {DOCS} d USING (chunk_id) WHERE list_contains(list_transform(string_split(tags, ','), lambda t: lower(trim(t))), 't3') ORDER BY score, chunk_id LIMIT 40"))
def fts_pool_reference(spark, sf):
    """The other reading of filters: the best are picked first, then filtered, so a page may be short."""
    chunks = docs(spark, sf).withColumn("title", F.lit("")).withColumn("emphasized_text", F.lit(""))
    out = search(chunks, text_index(spark, sf), Request("der und", limit=40, mode="fts", tag_filter="t3", pool="reference"), tokenizer=tokens.whitespace)
    return rounded(out.results.select("chunk_id", "score"), "score")


def mmr_sql(picks: int, balance: float) -> str:
    cos = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
    pool = f"c AS (SELECT vec_id, embedding, {COS} AS s, row_number() OVER (ORDER BY {L2}, vec_id) AS ord FROM embeddings, {Q} QUALIFY ord <= 30)"
    steps = [f"p1 AS (SELECT vec_id, embedding, 1 AS pick FROM c ORDER BY {balance} * s DESC, ord LIMIT 1)"]
    for i in range(2, picks + 1):
        past = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, i))
        steps.append(f"g{i} AS (SELECT a.vec_id, max({cos}) AS near FROM c a, ({past}) b GROUP BY 1), p{i} AS (SELECT c.vec_id, embedding, {i} AS pick FROM c JOIN g{i} USING (vec_id) WHERE vec_id NOT IN (SELECT vec_id FROM ({past})) ORDER BY {balance} * s - {1 - balance} * greatest(0, near) DESC, ord LIMIT 1)")
    return f"WITH {pool}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT vec_id AS chunk_id, pick FROM p{i}" for i in range(1, picks + 1))


@query(mmr_sql(5, 0.25))
def mmr(spark, sf):
    e = embedded(spark, sf)
    pool = ranking.ranked(vectors.nearest(e, first_vector(spark, sf), 30)).withColumnRenamed("rank", "ord").join(e, "chunk_id")
    return ranking.diversify(pool, first_vector(spark, sf), 0.25, 5).select("chunk_id", "pick")


@query("SELECT vec_id AS chunk_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits, round(list_sum(list_transform(list_zip(embedding, q), lambda z: CASE WHEN (z[1] > 0) = (z[2] > 0) THEN 1.0 ELSE 0.0 END)) / len(embedding), 6) AS similarity FROM embeddings, " + Q)
def quantise_signs(spark, sf):
    q = vectors.as_column(first_vector(spark, sf))
    return embedded(spark, sf).select("chunk_id", vectors.sign_bits(F.col("embedding")).alias("bits"), F.round(vectors.hamming_similarity(F.col("embedding"), q), 6).alias("similarity"))


@query("SELECT vec_id AS chunk_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norm(spark, sf):
    return embedded(spark, sf).select("chunk_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


# --- Markdown ------------------------------------------------------------------------------------------------------


@query(f"SELECT part, name, unnest(['x']) AS one FROM (SELECT part, unnest(list_transform(regexp_extract_all(text, '\\[\\[(.*?)\\]\\]', 1), lambda x: trim(regexp_replace(x, '[|#^].*$', '')))) AS name FROM {MADE})")
def wikilinks(spark, sf):
    return made(spark, sf).select("part", F.explode(C.wikilinks(F.col("text"))).alias("name"), F.lit("x").alias("one"))


@query(f"SELECT part, regexp_extract(line, '^\\s*- \\[[ xX]\\] (.*)$', 1) AS content, regexp_matches(line, '^\\s*- \\[[xX]\\] ') AS checked, line_number FROM (SELECT part, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_number FROM (SELECT part, string_split(text, chr(10)) AS ls FROM {MADE})) WHERE regexp_matches(line, '^\\s*- \\[[ xX]\\] ')")
def tasks_extract(spark, sf):
    return made(spark, sf).select("part", F.explode(C.tasks(F.col("text"))).alias("t")).select("part", "t.*")


@query(f"SELECT part, p_brand || ' ' || p_name AS emphasised FROM {MADE} JOIN part ON part.p_partkey = part")
def emphasis_extract(spark, sf):
    return made(spark, sf).select("part", C.emphasised(F.col("text")).alias("emphasised"))


@query("SELECT CAST(p_partkey AS BIGINT) AS part, p_name AS title, p_brand || ',t' || CAST(p_size % 5 AS STRING) AS tags, '2024-0' || CAST(1 + p_size % 9 AS STRING) || '-15' AS frontmatter_date FROM part")
def frontmatter(spark, sf):
    return made(spark, sf).select("part", F.col("path"), F.explode(C.chunks("text")).alias("c")).where("c.chunk_index = 0").select("part", "c.title", "c.tags", "c.frontmatter_date")


@query("SELECT CAST(p_partkey AS BIGINT) AS part, unnest([0, 1]) AS chunk_index, unnest([p_type, p_type || ' > Notes']) AS parent_header, unnest([CAST(length(p_brand) + 2 * length(p_name) + length(CAST((p_partkey * 7) % 500 AS STRING)) + length(CAST(p_partkey % 10 AS STRING)) + length(CAST(p_size AS STRING)) + 73 AS BIGINT), CAST(9 + length(CAST(p_size AS STRING)) + length(p_type) AS BIGINT)]) AS n_chars FROM part")
def chunk_headers(spark, sf):
    rows = made(spark, sf).select("part", F.explode(C.chunks("text")).alias("c"))
    return rows.select("part", "c.chunk_index", "c.parent_header", F.char_length("c.content").cast("long").alias("n_chars"))


@query("SELECT chunk_index, count(*) AS n FROM (SELECT unnest(range(greatest(CASE WHEN length(trim(t)) > 1000 THEN len(list_filter(string_split(t, chr(10) || chr(10)), lambda x: trim(x) <> '')) ELSE 1 END, 1))) AS chunk_index FROM (SELECT coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn), '') AS t FROM (SELECT conv_id, turn, regexp_replace(text, '[^a-zA-Z ]', ' ', 'g') AS text FROM conversations) GROUP BY conv_id)) GROUP BY 1")
def chunk_paragraphs(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^a-zA-Z ]", " ").alias("text"))
    talk = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return talk.select(F.explode(C.chunks("text")).alias("c")).groupBy("c.chunk_index").agg(F.count("*").alias("n"))


@query("SELECT CAST(p_partkey AS BIGINT) AS part, 'data|' || CAST(p_size AS STRING) || '|model|HTML|Parser' AS parts FROM part")
def ident_split(spark, sf):
    token = F.concat(F.lit("data"), F.col("p_size").cast("string"), F.lit("model_HTMLParser"))
    return table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("part"), F.array_join(C.identifier_parts(token), "|").alias("parts"))


@query("SELECT doc_id, sha256(lower(nfc_normalize(text))) AS hash FROM documents")
def normalize(spark, sf):
    # the texts hold no compatibility characters, for which SQL has no form; tests hold those against fixed values
    return table(spark, sf, "documents").select("doc_id", F.sha2(C.normalise(F.col("text")), 256).alias("hash"))


@query("SELECT doc_id, 'New York City|is|ChatGPT|' || lang AS merged FROM documents")
def user_dict(spark, sf):
    parts = F.array(F.lit("New"), F.lit("York"), F.lit("City"), F.lit("is"), F.lit("Chat"), F.lit("GPT"), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(C.user_dictionary(parts, {"New York", "New York City", "ChatGPT"}), "|").alias("merged"))


@query("SELECT CAST(p_partkey AS STRING) AS doc, 1 AS page, '# ' || p_name || chr(10) || chr(10) || chr(10) || '## ' || p_type || chr(10) || chr(10) || p_brand || chr(10) || 'size' || p_size || chr(10) || 'of ' || p_brand || chr(10) || 'no. ' || p_partkey AS markdown FROM part")
def pdf_pages(spark, sf):
    """A heading across the page, a smaller one below, and two columns, whose characters come line by line across both."""
    lines = (("p_name", 0, 90, 200, 24), ("p_type", 0, 70, 180, 15), ("p_brand", 0, 50, 90, 12), ("'of ' || p_brand", 110, 50, 200, 12), ("'size' || p_size", 0, 34, 90, 12), ("'no. ' || p_partkey", 110, 34, 200, 12))
    parts = [f"named_struct('n', {i}, 'text', {t}, 'x0', CAST({x0} AS DOUBLE), 'y0', CAST({y0} AS DOUBLE), 'x1', CAST({x1} AS DOUBLE), 'y1', CAST({y0 + 10} AS DOUBLE), 'font_size', CAST({size} AS DOUBLE))" for i, (t, x0, y0, x1, size) in enumerate(lines)]
    rows = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS doc", "1 AS page", f"explode(array({', '.join(parts)})) AS c").select("doc", "page", "c.*")
    # columns are far apart in height by a hair, so that no two make one line
    rows = rows.withColumn("y0", F.when(F.col("x0") > 0, F.col("y0") - 7).otherwise(F.col("y0"))).withColumn("y1", F.col("y0") + 10)
    return pdf.pages(rows, 210.0)


# --- links, tags, tasks, statistics ----------------------------------------------------------------------------------


def files(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf).select("vault_name", "path")


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    names = made(spark, sf).select("vault_name", F.col("path").alias("source"), F.explode(C.wikilinks(F.col("text"))).alias("name"))
    return notes.resolve_links(names, files(spark, sf))


RESOLVED = f"(SELECT DISTINCT l.vault_name, l.source, p.path AS target FROM (SELECT vault_name, path AS source, unnest([CAST((part * 7) % 500 AS STRING), CAST(part % 10 AS STRING)]) AS name FROM {MADE}) l JOIN {MADE} p ON p.vault_name = l.vault_name AND p.path = 'p/' || l.name || '.md')"


@query(f"SELECT * FROM {RESOLVED}")
def path_resolve(spark, sf):
    return resolved(spark, sf)


@query(f"SELECT f.vault_name, f.path, count(r.source) AS backlink_count FROM {MADE} f LEFT JOIN {RESOLVED} r ON r.vault_name = f.vault_name AND r.target = f.path GROUP BY 1, 2")
def backlink_counts(spark, sf):
    return notes.backlink_counts(files(spark, sf), resolved(spark, sf)).select("vault_name", "path", "backlink_count")


@query(f"SELECT f.vault_name, f.path AS file_path, round(CAST(-1.0 - 0.05 * count(r.source) AS DOUBLE), 6) AS score FROM {MADE} f LEFT JOIN {RESOLVED} r ON r.vault_name = f.vault_name AND r.target = f.path GROUP BY 1, 2")
def backlink_boost(spark, sf):
    hits = files(spark, sf).select("vault_name", F.col("path").alias("file_path"), F.lit(-1.0).alias("score"))
    counts = notes.backlink_counts(files(spark, sf), resolved(spark, sf)).withColumnRenamed("path", "file_path")
    return rounded(ranking.backlink_boost(hits, counts, "fts"), "score").select("vault_name", "file_path", "score")


TAGS = f"(SELECT vault_name, trim(unnest(string_split(tags, ','))) AS tag FROM {DOCS})"


@query(f"SELECT vault_name, tag, count(*) AS count FROM {TAGS} WHERE tag <> '' GROUP BY 1, 2")
def tag_counts(spark, sf):
    return notes.tag_counts(docs(spark, sf))


@query(f"SELECT vault_name, tag, count(*) AS count FROM {TAGS} WHERE tag <> '' GROUP BY 1, 2 ORDER BY count DESC, tag, vault_name LIMIT 10")
def top_tags(spark, sf):
    return notes.top_tags(notes.tag_counts(docs(spark, sf)), 10)


@query("SELECT lang AS vault_name, source AS file_path, string_agg(source || ', t' || CAST(doc_id % 7 AS STRING), ',' ORDER BY doc_id) AS tags FROM documents GROUP BY 1, 2")
def tags_for_file(spark, sf):
    rows = docs(spark, sf).withColumn("file_path", F.split("file_path", "/")[0]).withColumn("chunk_index", F.col("chunk_id"))
    return notes.tags_of_files(rows)


def order_tasks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderstatus").alias("vault_name"), F.col("o_custkey").cast("string").alias("file_path"), F.concat(F.lit("Order "), "o_orderpriority").alias("content"), (F.col("o_orderstatus") == "F").alias("checked"), F.col("o_orderkey").alias("line_number"))


ORDER_TASKS = "(SELECT o_orderstatus AS vault_name, CAST(o_custkey AS STRING) AS file_path, 'Order ' || o_orderpriority AS content, o_orderstatus = 'F' AS checked, o_orderkey AS line_number FROM orders)"


@query(f"SELECT * FROM {ORDER_TASKS} WHERE NOT checked")
def tasks_open(spark, sf):
    return notes.find_tasks(order_tasks(spark, sf))


@query(f"SELECT * FROM {ORDER_TASKS} WHERE lower(content) LIKE '%order 1%'")
def tasks_keyword(spark, sf):
    return notes.find_tasks(order_tasks(spark, sf), "oRDER 1", include_checked=True)


@query(f"SELECT (SELECT count(*) FROM documents) AS total_chunks, (SELECT count(*) FROM documents) AS total_files, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS total_chars, (SELECT count(*) FROM embeddings) AS vec_indexed_chunks, (SELECT max(doc_id) FROM documents) AS last_indexed_at, (SELECT string_agg(tag || '=' || count, ';' ORDER BY count DESC, tag) FROM (SELECT vault_name, tag, count(*) AS count FROM {TAGS} WHERE tag <> '' GROUP BY 1, 2 ORDER BY count DESC, tag, vault_name LIMIT 3)) AS top_tags")
def stats(spark, sf):
    d = docs(spark, sf)
    f = d.select("vault_name", F.col("file_path").alias("path"), F.char_length("content").alias("char_count"), F.octet_length("content").alias("file_size"), F.col("chunk_id").alias("mtime_ms"))
    one = notes.statistics(d, f, embedded(spark, sf), 3)
    return one.select("total_chunks", "total_files", "total_chars", "vec_indexed_chunks", "last_indexed_at", F.array_join(F.transform("top_tags", lambda x: F.concat(x["tag"], F.lit("="), x["count"].cast("string"))), ";").alias("top_tags"))


@query("SELECT source AS model_id, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY 1 ORDER BY n DESC, model_id LIMIT 1")
def dominant_model(spark, sf):
    model = F.when(F.col("source") == "src0", "none").otherwise(F.col("source"))
    return notes.dominant_model(table(spark, sf, "documents").withColumn("model_id", model))


@query(f"SELECT vault_name, file_path, CAST(sum(length(content)) AS BIGINT) AS char_count FROM {DOCS} GROUP BY 1, 2")
def char_counts(spark, sf):
    return notes.char_counts(docs(spark, sf))


def talks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.lit("c").alias("vault_name"), F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"))


@query("SELECT a.conv_id, a.turn AS centre, b.turn, b.turn = a.turn AS selected FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 WHERE a.turn % 3 = 1")
def surrounding(spark, sf):
    t = talks(spark, sf)
    near = notes.surrounding(t, t.where("chunk_index % 3 = 1"), 2)
    return near.select(F.col("file_path").cast("long").alias("conv_id"), "centre", F.col("chunk_index").alias("turn"), "selected")


@query(f"SELECT vault_name, file_path FROM {DOCS} ORDER BY vault_name, file_path LIMIT 50 OFFSET 20")
def list_page(spark, sf):
    return notes.page(docs(spark, sf).select("vault_name", "file_path"), ["vault_name", "file_path"], 50, 20)


@query("SELECT 'c' AS vault_name, CAST(conv_id AS STRING) AS file_path, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 2")
def context_rebuild(spark, sf):
    return notes.documents(talks(spark, sf))


# --- maintenance -----------------------------------------------------------------------------------------------------


def states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A cache of documents, and a scan in which some are new, gone, touched, changed or of another model."""
    d = table(spark, sf, "documents")
    base = d.select(F.col("lang").alias("vault_name"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("mtime_ms"), F.col("n_chars").alias("file_size"), F.lit("m1").alias("model_id"), "doc_id")
    cache = base.where("doc_id % 11 <> 0").drop("doc_id")
    scan = base.where("doc_id % 13 <> 0")
    scan = scan.withColumn("mtime_ms", F.when(F.col("doc_id") % 5 == 0, F.col("mtime_ms") + 1).otherwise(F.col("mtime_ms")))
    scan = scan.withColumn("hash", F.when(F.col("doc_id") % 10 == 0, F.lit("new")).otherwise(F.col("hash")))
    return scan.withColumn("model_id", F.when(F.col("doc_id") % 17 == 0, F.lit("m2")).otherwise(F.col("model_id"))).drop("doc_id"), cache


@query("SELECT CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 11 = 0 THEN 'inserted' WHEN doc_id % 17 = 0 THEN 'updated' WHEN doc_id % 10 = 0 THEN 'updated' WHEN doc_id % 5 = 0 THEN 'touched' ELSE 'skipped' END AS status FROM documents WHERE doc_id % 13 <> 0")
def change_detect(spark, sf):
    return changes.detect(*states(spark, sf)).select("path", "status")


@query("SELECT CAST(doc_id AS STRING) AS path FROM documents WHERE doc_id % 13 = 0 AND doc_id % 11 <> 0")
def deleted_files(spark, sf):
    return changes.deleted(*states(spark, sf)).select("path")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'inserted' WHEN doc_id % 17 = 0 OR doc_id % 10 = 0 THEN 'updated' WHEN doc_id % 5 = 0 THEN 'touched' ELSE 'skipped' END AS status FROM documents WHERE doc_id % 13 <> 0) GROUP BY 1")
def change_tally(spark, sf):
    return changes.tally(changes.detect(*states(spark, sf)))


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def orphans(spark, sf):
    return notes.orphans(embedded(spark, sf), docs(spark, sf).where("chunk_id % 3 <> 0")).select("chunk_id")


@query("SELECT o_orderstatus AS vault_name, o_orderkey AS path FROM orders WHERE (o_orderstatus = 'F' AND epoch_ms(o_orderdate) < 900000000000 - 365 * CAST(86400000 AS BIGINT)) OR (o_orderstatus = 'O' AND epoch_ms(o_orderdate) < 900000000000 - 30 * CAST(86400000 AS BIGINT))")
def retention(spark, sf):
    f = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("vault_name"), F.col("o_orderkey").alias("path"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime_ms"))
    return notes.expired(f, {"F": 365, "O": 30}, 900_000_000_000).drop("mtime_ms")


def masked_sql(column: str) -> str:
    for name, pattern in C.MASKS:
        column = f"regexp_replace({column}, '{pattern}', '[{name}]', 'g')"
    return column


@query(f"SELECT doc_id, {masked_sql('text')} AS masked FROM documents")
def mask_secrets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.mask(F.col("text")).alias("masked"))


@query("SELECT doc_id, regexp_replace(text, '(the)', '**\\1**', 'gi') AS marked FROM documents")
def highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.highlight(F.col("text"), "the").alias("marked"))


@query("SELECT doc_id, substr(text, 1, 80) || '…' AS snippet FROM documents")
def snippet_without_hit(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.snippet(F.col("text"), "qqqqqq", 3, 80).alias("snippet"))


@query("SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS snippet FROM (SELECT doc_id, string_split(rtrim(substr(text, instr(lower(text), 'en')), chr(10)), chr(10))[1] AS t FROM documents WHERE contains(lower(text), 'en'))")
def snippet_at_hit(spark, sf):
    rows = table(spark, sf, "documents").where("contains(lower(text), 'en')")
    return rows.select("doc_id", C.snippet(F.col("text"), "en", 0, 120).alias("snippet"))


@query("SELECT event_id AS id, strftime(ts, '%Y-%m') AS month, n, n <= 500 AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS n FROM events)")
def usage_quota(spark, sf):
    return limits.monthly_quota(table(spark, sf, "events"), 500, id_col="event_id")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def usage_history(spark, sf):
    return limits.monthly_usage(table(spark, sf, "orders"), "o_orderdate")


@query("SELECT event_type AS key, event_id AS id, admitted FROM (WITH RECURSIVE o AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events), w AS (SELECT event_type, event_id, us, n, true AS admitted, us AS last FROM o WHERE n = 1 UNION ALL SELECT o.event_type, o.event_id, o.us, o.n, o.us - w.last >= 1000000, CASE WHEN o.us - w.last >= 1000000 THEN o.us ELSE w.last END FROM w JOIN o ON o.event_type = w.event_type AND o.n = w.n + 1) SELECT * FROM w)")
def rate_limit(spark, sf):
    return limits.rate_limit(table(spark, sf, "events"), "event_type", 1, id_col="event_id").select(F.col("event_type").alias("key"), "id", "admitted")


@query("SELECT event_type AS key, event_id AS id, admitted FROM (WITH RECURSIVE o AS (SELECT event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events), w AS (SELECT event_type, event_id, n, true AS admitted, [us] AS held FROM o WHERE n = 1 UNION ALL SELECT o.event_type, o.event_id, o.n, len(list_filter(w.held, lambda h: o.us - h < 1000000)) < 3, CASE WHEN len(list_filter(w.held, lambda h: o.us - h < 1000000)) < 3 THEN list_append(list_filter(w.held, lambda h: o.us - h < 1000000), o.us) ELSE list_filter(w.held, lambda h: o.us - h < 1000000) END FROM w JOIN o ON o.event_type = w.event_type AND o.n = w.n + 1) SELECT * FROM w)")
def rate_limit_many(spark, sf):
    return limits.rate_limit(table(spark, sf, "events"), "event_type", 3, id_col="event_id").select(F.col("event_type").alias("key"), "id", "admitted")


@query(f"SELECT directory, count(*) AS count, directory = 'src3/build' AS known FROM (SELECT CASE WHEN source = 'src3' THEN 'src3/build' ELSE source END AS directory, n FROM (SELECT source, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE source = 'src3' OR n >= 50) GROUP BY 1")
def noise_dirs(spark, sf):
    path = F.concat_ws("/", F.when(F.col("source") == "src3", "src3/build").otherwise(F.col("source")), F.col("doc_id").cast("string"))
    return notes.noisy_directories(table(spark, sf, "documents").select(path.alias("path")), 50)


@query(f"SELECT file_path FROM {DOCS} WHERE file_path LIKE 'src1/%' OR (file_path LIKE 'src2/%' AND file_path LIKE '%7.md') OR file_path LIKE 'src4/%'")
def exclude_globs(spark, sf):
    return docs(spark, sf).where(C.excluded(F.col("file_path"), ["src1", "src2/*7.md", "/src4/**", "md"])).select("file_path")


@query(f"SELECT file_path, CASE WHEN file_path LIKE 'src1/%' THEN 'src1' WHEN file_path LIKE '%7.md' THEN 's*/*7.md' END AS pattern FROM {DOCS}")
def check_ignore(spark, sf):
    return docs(spark, sf).select("file_path", C.excluded_by(F.col("file_path"), ["", "src1", "s*/*7.md"]).alias("pattern"))


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def sha_dedup(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors see; only a local master may do without a setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="notelake-")
    return f"{named.rstrip('/')}/index-{uuid.uuid4().hex}"


def scanned(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf).select("*", F.col("part").alias("mtime_ms"), F.octet_length("text").cast("long").alias("file_size"), F.lit("none").alias("model_id"))


PER_NOTE = f"SELECT f.vault_name, f.path, CAST(count(r.source) AS BIGINT) AS backlink_count, CAST(2 AS BIGINT) AS chunks, CAST(2 AS BIGINT) AS tasks FROM {MADE} f LEFT JOIN {RESOLVED} r ON r.vault_name = f.vault_name AND r.target = f.path"


@query(f"{PER_NOTE} WHERE f.part % 7 <> 0 AND (r.source IS NULL OR CAST(regexp_extract(r.source, '([0-9]+)', 1) AS BIGINT) % 7 <> 0) GROUP BY 1, 2 UNION ALL SELECT vault_name, path, 0, 2, 2 FROM {MADE} f WHERE f.part % 7 <> 0 AND EXISTS (SELECT 1 FROM {RESOLVED} r WHERE r.vault_name = f.vault_name AND r.target = f.path) AND NOT EXISTS (SELECT 1 FROM {RESOLVED} r WHERE r.vault_name = f.vault_name AND r.target = f.path AND CAST(regexp_extract(r.source, '([0-9]+)', 1) AS BIGINT) % 7 <> 0)")
def incremental_equals_batch(spark, sf):
    """An index brought up in two halves, links to later notes among them, changed, and rid of some files, gives what one scan of the last texts gives."""
    d, store = scanned(spark, sf), Snapshots(spark, scratch(spark), buckets=4)
    update(store, d.where("part % 2 = 0").withColumn("text", F.concat("text", F.lit("\n[[nowhere]]"))).withColumn("mtime_ms", F.lit(0).cast("long")))
    update(store, d.where("part % 2 = 1"), complete=False)
    update(store, d.where("part % 2 = 0"), complete=False, removed=d.where("part % 7 = 0 AND part % 2 = 1"))
    update(store, d.where("part % 7 <> 0"))
    per = lambda t: store.table(t).groupBy("vault_name", F.col("file_path").alias("path")).agg(F.count("*").alias(t))
    return store.table("files").select("vault_name", "path", "backlink_count").join(per("chunks"), ["vault_name", "path"]).join(per("tasks"), ["vault_name", "path"])


@query(bm25_sql(AND, TOP10))
def fts_stored(spark, sf):
    """Over an index that is written as tables first, by bucket and term."""
    store = Snapshots(spark, scratch(spark), buckets=4)
    chunks = docs(spark, sf).withColumn("tokenized_content", F.col("content"))
    made_tables = search_tables(chunks)
    store.commit(made_tables | {"stats": made_tables["lengths"].agg(F.count("*").alias("n_docs"), F.sum("dl").alias("terms"))})
    return top10(bm25.match(bm25.stored(store.table("postings"), store.table("stats")), AND))


@query("SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, CAST(sum(CAST(tagged AS INT)) AS BIGINT) AS tagged FROM (SELECT unnest([0, 1]) AS i, p_partkey AS file_path, true AS tagged FROM part)")
def index_notes(spark, sf):
    rows = chunk_rows(made(spark, sf))
    return rows.agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"), F.sum((F.col("tags") != "").cast("int")).alias("tagged"))
