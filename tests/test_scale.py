"""Work that must not grow with the number of groups, and memory that must not grow with the size of a batch."""

import time
import tracemalloc
from datetime import datetime, timezone

import pyarrow as pa
import pytest

from notelake.functions import columns as C
from notelake.functions.snippets import snippet
from notelake.functions.tokens import normalise
from notelake.operators import bm25, limits, pdf
from notelake.operators.pdf import Line


@pytest.fixture
def tiny_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, was)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_pages_share_batches(spark, tiny_batches):
    """Pages go on over the borders of batches; none is a batch of its own."""
    rows = [(d, p, n, f"{d}{p}{n} ", 0.0, 100.0 - 20 * (n // 2), 10.0, 110.0 - 20 * (n // 2), 12.0) for d in ("a", "b", None) for p in (1, 2) for n in range(p * 2 + 1)]
    df = spark.createDataFrame(rows[::-1], "doc string, page int, n int, text string, x0 double, y0 double, x1 double, y1 double, font_size double")
    got = pdf.pages(df, 200.0)
    assert "FlatMapGroups" not in plan(got)
    want = {(d, p): pdf.page_text([Line(*r[3:]) for r in rows if r[:2] == (d, p)], 200.0) for d, p, *_ in rows}
    found = [((r.doc, r.page), r.markdown) for r in got.collect()]
    assert len(found) == 6 and dict(found) == want


@pytest.mark.parametrize("most", [1, 3])
def test_bursts_share_batches(spark, tiny_batches, most):
    """Bursts that cross slices of time and batches are judged as one run of the calls would; none is a batch of its own."""
    us = [limits.SLICE * s + t for s, near in enumerate([(-900_000, -500_000, 0, 999_999), (), (0,), (-1_000_001, -1, 0, 0, 700_000), (5,)], 1) for t in near]
    us += [limits.SLICE // 2 + 400_000 * i for i in range(2000)]  # a burst of more than a slice
    rows = [(k, i, u, None if u is None else datetime.fromtimestamp(u / 1e6, timezone.utc)) for k in ("a", None) for i, u in enumerate([*us, None])]
    df = spark.createDataFrame([(k, i, t) for k, i, _, t in rows[::-1]], "k string, id long, ts timestamp")
    got = limits.rate_limit(df, "k", most, id_col="id")
    assert "FlatMapGroups" not in plan(got)
    want = {(k, i): True for k, i, u, _ in rows if u is None}
    for k in ("a", None):
        calls = sorted((u, i) for x, i, u, _ in rows if x == k and u is not None)
        want |= {(k, i): ok for (_, i), ok in zip(calls, limits.admit([u for u, _ in calls], most)[0])}
    found = [((r.k, r.id), r.admitted) for r in got.collect()]
    assert len(found) == len(rows) and dict(found) == want


def test_postings_stay_where_chunks_are(spark, tiny_batches):
    texts = {1: "b a b", 2: None, 3: "", 4: "a " * 300_000 + "c", 5: "é É x", 6: "b"}
    df = spark.createDataFrame([(i, t, f"v{i}") for i, t in texts.items()], "chunk_id long, content string, vault_name string")
    got = bm25.postings(df, "content", "chunk_id", "vault_name")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in texts.items():
        for n, word in enumerate((t or "").lower().split()):
            want.setdefault((word, i, f"v{i}"), []).append(n)
    size = {i: len((t or "").split()) for i, t in texts.items()}
    found = [((r.term, r.chunk_id, r.vault_name), r.positions, r.tf, r.dl) for r in got.collect()]
    assert sorted(f[0] for f in found) == sorted(want) and all(p == want[k] and tf == len(p) and dl == size[k[1]] for k, p, tf, dl in found)


def test_phrase_of_frequent_words(spark):
    """Two words that each come 40,000 times in a text took their product before; counts are those of a plain walk."""
    texts = {1: "of the x " * 40_000, 2: "a a a a b", 3: "often the of-the ofthe", 4: "OF_THE of\n\nthe", 5: None, 6: "the of"}
    df = spark.createDataFrame(list(texts.items()), "chunk_id long, content string")
    plain = bm25.build(df)
    kept = bm25.TextIndex(plain.postings, plain.stats)
    asked = {("of", "the"): "f0", ("a", "a"): "f1", ("the",): "f2", ("a", "a", "b"): "f3"}
    began = time.monotonic()
    for index in (plain, kept):
        hits, known = index.counts(asked)
        got = {r.chunk_id: r[1:] for r in hits.select("chunk_id", "dl", *asked.values()).collect()}
        assert got == {1: (120_000, 40_000, 0, 40_000, 0), 2: (5, 0, 3, 0, 1), 3: (5, 1, 0, 2, 0), 4: (4, 2, 0, 2, 0), 6: (2, 0, 0, 1, 0)}
        row = known.first()
        assert (row.n_docs, row.nf0, row.nf1, row.nf2, row.nf3) == (6, 3, 1, 4, 1) and round(row.avgdl * 6) == 120_016
    assert time.monotonic() - began < 100


def test_few_texts_are_strings_at_once():
    """A batch of 50 MB of texts, of which 10,000 strings were held before; and snippets of plain texts keep no list of places."""
    values = pa.array(["é" + "x" * 5000] * 10_000 + [None])
    tracemalloc.start()
    got = C.in_parts(values, pa.string(), lambda t: normalise(t)[:3])
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert len(got) == 10_001 and got[0].as_py() == "éxx" and got[10_000].as_py() is None and C.in_parts(values[:0], pa.string(), str).to_pylist() == []
    assert held < 5_000_000
    text = "a" * 200_000
    before = tracemalloc.get_traced_memory()[0]
    assert snippet(text, "zz", 3, 5) == "aaaaa…" and snippet("ÀB\nİcd", "D", 0, 9) == "d" and snippet("Àbcd", "C", 0, 9) == "cd"
    assert tracemalloc.get_traced_memory()[1] - before < 1_500_000
    tracemalloc.stop()
