import json

import pytest
from pyspark.sql import functions as F

from notelake.api import Notes
from notelake.cli import edit_thesaurus, thesaurus, vaults
from notelake.functions import columns as C
from notelake.operators import changes, limits, ranking, vectors
from notelake.sources import vault
from notelake.streaming import watch


@pytest.fixture()
def notes(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "_under").mkdir()
    (root / "plan.md").write_text("---\ntitle: Project plan\ntags: [work]\ndate: 2024-02-01\n---\n# Plan\nThe project meets on Monday. See [[meeting]].\n- [ ] write report\n- [x] call\n")
    (root / "meeting.md").write_text("# Meeting\nproject meeting notes, mail a@b.example, **budget** agreed\n")
    (root / "sub" / "shopping.md").write_text("# List\nmilk and bread, see [[Plan]] and [[meeting|m]]\n")
    (root / ".hidden" / "x.md").write_text("project")
    (root / "_under" / "y.md").write_text("underscored project")
    (root / "skip.txt").write_text("project")
    (root / "bad.md").write_bytes(b"\xff\xfe")
    n = Notes(spark, str(tmp_path / "index"))
    n.root = root
    return n


def tally(df):
    return {r.status: r.n for r in df.collect()}


def test_life_of_an_index(notes, spark, tmp_path):
    assert tally(notes.index({"v": str(notes.root)})) == {"inserted": 4}
    out = notes.search("project", mode="fts", limit=2)
    rows = out.results.collect()
    assert out.mode == "fts" and len(rows) == 2 and out.next_cursor and [r.file_path for r in rows] == ["meeting.md", "plan.md"]
    more = notes.search("project", mode="fts", limit=2, cursor=out.next_cursor)
    assert [r.file_path for r in more.results.collect()] == ["_under/y.md"] and more.next_cursor is None
    assert {r.file_path for r in notes.search("project", mode="hybrid", tag_filter="WORK").results.collect()} == {"plan.md"}
    assert notes.search("  ", mode="fts").results.count() == 0 and notes.count("project", vault="none") == 0
    assert notes.search("meets | project", mode="fts", synonyms={"meets": ["agreed"]}).results.count() == 2
    with pytest.raises(ValueError):
        notes.search("x", mode="vec")
    shown = notes.show(notes.search("budget", mode="fts"), "budget")
    assert "[EMAIL]" in shown[0]["snippet"] and "tokenized_content" not in shown[0]
    links = {r.path: r.backlink_count for r in notes.files().collect()}
    assert links == {"plan.md": 1, "meeting.md": 2, "sub/shopping.md": 0, "_under/y.md": 0}
    assert [(t.content, t.line_number) for t in notes.tasks().collect()] == [("write report", 8)]
    assert notes.tasks("CALL", True).count() == 1
    one = notes.stats().first()
    assert (one.total_files, one.total_chunks, one.vec_indexed_chunks) == (4, 4, 0) and one.top_tags[0].tag == "work"
    assert tally(notes.index({"v": str(notes.root)})) == {"skipped": 4}
    (notes.root / "meeting.md").write_text("# Meeting\nnothing\n\n## More\nof it\n")
    (notes.root / "sub" / "shopping.md").unlink()
    assert tally(notes.index({"v": str(notes.root)})) == {"skipped": 2, "updated": 1, "deleted": 1}
    assert {r.path: r.backlink_count for r in notes.files().collect()}["meeting.md"] == 1
    assert notes.read("v", "meeting.md").first().text == "nothing\nof it"
    at = notes.store.table("chunks").where("content = 'of it'").first().chunk_id
    assert notes.context(at) == "nothing\n\n>>> of it"
    notes.delete("v", "meeting.md")
    assert notes.store.table("links").count() == 0 and notes.files().count() == 2
    with pytest.raises(ValueError):
        notes.delete("v", "../x")
    assert notes.prune({"v": 1}, 1 << 50, dry_run=True) == 2 and notes.files().count() == 2
    assert notes.prune({"v": 1}, 1 << 50) == 2 and notes.files().count() == 0
    assert notes.store.size() > 0 and notes.store.purge() > 1


def test_vectors_and_diversity(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "chunk_id long, embedding array<double>")
    assert [r.chunk_id for r in vectors.nearest(v, [1.0, 0.0], 3, metric="cosine").collect()] == [1, 2, 3]
    pool = v.withColumn("ord", F.col("chunk_id"))
    assert [r.chunk_id for r in ranking.diversify(pool, [1.0, 0.0], 0.0, 3).collect()][:2] == [1, 3]
    assert [r.chunk_id for r in ranking.diversify(pool, [1.0, 0.0], 1.0, 2).collect()] == [1, 2]
    assert [round(x, 6) for x in v.select(vectors.mean_pool(F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(9.0))), F.array(F.lit(1), F.lit(0))).alias("m")).first().m] == [1.0, 0.0]
    assert v.select(vectors.half(F.col("embedding")).alias("h")).count() == 4


def test_boost_directions(spark):
    h = spark.createDataFrame([(1, -2.0, "The Plan", ""), (2, 2.0, "plan", "plan"), (3, -2.0, "", "")], "chunk_id long, score double, title string, emphasized_text string")
    got = {r.chunk_id: round(r.score, 6) for r in ranking.boost(h, "plan", "fts").collect()}
    assert got == {1: round(-2 / 0.3, 6), 2: 0.3, 3: -2.0}
    assert ranking.boost(h, " ", "fts") is h


def test_masks_and_globs(spark):
    secrets = ["a@b.co", "sk-" + "a" * 48, "ghp_" + "b" * 36, "AKIA" + "C" * 16, "xoxb-1-a", "AIza" + "d" * 35, "eyJa.b.c", "555-123-4567", "https://u:p@h", "plain 12345"]
    df = spark.createDataFrame([(s,) for s in secrets], "t string")
    got = [r.m for r in df.select(C.mask(F.col("t"), (r"plain", "(")).alias("m")).collect()]
    assert got == ["[EMAIL]", "[OPENAI_KEY]", "[GITHUB_TOKEN]", "[AWS_KEY_ID]", "[SLACK_TOKEN]", "[GCP_API_KEY]", "[JWT_TOKEN]", "[PHONE]", "[URL_CREDENTIAL]h", "[CUSTOM_SECRET] 12345"]


def test_empty_tables(spark):
    files = spark.createDataFrame([], "vault_name string, path string, hash string, mtime_ms long, file_size long, model_id string")
    assert changes.detect(files, files).count() == changes.deleted(files, files).count() == 0
    events = spark.createDataFrame([], "k string, id long, ts timestamp")
    assert limits.rate_limit(events, "k", 1, id_col="id").count() == 0


def test_streams(spark, tmp_path, notes):
    notes.index({"v": str(notes.root)})
    rows = [(1, "upsert", "v", "new.md", "# N\nfresh [[plan]]", 5, 10, "none"), (2, "delete", "v", "meeting.md", None, None, None, None), (3, "upsert", "v", "new.md", "# N\nfresher [[plan]]", 6, 11, "none")]
    spark.createDataFrame(rows, watch.EVENT).write.json(str(tmp_path / "events"))
    stream = spark.readStream.schema(watch.EVENT).json(str(tmp_path / "events"))
    watch.follow(stream, notes.store, str(tmp_path / "progress")).awaitTermination()
    assert {r.path for r in notes.files().collect()} == {"plan.md", "new.md", "sub/shopping.md", "_under/y.md"}
    assert notes.read("v", "new.md").first().text == "fresher [[plan]]"
    calls = [("a", i, f"2024-01-01 00:00:00.{i}") for i in range(5)]
    spark.createDataFrame(calls, "key string, id long, t string").selectExpr("key", "id", "CAST(t AS timestamp) AS ts").write.parquet(str(tmp_path / "calls"))
    calls = spark.readStream.schema("key string, id long, ts timestamp").parquet(str(tmp_path / "calls"))
    q = watch.limit_stream(calls, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("limited").where("admitted").count() == 2
    routed = watch.route(spark.createDataFrame([("/a/b/c.md",), ("/a/x.md",), ("/z",)], "absolute string"), {"outer": "/a", "inner": "/a/b"})
    assert {(r.vault_name, r.path) for r in routed.collect()} == {("inner", "c.md"), ("outer", "x.md")}


def test_walk_and_config(tmp_path, notes):
    (notes.root / vault.IGNORE_FILE).write_text("# c\nsub\n")
    assert {p for _, p, *_ in vault.walk({"v": str(notes.root)})} == {"plan.md", "meeting.md", "bad.md", "_under/y.md"}
    assert ".hidden/x.md" in {p for _, p, *_ in vault.walk({"v": str(notes.root)}, skip_hidden=False)}
    with pytest.raises(ValueError):
        vault.safe_path(str(notes.root), "../x")
    assert vaults({"vault": {"path": "/a"}, "vaults": {"b": "/b"}}) == {"default": "/a", "b": "/b"}
    t = str(tmp_path / "t.toml")
    edit_thesaurus(t, "car", ["auto", "vehicle"], False)
    assert edit_thesaurus(t, "car", ["auto"], True) == {"car": ["vehicle"]} == thesaurus(t)
    assert json.loads(json.dumps(edit_thesaurus(t, "car", [], True))) == {}
