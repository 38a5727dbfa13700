"""Versions of an index, embeddings over HTTP, page text, SQL functions, the command line and watching."""

import json
import tomllib

import pytest

from notelake import cli
from notelake.api import Notes
from notelake.functions import sql, tokens
from notelake.operators import pdf
from notelake.operators.pdf import Line
from notelake.plans import index
from notelake.sources import embedding, vault
from notelake.sources.snapshot import Conflict, Snapshots
from notelake.streaming import watch


@pytest.fixture()
def root(tmp_path):
    folder = tmp_path / "vault"
    folder.mkdir()
    (folder / "a.md").write_text("# A\nsee [[b]] and project one\n- [ ] call\n")
    return folder


def test_links_to_later_notes_and_versions(spark, root, tmp_path):
    n = Notes(spark, str(tmp_path / "index"))
    n.index({"v": str(root)})
    (root / "b.md").write_text("# B\nproject two\n")
    n.index({"v": str(root)})
    assert n.file("v", "b.md")["backlink_count"] == 1 and n.file("v", "c.md") is None
    # only the terms of a query are read, by a filter that reaches the files
    plan = n.text_index().hits({"project": "p0"})._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [project])" in plan or "EqualTo(term,project)" in plan
    ids = n.chunk_ids("v", "b.md")
    assert len(ids) == 1 and n.chunk(ids[0])["content"] == "project two" and {r.vault_name: r.n for r in n.path_counts().collect()} == {"v": 2}
    assert n.read("v", "a.md", {"v": str(root)}).first().text.startswith("# A") and n.read("v", "a.md").first().text.startswith("see")
    # a crash before the version file has its name changes nothing; its number is not used again
    was = n.store.version()
    n.store.fs.create(n.store._path(f"versions/{was + 1:012d}.claim"), False).close()
    assert n.store.version() == was and n.search("two", mode="fts").results.count() == 1
    other = Snapshots(spark, n.store.root)
    assert index.clear_vlm_hashes(n.store) == was + 2
    with pytest.raises(Conflict):
        other._publish(other.manifest(was), was, 3)
    # what a commit does not change is not written again
    tables = [n.store.manifest(v)["tables"]["chunks"] for v in (was, was + 2)]
    assert tables[0] == tables[1]
    assert n.store.rollback(was) == was + 3 and n.search("two", mode="fts").results.count() == 1
    assert n.store.compact() == was + 4 and n.store.versions() == [was + 4] and n.search("two", mode="fts").results.count() == 1
    for k in (1, 2):
        assert index.record_usage(n.store, "embed", "m", 3, limit=2) == k
    with pytest.raises(PermissionError):
        index.record_usage(n.store, "embed", "m", 3, limit=2)
    index.forget_files(n.store, spark.createDataFrame([("v", "a.md")], "vault_name string, path string"))
    assert {r.status: r.n for r in n.index({"v": str(root)}).collect()} == {"inserted": 1, "skipped": 1}


def test_api_embedder():
    calls, pauses = [], []

    def send(url, headers, body, timeout):
        calls.append(json.loads(body)["input"])
        if len(calls) == 1:
            raise ConnectionError("reset")
        if len(calls) == 2:
            return 503, "busy"
        return 200, json.dumps({"data": [{"embedding": [float(len(t))]} for t in calls[-1]]})

    e = embedding.ApiEmbedder("http://x", "m", "top-key", send=send, sleep=pauses.append)
    assert e([f"{i:03d}" for i in range(150)]) == [[3.0]] * 150 and [len(c) for c in calls] == [100, 100, 100, 50] and pauses == [0.1, 0.2]
    assert e([]) == [] and e.model_id == embedding.ApiEmbedder("http://x", "m", "other").model_id != embedding.ApiEmbedder("http://y", "m", "").model_id
    refused = embedding.ApiEmbedder("http://x", "m", "top-key", send=lambda *a: (401, "Bearer top-key is wrong"), sleep=pauses.append)
    with pytest.raises(embedding.EmbeddingError, match=r"401: Bearer \[REDACTED\] is wrong"):
        refused(["a"])
    short = embedding.ApiEmbedder("http://x", "m", "k", send=lambda *a: (200, '{"data": []}'))
    with pytest.raises(embedding.EmbeddingError, match="0 embeddings for 1"):
        short(["a"])
    assert embedding.padded([5, 6], 4) == ([5, 6, 0, 0], [1, 1, 0, 0]) and len(embedding.padded(range(600))[0]) == 512


def test_page_text():
    line = pdf.cluster([Line("H", 10, 100, 16, 112, 12), Line("i", 8, 100.5, 20, 112.5, 12), Line("!", 20.5, 100, 26, 112, 12)])
    assert len(line) == 1 and (line[0].text, line[0].x0, line[0].x1) == ("Hi!", 10, 26)
    assert len(pdf.cluster([Line("A", 10, 100, 16, 112, 12), Line("B", 10, 80, 16, 92, 12)])) == 2
    rows = [Line("title", 0, 90, 200, 100, 18), Line(" left ", 0, 20, 90, 40, 12), Line("right", 110, 13, 200, 33, 12), Line("  ", 0, 5, 90, 9, 12)]
    assert pdf.page_text(rows, 200.0) == "# title\n\nleft\nright"
    assert pdf.body_size([]) == 12.0
    read = pdf.extractor(lambda data: [(200.0, [("one", 0, 10, 50, 20, 12)]), (200.0, []), (200.0, [("two", 0, 10, 50, 20, 12)])])
    assert read(b"x") == "one\ntwo"


def test_vision_reads_what_has_no_text(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "p.pdf").write_bytes(b"%PDF")
    files = vault.scan(spark, {"v": str(tmp_path / "v")})
    got = vault.read_texts(files, lambda data: "", lambda data: "seen").first()
    assert got.text == "seen" and len(got.vlm_hash) == 64 and got.error is None
    assert vault.read_texts(files, lambda data: "text", lambda data: "seen").first().vlm_hash is None
    assert vault.read_texts(files, lambda data: "", lambda data: 1 / 0).first().text == ""


def test_normal_forms():
    assert tokens.normalise("ＡＢＣ ﬁ ① Å é ﾊﾝ") == "abc fi 1 å é ハン"


def test_sql_functions(spark):
    sql.register(spark)
    one = spark.sql("SELECT notelake_normalise('ＡＢ') AS n, notelake_tokens('parseHTML now') AS t, notelake_highlight('a The b', 'the') AS h, notelake_match('a b') AS m, notelake_cosine(array(1D, 0D), array(1D, 0D)) AS c, notelake_snippet('x', 'y', 1, 5) AS s").first()
    assert (one.n, one.h, one.c, one.s) == ("ab", "a **The** b", 1.0, "x…") and "parse" in one.t and one.m == '"a" AND "b"'
    rows = spark.sql("SELECT c.* FROM (SELECT '# H\nbody\n- [x] done' AS text) t, LATERAL notelake_chunks(text) c").collect()
    assert [(r.parent_header, r.chunk_index) for r in rows] == [("H", 0)]
    assert spark.sql("SELECT * FROM notelake_tasks('- [x] done')").first().checked


def test_watch(spark, root, tmp_path):
    n = Notes(spark, str(tmp_path / "index"))
    n.index({"v": str(root)})
    (root / "c.md").write_text("# C\nnew words")
    (root / "a.md").unlink()
    assert watch.watch(n.store, {"v": str(root)}, str(tmp_path / "watch"), rounds=2, every=0.01) == 2
    assert {r.path for r in n.files().collect()} == {"c.md"} and n.search("words", mode="fts").results.count() == 1


def test_command_line(spark, root, tmp_path, capsys):
    config, words = str(tmp_path / "c.toml"), str(tmp_path / "t.toml")
    run = lambda *a: (cli.main(["--root", str(tmp_path / "index"), "--config", config, "--thesaurus", words, *a]), capsys.readouterr().out)[1]
    run("init", "--vault", f"v={root}")
    with pytest.raises(SystemExit):
        run("init")
    assert tomllib.loads(run("config"))["vaults"] == {"v": str(root)}
    assert json.loads(run("index")) == {"status": "inserted", "n": 1}
    run("synonym", "add", "uno", "one")
    found = json.loads(run("search", "uno", "--no-backlinks", "--alpha", "0.5"))
    assert [r["file_path"] for r in found["results"]] == ["a.md"]
    told = json.loads(run("support"))
    assert told["vaults"] == {"v": True} and told["files"] == {"v": 1}
    assert run("prune", "--days", "1", "--vault", "v", "--dry-run").strip() == "0"
    (tmp_path / "c.toml").write_text('[vault]\npath = "/a"\nexcludes = ["x"]\n[server]\napi_key = "k"\n')
    assert tomllib.loads(run("config-migrate", "--dry-run"))["vaults"] == {"default": "/a"} and "[REDACTED]" in run("config")
    assert cli.synonyms({"synonyms": {"uno": ["x"], "due": ["two"]}}, words) == {"uno": ["one"], "due": ["two"]}
