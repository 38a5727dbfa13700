import pytest

from notelake.functions import markdown as M
from notelake.functions import snippets as S
from notelake.functions import tokens as T
from notelake.functions.columns import MASKS, glob_regex
from notelake.operators.limits import admit
from notelake.operators.pdf import Line, body_size, cluster, reading_order, to_markdown


@pytest.mark.parametrize("text, title, date, tags, body", [
    ("---\ntitle: A\ndate: 2024-01-02\ntags: [x, \"y\"]\n---\n\n# H\n", "A", "2024-01-02", ["x", "y"], "# H\n"),
    ("---\ntags: a, b\n...\nbody", None, None, ["a", "b"], "body"),
    ("---\ntags:\n- a\n- \"b\"\n\n- c\n---\nbody", None, None, ["a", '"b"'], "body"),
    ("---\ntitle: A\nno end", None, None, [], "---\ntitle: A\nno end"),
    ("plain", None, None, [], "plain"),
    ("  ---\nTITLE: \"Q\"\ntitle: R\ntitle:\n---\nx", "R", None, [], "x"),
    ("---\nurl: http://x:1\n  ---\nx", None, None, [], "x"),
    ("", None, None, [], ""),
])
def test_frontmatter(text, title, date, tags, body):
    meta, rest = M.frontmatter(text)
    assert (meta.title, meta.date, meta.tags, rest) == (title, date, tags, body)


def test_sections_and_fences():
    got = M.sections("intro\n# A\na\n## B\n```\n# no heading\n```\nb\n# C\n#### deep\n#no")
    assert got == [([], "intro\n"), (["A"], "a\n"), (["A", "B"], "```\n# no heading\n```\nb\n"), (["C"], "#### deep\n#no\n")]


def test_chunks():
    assert M.chunks("# A\n\n## B\nx") == [{"chunk_index": 0, "parent_header": "A > B", "content": "x", "title": "", "tags": "", "frontmatter_date": ""}]
    assert [c["content"] for c in M.chunks("")] == [""]
    long = "a" * 600 + "\n\n" + "b" * 600 + "\n\n~~~\n\n\n~~~"
    assert [len(c["content"]) for c in M.chunks(long)] == [600, 600, 9]
    assert len(M.chunks("é" * 999 + "\n\nx")) == 2 and len(M.chunks("é" * 500 + "\n\nx")) == 1


def test_marks():
    assert M.emphasised("==a== b **c ** ***d*** == e") == "a c"[:3] or "a" in M.emphasised("==a== b **c **")
    assert M.wikilinks("[[A|b]] [[C#d]] [[E^f]] [[ ]] [[open") == ["A", "C", "E"]
    assert M.tasks("- [ ] a\n  - [x] b\n- [X] c\n-[ ] d\n- [] e") == [("a", False, 1), ("b", True, 2), ("c", True, 3)]
    assert M.code_segments("a `b` c\n```\nd\n```\n$e$") == [("a ", False), ("`b`", True), (" c\n", False), ("```\nd\n```", True), ("\n", False), ("$e$", True)]


@pytest.mark.parametrize("token, parts", [
    ("ReactComponent", ["React", "Component"]), ("HTMLParser", ["HTML", "Parser"]), ("test_runner", ["test", "runner"]), ("data2model", ["data", "2", "model"]),
    ("getElementById", ["get", "Element", "By", "Id"]), ("日本", ["日本"]), ("HTMLParser2go", ["HTML", "Parser", "2", "go"]),
])
def test_identifiers(token, parts):
    assert T.identifier_parts(token) == parts


def test_tokens():
    assert T.normalise("ＡＢＣ１２３ が") == "abc123 が"
    assert T.merge_dictionary(["in", "New", "York", "City", "Chat", "GPT"], {"New York", "New York City", "ChatGPT"}) == ["in", "New York City", "ChatGPT"]
    assert T.merge_dictionary(["new", "york"], {"New York"}) == ["new", "york"] and T.merge_dictionary([], {"a"}) == []
    assert T.collect("a a b\nb c_d") == ["a", "b", "c", "d"]
    assert T.and_query('a "b') == '"a" AND """b"' and T.or_query("a b") == '"a" OR "b"'
    assert T.match_string(T.expand(["a", "b"], {"b": ["c"]})) == '"a" AND ("b" OR "c")'
    assert T.tokenised("Use `fooBar` now") == "use `foobar` now"


def test_snippets():
    text = "one\ntwo\nthree TARGET\nfour\nfive"
    assert S.snippet(text, "target", 1, 100) == "two\nthree TARGET\nfour"
    assert S.snippet(text, "target", 0, 100) == "TARGET" and S.snippet(text, "", 1, 3) == "one…" and S.snippet(text, "zzz", 1, 3) == "one…"
    assert S.snippet("İİİ target", "target", 0, 50) == "target" and S.snippet("abc", "a", 2, 2) == "ab…"
    assert S.highlight("The the", "the") == "**The** **the**" and S.highlight("a.b", ".") == "a**.**b"
    for rank, row in ((-1.5, 42), (1e-20, 7), (-1234567.875, 0)):
        assert S.decode_cursor(S.encode_cursor(rank, row)) == (rank, row)
    assert S.decode_cursor("!!!") is None and S.decode_cursor("djE6MTox") is None


@pytest.mark.parametrize("pattern, path, hit", [
    ("node_modules", "a/node_modules/x.md", True), ("node_modules", "node_modules.md", False), ("drafts/*.md", "x/drafts/a.md", True), ("/drafts/", "drafts/a.md", True),
    ("draft_*", "draft_1/a.md", True), ("draft_*", "draft_1.md", False), ("a/**", "a/b/c.md", True), ("a[", "a[/x", False), ("", "x", False), ("?.md/x", "a.md/x", True), ("{a,b}/c", "z/b/c", True),
])
def test_globs(pattern, path, hit):
    import re

    regex = glob_regex(pattern)
    assert bool(regex and re.match(regex, path)) is hit


def test_masks_are_in_order():
    assert [MASKS[0][0], MASKS[-1][0], len(MASKS)] == ["EMAIL", "PHONE", 15]


def test_admission():
    assert admit([0, 1, 2, 999_999, 1_000_000, 1_000_001], 2)[0] == [True, True, False, False, True, True]


def line(text, x0, y0, x1, y1, size=12.0):
    return Line(text, x0, y0, x1, y1, size)


def test_pages():
    assert [x.text for x in cluster([line("a", 0, 100, 5, 112), line("b", 6, 101, 9, 112), line("c", 0, 80, 5, 92)])] == ["ab", "c"]
    left, right = [line(f"l{i}", 0, 100 - 20 * i, 80, 112 - 20 * i) for i in range(3)], [line(f"r{i}", 110, 100 - 20 * i, 190, 112 - 20 * i) for i in range(3)]
    # rows of both columns are level, so the cut between them comes first only where no gap runs across the page
    level = [x for pair in zip(left, right) for x in pair]
    shifted = [*left, *[line(x.text, x.x0, x.y0 - 10, x.x1, x.y1 - 10) for x in right]]
    assert [x.text for x in reading_order(shifted, 200)] == ["l0", "l1", "l2", "r0", "r1", "r2"]
    title = line("T", 0, 150, 195, 170, 18.0)
    got = reading_order([title, *level], 200)
    assert got[0] is title and to_markdown(got, body_size(got)).startswith("# T\n")
    assert body_size([]) == 0.0
