"""Markdown as data: frontmatter, sections, paragraphs, chunks, code segments, marks. Pure functions over strings.

Decisions taken where behaviour could go either way: an indented closing fence of the frontmatter is dropped whole (Q10);
the title comes from the frontmatter alone (Q11); frontmatter keeps quotes around titles, dates and listed tags.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: A section longer than this is cut into paragraphs.
LONG_SECTION = 1000

_OPEN = re.compile(r"\s*---\s*")
_CLOSE = re.compile(r"^[ \t]*(?:---|\.\.\.)[ \t]*\r?$\n?", re.M)
_FENCE = re.compile(r"\s*(?:```|~~~)")
_HEADING = re.compile(r"\s*(#{1,3}) +(.*)$|\s*(#{1,3}) ()$")
_MARKED = re.compile(r"==(.*?)==|\*\*(?!\*)(.*?)\*\*", re.S)
_LINK = re.compile(r"\[\[(.*?)\]\]", re.S)
_TASK = re.compile(r"\s*- \[([ xX])\] (.*)$", re.S)


@dataclass
class Frontmatter:
    title: str | None = None
    date: str | None = None
    tags: list[str] = field(default_factory=list)


def lines(text: str) -> list[str]:
    """Lines without their ends; a final newline opens no line."""
    got = text.split("\n")
    if got and got[-1] == "":
        got.pop()
    return [x.removesuffix("\r") for x in got]


def frontmatter(text: str) -> tuple[Frontmatter, str]:
    """Metadata and body; a text without an opened and closed block is all body."""
    text = text.lstrip()
    opened = _OPEN.match(text)
    if not opened:
        return Frontmatter(), text
    head = text[opened.end() :]
    closed = _CLOSE.search(head)
    if not closed:
        return Frontmatter(), text
    return metadata(head[: closed.start()]), head[closed.end() :].lstrip()


def metadata(block: str) -> Frontmatter:
    """``key: value`` lines; tags in brackets, by commas, or as a list that a blank line ends."""
    out, listing = Frontmatter(), False
    for line in map(str.strip, lines(block)):
        if listing and line.startswith("- "):
            out.tags += [line[2:].strip()] if line[2:].strip() else []
            continue
        listing = False
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key in ("title", "date"):
            setattr(out, key, value or getattr(out, key))
        elif key == "tags" and not value:
            listing = True
        elif key == "tags":
            inner = value[1:-1] if value[0] == "[" and value[-1] == "]" and len(value) > 1 else value
            out.tags += [t for t in (x.strip().strip('"').strip("'") for x in inner.split(",")) if t]
    return out


def outside_fences(text: str):
    """(line, True if it is neither in a fenced block nor one of its fences)."""
    inside = False
    for line in lines(text):
        fence = bool(_FENCE.match(line))
        yield line, not inside and not fence
        inside ^= fence


def sections(body: str) -> list[tuple[list[str], str]]:
    """(headings above, text) by headings of one to three marks; a heading ends those of its level and below."""
    stack: dict[int, str] = {}
    out: list[tuple[list[str], list[str]]] = []
    now: list[str] = []
    for line, free in outside_fences(body):
        heading = free and _HEADING.match(line)
        if not heading:
            now.append(line)
            continue
        if stack or any(x.strip() for x in now):
            out.append((list(stack.values()), now))
        now = []
        level = len(heading[1] or heading[3])
        stack = {k: v for k, v in stack.items() if k < level} | {level: (heading[2] or "").strip()}
    out.append((list(stack.values()), now))
    return [(h, "".join(x + "\n" for x in ls)) for h, ls in out]


def paragraphs(text: str) -> list[str]:
    """Runs of lines between blank lines that are outside fences."""
    out: list[list[str]] = [[]]
    for line, free in outside_fences(text):
        if free and not line.strip():
            out.append([])
        else:
            out[-1].append(line)
    return [t for t in ("".join(x + "\n" for x in run) for run in out) if t.strip()]


def chunks(text: str) -> list[dict]:
    """Chunks of a note in order: chunk_index, parent_header (or None), content, title, tags (CSV), frontmatter_date."""
    meta, body = frontmatter(text)
    own = {"title": meta.title or "", "tags": ",".join(meta.tags), "frontmatter_date": meta.date or ""}
    pieces: list[tuple[str | None, str]] = []
    for headings, part in sections(body):
        header, part = " > ".join(headings) or None, part.strip()
        if part:
            pieces += [(header, p.strip()) for p in paragraphs(part)] if len(part) > LONG_SECTION else [(header, part)]
    pieces = pieces or [(None, body.strip())]
    return [{"chunk_index": i, "parent_header": h, "content": c, **own} for i, (h, c) in enumerate(pieces)]


def code_segments(text: str) -> list[tuple[str, bool]]:
    """(segment, is code): fenced blocks, ``$$`` blocks, and inline code or mathematics within a line."""
    pattern = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)|\$\$.*?\$\$|`[^`\n]+`|\$[^$\n]+\$", re.S | re.M)
    out, at = [], 0
    for m in pattern.finditer(text):
        out += [(text[at : m.start()], False)] * (m.start() > at) + [(m[0], True)]
        at = m.end()
    return out + [(text[at:], False)] * (at < len(text))


def emphasised(text: str) -> str:
    """Marked and bold passages, trimmed, joined by a space."""
    return " ".join(x for x in ((m[1] if m[1] is not None else m[2]).strip() for m in _MARKED.finditer(text)) if x)


def wikilinks(text: str) -> list[str]:
    """Targets of links, without aliases, headings and block marks."""
    names = (m[1].split("|")[0] for m in _LINK.finditer(text))
    return [n for n in (x.split("#" if "#" in x else "^")[0].strip() for x in names) if n]


def tasks(text: str) -> list[tuple[str, bool, int]]:
    """(content, checked, line number from 1) over the whole text, frontmatter included."""
    found = ((i, _TASK.match(line)) for i, line in enumerate(lines(text), 1))
    return [(m[2], m[1] != " ", i) for i, m in found if m]
