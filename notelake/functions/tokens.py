"""Tokens: normal forms, identifiers, dictionaries and boolean queries. Pure functions over strings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

#: Terms of the full-text index: runs of letters, numbers and private-use characters (as a regex of the ``regex`` kind).
TERM = r"[\p{L}\p{N}\p{Co}]+"
_CJK = r"[぀-ヿ㐀-鿿豈-﫿]+"
_WORD = re.compile(rf"{_CJK}|[^\W_]+(?:_[^\W_]+)*|[^\s\w]", re.UNICODE)
#: Borders within an identifier: aA, a1, 1a, ABc.
BORDERS = r"_+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])"

Tokenizer = Callable[[str], list[str]]


def normalise(text: str) -> str:
    """Compatibility composition, then lower case."""
    return unicodedata.normalize("NFKC", text).lower()


def whitespace(line: str) -> list[str]:
    return line.split()


def words(line: str) -> list[str]:
    """The default tokenizer: words, and runs of one script where words are not spaced. A segmenter can stand in for it."""
    return [w for w in _WORD.findall(line) if any(c.isalnum() for c in w)]


def identifier_parts(token: str) -> list[str]:
    """Parts of an identifier; a token without ASCII letters or digits stays whole."""
    if not re.search(r"[A-Za-z0-9]", token):
        return [token]
    return [p for p in re.split(BORDERS, token) if p]


def collect(text: str, tokenizer: Tokenizer = words) -> list[str]:
    """Tokens line by line, identifiers in parts, without immediate repeats."""
    out: list[str] = []
    for line in text.splitlines():
        for token in tokenizer(line.strip()):
            out += [p for p in identifier_parts(token) if p.strip()]
    return [t for i, t in enumerate(out) if i == 0 or t != out[i - 1]]


def merge_dictionary(tokens: list[str], entries: set[str]) -> list[str]:
    """Join the longest runs, from the left, that make an entry with or without spaces."""
    widest = max((len(e) for e in entries), default=0)
    out, i = [], 0
    while i < len(tokens):
        spans = range(min(len(tokens), i + widest), i + 1, -1)
        hit = next(((j, e) for j in spans for e in (" ".join(tokens[i:j]), "".join(tokens[i:j])) if e in entries), None)
        j, token = hit or (i + 1, tokens[i])
        out.append(token)
        i = j
    return out


def tokenised(content: str, tokenizer: Tokenizer = words, entries: set[str] = frozenset()) -> str:
    """What the index sees of a chunk: code by white space, prose by the tokenizer, in normal form."""
    from .markdown import code_segments

    found: list[str] = []
    for segment, code in code_segments(content):
        found += segment.split() if code else collect(segment, tokenizer)
    return normalise(" ".join(merge_dictionary(found, set(entries))))


def quoted(tokens: list[str], joiner: str) -> str:
    return f" {joiner} ".join('"' + t.replace('"', '""') + '"' for t in tokens)


def and_query(text: str) -> str:
    return quoted(text.split(), "AND")


def or_query(text: str) -> str:
    return quoted(text.split(), "OR")


def expand(tokens: list[str], synonyms: dict[str, list[str]]) -> list[list[str]]:
    """Groups of alternatives, all of which a match must meet; tokens are looked up exactly."""
    return [[t, *synonyms.get(t, ())] for t in tokens]


def match_string(groups: list[list[str]]) -> str:
    return " AND ".join(quoted(g, "OR") if len(g) == 1 else f"({quoted(g, 'OR')})" for g in groups)
