"""Snippets around the first hit of a query, highlights, and cursors. Pure functions."""

from __future__ import annotations

import base64
import re
from decimal import Decimal

ELLIPSIS = "…"


def snippet(text: str, query: str, max_lines: int, max_chars: int) -> str:
    """Lines around the earliest hit of any word of the query; without words or hits the text's opening.

    Places are found character by character, so letters that change length in lower case shift nothing (Q25).
    """
    flat = text.lower() if text.isascii() else "".join(map(str.lower, text))
    # no letter is gone in lower case, so equal lengths mean that each is one still
    origin = range(len(text)) if len(flat) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    hits = [origin[p] for p in (flat.find(w.lower()) for w in query.split()) if p >= 0]
    if not hits:
        return text[:max_chars] + ELLIPSIS
    start = min(hits)
    if max_lines:
        ends = [m.start() for m in re.finditer("\n", text[:start])]
        start = ends[-max_lines - 1] + 1 if len(ends) > max_lines else 0
    shown = "\n".join(line.removesuffix("\r") for line in text[start:].split("\n")[: 2 * max_lines + 1]).removesuffix("\n")
    return shown if len(shown) <= max_chars else shown[:max_chars] + ELLIPSIS


def highlight(text: str, query: str, before: str = "**", after: str = "**") -> str:
    """Wrap each occurrence of the whole query, whatever its case."""
    return re.sub(re.escape(query), lambda m: before + m[0] + after, text, flags=re.I) if query else text


def encode_cursor(rank: float, row: int) -> str:
    """URL-safe base64 without padding of ``v2:rank:row``; the rank is written without an exponent."""
    return base64.urlsafe_b64encode(f"v2:{Decimal(repr(rank)):f}:{row}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[float, int] | None:
    """(rank, row), or None for anything that is no cursor."""
    try:
        version, rank, row = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().split(":")
        return (float(rank), int(row)) if version == "v2" else None
    except ValueError:
        return None
