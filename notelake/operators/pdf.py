"""Page geometry: characters to lines, reading order by recursive cuts, lines to Markdown."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDE, Y_GAP, X_GAP = 0.8, 2.0, 5.0
#: Font size over the body's size from which a line is a heading.
HEADINGS = ((1.5, "# "), (1.2, "## "))


@dataclass
class Line:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    font_size: float


def cluster(chars: list[Line]) -> list[Line]:
    """Lines of characters whose base differs by at most half the line's font size; highest line first."""
    out: list[Line] = []
    for c in chars:
        line = next((x for x in out if abs(x.y0 - c.y0) <= 0.5 * x.font_size), None)
        if line is None:
            out.append(Line(c.text, c.x0, c.y0, c.x1, c.y1, c.font_size))
        else:
            line.text += c.text  # the line keeps its first left edge
            line.y0 = min(line.y0, c.y0)
            line.x1, line.y1 = max(line.x1, c.x1), max(line.y1, c.y1)
    return sorted(out, key=lambda x: -x.y0)


def widest_gap(spans: list[tuple[float, float]], least: float) -> tuple[float, float] | None:
    """The widest stretch that no span touches, at least so wide."""
    best, reach = None, None
    for lo, hi in sorted(spans):
        if reach is not None and lo - reach >= least and (best is None or lo - reach > best[1] - best[0]):
            best = (reach, lo)
        reach = hi if reach is None else max(reach, hi)
    return best


def reading_order(lines: list[Line], page_width: float) -> list[Line]:
    """Recursive cuts at the widest vertical gap, then the widest horizontal one; lines across the page stay in place by height."""
    wide = [x for x in lines if x.x1 - x.x0 >= WIDE * page_width]
    rest = [x for x in lines if x.x1 - x.x0 < WIDE * page_width]

    def cut(part: list[Line]) -> list[Line]:
        if len(part) < 2:
            return part
        if gap := widest_gap([(x.y0, x.y1) for x in part], Y_GAP):
            return cut([x for x in part if x.y0 >= gap[1]]) + cut([x for x in part if x.y1 <= gap[0]])
        if gap := widest_gap([(x.x0, x.x1) for x in part], X_GAP):
            return cut([x for x in part if x.x1 <= gap[0]]) + cut([x for x in part if x.x0 >= gap[1]])
        return sorted(part, key=lambda x: -x.y0)

    out: list[Line] = []
    for bar in sorted(wide, key=lambda x: -x.y0):
        above = [x for x in rest if x.y0 > bar.y0]
        out += [*cut(above), bar]
        rest = [x for x in rest if x.y0 <= bar.y0]
    return out + cut(rest)


def body_size(lines: list[Line]) -> float:
    """The most frequent font size in half points, ties to the smaller (Q23); 12 without lines."""
    sizes = Counter(round(x.font_size * 2) for x in lines)
    return min(sizes, key=lambda s: (-sizes[s], s)) / 2 if sizes else 12.0


def to_markdown(lines: list[Line], body: float) -> str:
    """Trimmed lines; headings stand between blank lines, and lines of white space are gone."""
    out: list[str] = []
    for x in lines:
        if not (text := x.text.strip()):
            continue
        mark = next((m for ratio, m in HEADINGS if body > 0 and x.font_size / body >= ratio), "")
        out += [*([""] if mark and out else []), mark + text, *([""] if mark else [])]
    return "\n".join(out)


def page_text(chars: list[Line], page_width: float) -> str:
    lines = cluster([c for c in chars if c.text.strip()])
    return to_markdown(reading_order(lines, page_width), body_size(lines))


def extractor(backend):
    """What ``vault.read_texts`` takes as ``pdf``: ``backend`` maps a file's bytes to pages of (width, characters).

    A character is (text, x0, y0, x1, y1, font_size), in the order of the file, its origin at the bottom left. Pages
    without text leave no trace.
    """

    def run(data: bytes) -> str:
        return "\n".join(t for width, chars in backend(data) if (t := page_text([Line(*c) for c in chars], width)))

    return run


def pages(chars: DataFrame, page_width: float) -> DataFrame:
    """(doc, page, markdown) from ``chars(doc, page, n, text, x0, y0, x1, y1, font_size)``; a page is a bounded group.

    Python gets the characters of many pages in a batch, page by page, and holds one batch and the page that is open.
    """
    names = ["text", "x0", "y0", "x1", "y1", "font_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            done = []
            numbers = [b.column(n).to_numpy(zero_copy_only=False).tolist() for n in names[1:]]
            lines = map(Line, b.column("text").to_pylist(), *numbers)
            for key, line in zip(zip(b.column("doc").to_pylist(), b.column("page").to_pylist()), lines):
                if key != now:
                    if held:
                        done.append((*now, page_text(held, page_width)))
                    now, held = key, []
                held.append(line)
            yield made(done)
        if held:
            yield made([(*now, page_text(held, page_width))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        docs, numbers, texts = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], ["doc", "page", "markdown"])

    rows = chars.select(F.col("doc").cast("string"), F.col("page").cast("int"), "n", "text", *[F.col(n).cast("double") for n in names[1:]])
    return rows.repartition("doc", "page").sortWithinPartitions("doc", "page", F.asc_nulls_last("n")).drop("n").mapInArrow(run, "doc string, page int, markdown string")
