"""Oversized items cut into pieces at natural boundaries, with overlap.

Balanced targets: from the least number of pieces that can hold the item, targets are
placed at equal distances, each is snapped to the strongest boundary near it, and pieces
are added when any of them fails its limit.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 1600
OVERLAP = 200

#: Strengths of boundaries; a cut goes behind them.
PARAGRAPH, DEFINITION, BLANK_LINE, MARGIN, SHALLOW, LINE, SENTENCE, CLAUSE, WORD = range(9, 0, -1)
#: Every pattern goes over the text once, without going back.
_SPACE = re.compile(r"\s++")
_DEFINES = re.compile(r"(?:export |async |public |private |static )*+(?:def|class|function|interface|type|const|@|#+ )\b")
_SENTENCE = re.compile(r"[.!?。！？](?:[ \t]++|(?=[^\x00-\x7f]))")
_CLAUSE = re.compile(r"[;,{}、，]\s*+")


def _cuts(text: str) -> list[tuple[int, int]]:
    """(position, strength) of all boundaries, in order; larger is stronger."""
    best: dict[int, int] = {}

    def add(at: int, strength: int) -> None:
        if strength > best.get(at, 0):
            best[at] = strength

    for m in _SPACE.finditer(text):
        space, end = m.group(), m.end()
        add(end, CLAUSE if text[end : end + 1] in ("(", "{", "[") else WORD)
        n = space.count("\n")
        if not n:
            continue
        at = m.start()
        for _ in range(n):
            at = text.index("\n", at) + 1
            best[at] = max(LINE, best.get(at, 0))
        # at is behind the last line's end: the boundary proper.
        depth = end - at
        if not depth and end < len(text):
            add(at, PARAGRAPH if n > 1 else DEFINITION if _DEFINES.match(text, end) else MARGIN)
        elif n > 1:
            add(at, BLANK_LINE)
        elif depth <= 4 or text[at - 2 : at - 1] in ("}", ";"):
            add(at, SHALLOW)
    for m in _SENTENCE.finditer(text):
        add(m.end(), SENTENCE)
    for m in _CLAUSE.finditer(text):
        add(m.end(), CLAUSE)
    best.pop(0, None)
    best.pop(len(text), None)
    return sorted(best.items())


def _whole(text: str, at: int) -> int:
    """at, moved back so that it splits no CRLF and no combined character."""
    while 0 < at < len(text) and (text[at - 1 : at + 1] == "\r\n" or "̀" <= text[at] <= "ͯ" or text[at] in "‍️" or text[at - 1] == "‍" or "\U0001f3fb" <= text[at] <= "\U0001f3ff"):
        at -= 1
    return at


def _start(text: str, cut: int, floor: int, overlap: int, lines: list[int], words: list[int]) -> int:
    """Where the piece after a cut begins: the first line, else word, start within the overlap."""
    least = max(cut - overlap, floor)
    for places in (lines, words):
        k = bisect.bisect_left(places, least)
        if k < len(places) and places[k] < cut:
            return places[k]
    back = _whole(text, least)
    return back if least > floor and back >= cut - overlap else cut if least <= floor else least


def _place(text: str, n: int, limit: int, overlap: int, cuts: list[tuple[int, int]], places: list[int], lines: list[int], words: list[int]) -> list[tuple[int, int]] | None:
    """Spans of n pieces: n - 1 equally distant targets, each moved to the strongest boundary near it; None if a piece would be too long."""
    total, start, reach = len(text), 0, max(1, limit // 4)
    spans = []
    for k in range(1, n):
        target = k * total // n + overlap // 2
        low, high = max(start + overlap + 1, target - reach), min(start + limit, target + reach)
        if low > high:
            if target > start:
                return None
            continue
        near = range(bisect.bisect_left(places, low), bisect.bisect_right(places, high))
        best = max(near, key=lambda i: (cuts[i][1], -abs(places[i] - target)), default=None)
        end = places[best] if best is not None else _whole(text, min(max(target, low), high))
        if end <= start + overlap:  # a combined character with no room for it
            end = start + limit
        if end >= total:
            break
        spans.append((start, end))
        start = _start(text, end, start + 1, overlap, lines, words)
    return [*spans, (start, total)] if total - start <= limit else None


def split_text(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) spans covering the text, each of at most limit code points.

    Consecutive spans overlap by at most overlap.  A text within the limit is one span,
    an empty one none.  Pieces are added until all are within the limit.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("need 0 <= overlap < limit")
    total = len(text)
    if total <= limit:
        return [(0, total)] if total else []
    cuts = _cuts(text)
    places = [p for p, _ in cuts]
    lines = [m.end() for m in re.finditer(r"\n", text)]
    words = [m.end() for m in _SPACE.finditer(text)]
    n = -(-(total - overlap) // (limit - overlap))
    while n <= 2 * total:
        if spans := _place(text, n, limit, overlap, cuts, places, lines, words):
            return spans
        n += 1 + n // 16
    return [(at, min(at + limit, total)) for at in range(0, total, limit)]


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, first, text in zip(pdf["chunk_id"], pdf["first_line"], pdf["content"], strict=True):
                line, at = first, 0
                for no, (a, b) in enumerate(split_text(text, limit, overlap)):
                    line, at = line + text.count("\n", at, a), a
                    out.append((key, no, text[a:b], line, line + text.count("\n", a, b)))
            yield pd.DataFrame(out, columns=["chunk_id", "piece_no", "content", "start_line", "end_line"])

    return run


def split_oversized(chunks: DataFrame, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (chunk_id, piece_no, content, start_line, end_line, n_chars) of the chunks over the limit.

    Lines are 1-based lines of the whole file, end_line one past the last line of a piece
    that ends in a newline.  A null start_line counts as 1.  Null contents and contents
    within the limit need no cut and are left out; repeated rows give their pieces once.
    """
    big = (
        chunks.where(F.length("content") > limit)
        .select("chunk_id", F.coalesce("start_line", F.lit(1)).cast("int").alias("first_line"), "content")
        .dropDuplicates()
    )
    return big.mapInPandas(_pieces(limit, overlap), "chunk_id string, piece_no int, content string, start_line int, end_line int").withColumn("n_chars", F.length("content"))
