"""Pieces of at most `limit` characters of oversized texts, cut at natural boundaries.

Lexical cohesion: between neighbouring sentences the words of the sentences before and
after are compared by cosine over sliding blocks; a valley's depth is how far similarity
rises on both sides. In each window of sizes the deepest valley is the cut. A text
without sentence ends in the window is cut at a clause, a word or, failing all, a
character. The next piece begins at the boundary that leaves `overlap` shared characters
as nearly as boundaries allow.

Plan. Lengths are tested by built-in expressions, so only oversized texts are shuffled
(twins fall there) and reach Python.

Defined results: length is counted in code points after spaces, tabs and line ends at
both ends are removed; pieces are exact parts of the whole text, so nothing is lost;
texts within the limit, null and blank ones have no pieces; rows that share a key but not
the text are split each.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, BLOCK = 1_400, 150, 3
_SENTENCE = re.compile(r"[.!?…][\"”’')\]]*\s+|\n+(?=\s*(?:[-*•–▪#|>]|\(?\d+[.)]|[A-Z\"“]))|\n\s*\n\s*")
_CLAUSE = re.compile(r"[;:,]\s+|\s[–—]\s+|\n+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]{3,}")


def stripped_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def _cosine(a: Counter, b: Counter) -> float:
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def valleys(text: str, ends: list[int], block: int = BLOCK) -> list[float]:
    """Depth of the similarity valley at every sentence end but the last position."""
    starts = [0, *ends]
    words = [Counter(_WORD.findall(text[a:b].lower())) for a, b in zip(starts, [*ends, len(text)])]
    sims = []
    for i in range(len(ends)):
        left, right = Counter(), Counter()
        for w in words[max(0, i + 1 - block) : i + 1]:
            left.update(w)
        for w in words[i + 1 : i + 1 + block]:
            right.update(w)
        sims.append(_cosine(left, right))
    # highest similarity on the way up at either side
    n = len(sims)
    before, after = sims[:], sims[:]
    for i in range(1, n):
        before[i] = before[i - 1] if before[i - 1] > sims[i] else sims[i]
        if sims[i - 1] <= sims[i]:
            before[i] = sims[i]
    for i in range(n - 2, -1, -1):
        after[i] = after[i + 1] if sims[i + 1] > sims[i] else sims[i]
    return [before[i] + after[i] - 2 * sims[i] for i in range(n)]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int]]:
    """Ranges [start, end) of the pieces, in order; the whole text if it is within the limit."""
    size = len(text)
    if size <= limit:
        return [(0, size)] if size else []
    overlap = max(0, min(overlap, limit // 2 - 1))
    ends = sorted({m.end() for m in _SENTENCE.finditer(text)} - {0, size})
    depth = valleys(text, ends, block)
    clauses = [m.end() for m in _CLAUSE.finditer(text)]
    spaces = [m.end() for m in _SPACE.finditer(text)]

    def within(places: list[int], low: int, high: int) -> range:
        return range(bisect.bisect_left(places, low), bisect.bisect_right(places, high))

    out, start, done = [], 0, 0
    while True:
        if size - start <= limit:
            out.append((start, size))
            return out
        low, high = max(start + limit // 2, done + 1), start + limit
        own = within(ends, low, high)
        if len(own):
            cut = ends[max(own, key=lambda i: (round(depth[i], 9), i))]
        else:
            cut = next((p[r[-1]] for p in (clauses, spaces) if len(r := within(p, low, high))), high)
        out.append((start, cut))
        start, done = _restart(start, cut, overlap, ends, spaces), cut


def _restart(start: int, cut: int, overlap: int, ends: list[int], spaces: list[int]) -> int:
    """Where the next piece begins: the boundary nearest to the wanted place, a sentence's before a word's; the place itself if none is near."""
    if not overlap:
        return cut
    want, near = cut - overlap, []
    for kind, places in enumerate((ends, spaces)):
        i = bisect.bisect_left(places, want)
        near += [(abs(p - want), kind, p) for p in places[max(0, i - 1) : i + 1] if start < p < cut and abs(p - want) <= overlap // 2]
    return min(near)[2] if near else max(start + 1, want)


def oversized(df: DataFrame, kind: str, item_key: Column, path: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """(item_kind, item_key, heading_path, text) of the texts over the limit."""
    path = F.lit(None).cast("array<string>") if path is None else path
    return df.filter(stripped_length(F.col("text")) > limit).select(F.lit(kind).alias("item_kind"), item_key.alias("item_key"), path.alias("heading_path"), "text")


def split_pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_kind, item_key, piece_no, n_pieces, start, end, piece, heading_path) of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for kind, key, path, text in zip(d["item_kind"], d["item_key"], d["heading_path"], d["text"]):
                parts = split_text(text, limit, overlap)
                rows += [(kind, key, n, len(parts), a, b, text[a:b], path) for n, (a, b) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["item_kind", "item_key", "piece_no", "n_pieces", "start", "end", "piece", "heading_path"])

    return items.dropDuplicates(["item_kind", "item_key", "text"]).mapInPandas(
        run, "item_kind string, item_key string, piece_no int, n_pieces int, start int, end int, piece string, heading_path array<string>"
    )
