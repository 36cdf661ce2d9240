"""Problem 4: splitting oversized items at natural boundaries.

Method: recursive bisection. A text over the limit is cut at the strongest boundary near its middle, the halves again while
they exceed the limit less the overlap, and then each piece gets the last words of the one before it. Tables are cut
between rows and each piece repeats the header instead. Only items over the limit go through Python, one by one; the
others stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingsift.functions.text import SPACE, word_count

_WORD = re.compile(rf"[^{SPACE}]+")
_ROW = re.compile(r"\s*\|")
_RULE = re.compile(r"[\s|:\-]+")
#: How far from the middle a cut may be, as a share of the span.
REACH = 0.25
#: Words of its own that a piece of a table has at least beside the header, as a share of the limit.
OWN_SHARE = 0.125
PIECES = "item_id string, piece_no int, section string, kind string, piece string, words int, core_start int, core_end int, header string"


def _strengths(text: str, starts: np.ndarray, ends: np.ndarray, table: bool) -> np.ndarray:
    """Strength of the boundary before each word: 3 paragraph (or table row), 2 line or sentence, 1 clause, 0 none."""
    out = np.zeros(len(starts), np.int8)
    for k in range(1, len(starts)):
        gap = text[ends[k - 1] : starts[k]]
        last = text[ends[k - 1] - 1]
        breaks = gap.count("\n")
        if breaks and (table or breaks > 1):
            out[k] = 3
        elif breaks or last in ".!?" or (last in "\"')]”" and ends[k - 1] - starts[k - 1] > 1 and text[ends[k - 1] - 2] in ".!?"):
            out[k] = 2
        elif last in ",;:|":
            out[k] = 1
    return out


def _cuts(strength: np.ndarray, first: int, last: int, limit: int) -> Iterator[tuple[int, int]]:
    """Word ranges of at most ``limit`` words, in order; a stack instead of recursion, so that no length is too deep."""
    stack = [(first, last)]
    while stack:
        a, b = stack.pop()
        if b - a <= limit:
            yield a, b
            continue
        middle = (a + b) // 2
        reach = max(1, int((b - a) * REACH))
        near = np.arange(max(a + 1, middle - reach), min(b, middle + reach + 1))
        best = near[strength[near] == strength[near].max()]
        cut = int(best[np.abs(best - middle).argmin()])
        stack += [(cut, b), (a, cut)]


def header_of(text: str) -> str:
    """What every piece of a table repeats: all lines up to the rule below the first row, or else up to the first row; empty
    where there is no row."""
    lines = text.split("\n")
    rows = [k for k, x in enumerate(lines) if _ROW.match(x)]
    if not rows:
        return ""
    n = rows[0] + 1
    if n < len(lines) and _ROW.match(lines[n]) and _RULE.fullmatch(lines[n]):
        n += 1
    return "\n".join(lines[:n])


def split_text(text: str, table: bool, limit: int, overlap: int) -> list[tuple[str, int, int, int]]:
    """(piece, words, start, end) of a text: start and end bound what a piece adds to those before it, and the pieces'
    ranges follow each other without a gap from the first word to the last. No piece has more than ``limit`` words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) <= limit:
        return [(text, len(spans), 0, len(text))]
    starts, ends = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    header, head_words = "", 0
    if table:
        head = header_of(text)
        if head and fits(head, limit):
            header, head_words = head + "\n", int(np.searchsorted(starts, len(head)))
        overlap = 0
    overlap = max(0, min(overlap, limit // 2))
    strength = _strengths(text, starts, ends, table)
    size = limit - head_words - overlap
    out = []
    for a, b in _cuts(strength, head_words, len(spans), size):
        begin = 0 if not out else starts[a]
        upto = len(text) if b == len(spans) else starts[b]
        from_word = a if not out else max(head_words, a - overlap)
        lead = text[:starts[a]] if not out and not head_words else "" if not out else header
        piece = text[: ends[b - 1]] if not out else lead + text[starts[from_word] : ends[b - 1]]
        words = b if not out else b - from_word + (head_words if header else 0)
        out.append((piece, int(words), int(begin), int(upto)))
    return out


def fits(header: str, limit: int) -> bool:
    """Whether a header leaves room for words of a piece's own."""
    return len(_WORD.findall(header)) <= limit - max(1, int(limit * OWN_SHARE))


def pieces(items: DataFrame, limit: int = 512, overlap: int = 64) -> DataFrame:
    """(item_id, piece_no, section, kind, piece, words, core_start, core_end, header) of items (item_id, section, kind, text).

    An item within the limit is one piece, unchanged; null and blank texts and null ids give none. A word longer than
    anything stays whole: pieces are counted in words. Kind ``table`` is cut between rows, any other (null too) as running
    text with ``overlap`` words repeated. core_start and core_end are the character range that a piece adds, so joining
    these ranges in order gives the text back. header says of the pieces of a table whether they have its header:
    ``repeated``, ``none`` (the table has no row) or ``too long`` (with it, there is hardly room for a row: only the first
    pieces hold it); null for other pieces. Of rows that repeat an item the longest counts, then the greatest text.
    """
    items = items.select("item_id", "section", "kind", "text").where("item_id is not null").withColumn("words", word_count(F.col("text"))).where("words > 0")

    def once(rows: DataFrame) -> DataFrame:
        rest = ["words", "text", "section", "kind"]
        return rows.groupBy("item_id").agg(F.max(F.struct(*rest)).alias("r")).select("item_id", *[F.col("r")[c].alias(c) for c in rest])

    large = once(items.where(F.col("words") > limit))
    small = once(items.where(F.col("words") <= limit)).join(large.select("item_id"), "item_id", "left_anti")
    whole = small.select("item_id", F.lit(0).alias("piece_no"), "section", "kind", F.col("text").alias("piece"), "words", F.lit(0).alias("core_start"), F.length("text").alias("core_end"), F.lit(None).cast("string").alias("header"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                table = (r.kind or "").strip().lower() == "table"
                head = header_of(r.text) if table else ""
                state = None if not table else "none" if not head else "repeated" if fits(head, limit) else "too long"
                for k, (piece, words, start, end) in enumerate(split_text(r.text, table, limit, overlap)):
                    rows.append((r.item_id, k, r.section, r.kind, piece, words, start, end, state))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in PIECES.split(", ")])

    cut = large.select("item_id", "section", "kind", "text").mapInPandas(run, PIECES)
    return whole.unionByName(cut)
