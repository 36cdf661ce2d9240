"""Problem 8: long exact spans shared between records.

Method: count-min prefilter. Pass 1 picks windows by content (in any ``length - PICK + 1`` neighbouring windows of PICK
characters the one of least hash), so two equal stretches of ``length`` characters always pick an equal window; each
task counts its picks in a sketch, and the merged sketches overestimate how many documents hold a pick. Pass 2 hashes
every window of ``length`` characters whose pick is estimated to be in two documents or more, and groups exactly these:
a window is shared if its group holds two documents. Nothing shared is lost, since a sketch only overestimates.

Neighbouring windows with one pick travel as one run of a few numbers, without the hashes of its windows. The runs are
grouped by pick. Where all runs of a pick are the same text, one comparison settles all their windows; only where they
differ, at the ends of shared passages, do single windows go back to their text, are hashed there and grouped.

The sketch is sized from the number of characters, up to MOST_BITS. Beyond about 5 GB of text it fills up and lets ever
more picks through, up to all of them. Then the grouping by pick does the work alone, exactly, at about 20 bytes for each
pick (some 2 in 100 characters), so the disk stays in proportion to the input; no hash of a window is written
before its pick is known to be in two documents.

Skew: both groupings are partial aggregations (least and greatest document), and rows come back through joins that Spark
may split, so one passage that stands in a third of all documents burdens no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingsift.functions.shared import written
from filingsift.llm import sketch
from filingsift.llm.hashing import Ranges, text_slices

#: Characters of a picked window, as a share of the stretch's length.
PICK_SHARE = 2 / 3
#: The sketch's rows of buckets, the buckets of each for one expected pick, and the most of them (as a power of two, 32 MB of bits).
SKETCH_ROWS, ROOM, MOST_BITS = 2, 16, 28
RUNS = "pick long, run long, doc_id {kind}, start int, count int"
WINDOWS = "hash long, doc_id {kind}, first int"


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def _characters(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a slice of UTF-8 texts, and the rows' offsets in them."""
    chars = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(chars) == len(data):
        return chars, offsets
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=heads[1:])
    return chars, heads[offsets]


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each slice of rows: row number, start, window hash and picked hash of every window of ``length`` characters."""
    pick = max(1, int(length * PICK_SHARE))
    near = length - pick + 1
    for first, _, data, offsets in text_slices(column):
        if len(data) < length:
            continue
        chars, offsets = _characters(data, offsets)
        n = len(chars) - length + 1
        if n <= 0:
            continue
        sizes = np.diff(offsets)
        fits = sizes >= length
        if not fits.any():
            continue
        ok = np.zeros(len(chars) + 1, np.int8)
        ok[offsets[:-1][fits]] += 1
        np.add.at(ok, offsets[1:][fits] - length + 1, -1)
        at = np.flatnonzero(np.cumsum(ok[:n], dtype=np.int32) > 0)
        ranges = Ranges(chars)
        picks = ranges.windows(pick)
        keys = (picks & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(picks), dtype=np.uint64)
        least = _sliding_least(keys, near)[at] & np.uint64(0xFFFFFFFF)
        rows = np.searchsorted(offsets, at, "right") - 1
        yield first + rows, at - offsets[rows], ranges, at, least.astype(np.int64), picks


def _runs(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Where neighbouring windows of one row have another pick than the one before."""
    return np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])])


def sketch_bits(docs: DataFrame, length: int) -> int:
    """Buckets of a row of the sketch, as a power of two: ROOM for each pick to expect, MOST_BITS at most."""
    windows = docs.agg(F.sum(F.length("text") - (length - 1))).first()[0] or 0
    picks = 2 * windows / (length - int(length * PICK_SHARE) + 2)
    return int(min(MOST_BITS, max(12, np.ceil(np.log2(ROOM * picks + 1)))))


def _repeated(rows: DataFrame, by: str, *more: Column) -> DataFrame:
    """(by, and ``more``) of what stands in two documents at least."""
    found = rows.groupBy(by).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), *more)
    return found.where("least < greatest").drop("least", "greatest")


def _windows_of(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """(hash, doc_id, first) of the single windows of ``runs``, hashed where their text is."""
    wanted = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("runs"))  # the runs of one document
    key = F.xxhash64("doc_id").alias("key")
    docs, _ = sketch.split_by(docs.select("doc_id", "text", key), "key", runs.select(key).distinct())  # the others hold no such run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2)
            of = np.asarray(asked.value_lengths())
            part = asked.flatten()
            row = np.repeat(np.arange(len(of)), of)
            start, count = part.field(0).to_numpy(), part.field(1).to_numpy()
            for first, to, data, offsets in text_slices(batch.column(1)):
                chars, offsets = _characters(data, offsets)
                own = np.flatnonzero((row >= first) & (row < to))
                last = offsets[row[own] - first + 1] - offsets[row[own] - first] - length  # rows that repeat a doc_id may be shorter
                n = np.maximum(np.minimum(count[own], last + 1 - start[own]), 0)
                if not n.sum():
                    continue
                at = np.repeat(start[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows = np.repeat(row[own], n)
                begin = offsets[rows - first] + at
                hashes = Ranges(chars).between(begin, begin + length)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array(at.astype(np.int32))], ["hash", "doc_id", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(wanted, "doc_id").select("doc_id", "text", "runs").mapInArrow(run, WINDOWS.format(kind=kind))


def shared_windows(documents: DataFrame, length: int = 240, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """(doc_id, first, last): ranges of the starts of the windows of ``length`` characters that stand in the text of
    another doc_id too. ``bits`` sets the size of the sketch, which changes costs and no result."""
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    bits = bits or sketch_bits(docs, length)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def picked() -> Iterator[np.ndarray]:
            for batch in batches:
                for rows, _, _, _, least, picks in _pieces(batch.column(1), length):
                    starts = _runs(rows, least)
                    row, hashes = rows[starts], picks[least[starts]]
                    order = np.lexsort((hashes, row))  # a pick counts once for a document
                    row, hashes = row[order], hashes[order]
                    yield hashes[np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]]

        yield from sketch.partial_repeated(picked(), bits, SKETCH_ROWS)

    seen = documents.sparkSession.sparkContext.broadcast(sketch.repeated(docs.mapInArrow(first, sketch.PARTIAL), bits, SKETCH_ROWS))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, start, ranges, at, least, picks in _pieces(batch.column(1), length):
                begins = _runs(rows, least)
                sizes = np.diff(np.r_[begins, len(at)])
                pick = picks[least[begins]]
                kept = sketch.may_repeat(seen.value, pick, bits, SKETCH_ROWS)
                if kept.any():
                    begins, sizes = begins[kept], sizes[kept]
                    whole = ranges.between(at[begins], at[begins + sizes - 1] + length)
                    yield pa.RecordBatch.from_arrays([pa.array(pick[kept].view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(pa.array(rows[begins])), pa.array(start[begins].astype(np.int32)), pa.array(sizes.astype(np.int32))], ["pick", "run", "doc_id", "start", "count"])

    runs = written(docs.mapInArrow(second, RUNS.format(kind=kind)), "runs")
    found = _repeated(runs, "pick", (F.min("run") == F.max("run")).alias("same"))
    found = written(runs.drop("run").join(found, "pick").drop("pick"), "repeated")
    whole = found.where("same").select("doc_id", F.col("start").alias("first"), (F.col("start") + F.col("count") - 1).alias("last"))
    single = written(_windows_of(docs, found.where("not same"), length), "windows")
    single = single.join(_repeated(single, "hash"), "hash", "left_semi").select("doc_id", "first", F.col("first").alias("last"))
    return whole.unionByName(single)


def shared_spans(documents: DataFrame, length: int = 240, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """(doc_id, span_start, span_end): the maximal runs of shared characters of each document.

    A character (code point) is shared if it lies in a stretch of ``length`` characters that occurs exactly so in the
    text of another doc_id. Null, empty and shorter texts have no span; a passage repeated inside one document only is
    none; rows that repeat a doc_id count as one document. Other columns are ignored.
    """
    order = Window.partitionBy("doc_id").orderBy("first", "last")
    windows = shared_windows(documents, length, doc_id, text, bits)
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce(F.col("first") - reached > length, F.lit(True))
    runs = windows.withColumn("gap", gap).withColumn("run", F.sum(F.col("gap").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("first").alias("span_start"), (F.max("last") + length).cast("int").alias("span_end")).drop("run")


def coverage(documents: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: characters, shared characters and their share (0 for null or empty texts)."""
    covered = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).cast("long").alias("shared_chars"), F.count("*").alias("spans"))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("chars")).groupBy("doc_id").agg(F.max("chars").alias("chars"))
    out = docs.join(covered, "doc_id", "left").fillna(0, ["shared_chars", "spans"])
    return out.withColumn("shared_share", F.round(F.coalesce(F.try_divide(F.col("shared_chars"), F.col("chars")), F.lit(0.0)), 6))
