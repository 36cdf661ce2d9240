"""Problem 1: lines repeated across the documents of one source.

Method: PrefixSpan over the line-identifier sequences of each source. The frequent single lines of a source come first;
then each frequent sequence is grown by the frequent lines at any later place of the chunks that hold it (its projected
database: what is left of each chunk after the first place where the sequence is complete), until no longer one is held by
enough distinct documents. Lines between are no part of a sequence. Every occurrence of a frequent sequence, single lines included, is deleted. A line
of a frequent sequence is itself frequent, since support can only fall as a sequence grows; so longer sequences show what
belongs together and the single lines already bound what is deleted.

All steps are joins and aggregations keyed by source and line or by chunk. Support is counted in two levels (distinct
documents per sequence, then their number), so neither a source with a third of all documents nor a line that all of them
hold is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingsift.functions.shared import written
from filingsift.functions.text import squeezed

#: A sequence is frequent in at least so many distinct documents, and in this share of the source's documents.
LEAST_DOCUMENTS, LEAST_SHARE = 4, 0.05


def form(line: Column) -> Column:
    """What makes two lines the same: white space as one space, lower case, runs of digits as 0."""
    return F.regexp_replace(F.lower(squeezed(line)), "[0-9]+", "0")


def sequences(chunks: DataFrame, documents: DataFrame, exempt: DataFrame) -> DataFrame:
    """(source, doc_id, chunk_id, line_no, item): the non-blank lines of each chunk in order; item identifies a line's
    form, null for lines without a letter and for the exempt ones (column form)."""
    of = documents.select("doc_id", "source").where("doc_id is not null and source is not null").distinct()
    text = chunks.where("kind is null or kind <> 'table'").select("chunk_id", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = text.select("chunk_id", "doc_id", (F.col("at") + 1).alias("line_no"), form(F.col("line")).alias("form")).where("form <> ''")
    exempt = exempt.select("form").distinct().withColumn("exempt", F.lit(True))
    lines = lines.join(exempt, "form", "left")
    item = F.when(F.col("form").rlike("[a-z]") & F.col("exempt").isNull(), F.xxhash64("form"))
    return lines.select("chunk_id", "doc_id", "line_no", item.alias("item")).join(of, "doc_id").select("source", "doc_id", "chunk_id", "line_no", "item")


def _frequent(held: DataFrame, key: str, sizes: DataFrame, least: int, share: float) -> DataFrame:
    """(source, key, support) of what enough distinct documents of the source hold."""
    support = held.select("source", key, "doc_id").distinct().groupBy("source", key).agg(F.count("*").alias("support"))
    return support.where(F.col("support") >= least).join(sizes, "source").where(F.col("support") >= F.lit(share) * F.col("documents") - 1e-9).drop("documents")


def frequent_sequences(lines: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(patterns, occurrences) of ``sequences``.

    patterns: source, pattern (an identifier), items (the lines' identifiers in order), support; occurrences: source,
    pattern, doc_id, chunk_id, at (line numbers). Other lines may stand between the lines of a sequence. A single line has an
    occurrence wherever it stands, a longer sequence one in each chunk: at the first place where it is complete.
    """
    sizes = lines.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"))
    held = lines.where("item is not null")
    singles = _frequent(held, "item", sizes, least, share)
    single = written(held.join(singles.select("source", "item"), ["source", "item"]).distinct(), "lines")
    patterns = [singles.select("source", F.col("item").alias("pattern"), F.array("item").alias("items"), "support")]
    found = [single.select("source", F.col("item").alias("pattern"), "doc_id", "chunk_id", F.array("line_no").alias("at"))]
    chunk = ["source", "doc_id", "chunk_id"]
    last = single.groupBy(*chunk, F.col("item").alias("pattern")).agg(F.min("line_no").alias("last")).select("*", F.array("pattern").alias("items"), F.array("last").alias("at"))
    while True:
        after = last.join(single, chunk).where("line_no > last")
        grown = after.groupBy(*chunk, "pattern", "item").agg(F.min("line_no").alias("next"), F.first("items").alias("items"), F.first("at").alias("at"))
        grown = grown.select(*chunk, F.xxhash64("pattern", "item").alias("pattern"), F.col("next").alias("last"), F.concat("items", F.array("item")).alias("items"), F.concat("at", F.array("next")).alias("at"))
        grown = written(grown, "grown")
        kept = _frequent(grown, "pattern", sizes, least, share)
        last = written(grown.join(kept, ["source", "pattern"]), "sequences")
        if last.isEmpty():
            break
        patterns.append(last.select("source", "pattern", "items", "support").distinct())
        found.append(last.select("source", "pattern", "doc_id", "chunk_id", "at"))
        last = last.drop("support")
    every, occurrences = patterns[0], found[0]
    for p, o in zip(patterns[1:], found[1:]):
        every, occurrences = every.unionByName(p), occurrences.unionByName(o)
    return every, occurrences


def repeated_lines(chunks: DataFrame, documents: DataFrame, exempt: DataFrame, least: int = LEAST_DOCUMENTS, share: float = LEAST_SHARE) -> DataFrame:
    """(chunk_id, line_no): the lines to delete, each once; lines are counted from 1 and split at line breaks only.

    ``chunks`` has chunk_id, doc_id, kind and text (kind ``table`` is skipped, null is not), ``documents`` doc_id and
    source, ``exempt`` the forms never deleted. A source's documents are those with a chunk that is no table and not
    blank. Documents without a source, null texts and blank lines are never cases; repeated rows count once.
    """
    lines = written(sequences(chunks, documents, exempt), "sequences")
    _, occurrences = frequent_sequences(lines, least, share)
    return occurrences.select("chunk_id", F.explode("at").alias("line_no")).distinct()


def without_lines(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """``chunks`` (each chunk_id once) with ``clean_text``: the text without the given lines; null stays null."""
    gone = lines.groupBy("chunk_id").agg(F.collect_set("line_no").alias("gone"))  # one chunk's lines at most
    kept = F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains("gone", k + 1))
    clean = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return chunks.dropDuplicates(["chunk_id"]).join(gone, "chunk_id", "left").withColumn("clean_text", clean).drop("gone")
