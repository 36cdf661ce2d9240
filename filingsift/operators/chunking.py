"""Chunks of pages: windows, greedy packing, table splitting and the page strategies, as Column folds inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingsift.functions.text import let, squeezed, word_count, words
from filingsift.operators.metrics import once

STRATEGIES = ("fixed", "section", "section_table")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words that overlap by ``overlap``, as an array of texts; a text within the size stays as it is
    but for its ends, a null or blank one has no window."""
    step = max(1, size - overlap)
    none = F.array().cast("array<string>")

    def cut(w: Column) -> Column:
        count = F.ceil((F.size(w) - size) / step).cast("int") + 1
        pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.array_join(F.slice(w, k * step + 1, size), " "))
        return F.when(F.size(w) == 0, none).when(F.size(w) <= size, F.array(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))).otherwise(pieces)

    return F.when(text.isNull(), none).otherwise(let(words(text), cut))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.filter(parts, lambda p: p != ""), F.array().cast("array<string>"))


def pack(paras: Column, size: int) -> Column:
    """Greedy packing of array<struct<text, section>> into pieces of at most ``size`` words, joined by blank lines.

    A piece has the section of its first paragraph. A paragraph over the size closes the open piece and is cut into windows
    without overlap. The fold keeps only the open piece and the finished ones, one row's worth."""
    piece = "struct<text:string,section:string>"
    zero = F.struct(F.array().cast(f"array<{piece}>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("tok"), F.lit(None).cast("string").alias("sec"))
    closed = lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.struct(F.array_join(a["cur"], "\n\n").alias("text"), a["sec"].alias("section"))))).otherwise(a["out"])

    def merge(a: Column, p: Column) -> Column:
        n = word_count(p["text"])
        none = F.array().cast("array<string>")
        over = F.struct(F.concat(closed(a), F.transform(windows(p["text"], size, 0), lambda w: F.struct(w.alias("text"), p["section"].alias("section")))).alias("out"), none.alias("cur"), F.lit(0).alias("tok"), a["sec"].alias("sec"))
        full = F.struct(closed(a).alias("out"), F.array(p["text"]).alias("cur"), n.alias("tok"), p["section"].alias("sec"))
        more = F.struct(a["out"].alias("out"), F.concat(a["cur"], F.array(p["text"])).alias("cur"), (a["tok"] + n).alias("tok"), F.when(F.size(a["cur"]) == 0, p["section"]).otherwise(a["sec"]).alias("sec"))
        return F.when(n > size, over).when((F.size(a["cur"]) > 0) & (a["tok"] + n > size), full).otherwise(more)

    return F.aggregate(paras, zero, merge, closed)


def table_prefix(title: Column, units: Column) -> Column:
    """The line that names a table: its title and units."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    head = F.when(blank(title) != "", F.concat(F.lit("Table: "), title)).otherwise("Table")
    return F.concat(head, F.when(blank(units) != "", F.concat(F.lit(" ("), units, F.lit(")"))).otherwise(""), F.lit("\n"))


def split_table(text: Column, prefix: Column, size: int) -> Column:
    """A markdown table in parts of at most ``size`` words, each with the prefix and the first two lines; a single row that
    is too long stays whole. Tables within the size or of three lines at most are one part."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    header, rows = F.slice(lines, 1, 2), F.slice(lines, 3, 1 << 20)
    base = word_count(F.concat(prefix, F.array_join(header, "\n")))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("tok"))
    part = lambda a: F.concat(a["out"], F.array(F.concat(prefix, F.array_join(F.concat(header, a["cur"]), "\n"))))

    def merge(a: Column, r: Column) -> Column:
        n = word_count(r) + 1
        full = F.struct(part(a).alias("out"), F.array(r).alias("cur"), n.alias("tok"))
        more = F.struct(a["out"].alias("out"), F.concat(a["cur"], F.array(r)).alias("cur"), (a["tok"] + n).alias("tok"))
        return F.when((F.size(a["cur"]) > 0) & (base + a["tok"] + n > size), full).otherwise(more)

    cut = F.aggregate(rows, zero, merge, lambda a: F.when(F.size(a["cur"]) > 0, part(a)).otherwise(a["out"]))
    whole = F.array(F.concat(prefix, text))
    return F.when(text.isNull(), F.array().cast("array<string>")).when((word_count(F.concat(prefix, text)) <= size) | (F.size(lines) <= 3), whole).otherwise(cut)


def context_header(bank: Column, year: Column, section: Column, label: Column) -> Column:
    """The line put before a chunk's text where it is embedded."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("["), part(bank), F.lit(" | FY"), part(year), F.lit(" | "), F.coalesce(F.nullif(section, F.lit("")), F.lit("n/a")), F.lit(" | p. "), part(label), F.lit("]\n"))


def chunk_pages(blocks: DataFrame, filings: DataFrame, strategy: str = "section_table", size: int = 512, overlap: int = 64, header: bool = True) -> DataFrame:
    """Chunks of pages from blocks (doc_id, page_index, block_no, kind, text, section, title, units).

    ``fixed`` cuts windows of the page's text; ``section`` packs the paragraphs of all blocks; ``section_table`` packs those
    between two tables and splits tables on their own. Chunks never cross a page, and are numbered from 0 on it. Documents
    come from ``filings``, the first row of a doc_id by source_url; repeated blocks count once, blank texts give no chunk.
    """
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    page = ["doc_id", "page_index"]
    b = blocks.where("doc_id is not null and page_index is not null and block_no is not null").dropDuplicates([*page, "block_no"])
    b = b.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("table", F.coalesce(F.col("kind") == "table", F.lit(False)) & F.lit(strategy == "section_table"))
    order = Window.partitionBy(*page).orderBy("block_no")
    ordered = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct("block_no", *c))), lambda x: F.struct(*[x[k].alias(k) for k in c]))
    if strategy == "fixed":
        text = F.array_join(F.transform(ordered("text"), lambda x: x["text"]), "\n\n")
        pages = b.groupBy(*page).agg(text.alias("body"), F.max_by("section", "block_no").alias("section"))
        raw = pages.select(*page, "section", F.posexplode(windows(F.col("body"), size, overlap)).alias("piece", "text"), F.lit("text").alias("kind"), F.lit(0).alias("run"), F.lit(0).alias("part"))
    else:
        b = b.withColumn("run", F.sum(F.col("table").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        tables = b.where("table").select(*page, "section", F.posexplode(split_table(F.col("text"), table_prefix(F.col("title"), F.col("units")), size)).alias("piece", "text"), F.lit("table").alias("kind"), "run", F.lit(0).alias("part"))
        runs = b.where("not table").groupBy(*page, "run").agg(ordered("text", "section").alias("texts"))  # the blocks of one page
        paras = F.flatten(F.transform("texts", lambda x: F.transform(paragraphs(x["text"]), lambda p: F.struct(p.alias("text"), x["section"].alias("section")))))
        packed = runs.select(*page, "run", F.posexplode(pack(paras, size)).alias("piece", "x"))
        raw = tables.unionByName(packed.select(*page, F.col("x.section").alias("section"), "piece", F.col("x.text").alias("text"), F.lit("text").alias("kind"), "run", F.lit(1).alias("part")))
    number = F.row_number().over(Window.partitionBy(*page).orderBy("run", "part", "piece")) - 1
    docs = once(filings, "doc_id", "source_url").select("doc_id", squeezed(F.col("bank")).alias("bank"), "ticker", "fiscal_year")
    out = raw.where("trim(text) <> ''").withColumn("i", number).join(docs, "doc_id")
    head = context_header(F.col("bank"), F.col("fiscal_year"), F.col("section"), F.col("page_index")) if header else F.lit("")
    name = F.concat("doc_id", F.lit(":p"), "page_index", F.lit(":c"), "i")
    return out.select(name.alias("chunk_id"), "doc_id", "bank", "ticker", "fiscal_year", "page_index", F.col("page_index").cast("string").alias("page_label"), "section", "kind", "text", F.concat(head, "text").alias("embed_text"))
