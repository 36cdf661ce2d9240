"""Chunking and layout queries over whole blocks, chunks and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingsift.functions.answers import needles
from filingsift.functions.shared import written
from filingsift.functions.text import squeezed, word_count
from filingsift.operators import chunking, layout
from filingsift.sources.tables import table

PAGE = ["doc_id", "page_index"]


def _md5(text: Column) -> Column:
    return F.md5(squeezed(text).cast("binary"))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "blocks").where("doc_id is not null").dropDuplicates([*PAGE, "block_no"])


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"), 512, 64)).alias("piece", "text"))
    return rows.select("doc_id", "piece", word_count(F.col("text")).alias("words"), _md5(F.col("text")).alias("md5"))


def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    paras = F.transform(chunking.paragraphs(F.col("text")), lambda p: F.struct(p.alias("text"), F.col("section").alias("section")))
    rows = table(spark, folder, "chunks").where("coalesce(kind, 'text') <> 'table'").dropDuplicates(["chunk_id"]).select("chunk_id", F.posexplode(chunking.pack(paras, 64)).alias("piece", "x"))
    return rows.select("chunk_id", "piece", word_count(F.col("x.text")).alias("words"), _md5(F.col("x.text")).alias("md5"))


def chunk_table_split(spark: SparkSession, folder: str) -> DataFrame:
    prefix = chunking.table_prefix(F.col("title"), F.col("units"))
    rows = _blocks(spark, folder).where("kind = 'table'").select(*PAGE, "block_no", F.posexplode(chunking.split_table(F.col("text"), prefix, 64)).alias("piece", "text"))
    return rows.select(*PAGE, "block_no", "piece", word_count(F.col("text")).alias("words"), _md5(F.col("text")).alias("md5"))


def chunk_pages(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_pages(table(spark, folder, "blocks"), table(spark, folder, "filings"))


def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_pages(table(spark, folder, "blocks"), table(spark, folder, "filings"), "section")


def chunk_page_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_pages(table(spark, folder, "blocks"), table(spark, folder, "filings"), "fixed")


def chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("doc_id", "chunk_id").distinct().groupBy("doc_id").agg(F.count("*").alias("chunks"))


def chunk_contextual(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks").dropDuplicates(["chunk_id"])
    header = chunking.context_header(F.col("bank"), F.col("fiscal_year"), F.col("section"), F.col("page_label"))
    return c.select("chunk_id", F.md5(F.concat(header, F.coalesce("text", F.lit(""))).cast("binary")).alias("md5"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return _blocks(spark, folder).groupBy(*PAGE).agg(F.array_join(texts, "\n\n").alias("text"))  # the blocks of one page


def page_label(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select(*PAGE, layout.page_label(F.col("text"), F.col("page_index")).alias("label"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _blocks(spark, folder).where("coalesce(kind, 'text') <> 'table'")
    return rows.select(*PAGE, "block_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def section_carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    rows = layout.sections(_lines(spark, folder), table(spark, folder, "headings"), *PAGE, "block_no", "line_no")
    return rows.groupBy(*PAGE, "block_no").agg(F.max_by("section", "line_no").alias("section"), F.count("heading").alias("headings"))


def _toc(spark: SparkSession, folder: str) -> DataFrame:
    """Bookmarks of a document: its sections where they begin (level 1) and the titles of its tables (level 2)."""
    b = _blocks(spark, folder).where("section is not null and trim(section) <> ''").withColumn("section", F.lower(squeezed(F.col("section"))))
    w = Window.partitionBy("doc_id").orderBy("page_index", "block_no")
    b = b.withColumn("fresh", F.coalesce(F.lag("section").over(w) != F.col("section"), F.lit(True)))
    marks = b.where("fresh").select("doc_id", "page_index", "block_no", F.lit(1).alias("level"), F.col("section").alias("title")).unionByName(b.where("kind = 'table' and trim(title) <> ''").select("doc_id", "page_index", "block_no", F.lit(2).alias("level"), squeezed(F.col("title")).alias("title")))
    return marks.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "block_no", "level")).alias("nth"), "level", "title", F.col("page_index").alias("page"))


def toc_paths(spark: SparkSession, folder: str) -> DataFrame:
    return layout.toc_paths(_toc(spark, folder)).select("doc_id", "nth", "page", "path")


def toc_asof(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "chunks").where("doc_id is not null and page_index is not null").select(*PAGE).distinct()
    return layout.as_of(pages, layout.toc_paths(_toc(spark, folder)))


def find_units(spark: SparkSession, folder: str) -> DataFrame:
    b = _blocks(spark, folder).where("kind = 'table'")
    return b.select(*PAGE, "block_no", layout.find_units(F.col("title"), F.col("text")).alias("units"))


def title_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return layout.titles(_blocks(spark, folder))


def ruled_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _blocks(spark, folder).where("kind = 'table'").select(*PAGE, "block_no", layout.is_ruled_table(F.col("text")).alias("ruled"))


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """Words with positions, laid out from the table blocks: a column every 120 points, a line every 14, numbers flush right."""
    rows = _blocks(spark, folder).where("kind = 'table'").select(F.concat_ws(":", "doc_id", "page_index", "block_no").alias("page"), F.posexplode(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^[\s|:\-]*$"))).alias("nth", "line"))
    cells = rows.select("page", "nth", F.posexplode(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|")).alias("k", "cell")).withColumn("cell", F.trim("cell")).where("cell <> ''")
    width = F.length("cell") * 5.0
    left = F.when(F.col("k") == 0, 40.0).otherwise(F.col("k") * 120.0 + 300.0 - width)
    words = cells.withColumn("left", left).select("page", "nth", "left", F.posexplode(F.split("cell", r"\s+")).alias("at", "text"), "cell")
    before = F.length(F.array_join(F.slice(F.split("cell", r"\s+"), F.lit(1), F.col("at")), " ")) + F.when(F.col("at") > 0, 1).otherwise(0)
    x0 = F.col("left") + before * 5.0
    return words.select("page", x0.alias("x0"), (100 + F.col("nth") * 14.0).alias("y0"), (x0 + F.length("text") * 5.0).alias("x1"), (110 + F.col("nth") * 14.0).alias("y1"), "text")


def words_to_rows(spark: SparkSession, folder: str) -> DataFrame:
    return layout.word_rows(_words(spark, folder)).select("page", "nth", "y0", "y1", F.array_join("cells", " | ").alias("cells"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return layout.table_runs(layout.word_rows(_words(spark, folder)))


def table_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).groupBy("page", "run").agg(F.min("nth").alias("first"), F.max("nth").alias("last"))


def column_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return layout.column_anchors(_runs(spark, folder))


def rebuilt_tables(spark: SparkSession, folder: str) -> DataFrame:
    return layout.rebuilt_tables(_runs(spark, folder))


def gap_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs from the lines of text blocks, an empty line leaving a gap."""
    lines = _lines(spark, folder).select(F.concat_ws(":", *PAGE).alias("page"), F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_no", "line_no")).alias("n"), "line").where("trim(line) <> ''")
    rows = lines.select("page", F.col("n").alias("nth"), (F.col("n") * 12.0).alias("y0"), (F.col("n") * 12.0 + 10).alias("y1"), F.array("line").alias("cells"))
    return layout.paragraphs(rows).select("page", "paragraph", "y", F.length("text").alias("chars"))


def box_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Words of tables that meet the box of their table's lower half, bands of header and footer left out."""
    words = _words(spark, folder).where(layout.in_band(F.col("y0"), F.col("y1"), F.lit(10_000.0)))
    boxes = words.groupBy("page").agg(F.min("x0").alias("bx0"), ((F.min("y0") + F.max("y1")) / 2).alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))
    return layout.overlapping(words, boxes).groupBy("page").agg(F.count("*").alias("words"))


def box_inside(spark: SparkSession, folder: str) -> DataFrame:
    """Words of tables whose centre lies in the lower half of their table, which ends the page: its last lines are its footer."""
    words = _words(spark, folder)
    boxes = words.groupBy("page").agg((F.min("x0") - 1).alias("bx0"), ((F.min("y0") + F.max("y1")) / 2).alias("by0"), (F.max("x1") + 1).alias("bx1"), F.max("y1").alias("by1"))
    height = boxes.select("page", (F.col("by1") + 20).alias("height"))
    found = layout.inside(words, boxes).join(height, "page").where(layout.in_band(F.col("y0"), F.col("y1"), F.col("height")))
    return found.groupBy("page").agg(F.count("*").alias("words"))


def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Tables slotted between the texts of their page by height."""
    b = _blocks(spark, folder).where("y is not null").withColumn("page", F.concat_ws(":", *PAGE))
    name = F.col("block_no").cast("string").alias("text")
    texts = b.where("coalesce(kind, 'text') <> 'table'").select("page", F.row_number().over(Window.partitionBy("page").orderBy("block_no")).alias("nth"), "y", name)
    return layout.slotted(texts, b.where("kind = 'table'").select("page", "y", name))


def highlight_needles(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks").where("text is not null").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", F.size(needles(F.col("text"))).alias("needles"), F.md5(F.array_join(needles(F.col("text")), "|").cast("binary")).alias("md5"))


QUERIES = {f.__name__: f for f in (chunk_fixed, chunk_pack, chunk_table_split, chunk_pages, chunk_sections, chunk_page_windows, chunk_counts, chunk_contextual, page_label, section_carry_forward, toc_paths, toc_asof, find_units, title_lookup, ruled_tables, words_to_rows, table_runs, column_anchors, rebuilt_tables, gap_paragraphs, box_overlap, box_inside, reading_order, highlight_needles)}

_WS = "[\\s\\x{001c}-\\x{001f}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{000b}]+"
_B = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, block_no ORDER BY text) AS rn FROM blocks WHERE doc_id IS NOT NULL) WHERE rn = 1)"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _words_of(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{_WS[1:-1]}+')"


def _label(x: str, patterns: list[str]) -> str:
    """The first of the patterns' groups that a line holds."""
    found = ", ".join("nullif(regexp_extract({}, '{}', 1), '')".format(x, p.replace("'", "''")) for p in patterns)
    return f"coalesce({found}, '')"


def _title_like(x: str) -> str:
    return f"(length(trim({x})) BETWEEN 3 AND 90 AND regexp_matches(trim({x}), '^\\p{{Lu}}') AND NOT regexp_matches(trim({x}), '[.,;]$') AND NOT regexp_matches(trim({x}), '{layout.UNITS}') AND length(regexp_replace(trim({x}), '[^0-9]', '', 'g')) <= floor(length(trim({x})) / 3))"


_USPACE = "[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{000b}]"
_TOC = f"""{_B}, q AS (SELECT *, lower({_squeeze('section')}) AS sec FROM b WHERE trim(section) <> ''),
v AS (SELECT *, coalesce(lag(sec) OVER (PARTITION BY doc_id ORDER BY page_index, block_no) <> sec, true) AS fresh FROM q),
marks AS (SELECT doc_id, page_index, block_no, 1 AS level, sec AS title FROM v WHERE fresh UNION ALL SELECT doc_id, page_index, block_no, 2, {_squeeze('title')} FROM v WHERE kind = 'table' AND trim(title) <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, block_no, level) AS nth FROM marks),
up AS (SELECT *, CASE WHEN level = 2 THEN last_value(CASE WHEN level = 1 THEN trim(title) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM n),
toc AS (SELECT doc_id, nth, page_index AS page, substr(concat_ws(' > ', nullif(parent, ''), trim(title)), 1, 120) AS path FROM up WHERE page_index > 0)"""


# The words of table blocks with their places (as _words lays them out), rows of cells, table runs and columns.
_CELLS = f"""{_B}, l AS (SELECT concat_ws(':', doc_id, page_index, block_no) AS page, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[\\s\\x{{000b}}|:\\-]*$')) AS lines FROM b WHERE kind = 'table' AND text IS NOT NULL),
r AS (SELECT page, unnest(lines) AS line, unnest(range(len(lines))) AS nth FROM l),
c AS (SELECT page, nth, trim(unnest(cs)) AS cell, unnest(range(len(cs))) AS k FROM (SELECT page, nth, string_split(regexp_replace(line, '^\\s*\\||\\|\\s*$', '', 'g'), '|') AS cs FROM r)),
s AS (SELECT *, regexp_split_to_array(cell, '[\\s\\x{{000b}}]+') AS ws, CASE WHEN k = 0 THEN 40.0 ELSE k * 120.0 + 300.0 - length(cell) * 5.0 END AS lft FROM c WHERE cell <> ''),
w AS (SELECT page, nth, k, j, ws[j] AS text, (lft + 5.0 * (length(array_to_string(ws[1:j - 1], ' ')) + CASE WHEN j > 1 THEN 1 ELSE 0 END))::DOUBLE AS x0 FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM s)),
p AS (SELECT page, nth AS ln, x0, text, (x0 + 5.0 * length(text))::DOUBLE AS x1, regexp_matches(text, '{layout.FOOTNOTE}') AS mark, row_number() OVER (PARTITION BY page, nth ORDER BY x0, text, x0 + 5.0 * length(text)) AS pos FROM w)""" + """,
m AS (SELECT *, {num_text} OR text = '%' AS num, count_if(NOT mark) OVER (PARTITION BY page, ln ORDER BY pos ROWS UNBOUNDED PRECEDING) AS st FROM p),
g AS (SELECT *, mark AND coalesce(bool_or(num) OVER (PARTITION BY page, ln, st ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS gone FROM m),
h AS (SELECT *, coalesce(x0 - lag(x1) OVER (PARTITION BY page, ln ORDER BY pos) > 9, true) AS wide FROM g WHERE NOT gone),
i AS (SELECT *, count_if(wide) OVER (PARTITION BY page, ln ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cell FROM h),
d0 AS (SELECT page, ln, cell, string_agg(text, ' ' ORDER BY pos) AS text, min(x0) AS x0, arg_max(x1, pos) AS x1 FROM i GROUP BY page, ln, cell),
d1 AS (SELECT *, text <> '%' OR row_number() OVER (PARTITION BY page, ln ORDER BY cell) = 1 AS own FROM d0 WHERE text <> '$' AND NOT regexp_matches(text, '{footnote}')),
d2 AS (SELECT *, count_if(own) OVER (PARTITION BY page, ln ORDER BY cell ROWS UNBOUNDED PRECEDING) AS part FROM d1),
d3 AS (SELECT page, ln, part, string_agg(text, '' ORDER BY cell) AS text, min(x0) AS x0, arg_max(x1, cell) AS x1 FROM d2 GROUP BY page, ln, part),
rw AS (SELECT page, (row_number() OVER (PARTITION BY page ORDER BY ln) - 1)::INT AS nth, 100 + ln * 14.0::DOUBLE AS y0, 110 + ln * 14.0::DOUBLE AS y1, list(text ORDER BY part) AS cells, list(x0 ORDER BY part) AS lefts, list(x1 ORDER BY part) AS rights FROM d3 GROUP BY page, ln),
fl AS (SELECT *, len(cells) >= 2 AND len(list_filter(cells, lambda x: {num_x})) > 0 AND NOT {num_first} AS tab, len(cells) >= 2 OR regexp_matches(array_to_string(cells, ' '), '{units}') AS hdr, len(cells) = 1 AND length(cells[1]) < 100 AND NOT rtrim(cells[1]) LIKE '%.' AS lig FROM rw),
f2 AS (SELECT *, tab OR (lig AND coalesce(lag(tab) OVER o, false) AND coalesce(lead(tab) OVER o, false)) AS ins, hdr AND NOT tab AS head FROM fl WINDOW o AS (PARTITION BY page ORDER BY nth)),
f3 AS (SELECT *, ins AND NOT coalesce(lag(ins) OVER o, false) AS start, CASE WHEN NOT coalesce(lag(head) OVER o, false) THEN 0 WHEN NOT coalesce(lag(head, 2) OVER o, false) THEN 1 WHEN NOT coalesce(lag(head, 3) OVER o, false) THEN 2 WHEN NOT coalesce(lag(head, 4) OVER o, false) THEN 3 ELSE 4 END AS up FROM f2 WINDOW o AS (PARTITION BY page ORDER BY nth)),
f4 AS (SELECT *, count_if(start) OVER (PARTITION BY page ORDER BY nth ROWS UNBOUNDED PRECEDING) AS run FROM f3),
f5 AS (SELECT page, run, min(nth) AS first, max(nth) AS last, arg_min(up, nth) AS up FROM f4 WHERE ins GROUP BY page, run HAVING count_if(tab) >= 3),
ru AS (SELECT rw.*, f5.run FROM rw JOIN f5 ON rw.page = f5.page AND rw.nth BETWEEN f5.first - f5.up AND f5.last),
nc AS (SELECT page, run, x0, x1 FROM (SELECT page, run, unnest(cells[2:]) AS text, unnest(lefts[2:]) AS x0, unnest(rights[2:]) AS x1 FROM ru) WHERE {num_text}),
ne AS (SELECT *, coalesce(x1 - lag(x1) OVER (PARTITION BY page, run ORDER BY x1, x0) > 14, true) AS fresh FROM nc),
ng AS (SELECT *, count_if(fresh) OVER (PARTITION BY page, run ORDER BY x1, x0 ROWS UNBOUNDED PRECEDING) AS anchor FROM ne),
an AS (SELECT page, run, anchor::INT AS anchor, min(x0) AS ax0, max(x1) AS ax1 FROM ng GROUP BY page, run, anchor),
ce AS (SELECT page, run, nth, unnest(cells) AS text, unnest(lefts) AS x0, unnest(rights) AS x1, unnest(range(len(cells))) AS k FROM ru),
ov AS (SELECT ce.*, anchor, ax0, least(x1, ax1) - greatest(x0, ax0) AS over_, abs((x0 + x1) / 2 - (ax0 + ax1) / 2) AS away FROM ce JOIN an USING (page, run)),
pl AS (SELECT page, run, nth, k, any_value(text) AS text, max(anchor) AS many, CASE WHEN max(over_) > 0 THEN list(anchor ORDER BY over_ DESC, anchor)[1] WHEN k = 0 AND any_value(x1) <= arg_min(ax0, anchor) + 2 THEN 0 ELSE list(anchor ORDER BY away, anchor)[1] END AS col FROM ov GROUP BY page, run, nth, k),
gr AS (SELECT page, run, nth, many, col, string_agg(text, ' ' ORDER BY k) AS text FROM pl GROUP BY page, run, nth, many, col),
li AS (SELECT page, run, nth, many, '| ' || array_to_string(list_transform(range(many + 1), lambda j: coalesce(list_filter(any_value(cs), lambda c: c.col = j)[1].text, '')), ' | ') || ' |' AS line FROM (SELECT page, run, nth, many, list({{'col': col, 'text': text}}) AS cs FROM gr GROUP BY page, run, nth, many) GROUP BY page, run, nth, many)""".format(
    footnote=layout.FOOTNOTE, units=layout.UNITS, **{k: f"(regexp_matches(trim(regexp_replace(regexp_replace({x}, '\\([a-z0-9]{{1,2}}\\)', '', 'g'), '[$%()]', '', 'g')), '{layout.NUMBER}') OR trim(regexp_replace(regexp_replace({x}, '\\([a-z0-9]{{1,2}}\\)', '', 'g'), '[$%()]', '', 'g')) IN ('—', '–', '-', 'NM', 'n/a', 'NA'))" for k, x in (("num_text", "text"), ("num_x", "x"), ("num_first", "cells[1]"))}
)


def _packed(size: int, tables: str) -> str:
    """Chunks of pages as SQL: paragraphs packed between tables, which are split on their own (``tables`` says which blocks are tables)."""
    page = "doc_id, page_index"
    return f"""WITH RECURSIVE {_B}, v AS (SELECT * REPLACE (coalesce(text, '') AS text), {tables} AS tab FROM b WHERE page_index IS NOT NULL AND block_no IS NOT NULL),
z AS (SELECT *, count_if(tab) OVER (PARTITION BY {page} ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS run FROM v),
p AS (SELECT {page}, run, block_no, section, list_filter(list_transform(regexp_split_to_array(text, '\\n[\\s\\x{{000b}}]*\\n'), lambda x: regexp_replace(x, '^{_USPACE}+|{_USPACE}+$', '', 'g')), lambda x: x <> '') AS paras FROM z WHERE NOT tab),
u AS (SELECT {page}, run, block_no, section, unnest(paras) AS para, unnest(range(len(paras))) AS k FROM p),
w AS (SELECT *, {_words_of('para')} AS w, row_number() OVER (PARTITION BY {page}, run ORDER BY block_no, k) AS i FROM u),
f AS (SELECT DISTINCT {page}, run, 0::BIGINT AS i, 0::BIGINT AS piece, -1::BIGINT AS last, false AS open, 0::BIGINT AS tok FROM w UNION ALL
  SELECT {page}, run, w.i, CASE WHEN len(w) > {size} OR NOT open OR tok + len(w) > {size} THEN last + 1 ELSE last END, CASE WHEN len(w) > {size} THEN last + (len(w) + {size - 1}) // {size} WHEN NOT open OR tok + len(w) > {size} THEN last + 1 ELSE last END,
  len(w) <= {size}, CASE WHEN len(w) > {size} THEN 0 WHEN open AND tok + len(w) <= {size} THEN tok + len(w) ELSE len(w) END FROM f JOIN w USING ({page}, run) WHERE w.i = f.i + 1),
o AS (SELECT {page}, run, piece, i, section, para FROM f JOIN w USING ({page}, run, i) WHERE len(w) <= {size} UNION ALL
  SELECT {page}, run, piece + j, i, section, array_to_string(w[j * {size} + 1 : j * {size} + {size}], ' ') FROM (SELECT {page}, run, piece, i, section, w, unnest(range((len(w) + {size - 1}) // {size})) AS j FROM f JOIN w USING ({page}, run, i) WHERE len(w) > {size})),
texts AS (SELECT {page}, run, 1 AS part, piece, list(section ORDER BY i)[1] AS section, 'text' AS kind, string_agg(para, chr(10) || chr(10) ORDER BY i) AS text FROM o GROUP BY {page}, run, piece),
t AS (SELECT {page}, run, section, text, CASE WHEN coalesce(title, '') <> '' THEN 'Table: ' || title ELSE 'Table' END || CASE WHEN coalesce(units, '') <> '' THEN ' (' || units || ')' ELSE '' END || chr(10) AS prefix, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM z WHERE tab),
h AS (SELECT *, len({_words_of('prefix || text')}) <= {size} OR len(lines) <= 3 AS whole, prefix || array_to_string(lines[1:2], chr(10)) AS head FROM t),
r AS (SELECT {page}, run, section, head, unnest(lines[3:]) AS line, unnest(range(1, len(lines) - 1)) AS i FROM h WHERE NOT whole), x AS (SELECT *, len({_words_of('head')}) AS base, len({_words_of('line')}) + 1 AS n FROM r),
y AS (SELECT {page}, run, i, 0::BIGINT AS piece, n::BIGINT AS tok FROM x WHERE i = 1 UNION ALL
  SELECT {page}, run, x.i, CASE WHEN base + tok + n > {size} THEN piece + 1 ELSE piece END, CASE WHEN base + tok + n > {size} THEN n ELSE tok + n END FROM y JOIN x USING ({page}, run) WHERE x.i = y.i + 1),
every AS (SELECT * FROM texts UNION ALL SELECT {page}, run, 0, 0, section, 'table', prefix || text FROM h WHERE whole UNION ALL
  SELECT {page}, run, 0, piece, section, 'table', head || chr(10) || string_agg(line, chr(10) ORDER BY i) FROM y JOIN x USING ({page}, run, i) GROUP BY {page}, run, piece, section, head),
n AS (SELECT *, row_number() OVER (PARTITION BY {page} ORDER BY run, part, piece) - 1 AS i FROM every WHERE trim(text) <> ''),
d AS (SELECT DISTINCT ON (doc_id) doc_id, {_squeeze('bank')} AS bank, ticker, fiscal_year FROM filings ORDER BY doc_id, source_url NULLS FIRST)
SELECT doc_id || ':p' || page_index || ':c' || i AS chunk_id, doc_id, bank, ticker, fiscal_year, page_index, page_index::VARCHAR AS page_label, section, kind, text,
'[' || coalesce(bank, '') || ' | FY' || coalesce(fiscal_year::VARCHAR, '') || ' | ' || coalesce(nullif(section, ''), 'n/a') || ' | p. ' || page_index || ']' || chr(10) || text AS embed_text FROM n JOIN d USING (doc_id)"""


SQL = {
    "chunk_pages": _packed(512, "coalesce(kind = 'table', false)"),
    "chunk_sections": _packed(512, "false"),
    "chunk_fixed": f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, l, len(l) AS n, CASE WHEN len(l) <= 512 THEN 1 ELSE ceil((len(l) - 512) / 448.0)::INT + 1 END AS m FROM w WHERE len(l) > 0),
p AS (SELECT doc_id, l, unnest(range(m)) AS piece FROM m)
SELECT doc_id, piece::INT AS piece, len(l[piece * 448 + 1 : piece * 448 + 512])::INT AS words, md5(array_to_string(l[piece * 448 + 1 : piece * 448 + 512], ' ')) AS md5 FROM p""",
    "chunk_counts": "SELECT doc_id, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY doc_id",
    "chunk_contextual": "SELECT chunk_id, md5('[' || coalesce(bank, '') || ' | FY' || coalesce(fiscal_year::VARCHAR, '') || ' | ' || coalesce(nullif(section, ''), 'n/a') || ' | p. ' || coalesce(page_label, '') || ']' || chr(10) || coalesce(text, '')) AS md5 FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id)",
    "section_carry_forward": f"""WITH {_B}, li AS (SELECT doc_id, page_index, block_no, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM b WHERE coalesce(kind, 'text') <> 'table' AND text IS NOT NULL),
sq AS (SELECT *, {_squeeze('line')} AS s FROM li),
hd AS (SELECT DISTINCT regexp_replace(replace(lower({_squeeze('heading')}), '’', ''''), '[.:]+$', '') AS key, heading FROM headings),
fo AS (SELECT sq.*, CASE WHEN count_if(regexp_matches(line, '(?i)^\\s*Item\\s+\\d+[A-C]?\\.?')) OVER (PARTITION BY doc_id, page_index) > 5 THEN NULL WHEN length(s) BETWEEN 1 AND 120 THEN CASE WHEN regexp_matches(s, '(?i)^Item\\s+\\d+[A-C]?\\.?') THEN substr(s, 1, 80) ELSE heading END END AS h FROM sq LEFT JOIN hd ON key = regexp_replace(replace(lower(s), '’', ''''), '[.:]+$', '')),
se AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index, block_no, n ROWS UNBOUNDED PRECEDING), '') AS section FROM fo)
SELECT doc_id, page_index, block_no, arg_max(section, n) AS section, count(h) AS headings FROM se GROUP BY doc_id, page_index, block_no""",
    "find_units": f"""WITH {_B} SELECT doc_id, page_index, block_no, coalesce('in ' || coalesce(nullif(lower(regexp_extract(title, '(?i)\\((?:dollars |\\$ )?in (millions|billions|thousands)[^)]*\\)', 1)), ''), nullif(lower(regexp_extract(text, '(?i)\\((?:dollars |\\$ )?in (millions|billions|thousands)[^)]*\\)', 1)), '')), '') AS units FROM b WHERE kind = 'table'""",
    "ruled_tables": f"""WITH {_B}, r AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|')) AS l FROM b WHERE kind = 'table')
SELECT doc_id, page_index, block_no, coalesce(len(l) - 1 >= 3 AND len(string_split(l[1], '|')) - 2 >= 2 AND len(regexp_extract_all(text, '<br>')) <= 5 AND NOT regexp_matches(text, '\\|Col\\d'), false) AS ruled FROM r""",
    "chunk_pack": f"""WITH RECURSIVE c AS (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunks WHERE coalesce(kind, 'text') <> 'table' AND text IS NOT NULL ORDER BY chunk_id),
p AS (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[\\s\\x{{000b}}]*\\n'), lambda x: regexp_replace(x, '^{_USPACE}+|{_USPACE}+$', '', 'g')), lambda x: x <> '') AS paras FROM c),
r AS (SELECT chunk_id, unnest(paras) AS para, unnest(range(1, len(paras) + 1)) AS i FROM p), w AS (SELECT chunk_id, i, {_words_of('para')} AS w FROM r),
f AS (SELECT chunk_id, 0::BIGINT AS i, 0::BIGINT AS piece, -1::BIGINT AS last, false AS open, 0::BIGINT AS tok FROM p UNION ALL
  SELECT chunk_id, w.i, CASE WHEN len(w) > 64 OR NOT open OR tok + len(w) > 64 THEN last + 1 ELSE last END, CASE WHEN len(w) > 64 THEN last + (len(w) + 63) // 64 WHEN NOT open OR tok + len(w) > 64 THEN last + 1 ELSE last END,
  len(w) <= 64, CASE WHEN len(w) > 64 THEN 0 WHEN open AND tok + len(w) <= 64 THEN tok + len(w) ELSE len(w) END FROM f JOIN w USING (chunk_id) WHERE w.i = f.i + 1),
o AS (SELECT chunk_id, piece, i, w FROM f JOIN w USING (chunk_id, i) WHERE len(w) <= 64 UNION ALL SELECT chunk_id, piece + k, i, w[k * 64 + 1 : k * 64 + 64] FROM (SELECT chunk_id, piece, i, w, unnest(range((len(w) + 63) // 64)) AS k FROM f JOIN w USING (chunk_id, i) WHERE len(w) > 64)),
g AS (SELECT chunk_id, piece, flatten(list(w ORDER BY i)) AS w FROM o GROUP BY chunk_id, piece)
SELECT chunk_id, piece::INT AS piece, len(w)::INT AS words, md5(array_to_string(w, ' ')) AS md5 FROM g""",
    "chunk_table_split": f"""WITH RECURSIVE {_B}, t AS (SELECT doc_id, page_index, block_no, text, CASE WHEN coalesce(title, '') <> '' THEN 'Table: ' || title ELSE 'Table' END || CASE WHEN coalesce(units, '') <> '' THEN ' (' || units || ')' ELSE '' END || chr(10) AS prefix, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM b WHERE kind = 'table' AND text IS NOT NULL),
u AS (SELECT *, len({_words_of('prefix || text')}) <= 64 OR len(lines) <= 3 AS whole, {_words_of("prefix || array_to_string(lines[1:2], chr(10))")} AS head FROM t),
r AS (SELECT doc_id, page_index, block_no, head, unnest(lines[3:]) AS line, unnest(range(1, len(lines) - 1)) AS i FROM u WHERE NOT whole), w AS (SELECT * EXCLUDE (line), {_words_of('line')} AS w FROM r),
f AS (SELECT doc_id, page_index, block_no, i, 0::BIGINT AS piece, (len(w) + 1)::BIGINT AS tok FROM w WHERE i = 1 UNION ALL
  SELECT doc_id, page_index, block_no, w.i, CASE WHEN len(head) + tok + len(w) + 1 > 64 THEN piece + 1 ELSE piece END, CASE WHEN len(head) + tok + len(w) + 1 > 64 THEN len(w) + 1 ELSE tok + len(w) + 1 END FROM f JOIN w USING (doc_id, page_index, block_no) WHERE w.i = f.i + 1),
g AS (SELECT doc_id, page_index, block_no, piece, list_concat(any_value(head), flatten(list(w ORDER BY i))) AS w FROM f JOIN w USING (doc_id, page_index, block_no, i) GROUP BY ALL
  UNION ALL SELECT doc_id, page_index, block_no, 0, {_words_of('prefix || text')} FROM u WHERE whole)
SELECT doc_id, page_index, block_no, piece::INT AS piece, len(w)::INT AS words, md5(array_to_string(w, ' ')) AS md5 FROM g""",
    "chunk_page_windows": f"""WITH {_B}, p AS (SELECT doc_id, page_index, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY block_no) AS body, list(section ORDER BY block_no DESC)[1] AS section FROM b WHERE page_index IS NOT NULL AND block_no IS NOT NULL GROUP BY doc_id, page_index),
w AS (SELECT *, {_words_of('body')} AS w FROM p), m AS (SELECT *, CASE WHEN len(w) <= 512 THEN 1 ELSE (len(w) - 512 + 447) // 448 + 1 END AS many FROM w WHERE len(w) > 0), k AS (SELECT *, unnest(range(many)) AS piece FROM m),
t AS (SELECT doc_id, page_index, section, piece, CASE WHEN len(w) <= 512 THEN regexp_replace(body, '^{_USPACE}+|{_USPACE}+$', '', 'g') ELSE array_to_string(w[piece * 448 + 1 : piece * 448 + 512], ' ') END AS text FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY piece) - 1 AS i FROM t WHERE trim(text) <> ''),
d AS (SELECT DISTINCT ON (doc_id) doc_id, {_squeeze('bank')} AS bank, ticker, fiscal_year FROM filings ORDER BY doc_id, source_url NULLS FIRST)
SELECT doc_id || ':p' || page_index || ':c' || i AS chunk_id, doc_id, bank, ticker, fiscal_year, page_index, page_index::VARCHAR AS page_label, section, 'text' AS kind, text,
'[' || coalesce(bank, '') || ' | FY' || coalesce(fiscal_year::VARCHAR, '') || ' | ' || coalesce(nullif(section, ''), 'n/a') || ' | p. ' || page_index || ']' || chr(10) || text AS embed_text FROM n JOIN d USING (doc_id)""",
    "page_label": f"""WITH {_B}, p AS (SELECT doc_id, page_index, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY block_no) AS text FROM b GROUP BY doc_id, page_index),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM p),
t AS (SELECT *, list_reverse(lines[greatest(len(lines) - 2, 1):]) AS tail FROM l)
SELECT doc_id, page_index, coalesce(list_filter(list_transform(list_concat(tail, lines[1:3]), lambda x: {_label('x', layout.LABELS)}), lambda x: x <> '')[1], list_filter(list_transform(tail, lambda x: {_label('x', layout.TAIL_LABELS)}), lambda x: x <> '')[1], page_index::VARCHAR) AS label FROM t""",
    "toc_paths": f"WITH {_TOC} SELECT doc_id, nth, page, path FROM toc",
    "toc_asof": f"""WITH {_TOC}, pages AS (SELECT DISTINCT doc_id, page_index FROM chunks WHERE doc_id IS NOT NULL AND page_index IS NOT NULL)
SELECT p.doc_id, p.page_index, coalesce(arg_max(path, nth), '') AS path FROM pages p LEFT JOIN toc t ON t.doc_id = p.doc_id AND t.page <= p.page_index GROUP BY p.doc_id, p.page_index""",
    "title_lookup": f"""WITH {_B}, a AS (SELECT *, coalesce(list(coalesce(text, '')) FILTER (WHERE coalesce(kind, 'text') <> 'table') OVER (PARTITION BY doc_id, page_index ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS above FROM b),
l AS (SELECT *, list_transform(above, lambda t: list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS full_lines FROM a WHERE kind = 'table'),
n AS (SELECT *, list_filter(list_transform(list_filter(full_lines[greatest(len(above) - 3, 1):], lambda f: len(f) = 1), lambda f: f[1]), lambda x: {_title_like('x')}) AS single, flatten(full_lines[greatest(len(above) - 2, 1):]) AS flat FROM l),
o AS (SELECT *, list_filter(flat[greatest(len(flat) - 11, 1):], lambda x: {_title_like('x')}) AS near FROM n)
SELECT doc_id, page_index, block_no, coalesce(trim(CASE WHEN len(single) > 0 THEN single[len(single)] WHEN len(near) > 0 THEN near[len(near)] END), '') AS found_title FROM o""",
    "gap_paragraphs": f"""WITH {_B}, l AS (SELECT doc_id, page_index, block_no, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM b WHERE coalesce(kind, 'text') <> 'table' AND text IS NOT NULL),
n AS (SELECT concat_ws(':', doc_id, page_index) AS page, line, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY block_no, k) AS n FROM l),
h AS (SELECT page, line, n, n * 12.0 AS y0, n * 12.0 + 10 AS y1 FROM n WHERE trim(line) <> ''),
g AS (SELECT *, coalesce(y0 - lag(y1) OVER w > 0.45 * greatest(lag(y1) OVER w - lag(y0) OVER w, 1), true) AS fresh FROM h WINDOW w AS (PARTITION BY page ORDER BY n)),
q AS (SELECT *, count_if(fresh) OVER (PARTITION BY page ORDER BY n ROWS UNBOUNDED PRECEDING) AS paragraph FROM g)
SELECT page, paragraph::BIGINT AS paragraph, min(y0)::DOUBLE AS y, (sum(length(line)) + count(*) - 1)::INT AS chars FROM q GROUP BY page, paragraph""",
    # the box is as wide as all words of its table, so that heights alone decide
    "box_overlap": f"""WITH {_B}, l AS (SELECT concat_ws(':', doc_id, page_index, block_no) AS page, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[\\s\\x{{000b}}|:\\-]*$')) AS lines FROM b WHERE kind = 'table' AND text IS NOT NULL),
r AS (SELECT page, unnest(lines) AS line, unnest(range(len(lines))) AS nth FROM l), c AS (SELECT page, nth, trim(unnest(string_split(regexp_replace(line, '^\\s*\\||\\|\\s*$', '', 'g'), '|'))) AS cell FROM r),
w AS (SELECT page, 100 + nth * 14.0 AS y0, 110 + nth * 14.0 AS y1, unnest(regexp_split_to_array(cell, '[\\s\\x{{000b}}]+')) AS word FROM c WHERE cell <> ''),
x AS (SELECT page, (min(y0) + max(y1)) / 2 AS by0, max(y1) AS by1 FROM w WHERE y1 >= 40 AND y0 <= 9955 GROUP BY page)
SELECT page, count(*) AS words FROM w JOIN x USING (page) WHERE y1 >= 40 AND y0 <= 9955 AND y1 > by0 AND y0 < by1 GROUP BY page""",
    "box_inside": f"""WITH {_B}, l AS (SELECT concat_ws(':', doc_id, page_index, block_no) AS page, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[\\s\\x{{000b}}|:\\-]*$')) AS lines FROM b WHERE kind = 'table' AND text IS NOT NULL),
r AS (SELECT page, unnest(lines) AS line, unnest(range(len(lines))) AS nth FROM l), c AS (SELECT page, nth, trim(unnest(string_split(regexp_replace(line, '^\\s*\\||\\|\\s*$', '', 'g'), '|'))) AS cell FROM r),
w AS (SELECT page, 100 + nth * 14.0 AS y0, 110 + nth * 14.0 AS y1, unnest(regexp_split_to_array(cell, '[\\s\\x{{000b}}]+')) AS word FROM c WHERE cell <> ''),
x AS (SELECT page, (min(y0) + max(y1)) / 2 AS by0, max(y1) AS by1 FROM w GROUP BY page)
SELECT page, count(*) AS words FROM w JOIN x USING (page) WHERE y1 >= 40 AND y0 <= by1 + 20 - 45 AND (y0 + y1) / 2 BETWEEN by0 AND by1 GROUP BY page""",
    "words_to_rows": f"WITH {_CELLS} SELECT page, nth, y0, y1, array_to_string(cells, ' | ') AS cells FROM rw",
    "table_runs": f"WITH {_CELLS} SELECT page, run, min(nth) AS first, max(nth) AS last FROM ru GROUP BY page, run",
    "column_anchors": f"WITH {_CELLS} SELECT page, run, anchor, ax0, ax1 FROM an",
    "rebuilt_tables": f"WITH {_CELLS} SELECT page, run, string_agg(CASE WHEN nth = first THEN line || chr(10) || '|' || repeat(' --- |', many + 1) ELSE line END, chr(10) ORDER BY nth) AS markdown FROM (SELECT *, min(nth) OVER (PARTITION BY page, run) AS first FROM li) GROUP BY page, run",
    "reading_order": f"""WITH {_B}, p AS (SELECT *, concat_ws(':', doc_id, page_index) AS page FROM b WHERE y IS NOT NULL),
x AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY block_no) AS nth, y, block_no::VARCHAR AS text FROM p WHERE coalesce(kind, 'text') <> 'table'),
t AS (SELECT t.page, t.y, t.block_no::VARCHAR AS text, min(x.nth) AS nth FROM p t LEFT JOIN x ON x.page = t.page AND x.y > t.y WHERE t.kind = 'table' GROUP BY ALL),
a AS (SELECT page, coalesce(nth, 1 << 30) AS nth, 0 AS side, 'table' AS kind, y, text FROM t UNION ALL SELECT page, nth, 1, 'text', y, text FROM x)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY nth, side, y)::INT AS place, kind, y, text FROM a""",
    "highlight_needles": """WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, text, string_split(text, chr(10)) AS l FROM chunks WHERE text IS NOT NULL ORDER BY chunk_id),
n AS (SELECT chunk_id, CASE WHEN starts_with(ltrim(text), 'Table') THEN list_filter(flatten(list_transform(l[2:], lambda x: list_transform(string_split(regexp_replace(trim(x), '^\\|+|\\|+$', '', 'g'), '|'), lambda y: trim(y)))), lambda y: length(y) >= 4 AND NOT regexp_matches(y, '^[-: ]*$'))
  ELSE list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '[\\s\\x{000b}]+', ' ', 'g'))), lambda x: length(x) >= 12) END AS found FROM c),
d AS (SELECT chunk_id, list_filter(found, lambda x, i: list_position(found, x) = i) AS found FROM n)
SELECT chunk_id, len(found)::INT AS needles, md5(array_to_string(found, '|')) AS md5 FROM d""",
}
