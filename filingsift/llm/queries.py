"""The queries of the text problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingsift.functions.shared import written
from filingsift.llm import encoding, mixing, near_duplicates, quality, repeated_lines, spans, splitting
from filingsift.sources.tables import table


def _lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = table(spark, folder, "chunks").select("chunk_id", "doc_id", "kind", "text")
    documents = table(spark, folder, "filings").select("doc_id", F.col("ticker").alias("source"))
    exempt = table(spark, folder, "headings").where("heading is not null").select(repeated_lines.form(F.col("heading")).alias("form"))
    return chunks, documents, exempt


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(*_lines(spark, folder)).select("chunk_id", F.col("line_no").cast("int").alias("line_no"))


def p1_sequences(spark: SparkSession, folder: str) -> DataFrame:
    patterns, _ = repeated_lines.frequent_sequences(written(repeated_lines.sequences(*_lines(spark, folder)), "sequences"))
    return patterns.select("source", F.size("items").alias("lines"), F.array_join(F.transform("items", lambda i: F.hex(i)), " ").alias("items"), "support")


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    chunks, documents, exempt = _lines(spark, folder)
    return repeated_lines.without_lines(chunks, repeated_lines.repeated_lines(chunks, documents, exempt)).select("chunk_id", "clean_text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, folder, "chunks"), 0.7, 3, 30, "chunk_id")
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.similar_groups(table(spark, folder, "chunks"), 0.7, 3, 30, "chunk_id").withColumnRenamed("id", "chunk_id")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select(F.col("chunk_id").alias("item_id"), "section", "kind", "text")
    name = F.concat("doc_id", F.lit(":p"), "page_index", F.lit(":b"), "block_no")
    return chunks.unionByName(table(spark, folder, "blocks").select(name.alias("item_id"), "section", "kind", "text"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(_items(spark, folder)).where("piece_no > 0").select("item_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(_items(spark, folder))


def p4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of each item cover, and whether all are within the limit."""
    pieces = splitting.pieces(_items(spark, folder))
    span = F.sum(F.col("core_end") - F.col("core_start")).cast("long")
    return pieces.groupBy("item_id").agg(F.min("core_start").alias("first"), F.max("core_end").alias("last"), span.alias("covered"), (F.max("words") <= 512).alias("within"), (F.count("*") == F.max("piece_no") + 1).alias("numbered"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").where("kind is null or kind <> 'table'")
    return quality.judged(chunks, table(spark, folder, "common_words")).where(quality.not_prose()).select("chunk_id").distinct()


def p5_types(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_types(table(spark, folder, "chunks"), table(spark, folder, "common_words"))


def p5_types_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """How the types that were learned without labels meet the kinds that the table states."""
    types = quality.text_types(table(spark, folder, "chunks"), table(spark, folder, "common_words"))
    return types.groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "text_type").agg(F.count("*").alias("texts"), F.round(F.avg("p_table"), 6).alias("p_table"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encoded(table(spark, folder, "documents"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    documents = encoding.token_counts(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixing.mixed(documents, table(spark, folder, "mix_targets"))


def p7_blocks(spark: SparkSession, folder: str) -> DataFrame:
    documents = encoding.token_counts(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return mixing.blocks_of(documents, table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, folder), table(spark, folder, "mix_targets"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(table(spark, folder, "documents"))


def p8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return spans.coverage(documents, spans.shared_spans(documents))


QUERIES = {f.__name__: f for f in (p1_found, p1_sequences, p1_clean, p3_found, p3_groups, p4_found, p4_pieces, p4_coverage, p5_found, p5_types, p5_types_by_kind, p6_ids, p7_mix, p7_blocks, p7_shares, p8_found, p8_coverage)}
# White space as SPACE has it, for RE2.
_WS = "[\\s\\x{000b}\\x{001c}-\\x{001f}\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_NWS = "[^" + _WS[1:]


def _form(x: str) -> str:
    return f"regexp_replace(lower(trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))), '[0-9]+', '0', 'g')"


# Chunks with their class of equal shingle sets (m), classes (k) and alike classes (l). Alike sets share one of their rarest shingles.
_ALIKE = """WITH t AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM chunks WHERE chunk_id IS NOT NULL),
s AS (SELECT DISTINCT chunk_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS sh FROM t WHERE len(w) >= 30),
k AS (SELECT sh, len(sh) AS n, row_number() OVER () AS cls FROM (SELECT DISTINCT sh FROM s)), m AS (SELECT chunk_id, cls FROM s JOIN k USING (sh)),
e AS (SELECT cls, n, g, row_number() OVER (PARTITION BY cls ORDER BY df, g) AS nth FROM (SELECT *, count(*) OVER (PARTITION BY g) AS df FROM (SELECT cls, n, unnest(sh) AS g FROM k))),
f AS (SELECT cls, g FROM e WHERE nth <= n - ceil(0.7 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.cls AS x, b.cls AS y FROM f a JOIN f b USING (g) WHERE a.cls < b.cls),
o AS (SELECT x, y, a.n + b.n AS both_n, len(list_intersect(a.sh, b.sh)) AS o FROM c JOIN k a ON a.cls = x JOIN k b ON b.cls = y),
l AS (SELECT x, y FROM o WHERE o >= 0.7 * (both_n - o) - 1e-9)"""
_SPANS = """WITH w AS (SELECT doc_id, unnest(range(length(text) - 239)) AS pos, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 240),
h AS (SELECT doc_id, pos, md5(substring(text, pos + 1, 240)) AS h FROM w), r AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT DISTINCT doc_id, pos FROM h SEMI JOIN r USING (h)),
g AS (SELECT doc_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 240, true) AS gap FROM s),
i AS (SELECT doc_id, pos, count_if(gap) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM g),
spans AS (SELECT doc_id, min(pos)::INT AS span_start, (max(pos) + 240)::INT AS span_end FROM i GROUP BY doc_id, island)"""
_REPEATED = f"""WITH f AS (SELECT DISTINCT doc_id, ticker FROM filings WHERE ticker IS NOT NULL),
c AS (SELECT DISTINCT chunk_id, c.doc_id, f.ticker, text FROM chunks c JOIN f USING (doc_id) WHERE (kind IS NULL OR kind <> 'table') AND text IS NOT NULL),
l AS (SELECT chunk_id, doc_id, ticker, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM c),
g AS (SELECT *, {_form('line')} AS form FROM l), n AS (SELECT ticker, count(DISTINCT doc_id) AS docs FROM g WHERE form <> '' GROUP BY ticker),
h AS (SELECT ticker, form FROM g JOIN n USING (ticker) WHERE regexp_matches(form, '[a-z]') AND form NOT IN (SELECT {_form('heading')} FROM headings) GROUP BY ticker, form HAVING count(DISTINCT doc_id) >= 4 AND count(DISTINCT doc_id) * 20 >= any_value(docs)),
found AS (SELECT DISTINCT chunk_id, line_no::INT AS line_no FROM g JOIN h USING (ticker, form))"""
SQL: dict[str, str] = {
    "p1_found": f"{_REPEATED} SELECT chunk_id, line_no FROM found",
    "p1_clean": f"""{_REPEATED}, gone AS (SELECT chunk_id, list(line_no) AS gone FROM found GROUP BY chunk_id),
u AS (SELECT DISTINCT ON (chunk_id) chunk_id, text, string_split(text, chr(10)) AS lines FROM chunks ORDER BY chunk_id)
SELECT chunk_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda k: NOT list_contains(gone, k)), lambda k: lines[k]), chr(10)) END AS clean_text FROM u LEFT JOIN gone USING (chunk_id)""",
    "p3_found": f"""{_ALIKE}, every AS (SELECT x, y FROM l UNION ALL SELECT cls, cls FROM k)
SELECT DISTINCT least(a.chunk_id, b.chunk_id) AS chunk_id_a, greatest(a.chunk_id, b.chunk_id) AS chunk_id_b FROM every JOIN m a ON a.cls = x JOIN m b ON b.cls = y WHERE a.chunk_id <> b.chunk_id""",
    "p3_groups": f"""{_ALIKE}, z AS (SELECT cls, min(chunk_id) AS class_id, count(*) AS copies FROM m GROUP BY cls),
n AS (SELECT a AS cls, sum(copies) AS links FROM (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l) JOIN z ON z.cls = b GROUP BY a),
d AS (SELECT chunk_id, min(class_id) AS class_id, max(copies) AS copies, max(links) AS links FROM m JOIN z USING (cls) LEFT JOIN n USING (cls) GROUP BY chunk_id)
SELECT chunk_id, coalesce(class_id, chunk_id) AS class_id, coalesce(copies, 1) AS copies, coalesce(links, 0)::BIGINT AS links FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) LEFT JOIN d USING (chunk_id)""",
    "p8_found": f"{_SPANS} SELECT * FROM spans",
    "p8_coverage": f"""{_SPANS}, v AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS shared_chars, count(*) AS spans FROM spans GROUP BY doc_id),
d AS (SELECT doc_id, max(coalesce(length(text), 0))::INT AS chars FROM documents GROUP BY doc_id)
SELECT doc_id, chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(spans, 0) AS spans, CASE WHEN chars = 0 THEN 0 ELSE round(coalesce(shared_chars, 0) / chars, 6) END::DOUBLE AS shared_share FROM d LEFT JOIN v USING (doc_id)""",
    "p4_found": f"""SELECT DISTINCT item_id FROM (SELECT chunk_id AS item_id, text FROM chunks UNION ALL SELECT doc_id || ':p' || page_index || ':b' || block_no, text FROM blocks)
WHERE item_id IS NOT NULL AND len(regexp_extract_all(text, '{_NWS}+')) > 512""",
    "p4_coverage": f"""WITH i AS (SELECT chunk_id AS item_id, text FROM chunks UNION ALL SELECT doc_id || ':p' || page_index || ':b' || block_no, text FROM blocks)
SELECT item_id, 0 AS first, max(length(text))::INT AS last, max(length(text))::BIGINT AS covered, true AS within, true AS numbered FROM i WHERE item_id IS NOT NULL AND regexp_matches(text, '{_NWS}') GROUP BY item_id""",
    "p5_found": f"""WITH c AS (SELECT DISTINCT chunk_id, coalesce(text, '') AS t FROM chunks WHERE (kind IS NULL OR kind <> 'table') AND chunk_id IS NOT NULL),
w AS (SELECT chunk_id, t, regexp_extract_all(t, '{_NWS}+') AS w, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_WS}+$', '')), lambda x: x <> '') AS l FROM c),
s AS (SELECT chunk_id, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS chars, list_sum(list_transform(w, lambda x: length(regexp_replace(x, '[^|#*•…=_~<>^{{}}\\[\\]\\\\@+\\x{{FFFD}}]', '', 'g')))) AS sym, len(l) AS lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?]$'))) AS ended,
  len(list_filter(w, lambda x: list_contains(cw, regexp_replace(regexp_replace(lower(x), '^[^a-z]+', ''), '[^a-z]+$', '')))) AS com FROM w CROSS JOIN (SELECT list(lower(trim(word))) AS cw FROM common_words WHERE word IS NOT NULL))
SELECT chunk_id FROM s WHERE n = 0 OR NOT (chars >= 3 * n AND chars <= 9 * n AND ended * 4 >= lines AND sym * 20 <= chars AND com * 5 >= n)""",
}
