"""Retrieval queries: every question whose number is divisible by 50, or where it says so every question, against all chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingsift.functions.shared import written
from filingsift.operators import index
from filingsift.operators import retrieval as r
from filingsift.sources.tables import table

TOP_K, CANDIDATES = 5, 30


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The query set of a search: (query_id, text)."""
    q = table(spark, folder, "questions").where(F.expr("try_cast(substr(id, 2) as int) % 50 = 0"))
    return q.select(F.col("id").alias("query_id"), F.col("question").alias("text")).dropDuplicates(["query_id"])


def every(spark: SparkSession, folder: str) -> DataFrame:
    """All questions: (query_id, text)."""
    return table(spark, folder, "questions").select(F.col("id").alias("query_id"), F.col("question").alias("text")).dropDuplicates(["query_id"])


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks")


def _index(spark: SparkSession, folder: str) -> index.Index:
    return index.opened(spark, _chunks(spark, folder))


def _bm25(spark: SparkSession, folder: str, k: int) -> DataFrame:
    found = _index(spark, folder)
    return r.bm25(asked(spark, folder), found.packed, k, stats=found.stats)


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder, TOP_K).select("query_id", "chunk_id", "score", "rank")


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    detected = r.detect_filter(asked(spark, folder), r.aliases(table(spark, folder, "filings")))
    return r.resolve_filter(detected, _chunks(spark, folder))


def bm25_filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
    found = _index(spark, folder)
    resolved = written(_resolved(spark, folder).withColumn("filter_id", F.xxhash64("tickers", "years")), "resolved")
    queries = asked(spark, folder).join(resolved.select("query_id", "filter_id"), "query_id")
    return r.bm25(queries, found.packed, TOP_K, groups=filter_groups(resolved, found), stats=found.stats).select("query_id", "chunk_id", "score", "rank")


def filter_groups(resolved: DataFrame, found: index.Index) -> DataFrame:
    """(filter_id, grp): the groups of chunks (by ticker and year) that each filter admits."""
    members = r.filter_members(resolved.select("filter_id", "tickers", "years").distinct(), found.groups.withColumnRenamed("grp", "chunk_id"))
    return written(members.select("filter_id", F.col("chunk_id").alias("grp")).distinct(), "groups")


def detect_filter(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "questions").select(F.col("id").alias("query_id"), F.col("question").alias("text")).dropDuplicates(["query_id"])
    found = r.detect_filter(questions, r.aliases(table(spark, folder, "filings")))
    return found.select("query_id", F.array_join("tickers", ",").alias("tickers"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


def filter_fallback(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "questions").select(F.col("id").alias("query_id"), F.col("question").alias("text")).dropDuplicates(["query_id"])
    found = r.resolve_filter(r.detect_filter(questions, r.aliases(table(spark, folder, "filings"))), _chunks(spark, folder))
    return found.select("query_id", F.array_join("tickers", ",").alias("tickers"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"), "level")


def filter_isin(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).where(r.matches(["ALDRW", "BRAKW"], [2024, 2025])).select("chunk_id", "ticker", "fiscal_year", "page_index").distinct()


def substring_search(spark: SparkSession, folder: str) -> DataFrame:
    return r.substring_search(_chunks(spark, folder), "Liquidity Buffer", 8).select("chunk_id", "page_index", "page_label", "section")


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")).dropDuplicates(["vec_id"])
    return v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    queries, vectors = _vectors(spark, folder)
    return r.cosine(queries, vectors, TOP_K, "vec_id")


def dense_filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
    queries, vectors = _vectors(spark, folder)
    return r.cosine(queries, vectors, TOP_K, "vec_id", group="label")


def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    sparse = r.hash_embed(_chunks(spark, folder).select("chunk_id", "embed_text").dropDuplicates(["chunk_id"]))
    return sparse.select("chunk_id", F.explode(F.arrays_zip("buckets", "weights")).alias("x")).select("chunk_id", F.col("x.buckets").alias("bucket"), F.round("x.weights", 6).alias("weight"))


def _both(spark: SparkSession, folder: str, k: int) -> DataFrame:
    queries = asked(spark, folder)
    dense = r.cosine(r.hash_embed(queries, "query_id", "text"), _index(spark, folder).vectors, CANDIDATES)
    sparse = _bm25(spark, folder, CANDIDATES)
    return r.fused(dense, sparse, k)


def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _both(spark, folder, TOP_K)


def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = _bm25(spark, folder, CANDIDATES)
    return r.reranked(hits, asked(spark, folder), _index(spark, folder).of(hits, "embed_text"), TOP_K)


def balanced_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every question against the chunks of every bank; those of a bank lie together, so few partitions have a best of it."""
    chunks = _chunks(spark, folder).select("chunk_id", "doc_id", "embed_text")
    rows = index.once(chunks, written(index.repeated(chunks), "repeats")).withColumn("owner", F.regexp_extract("doc_id", "^([^_]*)", 1))
    rows = rows.select("chunk_id", "owner", "embed_text").repartitionByRange("owner", "chunk_id").sortWithinPartitions("owner", "chunk_id")
    packed = written(r.packed(rows, keep=("owner",)), "packed")
    return r.balanced(every(spark, folder), packed, "owner", 2).select("query_id", "owner", "chunk_id", "score", "rank")


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered_topk, detect_filter, filter_fallback, filter_isin, substring_search, dense_topk, dense_filtered_topk, hash_embed, hybrid_topk, rerank_topk, balanced_topk)}

_ASKED = "q AS (SELECT id AS query_id, any_value(question) AS text FROM questions WHERE try_cast(substr(id, 2) AS INT) % 50 = 0 GROUP BY id)"
_ALL_ASKED = "q AS (SELECT id AS query_id, any_value(question) AS text FROM questions GROUP BY id)"
_INDEX = """
c AS (SELECT chunk_id, any_value(embed_text) AS t FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
w AS (SELECT chunk_id, regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+') AS l FROM c),
w2 AS (SELECT chunk_id, CASE WHEN len(l) = 0 THEN ['_'] ELSE l END AS l FROM w),
i0 AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, unnest(l) AS term, len(l) AS dl FROM w2) GROUP BY chunk_id, term)"""
_BM25 = """
a AS (SELECT query_id, filter_id, term, count(*) AS qf FROM (SELECT query_id, filter_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM qf) GROUP BY ALL),
s AS (SELECT filter_id, count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT filter_id, chunk_id, dl FROM i) GROUP BY filter_id),
d AS (SELECT i.filter_id, term, count(*) AS df, any_value(n) AS n, any_value(avgdl) AS avgdl FROM i JOIN s USING (filter_id) GROUP BY i.filter_id, term),
e AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM d),
m AS (SELECT filter_id, avg(idf) AS mean_idf FROM e GROUP BY filter_id),
t AS (SELECT query_id, a.filter_id, a.term, avgdl, qf * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END AS weight FROM a JOIN e ON a.filter_id = e.filter_id AND a.term = e.term JOIN m ON m.filter_id = a.filter_id),
sc AS (SELECT query_id, chunk_id, round(sum(weight * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM t JOIN i ON t.filter_id = i.filter_id AND t.term = i.term GROUP BY query_id, chunk_id),
pos AS (SELECT query_id, count(*) AS found FROM sc WHERE score > 0 GROUP BY query_id),
idle AS (SELECT query_id, chunk_id, 0.0::DOUBLE AS score FROM (SELECT qf.query_id, u.chunk_id, row_number() OVER (PARTITION BY qf.query_id ORDER BY u.chunk_id) AS r FROM qf LEFT JOIN pos USING (query_id) JOIN (SELECT DISTINCT filter_id, chunk_id FROM i) u ON u.filter_id = qf.filter_id WHERE coalesce(found, 0) < {k} AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.query_id = qf.query_id AND sc.chunk_id = u.chunk_id)) WHERE r <= {k}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM sc UNION ALL SELECT * FROM idle)) WHERE rank <= {k})"""
_FREE = f"{_ASKED}, qf AS (SELECT *, 0 AS filter_id FROM q), {_INDEX}, i AS (SELECT *, 0 AS filter_id FROM i0), "
_ALL_FREE = _FREE.replace(_ASKED, _ALL_ASKED)
_DETECT = """
al0 AS (SELECT DISTINCT ticker, array_to_string(regexp_extract_all(lower(regexp_replace(trim(regexp_replace(bank, '\\s+', ' ', 'g')), '(?i), inc.?$', '')), '[a-z0-9]+'), ' ') AS name FROM filings WHERE ticker IS NOT NULL),
al AS (SELECT DISTINCT ticker, alias FROM (SELECT ticker, lower(ticker) AS alias FROM al0 UNION ALL SELECT ticker, name FROM al0 UNION ALL SELECT ticker, split_part(name, ' ', 1) FROM al0) WHERE alias <> ''),
qn AS (SELECT query_id, text, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS t FROM q),
nm AS (SELECT query_id, list_sort(list(DISTINCT ticker)) AS tickers FROM qn JOIN al ON contains(t, ' ' || alias || ' ') GROUP BY query_id),
det AS (SELECT q.query_id, coalesce(tickers, []) AS tickers, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '\\b(20\\d\\d)\\b', 1)::INT[])) AS years FROM q LEFT JOIN nm USING (query_id))"""
_RESOLVE = """
h AS (SELECT DISTINCT upper(trim(ticker)) AS ticker, fiscal_year FROM chunks WHERE ticker IS NOT NULL),
res0 AS (SELECT *, CASE WHEN (len(tickers) > 0 OR len(years) > 0) AND EXISTS (SELECT 1 FROM h WHERE (len(tickers) = 0 OR list_contains(tickers, h.ticker)) AND (len(years) = 0 OR list_contains(years, h.fiscal_year))) THEN 2 WHEN len(tickers) > 0 AND EXISTS (SELECT 1 FROM h WHERE list_contains(tickers, h.ticker)) THEN 1 ELSE 0 END AS level FROM det),
res AS (SELECT query_id, CASE WHEN level >= 1 THEN tickers ELSE [] END AS tickers, CASE WHEN level = 2 THEN years ELSE [] END AS years, level FROM res0)"""
_COSINE = """
v AS (SELECT vec_id, any_value(label) AS label, any_value(embedding)::DOUBLE[] AS e FROM embeddings GROUP BY vec_id)
SELECT query_id, vec_id, score, rank FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON {on} WHERE a.vec_id % 50 = 0)) WHERE rank <= 5"""
_HASHED = """
hv0 AS (SELECT id, ('0x' || substr(md5(w), 31, 2))::INT AS bucket, CASE WHEN ('0x' || substr(md5(w), 16, 1))::INT % 2 = 1 THEN 1 ELSE -1 END AS s FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+')) AS w FROM ht)),
hv1 AS (SELECT id, bucket, sum(s)::DOUBLE AS x FROM hv0 GROUP BY id, bucket HAVING sum(s) <> 0),
hv AS (SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM hv1)"""

SQL = {
    "bm25_topk": f"WITH {_FREE}{_BM25.format(k=5)} SELECT query_id, chunk_id, score, rank FROM hits",
    "bm25_filtered_topk": f"""WITH {_ASKED}, {_DETECT}, {_RESOLVE}, {_INDEX},
rf AS (SELECT *, dense_rank() OVER (ORDER BY array_to_string(tickers, ',') || '/' || array_to_string(years, ',')) AS filter_id FROM res),
qf AS (SELECT q.query_id, text, filter_id FROM q JOIN rf USING (query_id)),
cm AS (SELECT DISTINCT chunk_id, upper(trim(ticker)) AS ticker, fiscal_year FROM chunks WHERE chunk_id IS NOT NULL),
mem AS (SELECT DISTINCT filter_id, chunk_id FROM (SELECT DISTINCT filter_id, tickers, years FROM rf) f JOIN cm ON (len(tickers) = 0 OR list_contains(tickers, cm.ticker)) AND (len(years) = 0 OR list_contains(years, cm.fiscal_year))),
i AS (SELECT i0.*, filter_id FROM i0 JOIN mem USING (chunk_id)), {_BM25.format(k=5)} SELECT query_id, chunk_id, score, rank FROM hits""",
    "detect_filter": f"WITH {_ALL_ASKED}, {_DETECT} SELECT query_id, array_to_string(tickers, ',') AS tickers, array_to_string(years, ',') AS years FROM det",
    "filter_fallback": f"WITH {_ALL_ASKED}, {_DETECT}, {_RESOLVE} SELECT query_id, array_to_string(tickers, ',') AS tickers, array_to_string(years, ',') AS years, level FROM res",
    "filter_isin": "SELECT DISTINCT chunk_id, ticker, fiscal_year, page_index FROM chunks WHERE ticker IN ('ALDRW', 'BRAKW') AND fiscal_year IN (2024, 2025)",
    "substring_search": "SELECT DISTINCT chunk_id, page_index, page_label, section FROM chunks WHERE contains(lower(text), 'liquidity buffer') ORDER BY chunk_id LIMIT 8",
    "dense_topk": "WITH" + _COSINE.format(on="true"),
    "dense_filtered_topk": "WITH" + _COSINE.format(on="a.label = b.label"),
    "hash_embed": f"WITH {_INDEX}, ht AS (SELECT chunk_id AS id, t FROM c), {_HASHED} SELECT id AS chunk_id, bucket, round(weight, 6) AS weight FROM hv",
    "hybrid_topk": f"""WITH {_FREE}{_BM25.format(k=30)}, ht AS (SELECT chunk_id AS id, t FROM c UNION ALL SELECT query_id, text FROM q), {_HASHED},
dot AS (SELECT a.id AS query_id, b.id AS chunk_id, sum(a.weight * b.weight) AS x FROM hv a JOIN hv b USING (bucket) WHERE a.id IN (SELECT query_id FROM q) AND b.id IN (SELECT chunk_id FROM c) GROUP BY ALL),
den AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.query_id, c.chunk_id, round(coalesce(x, 0), 6) AS score FROM q CROSS JOIN c LEFT JOIN dot ON dot.query_id = q.query_id AND dot.chunk_id = c.chunk_id)) WHERE rank <= 30),
fu AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.rank AS dr, s.rank AS sr, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS score FROM den d FULL JOIN hits s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST, chunk_id) AS rank FROM fu) WHERE rank <= 5""",
    "rerank_topk": f"""WITH {_FREE}{_BM25.format(k=30)},
rr AS (SELECT h.query_id, h.chunk_id, h.rank AS fr, round(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')), w.l))::DOUBLE / len(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+'))), 6) AS score FROM hits h JOIN q USING (query_id) JOIN w USING (chunk_id))
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr) AS rank FROM rr) WHERE rank <= 5""",
    "balanced_topk": f"""WITH {_ALL_FREE}{_BM25.format(k=30)}, ow AS (SELECT DISTINCT chunk_id, split_part(doc_id, '_', 1) AS owner FROM chunks)
SELECT query_id, owner, chunk_id, score, rank FROM (SELECT h.query_id, owner, h.chunk_id, score, row_number() OVER (PARTITION BY h.query_id, owner ORDER BY score DESC, h.chunk_id) AS rank FROM hits h JOIN ow USING (chunk_id)) WHERE rank <= 2""",
}
