"""Store, ledger and stream queries over the whole logs and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingsift.functions.answers import cache_key, usd
from filingsift.functions.shared import shared_dir
from filingsift.operators import retrieval, store
from filingsift.operators.metrics import once
from filingsift.sources.tables import table
from filingsift.streaming import logs


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    return once(table(spark, folder, "cost_log"), "log_id", "arrived_at", "ts")


def cost_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _calls(spark, folder).groupBy("kind", "model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 6).alias("usd"))


def cost_recomputed(spark: SparkSession, folder: str) -> DataFrame:
    return _calls(spark, folder).select("log_id", F.round(usd(F.col("tokens_in"), F.col("tokens_out")), 8).alias("cost"))


def cost_running_total(spark: SparkSession, folder: str) -> DataFrame:
    calls = _calls(spark, folder).withColumn("usd", F.col("usd").cast("decimal(20,10)"))
    return store.running_total(calls, "ts", "log_id", "usd").select("log_id", F.round("running", 6).cast("double").alias("running"))


def budget_cut(spark: SparkSession, folder: str) -> DataFrame:
    return store.within_budget(_calls(spark, folder).withColumn("usd", F.col("usd").cast("decimal(20,10)")), "ts", "log_id", "usd", 0.05).select("log_id")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").where("text is not null").select("chunk_id", "fiscal_year", "text", cache_key("emb:hash", F.col("text")).alias("key"))


def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """What chunks of 2020 on need beside what older ones left in the cache."""
    rows = _requests(spark, folder)
    return store.misses(rows.where("fiscal_year >= 2020"), rows.where("fiscal_year < 2020").select("key").distinct()).select("key")


def cache_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Hits and misses of a cache filled by the chunks of each year, when those of the next recorded year ask: null years last."""
    rows = _requests(spark, folder).select("key", F.coalesce("fiscal_year", F.lit(9999)).alias("year"))
    first = rows.groupBy("key").agg(F.min("year").alias("first"))
    asked = rows.join(first, "key")
    return asked.groupBy("year").agg(F.count_if(F.col("first") < F.col("year")).alias("hits"), F.countDistinct(F.when(F.col("first") == F.col("year"), F.col("key"))).alias("misses"))


def cache_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = _requests(spark, folder).where("fiscal_year is not null").select("key", "fiscal_year")
    old, new = rows.where("fiscal_year < 2020"), rows.where("fiscal_year >= 2015")
    return store.upserted(old, new, "key", "fiscal_year").select("key", "fiscal_year")


def embed_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with the buckets of its vector; equal texts share one computation."""
    rows = _requests(spark, folder).select("chunk_id", "text", "key").distinct()
    embed = lambda r: retrieval.hash_embed(r, "key", "text")
    out, _ = store.computed_once(rows, embed(rows.where("false")), embed)
    return out.select("chunk_id", "key", F.size("buckets").alias("buckets"))


def latest_filing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "filings").where("ticker is not null and fiscal_year is not null")
    return store.latest(rows, ["ticker"], "fiscal_year", "doc_id").select("ticker", "fiscal_year", "doc_id")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, and whether it has chunks (documents without any are reported, not lost)."""
    docs = table(spark, folder, "filings").where("doc_id is not null").groupBy("doc_id").agg(F.max("ticker").alias("ticker"), F.max("fiscal_year").alias("fiscal_year"))
    have = table(spark, folder, "chunks").select("doc_id").distinct().withColumn("has_chunks", F.lit(True))
    return docs.join(have, "doc_id", "left").select("doc_id", "ticker", "fiscal_year", F.coalesce("has_chunks", F.lit(False)).alias("has_chunks"))


def carry_over(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with the cost that an earlier arrival of their log_id recorded, where there is one."""
    rows = table(spark, folder, "cost_log").where("log_id is not null")
    late = rows.groupBy("log_id").agg(F.max_by(F.struct("kind", "usd"), F.struct("arrived_at", "ts")).alias("r")).select("log_id", "r.kind", "r.usd")
    prior = _calls(spark, folder).where("usd is not null").select("log_id", "usd")
    return store.carried_over(late, prior, "log_id", ["usd"]).select("log_id", "kind", F.round("usd", 8).alias("usd"))


def log_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The query log appended as JSON lines and read back by schema."""
    path = f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}"
    rows = table(spark, folder, "query_log").select("log_id", "config", "mode", "input", "retrieved", "prompt_hash", "output")
    store.append_log(rows, path)
    back = store.json_lines(spark, path, rows.schema)
    return back.select("log_id", "config", "mode", F.size(F.coalesce("retrieved", F.array().cast("array<struct<chunk_id:string,score:double>>"))).alias("hits"), "prompt_hash").distinct()


def idempotent_build(spark: SparkSession, folder: str) -> DataFrame:
    """A table of chunk counts, built on the first call and only read on the second."""
    path = f"{shared_dir(spark)}/built-{uuid.uuid4().hex}"
    build = lambda: table(spark, folder, "chunks").groupBy("ticker").agg(F.countDistinct("chunk_id").alias("chunks"))
    store.built(spark, path, build)
    return store.built(spark, path, build)


def stream_hourly_cost(spark: SparkSession, folder: str) -> DataFrame:
    return logs.hourly_cost(spark, folder)


def stream_cost_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    return logs.cost_by_hour(spark, folder)


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    return logs.ingested(spark, folder)


QUERIES = {f.__name__: f for f in (cost_totals, cost_recomputed, cost_running_total, budget_cut, cache_misses, cache_counts, cache_upsert, embed_dedupe, latest_filing, manifest, carry_over, log_round_trip, idempotent_build, stream_hourly_cost, stream_cost_by_hour, stream_ingest)}

_C = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY arrived_at, ts) AS rn FROM cost_log WHERE log_id IS NOT NULL) WHERE rn = 1)"
_R = "r AS (SELECT chunk_id, fiscal_year, text, sha256('emb:hash' || chr(0) || text) AS key FROM chunks WHERE text IS NOT NULL)"
SQL = {
    "cost_totals": f"WITH {_C} SELECT kind, model, count(*) AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(coalesce(sum(usd), 0), 6) AS usd FROM c GROUP BY kind, model",
    "cost_recomputed": f"WITH {_C} SELECT log_id, round((coalesce(tokens_in, 0) * 0.4::DOUBLE + coalesce(tokens_out, 0) * 1.6::DOUBLE) / 1e6, 8) AS cost FROM c",
    "cost_running_total": f"WITH {_C} SELECT log_id, round(sum(coalesce(usd, 0)::DECIMAL(20,10)) OVER (ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS running FROM c",
    "budget_cut": f"WITH {_C} SELECT log_id FROM (SELECT log_id, sum(coalesce(usd, 0)::DECIMAL(20,10)) OVER (ORDER BY ts, log_id ROWS UNBOUNDED PRECEDING) - coalesce(usd, 0)::DECIMAL(20,10) AS before FROM c) WHERE before <= 0.05",
    "cache_misses": f"WITH {_R} SELECT DISTINCT key FROM r WHERE fiscal_year >= 2020 AND key NOT IN (SELECT key FROM r WHERE fiscal_year < 2020)",
    "cache_counts": f"WITH {_R}, y AS (SELECT key, coalesce(fiscal_year, 9999) AS year FROM r), f AS (SELECT key, min(year) AS first FROM y GROUP BY key) SELECT year, count_if(first < year) AS hits, count(DISTINCT CASE WHEN first = year THEN key END) AS misses FROM y JOIN f USING (key) GROUP BY year",
    "cache_upsert": f"WITH {_R} SELECT key, max(fiscal_year) AS fiscal_year FROM r WHERE fiscal_year IS NOT NULL GROUP BY key",
    "embed_dedupe": f"WITH {_R}, d AS (SELECT DISTINCT chunk_id, text, key FROM r), w AS (SELECT key, bucket FROM (SELECT key, ('0x' || substr(md5(w), 31, 2))::INT AS bucket, CASE WHEN ('0x' || substr(md5(w), 16, 1))::INT % 2 = 1 THEN 1 ELSE -1 END AS s FROM (SELECT key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM (SELECT DISTINCT key, text FROM d))) GROUP BY key, bucket HAVING sum(s) <> 0), n AS (SELECT key, count(*) AS n FROM w GROUP BY key) SELECT chunk_id, d.key, coalesce(n, 0)::INT AS buckets FROM d LEFT JOIN n ON d.key = n.key",
    "latest_filing": "SELECT ticker, fiscal_year, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY fiscal_year DESC, doc_id) AS r FROM filings WHERE ticker IS NOT NULL AND fiscal_year IS NOT NULL) WHERE r = 1",
    "manifest": "SELECT doc_id, max(ticker) AS ticker, max(fiscal_year) AS fiscal_year, doc_id IN (SELECT doc_id FROM chunks WHERE doc_id IS NOT NULL) AS has_chunks FROM filings WHERE doc_id IS NOT NULL GROUP BY doc_id",
    "carry_over": f"WITH {_C}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY arrived_at DESC, ts DESC) AS k FROM cost_log WHERE log_id IS NOT NULL) WHERE k = 1) SELECT l.log_id, l.kind, round(coalesce(c.usd, l.usd), 8) AS usd FROM l LEFT JOIN c ON c.log_id = l.log_id AND c.usd IS NOT NULL",
    "log_round_trip": "SELECT DISTINCT log_id, config, mode, coalesce(len(retrieved), 0)::INT AS hits, prompt_hash FROM query_log",
    "idempotent_build": "SELECT ticker, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY ticker",
    "stream_ingest": "SELECT DISTINCT sha256('hash' || chr(0) || text) AS key, length(text)::INT AS chars FROM chunks WHERE text IS NOT NULL",
    "stream_cost_by_hour": f"WITH {_C} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, kind, count(*) AS calls, round(sum(coalesce(usd, 0)), 6) AS usd FROM c GROUP BY 1, 2",
    "stream_hourly_cost": f"WITH {_C} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, kind, count(*) AS calls, round(sum(coalesce(usd, 0)), 6) AS usd FROM c WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM cost_log WHERE log_id IS NOT NULL) - INTERVAL 2 HOUR GROUP BY 1, 2",
}
