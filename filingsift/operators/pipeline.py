"""From questions and claims to answers, verdicts and log rows, under one configuration and over one persistent index.

Every step takes all queries at once: filters, candidates, reranking, prompts, model calls with a cache, citations. Models are
interfaces: a ``Completer`` turns distinct prompts into texts, a ``Scorer`` rates candidates; the offline ones need no network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingsift.config import Config
from filingsift.functions import answers as a
from filingsift.functions.shared import written
from filingsift.functions.text import word_count
from filingsift.operators import prompting, retrieval, store
from filingsift.operators.index import Index

#: (key, kind, system, user, text, excerpts) of distinct prompts -> (key, raw, tokens_in, tokens_out).
Completer = Callable[[DataFrame], DataFrame]
#: (hits, queries, chunks, k) -> hits, best first.
Scorer = Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]
CACHE = "key string, raw string, tokens_in long, tokens_out long"
#: Attempts of a model call, with pauses of 1, 2, 4, .. seconds between them.
ATTEMPTS = 4


# ---- models


def offline(requests: DataFrame) -> DataFrame:
    """The deterministic completer, as JSON text; costs are counted in words."""
    answer, abstain = prompting.offline_answer(F.col("text"), F.col("excerpts"))
    said, at = prompting.offline_verdict(F.col("text"), F.col("excerpts"))
    one = lambda shown, n: F.when(shown, F.array(F.lit(n))).otherwise(F.array().cast("array<int>"))
    ask = F.to_json(F.struct(answer.alias("answer"), one(~abstain, 1).alias("citations"), abstain.alias("abstain")), {"ignoreNullFields": "false"})
    why = F.when(at > 0, "numbers found").otherwise("not found")
    verify = F.to_json(F.struct(said.alias("verdict"), why.alias("explanation"), F.when(at > 0, F.array(at)).otherwise(F.array().cast("array<int>")).alias("evidence")))
    rows = requests.select("key", F.when(F.col("kind") == "ask", ask).otherwise(verify).alias("raw"), (word_count(F.col("system")) + word_count(F.col("user"))).cast("long").alias("tokens_in"))
    return rows.withColumn("tokens_out", word_count(F.col("raw")).cast("long"))


def remote(call: Callable[[str, str], tuple[str, int, int]], pause: Callable[[float], None] = time.sleep) -> Completer:
    """A completer from a function (system, user) -> (text, tokens in, tokens out) that may fail: it is tried ATTEMPTS times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for attempt in range(ATTEMPTS):
                    try:
                        rows.append((r.key, *call(r.system, r.user)))
                        break
                    except Exception as e:  # limits and outages of a service
                        if attempt + 1 == ATTEMPTS:
                            raise RuntimeError(f"the model failed {ATTEMPTS} times: {e}") from e
                        pause(2.0**attempt)
            yield pd.DataFrame(rows, columns=["key", "raw", "tokens_in", "tokens_out"])

    return lambda requests: requests.select("key", "system", "user").mapInPandas(run, CACHE)


def completed(requests: DataFrame, cache: DataFrame, config: Config, complete: Completer = offline) -> tuple[DataFrame, DataFrame]:
    """(requests with raw, tokens_in, tokens_out, cached, usd and prompt_hash; the grown cache).

    ``requests`` are (query_id, kind, system, user, text, excerpts). Equal prompts share one call, paid by the least query_id;
    what the cache holds is not called. The key holds provider, model and settings. A free provider costs nothing."""
    c = config.completion
    key = a.cache_key(f"llm:{c.provider}:{c.model}:{c.temperature}:{c.max_tokens}", F.concat("system", F.char(F.lit(0)), "user"))
    rows = written(requests.withColumn("key", key).withColumn("prompt_hash", prompting.prompt_hash(F.col("system"), F.col("user"))), "requests")
    fresh = written(complete(store.misses(rows, cache)).select("key", "raw", "tokens_in", "tokens_out"), "completed")
    grown = cache.select("key", "raw", "tokens_in", "tokens_out").unionByName(fresh)
    paid = rows.join(fresh.select("key"), "key", "left_semi").groupBy("key").agg(F.min("query_id").alias("payer"))
    out = rows.join(grown, "key").join(paid, "key", "left").withColumn("cached", ~F.coalesce(F.col("payer") == F.col("query_id"), F.lit(False)))
    cost = a.usd(F.col("tokens_in"), F.col("tokens_out"), c.price_in, c.price_out, F.col("cached")) if c.provider != "offline" else F.lit(0.0)
    return out.withColumn("usd", cost).drop("payer"), grown


# ---- retrieval under a configuration


def filters(queries: DataFrame, index: Index, alias: DataFrame, config: Config) -> DataFrame:
    """(query_id, tickers, years, filter_id): what each query's filter admits after falling back; empty where filters are off."""
    if config.retrieval.metadata_filter:
        found = retrieval.resolve_filter(retrieval.detect_filter(queries, alias), index.groups)
    else:
        found = queries.select("query_id", F.array().cast("array<string>").alias("tickers"), F.array().cast("array<int>").alias("years"))
    return written(found.select("query_id", "tickers", "years").withColumn("filter_id", F.xxhash64("tickers", "years")), "filters")


def retrieved(queries: DataFrame, index: Index, alias: DataFrame, config: Config, score: Scorer | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the hits of each query by the configured mode (dense, bm25 or their fusion), within its
    filter; with reranking the candidates are rated again by ``score``."""
    c = config.retrieval
    found = filters(queries, index, alias, config)
    members = retrieval.filter_members(found.select("filter_id", "tickers", "years").distinct(), index.groups.withColumnRenamed("grp", "chunk_id"))
    groups = written(members.select("filter_id", F.col("chunk_id").alias("grp")).distinct(), "groups")
    queries = queries.join(found.select("query_id", "filter_id"), "query_id")

    def dense(k: int) -> DataFrame:
        return retrieval.cosine(retrieval.hash_embed(queries, "query_id", "text", ("filter_id",)), index.vectors, k, groups=groups)

    def sparse(k: int) -> DataFrame:
        return retrieval.bm25(queries, index.packed, k, groups=groups, stats=index.stats)

    def by_mode(k: int) -> DataFrame:
        if c.mode == "dense":
            return dense(k)
        if c.mode == "bm25":
            return sparse(k)
        return retrieval.fused(dense(c.candidates), sparse(c.candidates), k, constant=c.rrf)

    if not c.rerank:
        return by_mode(c.top_k).select("query_id", "chunk_id", "score", "rank")
    hits = written(by_mode(c.candidates).select("query_id", "chunk_id", "score", "rank"), "candidates")
    return (score or retrieval.reranked)(hits, queries, index.of(hits, "embed_text"), c.top_k)


def with_hits(queries: DataFrame, hits: DataFrame, index: Index) -> DataFrame:
    """``queries`` with ``hits``, the chunks found in rank order (as many as were asked for), and ``excerpts`` for the prompt."""
    chunk = ["chunk_id", "doc_id", "bank", "fiscal_year", "page_label", "page_index", "section"]
    hits = written(hits, "found")
    rows = hits.join(index.of(hits, *chunk[1:], F.col("text").alias("snippet")), "chunk_id")
    found = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *chunk, "snippet", "score"))).alias("hits"))
    none = F.lit(None).cast(found.schema["hits"].dataType)
    out = queries.join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(found.schema["hits"].dataType), none))
    number = lambda h: a.excerpt(h["rank"], h["bank"], h["fiscal_year"], h["section"], h["page_label"], h["snippet"])
    return out.withColumn("excerpts", F.transform("hits", number))


def _cited(numbers: Column) -> Column:
    """The hits that kept citation numbers stand for."""
    fields = ("chunk_id", "doc_id", "bank", "fiscal_year", "page_label", "page_index", "section", "snippet")

    def one(n: Column) -> Column:
        hit = F.get(F.col("hits"), (n - 1).cast("int"))
        return F.struct(n.cast("int").alias("n"), *[hit[f].alias(f) for f in fields])

    return F.transform(numbers, one)


def _of_kind(queries: DataFrame, kind: str) -> DataFrame:
    return queries.select("query_id", F.lit(kind).alias("kind"), "text")


def _run(queries: DataFrame, index: Index, alias: DataFrame, config: Config, cache: DataFrame | None, complete: Completer, score: Scorer | None) -> tuple[DataFrame, DataFrame]:
    """``queries`` (query_id, kind, text) with hits and what the model said, and the grown cache; kinds share the search and the calls."""
    cache = cache if cache is not None else queries.sparkSession.createDataFrame([], CACHE)
    rows = written(with_hits(queries, retrieved(queries.select("query_id", "text"), index, alias, config, score), index), "hits")
    of_kind = lambda asks, checks: F.when(F.col("kind") == "ask", asks).otherwise(checks)
    user = lambda name: prompting.prompt(name, F.col("excerpts"), F.col("text"))
    requests = rows.select("query_id", "kind", of_kind(F.lit(prompting.ASK), F.lit(prompting.VERIFY)).alias("system"), of_kind(user("QUESTION"), user("CLAIM")).alias("user"), "text", "excerpts")
    done, grown = completed(requests, cache, config, complete)
    out = rows.join(done.select("query_id", "raw", "tokens_in", "tokens_out", "cached", "usd", "prompt_hash"), "query_id").withColumn("parsed", a.parse_object(F.col("raw")))
    items = F.transform("hits", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["doc_id"].alias("doc_id"), h["page_index"].alias("page_index"), h["score"].alias("score")))
    return out.withColumn("retrieved", items).withColumn("config", F.lit(config.name)).withColumnRenamed("kind", "mode"), grown


def _answers(rows: DataFrame) -> DataFrame:
    good, bad = a.citations(F.col("parsed"), "citations", F.size("hits"))
    abstain = a.abstains(F.col("parsed"))
    out = rows.withColumn("abstain", abstain).withColumn("kept", F.when(abstain, F.array().cast("array<bigint>")).otherwise(good)).withColumn("invalid_citations", bad)
    out = out.withColumn("answer", F.when(~F.col("abstain"), F.try_variant_get("parsed", "$.answer", "string"))).withColumn("citations", _cited(F.col("kept")))
    return out.select("query_id", "config", "mode", "text", "answer", "abstain", "citations", "invalid_citations", "retrieved", "prompt_hash", "usd", "cached", "raw")


def _verdicts(rows: DataFrame) -> DataFrame:
    good, bad = a.citations(F.col("parsed"), "evidence", F.size("hits"))
    said = a.verdict(F.coalesce(F.try_variant_get("parsed", "$.verdict", "string"), F.lit("")))
    out = rows.withColumn("verdict", said).withColumn("explanation", F.coalesce(F.try_variant_get("parsed", "$.explanation", "string"), F.lit("")))
    out = out.withColumn("invalid_citations", bad).withColumn("evidence", _cited(good))
    return out.select("query_id", "config", "mode", "text", "verdict", "explanation", "evidence", "invalid_citations", "retrieved", "prompt_hash", "usd", "cached", "raw")


def ask(queries: DataFrame, index: Index, alias: DataFrame, config: Config, cache: DataFrame | None = None, complete: Completer = offline, score: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, the grown cache): one row per query (query_id, text) with answer, abstain, citations (each with its chunk),
    invalid_citations, retrieved, prompt_hash, usd, cached, raw. An answer that abstains cites nothing."""
    rows, grown = _run(_of_kind(queries, "ask"), index, alias, config, cache, complete, score)
    return _answers(rows), grown


def verify(claims: DataFrame, index: Index, alias: DataFrame, config: Config, cache: DataFrame | None = None, complete: Completer = offline, score: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, the grown cache): one row per claim (query_id, text) with verdict, explanation, evidence (each with its
    chunk), invalid_citations, retrieved, prompt_hash, usd, cached, raw."""
    rows, grown = _run(_of_kind(claims, "verify"), index, alias, config, cache, complete, score)
    return _verdicts(rows), grown


def both(questions: DataFrame, claims: DataFrame, index: Index, alias: DataFrame, config: Config, cache: DataFrame | None = None, complete: Completer = offline, score: Scorer | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, verdicts, the grown cache): what ``ask`` and ``verify`` give for ids that are strings, by one search and one
    round of calls. A question and a claim may have the same id."""
    named = [_of_kind(q, kind).withColumn("query_id", F.concat(F.lit(f"{kind}:"), "query_id")) for kind, q in (("ask", questions), ("verify", claims))]
    rows, grown = _run(named[0].unionByName(named[1]), index, alias, config, cache, complete, score)
    rows = written(rows.drop("parsed"), "answered").withColumn("parsed", a.parse_object(F.col("raw"))).withColumn("query_id", F.regexp_replace("query_id", "^[a-z]+:", ""))
    return _answers(rows.where("mode = 'ask'")), _verdicts(rows.where("mode = 'verify'")), grown


def log_rows(answers: DataFrame) -> DataFrame:
    """Rows of the query log (with a log_id of configuration, mode and query), to be appended by ``store.append_log``."""
    hits = F.transform("retrieved", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["score"].alias("score")))
    now = F.current_timestamp()
    output = F.struct(F.col("raw").alias("raw"), F.col("invalid_citations").cast("int").alias("invalid_citations"))
    return answers.select(F.xxhash64("config", "mode", "query_id").alias("log_id"), now.alias("ts"), now.alias("arrived_at"), "config", "mode", F.col("text").alias("input"), hits.alias("retrieved"), "prompt_hash", output.alias("output"))
