"""Retrieval over chunks: filter detection with fallback, BM25, exact cosine, reciprocal-rank fusion and reranking.

Every operator takes a table of queries and answers them all. A query set is matched with texts or vectors block by block
(``scoring``); ranks are windows per query, which Spark limits before and after the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingsift.functions.shared import written
from filingsift.functions.text import let, squeezed, tokens
from filingsift.operators import scoring

#: BM25 parameters and the rank constant of reciprocal-rank fusion.
K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60
HASH_DIM = 256


def top(scored: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first k rows of each query, with their 1-based ``rank``; ``order`` must be total."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


# ---- filters


def matches(tickers: list[str], years: list[int]) -> Column:
    """Rows that satisfy a literal filter; an empty list is no constraint. Reaches the scan as a pushed filter."""
    out = F.lit(True)
    if tickers:
        out = out & F.col("ticker").isin(tickers)
    if years:
        out = out & F.col("fiscal_year").isin(years)
    return out


def aliases(filings: DataFrame) -> DataFrame:
    """(alias, ticker): a bank's ticker, its name and the first word of its name, as space-separated tokens."""
    name = F.array_join(tokens(F.regexp_replace(squeezed(F.col("bank")), "(?i), inc.?$", "")), " ")
    named = filings.where("ticker is not null").select("ticker", F.explode(F.array(F.lower("ticker"), name, F.split(name, " ")[0])).alias("alias"))
    return named.where("alias is not null and alias <> ''").distinct()


def detect_filter(queries: DataFrame, alias: DataFrame, longest: int = 5) -> DataFrame:
    """(query_id, tickers, years): the banks a query names (whole words, any case) and its years 20xx, both sorted.

    Words are matched by equality of word n-grams with an alias, not by trying every alias on every query.
    """
    words = queries.select("query_id", tokens(F.col("text")).alias("w"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: F.when(i + n - 1 <= F.size("w"), F.array_join(F.slice("w", i, n), " ")))))
    said = words.select("query_id", F.explode(F.array_distinct(grams)).alias("alias")).where("alias is not null")
    named = said.join(alias, "alias").groupBy("query_id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))))
    out = queries.select("query_id", years.alias("years")).join(named, "query_id", "left")
    return out.select("query_id", F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"), "years")


def resolve_filter(detected: DataFrame, chunks: DataFrame) -> DataFrame:
    """``detected`` with the filter that has rows: both lists, else the banks alone, else none (``level`` 2, 1, 0; a query
    that names nothing has level 0)."""
    have = chunks.select(F.upper(F.trim("ticker")).alias("ticker"), "fiscal_year").where("ticker is not null").distinct()
    named = detected.select("query_id", F.explode("tickers").alias("ticker"), "years").join(have, "ticker")
    joint = named.where("size(years) = 0 or array_contains(years, fiscal_year)").select("query_id").distinct().withColumn("joint", F.lit(True))
    only = named.select("query_id").distinct().withColumn("only", F.lit(True))
    free = detected.where("size(tickers) = 0").select("query_id", F.explode("years").alias("fiscal_year")).join(have.select("fiscal_year").distinct(), "fiscal_year").select("query_id").distinct().withColumn("joint", F.lit(True))
    out = detected.join(joint.unionByName(free), "query_id", "left").join(only, "query_id", "left")
    level = F.when(F.col("joint"), 2).when(F.col("only"), 1).otherwise(0)
    none_s, none_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    return out.withColumn("level", level).select("query_id", F.when(level >= 1, F.col("tickers")).otherwise(none_s).alias("tickers"), F.when(level == 2, F.col("years")).otherwise(none_i).alias("years"), "level")


def filter_members(filters: DataFrame, chunks: DataFrame) -> DataFrame:
    """(filter_id, chunk_id) of every row of ``filters`` (filter_id, tickers, years): equality joins on what is named."""
    c = chunks.select("chunk_id", F.upper(F.trim("ticker")).alias("ticker"), "fiscal_year").distinct()
    t, y = F.explode("tickers").alias("ticker"), F.explode("years").alias("fiscal_year")
    both = filters.where("size(tickers) > 0 and size(years) > 0").select("filter_id", t, "years").select("filter_id", "ticker", y).join(c, ["ticker", "fiscal_year"])
    banks = filters.where("size(tickers) > 0 and size(years) = 0").select("filter_id", t).join(c, "ticker")
    years = filters.where("size(tickers) = 0 and size(years) > 0").select("filter_id", y).join(c, "fiscal_year")
    every = filters.where("size(tickers) = 0 and size(years) = 0").select("filter_id").crossJoin(c)  # one filter at most is empty
    out = [x.select("filter_id", "chunk_id") for x in (both, banks, years, every)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# ---- BM25


def packed(texts: DataFrame, key: str = "chunk_id", text: str = "embed_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, dl, terms, tfs): the term counts of every row as two arrays; a text without tokens has the term ``_``.
    No row is moved."""
    words = let(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")), lambda w: F.when(F.size(w) == 0, F.array(F.lit("_"))).otherwise(w))
    rows = texts.select(key, *keep, words.alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            said = words.flatten().dictionary_encode()
            size = max(len(said.dictionary), 1)
            pairs, tf = np.unique(np.repeat(np.arange(len(length), dtype=np.int64), length) * size + said.indices.to_numpy(zero_copy_only=False), return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(len(length) + 1, dtype=np.int64) * size).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, said.dictionary.take(pa.array(pairs % size)))
            columns = [*batch.columns[:-1], pa.array(length.astype(np.int32)), terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "dl", "terms", "tfs"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.mapInArrow(run, f"{kinds}, dl int, terms array<string>, tfs array<int>")


def unpacked(index: DataFrame) -> DataFrame:
    """A row for each term of the texts of ``packed``, with term and tf."""
    rows = index.select(*[c for c in index.columns if c not in ("terms", "tfs")], F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    return rows.select("*", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf")).drop("x")


def postings(texts: DataFrame, key: str = "chunk_id", text: str = "embed_text") -> DataFrame:
    """(key, term, tf, dl, and ``grp`` if the texts have it): the term counts of every text, each key once (of repeated rows
    the least text)."""
    rest = [c for c in ("grp",) if c in texts.columns]
    rows = texts.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(text, *rest)).alias("r")).select(key, F.col("r")[text].alias(text), *[F.col("r")[c].alias(c) for c in rest])
    return unpacked(packed(rows, key, text, tuple(rest))).select(key, "term", "tf", "dl", *rest)


def term_counts(index: DataFrame, by: str) -> DataFrame:
    """(by, term, df): the texts of ``packed`` that hold a term."""
    return index.select(by, F.explode("terms").alias("term")).groupBy(by, "term").agg(F.count("*").alias("df"))


def text_sizes(index: DataFrame, by: str) -> DataFrame:
    """(by, n, words): texts of ``packed`` and their words."""
    return index.groupBy(by).agg(F.count("*").alias("n"), F.sum("dl").alias("words"))


def bm25(queries: DataFrame, index: DataFrame, k: int, members: DataFrame | None = None, key: str = "chunk_id", owner: DataFrame | str | None = None, groups: DataFrame | None = None, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best texts of each query under Okapi BM25, with ``owner`` (a table key, owner, or
    a column of the index) those of each query and owner, the statistics being those of all texts; then there is a column owner.

    ``queries`` has query_id and text; ``index`` are texts as ``packed``, or postings. With ``members`` (filter_id, key) or
    ``groups`` (filter_id, grp; the index has grp) the queries have filter_id too: then statistics are those of the filter's texts
    alone; with groups they are sums over groups, so the index is not copied for each filter. ``stats`` are known
    ``term_counts`` and ``text_sizes`` (by grp). Repeated query terms count again, ties keep the order of the key, and a text
    that holds no asked term has score zero. A term in more than half of the texts gets EPSILON times the mean idf.

    The index is read where it lies, once for each block of queries (see ``scoring``), and only the k best of each partition go on.
    """
    if "term" in index.columns:
        rest = [c for c in index.columns if c not in (key, "term", "tf", "dl")]
        index = index.groupBy(key, *rest).agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("x"))  # one text
        index = index.select(key, *rest, "dl", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs"))
    if isinstance(owner, DataFrame):
        index, owner = index.join(owner.select(key, "owner"), key), "owner"
    if members is not None:
        index, stats = index.drop("grp").join(members.select(F.col("filter_id").alias("grp"), key), key), None
        groups = queries.select("filter_id", F.col("filter_id").alias("grp")).distinct()
    free = groups is None
    if free:
        queries = queries.withColumn("filter_id", F.lit(0).cast("long"))
        index = index if stats else index.withColumn("grp", F.lit(0).cast("long"))
    df, sizes = stats or (term_counts(index, "grp"), text_sizes(index, "grp"))
    of = (lambda d: d.withColumn("filter_id", F.lit(0).cast("long"))) if free else (lambda d: d.join(groups, "grp"))
    df = of(df).groupBy("filter_id", "term").agg(F.sum("df").alias("df"))
    sizes = of(sizes).groupBy("filter_id").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sizes = written(sizes.select("filter_id", "n", (F.col("words") / F.col("n")).alias("avgdl")).where("n > 0"), "sizes")
    asked = queries.select("query_id", "filter_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "filter_id", "term").agg(F.count("*").alias("qf"))
    idf = df.join(sizes, "filter_id").withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = written(idf.select("filter_id", "term", "idf"), "idf")
    mean = idf.groupBy("filter_id").agg(F.avg("idf").alias("mean_idf"))
    terms = asked.join(idf, ["filter_id", "term"]).join(mean, "filter_id")
    weight = F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")) * F.col("qf")
    terms = written(terms.select("query_id", "filter_id", "term", weight.alias("weight")), "terms")
    queries = written(queries.select("query_id", "filter_id").distinct().join(sizes.select("filter_id", "avgdl"), "filter_id"), "queries")

    def scores(condition: Column) -> tuple[scoring.Words, list]:
        of = queries.where(condition).collect()
        admitted = None if free else groups.join(queries.where(condition).select("filter_id").distinct(), "filter_id", "left_semi").collect()
        return scoring.Words(of, terms.where(condition).collect(), admitted, k, K1, B), [r.query_id for r in of]

    texts = index.select(key, *([] if free else ["grp"]), *([owner] if owner else []), "dl", "terms", "tfs")
    found = scoring.best(texts, queries, scores, k, key, owner)
    by = ("query_id", *([owner] if owner else []))
    return written(top(found, k, F.desc("score"), F.col(key), by=by), "best")  # k rows a query, or a query and owner


# ---- vectors


def _hashed(texts: pd.Series, known: dict[str, tuple[int, int]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    import hashlib
    import re

    buckets, weights = [], []
    for t in texts:
        v = np.zeros(HASH_DIM)
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            if w not in known:
                h = int.from_bytes(hashlib.md5(w.encode()).digest(), "big")
                if len(known) > 500_000:
                    known.clear()
                known[w] = (h % HASH_DIM, 1 if h >> 64 & 1 else -1)
            b, s = known[w]
            v[b] += s
        at = np.flatnonzero(v)
        norm = np.sqrt((v[at] ** 2).sum())
        buckets.append(at.astype(np.int32))
        weights.append(v[at] / norm if norm else v[at])
    return buckets, weights


def hash_embed(texts: DataFrame, key: str = "chunk_id", text: str = "embed_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, buckets, weights): signed feature hashing of tokens into HASH_DIM buckets, of norm 1, sparse; a text
    without tokens, or whose tokens cancel, has none. One row per input row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int]] = {}
        for pdf in batches:
            buckets, weights = _hashed(pdf[text], known)
            yield pd.DataFrame({key: pdf[key], **{c: pdf[c] for c in keep}, "buckets": buckets, "weights": weights})

    rows = texts.select(key, *keep, text)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.mapInPandas(run, f"{kinds}, buckets array<int>, weights array<double>")


def cosine(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id", vector: str = "vector", group: str | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k nearest vectors of each query by exact cosine, within ``group`` if one is named, or
    within the groups (filter_id, grp) that the query's filter_id admits.

    Vectors are a column of arrays, or sparse as ``hash_embed`` gives them. They are read where they lie, once for each block
    of queries (see ``scoring``): one matrix product a block, of which only a partition's k best per query leave. Ties
    keep the order of the key; a null or empty array is in no result, a vector of zeros has cosine 0.
    """
    sparse = vector not in vectors.columns
    parts = ["buckets", "weights"] if sparse else [vector]
    there = F.lit(True) if sparse else F.col(vector).isNotNull() & (F.size(vector) > 0)
    named = "filter_id" if groups is not None else group
    queries = written(queries.where(F.col("query_id").isNotNull() & there).select("query_id", *([named] if named else []), *parts), "queries")
    texts = vectors.where(F.col(key).isNotNull() & there).select(key, *(["grp"] if groups is not None else [group] if group else []), *parts)

    def scores(condition: Column) -> tuple[scoring.Vectors | None, list]:
        of = queries.where(condition).collect()
        if not of:
            return None, []
        if sparse:
            m = np.zeros((len(of), HASH_DIM))
            for n, r in enumerate(of):
                m[n, r.buckets] = r.weights
        else:
            m = np.array([r[vector] for r in of], float)
        by = None
        if named:
            numbers: dict = {}
            for n, r in enumerate(of):
                numbers.setdefault(r[named], []).append(n)
            admits = None
            if groups is not None:
                admits = {}
                for r in groups.join(queries.where(condition).select("filter_id").distinct(), "filter_id", "left_semi").collect():
                    admits.setdefault(r.grp, []).append(r.filter_id)
            by = admits, {f: np.array(x) for f, x in numbers.items() if f is not None}
        return scoring.Vectors(m, by, k, None if sparse else vector, "grp" if groups is not None else group), [r.query_id for r in of]

    return top(scoring.best(texts, queries, scores, k, key), k, F.desc("score"), F.col(key))


# ---- fusion and reranking


def fused(dense: DataFrame, sparse: DataFrame, k: int, key: str = "chunk_id", constant: int = RRF) -> DataFrame:
    """(query_id, key, score, rank): reciprocal-rank fusion; ties keep the dense order, then the sparse one."""
    both = dense.select("query_id", key, F.col("rank").alias("dense_rank")).join(sparse.select("query_id", key, F.col("rank").alias("sparse_rank")), ["query_id", key], "full")
    part = lambda c: F.coalesce(1 / (constant + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9))
    return top(scored, k, F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.col(key)).select("query_id", key, "score", "rank")


def reranked(hits: DataFrame, queries: DataFrame, texts: DataFrame, k: int, key: str = "chunk_id", text: str = "embed_text") -> DataFrame:
    """The k best hits by a second score: the share of the query's distinct tokens that the text holds; ties keep the order
    of the first stage. Another scorer replaces the expression of ``score``; it sees the candidates only."""
    rows = hits.select("query_id", key, F.col("rank").alias("first_rank")).join(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked")), "query_id").join(texts.select(key, F.col(text).alias("body")), key)
    rows = rows.dropDuplicates(["query_id", key])
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("asked", F.coalesce(tokens(F.col("body")), F.array().cast("array<string>")))).cast("double"), F.size("asked").cast("double")), F.lit(0.0))
    return top(rows.withColumn("score", F.round(share, 6)), k, F.desc("score"), F.col("first_rank")).select("query_id", key, "score", "rank")


def balanced(queries: DataFrame, index: DataFrame, owner: DataFrame | str, k: int, key: str = "chunk_id", stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The k best texts of each owner (say, bank) for each query under BM25, so that a comparison sees every side: each owner
    is ranked among its own texts, however many of another's score higher. ``owner`` has key and owner, each key once, or is a column of the index."""
    return bm25(queries, index, k, key=key, owner=owner, stats=stats)


def substring_search(chunks: DataFrame, phrase: str, n: int, ticker: str | None = None, year: int | None = None) -> DataFrame:
    """The first n chunks, by chunk_id, whose text holds a phrase in any case."""
    found = chunks.where(F.lower("text").contains(phrase.lower()))
    found = found.where(matches([ticker.upper()] if ticker else [], [year] if year else []))
    return found.dropDuplicates(["chunk_id"]).orderBy("chunk_id").limit(n)


__all__ = [name for name in dir() if not name.startswith("_") and name != "written"]
