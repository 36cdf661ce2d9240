"""Prompts from hits and a deterministic offline completer, as expressions on one row per query.

A real model replaces ``offline_answer`` and ``offline_verdict``: it takes the prompt column and gives a JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingsift.functions import answers as a

# What the two kinds of call ask for.
ASK = "Answer from the numbered excerpts only, with units and year, and cite their numbers. If they do not hold the answer, abstain."
VERIFY = "Check the claim against the numbered excerpts only. Say SUPPORTED, REFUTED or NOT_ENOUGH_INFO and cite their numbers."


def with_excerpts(queries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``queries`` (query_id, text) with ``excerpts``: the numbered excerpts of their hits, in rank order; queries without
    hits have an empty array. A query's hits are as many as were asked for, so the collected list is bounded."""
    body = chunks.select("chunk_id", "bank", "fiscal_year", "section", "page_label", F.col("text").alias("body")).dropDuplicates(["chunk_id"])
    rows = hits.select("query_id", "chunk_id", "rank").join(body, "chunk_id")
    text = a.excerpt(F.col("rank"), F.col("bank"), F.col("fiscal_year"), F.col("section"), F.col("page_label"), F.col("body"))
    rows = rows.select("query_id", F.struct("rank", text.alias("text")).alias("x")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]).alias("excerpts"))
    return queries.join(rows, "query_id", "left").withColumn("excerpts", F.coalesce("excerpts", F.array().cast("array<string>")))


def prompt(kind: str, excerpts: Column, text: Column) -> Column:
    return F.concat(F.lit("EXCERPTS:\n"), F.array_join(excerpts, "\n\n"), F.lit(f"\n\n{kind}: "), F.coalesce(text, F.lit("")))


def prompt_hash(system: str, user: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(system), F.char(F.lit(0)), user), 256), 1, 16)


def offline_answer(question: Column, excerpts: Column) -> tuple[Column, Column]:
    """(answer, abstain): abstains without excerpts, on a year from 2026 and on what will be; else the first line of the
    first excerpt's text, up to 200 characters."""
    years = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"\b(20\d\d)\b"), F.lit(1))
    abstain = (F.size(excerpts) == 0) | F.exists(years, lambda y: y.cast("int") >= 2026) | F.coalesce(F.lower(question).rlike(r"\bwill\b"), F.lit(False))
    body = F.regexp_replace(F.regexp_replace(F.get(excerpts, F.lit(0)), r"^[^\n]*\n", ""), r"^\s+", "")
    first = F.substring(F.split(body, "\n")[0], 1, 200)
    return F.when(~abstain, F.nullif(first, F.lit(""))), abstain


def offline_verdict(claim: Column, excerpts: Column) -> tuple[Column, Column]:
    """(verdict, evidence): SUPPORTED by the first excerpt that holds all numbers of the claim, else NOT_ENOUGH_INFO."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(r"(\d[\d,.]*)"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]+$", ""))
    holds = F.transform(excerpts, lambda e: (F.size(numbers) > 0) & F.forall(numbers, lambda x: F.contains(e, x)))
    at = F.array_position(holds, F.lit(True)).cast("int")
    return F.when(at > 0, "SUPPORTED").otherwise("NOT_ENOUGH_INFO"), at
