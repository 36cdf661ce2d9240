"""Evaluation queries over the whole query log, questions and claims."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingsift.config import Config, Retrieval
from filingsift.functions import answers as a
from filingsift.functions.shared import shared_dir, written
from filingsift.operators import index, pipeline, prompting, retrieval, store
from filingsift.operators import metrics as m
from filingsift.plans import retrieval as rsql
from filingsift.plans.retrieval import TOP_K, _index, asked, every
from filingsift.sources.tables import table


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return m.evaluated(table(spark, folder, "query_log"), table(spark, folder, "questions"))


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).where("hit1 is not null").select("log_id", "hit1", "hit3", "hit5", "recall5", "mrr")


def citation_precision(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).where("citation_precision is not null").select("log_id", "citation_precision")


def citation_validate(spark: SparkSession, folder: str) -> DataFrame:
    rows = m.logged(table(spark, folder, "query_log"))
    return rows.select("log_id", F.array_join(F.col("good").cast("array<string>"), ",").alias("good"), F.col("invalid_citations").alias("bad"), "abstain", "answer")


def answer_correct(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).select("log_id", "type", "answer_correct")


def numbers_in_questions(spark: SparkSession, folder: str) -> DataFrame:
    q = m.once(table(spark, folder, "questions"), "id", "question").where("expected.answer is not null")
    return q.select(F.col("id"), F.posexplode(a.parse_numbers(F.col("expected.answer"))).alias("at", "n")).select("id", "at", "n.value", "n.suffix", "n.decimals")


def keywords_match(spark: SparkSession, folder: str) -> DataFrame:
    q = m.once(table(spark, folder, "questions"), "id", "question")
    return q.select("id", a.keywords_match(F.col("question"), F.col("expected.keywords")).alias("in_question"), a.keywords_match(F.concat_ws(" ", F.col("expected.answer"), F.array_join("expected.keywords", " ")), F.col("expected.keywords")).alias("in_answer"))


def abstention(spark: SparkSession, folder: str) -> DataFrame:
    return m.abstention(_log(spark, folder), "config")


def metrics_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return m.rolled_up(_log(spark, folder), "config", "type").select("config", "type", "n", "hit1", "hit3", "hit5", "recall5", "mrr", "answer_correct", "citation_precision", "invalid_citations")


def metrics_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return m.pivoted(_log(spark, folder), "config", "type", ["comparison", "factual", "numeric"], "mrr")


def main_table(spark: SparkSession, folder: str) -> DataFrame:
    """The main report of the log: figures by configuration, as text. What the log does not hold, verdicts, latency and
    cost, is in ``evaluation_run``."""
    rows = _log(spark, folder).join(judged_answers(spark, folder), "log_id", "left")
    means = rows.groupBy("config").agg(*[F.avg(k).alias(k) for k in (*m.KEYS, "faithfulness")]).join(m.abstention(rows, "config"), "config")
    names = ["hit5", "recall5", "mrr", "answer_correct", "faithfulness", "citation_precision", "abstain_precision", "abstain_recall", "false_abstention"]
    return means.select("config", *[a.shown(F.col(k)).alias(k) for k in names])


def _claimed(log: DataFrame, chunks: DataFrame) -> DataFrame:
    """(log_id, number, supported): each number of a logged answer is a claim, supported if a cited chunk holds it."""
    rows = log.where("answer is not null")
    numbers = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"(\d[\d,.]*\d|\d)"), F.lit(1)))
    cited = rows.select("log_id", F.explode("good").alias("at"), "retrieved").select("log_id", F.get("retrieved", (F.col("at") - 1).cast("int"))["chunk_id"].alias("chunk_id"))
    said = rows.select("log_id", F.explode(numbers).alias("number"))
    texts = cited.join(chunks.where("text is not null").select("chunk_id", "text"), "chunk_id").select("log_id", "text").distinct()
    held = said.join(texts, "log_id", "left")
    return held.groupBy("log_id", "number").agg(F.coalesce(F.bool_or(F.contains("text", "number")), F.lit(False)).alias("supported"))


def _judged(log: DataFrame, chunks: DataFrame) -> DataFrame:
    claims = F.to_json(F.struct(F.collect_list(F.struct(F.col("number").alias("claim"), "supported")).alias("claims")))  # the numbers of one answer
    judged = _claimed(log, chunks).groupBy("log_id").agg(claims.alias("judged"))
    return judged.select("log_id", F.round(a.faithfulness(F.try_parse_json("judged")), 6).alias("faithfulness"))


def judged_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Faithfulness of every logged answer as an offline judge sees it: each number of the answer is a claim, supported if a
    cited chunk holds it, and unsupported where none is cited or known. An answer without numbers claims nothing: no row."""
    return _judged(m.logged(table(spark, folder, "query_log")), table(spark, folder, "chunks"))


def judged_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The claims behind ``judged_answers``, one row each."""
    return _claimed(m.logged(table(spark, folder, "query_log")), table(spark, folder, "chunks"))


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every claim with its label and the verdict that the pages of its sources give."""
    claims = m.once(table(spark, folder, "claims"), "id", "claim")
    near = m.expected_pages(claims, "id").select("id", "doc_id", F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page_index")).distinct()
    said = table(spark, folder, "chunks").where("text is not null").select("doc_id", "page_index", "text").distinct()
    numbers = claims.select("id", F.transform(F.regexp_extract_all("claim", F.lit(r"(\d[\d,.]*)"), F.lit(1)), lambda x: F.regexp_replace(x, "[.,]+$", "")).alias("numbers"))
    held = near.join(said, ["doc_id", "page_index"]).join(numbers, "id").where("size(numbers) > 0").where(F.forall("numbers", lambda x: F.contains(F.col("text"), x))).select("id").distinct().withColumn("held", F.lit(True))
    return claims.join(held, "id", "left").select("id", a.verdict(F.col("label")).alias("gold"), F.when(F.col("held"), "SUPPORTED").otherwise("NOT_ENOUGH_INFO").alias("pred"), "perturbation")


def claim_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).select("id", "gold", "pred")


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return m.confusion(_verdicts(spark, folder))


def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    return m.class_scores(_verdicts(spark, folder))


def accuracy_by_perturbation(spark: SparkSession, folder: str) -> DataFrame:
    return m.accuracy_by(_verdicts(spark, folder), "perturbation")


def verdict_kappa(spark: SparkSession, folder: str) -> DataFrame:
    return m.kappa(_verdicts(spark, folder), "gold", "pred")


def _hits(spark: SparkSession, folder: str, queries: DataFrame) -> DataFrame:
    found = _index(spark, folder)
    return retrieval.bm25(queries, found.packed, TOP_K, stats=found.stats)


def claim_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the claims whose number is divisible by 50, each searched among all chunks."""
    claims = m.once(table(spark, folder, "claims"), "id", "claim").where("try_cast(substr(id, 2) as int) % 50 = 0")
    hits = _hits(spark, folder, claims.select(F.col("id").alias("query_id"), F.col("claim").alias("text")))
    ranked = hits.select("query_id", F.regexp_extract("chunk_id", r"^(.*):p\d+:c\d+$", 1).alias("doc_id"), F.regexp_extract("chunk_id", r":p(\d+):c\d+$", 1).cast("int").alias("page"), "rank")
    return m.retrieval_metrics(ranked, m.expected_pages(claims, "id").withColumnRenamed("id", "query_id"), "query_id")


# The configurations of the evaluation run, from plain to all there is.
CONFIGS = [
    Config("01_words", retrieval=Retrieval(mode="bm25", metadata_filter=False)),
    Config("02_second_look", retrieval=Retrieval(mode="hybrid", rerank=True)),
]
#: What ``ask`` and ``verify`` run under.
SHOWN = Config("words_filtered", retrieval=Retrieval(mode="bm25"))


def _every_claim(spark: SparkSession, folder: str) -> DataFrame:
    return m.once(table(spark, folder, "claims"), "id", "claim").select(F.col("id").alias("query_id"), F.col("claim").alias("text"))


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    return _every_claim(spark, folder).where("try_cast(substr(query_id, 2) as int) % 50 = 0")


def _together(spark: SparkSession, folder: str) -> index.Index:
    """The index for searches of all questions or claims, most of which a filter bounds."""
    return index.opened(spark, table(spark, folder, "chunks"), together=True)


def _alias(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.aliases(table(spark, folder, "filings"))


def ask(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of the query set through the pipeline: filter, words, prompt, answer, citations."""
    rows, _ = pipeline.ask(asked(spark, folder), _index(spark, folder), _alias(spark, folder), SHOWN)
    return rows.select("query_id", "answer", "abstain", F.array_join("citations.chunk_id", ",").alias("cited"), F.array_join("retrieved.chunk_id", ",").alias("retrieved"), "invalid_citations", "prompt_hash", "usd")


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """The claims of the query set through the pipeline."""
    rows, _ = pipeline.verify(_claims(spark, folder), _index(spark, folder), _alias(spark, folder), SHOWN)
    return rows.select("query_id", "verdict", "explanation", F.array_join("evidence.chunk_id", ",").alias("evidence"), F.array_join("retrieved.chunk_id", ",").alias("retrieved"), "prompt_hash", "usd")


def prompt_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The identity of every prompt of the query set, and what of it the cache of an earlier run answers."""
    found, alias, queries = _index(spark, folder), _alias(spark, folder), asked(spark, folder)
    _, cache = pipeline.ask(queries.where("pmod(xxhash64(query_id), 2) = 0"), found, alias, SHOWN)
    rows, _ = pipeline.ask(queries, found, alias, SHOWN, cache)
    return rows.select("query_id", "prompt_hash", "cached")


def pipeline_log(spark: SparkSession, folder: str) -> DataFrame:
    """The answers appended to a query log and read back from it."""
    rows, _ = pipeline.ask(asked(spark, folder), _index(spark, folder), _alias(spark, folder), SHOWN)
    log = pipeline.log_rows(rows)
    path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    store.append_log(log, path)
    return store.json_lines(spark, path, log.schema).select("config", "mode", "input", F.size("retrieved").alias("hits"), "output.invalid_citations")


def _runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(one row per question with all its metrics, one row per claim with gold and pred) of every configuration, whose questions
    and claims are searched together; the figures of all are made at once. The log's input is the id: texts of questions repeat."""
    found, alias = _together(spark, folder), _alias(spark, folder)
    log, usd, verdicts = [], [], []
    for config in CONFIGS:
        began = time.perf_counter()
        answers, said, _ = pipeline.both(every(spark, folder), _every_claim(spark, folder), found, alias, config)
        took = (time.perf_counter() - began) * 1000
        log.append(pipeline.log_rows(answers.withColumn("text", F.col("query_id"))).withColumn("latency_ms", F.lit(took) / (answers.count() + said.count())))
        usd.append(answers.select("config", F.col("query_id").alias("input"), "usd"))
        verdicts.append(said)
    log, usd, verdicts = (reduce(DataFrame.unionByName, x) for x in (log, usd, verdicts))
    log = written(log, "log")
    judged = _judged(m.logged(log), found.of(log.select(F.explode("retrieved.chunk_id").alias("chunk_id")), "text"))
    paid = log.join(usd.distinct(), ["config", "input"]).groupBy("log_id").agg(F.max("usd").alias("usd"))
    rows = m.evaluated(log, table(spark, folder, "questions").withColumn("question", F.col("id"))).join(judged, "log_id", "left").join(paid, "log_id", "left")
    rows = rows.join(log.groupBy("config").agg(F.max("latency_ms").alias("latency_ms")), "config")
    return written(rows, "run"), written(_labelled(spark, folder, verdicts), "verdicts")


def _labelled(spark: SparkSession, folder: str, verdicts: DataFrame) -> DataFrame:
    claims = m.once(table(spark, folder, "claims"), "id", "claim").select(F.col("id").alias("query_id"), a.verdict(F.col("label")).alias("gold"), "perturbation")
    return verdicts.select("config", "query_id", F.col("verdict").alias("pred"), "usd").join(claims, "query_id")


def _verdicts_of(spark: SparkSession, folder: str, config: Config) -> DataFrame:
    """One row per claim with gold and pred under one configuration."""
    verdicts, _ = pipeline.verify(_every_claim(spark, folder), _together(spark, folder), _alias(spark, folder), config)
    return written(_labelled(spark, folder, verdicts), "verdicts")


def evaluation_run(spark: SparkSession, folder: str) -> DataFrame:
    """The main report of a run of every configuration over all questions and claims, all its figures as text; latency is the run's
    wall time by question or claim, so it differs from run to run."""
    rows, claims = _runs(spark, folder)
    means = rows.groupBy("config").agg(*[F.avg(k).alias(k) for k in (*m.KEYS, "faithfulness", "latency_ms")], F.sum("usd").alias("usd"))
    scores = m.class_scores(claims, spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(c.name) for c in CONFIGS])).alias("config"))).select("config", "accuracy", "macro_f1").distinct()
    means = means.join(m.abstention(rows, "config"), "config").join(scores, "config", "left")
    names = ["hit5", "recall5", "mrr", "answer_correct", "faithfulness", "citation_precision", "abstain_precision", "abstain_recall", "false_abstention", "accuracy", "macro_f1"]
    return means.select("config", *[a.shown(F.col(k)).alias(k) for k in names], a.shown(F.col("latency_ms"), 0).alias("latency_ms"), a.shown(F.coalesce("usd", F.lit(0.0))).alias("usd"))


def verdicts_by_perturbation(spark: SparkSession, folder: str) -> DataFrame:
    """A report table: accuracy of the verdicts on all claims of each configuration of the run, by perturbation, as text."""
    rows = [_verdicts_of(spark, folder, c) for c in CONFIGS]
    both = rows[0].unionByName(rows[1]).withColumn("perturbation", F.coalesce("perturbation", F.lit("none"))).withColumn("right", (F.col("gold") == F.col("pred")).cast("double"))
    return m.pivoted(both, "config", "perturbation", ["bank", "none", "number", "unverifiable", "year"], "right")


def judge_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A reproducible sample of 25 answered, answerable log rows for hand labels."""
    rows = m.logged(table(spark, folder, "query_log")).where("answer is not null")
    kinds = m.once(table(spark, folder, "questions"), "question", "id").select("question", "type").where("type <> 'unanswerable'")
    return rows.join(kinds, F.col("input") == F.col("question")).select("log_id", "question", "answer").orderBy(F.xxhash64(F.lit(0), "log_id"), "log_id").limit(25)


QUERIES = {f.__name__: f for f in (retrieval_metrics, citation_precision, citation_validate, answer_correct, numbers_in_questions, keywords_match, abstention, metrics_rollup, metrics_pivot, main_table, judged_answers, claim_verdicts, confusion, class_scores, accuracy_by_perturbation, verdict_kappa, claim_retrieval, ask, verify, prompt_hashes, pipeline_log, evaluation_run, verdicts_by_perturbation, judged_claims, judge_sample)}

_LOG = r"""
l0 AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY arrived_at, ts) AS n FROM query_log WHERE log_id IS NOT NULL),
l1 AS (SELECT log_id, config, mode, input, coalesce(retrieved, []) AS retrieved, TRY_CAST(output.raw AS JSON) AS j1, TRY_CAST(regexp_extract(output.raw, '(?s)\{.*\}') AS JSON) AS j2 FROM l0 WHERE n = 1),
l2 AS (SELECT *, CASE WHEN json_type(coalesce(j1, j2)) = 'OBJECT' THEN coalesce(j1, j2) END AS j FROM l1),
l3 AS (SELECT *, json_extract(j, '$.citations[*]') AS cs, coalesce(json_extract_string(j, '$.answer'), '') = '' OR coalesce(json_extract_string(j, '$.abstain') = 'true', false) AS abstain FROM l2),
ci AS (SELECT log_id, pos, json_type(c) IN ('UBIGINT', 'BIGINT') AND TRY_CAST(c AS BIGINT) BETWEEN 1 AND len(retrieved) AS ok, TRY_CAST(c AS BIGINT) AS c FROM (SELECT log_id, retrieved, unnest(cs) AS c, generate_subscripts(cs, 1) AS pos FROM l3)),
go AS (SELECT log_id, list(c ORDER BY pos) AS good FROM (SELECT log_id, c, min(pos) AS pos FROM ci WHERE ok GROUP BY log_id, c) GROUP BY log_id),
ba AS (SELECT log_id, count(*) AS bad FROM ci WHERE NOT coalesce(ok, false) GROUP BY log_id),
l AS (SELECT l3.*, coalesce(good, []) AS good, coalesce(bad, 0)::INT AS invalid_citations, CASE WHEN NOT abstain THEN json_extract_string(j, '$.answer') END AS answer FROM l3 LEFT JOIN go USING (log_id) LEFT JOIN ba USING (log_id)),
qs AS (SELECT question, arg_min(type, id) AS type, arg_min(sources, id) AS sources, arg_min(expected, id) AS expected FROM questions GROUP BY question),
lq AS (SELECT l.*, type, sources, expected FROM l JOIN qs ON l.input = qs.question),
tr AS (SELECT DISTINCT log_id, doc_id, unnest(pages) AS page FROM (SELECT log_id, s.doc_id AS doc_id, s.pages AS pages FROM (SELECT log_id, unnest(sources) AS s FROM lq WHERE type <> 'unanswerable'))),
rk AS (SELECT log_id, rank, regexp_extract(c, '^(.*):p\d+:c\d+$', 1) AS doc_id, TRY_CAST(regexp_extract(c, ':p(\d+):c\d+$', 1) AS INT) AS page FROM (SELECT log_id, h.chunk_id AS c, rank FROM (SELECT log_id, unnest(retrieved) AS h, generate_subscripts(retrieved, 1) AS rank FROM lq))),
fi AS (SELECT rk.log_id, min(rank) AS first FROM rk JOIN tr ON rk.log_id = tr.log_id AND rk.doc_id = tr.doc_id AND abs(rk.page - tr.page) <= 1 GROUP BY rk.log_id),
co AS (SELECT log_id, count(*) AS covered FROM tr WHERE EXISTS (SELECT 1 FROM rk WHERE rank <= 5 AND rk.log_id = tr.log_id AND rk.doc_id = tr.doc_id AND abs(rk.page - tr.page) <= 1) GROUP BY log_id),
rm AS (SELECT log_id, coalesce((first <= 1)::INT::DOUBLE, 0) AS hit1, coalesce((first <= 3)::INT::DOUBLE, 0) AS hit3, coalesce((first <= 5)::INT::DOUBLE, 0) AS hit5, round(coalesce(covered, 0) / pages, 6) AS recall5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM (SELECT log_id, count(*)::DOUBLE AS pages FROM tr GROUP BY log_id) LEFT JOIN fi USING (log_id) LEFT JOIN co USING (log_id)),
cp0 AS (SELECT g.log_id, EXISTS (SELECT 1 FROM tr WHERE tr.log_id = g.log_id AND tr.doc_id = rk.doc_id AND abs(rk.page - tr.page) <= 1) AS hit FROM (SELECT log_id, unnest(good) AS rank FROM lq WHERE NOT abstain) g JOIN rk ON rk.log_id = g.log_id AND rk.rank = g.rank WHERE g.log_id IN (SELECT log_id FROM tr)),
cp AS (SELECT log_id, round(avg(hit::INT), 6) AS citation_precision FROM cp0 GROUP BY log_id),
ev AS (SELECT lq.log_id, config, mode, type, abstain, invalid_citations, hit1, hit3, hit5, recall5, mrr, citation_precision FROM lq LEFT JOIN rm USING (log_id) LEFT JOIN cp USING (log_id)),
hn AS (SELECT log_id, number, coalesce(bool_or(contains(text, number)), false) AS supported FROM (SELECT log_id, unnest(list_distinct(regexp_extract_all(answer, '\d[\d,.]*\d|\d'))) AS number FROM l WHERE answer IS NOT NULL) n
  LEFT JOIN (SELECT g.log_id, text FROM (SELECT log_id, retrieved[c].chunk_id AS chunk_id FROM (SELECT log_id, retrieved, unnest(good) AS c FROM l WHERE answer IS NOT NULL)) g JOIN chunks USING (chunk_id) WHERE text IS NOT NULL) t USING (log_id) GROUP BY log_id, number),
fa AS (SELECT log_id, round(avg(supported::INT), 6) AS faithfulness FROM hn GROUP BY log_id)"""


def _numbers(text: str) -> str:
    """The numbers of a text as a list of structs (v, s, d): value, suffix and decimals. RE2 has no look-around, so every
    separator is doubled and each number takes the ones beside it."""
    doubled = f"' ' || regexp_replace({text}, '([^A-Za-z0-9_.,])', '\\1\\1', 'g') || ' '"
    pattern = "(?i)[^A-Za-z0-9_.](\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)\\s*(trillion|billion|million|thousand|bn|mm|%|percent|b|m|k)?(?:[^A-Za-z0-9]|$)".replace("\\\\", "\\")
    raw, suffix = (f"regexp_extract_all({doubled}, '{pattern}', {k})" for k in (1, 2))
    one = "lambda r, i: {'v': replace(r, ',', '')::DOUBLE, 's': CASE WHEN lower(sx[i]) = 'percent' THEN '%' ELSE coalesce(lower(sx[i]), '') END, 'd': length(regexp_extract(r, '\\.(\\d+)$', 1))}".replace("\\\\", "\\")
    return f"list_transform({raw}, {one.replace('sx[i]', f'({suffix})[i]')})"


_SCALES = "MAP {" + ", ".join(f"'{k}': {v!r}::DOUBLE" for k, v in a.SCALES.items()) + "}"
_UNIT = """CASE WHEN contains(u, '%') OR regexp_matches(u, '(^|[^a-z])(percent|pct)($|[^a-z])') THEN 'percent' WHEN regexp_matches(u, '(^|[^a-z])(bps?|basis[ _]?points?)($|[^a-z])') THEN 'bps' WHEN regexp_matches(u, '(^|[^a-z])fractions?($|[^a-z])') THEN 'fraction'
WHEN regexp_matches(u, '(^|[^a-z])(billions?|bn|b)($|[^a-z])') THEN 'b' WHEN regexp_matches(u, '(^|[^a-z])(millions?|mm|mn|m)($|[^a-z])') THEN 'm' WHEN regexp_matches(u, '(^|[^a-z])(thousands?|k)($|[^a-z])|(^|[^0-9])000s') THEN 'k' ELSE 'usd' END"""
# Correctness of every logged answer: the number in its unit, or the keywords.
_CORRECT = f"""aq AS (SELECT log_id, type, abstain, answer, expected.value AS value, expected.keywords AS kw, {_UNIT} AS unit, list_distinct(regexp_extract_all(lower(answer), 'trillion|billion|million|thousand')) AS said FROM (SELECT *, lower(coalesce(expected.unit, '')) AS u FROM lq)),
ar AS (SELECT *, CASE unit WHEN 'fraction' THEN value * 100 WHEN 'bps' THEN value / 100 ELSE value END AS want, CASE unit WHEN 'usd' THEN 1 WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 END::DOUBLE AS factor, CASE WHEN len(said) = 1 THEN {_SCALES}[said[1]] END AS ambient, {_numbers('answer')} AS ns FROM aq),
an AS (SELECT log_id, want, factor, n.v AS v, n.s AS s, power(10.0::DOUBLE, -n.d) AS step, unnest(CASE WHEN factor IS NULL THEN [1.0::DOUBLE] WHEN coalesce({_SCALES}[n.s], ambient) IS NOT NULL THEN [coalesce({_SCALES}[n.s], ambient)] ELSE [1.0::DOUBLE, 1e3::DOUBLE, 1e6::DOUBLE, 1e9::DOUBLE] END) AS x FROM (SELECT *, unnest(ns) AS n FROM ar)),
am AS (SELECT DISTINCT log_id FROM an WHERE (s = '%') = (factor IS NULL) AND (abs(v * x - want * coalesce(factor, 1)) <= 0.01::DOUBLE * abs(want * coalesce(factor, 1)) OR abs(v * x - want * coalesce(factor, 1)) <= 0.5::DOUBLE * step * x + 1e-9::DOUBLE * abs(want * coalesce(factor, 1)))),
ac AS (SELECT log_id, type, CASE WHEN type = 'unanswerable' THEN abstain WHEN abstain THEN false WHEN type = 'numeric' AND value IS NOT NULL THEN coalesce(answer, '') <> '' AND log_id IN (SELECT log_id FROM am) WHEN len(kw) > 0 THEN coalesce(answer <> '' AND len(list_filter(kw, lambda k: NOT contains(lower(answer), lower(k)))) = 0, false) END::INT::DOUBLE AS answer_correct FROM ar)"""
# The hits of the pipeline, from the filtered words.
_PIPE = """{queries}, {detect}, {resolve}, {index},
rf AS (SELECT *, dense_rank() OVER (ORDER BY array_to_string(tickers, ',') || '/' || array_to_string(years, ',')) AS filter_id FROM res),
qf AS (SELECT q.query_id, text, filter_id FROM q JOIN rf USING (query_id)),
cm AS (SELECT DISTINCT chunk_id, upper(trim(ticker)) AS ticker, fiscal_year FROM chunks WHERE chunk_id IS NOT NULL),
mem AS (SELECT DISTINCT filter_id, chunk_id FROM (SELECT DISTINCT filter_id, tickers, years FROM rf) f JOIN cm ON (len(tickers) = 0 OR list_contains(tickers, cm.ticker)) AND (len(years) = 0 OR list_contains(years, cm.fiscal_year))),
i AS (SELECT i0.*, filter_id FROM i0 JOIN mem USING (chunk_id)), {bm25},
cu AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id),
ex AS (SELECT h.query_id, h.chunk_id, h.rank, cu.text AS body, '[' || h.rank || '] ' || coalesce(bank, '') || ' | FY' || coalesce(fiscal_year::VARCHAR, '') || ' | ' || coalesce(nullif(section, ''), 'n/a') || ' | p. ' || coalesce(page_label, '') || chr(10) || coalesce(cu.text, '') AS e FROM hits h JOIN cu USING (chunk_id)),
pr AS (SELECT q.query_id, q.text, string_agg(e, chr(10) || chr(10) ORDER BY rank) AS excerpts, coalesce(string_agg(chunk_id, ',' ORDER BY rank), '') AS retrieved, count(e) AS n FROM q LEFT JOIN ex USING (query_id) GROUP BY q.query_id, q.text),
ph AS (SELECT *, substr(sha256('{system}' || chr(0) || 'EXCERPTS:' || chr(10) || coalesce(excerpts, '') || chr(10) || chr(10) || '{kind}: ' || coalesce(text, '')), 1, 16) AS prompt_hash FROM pr)"""
_CLAIMED = "q AS (SELECT id AS query_id, min(claim) AS text FROM claims WHERE try_cast(substr(id, 2) AS INT) % 50 = 0 GROUP BY id)"


def _piped(kind: str, queries: str, system: str) -> str:
    return _PIPE.format(queries=queries, detect=rsql._DETECT, resolve=rsql._RESOLVE, index=rsql._INDEX, bm25=rsql._BM25.format(k=TOP_K), kind=kind, system=system.replace("'", "''"))


_CLAIMS = r"""
cl AS (SELECT id, arg_min(claim, claim) AS claim, arg_min(label, claim) AS label, arg_min(perturbation, claim) AS p0, arg_min(sources, claim) AS sources FROM claims GROUP BY id),
pe AS (SELECT DISTINCT ON (id) id, perturbation FROM claims ORDER BY id, claim),
nu AS (SELECT id, list_transform(regexp_extract_all(claim, '\d[\d,.]*'), lambda x: rtrim(x, '.,')) AS numbers FROM cl),
pg AS (SELECT DISTINCT id, doc_id, page FROM (SELECT id, s.doc_id AS doc_id, unnest(s.pages) AS page FROM (SELECT id, unnest(sources) AS s FROM cl))),
he AS (SELECT DISTINCT pg.id FROM pg JOIN chunks c ON c.doc_id = pg.doc_id AND abs(c.page_index - pg.page) <= 1 JOIN nu ON nu.id = pg.id WHERE len(numbers) > 0 AND c.text IS NOT NULL AND len(list_filter(numbers, lambda x: NOT contains(c.text, x))) = 0),
vd AS (SELECT cl.id, CASE WHEN upper(label) IN ('SUPPORTED', 'REFUTED', 'NOT_ENOUGH_INFO') THEN upper(label) ELSE 'NOT_ENOUGH_INFO' END AS gold, CASE WHEN cl.id IN (SELECT id FROM he) THEN 'SUPPORTED' ELSE 'NOT_ENOUGH_INFO' END AS pred, pe.perturbation FROM cl JOIN pe USING (id)),
lb AS (SELECT unnest(['SUPPORTED', 'REFUTED', 'NOT_ENOUGH_INFO']) AS label),
cf AS (SELECT a.label AS gold, b.label AS pred, (SELECT count(*) FROM vd WHERE vd.gold = a.label AND vd.pred = b.label) AS n FROM lb a CROSS JOIN lb b)"""
_AVG = ", ".join(f"round(avg({k}), 6) AS {k}" for k in ("hit1", "hit3", "hit5", "recall5", "mrr", "answer_correct", "citation_precision", "invalid_citations"))
SQL = {
    "retrieval_metrics": f"WITH {_LOG} SELECT log_id, hit1, hit3, hit5, recall5, mrr FROM ev WHERE hit1 IS NOT NULL",
    "citation_precision": f"WITH {_LOG} SELECT log_id, citation_precision FROM cp",
    "citation_validate": f"WITH {_LOG} SELECT log_id, array_to_string(good, ',') AS good, invalid_citations AS bad, abstain, answer FROM l",
    "keywords_match": "SELECT id, coalesce(len(k) > 0 AND q <> '' AND len(list_filter(k, lambda x: NOT contains(lower(q), lower(x)))) = 0, false) AS in_question, coalesce(len(k) > 0, false) AS in_answer FROM (SELECT id, arg_min(question, question) AS q, arg_min(expected, question).keywords AS k FROM questions GROUP BY id)",
    "abstention": f"WITH {_LOG} SELECT config, round(count_if(type = 'unanswerable' AND abstain) / nullif(count_if(abstain), 0)::DOUBLE, 6) AS abstain_precision, round(count_if(type = 'unanswerable' AND abstain) / nullif(count_if(type = 'unanswerable'), 0)::DOUBLE, 6) AS abstain_recall, round(count_if(type <> 'unanswerable' AND abstain) / nullif(count_if(type <> 'unanswerable'), 0)::DOUBLE, 6) AS false_abstention FROM ev GROUP BY config",
    "metrics_rollup": f"WITH {_LOG}, {_CORRECT} SELECT coalesce(config, '_overall') AS config, coalesce(type, '_overall') AS type, count(*) AS n, {_AVG} FROM (SELECT * REPLACE (coalesce(config, 'none') AS config, coalesce(ev.type, 'none') AS type) FROM (SELECT ev.*, ac.answer_correct FROM ev JOIN ac USING (log_id)) ev) GROUP BY ROLLUP (config, type)",
    "metrics_pivot": f"WITH {_LOG} SELECT config, " + ", ".join(f"coalesce(printf('%.3f', avg(mrr) FILTER (type = '{t}')), '–') AS {t}" for t in ("comparison", "factual", "numeric")) + " FROM ev GROUP BY config",
    "main_table": f"WITH {_LOG}, {_CORRECT} SELECT config, " + ", ".join(f"coalesce(printf('%.3f', avg({k})), '–') AS {k}" for k in ("hit5", "recall5", "mrr", "answer_correct", "faithfulness", "citation_precision")) + ", coalesce(printf('%.3f', round(count_if(type = 'unanswerable' AND abstain) / nullif(count_if(abstain), 0)::DOUBLE, 6)), '–') AS abstain_precision, coalesce(printf('%.3f', round(count_if(type = 'unanswerable' AND abstain) / nullif(count_if(type = 'unanswerable'), 0)::DOUBLE, 6)), '–') AS abstain_recall, coalesce(printf('%.3f', round(count_if(type <> 'unanswerable' AND abstain) / nullif(count_if(type <> 'unanswerable'), 0)::DOUBLE, 6)), '–') AS false_abstention FROM (SELECT ev.*, ac.answer_correct, faithfulness FROM ev JOIN ac USING (log_id) LEFT JOIN fa USING (log_id)) GROUP BY config",
    "answer_correct": f"WITH {_LOG}, {_CORRECT} SELECT log_id, type, answer_correct FROM ac",
    "numbers_in_questions": f"""WITH q AS (SELECT id, arg_min(expected, question).answer AS t FROM questions WHERE id IS NOT NULL GROUP BY id), n AS (SELECT id, {_numbers('t')} AS ns FROM q WHERE t IS NOT NULL)
SELECT id, (pos - 1)::INT AS "at", n.v AS value, n.s AS suffix, n.d::INT AS decimals FROM (SELECT id, unnest(ns) AS n, generate_subscripts(ns, 1) AS pos FROM n)""",
    "judged_claims": f"WITH {_LOG} SELECT log_id, number, supported FROM hn",
    "ask": f"""WITH {_piped('QUESTION', rsql._ASKED, prompting.ASK)}, an0 AS (SELECT ph.*, n = 0 OR len(list_filter(regexp_extract_all(coalesce(ph.text, ''), '\\b(20\\d\\d)\\b', 1), lambda y: y::INT >= 2026)) > 0 OR coalesce(regexp_matches(lower(ph.text), '\\bwill\\b'), false) AS ab, nullif(substr(split_part(regexp_replace(coalesce(ex.body, ''), '^[\\s\\x{{000b}}]+', ''), chr(10), 1), 1, 200), '') AS first, ex.chunk_id AS best FROM ph LEFT JOIN ex ON ex.query_id = ph.query_id AND ex.rank = 1)
SELECT query_id, CASE WHEN NOT ab THEN first END AS answer, ab OR first IS NULL AS abstain, CASE WHEN NOT ab AND first IS NOT NULL THEN best ELSE '' END AS cited, retrieved, 0 AS invalid_citations, prompt_hash, 0.0::DOUBLE AS usd FROM an0""",
    "pipeline_log": f"WITH {_piped('QUESTION', rsql._ASKED, prompting.ASK)} SELECT '{SHOWN.name}' AS config, 'ask' AS mode, text AS input, n::INT AS hits, 0 AS invalid_citations FROM ph",
    "verify": f"""WITH {_piped('CLAIM', _CLAIMED, prompting.VERIFY)}, nu AS (SELECT query_id, list_transform(regexp_extract_all(coalesce(text, ''), '\\d[\\d,.]*'), lambda x: rtrim(x, '.,')) AS numbers FROM q),
ho AS (SELECT query_id, min(rank) AS holder FROM ex JOIN nu USING (query_id) WHERE len(numbers) > 0 AND len(list_filter(numbers, lambda x: NOT contains(e, x))) = 0 GROUP BY query_id)
SELECT ph.query_id, CASE WHEN holder IS NULL THEN 'NOT_ENOUGH_INFO' ELSE 'SUPPORTED' END AS verdict, CASE WHEN holder IS NULL THEN 'not found' ELSE 'numbers found' END AS explanation, coalesce(ex.chunk_id, '') AS evidence, retrieved, prompt_hash, 0.0::DOUBLE AS usd FROM ph LEFT JOIN ho USING (query_id) LEFT JOIN ex ON ex.query_id = ph.query_id AND ex.rank = ho.holder""",
    "claim_retrieval": f"""WITH {_CLAIMED}, qf AS (SELECT *, 0 AS filter_id FROM q), {rsql._INDEX}, i AS (SELECT *, 0 AS filter_id FROM i0), {rsql._BM25.format(k=TOP_K)},
tr AS (SELECT DISTINCT query_id, doc_id, unnest(pages) AS page FROM (SELECT id AS query_id, s.doc_id AS doc_id, s.pages AS pages FROM (SELECT id, unnest(arg_min(sources, claim)) AS s FROM claims WHERE id IN (SELECT query_id FROM q) GROUP BY id))),
rk AS (SELECT query_id, rank, regexp_extract(chunk_id, '^(.*):p\\d+:c\\d+$', 1) AS doc_id, regexp_extract(chunk_id, ':p(\\d+):c\\d+$', 1)::INT AS page FROM hits),
fi AS (SELECT rk.query_id, min(rank) AS first FROM rk JOIN tr ON rk.query_id = tr.query_id AND rk.doc_id = tr.doc_id AND abs(rk.page - tr.page) <= 1 GROUP BY rk.query_id),
co AS (SELECT query_id, count(*) AS covered FROM tr WHERE EXISTS (SELECT 1 FROM rk WHERE rank <= 5 AND rk.query_id = tr.query_id AND rk.doc_id = tr.doc_id AND abs(rk.page - tr.page) <= 1) GROUP BY query_id)
SELECT query_id, coalesce((first <= 1)::INT::DOUBLE, 0) AS hit1, coalesce((first <= 3)::INT::DOUBLE, 0) AS hit3, coalesce((first <= 5)::INT::DOUBLE, 0) AS hit5, round(coalesce(covered, 0) / pages, 6) AS recall5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM (SELECT query_id, count(*)::DOUBLE AS pages FROM tr GROUP BY query_id) LEFT JOIN fi USING (query_id) LEFT JOIN co USING (query_id)""",
    "judged_answers": rf"""WITH {_LOG}, ct AS (SELECT l.log_id, list_distinct(regexp_extract_all(answer, '\d[\d,.]*\d|\d')) AS ns, retrieved[g].chunk_id AS chunk_id FROM (SELECT log_id, answer, retrieved, unnest(good) AS g FROM l WHERE answer IS NOT NULL) l),
tx AS (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id),
hn AS (SELECT log_id, n, bool_or(contains(text, n)) AS ok FROM (SELECT log_id, text, unnest(ns) AS n FROM ct JOIN tx USING (chunk_id)) GROUP BY log_id, n)
SELECT log_id, round(avg(ok::INT), 6) AS faithfulness FROM hn GROUP BY log_id""",
    "claim_verdicts": f"WITH {_CLAIMS} SELECT id, gold, pred FROM vd",
    "confusion": f"WITH {_CLAIMS} SELECT gold, pred, n FROM cf",
    "class_scores": f"""WITH {_CLAIMS}, s0 AS (SELECT label, (SELECT sum(n) FROM cf WHERE gold = label AND pred = label)::DOUBLE AS r, (SELECT sum(n) FROM cf WHERE gold = label)::DOUBLE AS g, (SELECT sum(n) FROM cf WHERE pred = label)::DOUBLE AS p FROM lb),
s1 AS (SELECT *, coalesce(r / nullif(p, 0), 0) AS pr, coalesce(r / nullif(g, 0), 0) AS re FROM s0), s2 AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f FROM s1)
SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, round((SELECT sum(r) / sum(g) FROM s2), 6) AS accuracy, round((SELECT avg(f) FROM s2), 6) AS macro_f1 FROM s2""",
    "accuracy_by_perturbation": f"WITH {_CLAIMS} SELECT coalesce(perturbation, 'none') AS perturbation, count(*) AS n, round(avg((gold = pred)::INT), 6) AS accuracy FROM vd GROUP BY 1",
    "verdict_kappa": f"""WITH {_CLAIMS}, k AS (SELECT sum(n)::DOUBLE AS n, sum(n) FILTER (gold = pred) / sum(n)::DOUBLE AS po, (SELECT sum(a.n * b.n) FROM (SELECT gold AS x, sum(n) AS n FROM cf GROUP BY gold) a JOIN (SELECT pred AS x, sum(n) AS n FROM cf GROUP BY pred) b USING (x))::DOUBLE / (sum(n) * sum(n))::DOUBLE AS pe FROM cf)
SELECT n::BIGINT AS n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM k""",
}
