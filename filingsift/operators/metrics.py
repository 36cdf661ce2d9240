"""Evaluation of logged answers and of verdicts, as joins and grouped aggregations over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingsift.functions import answers as a
from filingsift.operators.quantities import FACTORS, unit_of

LABELS = a.VERDICTS
PAGE_TOLERANCE = 1
KEYS = ["hit1", "hit3", "hit5", "recall5", "mrr", "answer_correct", "citation_precision", "invalid_citations"]


def once(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the first by ``order`` (a partial aggregation, not a window)."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def expected_pages(rows: DataFrame, key: str) -> DataFrame:
    """(key, doc_id, page): the distinct pages that hold the truth."""
    return rows.select(key, F.explode("sources").alias("s")).select(key, F.col("s.doc_id").alias("doc_id"), F.explode("s.pages").alias("page")).distinct()


def page_hits(cited: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Rows of ``cited`` (key, doc_id, page) that are within a page of a true one. The truth is widened and joined by
    equality, which is a hash join where a condition on the distance would compare all pages of a document."""
    near = truth.select(key, "doc_id", F.explode(F.sequence(F.col("page") - PAGE_TOLERANCE, F.col("page") + PAGE_TOLERANCE)).alias("page")).distinct()
    return cited.join(near, [key, "doc_id", "page"], "left_semi")


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(key, hit1, hit3, hit5, recall5, mrr) of each key that has a truth; ``ranked`` is (key, doc_id, page, rank). Recall
    is the share of true pages that one of the first five hits is near; keys without hits have zeros."""
    found = page_hits(ranked, truth, key).groupBy(key).agg(F.min("rank").alias("first"))
    near = ranked.where("rank <= 5").select(key, "doc_id", F.explode(F.sequence(F.col("page") - PAGE_TOLERANCE, F.col("page") + PAGE_TOLERANCE)).alias("page")).distinct()
    covered = truth.join(near, [key, "doc_id", "page"], "left_semi").groupBy(key).agg(F.count("*").alias("covered"))
    out = truth.groupBy(key).agg(F.count("*").alias("pages")).join(found, key, "left").join(covered, key, "left")
    hit = lambda k: F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"hit{k}")
    return out.select(key, hit(1), hit(3), hit(5), F.round(F.coalesce("covered", F.lit(0)) / F.col("pages"), 6).alias("recall5"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def logged(query_log: DataFrame) -> DataFrame:
    """One row per log_id (first arrival) with the parsed output, kept citations, invalid ones and abstention."""
    rows = once(query_log, "log_id", "arrived_at", "ts").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<struct<chunk_id:string,score:double>>")))
    rows = rows.withColumn("parsed", a.parse_object(F.col("output.raw")))
    good, bad = a.citations(F.col("parsed"), "citations", F.size("retrieved"))
    return rows.withColumn("good", good).withColumn("invalid_citations", bad).withColumn("abstain", a.abstains(F.col("parsed"))).withColumn("answer", F.when(~F.col("abstain"), F.try_variant_get("parsed", "$.answer", "string"))).drop("parsed")


def pages_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, doc_id, page, rank) of ``retrieved``: chunk names say document and page."""
    hits = rows.select(key, F.posexplode("retrieved").alias("at", "h")).select(key, (F.col("at") + 1).alias("rank"), F.col("h.chunk_id").alias("chunk_id"))
    return hits.select(key, F.regexp_extract("chunk_id", r"^(.*):p\d+:c\d+$", 1).alias("doc_id"), F.regexp_extract("chunk_id", r":p(\d+):c\d+$", 1).try_cast("int").alias("page"), "rank")


def citation_precision(cited: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """(key, citation_precision): share of cited pages near a true one; null where nothing is cited or expected."""
    total = cited.groupBy(key).agg(F.count("*").alias("n")).join(truth.select(key).distinct(), key, "left_semi")
    return total.join(page_hits(cited, truth, key).groupBy(key).agg(F.count("*").alias("right")), key, "left").select(key, F.round(F.coalesce("right", F.lit(0)) / F.col("n"), 6).alias("citation_precision"))


def answer_correct(kind: Column, abstain: Column, answer: Column, expected: Column) -> Column:
    """1, 0 or null: unanswerable questions want abstention, others none; then the number, then the keywords decide."""
    unit = F.coalesce(unit_of(expected["unit"]), F.lit("usd"))
    factor = F.try_element_at(F.create_map(*[F.lit(x) for k, v in FACTORS.items() if k.startswith("usd") for x in (k, float(v))]), unit)
    value = F.when(unit == "fraction", expected["value"] * 100).when(unit == "bps", expected["value"] / 100).otherwise(expected["value"])
    out = F.when(kind == "unanswerable", abstain).when(abstain, False)
    out = out.when((kind == "numeric") & expected["value"].isNotNull(), a.numeric_match(answer, value, factor))
    return out.when(F.size(expected["keywords"]) > 0, a.keywords_match(answer, expected["keywords"])).cast("double")


def evaluated(query_log: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per logged question with every metric; the question is found by its text."""
    asked = once(questions, "question", "id").select("question", "id", "type", "expected", "sources")
    rows = logged(query_log).join(asked, F.col("input") == F.col("question"))
    truth = expected_pages(rows.where("type <> 'unanswerable'"), "log_id")
    ranked = pages_of(rows, "log_id")
    cited = rows.where("not abstain").select("log_id", F.explode("good").alias("rank")).join(ranked, ["log_id", "rank"]).select("log_id", "doc_id", "page")
    out = rows.select("log_id", "config", "mode", "type", "abstain", "invalid_citations", answer_correct(F.col("type"), F.col("abstain"), F.col("answer"), F.col("expected")).alias("answer_correct"))
    return out.join(retrieval_metrics(ranked, truth, "log_id"), "log_id", "left").join(citation_precision(cited, truth, "log_id"), "log_id", "left")


def rolled_up(rows: DataFrame, *by: str) -> DataFrame:
    """Means of the metrics (nulls are left out) by ``by`` and over all, which the group ``_overall`` stands for."""
    keyed = rows.select(*[F.coalesce(F.col(c), F.lit("none")).alias(c) for c in by], *KEYS)
    out = keyed.rollup(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(k), 6).alias(k) for k in KEYS])
    return out.select(*[F.coalesce(F.col(c), F.lit("_overall")).alias(c) for c in by], "n", *KEYS)


def pivoted(rows: DataFrame, row: str, column: str, values: list[str], metric: str) -> DataFrame:
    """A report table: mean of a metric by row and column, as text; a dash where there is none."""
    out = rows.groupBy(row).pivot(column, values).agg(F.avg(metric))
    return out.select(row, *[a.shown(F.col(v)).alias(v) for v in values])


def abstention(rows: DataFrame, *by: str) -> DataFrame:
    """Precision and recall of abstention and the rate of false abstention; null where undefined."""
    un, ab = F.col("type") == "unanswerable", F.col("abstain")
    n = lambda c: F.count_if(c)
    rate = lambda x, y: F.round(F.try_divide(x.cast("double"), y.cast("double")), 6)
    return rows.groupBy(*by).agg(rate(n(un & ab), n(ab)).alias("abstain_precision"), rate(n(un & ab), n(un)).alias("abstain_recall"), rate(n(~un & ab), n(~un)).alias("false_abstention"))


def confusion(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(gold, pred, n) for all pairs of labels, zeros included; rows have gold and pred. With ``groups`` (a row a group, whose
    columns rows have too) for each of them."""
    one = groups if groups is not None else rows.sparkSession.range(0, 1, 1, 1).select()
    by, label = one.columns, F.explode(F.array(*map(F.lit, LABELS)))
    every = one.select(*by, label.alias("gold")).select(*by, "gold", label.alias("pred"))  # nine rows (a group), no product of partitions
    return every.join(rows.groupBy(*by, "gold", "pred").agg(F.count("*").alias("n")), [*by, "gold", "pred"], "left").fillna(0, ["n"])


def class_scores(rows: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 of each label (0 where undefined), with accuracy and macro F1 of all three; of each of ``groups``
    as in ``confusion``."""
    c, by = confusion(rows, groups), groups.columns if groups is not None else []
    gold = c.groupBy(*by, "gold").agg(F.sum("n").alias("of_gold"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    pred = c.groupBy(*by, F.col("pred").alias("gold")).agg(F.sum("n").alias("of_pred"))
    rate = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0))
    s = gold.join(pred, [*by, "gold"]).withColumn("precision", rate("right", "of_pred")).withColumn("recall", rate("right", "of_gold"))
    s = s.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    total = s.groupBy(*by).agg(F.try_divide(F.sum("right").cast("double"), F.sum("of_gold").cast("double")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    return (s.join(total, by) if by else s.crossJoin(total)).select(*by, F.col("gold").alias("label"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "accuracy", "macro_f1")])


def accuracy_by(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(by), F.lit("none")).alias(by)).agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6).alias("accuracy"))


def kappa(rows: DataFrame, one: str, two: str) -> DataFrame:
    """(n, agreement, kappa) of two raters over the rows that both rated; kappa is 1 where chance agreement is certain."""
    both = rows.where(F.col(one).isNotNull() & F.col(two).isNotNull()).select(F.col(one).alias("x"), F.col(two).alias("y"))
    seen = both.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("po"))
    left, right = both.groupBy("x").agg(F.count("*").alias("nx")), both.groupBy(F.col("y").alias("x")).agg(F.count("*").alias("ny"))
    chance = left.join(right, "x").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("both"))
    pe = F.try_divide(F.col("both").cast("double"), F.col("n").cast("double") * F.col("n"))
    k = F.when(pe == 1, 1.0).otherwise(F.try_divide(F.col("po") - pe, 1 - pe))
    return seen.crossJoin(chance).select("n", F.round("po", 6).alias("agreement"), F.round(k, 6).alias("kappa"))


def judge_agreement(labels: DataFrame) -> DataFrame:
    """(name, n, agreement, kappa) of a judge and hand labels: correctness (a judge's figure above zero is right) and
    faithfulness (only the full figure is faithful), each over the rows that both rated."""
    said = labels.select("human_correct", (F.col("judge_correct") != 0).alias("judge_right"), "human_faithful", (F.col("judge_faithfulness") == 1).alias("judge_faithful"))
    pairs = {"correctness": ("human_correct", "judge_right"), "faithfulness": ("human_faithful", "judge_faithful")}
    out = [kappa(said, *pair).select(F.lit(name).alias("name"), "n", "agreement", "kappa") for name, pair in pairs.items()]
    return out[0].unionByName(out[1])
