import datetime
import json

import pytest
from pyspark.sql import functions as F

from filingsift.operators import metrics as m


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, "jpm", 45, 1), (1, "c", 99, 2), (1, "c", 47, 3)], "q int, doc_id string, page int, rank int")
    truth = spark.createDataFrame([(1, "c", 45), (1, "c", 46), (2, "c", 1)], "q int, doc_id string, page int")
    got = {r.q: r for r in m.retrieval_metrics(ranked, truth, "q").collect()}
    assert (got[1].hit1, got[1].hit3, got[1].recall5) == (0, 1, 0.5) and got[1].mrr == pytest.approx(1 / 3, abs=1e-6)
    assert (got[2].hit5, got[2].mrr) == (0, 0)  # a truth without hits is zero, a key without truth is absent
    cited = spark.createDataFrame([(1, "c", 45), (1, "c", 10)], "q int, doc_id string, page int")
    assert [tuple(r) for r in m.citation_precision(cited, truth, "q").collect()] == [(1, 0.5)]


def test_abstention(spark):
    rows = spark.createDataFrame([("unanswerable", True), ("unanswerable", False), ("numeric", True), ("numeric", False)], "type string, abstain boolean")
    assert tuple(m.abstention(rows).first()) == (0.5, 0.5, 0.5)
    assert tuple(m.abstention(rows.where("false")).first()) == (None, None, None)


def test_verdict_scores(spark):
    s, r, n = m.LABELS
    rows = spark.createDataFrame([(s, s), (r, r), (n, r), (r, n)], "gold string, pred string")
    assert {(x.gold, x.pred): x.n for x in m.confusion(rows).collect()}[r, n] == 1 and m.confusion(rows).count() == 9
    scores = {x.label: x for x in m.class_scores(rows).collect()}
    assert scores[s].accuracy == 0.5 and scores[s].f1 == 1 and scores[n].f1 == 0 and scores[r].f1 == 0.5


@pytest.mark.parametrize(("x", "y", "want"), [("1100", "1100", 1.0), ("1100", "1010", 0.0), ("11", "11", 1.0)])
def test_kappa(spark, x, y, want):
    rows = spark.createDataFrame(list(zip(x, y)), "x string, y string")
    assert m.kappa(rows, "x", "y").first().kappa == want


def test_kappa_of_labels(spark):
    rows = [(1, 1, True, True)] * 19 + [(0, 1, False, False)] * 3 + [(1, 1, False, False), (1, 1, True, False), (0, 1, True, True), (None, 1, True, None)]
    df = spark.createDataFrame(rows, "jc int, jf int, hc boolean, hf boolean").select((F.col("jc") == 1).alias("jc"), (F.col("jf") == 1).alias("jf"), "hc", "hf")
    one, two = m.kappa(df, "hc", "jc").first(), m.kappa(df, "hf", "jf").first()
    assert (one.n, one.agreement, round(one.kappa, 4)) == (25, 0.92, 0.7024) and (two.agreement, two.kappa) == (0.8, 0.0)
    assert m.kappa(df.where("false"), "hc", "jc").first().kappa is None


def test_judged_answers_keep_uncited_ones(spark, tmp_path):
    from filingsift.plans import evaluation

    raw = lambda answer, cited: json.dumps({"answer": answer, "citations": cited, "abstain": False})
    said = [(1, raw("15 and 20", [1])), (2, raw("15", [])), (3, raw("15", [2])), (4, raw("15", [3])), (5, raw("15", [9])), (6, raw("none", [1])), (7, raw("20 of 15", [2, 1]))]
    hits = [("a:p1:c0", 1.0), ("missing:p1:c0", 0.5), ("null:p1:c0", 0.2)]
    at = datetime.datetime(2025, 1, 1)
    log = [(i, at, at, hits, (text, 0)) for i, text in said] + [(8, at, at, None, (raw("15", [1]), 0))]
    spark.createDataFrame(log, "log_id long, ts timestamp, arrived_at timestamp, retrieved array<struct<chunk_id:string,score:double>>, output struct<raw:string,invalid_citations:int>").write.parquet(f"{tmp_path}/query_log.parquet")
    spark.createDataFrame([("a:p1:c0", "it was 15"), ("null:p1:c0", None)], "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.log_id: r.faithfulness for r in evaluation.judged_answers(spark, str(tmp_path)).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 7: 0.5, 8: 0.0}


def test_judge_agreement_over_complete_pairs(spark):
    rows = [(1.0, 1.0, True, True)] * 19 + [(0.0, 1.0, False, False)] * 3 + [(1.0, 1.0, False, False), (1.0, 1.0, True, False), (0.0, 1.0, True, True), (None, 0.5, True, None), (1.0, 0.5, None, False)]
    got = {r["name"]: r for r in m.judge_agreement(spark.createDataFrame(rows, "judge_correct double, judge_faithfulness double, human_correct boolean, human_faithful boolean")).collect()}
    assert (got["correctness"].n, got["correctness"].agreement, round(got["correctness"].kappa, 4)) == (25, 0.92, 0.7024)
    assert (got["faithfulness"].n, got["faithfulness"].agreement) == (26, round(21 / 26, 6)) and got["faithfulness"].kappa > 0


def test_class_scores_by_group_without_products_of_partitions(spark):  # F3
    rows = spark.createDataFrame([("a", "SUPPORTED", "SUPPORTED"), ("a", "REFUTED", "SUPPORTED"), ("b", "REFUTED", "REFUTED")], "config string, gold string, pred string")
    groups = spark.createDataFrame([("a",), ("b",), ("none",)], "config string")
    together = m.class_scores(rows, groups).orderBy("config", "label").collect()
    alone = [(c, *r) for c in ("a", "b", "none") for r in m.class_scores(rows.where(f"config = '{c}'")).orderBy("label").collect()]
    assert list(map(tuple, together)) == alone and len(alone) == 9
    plan = spark._jvm.PythonSQLUtils.explainString(m.confusion(rows)._jdf.queryExecution(), "simple")
    assert "Cartesian" not in plan and "NestedLoop" not in plan
