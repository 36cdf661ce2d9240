"""The pipeline over a small collection of two banks and two years, as the evaluation uses it."""

import pytest
from pyspark.sql import functions as F

from filingsift.config import Completion, Config, Retrieval
from filingsift.operators import index, pipeline, retrieval, store
from filingsift.plans import evaluation

CHUNK = "chunk_id string, doc_id string, bank string, ticker string, fiscal_year int, page_index int, page_label string, section string, kind string, text string, embed_text string"
FACTS = {("Alder Bank", "ALD", 2024): ("15.7%", "54,000"), ("Alder Bank", "ALD", 2025): ("15.1%", "58,000"), ("Brack Bank", "BRK", 2024): ("11.0%", "19,100"), ("Brack Bank", "BRK", 2025): ("11.1%", "19,000")}


@pytest.fixture(scope="module")
def collection(spark, tmp_path_factory):
    rows = []
    for (bank, ticker, year), (ratio, income) in FACTS.items():
        doc = f"{ticker.lower()}_fy{year}"
        texts = [f"The capital ratio of {bank} was {ratio} at year end.", f"Net income of {bank} was {income} million.", "Nothing else is said here."]
        rows += [(f"{doc}:p{k + 1}:c0", doc, bank, ticker, year, k + 1, str(k + 40), "Capital" if k < 2 else None, "text", t, f"[{bank} | FY{year}]\n{t}") for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("chunks") / "chunks.parquet")
    spark.createDataFrame([*rows, rows[0], (None, *rows[0][1:])], CHUNK).write.parquet(path)
    alias = spark.createDataFrame([("alder bank", "ALD"), ("alder", "ALD"), ("brack", "BRK")], "alias string, ticker string")
    return index.opened(spark, spark.read.parquet(path), Config()), alias


def questions(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, text string")


@pytest.mark.parametrize("mode", ["dense", "bm25", "hybrid"])
@pytest.mark.parametrize("rerank", [False, True])
def test_filter_mode_and_reranking(spark, collection, mode, rerank):
    found, alias = collection
    config = Config(retrieval=Retrieval(mode=mode, rerank=rerank, top_k=2, candidates=5))
    q = questions(spark, "What was the capital ratio of Alder in 2024?", "Net income of Brack in 1999 or 2031?", "capital ratio")
    hits = pipeline.retrieved(q, found, alias, config).join(found.chunks, "chunk_id").collect()
    assert {(r.ticker, r.fiscal_year) for r in hits if r.query_id == "q0"} == {("ALD", 2024)} and {r.ticker for r in hits if r.query_id == "q1"} == {"BRK"}
    assert all(sorted(r["rank"] for r in hits if r.query_id == i) == [1, 2] for i in ("q0", "q1", "q2"))
    assert next(r.chunk_id for r in hits if r.query_id == "q0" and r["rank"] == 1) == "ald_fy2024:p1:c0"
    free = pipeline.retrieved(q, found, alias, Config(retrieval=Retrieval(mode=mode, metadata_filter=False, top_k=12))).where("query_id = 'q1'")
    assert free.join(found.chunks, "chunk_id").select("ticker").distinct().count() == 2


def test_answers_cite_what_they_found(spark, collection):
    found, alias = collection
    config = Config("c", retrieval=Retrieval(mode="bm25", top_k=2))
    rows, cache = pipeline.ask(questions(spark, "What was the capital ratio of Alder in 2024?", "What will it be?", "What was the capital ratio of Alder in 2024?"), found, alias, config)
    got = {r.query_id: r for r in rows.collect()}
    assert got["q0"].answer.startswith("The capital ratio of Alder Bank was 15.7%") and not got["q0"].abstain
    c = got["q0"].citations[0]
    assert (c.n, c.chunk_id, c.doc_id, c.page_index, c.page_label, c.section) == (1, "ald_fy2024:p1:c0", "ald_fy2024", 1, "40", "Capital") and c.snippet == got["q0"].answer
    assert got["q1"].abstain and got["q1"].answer is None and got["q1"].citations == [] and len(got["q0"].retrieved) == 2
    assert got["q0"].prompt_hash == got["q2"].prompt_hash and [got[k].cached for k in ("q0", "q2")] == [False, True] and cache.count() == 2
    again, grown = pipeline.ask(questions(spark, "What was the capital ratio of Alder in 2024?"), found, alias, config, cache)
    assert again.first().cached and grown.count() == 2
    log = pipeline.log_rows(rows)
    assert {r.mode for r in log.collect()} == {"ask"} and log.select("output.raw").where("raw like '%15.7%%'").count() == 2


def test_verdicts(spark, collection):
    found, alias = collection
    rows, _ = pipeline.verify(questions(spark, "Brack's net income in 2025 was 19,000 million.", "Brack's net income in 2025 was 77 million."), found, alias, Config(retrieval=Retrieval(mode="bm25")))
    got = {r.query_id: r for r in rows.collect()}
    assert got["q0"].verdict == "SUPPORTED" and got["q0"].evidence[0].chunk_id == "brk_fy2025:p2:c0" and got["q0"].explanation == "numbers found"
    assert got["q1"].verdict == "NOT_ENOUGH_INFO" and got["q1"].evidence == []


def test_invalid_citations_and_paid_calls(spark, collection):
    found, alias = collection
    config = Config(retrieval=Retrieval(mode="bm25", top_k=4, metadata_filter=False), completion=Completion(provider="paid", model="m"))
    fixed = pipeline.remote(lambda system, user: ('{"answer": "x", "citations": [1, 9, 0, "2", 1, true]}', 1000, 500))
    r = pipeline.ask(questions(spark, "capital ratio"), found, alias, config, complete=fixed)[0].first()
    assert [c.n for c in r.citations] == [1] and r.invalid_citations == 4 and r.usd == pytest.approx((1000 * 0.4 + 500 * 1.6) / 1e6)
    r = pipeline.ask(questions(spark, "capital ratio"), found, alias, config, complete=pipeline.remote(lambda s, u: ("no json", 1, 1)))[0].first()
    assert r.abstain and r.citations == [] and r.answer is None


def test_calls_are_tried_again():
    import pandas as pd

    tried, slept = [], []

    def call(system, user):
        tried.append(user)
        if len(tried) < 3:
            raise OSError("busy")
        return "{}", 1, 1

    class Frame:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return list(run(iter([pd.DataFrame({"key": ["k"], "system": ["s"], "user": ["u"]})])))

    assert pipeline.remote(call, slept.append)(Frame())[0].to_dict("list") == {"key": ["k"], "raw": ["{}"], "tokens_in": [1], "tokens_out": [1]} and slept == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        pipeline.remote(lambda s, u: 1 / 0, slept.append)(Frame())


def test_index_is_built_once(spark, collection, tmp_path):
    found, _ = collection
    assert found.chunks.count() == 12 and found.sizes.agg(F.sum("n")).first()[0] == 12 and found.groups.count() == 4
    df = spark.createDataFrame([("a:p1:c0", "a", "A", " ald", 2024, 1, None, None, None, None, None)], CHUNK)
    df.write.parquet(f"{tmp_path}/c.parquet")
    one = index.opened(spark, spark.read.parquet(f"{tmp_path}/c.parquet"))
    two = index.opened(spark, spark.read.parquet(f"{tmp_path}/c.parquet"), Config(retrieval=Retrieval(mode="dense")))
    assert one.postings.inputFiles() == two.postings.inputFiles() and one.postings.first().term == "_" and one.groups.first().ticker == "ALD"
    df.write.mode("append").parquet(f"{tmp_path}/c.parquet")
    assert index.opened(spark, spark.read.parquet(f"{tmp_path}/c.parquet")).postings.inputFiles() != one.postings.inputFiles()
    q = spark.createDataFrame([("q", "anything")], "query_id string, text string")
    assert retrieval.bm25(q, one.postings, 3, stats=one.stats).count() == 1
    built = []
    store.built(spark, f"{tmp_path}/t", lambda: built.append(1) or spark.range(2).toDF("i"))
    assert store.built(spark, f"{tmp_path}/t", lambda: built.append(1) or spark.range(2).toDF("i")).count() == 2 and built == [1]


def test_both_kinds_share_one_search(spark, collection, monkeypatch):  # F3
    found, alias = collection
    q = questions(spark, "What was the capital ratio of Alder in 2024?", "What will it be?")
    claims = questions(spark, "Brack's net income in 2025 was 19,000 million.", "Brack's net income in 2025 was 77 million.", "What will it be?")
    config = Config("c", retrieval=Retrieval(mode="hybrid", rerank=True, top_k=2, candidates=5))
    want = [pipeline.ask(q, found, alias, config)[0].orderBy("query_id").collect(), pipeline.verify(claims, found, alias, config)[0].orderBy("query_id").collect()]
    calls, bm25 = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda *args, **more: calls.append(1) or bm25(*args, **more))
    answers, verdicts, cache = pipeline.both(q, claims, found, alias, config)
    assert [answers.orderBy("query_id").collect(), verdicts.orderBy("query_id").collect()] == want
    assert calls == [1] and cache.count() == 5  # ids that questions and claims share are told apart


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables whose ids are not divisible by 50; two questions of one text want different numbers."""
    at = str(tmp_path_factory.mktemp("run"))
    rows = []
    for (bank, ticker, year), (ratio, income) in FACTS.items():
        doc = f"{ticker.lower()}_fy{year}"
        texts = [f"The capital ratio of {bank} was {ratio} at year end.", f"Net income of {bank} was ${income} million."]
        rows += [(f"{doc}:p{k + 1}:c0", doc, bank, ticker, year, k + 1, str(k), None, "text", t, f"[{bank} | FY{year}]\n{t}") for k, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[0]], CHUNK).write.parquet(f"{at}/chunks.parquet")
    spark.createDataFrame([("Alder Bank", "ALD"), ("Brack Bank", "BRK")], "bank string, ticker string").write.parquet(f"{at}/filings.parquet")
    sources, net = [("ald_fy2024", [2])], "What was the net income of Alder Bank in 2024?"
    asked = [("q0000001", "numeric", net, (None, 54000.0, "usd millions", []), sources), ("q0000002", "numeric", net, (None, 7.0, "usd millions", []), sources), ("q0000050", "unanswerable", "What will the ratio of Brack Bank be?", None, []), ("q0000003", "factual", "What was the capital ratio of Brack Bank in 2025?", (None, None, None, ["capital"]), [("brk_fy2025", [1])])]
    spark.createDataFrame([*asked, asked[0]], "id string, type string, question string, expected struct<answer:string,value:double,unit:string,keywords:array<string>>, sources array<struct<doc_id:string,pages:array<int>>>").write.parquet(f"{at}/questions.parquet")
    claims = [("c0000001", "Brack Bank's net income in 2025 was 19,000 million.", "supported", None, []), ("c0000002", "Brack Bank's net income in 2025 was 77 million.", "REFUTED", "number", []), ("c0000100", "Alder Bank's capital ratio in 2024 was 15.7%.", "SUPPORTED", None, []), ("other", "Alder Bank's capital ratio in 2025 was 15.1%.", "SUPPORTED", "year", [])]
    spark.createDataFrame([*claims, claims[0]], "id string, claim string, label string, perturbation string, sources array<struct<doc_id:string,pages:array<int>>>").write.parquet(f"{at}/claims.parquet")
    return at


def test_evaluation_run_takes_every_question_and_claim(spark, folder):  # F2 of round 3
    rows, claims = evaluation._runs(spark, folder)
    names = {c.name for c in evaluation.CONFIGS}
    got = rows.where("config = '02_second_look'").collect()
    assert rows.count() == 8 and {r.config for r in rows.collect()} == names and sorted((r.type, r.answer_correct) for r in got) == [("factual", 1.0), ("numeric", 0.0), ("numeric", 1.0), ("unanswerable", 1.0)]
    assert {(r.config, r.query_id) for r in claims.collect()} == {(n, c) for n in names for c in ("c0000001", "c0000002", "c0000100", "other")}


def test_verdicts_by_perturbation_take_every_claim(spark, folder):  # F3 of round 3
    got = evaluation._verdicts_of(spark, folder, evaluation.CONFIGS[0])
    assert {(r.query_id, r.gold, r.perturbation) for r in got.collect()} == {("c0000001", "SUPPORTED", None), ("c0000002", "REFUTED", "number"), ("c0000100", "SUPPORTED", None), ("other", "SUPPORTED", "year")}
    table = {r.config: r.asDict() for r in evaluation.verdicts_by_perturbation(spark, folder).collect()}
    assert set(table) == {c.name for c in evaluation.CONFIGS} and table["01_words"] == {"config": "01_words", "bank": "–", "none": "1.000", "number": "0.000", "unverifiable": "–", "year": "1.000"}


def test_an_index_laid_together_is_the_same(spark, folder):  # F2 of round 3
    chunks = spark.read.parquet(f"{folder}/chunks.parquet")
    lies, laid = index.opened(spark, chunks), index.opened(spark, chunks, together=True)
    assert lies.at != laid.at
    for name in ("postings", "vectors", "groups", "counts", "sizes"):
        assert sorted(map(str, getattr(lies, name).collect())) == sorted(map(str, getattr(laid, name).collect())), name
