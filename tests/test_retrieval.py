import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from filingsift.operators import retrieval as r
from filingsift.plans import retrieval as plans


def brute_bm25(texts, query, k):
    docs = {i: re.findall("[a-z0-9]+", (t or "").lower()) or ["_"] for i, t in texts}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in idf.items()}
    score = {i: round(sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in re.findall("[a-z0-9]+", query.lower())), 6) for i, d in docs.items()}
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


TEXTS = [("a", "net income rose to 15"), ("b", "net loss"), ("c", None), ("d", ""), ("e", "income income of the bank, income"), ("f", "the bank"), ("f", "the bank"), ("g", "the the net")]


def test_bm25_is_brute_force(spark):
    df = spark.createDataFrame(TEXTS, "chunk_id string, embed_text string")
    for query in ("income of the bank", "loss", "nothing at all", "bank bank net"):
        got = r.bm25(spark.createDataFrame([("q", query)], "query_id string, text string"), r.postings(df), 4).orderBy("rank").collect()
        assert [(x.chunk_id, x.score) for x in got] == brute_bm25(dict(TEXTS).items(), query, 4), query


def test_bm25_of_empty_tables(spark):
    df = spark.createDataFrame(TEXTS, "chunk_id string, embed_text string")
    q = spark.createDataFrame([("q", "bank")], "query_id string, text string")
    assert r.bm25(q, r.postings(df.where("false")), 3).count() == 0
    assert r.bm25(q.where("false"), r.postings(df), 3).count() == 0


def test_balanced_sees_every_owner(spark):
    texts = [(f"big{i:02}", "capital ratio ratio") for i in range(40)] + [("small0", "the ratio of one small bank among many others"), ("small1", "none"), ("tiny0", "other words")]
    index = r.postings(spark.createDataFrame(texts, "chunk_id string, embed_text string"))
    owner = spark.createDataFrame([(i, re.sub("[0-9]", "", i)) for i, _ in texts], "chunk_id string, owner string")
    q = spark.createDataFrame([("q", "capital ratio of one bank"), ("z", "unheard")], "query_id string, text string")
    got = {(x.query_id, x.owner, x["rank"]): (x.chunk_id, x.score) for x in r.balanced(q, index, owner, 2).collect()}
    for query, text in (("q", "capital ratio of one bank"), ("z", "unheard")):
        want = {}
        for i, score in brute_bm25(dict(texts).items(), text, len(texts)):
            want.setdefault(re.sub("[0-9]", "", i), []).append((i, score))
        assert {k[1:]: v for k, v in got.items() if k[0] == query} == {(o, n + 1): x for o, xs in want.items() for n, x in enumerate(xs[:2])}


def test_balanced_query_reaches_below_the_candidates(spark, tmp_path):
    rows = [(f"AA_1:p1:c{i:02}", "AA_1", "Alder capital ratio ratio") for i in range(40)] + [("BB_1:p1:c0", "BB_1", "Brack: one mention of the ratio among many other words")]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, embed_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("q50", "capital ratio")], "id string, question string").write.parquet(f"{tmp_path}/questions.parquet")
    assert {x.owner for x in plans.balanced_topk(spark, str(tmp_path)).collect()} == {"AA", "BB"}


def test_balanced_query_asks_every_question(spark, tmp_path):  # F1 of round 3
    rows = [(f"{o}_{n}:p1:c{i}", f"{o}_{n}", f"{o} capital ratio {i}") for o in ("AA", "BB", "CC") for n in (1, 2) for i in range(3)] + [("x", None, "capital")]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, embed_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(f"q{n}", f"capital {n}") for n in range(49, 53)] + [("no number", "ratio"), ("q51", "capital 51")], "id string, question string").write.parquet(f"{tmp_path}/questions.parquet")
    got = Counter((x.query_id, x.owner) for x in plans.balanced_topk(spark, str(tmp_path)).collect())
    assert got == {(q, o): 1 if o is None else 2 for q in ("q49", "q50", "q51", "q52", "no number") for o in ("AA", "BB", "CC", None)}
    assert "% 50" not in plans.SQL["balanced_topk"]


def test_filters(spark):
    alias = spark.createDataFrame([("wells fargo", "WFC"), ("wells", "WFC"), ("citi", "C")], "alias string, ticker string")
    q = spark.createDataFrame([("1", "Wells Fargo in 2024 and 2023?"), ("2", "cities in 1999"), ("3", None), ("4", "CITI, 2031")], "query_id string, text string")
    found = r.detect_filter(q, alias)
    got = {x.query_id: (x.tickers, x.years) for x in found.collect()}
    assert got == {"1": (["WFC"], [2023, 2024]), "2": ([], []), "3": ([], []), "4": (["C"], [2031])}
    chunks = spark.createDataFrame([("x", "wfc ", 2024), ("y", "C", 2020), ("z", None, None)], "chunk_id string, ticker string, fiscal_year int")
    got = {x.query_id: (x.tickers, x.years, x.level) for x in r.resolve_filter(found, chunks).collect()}
    assert got["1"] == (["WFC"], [2023, 2024], 2) and got["4"] == (["C"], [], 1) and got["2"][2] == 0
    f = r.resolve_filter(found, chunks).select(F.col("query_id").alias("filter_id"), "tickers", "years")
    assert {(x.filter_id, x.chunk_id) for x in r.filter_members(f.where("filter_id in ('1', '4')"), chunks).collect()} == {("1", "x"), ("4", "y")}


def test_cosine_is_exact(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None), (62, [])]
    df = spark.createDataFrame(v, "chunk_id int, vector array<float>")
    q = df.where("chunk_id < 5").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for x in r.cosine(q, df, 3).collect():
        got.setdefault(x.query_id, {})[x.rank] = x.chunk_id
    m = np.array([x for _, x in v[:60]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(5):
        assert [got[i][k] for k in (1, 2, 3)] == list(np.argsort(-(m @ m[i]), kind="stable")[:3])


def test_fusion_keeps_first_seen_order(spark):
    s = "query_id string, chunk_id string, rank int"
    dense, sparse = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], s), spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], s)
    assert [x.chunk_id for x in r.fused(dense, sparse, 3).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [x.chunk_id for x in r.fused(dense.where("false"), sparse, 3).orderBy("rank").collect()] == ["b", "c"]


def test_hash_embed_has_norm_one(spark):
    df = spark.createDataFrame([("a", "one two two"), ("b", ""), ("c", None)], "chunk_id string, embed_text string")
    got = {x.chunk_id: x.weights for x in r.hash_embed(df).collect()}
    assert abs(sum(w * w for w in got["a"]) - 1) < 1e-9 and got["b"] == [] and got["c"] == []
