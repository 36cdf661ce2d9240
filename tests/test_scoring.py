"""Scores made in blocks: the same results however small the blocks are, and no pair of query and text as a row."""

import random

import numpy as np
import pytest

from filingsift.functions import shared
from filingsift.operators import index, scoring
from filingsift.operators import retrieval as r
from filingsift.plans import retrieval as plans
from test_retrieval import brute_bm25

WORDS = ["net", "income", "of", "the", "bank", "ratio", "loss", "2024", "x1", "x2", "x3"]


@pytest.fixture()
def small_blocks(monkeypatch):
    """Blocks of few queries and scores; how many rows each written table has."""
    rows: dict[str, int] = {}

    def written(df, name):
        out = shared.written(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    for module in (r, scoring, index):
        monkeypatch.setattr(module, "written", written)
    monkeypatch.setattr(scoring, "QUERIES", 8)
    monkeypatch.setattr(scoring, "CELLS", 48)
    return rows


def texts_and_queries(spark, n=300, asked=12):
    rng = random.Random(2)
    texts = [(f"c{i:03}", " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(n)]
    queries = [(f"q{i}", " ".join(rng.choices([*WORDS[:5], rng.choice(WORDS), "unheard"], k=4))) for i in range(asked)] + [("none", "unheard")]
    return texts, queries, spark.createDataFrame(texts, "chunk_id string, embed_text string").repartition(3), spark.createDataFrame(queries, "query_id string, text string")


def test_bm25_makes_no_row_of_a_pair(spark, small_blocks):  # F2
    texts, queries, t, q = texts_and_queries(spark)
    got = {}
    for x in r.bm25(q, r.packed(t), 3).orderBy("rank").collect():
        got.setdefault(x.query_id, []).append((x.chunk_id, x.score))
    assert got == {i: brute_bm25(texts, text, 3) for i, text in queries}
    assert small_blocks["scored"] <= 3 * len(queries) * 3 and not {"matched", "postings"} & set(small_blocks)


def test_balanced_makes_no_row_of_a_pair(spark, small_blocks):  # F1
    texts, queries, t, q = texts_and_queries(spark, 200, 9)
    got = {}
    for x in r.balanced(q, r.packed(t.selectExpr("*", "substr(chunk_id, 1, 2) as owner"), keep=("owner",)), "owner", 2).orderBy("rank").collect():
        got.setdefault((x.query_id, x.owner), []).append((x.chunk_id, x.score))
    want = {}
    for i, text in queries:
        for c, score in brute_bm25(texts, text, len(texts)):
            want.setdefault((i, c[:2]), []).append((c, score))
    assert got == {k: v[:2] for k, v in want.items()} and small_blocks["scored"] <= 3 * len(queries) * 2 * 2


def test_cosine_packs_no_vector(spark, small_blocks):  # F6
    texts, queries, t, q = texts_and_queries(spark, 200, 9)
    sparse = r.hash_embed(t)
    m = np.zeros((len(texts), r.HASH_DIM))
    rows = sorted(sparse.collect())
    for n, x in enumerate(rows):
        m[n, x.buckets] = x.weights
    got = {}
    for x in r.cosine(r.hash_embed(q, "query_id", "text"), sparse, 3).orderBy("rank").collect():
        got.setdefault(x.query_id, []).append((x.chunk_id, x.score))
    for x in r.hash_embed(q, "query_id", "text").collect():
        v = np.zeros(r.HASH_DIM)
        v[x.buckets] = x.weights
        score = np.round(m @ v, 6) + 0.0
        assert got[x.query_id] == [(rows[n].chunk_id, score[n]) for n in np.argsort(-score, kind="stable")[:3]]
    assert small_blocks["scored"] <= 3 * len(queries) * 3


def test_filters_share_one_reading_of_the_index(spark, small_blocks):  # F3, F4
    texts, queries, t, q = texts_and_queries(spark, 120, 9)
    grouped = t.selectExpr("*", "cast(substr(chunk_id, 4, 1) as bigint) as grp")
    admits = {0: range(10), 1: [1, 2], 2: [2]}
    groups = spark.createDataFrame([(f, g) for f, gs in admits.items() for g in gs], "filter_id long, grp long")
    filtered = [(i, text, n % 3) for n, (i, text) in enumerate(queries)]
    packed = r.packed(grouped, keep=("grp",))
    asked = spark.createDataFrame(filtered, "query_id string, text string, filter_id long")
    got = {}
    for x in r.bm25(asked, packed, 3, groups=groups).orderBy("rank").collect():
        got.setdefault(x.query_id, []).append((x.chunk_id, x.score))
    assert got == {i: brute_bm25([x for x in texts if int(x[0][3]) in admits[f]], text, 3) for i, text, f in filtered}
    near = r.cosine(r.hash_embed(asked, "query_id", "text", ("filter_id",)), r.hash_embed(grouped, keep=("grp",)), 3, groups=groups).collect()
    assert len(near) == 3 * len(queries) and all(int(x.chunk_id[3]) in admits[dict((i, f) for i, _, f in filtered)[x.query_id]] for x in near)


def test_a_search_by_words_builds_no_copy_of_the_texts(spark, tmp_path):  # F5
    rows = [("a_1:p1:c0", "a_1", "A", 2024, "net income"), ("a_1:p2:c0", "a_1", "A", 2024, "net loss"), ("a_1:p2:c0", "a_1", "A", 2024, "a loss")]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, ticker string, fiscal_year int, embed_text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("q50", "loss")], "id string, question string").write.parquet(f"{tmp_path}/questions.parquet")
    assert plans.bm25_topk(spark, str(tmp_path)).count() == 2
    found = index.opened(spark, spark.read.parquet(f"{tmp_path}/chunks.parquet"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found.at)
    built = {x.getPath().getName() for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)}
    assert built == {"repeats", "packed", "counts", "sizes"} and found.packed.count() == 2
    plan = spark._jvm.PythonSQLUtils.explainString(found.chunks._jdf.queryExecution(), "formatted")
    assert "BroadcastHashJoin LeftAnti" in plan


def test_texts_of_hits_are_those_of_the_least_rows(spark, tmp_path, monkeypatch):  # F7
    monkeypatch.setattr(index, "IDS", 2)
    rows = [(f"c{i}", "d", "t", 2024, f"text {i}") for i in range(9)] + [("c3", "d", "t", 2024, "a text"), (None, "d", "t", 2024, "x")]
    spark.createDataFrame(rows, "chunk_id string, doc_id string, ticker string, fiscal_year int, embed_text string").write.parquet(f"{tmp_path}/c.parquet")
    found = index.opened(spark, spark.read.parquet(f"{tmp_path}/c.parquet"))
    ids = spark.createDataFrame([("c3",), ("c3",), ("c5",), ("c7",), ("no",), (None,)], "chunk_id string")
    assert sorted(map(tuple, found.of(ids, "embed_text").collect())) == [("c3", "a text"), ("c5", "text 5"), ("c7", "text 7")]
