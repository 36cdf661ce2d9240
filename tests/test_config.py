import json

import pytest
from pyspark.sql import functions as F

from filingsift import config
from filingsift.functions import answers
from filingsift.functions.shared import shared_dir
from filingsift.operators import layout, store


def test_searches_share_an_index(tmp_path):
    (tmp_path / "05_x.yaml").write_text(json.dumps({"retrieval": {"mode": "bm25", "rerank": True}}))
    c = config.load(tmp_path / "05_x.yaml")
    assert c.name == "05_x" and c.retrieval.mode == "bm25" and c.index_id == config.Config().index_id
    assert config.Config(chunking=config.Chunking(size=100)).index_id != c.index_id
    for bad in ({"retrieval": {"mode": "other"}}, {"chunking": {"sizes": 1}}, {"chunking": {"strategy": "x"}}):
        (tmp_path / "bad.yaml").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load(tmp_path / "bad.yaml")


def test_faithfulness(spark):
    rows = [('{"claims": [{"claim": "a", "supported": true}, {"supported": false}, {"claim": "x"}, 3]}', 0.5), ('{"claims": []}', None), ("{}", None), (None, None)]
    df = spark.createDataFrame(rows, "raw string, want double")
    assert all(r.got == r.want for r in df.select("want", answers.faithfulness(answers.parse_object(F.col("raw"))).alias("got")).collect())


def test_annual_facts(spark):
    f = "ticker string, tag string, form string, fp string, start string, end string, val long, filed string"
    rows = [("C", "Assets", "10-K", "FY", None, "2024-12-31", 1, "2025-02-01"), ("C", "Assets", "10-K", "FY", None, "2024-12-31", 2, "2026-02-01"), ("C", "Income", "10-K", "FY", "2024-01-01", "2024-12-31", 3, "2025-02-01"), ("C", "Income", "10-K", "FY", "2024-10-01", "2024-12-31", 4, "2026-02-01"), ("C", "Income", "10-Q", "FY", "2024-01-01", "2024-12-31", 5, "2027-02-01")]
    assert {(r.tag, r.year, r.val) for r in store.annual_facts(spark.createDataFrame(rows, f)).collect()} == {("Assets", 2024, 2), ("Income", 2024, 3)}


def test_columns_of_a_page_are_not_mixed(spark):
    words = []
    for block, x in ((1, 50.0), (0, 300.0)):
        for line in range(8):
            y = 100 + 12.0 * line + (30 if line > 3 else 0)
            words += [("p", len(words), block, line, x + 40, y, x + 60, y + 10, "b"), ("p", len(words) + 1, block, line, x, y, x + 30, y + 10, f"c{block}-{line}")]
    df = spark.createDataFrame(words, "page string, nth int, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [r.text for r in layout.paragraphs_of_words(df).orderBy("paragraph").collect()]
    assert got == ["\n".join(f"c{b}-{k} b" for k in ks) for b in (1, 0) for ks in (range(4), range(4, 8))]


def test_markdown(spark):
    path = f"{shared_dir(spark)}/report"
    store.write_markdown(spark.createDataFrame([("b", "1"), ("a", None)], "config string, hit string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["| config | hit |", "|---|---|", "| a | – |", "| b | 1 |"]
