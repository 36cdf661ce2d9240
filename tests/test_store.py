from pyspark.sql import functions as F

from filingsift.functions.shared import shared_dir
from filingsift.operators import prompting, store


def test_cache(spark):
    cache = spark.createDataFrame([("a", 1)], "key string, v int")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "i int, key string")
    calls = spark.sparkContext.accumulator(0)
    got, grown = store.computed_once(asked, cache, lambda m: m.select("key", F.lit(7).alias("v")))
    assert {(r.i, r.v) for r in got.collect()} == {(1, 1), (2, 7), (3, 7), (4, None)} and grown.count() == 2 and calls.value == 0
    fresh = spark.createDataFrame([("a", 5), ("a", 3)], "key string, v int")
    assert store.upserted(cache, fresh, "key", "v").collect() == [("a", 5)]


def test_running_total_and_budget(spark):
    rows = [(i, f"2026-01-0{1 + i // 4} 0{i % 4}:00:00", None if i == 3 else 1.0) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, ts string, usd double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.running for r in store.running_total(df, "ts", "id", "usd").orderBy("id").collect()] == [1, 2, 3, 3, 4, 5, 6, 7]
    assert store.within_budget(df, "ts", "id", "usd", 2.5).count() == 3  # the third passes it
    assert store.running_total(df.where("false"), "ts", "id", "usd").count() == 0


def test_logs_and_builds(spark):
    path = f"{shared_dir(spark)}/test-log"
    schema = "ts string, usd double"
    spark.createDataFrame([("a", 1.0)], schema).write.mode("overwrite").json(path)
    store.append_log(spark.createDataFrame([("b", None)], schema), path)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(path)
    assert {tuple(r) for r in store.json_lines(spark, path, schema).collect()} == {("a", 1.0), ("b", None)}
    built = []
    for force in (True, False, True):
        store.built(spark, f"{path}-built", lambda: built.append(1) or spark.range(3).toDF("i"), force)
    assert len(built) == 2


def test_latest_and_carry_over(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "z"), ("a", 2, "y")], "k string, filed int, id string")
    assert store.latest(rows, ["k"], "filed", "id").first().id == "y"
    now, prior = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "k string, ms double"), spark.createDataFrame([("a", 9.0)], "k string, ms double")
    assert dict(store.carried_over(now, prior, "k", ["ms"]).collect()) == {"a": 9.0, "b": 1.0}


def test_offline_completer(spark):
    df = spark.createDataFrame([("What was it?", ["[1] B | FY1 | n/a | p. 1\n\nFirst line\nsecond"]), ("What will it be?", ["[1] x\ny"]), ("In 2031?", ["[1] x\ny"]), ("What?", [])], "t string, e array<string>")
    a, ab = prompting.offline_answer(F.col("t"), F.col("e"))
    assert [tuple(r) for r in df.select(a, ab).collect()] == [("First line", False), (None, True), (None, True), (None, True)]
    df = spark.createDataFrame([("It was 5,000 in 2024.", ["none", "2024: 5,000"]), ("It grew.", ["2024"]), ("It was 7.", [])], "t string, e array<string>")
    v, at = prompting.offline_verdict(F.col("t"), F.col("e"))
    assert [tuple(r) for r in df.select(v, at).collect()] == [("SUPPORTED", 2), ("NOT_ENOUGH_INFO", 0), ("NOT_ENOUGH_INFO", 0)]


def test_late_calls_of_many_files_are_counted_once(spark, tmp_path, monkeypatch):
    import datetime

    from filingsift.streaming import logs

    monkeypatch.setattr(logs, "FILES", 1)

    at = lambda day, hour: datetime.datetime(2026, 1, day, hour, 30)
    files = [[(1, at(1, 5), at(1, 6), "ask", 1.0), (2, at(1, 5), at(1, 6), "ask", None)], [(3, at(4, 7), at(4, 8), "ask", 2.0), (1, at(1, 5), at(4, 9), "ask", 9.0)], [(4, at(1, 5), at(5, 1), "ask", 4.0), (None, at(1, 5), at(5, 1), "ask", 4.0)]]
    for k, rows in enumerate(files):  # each file is a batch of its own; calls of the first day arrive on the fifth
        spark.createDataFrame(rows, "log_id long, ts timestamp, arrived_at timestamp, kind string, usd double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/cost_log.parquet")
    assert {tuple(r) for r in logs.cost_by_hour(spark, str(tmp_path)).collect()} == {("2026-01-01 05", "ask", 3, 5.0), ("2026-01-04 07", "ask", 1, 2.0)}


def test_json_arrays_and_result_files(spark, tmp_path):
    (tmp_path / "questions.json").write_text('[\n {"id": "a", "n": 1},\n {"id": "b"}\n]')
    assert {tuple(r) for r in store.json_array(spark, f"{tmp_path}/questions.json", "id string, n int").collect()} == {("a", 1), ("b", None)}
    assert store.json_array(spark, f"{tmp_path}/missing.json", "id string").count() == 0
    for name, text in (("r1", '{"name": "x",\n "question_metrics": {"mrr": 0.5}}'), ("r2", '{"name": "y", "retrieval_only": true, "question_metrics": {"mrr": 1}}'), ("r3", '{"name": "z"}')):
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "questions.json").unlink()
    assert [r.name for r in store.results(spark, str(tmp_path), "name string, retrieval_only boolean, question_metrics struct<mrr: double>").collect()] == ["x"]
