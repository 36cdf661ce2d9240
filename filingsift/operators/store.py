"""Tables that grow: keyed caches, append-only logs, idempotent builds, running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """The distinct keys of ``requests`` that the cache lacks, with one of their rows each: what has to be computed."""
    return requests.where(F.col(key).isNotNull()).dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def upserted(cache: DataFrame, fresh: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the greatest version (by a partial aggregation, whatever the number of versions)."""
    rows = cache.unionByName(fresh)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in rest])


def computed_once(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(requests with their values, the grown cache): equal requests share one computation, known ones need none."""
    fresh = compute(misses(requests, cache, key))
    grown = cache.unionByName(fresh)
    return requests.join(grown, key, "left"), grown


def built(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``, built only if there is none that was written to its end (or by force)."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    exists = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
    if force or not exists:
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; blank and broken lines are skipped (all their fields would be null)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*").dropna("all")


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of files that each hold one JSON array (or one object) over many lines; no file, no rows."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not list(at.getFileSystem(hadoop).globStatus(at) or []):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def results(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The result files of earlier runs (one JSON object each), those without question metrics or of retrieval alone left out."""
    rows = json_array(spark, f"{folder.rstrip('/')}/*.json", schema)
    return rows.where(F.col("question_metrics").isNotNull() & ~F.coalesce(F.col("retrieval_only"), F.lit(False)))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def running_total(rows: DataFrame, at: str, tie: str, value: str, grain: str = "HOUR") -> DataFrame:
    """``rows`` with ``running``: the sum of ``value`` (null as 0) up to each row in the order of ``at`` and ``tie``.

    Taken in two levels, inside time buckets and over their totals, so that no window holds the whole table."""
    rows = rows.withColumn("bucket", F.date_trunc(grain, at))
    v = F.coalesce(F.col(value), F.lit(0))
    inside = F.sum(v).over(Window.partitionBy("bucket").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy("bucket").agg(F.sum(v).alias("total"))
    before = F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # one row per bucket
    bases = totals.select("bucket", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.withColumn("inside", inside).join(bases, "bucket").withColumn("running", F.col("base") + F.col("inside")).drop("bucket", "inside", "base")


def within_budget(rows: DataFrame, at: str, tie: str, value: str, budget: float) -> DataFrame:
    """The rows up to and with the first one that passes the budget."""
    r = running_total(rows, at, tie, value)
    return r.where(F.col("running") - F.coalesce(F.col(value), F.lit(0)) <= budget)


def latest(rows: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """One row per key: the greatest ``by``, among equal ones the least ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(tie))
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def carried_over(rows: DataFrame, prior: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``rows`` with the fields that ``prior`` has for their key in place of their own."""
    old = prior.select(key, *[F.col(f).alias(f"old_{f}") for f in fields])
    out = rows.join(old, key, "left")
    return out.select(*[F.coalesce(f"old_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def annual_facts(facts: DataFrame) -> DataFrame:
    """(ticker, tag, year, val, filed) of facts (ticker, tag, form, fp, start, end, val, filed; dates as text): the latest
    filed annual value whose period ends in the year; periods with a start must last 350 to 380 days, and of equal filing
    dates the first period counts."""
    days = F.datediff(F.to_date("end"), F.to_date("start"))
    kept = facts.where((F.col("form") == "10-K") & (F.col("fp") == "FY") & (F.col("start").isNull() | days.between(350, 380)))
    return latest(kept.withColumn("year", F.year(F.to_date("end"))), ["ticker", "tag", "year"], "filed", "end").select("ticker", "tag", "year", "val", "filed")


def write_markdown(table: DataFrame, path: str) -> None:
    """A report table (one row per configuration) as the lines of a markdown table, in the order of its first column."""
    head = [f"| {' | '.join(table.columns)} |", "|---" * len(table.columns) + "|"]
    spark = table.sparkSession
    rows = table.select(F.lit(1).alias("part"), F.col(table.columns[0]).cast("string").alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in table.columns]), F.lit(" |")).alias("value"))
    lines = spark.createDataFrame([(0, str(k), v) for k, v in enumerate(head)], "part int, key string, value string").unionByName(rows)
    lines.orderBy("part", "key").select("value").coalesce(1).write.mode("overwrite").text(path)
