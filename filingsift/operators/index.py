"""The persistent index of a collection: packed postings, their statistics and vectors, each a table built once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingsift.config import Config
from filingsift.functions.shared import shared_dir, written
from filingsift.operators import retrieval, store

#: Ids of one broadcast (a few MB).
IDS = 1 << 17


def least(chunks: DataFrame) -> DataFrame:
    """Of rows that repeat a chunk_id the least."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    return chunks.groupBy("chunk_id").agg(F.min(F.struct(*rest)).alias("r")).select("chunk_id", "r.*")


def once(chunks: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rows with an id, of rows that repeat a chunk_id the least. ``repeats`` are the ids that do; where these are few, no other
    row is moved."""
    rows = chunks.where("chunk_id is not null")
    return rows.join(repeats, "chunk_id", "left_anti").select(*chunks.columns).unionByName(least(rows.join(repeats, "chunk_id", "left_semi").select(*chunks.columns)))


def repeated(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id")


class Index:
    """Tables of a collection, each built when it is first asked for: ``packed`` (chunk_id, grp, dl, terms, tfs), whose rows by term are
    ``postings``; ``counts`` (grp, term, df) and ``sizes`` (grp, n, words); ``vectors`` (chunk_id, grp, buckets, weights); ``groups``
    (grp, ticker, fiscal_year). ``chunks`` are the source's rows, once each, with ``grp`` (a hash of ticker and year). With
    ``together`` the packed rows and vectors of a group lie together, so that of a filter's texts few partitions have a best."""

    def __init__(self, source: DataFrame, at: str, force: bool = False, together: bool = False):
        self.source, self.at, self.force, self.together = source, at, force, together

    def _table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return store.built(self.source.sparkSession, f"{self.at}/{name}", build, self.force)

    @staticmethod
    def _grouped(rows: DataFrame) -> DataFrame:
        return rows.withColumn("grp", F.xxhash64(F.upper(F.trim("ticker")), "fiscal_year"))

    @cached_property
    def chunks(self) -> DataFrame:
        return self._grouped(once(self.source, self._table("repeats", lambda: repeated(self.source))))

    @cached_property
    def texts(self) -> DataFrame:
        """What is packed: as it lies, or laid together by one exchange."""
        if not self.together:
            return self.chunks
        rows = self.chunks.select("chunk_id", "grp", "embed_text").repartitionByRange("grp", "chunk_id")
        return self._table("texts", lambda: rows.sortWithinPartitions("grp", "chunk_id"))

    @cached_property
    def packed(self) -> DataFrame:
        return self._table("packed", lambda: retrieval.packed(self.texts, keep=("grp",)))

    @property
    def postings(self) -> DataFrame:
        return retrieval.unpacked(self.packed)

    @cached_property
    def counts(self) -> DataFrame:
        return self._table("counts", lambda: retrieval.term_counts(self.packed, "grp"))

    @cached_property
    def sizes(self) -> DataFrame:
        return self._table("sizes", lambda: retrieval.text_sizes(self.packed, "grp"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self._table("vectors", lambda: retrieval.hash_embed(self.texts, keep=("grp",)))

    @cached_property
    def groups(self) -> DataFrame:
        return self._table("groups", lambda: self.chunks.select("grp", F.upper(F.trim("ticker")).alias("ticker"), "fiscal_year").distinct())

    @property
    def stats(self) -> tuple[DataFrame, DataFrame]:
        return self.counts, self.sizes

    def of(self, ids: DataFrame, *columns: str) -> DataFrame:
        """The chunks of ``ids`` (chunk_id), once each: blocks of some IDS ids are broadcast, so that no other text is moved."""
        ids = written(ids.select("chunk_id").where("chunk_id is not null").distinct(), "ids")
        n = max(1, -(-ids.count() // IDS))
        rows = None
        for b in range(n):
            some = self.source.join(F.broadcast(ids.where(F.pmod(F.xxhash64("chunk_id"), F.lit(n)) == b)), "chunk_id", "left_semi")
            rows = some if rows is None else rows.unionByName(some)
        return written(least(rows.select(*self.source.columns)).select("chunk_id", *columns), "found")


def place(spark: SparkSession, chunks: DataFrame, config: Config) -> str:
    """Where the index of these files lies: by the configuration's index_id, and by the files and their bytes."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted(chunks.inputFiles())
    at = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    sizes = [p.getFileSystem(hadoop).getFileStatus(p).getLen() for p in at]
    return f"{shared_dir(spark)}/index-{config.index_id}-{hashlib.sha256(repr((files, sizes)).encode()).hexdigest()[:12]}"


def opened(spark: SparkSession, chunks: DataFrame, config: Config | None = None, force: bool = False, together: bool = False) -> Index:
    """The index of ``chunks`` (read from files), whose tables are built where they are not there yet. Configurations that
    differ only in how they search share it. Of rows that repeat a chunk_id the least counts, null ids are left out."""
    return Index(chunks, place(spark, chunks, config or Config()) + ("-together" if together else ""), force, together)
