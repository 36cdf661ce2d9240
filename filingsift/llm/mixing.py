"""Problem 7: mixing sources to target weights.

Method: Pfair scheduling. A source's text is a stream of equal quanta, some of which make a block; its weight gives quantum k
of n in P slots the release floor(k P / n) and the deadline ceil((k + 1) P / n), and earliest deadline first fills the slots.

The schedule is made in two levels, so that no task goes through all slots. First, periods of many slots take quanta by
earliest deadline first, as one slot of that capacity each: this says how many quanta each source has in each period, and
every sum up to a border is within one quantum of its share. Then each period is scheduled on its own, in parallel, with
weights from its own counts. Up to any slot a source is less than two quanta from its share, hence far less than a block; the
number of quanta in a block is chosen so that quanta that are not full (the ends of exhausted sources) fit in as well.

Documents reach their quantum through running sums of token counts, taken in two levels (within hashed buckets, then over
buckets), so that a source with a third of all documents is spread over many tasks. ``blocks_of`` cuts documents at the
borders of quanta, so that the tokens follow the schedule exactly; ``mixed`` keeps them whole where they begin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingsift.functions.shared import written

#: Slots of a period at least, and periods at most: the driver holds a count for each source of each period.
PERIOD_SLOTS, MOST_PERIODS = 1 << 20, 1 << 16
#: Tokens of a block, quanta of a block at least, documents of a bucket of the running sums, sources at most.
BLOCK_TOKENS, QUANTA, BUCKET_DOCUMENTS, MOST_SOURCES = 4096, 8, 20_000, 10_000


def quotas(shares: dict[str, float], limits: dict[str, int], total: int) -> dict[str, int]:
    """Tokens of each source: its share of ``total``, or its limit if that is less; what the limited ones lack goes to
    the others in proportion to their shares."""
    out, left, active = {}, total, {s: w for s, w in shares.items() if w > 0 and limits.get(s, 0) > 0}
    while active:
        weight = sum(active.values())
        short = [s for s, w in active.items() if limits[s] <= left * w / weight]
        if not short:
            out |= {s: round(left * w / weight) for s, w in active.items()}
            break
        for s in short:
            out[s] = limits[s]
            del active[s]
        left = total - sum(out.values())
    return {s: n for s, n in out.items() if n > 0}


def apportion(sizes: dict[str, int], slots: int) -> dict[str, int]:
    """Whole slots by largest remainder, one at least for each source."""
    total = sum(sizes.values())
    exact = {s: n * slots / total for s, n in sizes.items()}
    given = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (given[s] - exact[s], s))[: max(0, slots - sum(given.values()))]:
        given[s] += 1
    while sum(given.values()) > slots:
        given[max(given, key=lambda s: (given[s], s))] -= 1
    return given


def scheduled(blocks: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """(source, block, slot): earliest deadline first over one period of ``sum(blocks.values())`` slots, one by one."""
    slots = sum(blocks.values())
    waiting = [(0, -(-slots // n), s, 0) for s, n in sorted(blocks.items())]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, k))
        _, s, k = heapq.heappop(ready)
        yield s, k, slot
        if k + 1 < blocks[s]:
            n = blocks[s]
            heapq.heappush(waiting, ((k + 1) * slots // n, -(-(k + 2) * slots // n), s, k + 1))


def schedule(blocks: dict[str, int]) -> list[tuple[str, int, int]]:
    """All rows of ``scheduled``."""
    return list(scheduled(blocks))


def periods(quanta: dict[str, int], least_slots: int | None = None) -> Iterator[tuple[int, int, dict[str, tuple[int, int]]]]:
    """(first slot, slots, {source: (first quantum, quanta)}) of each period.

    At a border after T slots a source has its floor or its ceiling of T n / P. The floor is due; what is left of the
    capacity goes to the started quanta of earliest deadline. A quantum once taken stays taken."""
    slots = sum(quanta.values())
    size = max(least_slots or PERIOD_SLOTS, -(-slots // MOST_PERIODS))
    done = dict.fromkeys(sorted(quanta), 0)
    for first in range(0, slots, size):
        end = min(first + size, slots)
        now = {s: max(k, end * quanta[s] // slots) for s, k in done.items()}
        left = end - sum(now.values())
        started = [(-(-(k + 1) * slots // quanta[s]), s) for s, k in now.items() if k < -(-end * quanta[s] // slots)]
        for _, s in sorted(started)[:left]:
            now[s] += 1
        yield first, end - first, {s: (done[s], now[s] - k) for s, k in done.items() if now[s] > k}
        done = now


def slot_table(spark: SparkSession, quanta: dict[str, int]) -> DataFrame:
    """The schedule as a table (source, quantum, at): one row of counts for each period, each scheduled in a task of its own."""
    rows = [(first, [(s, k, n) for s, (k, n) in own.items()]) for first, _, own in periods(quanta)]
    own = spark.createDataFrame(rows, "first long, own array<struct<source: string, start: long, n: long>>").repartition(max(1, min(len(rows), 10_000)), "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, sources in zip(pdf["first"], pdf["own"]):
                start = {r["source"]: r["start"] for r in sources}
                table = pd.DataFrame(scheduled({r["source"]: r["n"] for r in sources}), columns=["source", "quantum", "at"])
                yield table.assign(quantum=table["quantum"] + table["source"].map(start), at=table["at"] + first)

    return written(own.mapInPandas(run, "source string, quantum long, at long"), "slots")


def _placed(documents: DataFrame, targets: DataFrame, total: int | None, block_tokens: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(every use of a document with its place in its source's stream, the slots, tokens of a quantum)."""
    spark = documents.sparkSession
    targets = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    sized = documents.select("source", "doc_id", F.col("tokens").cast("long").alias("tokens")).where("tokens > 0 and source is not null")
    sized = written(sized.join(targets.where("target_share > 0 and max_repeats > 0"), "source"), "sizes")
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"), F.first("target_share").alias("share"), F.first("max_repeats").alias("times")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources to mix")
    total = total if total is not None else sum(r["n"] for r in sums)
    limits = {r["source"]: r["n"] * r["times"] for r in sums}
    quota = quotas({r["source"]: r["share"] for r in sums}, limits, total)
    # a source that is exhausted ends within a quantum; the more there are, the smaller the quantum
    ends = sum(quota[s] == limits[s] for s in quota)
    quantum = max(1, block_tokens // max(QUANTA, 3 + ceil(ends * max(quota.values(), default=0) / max(1, sum(quota.values())))))
    quota = {s: n if n == limits[s] or n < quantum else n - n % quantum for s, n in quota.items()}
    slots = slot_table(spark, {s: -(-n // quantum) for s, n in quota.items()})
    rows = [(r["source"], quota[r["source"]], r["n"]) for r in sums if r["source"] in quota]
    limit = spark.createDataFrame(rows, "source string, quota long, size long")

    parts = max(1, -(-sum(r["docs"] for r in sums) // BUCKET_DOCUMENTS))
    spread = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = sized.join(F.broadcast(limit), "source").withColumn("spread", spread).withColumn("bucket", F.pmod("spread", F.lit(parts)))  # MOST_SOURCES rows
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = sized.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).select("source", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("spread", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("inside", inside - F.col("tokens")).join(bases, ["source", "bucket"]).withColumn("offset", F.col("base") + F.col("inside"))
    times = F.least(F.expr("(quota - 1 - offset) div size"), F.col("max_repeats") - 1)
    used = placed.where("offset < quota").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times.cast("long"))))
    used = used.withColumn("copy", F.col("copy").cast("int")).withColumn("place", F.col("copy") * F.col("size") + F.col("offset"))
    return used.select("source", "doc_id", "copy", "tokens", "place", "quota"), slots.hint("merge"), quantum


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """(source, doc_id, copy, tokens, slot, place): every use of a document, to be read in the order of slot, copy, place.

    ``documents`` has doc_id, source and tokens (see ``encoding.token_counts``), ``targets`` source, target_share and
    max_repeats, of at most MOST_SOURCES sources (else an error). ``total`` is the size of the mix in tokens, by default that
    of all documents whose source has a share. No document is used more than max_repeats times (null counts as 1); a source
    that cannot fill its share gives all it may. A document stands whole in the slot where it begins, and the last one may
    pass the source's quota; ``blocks_of`` cuts them. Documents without tokens, without a source or of a source without a
    share are not used; shares need not sum to 1; rows of one source in ``targets`` add up.
    """
    used, slots, quantum = _placed(documents, targets, total, block_tokens, seed)
    used = used.withColumn("quantum", F.expr(f"place div {quantum}")).join(slots, ["source", "quantum"])
    return used.select("source", "doc_id", "copy", "tokens", F.col("at").alias("slot"), "place")


def blocks_of(documents: DataFrame, targets: DataFrame, total: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """(slot, source, doc_id, copy, first_token, tokens, place): the same mix with documents cut where a quantum ends, to be
    read in the order of slot and place. Up to any slot, the tokens of a source are less than ``block_tokens`` from its share
    of all tokens so far; the last document of a source ends at its quota. Inputs are those of ``mixed``."""
    used, slots, quantum = _placed(documents, targets, total, block_tokens, seed)
    used = used.withColumn("end", F.least(F.col("place") + F.col("tokens"), "quota"))
    used = used.withColumn("quantum", F.explode(F.sequence(F.expr(f"place div {quantum}"), F.expr(f"(end - 1) div {quantum}"))))
    begin, end = F.greatest("place", F.col("quantum") * quantum), F.least("end", (F.col("quantum") + 1) * quantum)
    out = used.withColumn("begin", begin).withColumn("upto", end).join(slots, ["source", "quantum"])
    return out.select(F.col("at").alias("slot"), "source", "doc_id", "copy", (F.col("begin") - F.col("place")).alias("first_token"), (F.col("upto") - F.col("begin")).alias("tokens"), F.col("begin").alias("place"))


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: its target, the tokens and documents used, how often one was used at most, and
    the share that it really got."""
    used = mix.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("uses"), (F.max("copy") + 1).alias("most_repeats"))
    all_used = used.agg(F.sum("used_tokens").alias("all_tokens"))
    targets = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    out = targets.join(used, "source", "left").crossJoin(F.broadcast(all_used)).fillna(0, ["used_tokens", "uses", "most_repeats"])  # one row: a total
    return out.withColumn("actual_share", F.round(F.coalesce(F.try_divide("used_tokens", "all_tokens"), F.lit(0.0)), 6)).drop("all_tokens")
