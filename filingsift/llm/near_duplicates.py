"""Problem 3: near-duplicate records with small edits, as an exact set-similarity join.

A record is the set of runs of ``words`` consecutive tokens (`[a-z0-9]+` of the lower-cased text); two records are alike
if |A and B| / |A or B| >= threshold. Method: set-relation skipping over an inverted index.

* Order. Shingles are ordered by how many records hold their bucket of a merged counting sketch (rare first), ties by hash.
* Index. Alike sets share at least ``g + m`` of the first ``P = allowed misses + g + m`` shingles in that order. Hashed into
  ``g`` groups, these fall at least ``m`` times two into one group: index keys are the pairs of prefix shingles of one group,
  and alike sets have ``m`` keys in common. No pair of alike sets is missed; keys made of two shingles have short lists even
  where single shingles are frequent, and hardly any other pair has m of them in common.
* The lists are made by one exchange. Every task sorts its entries (key, set, position, size) and sends each range of keys
  as one packed block of some 7 bytes an entry; a task that gets a range merges the blocks into its lists. Nothing is
  broadcast and no sketch can fill up, so an entry costs the same at any size of the collection.
* Index-level skipping: a list is cut into blocks of like sizes, each in the order of positions. An entry is compared with
  the blocks of sizes that an alike set may have, and in each with the stretch of positions only that leaves room for the
  needed overlap; blocks and stretches beyond are skipped unseen. Exact size and position decide about the rest.
* Answer-level skipping: equal sets are one class and only its representative is indexed. Representatives with the same
  rarest shingles follow a leader; once the overlap of two leaders is computed, it bounds the overlaps of their followers
  by the few shingles in which these differ, and only pairs that the bounds leave open are compared in full.

Skew: the list of a key whose shingles are both frequent is salted: its entries are dealt to slots, and every two slots meet in
a list of their own. Classes are min-aggregations, and copies come back through a join at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingsift.functions.shared import written
from filingsift.llm import sketch
from filingsift.llm.hashing import Ranges, mix, text_slices

#: Buckets of the ordering sketch (4 bytes each), as a power of two.
ORDER_BITS = 20
#: Bits of an index key that are kept (keys that agree in them share a list), and entries that a task packs at once.
KEY_BITS, PACKED = 40, 2_000_000
#: A list expected to be longer than this, and than so many times the mean bucket of the ordering sketch, is salted.
LONG_LIST, LONG_SHARE, MOST_SLOTS = 50_000, 64, 32
#: Sizes of one block of a list differ by less than this factor.
BAND = 1.1
#: Pairs of entries that a task looks at in one go.
AT_ONCE = 4_000_000
#: Keys that alike sets must have in common, at most (fewer for sets below 16 shingles).
COMMON = 4
#: Rarest shingles that followers of a leader have in common.
NEAR = 6
_CLASS = np.zeros(256, bool)
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UNUSUAL = (chr(0x130).encode(), chr(0x212A).encode())  # capital dotted I and the Kelvin sign: their lower case holds an ASCII letter


def _sets(column: pa.Array, words: int, least_tokens: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each slice of rows: first row, row of each shingle and its hash; distinct and sorted within a row."""
    for first, to, data, offsets in text_slices(column):
        if any(x in data for x in _UNUSUAL):
            texts = [(t or "").lower().encode() for t in column.slice(first, to - first).to_pylist()]
            data, offsets = b"".join(texts), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        chars = _LOWER[np.frombuffer(data, np.uint8)]
        inside = _CLASS[chars]
        edge = np.zeros(len(chars) + 1, bool)
        edge[offsets] = True  # a token ends where its row ends
        before = np.r_[False, inside]
        after = np.r_[inside, False]
        start = np.flatnonzero(after & (~before | edge))
        end = np.flatnonzero(before & (~after | edge))
        if not len(start):
            continue
        tokens = Ranges(chars).between(start, end)
        row = np.searchsorted(offsets, start, "right") - 1
        enough = np.bincount(row, minlength=len(offsets))[row] >= max(words, least_tokens)
        n = len(tokens) - words + 1
        if n <= 0:
            continue
        hashes = np.zeros(n, np.uint64)
        for k in range(words):
            hashes = mix(hashes + tokens[k : n + k] + np.uint64(k + 1))
        ok = enough[:n] & (row[:n] == row[words - 1 :])
        row, hashes = row[:n][ok], hashes[ok]
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        fresh = np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])][: len(row)]
        yield first, row[fresh], hashes[fresh]


def _ordered(row: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each row's shingles, rare first; with the position of each, the size of its set and how often its bucket occurs."""
    times = counts[sketch.buckets(hashes, ORDER_BITS)]
    order = np.lexsort((hashes, np.minimum(times, np.uint32(0xFFFFFF)), row))
    row, hashes = row[order], hashes[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[starts, len(row)])
    return row, hashes, np.arange(len(row)) - np.repeat(starts, sizes), np.repeat(sizes, sizes), times[order]


def _needed(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The least overlap of alike sets of a and b shingles."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def _needed_column(a: str, b: str, threshold: float) -> Column:
    return F.ceil(F.lit(threshold / (1 + threshold)) * (F.col(a) + F.col(b)) - 1e-9)


def _keys(row: np.ndarray, hashes: np.ndarray, at: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Index keys as (index of the earlier and of the later shingle, key, whether a set has it as the smaller of two as well).

    The class of two sets is that of the smaller, c for 2**c to 2**(c + 1) - 1 shingles; it has ``g = 2**c / 4`` groups and
    asks for ``m = min(COMMON, g)`` common keys (see ``_common_keys``). A set has keys of its own class, and as the larger
    one those of the class below if an alike set may be that small. Below 8 shingles sets may share fewer than g + m, so
    there single shingles are the keys (g = 0, m = 1).
    """
    own = np.floor(np.log2(size) + 1e-9).astype(np.int64)
    for lower in (0, 1):
        cls = own - lower
        floor = 1 << np.maximum(cls, 0)
        smallest = np.maximum(np.ceil(threshold * size - 1e-9).astype(np.int64), floor)
        g = np.where(cls >= 3, floor >> 2, 0)
        m = np.where(cls >= 3, np.minimum(COMMON, g), 1)
        inside = (cls >= 0) & (smallest < 2 * floor) & (at < size - _needed(smallest, size, threshold) + g + m)
        small = (lower == 0) & (at < size - _needed(size, size, threshold) + g + m)  # the smaller of two may miss less
        salt = mix(cls.astype(np.uint64) + np.uint64(101))
        lone = np.flatnonzero(inside & (g == 0))
        if len(lone):
            yield lone, lone, mix(hashes[lone] ^ salt[lone]), small[lone]
        paired = np.flatnonzero(inside & (g > 0))
        group = mix(hashes[paired] + np.uint64(77)) % g[paired].astype(np.uint64)
        sort = np.lexsort((at[paired], group, row[paired]))
        order, group = paired[sort], group[sort]
        for lag in range(1, len(order)):
            same = (row[order[:-lag]] == row[order[lag:]]) & (group[:-lag] == group[lag:])
            if not same.any():
                break
            a, b = order[:-lag][same], order[lag:][same]
            yield a, b, mix((hashes[a] * np.uint64(3) + mix(hashes[b])) ^ salt[b]), small[b]


def _common_keys(smaller: Column) -> Column:
    """The keys that two alike sets have in common at least, by the size of the smaller one."""
    g = F.floor(F.pow(F.lit(2.0), F.floor(F.log2(smaller.cast("double")) + 1e-9)) / 4)
    return F.when(smaller < 8, 1).otherwise(F.least(g, F.lit(COMMON)))


def _classes(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: where it starts, the id of its class (a hash of the set, whatever its order) and its size."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    sizes = np.diff(np.r_[starts, len(row)])
    whole = np.add.reduceat(mix(hashes ^ np.uint64(0x51)), starts) + mix(np.bitwise_xor.reduceat(mix(hashes ^ np.uint64(0x77)), starts)) + sizes.astype(np.uint64)
    return starts, mix(whole), sizes


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of all of them, so that bytes that hardly vary are pressed away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def packed(key: np.ndarray, cid: np.ndarray, at: np.ndarray, size: np.ndarray, small: np.ndarray, ranges: int) -> pa.RecordBatch:
    """Entries as one block for each range of keys (a power of two of them): the keys' steps, then the other columns."""
    key = key >> np.uint64(64 - KEY_BITS)
    order = np.argsort(key)
    key, cid, at, size = key[order], cid[order], (at[order].astype(np.uint64) << np.uint64(1)) | small[order], size[order]
    width = 1 << (KEY_BITS - ranges.bit_length() + 1)
    edges = np.searchsorted(key, np.arange(0, (1 << KEY_BITS) + 1, width, dtype=np.uint64))
    kept = np.flatnonzero(np.diff(edges))
    datas = []
    for k in kept:
        own = slice(edges[k], edges[k + 1])
        steps = np.diff(key[own], prepend=np.uint64(k * width))
        raw = b"".join(_planes(x) for x in (steps, cid[own], at[own], size[own]))
        datas.append(len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(datas, pa.binary())], ["range", "data"])


def unpacked(datas: list[bytes]) -> tuple[np.ndarray, ...]:
    """(key within the range, cid, position, size, small) of the blocks of one range."""
    parts = []
    for d in datas:
        raw = pa.decompress(d[4:], int.from_bytes(d[:4], "little"), "zstd", asbytes=True)
        rows = np.frombuffer(raw, np.uint8).reshape(4, 8, -1).transpose(0, 2, 1)
        part = np.ascontiguousarray(rows).view("<u8")[..., 0].copy()
        part[0] = np.cumsum(part[0], dtype=np.uint64)
        parts.append(part)
    key, cid, at, size = np.concatenate(parts, axis=1)
    return key, cid.view(np.int64), (at >> np.uint64(1)).astype(np.int64), size.astype(np.int64), (at & np.uint64(1)) == 1


def stretches(key: np.ndarray, at: np.ndarray, size: np.ndarray, band: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For entries in the order of key, band and position: per block of sizes, where the stretch of entries to compare each
    with begins and how many they are. A pair of one block is met once, from the entry that comes first."""
    share = threshold / (1 + threshold)  # of both sizes, the needed overlap
    lists = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    steps = int(np.ceil(np.log(1 / threshold) / np.log(BAND)))
    reach = int(size.max() * BAND / threshold) + 2  # no distance of positions is larger
    span, bands = int(at.max()) + 2 * reach + 1, int(band.max()) + steps + 1
    place = (lists * bands + band) * span + reach + at
    for step in range(steps + 1):
        low, high = BAND ** (band + step), BAND ** (band + step + 1.0)
        if step:
            later, earlier = high - share * (size + high), size - share * (size + low)
            home = place + step * span
            begin = np.searchsorted(place, home - np.floor(earlier + 1e-6).astype(np.int64), "left")
        else:
            later, home, begin = high - share * (low + high), place, np.arange(1, len(place) + 1)
        yield begin, np.maximum(np.searchsorted(place, home + np.floor(later + 1e-6).astype(np.int64), "right") - begin, 0)


def met(key: np.ndarray, cid: np.ndarray, at: np.ndarray, size: np.ndarray, small: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, na, nb, times): the sets of one list, a the smaller, whose entries stand so that they may be alike."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    order = order[np.r_[False, same] | np.r_[same, False]]  # lists of one entry lead nowhere
    band = np.floor(np.log(size) / np.log(BAND) + 1e-9).astype(np.int64)
    order = order[np.lexsort((at[order], band[order], key[order]))]
    key, cid, at, size, small, band = (x[order] for x in (key, cid, at, size, small, band))
    for begin, n in stretches(key, at, size, band, threshold) if len(order) else ():
        first, total = 0, np.cumsum(n)
        while first < len(n):  # slices of bounded work
            before = total[first] - n[first]
            to = max(first + 1, int(np.searchsorted(total, before + AT_ONCE, "right")))
            i = np.repeat(np.arange(first, to), n[first:to])
            j = np.repeat(begin[first:to] - (total[first:to] - n[first:to] - before), n[first:to]) + np.arange(len(i))
            first = to
            less = (size[i] < size[j]) | ((size[i] == size[j]) & (cid[i] < cid[j]))
            a, b = np.where(less, i, j), np.where(less, j, i)
            na, nb = size[a], size[b]
            needed = _needed(na, nb, threshold)
            ok = small[a] & (cid[a] != cid[b]) & (na >= threshold * nb - 1e-9) & (at[b] - at[a] <= nb - needed) & (at[a] - at[b] <= na - needed)
            if ok.any():
                both = np.stack([cid[a[ok]], cid[b[ok]], na[ok], nb[ok]])
                both = both[:, np.lexsort((both[1], both[0]))]
                fresh = np.flatnonzero(np.r_[True, (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1])])
                yield (*both[:, fresh], np.diff(np.r_[fresh, both.shape[1]]))


def _salted(k: np.ndarray, key: np.ndarray, frequent: np.ndarray, cid: np.ndarray, long: float) -> tuple[np.ndarray, np.ndarray]:
    """(entry, key) with the entries of long lists dealt to slots: an entry goes to the lists of its own slot with each slot."""
    slots = np.clip(np.ceil(frequent / long), 1, MOST_SLOTS).astype(np.int64)
    times = np.repeat(np.arange(len(k)), slots)
    other = np.arange(len(times)) - np.repeat(np.cumsum(slots) - slots, slots)
    many = slots[times] > 1
    own = (mix(cid[k][times].astype(np.uint64)) % slots[times].astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(own, other) * (MOST_SLOTS + 1) + np.maximum(own, other) + 1).astype(np.uint64)
    return times, np.where(many, mix(key[times] ^ mix(pair)), key[times])


RECORDS = "cid long, cls long, n int, id {kind}, text string, block int, part int, data binary"
PAIRS = "a long, b long, na int, nb int, times long"


class Joined:
    """The steps of one join; each is a table written once."""

    def __init__(self, records: DataFrame, threshold: float, words: int, least_tokens: int, id_column: str, text: str, long_list: int = LONG_LIST):
        self.records = records.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
        self.threshold, self.words, self.least_tokens, self.long_list = threshold, words, least_tokens, long_list
        self.spark = records.sparkSession
        every = self.every = self._read()
        self.counts = self.spark.sparkContext.broadcast(sketch.counted(every.where("data is not null").select("block", "part", "data"), ORDER_BITS))
        members = every.where("cls is not null").select("cls", "cid", "id")
        held = members.where("cid is not null")
        first = held.groupBy("cls").agg(F.min("cid").alias("cid"))
        # one text for each class: those that another task holds as well are left out of the texts
        again = held.join(first.withColumnRenamed("cid", "first"), "cls").where("cid <> first").select("cid")
        again = written(again, "again")
        maybe, surely = sketch.split_by(every.where("text is not null").select("cid", "text"), "cid", again)
        self.texts = surely.unionByName(maybe.join(again, "cid", "left_anti"))
        self.members = members.select("cls", "id").join(first, "cls").select(F.col("cid").alias("cls"), "id")
        self.links = self._links()

    def _read(self) -> DataFrame:
        """Each record with its class (a hash of its set); the text and a number where its task meets the class first; and
        the partial sketches of how often shingles occur."""
        words, least = self.words, self.least_tokens
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), None, pa.string(), pa.int32(), pa.int32(), pa.binary()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            rows: list[pa.RecordBatch] = []
            base = TaskContext.get().partitionId() << 33
            kind = pa.string()

            def read() -> Iterator[np.ndarray]:
                nonlocal kind
                for batch in batches:
                    kind = batch.column(0).type
                    for first, row, hashes in _sets(batch.column(1), words, least):
                        if len(row):
                            starts, cls, n = _classes(row, hashes)
                            fresh = np.zeros(len(cls), bool)
                            for k, c in enumerate(cls.tolist()):
                                if c not in seen:
                                    seen.add(c)
                                    fresh[k] = True
                            cid = base + len(seen) - fresh.sum() + np.cumsum(fresh) - 1
                            record = pa.array(first + row[starts])
                            text = pc.if_else(pa.array(fresh), batch.column(1).take(record).cast(pa.string()), pa.scalar(None, pa.string()))
                            rows.append(_batch({"cid": pa.array(cid, mask=~fresh), "cls": pa.array(cls.view(np.int64)), "n": pa.array(n.astype(np.int32)), "id": batch.column(0).take(record), "text": text}, len(cls)))
                        yield hashes

            def _batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([columns.get(x, None) if x in columns else pa.nulls(n, t or kind) for x, t in zip(names, types)], names)

            total = np.zeros(1 << ORDER_BITS, np.uint32)
            for hashes in read():
                total += np.bincount(sketch.buckets(hashes, ORDER_BITS), minlength=1 << ORDER_BITS).astype(np.uint32)
                yield from rows
                rows.clear()
            for part in sketch.packed_counts(total):
                yield _batch({x: part.column(x) for x in ("block", "part", "data")}, part.num_rows)

        return written(self.records.mapInArrow(run, RECORDS.format(kind=self.records.schema["id"].dataType.simpleString())), "records")

    def _candidates(self) -> DataFrame:
        """Pairs of classes (a the smaller set) that have enough keys in common, at positions that allow the overlap."""
        words, least, threshold, counts, most = self.words, self.least_tokens, self.threshold, self.counts, self.long_list
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # some for each task, so that they fill alike, but entries enough for a block
        ranges = 1 << min(20, max(4, min(8 * tasks - 1, max(4095, 2 * tasks - 1)).bit_length()))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[tuple[np.ndarray, ...]] = []
            held = 0
            long = max(most, LONG_SHARE * counts.value.mean())
            for batch in batches:
                cids = batch.column(0).to_numpy()
                for first, row, hashes in _sets(batch.column(1), words, least):
                    if not len(row):
                        continue
                    row, hashes, at, size, times = _ordered(row, hashes, counts.value)
                    for a, b, key, small in _keys(row, hashes, at, size, threshold):
                        entry, key = _salted(b, key, np.minimum(times[a], times[b]), cids[first + row], long)
                        b = b[entry]
                        parts.append((key, cids[first + row[b]], at[b], size[b], small[entry]))
                        held += len(key)
                        if held >= PACKED:
                            yield packed(*(np.concatenate(x) for x in zip(*parts)), ranges)
                            parts, held = [], 0
            if held:
                yield packed(*(np.concatenate(x) for x in zip(*parts)), ranges)

        def pairs_of(table: pa.Table) -> pa.Table:
            found = [pa.table(list(x), names=["a", "b", "na", "nb", "times"]) for x in met(*unpacked(table.column("data").to_pylist()), threshold)]
            return pa.concat_tables(found).cast(kinds) if found else kinds.empty_table()

        kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("times", pa.int64())])
        pairs = self.texts.mapInArrow(blocks, "range int, data binary").groupBy("range").applyInArrow(pairs_of, PAIRS)
        # salted lists may count a key again, so the sum is no less than the number of keys
        pairs = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("times").alias("common"))
        return pairs.where(F.col("common") >= _common_keys(F.col("na"))).drop("common")

    def _overlaps(self, pairs: DataFrame) -> DataFrame:
        """The pairs with the size of their overlap, counted in full."""
        left = self.sets.select(F.col("cls").alias("a"), F.col("shingles").alias("of_a"))
        right = self.sets.select(F.col("cls").alias("b"), F.col("shingles").alias("of_b"))
        return pairs.join(left, "a").join(right, "b").withColumn("overlap", F.size(F.array_intersect("of_a", "of_b"))).drop("of_a", "of_b")

    def _links(self) -> DataFrame:
        """(a, b) of alike classes of different sets."""
        t = self.threshold
        pairs = written(self._candidates(), "candidates")
        self.sets = self._sets_of(pairs)
        leaders = self.sets.groupBy("near").agg(F.min(F.struct("cls", "n")).alias("lead")).select("near", F.col("lead.cls").alias("lead"), F.col("lead.n").alias("nl"))
        led = self.sets.select("cls", "near").join(leaders, "near").select("cls", "lead", "nl")
        pairs = pairs.join(led.select(F.col("cls").alias("a"), F.col("lead").alias("la"), F.col("nl").alias("nla")), "a").join(led.select(F.col("cls").alias("b"), F.col("lead").alias("lb"), F.col("nl").alias("nlb")), "b")
        pairs = written(pairs, "led")

        plain = pairs.where("a = la and b = lb").select("a", "b", "na", "nb")
        follow = pairs.where("a <> la").select("a", F.col("la").alias("b"), "na", F.col("nla").alias("nb")).unionByName(pairs.where("b <> lb").select(F.col("b").alias("a"), F.col("lb").alias("b"), F.col("nb").alias("na"), F.col("nlb").alias("nb"))).distinct()
        known = written(self._overlaps(plain.withColumn("follow", F.lit(False)).unionByName(follow.withColumn("follow", F.lit(True)))), "known")

        own = known.where("follow").select(F.col("a").alias("cls"), F.col("overlap").alias("own"))
        between = known.where("not follow").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("overlap").alias("leads"))
        rest = pairs.where("a <> la or b <> lb").withColumn("x", F.least("la", "lb")).withColumn("y", F.greatest("la", "lb"))
        rest = rest.join(own.select(F.col("cls").alias("a"), F.col("own").alias("oa")), "a", "left").join(own.select(F.col("cls").alias("b"), F.col("own").alias("ob")), "b", "left").join(between, ["x", "y"], "left")
        rest = rest.withColumn("oa", F.coalesce("oa", "na")).withColumn("ob", F.coalesce("ob", "nb"))
        least_leads = F.when(F.col("la") == F.col("lb"), F.col("nla")).otherwise(F.col("leads"))
        most_leads = F.coalesce(least_leads, _needed_column("nla", "nlb", t) - 1)  # leaders that are no candidates are not alike
        least = F.coalesce(least_leads - (F.col("nla") - F.col("oa")) - (F.col("nlb") - F.col("ob")), F.lit(0))
        most = most_leads + (F.col("na") - F.col("oa")) + (F.col("nb") - F.col("ob"))
        rest = rest.withColumn("needed", _needed_column("na", "nb", t)).withColumn("least", least).where(most >= F.col("needed"))
        settled = rest.where("least >= needed").select("a", "b")
        open_pairs = self._overlaps(rest.where("least < needed").select("a", "b", "na", "nb"))
        counted = known.where("not follow").select("a", "b", "na", "nb", "overlap").unionByName(open_pairs)
        return written(settled.unionByName(counted.where(F.col("overlap") >= _needed_column("na", "nb", t)).select("a", "b")), "links")

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        """(cls, n, near, shingles) of the classes that occur in ``pairs``."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        words, least, counts = self.words, self.least_tokens, self.counts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, row, hashes in _sets(batch.column(1), words, least):
                    if len(row):
                        row, hashes, at, _, _ = _ordered(row, hashes, counts.value)
                        starts = np.flatnonzero(at == 0)
                        offsets = pa.array(np.r_[starts, len(row)].astype(np.int32))
                        near = np.add.reduceat(np.where(at < NEAR, mix(hashes), np.uint64(0)), starts)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row[starts])), pa.array(np.diff(np.r_[starts, len(row)]).astype(np.int32)), pa.array(near.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], ["cls", "n", "near", "shingles"])

        wanted = written(wanted, "wanted")
        texts = sketch.split_by(self.every.where("text is not null").select("cid", "text"), "cid", wanted)[0].join(wanted, "cid", "left_semi")
        return written(texts.mapInArrow(run, "cls long, n int, near long, shingles array<long>"), "sets")


def _joined(records: DataFrame, threshold: float, words: int, least_tokens: int, id_column: str, text: str, **more: int) -> tuple[DataFrame, DataFrame]:
    done = Joined(records, threshold, words, least_tokens, id_column, text, **more)
    return done.members.select("cls", "id").distinct(), done.links


def similar_pairs(records: DataFrame, threshold: float = 0.8, words: int = 5, least_tokens: int = 5, id_column: str = "doc_id", text: str = "text", **more: int) -> DataFrame:
    """(a, b), a < b: every two records whose sets of shingles are alike, copies included.

    Records with a null id, a null text or fewer than ``least_tokens`` tokens are in no pair; repeated rows count once;
    other columns are ignored. The number of pairs is that of the definition; ``similar_groups`` gives one row a record.
    """
    members, links = _joined(records, threshold, words, least_tokens, id_column, text, **more)
    one, two = members.select("cls", F.col("id").alias("one")), members.select("cls", F.col("id").alias("two"))
    copies = one.join(two, "cls").where("one < two").select(F.col("one").alias("a"), F.col("two").alias("b"))
    linked = links.join(one.withColumnRenamed("cls", "a"), "a").join(two.withColumnRenamed("cls", "b"), "b")
    return copies.unionByName(linked.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).where("a <> b")).distinct()


def similar_groups(records: DataFrame, threshold: float = 0.8, words: int = 5, least_tokens: int = 5, id_column: str = "doc_id", text: str = "text", **more: int) -> DataFrame:
    """(id, class_id, copies, links): one row per record, with the least id of its class of equal sets, the size of that
    class, and the number of records of other classes alike to it. Records without a set are alone in their class."""
    members, links = _joined(records, threshold, words, least_tokens, id_column, text, **more)
    classes = members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("cls").alias("b"), "copies"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("copies").alias("links"))
    every = records.select(F.col(id_column).alias("id")).where("id is not null").distinct()
    found = members.join(classes, "cls").join(linked, "cls", "left").groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("copies").alias("copies"), F.max("links").alias("links"))
    return every.join(found, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
