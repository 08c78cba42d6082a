"""Operator 2: byte-balanced sharding by histogram sort.

Documents are ordered by (identifier, hash of the text). A narrow table of keys and exact sizes is written once. Then,
round by round, every partition counts the bytes and rows below candidate boundaries, the counts are summed, and each
splitter's interval shrinks to the two candidates around its target, until the bytes below a candidate are within
tolerance or the interval is a single key. After that the documents move once.

Each shard is cut into ``parts`` ranges, so a task handles a part of a shard, never all of it. The rounds find at most
``COARSE`` splitters, so what a round probes and brings to the driver is bounded, however large the table. Where a range of
these is still larger than a task should take, its keys, and only they, are sorted in one task a range and cut every
``part_bytes``; these finer boundaries go to the tasks as sixteen bytes for each ``part_bytes`` of text.

Defined results: null text has size 1; a null identifier counts as the smallest one; rows with the same identifier and
text are neighbours in no particular order, and if they alone outweigh a range they are dealt over the ranges they span;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written

MASK = (1 << 64) - 1
LEAST_ID = -(1 << 63)
#: Bytes of a range where a shard is large, and the most ranges that the rounds find.
PART_BYTES, COARSE = 128 << 20, 512


def _wide(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a batch as two unsigned 64-bit halves that order like (doc_id, tie), null as the smallest doc_id."""
    high = batch.column(0).fill_null(LEAST_ID).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    low = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return high, low


def _halves(bounds: list[int]) -> np.ndarray:
    """Ascending 128-bit bounds as rows of two halves; no key lies at or above a bound of more bits, so these are left out."""
    return np.array([(x >> 64, x & MASK) for x in bounds if x >> 128 == 0], np.uint64).reshape(-1, 2)


def _below(high: np.ndarray, low: np.ndarray, bounds: np.ndarray, side: str = "right") -> np.ndarray:
    """For each key, how many of the ascending bounds are at or below it; with side left, how many are below it."""
    if not len(bounds):
        return np.zeros(len(high), np.int64)
    begin, end = np.searchsorted(bounds[:, 0], high, "left"), np.searchsorted(bounds[:, 0], high, "right")
    out = begin.astype(np.int64)
    same = end > begin  # the low half decides
    for b in np.unique(begin[same]):
        rows = same & (begin == b)
        out[rows] += np.searchsorted(bounds[b : end[rows][0], 1], low[rows], side)
    return out


def _counts(keys: DataFrame, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each bound."""
    n, halves = len(bounds) + 1, _halves(bounds)

    def count(batches):
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            at = _below(*_wide(batch), halves)
            size += np.bincount(at, batch.column(2).to_numpy(zero_copy_only=False), n).astype(np.int64)
            rows += np.bincount(at, minlength=n)
        k = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(size[k]), pa.array(rows[k])], ["k", "size", "rows"])

    got = keys.mapInArrow(count, "k long, size long, rows long").groupBy("k").agg(F.sum("size"), F.sum("rows")).collect()
    size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, s, r in got:
        size[k], rows[k] = s, r
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(keys: DataFrame, ranges: int, tolerance: float = 0.001, probes: int = 16) -> tuple[list[int], dict[int, tuple[int, np.ndarray]]]:
    """Boundaries of ``ranges`` ranges of near equal bytes over ``keys`` (doc_id, tie, size).

    Returns the ascending boundaries, and for each key that by itself spans several ranges the first of these and the
    share of the key's bytes that each should get.
    """
    total, least, most, nulls, rows = keys.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    if total is None:
        return [], {}
    first = 0 if nulls or least is None else (least - LEAST_ID) << 64
    end = ((most if most is not None else LEAST_ID) - LEAST_ID + 1) << 64  # may have 129 bits
    targets = [total * i // ranges for i in range(1, ranges)]
    low, high = [(first, 0, 0)] * len(targets), [(end, total, rows)] * len(targets)  # boundary, bytes and rows below it
    near = tolerance * total / ranges

    def open_(i: int) -> bool:
        (a, x, r), (b, y, s) = low[i], high[i]
        return b - a > 1 and s - r > 1 and min(targets[i] - x, y - targets[i]) > near

    while todo := [i for i in range(len(targets)) if open_(i)]:
        tried = sorted({low[i][0] + (high[i][0] - low[i][0]) * j // (probes + 1) for i in todo for j in range(1, probes + 1)})
        sizes, counts = _counts(keys, tried)
        for i in todo:  # bytes below ascend with the boundaries, so one search finds the two around the target
            k = int(np.searchsorted(sizes, targets[i], "right"))
            if k > 0:
                low[i] = max(low[i], (tried[k - 1], int(sizes[k - 1]), int(counts[k - 1])))
            if k < len(tried):
                high[i] = min(high[i], (tried[k], int(sizes[k]), int(counts[k])))
    bounds, heavy = [], {}
    for i, target in enumerate(targets):
        (a, x, r), (b, y, s) = low[i], high[i]
        if b - a == 1 and s - r > 1 and min(target - x, y - target) > near:
            bounds.append(a)
            heavy.setdefault(a, [x, y, []])[2].append(i)
        else:
            bounds.append(a if target - x <= y - target else b)
    out = {}
    for key, (x, y, at) in heavy.items():
        edges = [x, *(targets[i] for i in at), y]
        out[key] = at[0], np.diff(edges) / (y - x)
    return bounds, out


def _finer(keys: DataFrame, place, ranges: int, part_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(halves, first of each range): boundaries within the ``ranges`` of ``place``, one for each ``part_bytes`` passed.

    A key that passes several has its boundary as often. One exchange of the keys, a task for each range.
    """
    ranged = keys.mapInArrow(place, "doc_id long, tie long, size long, range int").repartitionById(ranges, "range")
    order = [F.coalesce("doc_id", F.lit(LEAST_ID)), "tie"]

    def cut(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                size = np.cumsum(batch.column(2).to_numpy(zero_copy_only=False)) + total
                times = size // part_bytes - np.append(total, size[:-1]) // part_bytes
                total = int(size[-1])
                at = np.repeat(np.arange(batch.num_rows), times)
                signed = [(half ^ np.uint64(1 << 63)).view(np.int64)[at] for half in _wide(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(at)), *map(pa.array, signed)], ["range", "high", "low"])

    table = ranged.sortWithinPartitions("range", *order).mapInArrow(cut, "range int, high long, low long").toArrow()
    table = table.sort_by([("range", "ascending"), ("high", "ascending"), ("low", "ascending")])
    halves = np.stack([table[c].to_numpy().view(np.uint64) ^ np.uint64(1 << 63) for c in ("high", "low")], axis=1)
    return halves, np.searchsorted(table["range"].to_numpy(), np.arange(ranges + 1))


def shard(docs: DataFrame, shards: int = 8, parts: int | None = None, tolerance: float = 0.001, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) with size, shard, range and here (its place in the range); the texts move once.

    ``parts``: ranges a shard; by default of ``part_bytes``, and eight at least. Ranges ascend with the shards.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    keys = written(rows.select("doc_id", tie.alias("tie"), size.alias("size")), "shard-keys")
    if parts is None:
        parts = max(8, (keys.agg(F.sum("size")).first()[0] or 0) // (shards * part_bytes))
    coarse = min(parts, max(1, COARSE // shards))
    bounds, heavy = splitters(keys, shards * coarse, tolerance)
    assert all(a <= b for a, b in zip(bounds, bounds[1:])), "targets ascend, and so do their boundaries"
    halves = _halves(bounds)

    def put(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        at = _below(high, low, halves)
        for key, (begin, share) in heavy.items():
            if key >> 128 == 0:
                same = np.flatnonzero((high == np.uint64(key >> 64)) & (low == np.uint64(key & MASK)))
                turn = (np.arange(1, len(same) + 1) * 0.6180339887498949) % 1.0
                at[same] = begin + np.minimum(np.searchsorted(np.cumsum(share), turn, "right"), len(share) - 1)
        return at

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(put(*_wide(batch)), pa.int32())], [*batch.schema.names, "range"])

    finer, first = _finer(keys, place, shards * coarse, part_bytes) if coarse < parts else (np.zeros((0, 2), np.uint64), np.zeros(shards * coarse + 1, np.int64))
    total = shards * coarse + len(finer)

    def place_finer(batches):
        """A range is followed by those its boundaries cut off; a key that is several boundaries is dealt over their ranges."""
        for batch in batches:
            high, low = _wide(batch)
            at = put(high, low)
            out = at + first[at]
            for k in np.unique(at[first[at] < first[at + 1]]).tolist():
                own, cuts = np.flatnonzero(at == k), finer[first[k] : first[k + 1]]
                after = _below(high[own], low[own], cuts)
                several = after - _below(high[own], low[own], cuts, "left")
                turn = (np.arange(1, len(own) + 1) * 0.6180339887498949) % 1.0
                out[own] += np.where(several > 1, after - (turn * several).astype(np.int64), after)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at // coarse, pa.int32()), pa.array(out, pa.int32())], [*batch.schema.names, "shard", "range"])

    placed = rows.select("doc_id", tie.alias("tie"), size.alias("size"), "text").mapInArrow(place_finer, "doc_id long, tie long, size long, text string, shard int, range int")
    moved = placed.repartitionById(total, "range")
    here = F.row_number().over(Window.partitionBy("range").orderBy(F.coalesce("doc_id", F.lit(LEAST_ID)), "tie")) - 1
    return moved.withColumn("here", here.cast("long")).drop("tie")


def slots(moved: DataFrame) -> DataFrame:
    """``moved`` (a written table) with slot, gapless from 0 within the shard: the rows of its ranges before, and here."""
    counts = written(moved.groupBy("shard", "range").agg(F.count("*").alias("n")), "shard-ranges")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("range").alias("base_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return moved.join(bases, F.col("range") == F.col("base_range")).withColumn("slot", F.col("base") + F.col("here")).drop("base_range", "base")
