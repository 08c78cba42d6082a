"""Operator 5: exact deduplication by content-defined chunk recipes.

A text, less its ASCII white space, is cut where a rolling hash of the last 32 bytes has a fixed pattern, so that equal
stretches give equal chunks wherever they stand. A chunk's identifier is a 128-bit digest. The chunks themselves move
once, each distinct one once from each task, to be held against all others of the same digest; a digest that stands for
two different chunks is spelled out, chunk and all, in the recipes. Texts are then equal exactly if their ordered lists of
identifiers are, and only these short lists are grouped and joined.

Defined results: null counts as empty, and empty texts are one group; of rows that agree in length and doc_id too, one
stays; a null doc_id yields to any other; an empty table gives no rows; other columns are carried by ``deduplicate`` and
ignored by ``groups``.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import computed, named, numbered, prepare, texts_of, written

SPACES = b" \t\n\x0b\f\r"
LEAST, USUAL, MOST = 512, 2048, 16384
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 7) for i in range(256)], np.uint32)
#: Digests spelled out by name; with more, every chunk is.
SPELLED = 100_000
#: Bytes of chunks that a task holds against repeats.
HELD = 32 << 20


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks of LEAST to MOST bytes; the last may be shorter."""
    if len(data) <= LEAST:
        return [data] if data else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):  # the rolling sum over 32 bytes, doubled up
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    out, begin = [], 0
    for at in [*(np.flatnonzero(h < np.uint32(2**32 // USUAL)) + 1).tolist(), len(data)]:
        while at - begin > MOST:
            out.append(data[begin : begin + MOST])
            begin += MOST
        if at - begin >= LEAST or at == len(data) > begin:
            out.append(data[begin:at])
            begin = at
    return out


def _digest(chunk: bytes, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:size]


def recipe(data: bytes, size: int = 16, spelled: frozenset | None = frozenset()) -> bytes:
    """The ordered identifiers; of digests in ``spelled`` (None: of all), the chunk itself."""
    out = []
    for c in chunks(data):
        d = _digest(c, size)
        out += [b"\0", struct.pack("<I", len(c)), c] if spelled is None or d in spelled else [b"\1", d]
    return b"".join(out)


def ambiguous(docs: DataFrame, size: int = 16) -> DataFrame:
    """Digests that stand for more than one chunk, found by comparing the chunks themselves."""

    def run(batches):
        held, bytes_ = {}, 0
        for batch in batches:
            out = []
            for text in texts_of(batch.column(0)):
                for c in chunks(text.encode().translate(None, SPACES)):
                    d = _digest(c, size)
                    if held.get(d) != c:
                        out.append((d, c))
                        held[d] = c
                        bytes_ += len(c) + 100
            if bytes_ > HELD:
                held, bytes_ = {}, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["digest", "chunk"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "digest binary, chunk binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "digest").dropDuplicates(["digest", "chunk"]).groupBy("digest").count().where("count > 1").select("digest")


def recipes(docs: DataFrame, carry: list[str], size: int = 16, text: str = "text") -> DataFrame:
    """A written table: ``carry``, a unique number of the row, code points, sha256 of the normalised text, recipe."""
    prepare(docs.sparkSession)
    twice = ambiguous(docs.select(F.col(text).alias("text")), size).limit(SPELLED + 1).collect()
    spelled = frozenset(bytes(r.digest) for r in twice) if len(twice) <= SPELLED else None
    fields = [T.StructField("points", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("recipe", T.BinaryType())]

    def compute(texts):
        data = [t.encode().translate(None, SPACES) for t in texts]
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array([recipe(d, size, spelled) for d in data], pa.binary())]

    return written(computed(docs, carry, fields, compute, text).withColumn("row", F.monotonically_increasing_id()), "recipes")


def grouped(table: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(recipe, group_size, keep_id, keep_row) of each group: most code points, then smallest doc_id, stays."""
    best = F.max(F.struct("points", F.bitwise_not(F.col(doc_id)).alias("id"), F.bitwise_not("row").alias("row"))).alias("best")
    groups = table.groupBy(F.col("recipe").alias("__recipe")).agg(F.count("*").alias("group_size"), best)
    return groups.select("__recipe", "group_size", F.bitwise_not("best.id").alias("keep_id"), F.bitwise_not("best.row").alias("keep_row"))


def groups(docs: DataFrame, size: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    table = recipes(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], size)
    several = written(grouped(table).where("group_size > 1"), "copied")  # a table, so that the join may split a large group
    joined = table.join(several, F.col("recipe") == F.col("__recipe"), "left")
    alone = F.col("keep_row").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, size: int = 16) -> DataFrame:
    """One row of each group, with the columns of ``docs``."""
    rows, text = numbered(docs)
    table = recipes(rows, rows.columns, size, text)
    narrow = table.select(F.col(f"__in{docs.columns.index('doc_id')}").cast("long").alias("doc_id"), "points", "recipe", "row")
    several = written(grouped(narrow).where("group_size > 1"), "copied")
    lost = narrow.join(several, F.col("recipe") == F.col("__recipe")).where("row <> keep_row").select(F.col("row").alias("__lost"))
    return named(table.join(lost, F.col("row") == F.col("__lost"), "left_anti"), docs)
