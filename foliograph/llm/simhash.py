"""Operator 4: SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits itself and all 64 fingerprints one bit away, half the radius of two. Two fingerprints
differ in two bits or fewer exactly if they emit a common variant, and all that emit a variant are within two bits of one
another. A variant's senders are the variant with one bit or none changed, so its group is one 64-bit mask and a flag,
added up by bitwise or before and after the shuffle; no group is ever gathered. Each sender is linked to the least one of
its variant, the link is verified by its differing bits, and the components of the links are the classes.

Copies share a fingerprint and are joined once, by fingerprint, never paired.

Defined results: null or wordless text has fingerprint zero, which links like any other; the component is the smallest
doc_id reachable, null only if all are null; repeated rows get the same result; an empty table gives no rows; other columns
are carried by ``deduplicate`` and ignored by ``classes``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .common import computed, named, numbered, written
from .components import components

WORDS, SEED, BITS = 3, 42, 64
#: Variants that a task of the emission sends, about.
SENT = 2_000_000
_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)  # of a byte's values
_LANES = (np.arange(8) * 256).astype(np.int16)


def fingerprint(text: str, width: int = WORDS) -> int:
    """Bit i is set if over half the shingles' hashes have it. bytes.lower() and split() know ASCII alone."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash_(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    hashes = np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], "<u8")
    lanes = hashes.view(np.uint8).reshape(-1, 8).astype(np.int16) + _LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """A written table: ``carry``, a unique number of the row, and fp, the fingerprint as a signed integer."""

    def compute(texts):
        return [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

    return written(computed(docs, carry, [T.StructField("fp", T.LongType())], compute, text).withColumn("row", F.monotonically_increasing_id()), "fingerprints")


def links(nodes: DataFrame) -> DataFrame:
    """Verified links (a, b), enough to join all of ``nodes`` (fp, distinct) within two bits."""
    one = F.lit(1).cast("long")
    nodes = nodes.select("fp").repartition(1 + nodes.count() * (BITS + 1) // SENT)  # a small table, but 65 rows come of each of its rows
    variants = F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda i: F.struct(F.when(i == BITS, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, i))).alias("v"), i.alias("bit")))
    emitted = nodes.select(F.explode(variants).alias("x")).select("x.v", F.when(F.col("x.bit") == BITS, 0).otherwise(F.call_function("shiftleft", one, F.col("x.bit"))).cast("long").alias("mask"), (F.col("x.bit") == BITS).cast("int").alias("own"))
    met = emitted.groupBy("v").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).where(F.bit_count("mask") + F.col("own") > 1)
    senders = F.filter(F.transform(F.sequence(F.lit(0), F.lit(BITS)), lambda i: F.when(i == BITS, F.when(F.col("own") == 1, F.col("v"))).when(F.getbit("mask", F.least(i, F.lit(BITS - 1))) == 1, F.col("v").bitwiseXOR(F.call_function("shiftleft", one, i)))), lambda x: x.isNotNull())
    stars = met.select(senders.alias("s")).select(F.explode("s").alias("a"), F.array_min("s").alias("b"))
    return stars.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))


def roots(table: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``table``; the root, a fingerprint, tells components apart."""
    nodes = written(table.groupBy("fp").agg(F.min(doc_id).alias("least")), "fingerprint-nodes")
    found = components(links(nodes))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "fingerprint-roots")
    # aggregates are written before they are joined back: only then may the join split a large component
    least = written(rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")), "component-ids")
    return written(rooted.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("__fp"), "root", "component_id"), "fingerprint-components")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    table = fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    return table.join(roots(table), F.col("fp") == F.col("__fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """One row of each class, that of the smallest doc_id, with the columns of ``docs``.

    Without ``similarity`` the classes are those of the fingerprints. With it, texts of one such class are candidates, as are
    those that share a stretch of minima, and the classes are those of the links of all candidates whose shingles of ``words``
    words have at least that Jaccard similarity.
    """
    rows, text = numbered(docs)
    doc_id = F.col(f"__in{docs.columns.index('doc_id')}").cast("long").alias("doc_id")
    if similarity is None:
        table = fingerprints(rows, rows.columns, text, words)
        narrow = table.select(doc_id, "fp", "row")
        rooted = roots(narrow)
    else:
        table = jaccard.signatures(rows, rows.columns, words, text, fingerprint)
        narrow = table.select(doc_id, "fp", "row")
        met = roots(table.select(F.col("bits").alias("fp"), "row"), "row").select("__fp", F.xxhash64("root").alias("s"))
        balls = written(table.select("row", "bits").join(met, F.col("bits") == F.col("__fp")).select("row", "s"), "fingerprint-balls")
        rooted = jaccard.roots(table, balls, text, words, similarity)
    placed = written(narrow.join(rooted, F.col("fp") == F.col("__fp")).select("doc_id", "row", "root"), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("first")
    heads = written(placed.groupBy(F.col("root").alias("__root")).agg(first, F.count("*").alias("rows")).where("rows > 1"), "component-heads")
    lost = placed.join(heads, F.col("root") == F.col("__root")).where("row <> first.row").select(F.col("row").alias("__lost"))
    return named(table.join(lost, F.col("row") == F.col("__lost"), "left_anti"), docs)
