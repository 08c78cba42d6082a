"""Links of near copies by the Jaccard similarity of their word shingles, for ``simhash.deduplicate``.

A fingerprint of 64 bits can't tell similarities of 0.8 from those far below: at 0.8 some ten of its bits differ. So the
fingerprint here is wide, the minima of 160 hash functions over a text's shingles, and split into 32 stretches of five; texts
that share a stretch are candidates. Two of similarity s share none with probability (1 - s^5)^32, 3e-6 at 0.8 and less
above. Candidates are compared shingle by shingle, in tiles of at most two chunks of texts, in two passes:

* The candidates' components are clusters, and a cluster's texts fall into chunks by a hash. Each chunk is compared with
  itself and with the first chunk. For a cluster of one chunk that is all; in a large one it joins what is alike by work that
  grows with its size and not with the square of it.
* Where texts of a large cluster are still apart, those outside the cluster's largest group are compared with one another and
  with that group, in larger tiles; beyond WHOLE texts, only those that share a stretch are, stretch by stretch. So no two
  candidates go uncompared that are not joined already.

Classes of the 64-bit fingerprints' balls (module ``simhash``) are one stretch more: who is in one is a candidate too.

No cluster or stretch is gathered in one task. Texts with the same shingles are one node.

Defined results: ASCII letters are lower-cased and words split at ASCII white space; a text of fewer words than a shingle has
one shingle, all of it; null or wordless texts have none and are copies of each other alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import computed, texts_of, written
from .components import components

STRETCHES, WIDTH, SEED = 32, 5, 42
#: Texts of a chunk, about, and shingles compared at once; bound memory and not results.
CHUNK, COLUMNS = 128, 1 << 12
#: Chunks of the first pass that are one of the second, and texts of a cluster that are compared whole there.
LATER, WHOLE = 4, 8192
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, STRETCHES * WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int) -> set[bytes]:
    found = text.encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def _digests(text: str, words: int) -> tuple[bytes, list[int]]:
    """A digest of the shingles, and one of each stretch; none if there are no shingles."""
    hashes = np.array(sorted(map(xxhash.xxh64_intdigest, shingles(text, words))), np.uint64)
    if not len(hashes):
        return b"", []
    least = np.minimum.reduce([(hashes[i : i + 2048, None] * _FACTORS).min(0) for i in range(0, len(hashes), 2048)])
    stretches = [xxhash.xxh64_intdigest(s.tobytes(), i) for i, s in enumerate(least.reshape(STRETCHES, WIDTH))]
    return xxhash.xxh3_128_digest(hashes.tobytes()), np.array(stretches, np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, carry: list[str], words: int, text: str, fingerprint: Callable[[str, int], int]) -> DataFrame:
    """A written table: ``carry``, a unique number of the row, fp, the digest of its shingles, the stretches, and bits, the fingerprint."""

    def compute(texts):
        found = [_digests(t, words) for t in texts]
        bits = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
        return [pa.array([d for d, _ in found], pa.binary()), pa.array([s for _, s in found], pa.list_(pa.int64())), pa.array(bits)]

    fields = [T.StructField("fp", T.BinaryType()), T.StructField("stretches", T.ArrayType(T.LongType())), T.StructField("bits", T.LongType())]
    return written(computed(docs, carry, fields, compute, text).withColumn("row", F.monotonically_increasing_id()), "signatures")


def near(left: list[str], right: list[str], words: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places in ``left + right``, enough to join all similar texts of which one at least is in ``left``."""
    numbers: dict[bytes, int] = {}
    sets = [np.array([numbers.setdefault(s, len(numbers)) for s in shingles(t, words)], np.int64) for t in left + right]
    sizes, n = np.array([len(s) for s in sets]), len(left)
    shared = np.bincount(np.concatenate(sets), minlength=len(numbers)) > 1  # a shingle of one text is common to none
    number, columns = np.cumsum(shared) - 1, int(shared.sum())
    del numbers
    sets = [np.sort(number[s[shared[s]]]) for s in sets]
    common = np.zeros((n, len(sets)), np.float32)  # counts of shingles, far below 2^24
    for begin in range(0, columns, COLUMNS):
        has = np.zeros((len(sets), min(COLUMNS, columns - begin)), np.float32)
        for k, s in enumerate(sets):
            has[k, s[np.searchsorted(s, begin) : np.searchsorted(s, begin + COLUMNS)] - begin] = 1
        common += has[:n] @ has.T
    root, out = list(range(len(sets))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    union = np.maximum(sizes[:n, None] + sizes[None, :] - common, 1)
    for a, b in np.argwhere(common.astype(np.float64) / union >= similarity):
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            out.append((a, b))
    return out


def _chunks(n: Column, times: int = 1) -> Column:
    return F.ceil(n / (CHUNK * times)).cast("int")


def _chunk_of(node: Column, n: Column, times: int = 1) -> Column:
    return F.pmod(F.xxhash64(node), F.greatest(_chunks(n, times), F.lit(1))).cast("int")


def _places(pairs: Column) -> Column:
    """Places in tiles, an array of (tile, second), as rows."""
    return F.inline(pairs)


def _struct(tile: Column, second: bool) -> Column:
    return F.struct(tile.cast("string").alias("tile"), F.lit(second).alias("second"))


def _upto(first: Column, last: Column, each) -> Column:
    """An array of ``each`` number from ``first`` to ``last``, empty if there is none."""
    return F.when(first <= last, F.transform(F.sequence(first, last), each)).otherwise(F.array().cast("array<struct<tile: string, second: boolean>>"))


def first_tiles(placed: DataFrame) -> DataFrame:
    """(node, group, tile, second): each chunk of a cluster, and with it the first chunk."""
    last = _chunks(F.col("n")) - 1
    with_all = _upto(F.lit(1), F.when(F.col("chunk") == 0, last).otherwise(0), lambda j: _struct(j, True))
    return placed.select("node", F.col("root").alias("group"), _places(F.concat(F.array(_struct(F.col("chunk"), False)), with_all)))


def later_tiles(members: DataFrame) -> DataFrame:
    """(node, group, tile, second) of members (node, label, s): of each s, all but the largest label's with all."""
    counts = written(members.groupBy("s", "label").agg(F.count("*").alias("m")), "stretch-labels")
    mixed = counts.groupBy("s").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.max("m").alias("mains"), F.sum("m").alias("n"), F.count("*").alias("labels"))
    mixed = written(mixed.where("labels > 1").select(F.col("s").alias("t"), "main", "mains", (F.col("n") - F.col("mains")).alias("others")), "mixed-stretches")
    rows = members.join(mixed, F.col("s") == F.col("t")).withColumn("is_main", F.col("label") == F.col("main"))
    chunk = F.when(F.col("is_main"), _chunk_of(F.col("node"), F.col("mains"), LATER)).otherwise(_chunk_of(F.col("node"), F.col("others"), LATER))
    rows = rows.withColumn("chunk", chunk)
    others, mains, own = _chunks(F.col("others"), LATER), _chunks(F.col("mains"), LATER), F.col("chunk")
    name = lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))
    of_main = _upto(F.lit(0), others - 1, lambda i: _struct(F.concat(F.lit("m"), name(i, own)), True))
    of_other = F.concat(
        _upto(own, others - 1, lambda j: _struct(F.concat(F.lit("o"), name(own, j)), False)),
        _upto(F.lit(0), own - 1, lambda i: _struct(F.concat(F.lit("o"), name(i, own)), True)),
        _upto(F.lit(0), mains - 1, lambda j: _struct(F.concat(F.lit("m"), name(own, j)), False)),
    )
    return rows.select("node", F.col("s").alias("group"), _places(F.when(F.col("is_main"), of_main).otherwise(of_other)))


def compared(tiles: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Verified links (a, b) within tiles."""

    def compare(tile: pa.Table) -> pa.Table:
        found, second, node = texts_of(tile["text"]), tile["second"].to_pylist(), tile["node"].to_pylist()
        left, right = ([k for k, s in enumerate(second) if s == side] for side in (False, True))
        pairs = near([found[k] for k in left], [found[k] for k in right], words, similarity)
        at = [node[k] for k in left + right]
        return pa.table({"a": pa.array([at[a] for a, _ in pairs], pa.int64()), "b": pa.array([at[b] for _, b in pairs], pa.int64())})

    return tiles.join(texts, F.col("node") == F.col("row")).select("node", "group", "tile", "second", "text").groupBy("group", "tile").applyInArrow(compare, "a long, b long")


def later_members(large: DataFrame, labels: DataFrame, stretches: DataFrame) -> DataFrame:
    """(node, label, s) for later_tiles of large clusters' texts (node, root, n): s is the cluster, or a stretch of a very large one."""
    known = labels.select(F.col("node").alias("labelled"), F.col("root").alias("label"))
    members = large.join(known, F.col("node") == F.col("labelled"), "left").select("node", "root", "n", F.coalesce("label", "node").alias("label"))
    split = members.where(F.col("n") > WHOLE).join(stretches, F.col("node") == F.col("row")).select("node", "label", "s")
    return members.where(F.col("n") <= WHOLE).select("node", "label", F.col("root").alias("s")).unionAll(split)


def links(table: DataFrame, nodes: DataFrame, balls: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """Verified links (a, b), enough to join all of ``nodes`` (node, fp; node is a row of ``table``) that are similar.

    ``balls``: (row, s), the class of each row's fingerprint.
    """
    own = table.select("row", "stretches").join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi").select("row", F.explode("stretches").alias("s"))
    stretches = own.unionAll(balls.join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi").select("row", "s"))
    met = written(stretches.groupBy("s").agg(F.min("row").alias("b"), F.count("*").alias("n")).where("n > 1").select(F.col("s").alias("t"), "b"), "met")
    clusters = components(stretches.join(met, F.col("s") == F.col("t")).select(F.col("row").alias("a"), "b"))
    sizes = written(clusters.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n")), "cluster-sizes")
    placed = clusters.join(sizes, F.col("root") == F.col("r")).select("node", "root", "n", _chunk_of(F.col("node"), F.col("n")).alias("chunk"))
    placed = written(placed, "cluster-chunks")
    texts = written(table.select("row", F.col(text).cast("string").alias("text")).join(placed.select("node"), F.col("row") == F.col("node"), "left_semi"), "near-texts")
    found = compared(first_tiles(placed), texts, words, similarity)
    large = placed.where(_chunks(F.col("n")) > 1).select("node", "root", "n")
    if large.isEmpty():
        return found
    found = written(found, "near-links")
    members = written(later_members(large, components(found), stretches), "near-members")
    return found.unionAll(compared(later_tiles(members), texts, words, similarity))


def roots(table: DataFrame, balls: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """(fp, root) of every digest of ``table``; the root, a row's number, tells components apart."""
    nodes = written(table.groupBy("fp").agg(F.min("row").alias("node")), "shingle-nodes")
    found = components(links(table, nodes, balls, text, words, similarity)).withColumnRenamed("node", "n")
    return nodes.join(found, F.col("node") == F.col("n"), "left").select(F.col("fp").alias("__fp"), F.coalesce("root", "node").alias("root"))
