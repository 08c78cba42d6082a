"""Random forests of pyspark.ml, grown on the distinct rows of a table.

Features of blocks repeat: few sizes, few lengths. So equal rows are counted once by an aggregate, the counted rows go to all
tasks, and each task grows whole trees. A tree's bootstrap is a Poisson number of each row, and the sum of a row's copies
is one Poisson number of their count: the trees are of the same kind as those grown row by row, if not the same ones. Splits are
chosen as pyspark.ml does: 32 bins at most, Gini impurity of weighted rows, the square root of the features in each node, a least
count of rows in a leaf; leaves of one prediction under a node are merged into it. The trees are written as pyspark.ml writes a
model, and read as one.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct rows that are grown on this way, since each task holds all of them; a table of more goes to pyspark.ml row by row.
DISTINCT = 500_000
BINS = 32

NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def thresholds(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Between all values if there are few, else so that bins have about equal weights."""
    values, at = np.unique(values, return_inverse=True)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < BINS:
        return middle
    sums = np.cumsum(np.bincount(at, weights))
    stride, out = sums[-1] / BINS, []
    for k in range(1, len(values)):
        target = stride * (len(out) + 1)
        if abs(sums[k - 1] - target) < abs(sums[k] - target):
            out.append(middle[k - 1])
    return np.array(out)


def _gini(stats: np.ndarray) -> np.ndarray:
    return 1 - (stats**2).sum(-1) / np.maximum(stats.sum(-1) ** 2, 1e-300)


def _splits(code: np.ndarray, at: np.ndarray, weights: np.ndarray, raw: np.ndarray, stats: np.ndarray, counts: np.ndarray, leaf: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The best gain of each node by one feature, and its bin."""
    n, classes = stats.shape
    key = at * bins + code
    left = np.stack([np.bincount(key, weights[:, k], n * bins) for k in range(classes)], 1).reshape(n, bins, classes).cumsum(1)[:, :-1]
    rows = np.bincount(key, raw, n * bins).reshape(n, bins).cumsum(1)[:, :-1]
    right, total = stats[:, None] - left, stats.sum(1)[:, None]
    gain = _gini(stats)[:, None] - (left.sum(2) * _gini(left) + right.sum(2) * _gini(right)) / total
    gain = np.where((rows >= leaf) & (counts[:, None] - rows >= leaf), gain, -1.0)
    best = gain.argmax(1)
    return gain[np.arange(n), best], best


def grown(codes: np.ndarray, counts: np.ndarray, class_weights: np.ndarray, cuts: list[np.ndarray], settings, tree: int) -> list[dict]:
    """The nodes of one tree, each before its children, as pyspark.ml writes them."""
    rng = np.random.default_rng([settings.seed, tree])
    raw = rng.poisson(settings.share * counts)
    kept = raw.sum(1) > 0
    codes, weights, raw = codes[kept], raw[kept] * class_weights, raw[kept].sum(1)
    features, some = codes.shape[1], int(np.ceil(np.sqrt(codes.shape[1])))
    at, stats, sizes, gains, feature, place, left = np.zeros(len(codes), np.int64), [], [], [], [], [], []
    row, begin, n = np.arange(len(codes)), 0, 1
    for level in range(settings.depth + 1):
        own = np.stack([np.bincount(at, weights[row, k], n) for k in range(weights.shape[1])], 1)
        size = np.bincount(at, raw[row], n)
        gain, by, cut = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
        open_ = (_gini(own) > 1e-15) & (level < settings.depth)
        chosen = (rng.random((n, features)).argsort(1).argsort(1) < some) & open_[:, None]
        for f in range(features):
            nodes = np.flatnonzero(chosen[:, f])
            if len(nodes) and len(cuts[f]):
                number = np.full(n, -1)
                number[nodes] = np.arange(len(nodes))
                mine = number[at] >= 0
                of = row[mine]
                found, bins = _splits(codes[of, f], number[at[mine]], weights[of], raw[of], own[nodes], size[nodes], settings.leaf, len(cuts[f]) + 1)
                better = found > gain[nodes]
                gain[nodes[better]], by[nodes[better]], cut[nodes[better]] = found[better], f, bins[better]
        split = by >= 0
        first = np.where(split, begin + n + 2 * (np.cumsum(split) - 1), -1)
        for out, x in ((stats, own), (sizes, size), (gains, gain), (feature, by), (place, cut), (left, first)):
            out.append(x)
        if not split.any():
            break
        going = split[at]
        row, at = row[going], at[going]
        at = first[at] - begin - n + (codes[row, by[at]] > cut[at])
        begin, n = begin + n, 2 * int(split.sum())
    return _nodes(*map(np.concatenate, (stats, sizes, gains, feature, place, left)), cuts)


def _nodes(stats, sizes, gains, feature, place, left, cuts) -> list[dict]:
    predicted, impurity, left = stats.argmax(1), _gini(stats), left.copy()
    for k in range(len(left) - 1, -1, -1):  # children come after their parent
        a = left[k]
        if a >= 0 and left[a] < 0 and left[a + 1] < 0 and predicted[a] == predicted[a + 1]:
            left[k] = -1
    order, stack = [], [0]
    while stack:
        order.append(k := stack.pop())
        if left[k] >= 0:
            stack += [left[k] + 1, left[k]]
    number, out = {k: i for i, k in enumerate(order)}, []
    for i, k in enumerate(order):
        a, inner = left[k], left[k] >= 0
        split = {"featureIndex": int(feature[k]) if inner else -1, "leftCategoriesOrThreshold": [float(cuts[feature[k]][place[k]])] if inner else [], "numCategories": -1}
        out.append({
            "id": i, "prediction": float(predicted[k]), "impurity": float(impurity[k]), "impurityStats": stats[k].tolist(), "rawCount": int(sizes[k]), "gain": float(gains[k]) if inner else -1.0,
            "leftChild": number[a] if inner else -1, "rightChild": number[a + 1] if inner else -1, "split": split,
        })
    return out


def _folder(spark) -> str:
    """A new folder that driver and executors share; a local session may do without a setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        found = "file://" + tempfile.mkdtemp(prefix="foliograph-")
    if found is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{found.rstrip('/')}/forest-{uuid.uuid4().hex}"


def fit(rows: DataFrame, columns: list[str], label: str, settings, classifier: RandomForestClassifier) -> RandomForestClassificationModel | None:
    """A model of ``classifier``'s settings; none if the rows, without nulls and with __weight by label, have too many distinct values."""
    spark = rows.sparkSession
    names = [f"c{i}" for i in range(len(columns))]
    values = rows.select(*(F.col(c).cast("double").alias(n) for c, n in zip(columns, names)), F.col(label).cast("double").alias("label"), F.col("__weight").cast("double").alias("weight"))
    table = values.groupBy(*names, "label", "weight").count().limit(DISTINCT + 1).toArrow()
    found, weight, n = (table["label"].to_numpy(), table["weight"].to_numpy(), table["count"].to_numpy())
    if not 0 < len(found) <= DISTINCT or (found < 0).any() or (found % 1).any():
        return None
    of_class = found.astype(np.int64)
    class_weights = np.ones(of_class.max() + 1)
    class_weights[of_class] = weight
    data = np.stack([table[c].to_numpy() for c in names], 1)
    cuts = [thresholds(x, weight * n) for x in data.T]
    codes, at = np.unique(np.stack([np.searchsorted(c, x) for c, x in zip(cuts, data.T)], 1).astype(np.uint8), axis=0, return_inverse=True)
    counts = np.zeros((len(codes), len(class_weights)), np.int64)
    np.add.at(counts, (at.ravel(), of_class), n)
    shape = pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct([
        ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()),
        ("rightChild", pa.int32()), ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
    ]))])

    def grow(batches):
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                nodes = grown(codes, counts, class_weights, cuts, settings, tree)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(nodes), pa.int32()), pa.array(nodes, shape.field(1).type)], schema=shape)

    # the model's own description, of a fit to one row a class, with the trees put in its place
    folder = _folder(spark)
    zero = Vectors.dense([0.0] * len(columns))
    small = spark.createDataFrame([(zero, float(k), 1.0) for k in range(len(class_weights))], [classifier.getFeaturesCol(), classifier.getLabelCol(), "__weight"])
    classifier.fit(small.coalesce(1)).write().save(folder)
    spark.range(0, settings.trees, 1, min(settings.trees, 48)).mapInArrow(grow, NODES).write.mode("overwrite").parquet(f"{folder}/data")
    return RandomForestClassificationModel.load(folder)
