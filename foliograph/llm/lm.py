"""Operator 8: a hashed maximum-entropy language model with a class-factored softmax.

Tokens are the words of the lower-cased text and one end. A document's tokens are counted over the whole training part;
the counts give the baseline and the words' shares within their classes.

The model: P(token | history) = P(class | history) x P(token | class, context).

* Classes. The most frequent words ("named", a bounded number) are clustered by the common words they share documents
  with, and each cluster is cut into bands of frequency. Every other word, known or not, goes to its cluster's open class
  by its last two bytes, as those of the named words are clustered. The end is a class of its own. A word has the share
  (count + 1) / (sum of count + 1 over the class); an open class counts one unseen word besides.
* P(class | history) is a softmax over hashed features: the word before (if frequent, else its class), the class two
  before and the cluster three before (skips), the pair of the word before and the class two before (n-gram), and a bias.
* P(token | class, context) is proportional to the word's share times the weight of one hashed n-gram feature: the word and
  its context, the words before it back to the first that is not one of the 1,024 most frequent, four at most. There is
  such a feature for every word of the head in every context that training has, so what is learnt grows with the corpus.
* Training the classes. All a document contributes is how often each class follows each history signature. These counts
  are added up over all training tokens into one table, and each gradient step is a job over it: tasks compute expected
  counts of features and classes, the driver adds up a bounded number of arrays of the model's size and moves the weights
  by the difference to the observed counts, scaled by their size. The table's size is bounded by the number of signatures.
* Training the words. With a penalty of DISCOUNT for each unit of weight, the gradient of a feature is its observed count
  less DISCOUNT less its expected one, and it falls apart by context and class: its zero is one expression over the counts
  of a context. So tokens are sent once, as hashes, to the task of their context, which counts, solves and answers with
  sums by document. Contexts end at a rare word, so none gathers a large part of all tokens; the number of tasks follows
  the tokens.
* Scoring goes over batches of documents: the distinct signatures of a batch are looked up once, in numpy.

Words of the bounded head come with the tasks; all others are joined to the counts by the word, so vocabularies of any
size do. Only counts of counts, the head and arrays of the model's size come to the driver. A context and its
class are 32 bits within the task they fall to, of which there are as many as the tokens ask for; what collides is one.

Defined results: null or empty text is the end alone; a null doc_id counts as the empty text for the held-out rule and is
in the training part; repeated rows count as often as they occur; with no training rows all probabilities are those of
add-one smoothing over nothing (base_score 0 and score 0); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import filesystem, prepare, scratch, texts_of, written

#: Words whose counts come with the tasks, named words, words that are features, common words for clusters: at most.
HEAD, NAMED, WORDS, COMMON = 200_000, 4096, 1024, 64
CLUSTERS, BANDS = 6, 4
END = CLUSTERS * (BANDS + 1)  # class: cluster * BANDS + band, then the open classes, then the end
CLASSES = END + 2  # 32, one unused
CONTEXTS = WORDS + CLASSES
ROWS = 1 << 14  # of the hashed weights
FEATURES, STEPS, RATE = 5, 12, 1.5
TASKS = 8  # of a gradient step, each of which sends an array of the weights' size to the driver
FLUSH = 500_000  # words that a task counts before it passes them on
DISCOUNT, REACH = 0.7, 4  # of a count of a word in a context; words of a context, at most
TASK_TOKENS, SENT, TOKEN_BYTES = 1_500_000, 600_000, 6  # tokens that a task of contexts gets, and that a reader sends at once, and bytes of one, about


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def count_words(train: DataFrame) -> DataFrame:
    """(word, n), the null word being the end; a written table."""

    def run(batches):
        counts, ends = Counter(), 0
        for batch in batches:
            for text in texts_of(batch.column(0)):
                counts.update(words_of(text))
                ends += 1
            if len(counts) > FLUSH:
                yield _counted(counts, 0)
                counts = Counter()
        if ends:
            yield _counted(counts, ends)

    found = train.select(F.col("text").cast("string")).mapInArrow(run, "word binary, n long")
    return written(found.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def _counted(counts: Counter, ends: int) -> pa.RecordBatch:
    words, n = list(counts), list(counts.values())
    if ends:
        words, n = [*words, None], [*n, ends]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])


def head_of(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """The most frequent words, as many whole ranks of frequency as fit ``most``, in order of count, then word."""
    by_count, total, least = counts.where("word is not null").groupBy("n").count(), 0, None
    # counts of counts: as many rows as there are different counts, of which the largest that matter are taken
    for n, words in by_count.orderBy(F.desc("n")).limit(most).collect():
        if total + words > most:
            break
        total, least = total + words, n
    if least is None:
        return [], []
    rows = counts.where((F.col("n") >= least) & F.col("word").isNotNull()).select("n", "word").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return rows["word"].to_pylist(), rows["n"].to_pylist()


@dataclass
class Classes:
    """The class of every word."""

    named: dict[bytes, int]  # word: place in the order of frequency
    of_named: np.ndarray  # classes of the named
    by_ending: np.ndarray  # cluster by the last two bytes
    log_total: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # log10 of a class's sum of count + 1

    def cluster_of(self, word: bytes) -> int:
        return int(self.by_ending[word[-1] << 8 | (word[-2] if len(word) > 1 else 0)])

    def open_class(self, word: bytes) -> int:
        return CLUSTERS * BANDS + self.cluster_of(word)


def profiles(train: DataFrame, named: list[bytes]) -> np.ndarray:
    """For each named word, how its documents' common words are distributed."""
    place, common = {w: i for i, w in enumerate(named)}, min(COMMON, len(named))

    def run(batches):
        total = np.zeros((len(named), common))
        for batch in batches:
            for text in texts_of(batch.column(0)):
                times = Counter(words_of(text))
                pairs = [(i, n) for w, n in times.items() if (i := place.get(w)) is not None]
                if pairs:
                    ids = np.array(pairs)
                    few = ids[ids[:, 0] < common]
                    if len(few):
                        total[np.ix_(ids[:, 0], few[:, 0])] += few[:, 1] / few[:, 1].sum()
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(list(total[rows]), pa.list_(pa.float64()))], ["i", "v"])

    parts = train.select(F.col("text").cast("string")).mapInArrow(run, "i long, v array<double>")
    sums = parts.groupBy("i").agg(*(F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(common)))
    out = np.zeros((len(named), common))
    for r in sums.collect():
        out[r[0]] = r[1:]
    return out


def cluster(profile: np.ndarray, weights: np.ndarray, k: int = CLUSTERS, rounds: int = 30) -> np.ndarray:
    """k-means over the square roots of the words' shares, begun at words far from one another."""
    rows = np.sqrt(profile / np.maximum(profile.sum(axis=1, keepdims=True), 1e-12))
    if not len(rows):
        return np.zeros(0, np.int64)
    centres = [rows[0]]
    for _ in range(1, k):
        gap = np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(rows[np.argmax(gap * weights**2)])
    centres = np.array(centres)
    for _ in range(rounds):
        at = np.argmin(((rows[:, None, :] - centres) ** 2).sum(axis=2), axis=1)
        for c in range(k):
            if (own := at == c).any():
                centres[c] = np.average(rows[own], axis=0, weights=weights[own])
    return at


def classes_of(named: list[bytes], counts: list[int], clusters: np.ndarray) -> Classes:
    n = np.array(counts, float)
    of_named = np.zeros(len(named), np.int64)
    votes = np.zeros((1 << 16, CLUSTERS))
    for c in range(CLUSTERS):
        own = np.flatnonzero(clusters == c)
        share = np.cumsum(n[own]) / max(1.0, n[own].sum())
        of_named[own] = c * BANDS + np.minimum((share * BANDS - 1e-9).astype(int), BANDS - 1)
    for word, c, k in zip(named, clusters, counts):
        if word:
            votes[word[-1] << 8 | (word[-2] if len(word) > 1 else 0), c] += math.log1p(k)
            votes[word[-1] << 8 :][: 1 << 8, c] += 1e-6 * math.log1p(k)  # where two bytes say nothing, the last one does
    votes += 1e-12 * np.bincount(clusters, minlength=CLUSTERS)
    return Classes({w: i for i, w in enumerate(named)}, of_named, votes.argmax(axis=1).astype(np.int8))


def class_totals(counts: DataFrame, classes: Classes) -> np.ndarray:
    """Sum of count + 1 of each class; an open class has an unseen word besides."""

    def run(batches):
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if word is None:
                    total[END] += n + 1
                else:
                    i = classes.named.get(word)
                    total[classes.of_named[i] if i is not None else classes.open_class(word)] += n + 1
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total)], ["c", "n"])

    out = np.zeros(CLASSES)
    for c, n in counts.select("word", "n").mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n")).collect():
        out[c] = n
    out[CLUSTERS * BANDS : END] += 1
    return np.maximum(out, 1)


END_HASH = np.uint64(0x5851F42D4C957F2D)
COUNT_BITS = 44  # of a word's count, below its place
#: A token's place in its batch, whether its document trains and is asked for, and its word's place in the head, in 32 bits.
PLACE_BITS, RANK_BITS = 12, 18


class Reader:
    """Turns documents into arrays: what each token is, its class, and the signature of its history.

    ``head``: of each word whose count came along, its place in the order of frequency and its count, as one number.

    A worker numbers the words it meets; number 0 is the end. What is known of a word stands at its number.
    """

    def __init__(self, classes: Classes, head: dict[bytes, int] | None = None, end_log: float = 0.0):
        self.classes, self.head, self.end_log = classes, head, end_log
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.words: list[bytes | None] = [None]
        self.packed, self.logs = np.zeros(1 << 16, np.int64), np.zeros(1 << 16)
        self.hashes, self.ranks = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        self.packed[0], self.logs[0] = END << 16 | (WORDS + END) << 3 | 7, self.end_log
        self.hashes[0], self.ranks[0] = END_HASH, len(self.head or ())

    def _add(self, word: bytes) -> int:
        """The number of a word; its class, context and cluster as one number, log10(count + 1), or NaN beyond the head."""
        at = self.place.get(word)
        if at is not None:
            return at
        c, at = self.classes, len(self.words)
        i = c.named.get(word)
        if i is not None:
            k = int(c.of_named[i])
            context, group = (i if i < WORDS else WORDS + k), k // BANDS
        else:
            group = c.cluster_of(word)
            k = CLUSTERS * BANDS + group
            context = WORDS + k
        if at == len(self.packed):
            for name in ("packed", "logs", "hashes", "ranks"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        self.packed[at], self.hashes[at] = k << 16 | context << 3 | group, xxhash.xxh64_intdigest(word)
        if self.head is not None:
            known = self.head.get(word)
            self.ranks[at], self.logs[at] = (-1, math.nan) if known is None else (known >> COUNT_BITS, math.log10((known & (1 << COUNT_BITS) - 1) + 1))
        self.place[word] = at
        self.words.append(word)
        return at

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' tokens in a row, each text with an end, and the place after each text."""
        if len(self.words) > FLUSH:
            self._forget()
        get, numbers, sizes = self.place.get, [], []
        for text in texts:
            words = words_of(text)
            row = [get(w) for w in words]
            if None in row:
                row = [self._add(w) if i is None else i for w, i in zip(words, row)]
            numbers += row
            numbers.append(0)
            sizes.append(len(row) + 1)
        return np.array(numbers, np.int64), np.cumsum(sizes)


def signatures(packed: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature of the history, class) of each token. Before a document, all is as after an end."""
    k, context, group = packed >> 16, packed >> 3 & 0x1FFF, packed & 7
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends

    def before(values: np.ndarray, by: int, first: int) -> np.ndarray:
        out = np.full(len(values), first, np.int64)
        out[by:] = values[:-by] if len(values) > by else out[by:]
        for d in range(by):
            at = starts + d
            out[at[at < ends]] = first
        return out

    signature = (before(context, 1, WORDS + END) * CLASSES + before(k, 2, END)) * 8 + before(group, 3, 7)
    return signature, k


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def contexts_of(packed: np.ndarray, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token a hash of its context and class. Before a document there are ends."""
    k, common = (packed >> 16).astype(np.uint64), (packed >> 3 & 0x1FFF < WORDS) | (packed >> 16 == END)
    place = np.arange(len(packed)) - np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)) if len(ends) else np.zeros(0, np.int64)
    context, more = np.zeros(len(packed), np.uint64), np.ones(len(packed), bool)
    for back in range(1, REACH + 1):
        at = np.maximum(np.arange(len(packed)) - back, 0)
        inside = place >= back
        context = np.where(more, _mixed(context + np.where(inside, hashes[at], END_HASH)), context)
        more &= ~inside | common[at]
    return _mixed(context + k)


def solved(contexts: np.ndarray, ranks: np.ndarray, trains: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each token, log10 of P(word | class, context) over the word's share of its class.

    ``ranks``: the tokens' words; ``trains``: which tokens are counted; ``share``: the share of each word, NaN where it is no
    feature. A feature's probability is (n - DISCOUNT) / N, of N tokens of its class in its context; all other words of the
    class share the rest as they share the class. Where all words of a class are features, there is no rest and no discount.
    """
    if not len(contexts):
        return np.zeros(0)
    keys = contexts.astype(np.uint64) << np.uint64(RANK_BITS) | ranks.astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.add.reduceat(trains[order].astype(np.float64), first)
    context, u = keys[first] >> np.uint64(RANK_BITS), share[(keys[first] & np.uint64((1 << RANK_BITS) - 1)).astype(np.int64)]
    new = np.concatenate([[True], context[1:] != context[:-1]])
    begins, of = np.flatnonzero(new), np.cumsum(new) - 1
    active = (n > 0) & ~np.isnan(u)
    total = np.add.reduceat(n, begins)
    count, taken = np.add.reduceat(np.where(active, n, 0.0), begins), np.add.reduceat(np.where(active, u, 0.0), begins)
    some = np.add.reduceat(active.astype(np.float64), begins)
    whole = (taken > 1 - 1e-9) | (total == 0)
    off = np.where(whole, 0.0, DISCOUNT)
    rest = np.where(whole, 1.0, 1 - (count - off * some) / np.maximum(total, 1))
    other = np.log10(rest) - np.log10(np.where(whole, 1.0, 1 - taken))
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.log10((n - off[of]) / total[of]) - np.log10(u)
    out = np.empty(len(keys))
    out[order] = np.repeat(np.where(active, own, other[of]), np.diff(np.append(first, len(keys))))
    return out


def features(signature: np.ndarray) -> np.ndarray:
    """The rows of the weights that a signature switches on, FEATURES of them."""
    group, k, context = signature & 7, (signature >> 3) % CLASSES, (signature >> 3) // CLASSES
    pair = ((context * CLASSES + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
    fixed = 1 + 8 + CLASSES + CONTEXTS
    return np.stack([np.zeros_like(k), 1 + group, 9 + k, 9 + CLASSES + context, fixed + pair % (ROWS - fixed)], axis=1)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log probabilities of the classes, for rows of features."""
    z = weights[rows[:, 0]]
    for f in range(1, rows.shape[1]):
        z = z + weights[rows[:, f]]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def histories(train: DataFrame, classes: Classes) -> DataFrame:
    """(key, n): how often a class follows a signature, key being signature * CLASSES + class; a written table."""

    def run(batches):
        reader, kept, held = Reader(classes), [], 0
        for batch in batches:
            numbers, ends = reader.tokens(texts_of(batch.column(0)))
            signature, k = signatures(reader.packed[numbers], ends)
            kept.append(np.unique(signature * CLASSES + k, return_counts=True))
            held += len(kept[-1][0])
            if held > 4 * FLUSH:
                kept, held = [_added(kept)], 0
                if len(kept[0][0]) > 2 * FLUSH:
                    yield _pairs(kept.pop())
        if kept:
            yield _pairs(_added(kept))

    found = train.select(F.col("text").cast("string")).mapInArrow(run, "key long, n long")
    return written(found.groupBy("key").agg(F.sum("n").alias("n")), "histories")


def _added(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def _pairs(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1].astype(np.int64))], ["key", "n"])


def observed(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How often each feature and class occur together, for counted histories."""
    rows, k = features(keys // CLASSES), keys % CLASSES
    seen = np.zeros(ROWS * CLASSES)
    for f in range(FEATURES):
        seen += np.bincount(rows[:, f] * CLASSES + k, n, ROWS * CLASSES)
    return seen.reshape(ROWS, CLASSES)


def expected(weights: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """How often the model would have each feature and class together, and the log likelihood of the histories."""
    signature, where = np.unique(keys // CLASSES, return_inverse=True)
    rows = features(signature)
    logs = log_softmax(weights, rows)
    each, want = np.exp(logs) * np.bincount(where, n, len(signature))[:, None], np.zeros((ROWS, CLASSES))
    for f in range(FEATURES):
        order = np.argsort(rows[:, f], kind="stable")
        at = np.flatnonzero(np.diff(rows[order, f], prepend=-1))
        want[rows[order[at], f]] += np.add.reduceat(each[order], at, axis=0)
    return want, float((logs[where, keys % CLASSES] * n).sum())


def _summed(table: DataFrame, compute) -> tuple[np.ndarray, float]:
    """Sums over at most TASKS tasks of an array of the weights' size and a number.

    Tasks leave the arrays in the shared folder, in files of the attempt's own, and only names pass through the driver's Java,
    which would hold each array several times over. The files go once they are read.
    """
    folder = scratch(table.sparkSession, "sums")

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            values, log = compute(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
            (fs, path), file = filesystem(folder), uuid.uuid4().hex
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{file}", compression=None) as out:
                out.write(values.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([log])], ["file", "log"])

    total, log = np.zeros((ROWS, CLASSES)), 0.0
    found = table.select("key", "n").coalesce(TASKS).mapInArrow(run, "file string, log double").collect()
    if found:
        fs, path = filesystem(folder)
        for r in found:
            with fs.open_input_file(f"{path}/{r.file}") as file:
                total += np.frombuffer(file.read(), "<f4").reshape(ROWS, CLASSES)
            log += r.log
        fs.delete_dir(path)
    return total, log


def train_weights(table: DataFrame, steps: int = STEPS) -> tuple[np.ndarray, list[float]]:
    """Weights by full-batch gradient steps, each a job over the table; and the log likelihood before each step."""
    weights, likelihood = np.zeros((ROWS, CLASSES), np.float32), []
    seen, _ = _summed(table, lambda keys, n: (observed(keys, n), 0.0))
    for _ in range(steps):
        want, log = _summed(table, lambda keys, n, now=weights: expected(now, keys, n))
        likelihood.append(log)
        weights = (weights + RATE * (seen - want) / (FEATURES * (0.5 * (seen + want) + 1.0))).astype(np.float32)
    return weights, likelihood


@dataclass
class Model:
    counts: DataFrame
    classes: Classes
    train: DataFrame
    head: dict[bytes, int]
    weights: np.ndarray
    tokens: int  # N
    types: int  # V
    likelihood: list[float]


def fit(train: DataFrame) -> Model:
    prepare(train.sparkSession)
    counts = count_words(train)
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    words, times = head_of(counts, HEAD)
    named, of_named = words[:NAMED], times[:NAMED]
    profile = profiles(train, named) if named else np.zeros((0, 1))
    classes = classes_of(named, of_named, cluster(profile, np.sqrt(np.array(of_named, float)) if named else np.zeros(0)))
    classes.log_total = np.log10(class_totals(counts, classes))
    table = histories(train, classes)
    weights, likelihood = train_weights(table)
    return Model(counts, classes, train, {w: i << COUNT_BITS | k for i, (w, k) in enumerate(zip(words, times))}, weights, n or 0, v, likelihood)


def _shares(model: Model, end_count: int) -> np.ndarray:
    """The share of its class of each word of the head, by rank; then the end's."""
    c = model.classes
    k = np.array([c.of_named[c.named[w]] if w in c.named else c.open_class(w) for w in model.head] + [END], np.int64)
    counts = [x & (1 << COUNT_BITS) - 1 for x in model.head.values()]
    return (np.array([*counts, end_count], np.float64) + 1) / 10 ** c.log_total[k]


#: What goes with a batch of documents once: of each document its doc_id, whether it is asked for, tokens, sums over the words
#: of the head, how many of them, sums over the classes; and, packed, the words beyond the head by the document's place.
ONCE = [("ids", T.LongType()), ("asked", T.BooleanType()), ("sizes", T.LongType()), ("logs", T.DoubleType()), ("known", T.LongType()), ("classes", T.DoubleType()), ("rest", T.BinaryType())]


def _pack_rest(places: np.ndarray, times: np.ndarray, words: list[bytes]) -> bytes:
    return zstandard.compress(struct.pack("<I", len(words)) + places.astype("<u2").tobytes() + times.astype("<u4").tobytes() + b"\n".join(words), 1)


def _unpack_rest(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data = zstandard.decompress(data)
    n = struct.unpack_from("<I", data)[0]
    return np.frombuffer(data, "<u2", n, 4), np.frombuffer(data, "<u4", n, 4 + 2 * n), data[4 + 6 * n :].split(b"\n") if n else []


def scored(rows: DataFrame, model: Model, end_count: int, tasks: int) -> DataFrame:
    """A row for each row asked: doc_id, n_tokens, logs, known, classes (log10 of all but the words' shares) and rest.

    ``rows``: doc_id, text, trains and asked. Readers send each token's hash to the task of its context, and what they know of
    a document by itself with it; the tasks of contexts answer with sums by document, which are added up by batch.
    """
    classes, head, weights, end_log = model.classes, model.head, model.weights, math.log10(end_count + 1)
    share = np.full(1 << RANK_BITS, np.nan)  # NaN for words beyond the head, whose place is the last
    share[: len(head) + 1] = _shares(model, end_count)
    beyond_head = (1 << RANK_BITS) - 1
    once = [T.StructField(c, T.ArrayType(t)) for c, t in ONCE]
    kinds = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("marks", T.BinaryType()), *once])
    answers = T.StructType([T.StructField("batch", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("sums", T.BinaryType()), *once])

    def send(batches):
        schema, number = to_arrow_schema(kinds), TaskContext.get().partitionId() << 32
        reader = Reader(classes, head, end_log)
        keys, marks, own = [], [], {c: [] for c, _ in ONCE}
        docs = held = 0

        def packed():
            key, mark = np.concatenate(keys), np.concatenate(marks)
            part = (key >> np.uint64(32)) % np.uint64(tasks)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(tasks + 1, dtype=np.uint64))
            key, mark = (key[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), mark[order]
            used = np.flatnonzero(np.diff(cuts)).tolist()
            cut = lambda x: pa.array([x[cuts[p] : cuts[p + 1]].tobytes() for p in used], pa.binary())
            first = [pa.array([np.concatenate(own[c]) if c not in ("ids", "rest") else sum(own[c], []), *[None] * (len(used) - 1)], schema.field(c).type) for c, _ in ONCE]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([number] * len(used), pa.int64()), cut(key), cut(mark), *first], schema=schema)

        for batch in batches:
            texts = texts_of(batch.column(1))
            if not texts:
                continue
            if docs + len(texts) > 1 << PLACE_BITS:
                yield packed()
                keys, marks, own = [], [], {c: [] for c, _ in ONCE}
                docs, held, number = 0, 0, number + 1
            numbers, ends = reader.tokens(texts)
            starts, sizes = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0).astype(np.int64)
            kinds_of = reader.packed[numbers]
            signature, k = signatures(kinds_of, ends)
            each, where = np.unique(signature, return_inverse=True)
            logs = log_softmax(weights, features(each)).astype(np.float64) / math.log(10)
            words = reader.logs[numbers]
            beyond = np.isnan(words)
            at = np.flatnonzero(beyond)  # words beyond the head, counted by document
            pairs, times = np.unique(np.searchsorted(ends, at, "right") << 32 | numbers[at], return_counts=True)
            trains, asked = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ranks = reader.ranks[numbers]
            mark = (docs + np.arange(len(texts), dtype=np.uint32)) << (RANK_BITS + 2) | trains.astype(np.uint32) << (RANK_BITS + 1) | asked.astype(np.uint32) << RANK_BITS
            keys.append(contexts_of(kinds_of, reader.hashes[numbers], ends))
            marks.append(np.repeat(mark, sizes) | np.where(ranks < 0, beyond_head, ranks).astype(np.uint32))
            for c, x in (
                ("ids", batch.column(0).to_pylist()), ("asked", asked), ("sizes", sizes), ("logs", np.add.reduceat(np.where(beyond, 0.0, words), starts)), ("known", np.add.reduceat((~beyond).astype(np.int64), starts) - (end_count == 0)),
                ("classes", np.add.reduceat(logs[where, k] - classes.log_total[k], starts)), ("rest", [_pack_rest(docs + (pairs >> 32), times, [reader.words[i] for i in (pairs & 0xFFFFFFFF).tolist()])]),
            ):
                own[c].append(x)
            docs, held = docs + len(texts), held + len(numbers)
            if held > SENT:
                yield packed()
                keys, marks, own = [], [], {c: [] for c, _ in ONCE}
                docs, held, number = 0, 0, number + 1
        if held:
            yield packed()

    def answer(batches):
        keys, marks, cuts, rest = [], [], [0], []
        for b in batches:
            if b.num_rows:
                keys.append(_flat(b["keys"], np.uint32))
                marks.append(_flat(b["marks"], np.uint32))
                cuts += (cuts[-1] + np.cumsum(pc.binary_length(b["keys"]).to_numpy(zero_copy_only=False) // 4)).tolist()
                rest.append(b.select(["batch", *(c for c, _ in ONCE)]))
        if not rest:
            return
        mark, key = np.concatenate(marks), np.concatenate(keys)
        keys = marks = None
        found = solved(key, mark & beyond_head, (mark >> (RANK_BITS + 1) & 1).astype(bool), share)
        at = 0
        for b in rest:
            places, sums = [], []
            for begin, end in zip(cuts[at : at + b.num_rows], cuts[at + 1 :]):
                asked = np.flatnonzero(mark[begin:end] >> RANK_BITS & 1)
                own, values = mark[begin:end][asked] >> (RANK_BITS + 2), found[begin:end][asked]
                first = np.flatnonzero(np.diff(own.astype(np.int64), prepend=-1))
                places.append(own[first].astype(np.uint16).tobytes())
                sums.append((np.add.reduceat(values, first) if len(first) else values).astype(np.float32).tobytes())
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b["batch"], pa.array(places, pa.binary()), pa.array(sums, pa.binary()), *b.columns[1:]], answers.names)

    def added(table: pa.Table) -> pa.Table:
        own = {c: next(x for x in table[c].to_pylist() if x is not None) for c, _ in ONCE}
        n = len(own["ids"])
        place = np.concatenate([_flat(x, np.uint16) for x in table["places"].chunks])
        words = np.bincount(place, np.concatenate([_flat(x, np.float32) for x in table["sums"].chunks]), n).astype(np.float64)
        rests = [_unpack_rest(x) for x in own["rest"]]
        stops = np.searchsorted(np.concatenate([x[0] for x in rests]), np.arange(n + 1)).astype(np.int32)
        rest = pa.ListArray.from_arrays(pa.array(stops), pa.StructArray.from_arrays([pa.array([w for x in rests for w in x[2]], pa.binary()), pa.array(np.concatenate([x[1] for x in rests]).astype(np.int64))], ["word", "m"]))
        columns = [pa.array(own["ids"], pa.int64()), pa.array(own["sizes"], pa.int64()), pa.array(own["logs"], pa.float64()), pa.array(own["known"], pa.int64()), pa.array(np.array(own["classes"], np.float64) + words), rest]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "logs", "known", "classes", "rest"]).filter(pa.array(own["asked"], pa.bool_()))

    moved = rows.select("doc_id", "text", "trains", "asked").mapInArrow(send, kinds).repartitionById(tasks, "part").mapInArrow(answer, answers)
    # as many tasks as the tokens ask for, whatever the session's number is
    return moved.repartition(tasks, "batch").groupBy("batch").applyInArrow(added, "doc_id long, n_tokens long, logs double, known long, classes double, rest array<struct<word: binary, m: long>>")


def _flat(column: pa.Array, kind) -> np.ndarray:
    """All bytes of a binary column in a row, as numbers."""
    _, offsets, data = column.buffers()
    begin, end = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset)[[0, -1]].tolist()
    return np.frombuffer(data, kind, (end - begin) // np.dtype(kind).itemsize, begin) if end > begin else np.zeros(0, kind)


def fit_and_score(docs: DataFrame) -> DataFrame:
    """``score`` of all rows by a model of those that the rule does not hold out; each row's tokens are sent once for both."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = ~held_out(F.col("doc_id"))
    return score(rows, fit(rows.where(out)), rows.select("doc_id", "text", out.alias("trains"), F.lit(True).alias("asked")))


def score(docs: DataFrame, model: Model, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``rows``: the training rows and ``docs`` as scored() takes them, if they overlap; by default one after the other.
    """
    prepare(docs.sparkSession)
    if rows is None:
        asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(False).alias("trains"), F.lit(True).alias("asked"))
        rows = model.train.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string"), F.lit(True).alias("trains"), F.lit(False).alias("asked")).unionAll(asked)
    ends_seen = model.counts.where("word is null").select("n").first()
    end_count = ends_seen[0] if ends_seen else 0
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1).cast("long"))).first()[0] or 0
    table = scored(rows, model, end_count, 1 + size // (TASK_TOKENS * TOKEN_BYTES))
    table = written(table.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = table.select("row", F.inline("rest"))
    met = rest.join(model.counts.where("word is not null").withColumnRenamed("word", "w"), F.col("word") == F.col("w"))
    more = met.groupBy(F.col("row").alias("r")).agg(F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum("m").alias("more_known"))
    joined = table.drop("rest").join(more, F.col("row") == F.col("r"), "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = logs - F.col("n_tokens") * math.log10(model.tokens + model.types + 1)
    return joined.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (logs + F.col("classes")).alias("score") if model.tokens else base.alias("score"),
    )
