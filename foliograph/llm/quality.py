"""Operator 3: host-level quality rules.

Each document is measured by itself, over its whole text. Failures are then added up by host, a beta prior is fitted to
the hosts' failure rates by the method of moments, each host's rate shrinks towards the prior's mean by as much as its few
documents warrant, and hosts whose shrunk rate exceeds ``max_rate`` are rejected with all their documents.

Only the prior's sums, one row, come to the driver. The verdict join carries the rejected hosts alone; a host with a third
of all rows is pre-aggregated where its rows lie, and Spark splits its side of the join.

Defined results: null or empty text has no words and fails; a null host is a host of its own; repeated rows count as often
as they occur; an empty table gives no rows; an input column named like a measure is replaced by it.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import computed, named, numbered, written

SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_RATE = 50, 50, 0.5


def measures(text: str) -> tuple[int, int, int, int, int]:
    """The five measures of a text. bytes.split() and bytes.strip() know exactly the six ASCII white-space characters."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else ()
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            times, done = Counter(windows), 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(i, done)
                    done = i + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def measure(docs: DataFrame, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with its measures and base_failed; ``carry``: the columns to keep, by default all."""
    names = [c for c in (carry if carry is not None else docs.columns) if c not in (*MEASURES, "base_failed")]

    def compute(texts):
        found = [measures(t) for t in texts]
        return [pa.array([r[i] for r in found], pa.int64()) for i in range(5)]

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return computed(docs, names, [T.StructField(c, T.LongType()) for c in MEASURES], compute, text).withColumn("base_failed", failed)


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """(host, documents, failed, shrunk_rate): failure rates by host, shrunk by the empirical beta prior."""
    hosts = written(measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "host-counts")
    rate = F.col("failed") / F.col("documents")
    s = hosts.agg(F.sum("failed").alias("f"), F.sum("documents").alias("n"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("documents")).alias("i")).first()
    mean = s.f / s.n if s.n else 0.0
    weight = prior_weight(mean, s.v, s.i)
    return hosts.withColumn("shrunk_rate", (F.col("failed") + mean * weight) / (F.col("documents") + weight))


def prior_weight(mean: float, variance: float | None, inverse: float | None) -> float:
    """How many documents the prior counts as: from the variance between hosts beyond what sampling alone gives."""
    sampling = mean * (1 - mean)
    between = (variance or 0.0) - sampling * (inverse or 0.0)
    return min(1000.0, max(1.0, sampling / between - 1)) if between > 0 and sampling > 0 else 1000.0 if sampling > 0 else 1.0


def judge(measured: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """``measured``, a written table, with kept."""
    bad = host_rates(measured, host).where(F.col("shrunk_rate") > max_rate).select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    return measured.join(bad, F.col(host).eqNullSafe(F.col("__host")), "left").withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__host", "__bad")


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns. They are measured and written once."""
    rows, text = numbered(docs)
    measured = written(measure(rows, text=text), "quality")
    return named(judge(measured, f"__in{docs.columns.index(host)}").where("kept"), docs)
