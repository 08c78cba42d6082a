"""The pipeline against a brute-force version: near copies have a similarity of 0.8 or more of their five-word shingles."""

import statistics

import corpus_pipeline
from test_dedup_quality import WORD, brute_measures
from test_tokens_ops import check_packed

SF = "/root/testdata/sf0.001"


def brute_shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_groups(docs):
    """The smallest doc_id of each document's component of similar pairs."""
    sets, root = [brute_shingles(d.text) for d in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    return [min(d.doc_id for d, r in zip(docs, root) if r == mine) for mine in root]


def brute(docs):
    def passes(d):
        n, _, _, _, repeated = brute_measures(d.text)
        return n >= 50 and 100 * repeated <= 50 * n

    failed = {}
    for d in docs:
        failed.setdefault(d.source, []).append(not passes(d))
    mean = sum(map(sum, failed.values())) / len(docs)
    between = statistics.variance(sum(f) / len(f) for f in failed.values()) - mean * (1 - mean) * statistics.fmean(1 / len(f) for f in failed.values())
    weight = min(1000, max(1, mean * (1 - mean) / between - 1)) if between > 0 else 1000
    bad = {h for h, f in failed.items() if (sum(f) + mean * weight) / (len(f) + weight) > 0.5}
    docs = [d for d in docs if passes(d) and d.source not in bad]
    best = {}
    for d in docs:
        key = "".join(c for c in d.text if c not in " \t\n\x0b\f\r")
        if key not in best or (-len(d.text), d.doc_id) < (-len(best[key].text), best[key].doc_id):
            best[key] = d
    docs = list(best.values())
    return [d for d, least in zip(docs, brute_groups(docs)) if d.doc_id == least]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute(docs)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(want) < len(docs)
    assert check_packed(rows, [(d.doc_id, d.text) for d in want]) < 0.02


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), SF)
        assert out.columns == docs.columns and out.count() == 0
    good = " ".join(f"w{i}" for i in range(100))
    odd = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, good, "en", None, 5), (1, good, "en", None, 5), (None, good + " x", None, "s", 1), (2, "once only", "en", "s", 2)], docs.schema)
    left = [sorted(((r.doc_id, r.text) for r in stage(spark, odd, SF).collect()), key=str) for _, stage in corpus_pipeline.STAGES[:-1]]
    assert left[0] == [(1, good)] * 2 + [(None, good + " x")]
    assert left[1] == [(1, good), (2, "once only"), (None, good + " x"), (None, None)]
    assert left[2] == [(1, good), (2, "once only"), (None, None)]
    pieces = corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect()
    assert sum(r.length for r in pieces if r.doc_id is None and r.doc_tokens == 1) == 2 and sum(r.length for r in pieces if r.doc_id == 1) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 1)
