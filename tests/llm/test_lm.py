"""Operator 8: counts and baseline against brute force, the model against its own laws and on held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foliograph.llm import lm, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def brute(docs):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in docs}
    counts = Counter(t for i, x in docs if not held[i] for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(i, held[i], len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))) for i, x in docs]


def check(rows, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
    want = sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("head", [lm.HEAD, 300])
def test_counts_baseline_and_gain(spark, docs, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = queries.op8_maxent_lm(spark, SF).collect()
    check(rows, brute([tuple(d) for d in docs.collect()]))
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_likelihood_rises(docs):
    model = lm.fit(docs.where(~lm.held_out(docs.doc_id)))
    assert all(b > a for a, b in zip(model.likelihood, model.likelihood[1:]))


def test_the_model_is_a_distribution(docs):
    model = lm.fit(docs)
    reader, c = lm.Reader(model.classes, model.head), model.classes
    numbers, ends = reader.tokens(["the of and to unheardof", ""])
    logs = lm.log_softmax(model.weights, lm.features(lm.signatures(reader.packed[numbers], ends)[0]))
    assert np.allclose(np.exp(logs).sum(axis=1), 1)
    share = np.zeros(lm.CLASSES)
    for r in model.counts.collect():
        w = None if r.word is None else bytes(r.word)
        k = lm.END if w is None else c.of_named[c.named[w]] if w in c.named else c.open_class(w)
        share[k] += (r.n + 1) / 10 ** c.log_total[k]
    for k in range(lm.CLUSTERS * lm.BANDS, lm.END):
        share[k] += 1 / 10 ** c.log_total[k]
    assert np.allclose(share[share > 0], 1)


def contexts(text, model):
    """Each token of a text with its class and context: the words before it back to the first that is not frequent."""
    c = model.classes
    kind = lambda w: lm.END if w is None else int(c.of_named[c.named[w]]) if w in c.named else c.open_class(w)
    words = [None] * lm.REACH + [t and t.encode() for t in tokens(text)]
    for i in range(lm.REACH, len(words)):
        context = []
        for w in reversed(words[i - lm.REACH : i]):
            context.append(w)
            if w is not None and c.named.get(w, lm.WORDS) >= lm.WORDS:
                break
        yield words[i], kind(words[i]), tuple(context)


def brute_scores(docs, model):
    """log10 of the probability of each text by the model's definition, from plain counts."""
    c, counts = model.classes, {None if r.word is None else bytes(r.word): r.n for r in model.counts.collect()}
    share = lambda w, k: (counts.get(w, 0) + 1) / 10 ** c.log_total[k]
    seen, total = Counter(), Counter()
    for r in model.train.collect():
        for w, k, x in contexts(r.text, model):
            seen[w, k, x] += 1
            total[k, x] += 1
    active = {}
    for (w, k, x), n in seen.items():
        if w is None or w in model.head:
            active.setdefault((k, x), []).append((n, share(w, k)))
    out = []
    for _, text in docs:
        score = 0.0
        reader = lm.Reader(c, model.head)
        numbers, ends = reader.tokens([text or ""])
        logs = lm.log_softmax(model.weights, lm.features(lm.signatures(reader.packed[numbers], ends)[0])) / math.log(10)
        for at, (w, k, x) in enumerate(contexts(text, model)):
            own, n = active.get((k, x), []), seen[w, k, x] if w is None or w in model.head else 0
            taken = sum(u for _, u in own)
            off = 0.0 if taken > 1 - 1e-9 else lm.DISCOUNT
            if n:
                p = (n - off) / total[k, x]
            elif total[k, x] and taken <= 1 - 1e-9:
                p = (1 - sum(m - off for m, _ in own) / total[k, x]) * share(w, k) / (1 - taken)
            else:
                p = share(w, k)
            score += logs[at, k] + math.log10(p)
        out.append(score)
    return out


@pytest.mark.parametrize("words,head", [(lm.WORDS, lm.HEAD), (20, 300)])
def test_score_against_brute_force(spark, docs, monkeypatch, words, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "TASK_TOKENS", 20_000)
    monkeypatch.setattr(lm, "SENT", 5_000)
    own = docs.where(docs.doc_id % 3 == 0)
    model = lm.fit(own.where(~lm.held_out(docs.doc_id)))
    rows = [tuple(r) for r in own.collect()]
    want = dict(zip([i for i, _ in rows], brute_scores(rows, model)))
    for found in (lm.fit_and_score(own), lm.score(own, model)):
        got = {r.doc_id: r.score for r in found.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-5, abs_tol=1e-4) for i in want)


def test_words_of_a_class_in_a_context_add_up_to_one():
    share = np.array([0.5, 0.2, 0.1, 0.1, 0.1, 1.0, 0.3])
    context = np.array([5, 5, 5, 5, 5, 6, 7], np.uint32)
    for trains in ([0, 3, 1, 0, 0, 2, 0], [0] * 7, [1] * 4 + [0, 1, 1]):
        many = np.repeat(np.arange(7), np.maximum(trains, 1))
        flags = np.repeat(np.array(trains) > 0, np.maximum(trains, 1))
        found = lm.solved(context[many], many, flags, share)
        each = {k: share[k] * 10 ** found[many == k][0] for k in range(7)}
        assert math.isclose(sum(each[k] for k in range(5)), 1) and math.isclose(each[5], 1)
    assert len(lm.solved(context[:0], context[:0], np.zeros(0, bool), share)) == 0
    some = lm._pack_rest(np.array([0, 0, 9]), np.array([1, 70000, 2]), [b"a", b"\xff\x00", b"c"])
    assert [list(x) for x in lm._unpack_rest(some)] == [[0, 0, 9], [1, 70000, 2], [b"a", b"\xff\x00", b"c"]] and lm._unpack_rest(lm._pack_rest(np.zeros(0), np.zeros(0), []))[2] == []


def test_held_out_score_is_better_than_classes_alone(spark):
    rows = [r for r in queries.op8_maxent_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > -3.5


def test_signatures_do_not_cross_documents():
    packed = np.array([1 << 16 | 5 << 3 | 1, lm.END << 16 | (lm.WORDS + lm.END) << 3 | 7] * 2, np.int64)
    sig, k = lm.signatures(packed, np.array([2, 4]))
    assert list(sig[:2]) == list(sig[2:]) and list(k) == [1, lm.END, 1, lm.END]
    sig, _ = lm.signatures(packed[1:2].repeat(3), np.array([1, 2, 3]))
    assert len(set(sig)) == 1 and len(lm.signatures(packed[:0], np.array([], np.int64))[0]) == 0


def test_gradient_is_observed_less_expected():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(lm.ROWS, lm.CLASSES)).astype(np.float32) * 0.1
    keys = np.unique(rng.integers(0, lm.CONTEXTS * lm.CLASSES * 8, 20)[:, None] * lm.CLASSES + rng.integers(0, lm.CLASSES, 3))
    n = rng.integers(1, 9, len(keys))
    seen, (want, log) = lm.observed(keys, n), lm.expected(weights, keys, n)
    rows = lm.features(keys // lm.CLASSES)
    for f, k in [(0, 3), (int(rows[0, 4]), int(keys[0] % lm.CLASSES))]:
        moved = weights.astype(np.float64)
        moved[f, k] += 1e-4
        assert (lm.expected(moved, keys, n)[1] - lm.expected(weights.astype(np.float64), keys, n)[1]) / 1e-4 == pytest.approx(seen[f, k] - want[f, k], abs=1e-2)


def test_arrays_of_a_step_do_not_pass_through_the_drivers_java(spark, docs, monkeypatch):
    classes = lm.fit(docs).classes
    assert classes.by_ending.nbytes <= 1 << 16
    frame, moved = type(docs), []
    for name, size in (("collect", lambda rows: sum(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray)))), ("toArrow", lambda table: table.nbytes)):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name), size=size: (x := f(self), moved.append(size(x)))[0])
    table = lm.histories(docs, classes).repartition(12)
    keys, n = (np.array(x) for x in zip(*table.collect()))
    seen, log = lm._summed(table, lambda keys, n: (lm.observed(keys, n), float(n.sum())))
    assert np.array_equal(seen, lm.observed(keys, n)) and log == n.sum() and len(moved) >= 2 and max(moved) < 1 << 16
    assert lm._summed(table.limit(0), None)[0].any() == False  # noqa: E712


def test_numbers_may_be_forgotten(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 100)
    check(queries.op8_maxent_lm(spark, SF).collect(), brute([tuple(d) for d in docs.collect()]))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "The the THE"), (3, "word " * 30000), (10**12, "\x1c the\x85"), (4, "É é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    check(lm.score(df, lm.fit(df.where(~lm.held_out(df.doc_id)))).collect(), brute(rows))
    none = lm.score(df, lm.fit(df.limit(0))).collect()
    assert len(none) == len(rows) and all(r.base_score == r.score == 0 and r.n_known == 0 for r in none)
    assert lm.score(df.limit(0), lm.fit(df)).count() == 0
