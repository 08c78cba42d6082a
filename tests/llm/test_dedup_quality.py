"""Operators 3, 4 and 5 against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliograph.llm import exactdedup, jaccard, quality, queries, simhash
from foliograph.llm import components as components_module
from foliograph.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.text(alphabet=st.sampled_from(list("ab A.\n\t\x0b\x1c\x85\xa0#é")), max_size=60)


def brute_measures(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_op3_measures(text):
    assert quality.measures(text) == brute_measures(text)


def test_op3_hosts(spark):
    good, junk = "w " * 2 + " ".join(f"word{i}" for i in range(80)), "bad"
    rows = [(i, good if i % 10 else junk, "clean", "k") for i in range(60)] + [(100 + i, junk if i % 8 else good, "spam", "k") for i in range(60)]
    rows += [(200, good, "small", "k"), (201, None, None, "k"), (202, "", None, "k"), (203, good, None, "k"), (None, good, "clean", "k"), (1, good, "clean", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string")
    from foliograph.llm.common import written

    out = quality.judge(written(quality.measure(df), "t"), "source").collect()
    assert len(out) == len(rows)
    assert {r.source for r in out if r.kept} == {"clean", "small"}
    assert sum(r.kept for r in out if r.source == "clean") == 54 + 2
    kept = quality.apply_rules(df)
    assert kept.columns == df.columns and kept.count() == 57 and {r.n_words for r in kept.collect()} == {"k"}
    assert quality.apply_rules(df.limit(0)).count() == 0


def test_op3_prior_weight():
    assert quality.prior_weight(0.0, 0.0, 0.1) == 1.0 and quality.prior_weight(0.2, None, None) == 1000.0
    assert 1 <= quality.prior_weight(0.2, 0.05, 0.01) < 10


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_op4_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(ids, fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in set(fps):
        for b in set(fps):
            if bin(a ^ b).count("1") <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, f in zip(ids, fps):
        least[find(f)] = min(least.get(find(f), i), i)
    return [least[find(f)] for f in fps]


def test_op4_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    want = {d.doc_id: (f"{f:016x}", c) for d, f, c in zip(docs, fps, brute_components([d.doc_id for d in docs], fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_ball(spark, SF).collect()}
    assert got == want and len(set(x for _, x in want.values())) < len(docs)


def test_op4_links_join_exactly_what_is_near(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(200):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
            f ^= 1 << b
        fps.append(f)
    fps = list({*fps, 0, 1, (1 << 63), (1 << 63) | 1, 2**64 - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    want = brute_components(range(len(fps)), fps)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({x for g in groups.values() for x in g})


def test_components_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1500)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ODD = [(4, "A b\n", "x"), (3, "Ab ", "x"), (2, "A\x0bb\x0c\r", "x"), (9, "A\x1cb", "x"), (5, None, "x"), (6, "", "x"), (6, "", "x"), (None, " \n ", "x"), (7, "z" * 9000, "x"), (8, "z " * 9000, "x"), (1, "once", "x")]


@pytest.mark.parametrize("size", [16, 1])
def test_op5_odd(spark, size):
    df = spark.createDataFrame(ODD, "doc_id long, text string, kept string").repartition(3)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.groups(df, size).collect()), key=str)
    want = [(4, 2, 3, False), (3, 2, 3, False), (2, 2, 3, True), (9, 9, 1, True), (5, None, 4, False), (6, None, 4, False), (6, None, 4, False), (None, None, 4, True), (7, 8, 2, False), (8, 8, 2, True), (1, 1, 1, True)]
    assert got == sorted(want, key=str)
    left = exactdedup.deduplicate(df, size)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [2, 9, None, 8, 1]))
    assert exactdedup.groups(df.limit(0), size).count() == 0


def test_op5_repeated_row_stays_once(spark):
    df = spark.createDataFrame([(1, "a b")] * 4 + [(2, "a b")], "doc_id long, text string")
    assert sorted(r.kept for r in exactdedup.groups(df).collect()) == [False] * 4 + [True]
    assert [r.doc_id for r in exactdedup.deduplicate(df).collect()] == [1]


def test_op5_hash(spark):
    df = spark.createDataFrame([(1, "a b\n")], "doc_id long, text string")
    assert exactdedup.groups(df).first().text_sha256 == hashlib.sha256(b"ab").hexdigest()


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 60000))
def test_op5_chunks(seed, n):
    data = random.Random(seed).randbytes(n)
    parts = exactdedup.chunks(data)
    assert b"".join(parts) == data and all(exactdedup.LEAST <= len(p) <= exactdedup.MOST for p in parts[:-1])
    if n > 30000:  # an insertion changes few chunks
        other = exactdedup.chunks(data[:100] + b"!" + data[100:])
        assert len(set(parts) & set(other)) >= len(parts) // 2


def test_op4_deduplicate(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + "\n"), (9, "quite another text of few words"), (3, base + "\n"), (1, None), (2, "")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fp string")
    left = simhash.deduplicate(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 9]
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_op4_deduplicate_null_and_shared_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(200)) for c in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + "\n"), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[4]), (8, texts[4])]
    left = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [("None", texts[0]), ("None", texts[1]), ("7", texts[2]), ("7", texts[3]), ("8", texts[4])]
    assert sorted((str(r.doc_id), r.text.strip()) for r in left) == sorted(want)


def brute_near(rows, words, similarity):
    """The rows that stay: of each component of similar shingle sets, the first by (null last, doc_id, place)."""
    sets = [jaccard.shingles(t or "", words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] == sets[b] or common and common / (len(sets[a]) + len(sets[b]) - common) >= similarity:
                root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(best.get(find(k), (True, 0, k)), (i is None, i or 0, k))
    return [rows[k] for _, _, k in best.values()]


def test_near_copies_by_similarity(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)  # several tiles a cluster
    rng = random.Random(11)
    rows = [(None, None), (3, " "), (None, "one two"), (2, "ONE\ttwo"), (4, "one two three")]
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(200)]
        for k in range(rng.choice([1, 2, 3, 40])):
            copy = list(base)
            for at in rng.sample(range(200), rng.choice([0, 1, 3, 4, 5, 8, 12])):
                copy[at] = f"x{rng.random()}"
            rows.append((g * 100 + k if k % 5 else None, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = simhash.deduplicate(df, words=5, similarity=0.8)
    want = brute_near(rows, 5, 0.8)
    assert left.columns == df.columns and left.count() == len(want) < len(rows)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in want)
    assert simhash.deduplicate(df.limit(0), words=5, similarity=0.8).count() == 0


def test_tiles_of_a_large_cluster_grow_with_its_size(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    placed = spark.range(4000).select(F.col("id").alias("node"), F.lit(0).alias("root"), F.lit(4000).alias("n"), jaccard._chunk_of(F.col("id"), F.lit(4000)).alias("chunk"))
    tiles = jaccard.first_tiles(placed).groupBy("group", "tile").count().collect()
    assert len(tiles) == 500 and max(t["count"] for t in tiles) < 80
    members = spark.range(4000).select(F.col("id").alias("node"), F.when(F.col("id") < 3990, 0).otherwise(F.col("id")).alias("label"), F.lit(5).alias("s"))
    later = jaccard.later_tiles(members).groupBy("group", "tile").agg(F.collect_list(F.when(~F.col("second"), F.col("node"))).alias("a"), F.collect_list(F.when(F.col("second"), F.col("node"))).alias("b")).collect()
    pairs = {(x, y) for t in later for x in t.a for y in [*t.a, *t.b]}
    assert len(later) < 1200 and all((x, y) in pairs or (y, x) in pairs for x in range(3990, 4000) for y in range(4000))
    assert jaccard.later_tiles(members.withColumn("label", F.lit(1))).count() == 0


def test_joins_split_a_hub(spark):
    """With broadcasts off and low limits, adaptive execution splits the partition of a node that has half of all links."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        from foliograph.llm.common import written

        pairs = written(spark.range(400_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("u"), F.xxhash64("id").alias("v")), "hub")
        star = components_module._star(pairs)
        star.write.format("noop").mode("overwrite").save()
        executed = star._jdf.queryExecution()
        star.collect()
        assert "isSkewJoin=true" in executed.executedPlan().toString() or "skew=true" in executed.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    copy, other = base[:100] + ["x", "y"] + base[102:], base[:100] + [f"z{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(other))], "doc_id long, text string")
    assert simhash.fingerprint(df.first().text) != simhash.fingerprint(" ".join(copy))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()) == [1, 3]


def test_balls_of_fingerprints_make_candidates(spark, monkeypatch):
    """Copies within two bits are found where no stretch of minima is shared; the exact check follows."""
    own = jaccard._digests

    def apart(text, words):
        return own(text, words)[0], [hash((text, i)) for i in range(4)]

    monkeypatch.setattr(jaccard, "_digests", apart)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), *(" ".join([*base[:at], "x", *base[at + 1 :]]) for at in range(0, 400, 7))]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    near = next(k for k in range(1, len(texts)) if (prints[0] ^ prints[k]).bit_count() <= 2)
    df = spark.createDataFrame([(1, texts[0]), (2, texts[near]), (3, "quite another text of some words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(df, words=5, similarity=0.8).collect()) == [1, 3]


def test_a_large_cluster_is_compared_whole_and_not_by_stretch(spark):
    n = 2600
    large = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"), F.lit(n).cast("long").alias("n"))
    labels = spark.range(n // 2).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("root"))
    stretches = spark.range(n * 16).select((F.col("id") % n).alias("row"), (F.col("id") / n).cast("long").alias("s"))
    tiles = jaccard.later_tiles(jaccard.later_members(large, labels, stretches))
    assert tiles.count() <= 5 * n  # by stretch, 16 times the copies of each text
    got = tiles.groupBy("group", "tile").agg(F.collect_list(F.when(~F.col("second"), F.col("node"))).alias("a"), F.collect_list(F.when(F.col("second"), F.col("node"))).alias("b")).collect()
    pairs = {(min(x, y), max(x, y)) for t in got for x in t.a for y in [*t.a, *t.b]}
    assert all((x, y) in pairs for y in range(n // 2, n) for x in range(0, y, 13))
