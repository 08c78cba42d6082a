"""Operators 1, 2 and 7 against brute force."""

import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliograph.llm import packing, queries, sharding, sstable, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ROWS = [(5, "one two"), (1, None), (-3, ""), (2, "same"), (2, "same"), (9, "x " * 9000), (None, "no id\n\n  end "), (7, "ünï 'll they're  \t\x1c a b"), (2, "other")]


def library(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "a", 1, 2, 3) for i, t in ROWS], "doc_id long, text string, shard string, size int, ids int, start int").repartition(3)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'tsre 1,.\n\t\x1c\x85 　é!<|>")), max_size=40), max_size=5))
def test_encoder_equals_the_library(texts):
    e = tokens.encoder(PATH)
    assert e.encode(texts) == [array("I", i).tobytes() for i in library(texts)]


def test_special_strings_are_text():
    assert tokens.encoder(PATH).encode(["a <|endoftext|> b"]) == [array("I", library(["a <|endoftext|> b"])[0]).tobytes()]


def expected_starts(rows):
    out, start = [], 0
    for (i, _), ids in zip(rows, library([t or "" for _, t in rows])):
        ids = [*ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op1_query(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False, name=None))
    got = sorted(map(tuple, queries.op1_sstable_shards(spark, SF).collect()))
    assert got == expected_starts(rows)


def test_op1_odd_rows_and_lookup(spark, odd):
    shards = sstable.write(odd, PATH, shards=3)
    got = [(r.doc_id, r.start, r.n_tokens) for r in sstable.read(spark, shards).collect()]
    want = library([t or "" for _, t in ROWS])
    assert sorted((str(i), n) for i, _, n in got) == sorted((str(i), len(w) + 1) for (i, _), w in zip(ROWS, want))
    at = sorted(s for _, s, _ in got)
    assert at[0] == 0 and [i for i, _, _ in sorted(got, key=lambda x: x[1])] == [None, -3, 1, 2, 2, 2, 5, 7, 9]
    for i in {i for i, _ in ROWS}:
        assert sorted(map(list, sstable.lookup(shards, i))) == sorted([*w, 0] for (j, _), w in zip(ROWS, want) if j == i)
    assert sstable.lookup(shards, 12345) == []


def test_op1_block_format(tmp_path):
    import pyarrow.fs as fs

    keys = sorted({sstable.key_of(i * 7919 % 5000 - 2500) for i in range(3000)})
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "a")) as out:
        w = sstable.Writer(out, 4, block_bytes=300)
        for n, k in enumerate(keys):
            w.add(k, np.arange(n % 5, dtype="<u4"))
        w.close()
    r = sstable.Reader(fs.LocalFileSystem().open_input_file(str(tmp_path / "a")))
    assert [k for k, _ in r] == keys and len(r.index) > 20
    assert all(len(r.lookup(k)) == 1 for k in keys[::17])
    absent = [sstable.key_of(10**6 + i) for i in range(2000)]
    assert sum(map(r.may_hold, absent)) < 100 and not any(r.lookup(k) for k in absent)


def test_op1_ids_must_fit_the_width(tmp_path):
    import pyarrow.fs as fs

    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "a")) as out:
        w = sstable.Writer(out, 2)
        w.add(b"a", np.array([65535], "<u4"))
        with pytest.raises(ValueError):
            w.add(b"b", np.array([70000], "<u4"))


def test_op1_shards_follow_the_bytes_and_split_one_key(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 2000)
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, None).otherwise(F.col("id")).alias("doc_id"), F.lit("one two").alias("text")).repartition(3)
    shards = sstable.write(df, PATH)
    assert len(shards) > 8 and max(s.documents for s in shards) < 150
    got = sorted((r.start, r.doc_id) for r in sstable.read(spark, shards).collect())
    n = len(library(["one two"])[0]) + 1
    assert [s for s, _ in got] == list(range(0, 600 * n, n)) and [i for _, i in got] == [None] * 400 + list(range(0, 600, 3))
    assert len(sstable.lookup(shards, None)) == 400 and len(sstable.lookup(shards, 300)) == 1 and sstable.lookup(shards, 1) == []


def test_encoder_takes_plain_byte_level_bpe_alone(tmp_path):
    import json

    from foliograph.llm import tokens

    tokens.check_layout(PATH)
    with open(PATH, encoding="utf-8") as file:
        good = json.load(file)
    for part, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {**good["pre_tokenizer"], "add_prefix_space": True}), ("model", {**good["model"], "dropout": 0.1}), ("model", {"type": "Unigram"})):
        (tmp_path / "t.json").write_text(json.dumps({**good, part: value}))
        with pytest.raises(ValueError):
            tokens.check_layout(str(tmp_path / "t.json"))


def test_op1_empty(spark, odd):
    shards = sstable.write(odd.limit(0), PATH)
    assert shards == [] and sstable.read(spark, shards).count() == 0


def check_shards(rows, texts, tolerance):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert sorted((r["size"] for r in rows)) == sorted(len((t or "").encode()) + 1 for t in texts)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in by[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= tolerance, sizes


def test_op2_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op2_histogram_sort(spark, SF).collect()
    check_shards(rows, [d.text for d in docs], 2 * max(len(d.text.encode()) for d in docs))
    want = {d.doc_id: zlib.crc32(d.text.encode()) for d in docs}
    assert {r.doc_id: r.text_crc32 for r in rows} == want
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def sharded(df):
    from foliograph.llm.common import written

    return sharding.slots(written(sharding.shard(df).select("doc_id", "size", "shard", "range", "here"), "t")).collect()


def test_op2_one_key_holds_a_third(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 10**12).alias("doc_id"), F.lit("abc").alias("text"), F.lit(1).alias("shard"))
    check_shards(sharded(df), ["abc"] * 3000, 80)


@pytest.mark.parametrize("ids", [[2**63 - 1], [2**63 - 1, 5, -(2**63)], [None, -(2**63), 2**63 - 1, 2**63 - 1], [None, None]])
def test_op2_ends_of_the_identifiers(spark, ids):
    for texts in (["ab"] * len(ids), ["x" * 9000 if k == len(ids) - 1 else "y" for k in range(len(ids))]):
        rows = sharded(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))
        check_shards(rows, texts, 10**6)
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))


@pytest.mark.parametrize("hot", [0, 900])
def test_op2_ranges_finer_than_the_rounds_find(spark, monkeypatch, hot):
    from foliograph.llm.common import written

    monkeypatch.setattr(sharding, "COARSE", 16)
    df = spark.range(3000).select(F.when(F.col("id") < hot, 7).otherwise(F.col("id") * 7919 % 10007).alias("doc_id"), F.lit("abc").alias("text")).repartition(5)
    moved = written(sharding.shard(df, parts=20, part_bytes=75).select("doc_id", "size", "shard", "range", "here"), "t")
    rows = sharding.slots(moved).collect()
    check_shards(rows, ["abc"] * 3000, 80)
    ranges = defaultdict(list)
    for r in rows:
        ranges[r["range"]].append(r)
    assert len(ranges) > 140 and max(map(len, ranges.values())) < 60
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_op2_many_splitters_are_found_in_seconds(spark):
    import time

    start = time.time()
    bounds, _ = sharding.splitters(spark.range(200_000).select(F.xxhash64("id").alias("doc_id"), F.xxhash64("id").alias("tie"), F.lit(10).cast("long").alias("size")), sharding.COARSE)
    assert len(bounds) == sharding.COARSE - 1 and bounds == sorted(bounds) and time.time() - start < 60
    halves = sharding._halves(bounds)
    keys = np.random.default_rng(1).integers(0, 2**63, 300_000).astype(np.uint64)
    assert len(sharding._below(keys, keys, halves)) == len(keys) and time.time() - start < 60


def test_op2_odd_and_empty(spark, odd):
    check_shards(sharded(odd), [t for _, t in ROWS], 10**6)
    assert sharded(odd.limit(0)) == []


@pytest.mark.parametrize("n", [1, 3, 17, 511, 512, 513, 700, 1023, 1024, 1025, 5000])
def test_op7_cuts(n):
    pieces = packing.cuts(n)
    assert sum(s for s, _ in pieces) == n
    assert all(1024 // (k + 1) < s <= 1024 // k and 1024 - k * s <= max(k, 16) or s == 1024 // k for s, k in pieces)


def check_packed(rows, docs):
    want = {}
    for (i, _), ids in zip(docs, library([t or "" for _, t in docs])):
        want.setdefault(i, []).append([*ids, 0])
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(want)
    for i, own in by.items():
        assert sum(r.length for r in own) == sum(map(len, want[i]))
        if len(want[i]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                ids = np.array(want[i][0][at : at + r.length], "<u4")
                assert (r.start, r.doc_tokens) == (at, len(want[i][0])) and bytes(r.ids) == ids.tobytes()
                at += r.length
    padding = total = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, total)


def test_op7_packing(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert check_packed(packing.pack(docs, PATH).collect(), [tuple(r) for r in docs.collect()]) < 0.01
    check_packed(packing.pack(odd, PATH).collect(), ROWS)
    assert packing.pack(odd.limit(0), PATH).count() == 0
    assert queries.op7_harmonic_packing(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stretches_are_encoded_together_and_the_first_are_kept():
    """Stretches in one text give the ids that each gives alone; a full worker forgets the later ones only."""
    encoder = tokens.Encoder(PATH)
    odd = ["a1", "1,000", "x\n", "y\n\n\tz", "don't", "'s", "(see", "中文", "éè!", "a b", "end ", "two  ", "<|endoftext|>", "\U0001f600", "Δx", "--", "​", "̀e", "Ġq"] * 2 + [f"{i}%" for i in range(3000)]
    together = encoder._together(odd)
    assert together == encoder._raw([" " + x for x in odd])
    encoder.kept = 40
    texts = [" ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(50, 150)), "w1 w2 new"]
    assert [encoder.encode([t])[0] for t in texts] == encoder._raw(texts)
    assert 0 < len(encoder._known) <= 40
