"""Greedy merges: each step depends on what the steps before it consumed.

They run per document over its blocks in order. A document's rows come to one task, as a stream of batches; what is held
is the few rows that a merge may look ahead to, so the length of a document does not matter. Of blocks, only the columns
that a merge reads leave Arrow; the others pass through as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.patterns import PREFIXES

STOP = {"the", "a", "an", "and", "or", "but"}


def _prefix() -> Callable[[str], bool]:
    import re

    tests = [re.compile(p, re.I if f else 0).match for _, p, f in PREFIXES]
    return lambda text: any(t(text) for t in tests)


def per_document(df: DataFrame, order: list[str], schema, run: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """Apply ``run`` to the rows of each document in order; rows come and go one by one."""
    names = [x.name for x in schema.fields]

    def batches(found):
        def rows():
            for batch in found:
                yield from batch.to_pylist()

        out = []
        for _, own in groupby(rows(), key=lambda r: r["doc_id"]):
            for row in run(own):
                out.append(row)
                if len(out) >= 4096:
                    yield pack(out)
                    out = []
        if out:
            yield pack(out)

    def pack(rows):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.field(c).type) for c in names], names)

    return df.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(batches, schema)


AHEAD = 3  # rows after a block that a merge of broken headings may read


def broken_headings(texts: list, heads: list, pages: list, docs: list, done: list, rows: Iterable[int]) -> tuple[list[int], list[int]]:
    """Join single capitalised words that follow one another as headings on a page, beginning at ``rows`` in turn, in place.

    The first of them takes the text; ``done`` gets the decisions. A block needs two more of its document after it.
    Returns the rows that took a text and those that gave theirs.
    """
    took, gave = [], []
    for i in rows:
        last = i + 1
        while last < len(docs) and last <= i + AHEAD and docs[last] == docs[i]:
            last += 1
        text = (texts[i] or "").strip()
        if done[i] is not None or last - i < 3 or heads[i] != 1 or not _single(text):
            continue
        own = [i]
        for k in range(i + 1, last):
            if done[k] is not None:
                continue
            t = (texts[k] or "").strip()
            if heads[k] != 1 or pages[k] != pages[i]:
                break
            if _single(t):
                own.append(k)
            else:
                if t and len(t.split()) <= 3 and t[0].isupper():
                    own.append(k)
                break
        found = [(texts[k] or "").strip() for k in own]
        merged = " ".join(found)
        if len(own) > 1 and len(merged) >= 5 and len(merged.split()) <= 6 and not any(t.lower() in STOP for t in found):
            texts[i], done[i] = merged, "merged_broken_heading"
            took.append(i)
            for k in own[1:]:
                heads[k], done[k] = 0, "merged_into_broken_heading"
                gave.append(k)
    return took, gave


def merge_broken(df: DataFrame, order: list[str], schema) -> DataFrame:
    """Blocks with broken_headings() applied to each document; ``schema`` is theirs with broken_decision after it."""
    places = [df.columns.index(c) for c in ("text", "is_heading_pred", "page", "doc_id")]
    decision = len(df.columns)

    def codes(column: pa.Array) -> tuple[list, np.ndarray]:
        """An array's values, each once, and the place of each row's value among them."""
        found = column.dictionary_encode("encode")
        return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)

    def applied(table: pa.Table, upto: int) -> pa.Table:
        if not upto:
            return table
        text, pred, page, doc, done = (pa.concat_arrays(table.column(k).chunks) for k in (*places, decision))
        values, at = codes(text)
        single = np.array([_single((v or "").strip()) for v in values])[at]
        heads = pc.fill_null(pc.equal(pred, 1), False).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(heads[:upto] & single[:upto]).tolist()  # others begin nothing
        texts, decisions = [values[c] for c in at.tolist()], [None] * len(done) if done.null_count == len(done) else done.to_pylist()
        took, gave = broken_headings(texts, heads.tolist(), codes(page)[1].tolist(), codes(doc)[1].tolist(), decisions, rows)
        if not took:
            return table

        def changed(column: pa.Array, own: list[int], by: list) -> pa.Array:
            mask = np.zeros(len(column), bool)
            mask[own] = True
            return pc.replace_with_mask(column, pa.array(mask), pa.array([by[i] for i in own], column.type))

        both = sorted(took + gave)
        new = {places[0]: changed(text, took, texts), places[1]: changed(pred, sorted(gave), [0] * len(texts)), decision: changed(done, both, decisions)}
        for k, column in new.items():
            table = table.set_column(k, table.schema.field(k), column)
        return table

    def batches(found):
        held = None
        for batch in found:
            now = pa.Table.from_batches([batch]).append_column(pa.field("broken_decision", pa.string()), pa.nulls(batch.num_rows, pa.string()))
            now = now if held is None else pa.concat_tables([held, now])
            upto = max(0, now.num_rows - AHEAD)
            now = applied(now, upto)
            yield from now.slice(0, upto).combine_chunks().to_batches()
            held = now.slice(upto)
        if held is not None and held.num_rows:
            yield from applied(held, held.num_rows).combine_chunks().to_batches()

    return df.repartition("doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(batches, schema)


def _single(text: str) -> bool:
    return len(text.split()) == 1 and text.isalpha() and text[0].isupper()


def outline_merge(rows: Iterator[dict]) -> Iterator[dict]:
    """Join entries of an outline: a bare number or letter with the next, and runs of up to four single words."""
    is_prefix, window, place = _prefix(), [], 0
    rows = iter(rows)

    def fill(n: int) -> None:
        while len(window) < n and (row := next(rows, None)) is not None:
            window.append(dict(row))

    fill(5)
    while window:
        first = window[0]
        text, used, out = first["text"].strip(), 1, dict(first)
        follows = len(window) > 1 and window[1]["page"] == first["page"]
        after = window[1]["text"].strip() if follows else ""
        if follows and is_prefix(text) and after and after[0].isupper() and len(after.split()) <= 10:
            out["text"], out["level"], used = f"{text} {after}".strip(), window[1]["level"], 2
        elif follows and _single(text):
            texts = [text]
            for other in window[1:4]:
                t = other["text"].strip()
                if other["page"] != first["page"] or not _single(t):
                    break
                texts.append(t)
            merged = " ".join(texts)
            if len(texts) > 1 and len(merged) >= 5 and len(texts) <= 6:
                out["text"], used = merged, len(texts)
        place += 1
        out["place"] = place
        yield out
        del window[:used]
        fill(5)
