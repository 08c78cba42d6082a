"""Writers: outlines and reports as JSON, blocks as CSV."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First in a UTF-8 file for programs that would read it as another encoding.
BOM = "\ufeff"


def outlines_json(outlines: DataFrame, folder: str) -> None:
    """(doc_id, title, outline) as JSON lines, as many files as there are tasks; characters beyond ASCII stay."""
    outlines.write.mode("overwrite").json(folder)


def outline_text(outlines: DataFrame) -> DataFrame:
    """(doc_id, json): each outline as pretty-printed text, as a file of its own would hold it."""
    return outlines.select("doc_id", F.to_json(F.struct("title", "outline"), {"pretty": "true"}).alias("json"))


def document_files(rows: DataFrame, folder: str, name: str = "doc_id", indent: int = 2) -> int:
    """One JSON file a row, called after its ``name`` and holding its other columns, indented; how many were written.

    ``folder``: a URI that pyarrow opens on every executor. A file is written under another name and then moved, so a lost
    task leaves no half of one, and a task run again writes the same.
    """
    uri = folder if "://" in folder else f"file://{folder}"
    own = rows.select(F.col(name).cast("string").alias("name"), F.to_json(F.struct(*(c for c in rows.columns if c != name)), {"ignoreNullFields": "false"}).alias("json"))

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(uri)
        fs.create_dir(path, recursive=True)
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                where = f"{path}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(where) as out:
                    out.write(json.dumps(json.loads(text), indent=indent, ensure_ascii=False).encode())
                fs.move(where, f"{path}/{str(name).replace('/', '_')}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return own.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def blocks_csv(blocks: DataFrame, folder: str, bom: bool = True) -> None:
    """CSV files with a header, all fields in quotes and, unless ``bom`` is false, a byte-order mark."""
    quoted = {"quoteAll": "true", "escape": '"'}
    if not bom:
        blocks.write.mode("overwrite").option("header", True).options(**quoted).csv(folder)
        return
    header = BOM + ",".join('"' + c.replace('"', '""') + '"' for c in blocks.columns)
    lines = blocks.select(F.to_csv(F.struct(*(F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(blocks.columns))), quoted).alias("value"))

    def headed(batches):
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
                first = False
            yield batch

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(folder)
