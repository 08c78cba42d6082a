"""Shared folder, written intermediates and file access for the operators.

Intermediates are Parquet tables in the folder that the cluster names in ``spark.checkpoint.dir``: they cut
lineage, and a lost executor never takes their only copy with it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that a Python worker gets at once; documents may be long.
BATCH_ROWS, BATCH_BYTES = "512", str(16 << 20)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, so that a worker never holds thousands of long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    A local master may do without the setting and gets a temporary folder; a cluster may not. A path without a scheme is
    one of the cluster's default file system.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliograph-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: computed once, no lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI; works on executors too."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def byte_column(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def computed(docs: DataFrame, carry: list[str], fields: list[T.StructField], compute: Callable[[list[str]], list[pa.Array]], text: str = "text") -> DataFrame:
    """Columns ``carry`` of ``docs`` and the ``fields`` that ``compute`` makes of a batch of texts. Texts move once."""
    prepare(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in carry] + fields)
    at = carry.index(text) if text in carry else len(carry)
    read = docs.select(*carry, *([] if text in carry else [F.col(text).cast("string").alias("__text")]))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *compute(texts_of(batch.column(at)))], schema.names)

    return read.mapInArrow(run, schema)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with columns named by place, so that no other name can clash, and the name of its text."""
    cast = {"text": "string"}
    renamed = docs.select(*(F.col(c).cast(cast[c]).alias(f"__in{i}") if c in cast else F.col(c).alias(f"__in{i}") for i, c in enumerate(docs.columns)))
    return renamed, f"__in{docs.columns.index('text')}"


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, by their own names, out of what ``numbered`` made."""
    return rows.select(*(F.col(f"__in{i}").alias(c) for i, c in enumerate(docs.columns)))
