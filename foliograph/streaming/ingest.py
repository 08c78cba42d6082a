"""Token corpora and block files as they arrive: each file once, whatever stops the run in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import SparkRelation
from ..sources.readers import parse_tokens


def token_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Tokens of the files of a folder, new ones as they come."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)
    return parse_tokens(lines.withColumn("path", F.col("_metadata.file_path")))


def append(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table and stop. The checkpoint is the log of files done."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_documents(stream: DataFrame, table: str, checkpoint: str, plan) -> StreamingQuery:
    """As ``append``, with a plan over whole documents: files hold whole documents, so a batch does too."""

    def each(batch: DataFrame, number: int) -> None:
        plan(SparkRelation(batch)).df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(lambda b, n: each(b, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
