"""Readers: documents as bytes, block tables as CSV, labelled token corpora, JSON settings and reports, saved models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = [",", ";", "\t", "|"]
NOT_A_TOKEN = "##LTLine##"


def documents(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, name, path, bytes, content) of the documents in a folder; doc_id is a hash of the path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path", F.col("length").alias("bytes"), "content")


def spans(documents_: DataFrame, extract) -> DataFrame:
    """The spans of documents, by a function from a document's bytes to rows of SPAN_SCHEMA less doc_id.

    The library that reads a format is the caller's; a document that it fails on gives one row with its error.
    """
    import pandas as pd

    from ..schema import SPAN_SCHEMA

    names = [f.name for f in SPAN_SCHEMA.fields]

    def run(frames):
        for frame in frames:
            out = []
            for doc_id, content in zip(frame["doc_id"], frame["content"]):
                try:
                    out += [{"doc_id": doc_id, **row} for row in extract(bytes(content))]
                except Exception as e:  # one document must not stop the others
                    out.append({"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda x: x.notna(), None)

    return documents_.select("doc_id", "content").mapInPandas(run, SPAN_SCHEMA)


def delimiter(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """(path, delimiter) of files, by what occurs most in the first line of their first 2,048 bytes; a comma if none does."""
    head = F.split(F.decode(F.substring("content", 1, 2048), "UTF-8"), "\r?\n").getItem(0)
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", head.alias("h"))
    counts = F.array(*(F.struct((F.length("h") - F.length(F.replace("h", F.lit(c), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(DELIMITERS)))
    best = F.array_max(counts)
    return found.select("path", F.when(best["n"] > 0, best["c"]).otherwise(",").alias("delimiter"))


def blocks_csv(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """Blocks from CSV files with a header, whatever their delimiters, without files of predictions; source_file added."""
    by: dict[str, list[str]] = {}
    for r in delimiter(spark, folder).where(~F.col("path").endswith("_with_predictions.csv")).collect():  # one row a file
        by.setdefault(r.delimiter, []).append(r.path)
    parts = []
    for mark, paths in sorted(by.items()):
        reader = spark.read.option("header", True).option("sep", mark).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(paths)
        df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
        parts.append(df.withColumn("source_file", F.regexp_extract(F.input_file_name(), "([^/]*)$", 1)))
    if not parts:
        raise FileNotFoundError(f"no CSV files in {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def parse_tokens(lines: DataFrame) -> DataFrame:
    """Tokens of (value, path): text, box and label of lines of ten tab-separated fields or more; page from the file's name."""
    f = F.split("value", "\t")
    page = F.try_to_number(F.regexp_extract("path", r"_(\d+)\.[A-Za-z]+$", 1), F.lit("9999999")).cast("int")
    rows = lines.where(F.size(f) >= 10).select("path", *(f.getItem(i).alias(n) for i, n in enumerate(["text", "x0", "y0", "x1", "y1"])), F.element_at(f, -1).alias("label"), (F.coalesce(page, F.lit(0)) + 1).alias("page"))
    rows = rows.where((F.col("text") != NOT_A_TOKEN) & (F.col("label") != NOT_A_TOKEN))
    return rows.withColumns({c: F.col(c).try_cast("double") for c in ("x0", "y0", "x1", "y1")})


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return parse_tokens(spark.read.text(folder).withColumn("path", F.input_file_name()))


def settings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def reports(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """Filter reports, their decision counts as rows: (doc_id, filter_decision, blocks, reduction_rate), the file being the document."""
    schema = "timestamp string, decision_breakdown map<string, long>, filtering_summary struct<total_blocks: long, original_predictions: long, final_predictions: long, filtered_count: long, reduction_rate: double>"
    found = spark.read.schema(schema).option("pathGlobFilter", glob).json(folder, multiLine=True)
    return found.select(F.input_file_name().alias("doc_id"), F.col("filtering_summary.reduction_rate").alias("reduction_rate"), F.explode("decision_breakdown").alias("filter_decision", "blocks"))


def status(spark: SparkSession, folders: dict[str, str], models: str | None = None, newest: int = 5) -> DataFrame:
    """(kind, name, files, modified): how many files each folder has, as name: 'folder/*.ending', and the newest models."""
    listed = lambda path: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", path.rsplit("/", 1)[1]).load(path.rsplit("/", 1)[0]).select("path", F.col("modificationTime").alias("modified"))
    out = spark.createDataFrame([], "kind string, name string, files long, modified timestamp")
    for name, path in folders.items():
        out = out.unionAll(listed(path).agg(F.count("*").alias("files"), F.max("modified").alias("modified")).select(F.lit("folder"), F.lit(name), "files", "modified"))
    if models is not None:
        last = listed(models).orderBy(F.desc("modified"), "path").limit(newest)
        out = out.unionAll(last.select(F.lit("model"), F.regexp_extract("path", "([^/]*)$", 1), F.lit(1).cast("long"), "modified"))
    return out


def latest_model(listing: DataFrame) -> DataFrame:
    """Of (name, mtime): the newest, 'retrained' counting 1,000,000 seconds and 'trained' 100,000 seconds more."""
    bonus = F.when(F.contains("name", F.lit("retrained")), 1_000_000).when(F.contains("name", F.lit("trained")), 100_000).otherwise(0)
    return listing.agg(F.max_by("name", F.struct(F.col("mtime") + bonus, "name")).alias("name"))
