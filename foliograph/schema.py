"""Block, span and outline schemas, and the defaults of missing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLAGS = ["bold", "italic", "underline", "bullet", "math", "hyperlink"]
_BITS = ["is_all_caps", "is_title_case", "ends_with_colon", "starts_with_number", "contains_colon", "contains_semicolon"]
_POS = ["num_nouns", "num_verbs", "num_adjs", "num_advs", "num_propn", "num_pronouns", "num_other_pos"]


def _fields(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names]


BLOCK_SCHEMA = T.StructType(
    [
        *_fields(T.LongType(), "doc_id", "block_id"), *_fields(T.StringType(), "text"), *_fields(T.DoubleType(), "font_size"), *_fields(T.IntegerType(), "page"),
        *_fields(T.DoubleType(), "x0", "y0", "x1", "y1"), *_fields(T.StringType(), "font"), *_fields(T.IntegerType(), "color"), *_fields(T.BooleanType(), *_FLAGS),
        *_fields(T.IntegerType(), *_BITS, "punctuation_count", "word_count"), *_fields(T.DoubleType(), "line_position_on_page", "relative_font_size", "line_spacing_above"),
        *_fields(T.IntegerType(), "distance_to_previous_heading", "is_heading", "heading_level", *_POS),
    ]
)
SPAN_SCHEMA = T.StructType(
    [
        *_fields(T.LongType(), "doc_id"), *_fields(T.IntegerType(), "page"), *_fields(T.DoubleType(), "page_height"), *_fields(T.LongType(), "line_no", "span_no"), *_fields(T.StringType(), "text"),
        *_fields(T.DoubleType(), "size"), *_fields(T.StringType(), "font"), *_fields(T.IntegerType(), "flags", "color"), *_fields(T.DoubleType(), "x0", "y0", "x1", "y1"), *_fields(T.StringType(), "error"),
    ]
)

#: What a column is when a source lacks it.
DEFAULTS = {"page": 1, "heading_confidence": 0.8, "is_heading_pred": 0, "is_heading": 0, "heading_level": 0}


def conform(df: DataFrame) -> DataFrame:
    """Blocks with the columns that all operators need: aliases resolved, NaN as null, defaults for what is missing."""
    if "page" not in df.columns and "page_num" in df.columns:
        df = df.withColumnRenamed("page_num", "page")
    new = {c: F.lit(v) for c, v in DEFAULTS.items() if c not in df.columns}
    if "block_id" not in df.columns:
        new["block_id"] = F.monotonically_increasing_id()
    if "doc_id" not in df.columns:
        new["doc_id"] = F.xxhash64("source_file") if "source_file" in df.columns else F.lit(0).cast("long")
    df = df.withColumns(new)
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in floats} | {"text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
