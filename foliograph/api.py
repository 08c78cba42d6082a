"""Operators on DataFrames, and the pipelines made of them.

Every function takes and returns DataFrames of blocks, for any number of documents at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import classify, filtering, outline, sequential
from .plans import Relation, SparkRelation
from .schema import conform

#: ((name, pattern), ...) of personal data to exclude; none by default.
Personal = tuple[tuple[str, str], ...]


def apply(df: DataFrame, *steps: Callable[[Relation], Relation]) -> DataFrame:
    """Operators of ``operators`` in turn, on a table of blocks."""
    r: Relation = SparkRelation(conform(df))
    for step in steps:
        r = step(r)
    return r.df


def outlines(blocks: DataFrame, personal: Personal = ()) -> DataFrame:
    """(doc_id, title, outline, valid): the rule path from blocks to nested outlines."""
    r = SparkRelation(conform(blocks))
    entries = outline.with_first_h1(outline.outline_rows(classify.rule_headings(r, personal)))
    return outline.valid_outline(outline.nested(SparkRelation(merge_outline(entries.df)), r, [p for _, p in personal])).df


def filter_predictions(blocks: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Predicted blocks with decisions, titles and merged fragments; all columns are carried through.

    ``columns``: those to return alone. What they don't need is then neither computed nor carried to the last merge, which no plan sees through.
    """
    from .operators import merging

    r = filtering.decide(filtering.enhanced_score(SparkRelation(conform(blocks)), more=(merging.of_text,)))
    r = merging.titles_and_prefixes(r)
    r = r.add(text="merged_text").drop("merged_text")
    if columns is None:
        return merge_broken(r.df)
    needed = {*columns, "doc_id", "block_id", "page", "line_position_on_page", "text", "is_heading_pred"}
    return merge_broken(r.pick(*(c for c in r.columns if c in needed)).df).select(*columns)


def merge_outline(entries: DataFrame) -> DataFrame:
    """Entries (doc_id, place, level, text, page) with fragments joined."""
    return sequential.per_document(entries, ["place"], entries.schema, sequential.outline_merge)


def merge_broken(blocks: DataFrame) -> DataFrame:
    """Blocks with headings that were broken into single words joined; broken_decision added."""
    schema = T.StructType([*blocks.schema.fields, T.StructField("broken_decision", T.StringType())])
    order = ["page", *(c for c in ("line_position_on_page",) if c in blocks.columns), "block_id"]
    return sequential.merge_broken(blocks, order, schema)


def check_sequences(blocks: DataFrame) -> DataFrame:
    """One row a document: whether its numbering is consistent."""
    from .operators.numbering import numbering, sequence_check

    return sequence_check(numbering(SparkRelation(blocks))).df


def rule_lines(spans: DataFrame) -> DataFrame:
    """Lines of the rule path from spans: joined, without control characters, with size and position against their page."""
    from .operators import assembly, quality

    r = SparkRelation(spans)
    lines = assembly.line_position(assembly.relative_size(assembly.merge_spans(quality.strip_control(r)), r))
    return conform(lines.df.withColumn("block_id", F.col("line_no")))


def legacy_lines(spans: DataFrame) -> DataFrame:
    """Lines of the older extraction from spans: normalised by NFKC, with their statistics."""
    from .functions.udf import nfkc
    from .operators import assembly

    lines = assembly.merge_spans(SparkRelation(spans)).df
    return assembly.legacy_stats(SparkRelation(lines.withColumn("text", nfkc("text")))).df


def all_features(blocks: DataFrame) -> DataFrame:
    """Blocks with every feature of a heading classifier that needs no vocabulary."""
    from .operators import features

    r: Relation = SparkRelation(conform(blocks))
    for step in (features.text_features, features.box_features, features.font_features, features.page_features, features.pos_features, features.passed_features):
        r = step(r)
    return r.df


def completed(blocks: DataFrame, tag_counts=None) -> DataFrame:
    """Blocks with the distance to the previous heading, and counts of parts of speech, computed where they are missing.

    ``tag_counts``: a function of a text column as ``functions.udf.tag_counts`` makes it; without one the counts are 0.
    """
    from .operators import features, merging

    r = SparkRelation(conform(blocks))
    need = features.must_compute(r).df.first()  # one row
    if need.needs_distance:
        r = merging.distance(r)
    if not need.needs_pos:
        return r.df
    if tag_counts is None:
        return r.df.withColumns({c: F.lit(0) for c in features.POS})
    tagged = r.df.withColumn("__pos", tag_counts("text"))
    return tagged.withColumns({c: F.col(f"__pos.{c}") for c in features.POS}).drop("__pos")


def tfidf(blocks: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """(doc_id, block_id, term, weight) by settings that follow the table's size; of all words alone if no term remains."""
    from pyspark.ml.feature import StopWordsRemover

    from .operators import features

    words = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    found = features.tfidf_rows(blocks, words)
    return features.tfidf_rows(blocks, [], pairs=False, most_terms=10, fallback=True) if found.isEmpty() else found


def train(blocks: DataFrame, columns: list[str], settings=None, version: str = ""):
    """A bundle: a forest on four fifths of each document's blocks, its threshold the best on the rest."""
    from .operators import evaluation, models

    rows = evaluation.split(SparkRelation(all_features(blocks))).df
    forest = models.train_forest(rows.where("NOT held_out"), columns, settings=settings or models.ForestSettings())
    rest = models.predict(forest, rows.where("held_out"))
    best = evaluation.recall_threshold(SparkRelation(rest)).df.first()
    return models.Bundle(forest, columns, best.threshold if best else 0.5, version)


def retrain(original: DataFrame, reports: DataFrame, settings: dict, columns: list[str], reviewed: DataFrame | None = None, decided: DataFrame | None = None, version: str = ""):
    """(bundle, record): a forest on labels, corrections and decisions, by settings adjusted after reports.

    The record has data_sources, rows, headings, the measures on held-out rows, the feedback and the adjusted settings.
    """
    from .operators import evaluation, models

    wrap = lambda df: None if df is None else SparkRelation(conform(df))
    said = evaluation.feedback(SparkRelation(reports)).df.first().asDict()
    reasons = {r.reason: r.blocks for r in evaluation.feedback_reasons(SparkRelation(reports)).where("kind = 'exclusion'").df.collect()}  # a row a reason
    adjusted = models.adjusted(settings, said["average_reduction_rate"] or 0.0, reasons)
    rows = evaluation.training_union(SparkRelation(conform(original)), wrap(reviewed), wrap(decided))
    shape = models.ForestSettings(trees=adjusted["model_params"].get("n_estimators", 2000), depth=adjusted["model_params"].get("max_depth", 15), positive_weight=adjusted["model_params"].get("class_weight", {}).get("1", 75))
    bundle = train(rows.df, columns, shape, version)
    held = evaluation.split(SparkRelation(all_features(rows.df))).where("held_out").df
    measured = SparkRelation(models.predict(bundle.model, held))
    m, a = evaluation.metrics(measured).df.first(), evaluation.auc(measured).df.first()
    sources = {r.data_source: r["count"] for r in rows.df.groupBy("data_source").count().collect()}  # three at most
    record = {"model_version": version, "data_sources": sources, "total_training_samples": sum(sources.values()), "total_headings": rows.df.agg(F.sum("is_heading")).first()[0]}
    record |= {"performance_metrics": {"precision": m.precision, "recall": m.recall, "f1_score": m.f1, "roc_auc": a.auc}, "filtering_feedback": said | {"reasons": reasons}, "adjusted_config": adjusted}
    return bundle, record


def predict_headings(blocks: DataFrame, bundle) -> tuple[DataFrame, DataFrame]:
    """(blocks, reports): features, alignment, prediction at the bundle's threshold, filtering, and a report a document."""
    from .operators import features, models

    made = all_features(blocks)
    missing, _ = features.missing_columns(made.columns, bundle.columns)
    aligned = made.withColumns({c: F.lit(0.0) for c in missing})
    own = [c for c in blocks.columns if c not in ("heading_confidence", "is_heading_pred")]
    scored = models.predict(bundle.model, aligned, bundle.threshold)
    keys = [c for c in conform(blocks).columns if c in scored.columns and c not in own and c not in ("heading_confidence", "is_heading_pred")]
    predicted = scored.select(*keys, *own, "heading_confidence", "is_heading_pred")
    return filter_predictions(predicted), report(predicted)


def report(blocks: DataFrame) -> DataFrame:
    """One row a document of predicted blocks: the filter's report, with statistics, counts and examples."""
    decided = filtering.decide(filtering.enhanced_score(SparkRelation(conform(blocks))))
    return filtering.full_report(decided).df


def register(spark, blocks: DataFrame, prefix: str = "blocks") -> list[str]:
    """Register the rules for SQL, as views over ``blocks`` named ``prefix`` and the rule; the views' names.

    Views are plans, so a query over one is optimised as a whole, which a function for each row would bar.
    """
    from .operators import metadata, numbering, quality, rules

    steps = {"numbering": numbering.numbering, "valid_text": quality.valid_text, "mojibake": quality.mojibake, "false_positive": quality.false_positive, "positive": rules.positive, "exclusion": rules.exclusion, "rule_filter": rules.rule_filter, "metadata": metadata.comprehensive}
    names = []
    for name, step in steps.items():
        names.append(f"{prefix}_{name}")
        apply(blocks, step).createOrReplaceTempView(names[-1])
    return names
