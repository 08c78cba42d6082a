"""The library's queries over the driver's tables.

Each is one plan over a block table, run by Spark and written out as SQL; floats are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, oracle
from .operators import assembly, classify, evaluation, features, filtering, merging, metadata, numbering, outline, quality, rules
from .plans import Relation, SparkRelation
from .sources import blocks, readers
from .sources.blocks import SparkTables, SqlTables

KEY = ("doc_id", "block_id")


def rounded(r: Relation, *columns: str) -> Relation:
    return r.add(**{c: f"round({c}, 6)" for c in columns})


def _unscaled(r: Relation) -> Relation:
    """Positions as line numbers, as sources without page heights have them."""
    return r.add(line_position_on_page="CAST(block_id % 40 AS DOUBLE)")


def _spans(t) -> Relation:
    """Three spans a line, made of blocks."""
    r = blocks.star(t).add(line_no="CAST(floor(block_id / 3) AS BIGINT)", span_no="block_id % 3", size="font_size", font="CASE WHEN bold THEN 'Bold' ELSE 'Plain' END", flags="CAST(block_id % 8 AS INT)", color="CAST(block_id % 5 AS INT)")
    return r.pick("doc_id", "line_no", "span_no", "text", "size", "font", "flags", "color", "x0", "y0", "x1", "y1", page="CAST(floor(line_no / 20) + 1 AS INT)", page_height="CAST(800 AS DOUBLE)")


def a_token_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of tab-separated lines; every third line has the marker that is no token, every seventh too few fields."""
    rows = blocks.star(SparkTables(spark, folder)).df
    fields = ["text", *("CAST(CAST(%s AS INT) AS STRING)" % c for c in ("x0", "y0", "x1", "y1")), "'0'", "'0'", "'0'", "'Font'", "CASE WHEN block_id % 3 = 0 THEN '##LTLine##' WHEN bold THEN 'title' ELSE 'paragraph' END"]
    line = f"CASE WHEN block_id % 7 = 0 THEN concat_ws(chr(9), text, 'short') ELSE concat_ws(chr(9), {', '.join(fields)}) END"
    lines = rows.selectExpr(f"{line} AS value", "concat('/in/', doc_id, '/', block_id, '_', page - 1, '.txt') AS path")
    return readers.parse_tokens(lines).select("path", "text", "label", "page", "x0", "y0", "x1", "y1")


def a_spans_long(t) -> Relation:
    return assembly.spans_long(_spans(t))


def b_merge_spans(t) -> Relation:
    return rounded(assembly.merge_spans(_spans(t)), "x0", "y0", "x1", "y1")


def b_text_flags(t) -> Relation:
    return assembly.text_flags(blocks.star(t)).pick(*KEY, "bullet", "math", "hyperlink", "is_all_caps", "is_title_case", "ends_with_colon", "contains_colon", "contains_semicolon", "starts_with_number", "punctuation_count", "word_count", "text_length", "contains_digits", "language_is_english")


def b_text_flags_lines(t) -> Relation:
    return assembly.text_flags(blocks.lines(t)).pick(*KEY, "bullet", "math", "hyperlink", "is_all_caps", "is_title_case", "ends_with_colon", "punctuation_count", "word_count", "text_length", "contains_digits", "language_is_english")


def b_line_spacing(t) -> Relation:
    r = assembly.line_position(assembly.spacing(blocks.star(t)).add(page_height="CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 900 END"))
    return rounded(r.pick(*KEY, "line_spacing_above", "line_position_on_page"), "line_spacing_above", "line_position_on_page")


def b_strip_control(t) -> Relation:
    return quality.strip_control(blocks.star(t).add(text="concat(chr(8), substr(text, 1, 3), chr(127), chr(9), substr(text, 4), chr(11))")).pick(*KEY, "text")


def b_size_level(t) -> Relation:
    return assembly.heading_level(assembly.text_flags(assembly.size_rank(blocks.star(t)))).pick(*KEY, "size_level", "heading_level")


def b_relative_size(t) -> Relation:
    r = assembly.relative_size(assembly.merge_spans(_spans(t)), _spans(t))
    return rounded(r.pick("doc_id", "page", "line_no", "font_size", "relative_font_size"), "relative_font_size")


def b_auto_label(t) -> Relation:
    return assembly.auto_label(assembly.text_flags(blocks.star(t))).pick(*KEY, "auto_label")


def b_garbage_ratio(t) -> Relation:
    return rounded(assembly.garbage_ratio(quality.valid_text(blocks.star(t))), "garbage_ratio")


def c_valid_text(t) -> Relation:
    return quality.valid_text(blocks.lines(t)).pick(*KEY, "valid_text")


def c_valid_text_star(t) -> Relation:
    return quality.valid_text(blocks.star(t)).pick(*KEY, "valid_text")


def c_mojibake(t) -> Relation:
    return quality.mojibake(blocks.lines(t)).pick(*KEY, "mojibake")


def c_false_positive(t) -> Relation:
    return quality.plain_heading(quality.false_positive(blocks.star(t))).pick(*KEY, "false_positive", "plain_heading")


def c_keyword(t) -> Relation:
    return quality.unwanted_title(quality.keyword(blocks.star(t))).pick(*KEY, "contains_keyword", "unwanted_title")


def d_roman(t) -> Relation:
    r = blocks.star(t).add(number="CAST(1 + (block_id * 37) % 3999 AS INT)").add(roman=numbering.to_roman("number"))
    return r.pick(*KEY, "number", "roman", value=numbering.roman_value("roman"), valid=numbering.valid_roman(r.d, "roman"), text_is_roman=numbering.valid_roman(r.d, "text"))


def d_numbering(t) -> Relation:
    return numbering.numbering(blocks.star(t)).pick(*KEY, "text", "numbered", "number_type", "number_level")


def d_hierarchy(t) -> Relation:
    return numbering.hierarchy(numbering.numbering(blocks.star(t)))


def d_summary_patterns(t) -> Relation:
    from .functions.patterns import SUMMARY_PATTERNS, portable

    r = blocks.star(t)
    return r.pick(*KEY, **{k: r.d.rx("text", portable(p)) for k, p in SUMMARY_PATTERNS.items()})


def e_positive(t) -> Relation:
    return rules.positive(blocks.star(t)).pick(*KEY, positive="coalesce(positive, '')")


def e_rule_filter(t) -> Relation:
    return rules.rule_filter(blocks.star(t)).pick(*KEY, "text", "rule_reject", "rule_reasons")


def e_exclusion(t) -> Relation:
    return rules.exclusion(blocks.star(t), [("named_people", r"^(blue|red)\s+bolt$")]).pick(*KEY, "excluded", "exclusion_reason")


def e_exclusion_lines(t) -> Relation:
    return rules.exclusion(rules.rule_filter(blocks.lines(t))).pick(*KEY, "rule_reject", "rule_reasons", "excluded", "exclusion_reason")


def e_matched_pattern(t) -> Relation:
    return classify.matched_pattern(blocks.star(t)).pick(*KEY, matched="coalesce(matched, '')")


def f_fonts(t) -> Relation:
    r = metadata.fonts(blocks.star(t))
    r = r.pick(*KEY, "font_size_mean", "font_size_std", "font_size_percentile_rank", "font_category", "font_size_relative", "font_size_jump")
    return rounded(r, "font_size_mean", "font_size_std", "font_size_percentile_rank", "font_size_relative")


def f_typography(t) -> Relation:
    return metadata.typography(blocks.star(t)).pick(*KEY, "typography_score", "typography_patterns")


def f_linguistics(t) -> Relation:
    return metadata.linguistics(blocks.star(t)).pick(*KEY, "linguistic_score", "syntax_violations", "linguistic_patterns")


def f_linguistics_lines(t) -> Relation:
    return metadata.linguistics(blocks.lines(t)).pick(*KEY, "linguistic_score", "syntax_violations", "linguistic_patterns")


def f_position(t) -> Relation:
    return metadata.positions(_unscaled(blocks.star(t))).pick(*KEY, "position_score", "position_patterns")


def f_semantics(t) -> Relation:
    return metadata.semantics(blocks.star(t)).pick(*KEY, "semantic_score", "content_type", "semantic_patterns")


def f_structure(t) -> Relation:
    return metadata.structure(metadata.positions(metadata.fonts(_unscaled(blocks.star(t))))).pick(*KEY, "hierarchy_level", "section_boundary", "structure_score", "structure_patterns")


def f_likelihood(t) -> Relation:
    return rounded(metadata.comprehensive(_unscaled(blocks.star(t))).pick(*KEY, "heading_likelihood", "recommended_level", "level_confidence"), "heading_likelihood")


def g_doc_stats(t) -> Relation:
    r = filtering.document_stats(blocks.star(t))
    return rounded(r, "avg_font_size", "font_size_std", "avg_word_count", "blocks_per_page", *(f"font_p{p}" for p in filtering.PERCENTILES))


def g_context(t) -> Relation:
    return rounded(filtering.context(_unscaled(blocks.star(t))).pick(*KEY, "font_size_context", "position_context", "heading_density"), "heading_density")


def g_score(t) -> Relation:
    return rounded(filtering.score(_unscaled(blocks.star(t))).pick(*KEY, "filter_score", "filter_reasons"), "filter_score")


def g_enhanced_score(t) -> Relation:
    return rounded(filtering.enhanced_score(_unscaled(blocks.star(t))).pick(*KEY, "filter_score", "hard_filter"), "filter_score")


def _decided(t, by_text: bool = True) -> Relation:
    return filtering.decide(filtering.enhanced_score(blocks.star(t), by_text))


def g_decision(t) -> Relation:
    return _decided(t).pick(*KEY, "filter_decision", "original_prediction", "is_heading_pred", final_heading_level="coalesce(final_heading_level, '')")


def g_report(t) -> Relation:
    return filtering.report(_decided(t))


def g_summary(t) -> Relation:
    return rounded(filtering.summary(_decided(t)), "reduction_rate")


def g_threshold_precision(t) -> Relation:
    return rounded(evaluation.precision_threshold(blocks.star(t), 0.4), "precision", "recall", "f1")


def h_title(t) -> Relation:
    return merging.document_title(blocks.star(t)).where("title_role IS NOT NULL").pick(*KEY, "title_role", "text")


def h_prefix_merge(t) -> Relation:
    return merging.merge_prefixes(blocks.star(t)).pick(*KEY, "merged_text", "is_heading_pred", merge_decision="coalesce(merge_decision, '')")


def h_combine_runs(t) -> Relation:
    return merging.combine_runs(blocks.star(t))


def h_combine_tokens(t) -> Relation:
    r = blocks.star(t).add(label="CASE WHEN bold THEN 'title' ELSE 'section' END", y0="CAST(floor(block_id / 5) AS DOUBLE)", x1="x0 + 10", y1="CAST(floor(block_id / 5) + 8 AS DOUBLE)")
    return rounded(merging.corpus_level(merging.combine_tokens(r)), "x0", "x1")


def i_distance(t) -> Relation:
    r = merging.distance(blocks.star(t)).pick(*KEY, "page", "is_heading", first="distance_to_previous_heading")
    return merging.distance(r, "0").pick(*KEY, "first", "distance_to_previous_heading")


def i_split(t) -> Relation:
    return merging.split_rows(blocks.star(t)).pick(*KEY, "part", "text", "is_heading", "heading_level")


def i_split_lines(t) -> Relation:
    r = blocks.lines(t).add(is_heading="CASE WHEN block_id = 0 THEN 1 ELSE 0 END", heading_level="CASE WHEN block_id = 0 THEN 1 ELSE 0 END")
    return merging.split_rows(r, headings_only=True).pick(*KEY, "part", "text", "is_heading", "heading_level")


def j_rule_heading(t) -> Relation:
    return classify.rule_headings(blocks.star(t)).pick(*KEY, "heading", "heading_reason", level="coalesce(level, '')")


def j_rule_heading_pages(t) -> Relation:
    return classify.rule_headings(blocks.page(t)).pick(*KEY, "tag", "text", "heading", "heading_reason", level="coalesce(level, '')")


def j_size_levels(t) -> Relation:
    r = classify.heading_size_level(classify.document_size_level(quality.plain_heading(blocks.star(t))))
    return r.pick(*KEY, size_heading="coalesce(size_heading, '')", heading_rank_level="coalesce(heading_rank_level, '')")


def j_pattern_level(t) -> Relation:
    return classify.pattern_level(blocks.star(t)).pick(*KEY, "outline_level")


def k_outline(t) -> Relation:
    return outline.outline_rows(classify.rule_headings(blocks.page(t)))


def k_titles(t) -> Relation:
    return outline.titles(classify.rule_headings(blocks.page(t)))


def l_text(t) -> Relation:
    r = features.text_features(blocks.star(t)).drop("x0", "y0", "x1", "y1", "text", "page", "font_size", "line_position_on_page", "bold", "italic", "is_heading", "heading_level", "heading_confidence", "is_heading_pred")
    return rounded(r, "avg_word_length", "text_upper_ratio", "text_digit_ratio", "text_punct_ratio", "text_space_ratio")


def l_box(t) -> Relation:
    names = ("x_position", "y_position", "width", "height", "center_x", "center_y", "aspect_ratio", "area", "x_position_norm", "y_position_norm")
    return rounded(features.box_features(blocks.star(t)).pick(*KEY, *names, "left_aligned", "top_of_page", "center_aligned", "is_wide", "is_tall"), *names)


def l_font(t) -> Relation:
    r = features.page_features(features.font_features(blocks.star(t)))
    return rounded(r.pick(*KEY, "font_size", *(f"font_ge_{p}p" for p in features.PERCENTILES), "font_size_normalized", "font_size_zscore", "is_largest_font", "above_median_font", "is_first_page", "is_early_page"), "font_size_normalized", "font_size_zscore")


def l_pos(t) -> Relation:
    r = blocks.star(t).add(num_nouns="CAST(block_id % 4 AS INT)", num_verbs="CAST(block_id % 2 AS INT)", num_propn="CAST(block_id % 3 AS INT)")
    r = features.retraining_features(features.short_features(features.pos_features(r)), {"excluded_urls": 21, "excluded_long_sentences": 31})
    return rounded(r.pick(*KEY, "total_pos_tags", "noun_ratio", "verb_ratio", "adj_ratio", "propn_ratio", "high_noun_content", "has_proper_nouns", "minimal_verbs", "heading_pos_pattern", "text_very_short", "text_short", "left_quarter", "is_question", "is_list_item", "enhanced_url_detection", "is_long_sentence"), "noun_ratio", "verb_ratio", "adj_ratio", "propn_ratio")


def l_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.tfidf_rows(blocks.lines(SparkTables(spark, folder)).df, "the of and to in is that it for on".split())
    return rows.withColumn("weight", F.round("weight", 6))


def l_coerced(t) -> Relation:
    r = blocks.star(t).add(punctuation_count="CASE WHEN block_id % 5 = 0 THEN 'many' ELSE CAST(x0 AS STRING) END", relative_font_size="font_size / 10 - 1", is_all_caps="bold")
    return features.coerced(r).pick(*KEY, *features.COERCED, "bold", "italic", "is_all_caps")


def i_must_compute(t) -> Relation:
    r = merging.distance(blocks.star(t)).add(num_nouns="0", num_verbs="0", num_adjs="0", num_advs="0", num_propn="0", num_pronouns="0")
    return features.must_compute(r).union(features.must_compute(r.add(num_other_pos="page", distance_to_previous_heading="0")))


def l_align(t) -> Relation:
    return rounded(features.aligned(features.passed_features(blocks.star(t)), ["font_size", "missing_one", "bold", "relative_font_size", "line_position_on_page"], list(KEY)), "line_position_on_page")


def n_metrics(t) -> Relation:
    return rounded(evaluation.metrics(blocks.star(t), "doc_id"), "accuracy", "precision", "recall", "f1")


def n_confusion(t) -> Relation:
    return evaluation.confusion(assembly.size_rank(blocks.star(t)), predicted="size_level")


def n_threshold_recall(t) -> Relation:
    return rounded(evaluation.recall_threshold(blocks.star(t)), "precision", "recall", "f1", "goal")


def n_auc(t) -> Relation:
    return rounded(evaluation.auc(blocks.star(t)), "auc", "youden_index")


def n_dataset(t) -> Relation:
    r = evaluation.split(evaluation.usable_documents(blocks.star(t)))
    return rounded(evaluation.dataset_stats(r.where("NOT held_out")), "heading_percent")


def _reports(t) -> Relation:
    """Reports of all documents, and one that an older filter made."""
    rows = filtering.reports(_decided(t, by_text=False))
    if isinstance(rows, SparkRelation):  # not a union, which would make the rows twice
        older = "__older = 1"
        return rows.explode("__older", "array(0, 1)").add(doc_id=f"CASE WHEN {older} THEN -doc_id ELSE doc_id END", filter_decision=f"CASE WHEN {older} THEN 'filtered_low_score' ELSE filter_decision END").drop("__older")
    return rows.union(rows.add(doc_id="-doc_id", filter_decision="'filtered_low_score'"))


def o_feedback(t) -> Relation:
    return rounded(evaluation.feedback(_reports(t)), "average_reduction_rate")


def o_feedback_reasons(t) -> Relation:
    return evaluation.feedback_reasons(_reports(t))


def o_training_rows(t) -> Relation:
    r = _decided(t, by_text=False).add(filter_decision="CASE WHEN block_id % 11 = 0 THEN 'filtered_low_score' ELSE filter_decision END")
    return evaluation.training_union(blocks.star(t).where("italic"), blocks.star(t).where("heading_level = 2"), r).pick(*KEY, "is_heading", "data_source")


def n_class_report(t) -> Relation:
    return rounded(evaluation.class_report(assembly.size_rank(blocks.star(t)), predicted="size_level"), "precision", "recall", "f1")


def n_macro_auc(t) -> Relation:
    r = blocks.star(t).add(p0="heading_confidence", p1="1 - heading_confidence", p2="font_size / 30", p3="line_position_on_page")
    return rounded(evaluation.macro_auc(r, "heading_level", {0: "p0", 1: "p1", 2: "p2", 3: "p3"}), "macro_auc")


def f_whitespace(t) -> Relation:
    return metadata.whitespace_above(blocks.star(t).where("block_id % 4 <> 1")).pick(*KEY, "whitespace_above")


def f_tagged(t) -> Relation:
    r = blocks.star(t).add(tags_favourable="CAST(block_id % 5 AS INT)", tags_neutral="CAST(block_id % 2 AS INT)", tags_unfavourable="CAST(block_id % 3 AS INT)", tags="CAST(block_id % 7 AS INT)", has_subject="bold", has_verb="page > 2")
    return rounded(metadata.tagged(r).pick(*KEY, "pos_heading_score", "pos_patterns", "pos_violations"), "pos_heading_score")


def g_enhanced_reasons(t) -> Relation:
    return filtering.enhanced_score(blocks.star(t)).pick(*KEY, "filter_reasons")


def k_named_titles(t) -> Relation:
    names = t("pages").pick(doc_id="page_id", name="concat('annual_report-of_', CAST(page_id AS STRING), '.pdf')")
    return outline.titles(classify.rule_headings(blocks.page(t).where("tag <> 'title' AND tag <> 'h1'")), names)


def k_boxed(t) -> Relation:
    return outline.boxed(blocks.star(t).drop("y1"))


def d_sequence(t) -> Relation:
    return numbering.sequence_check(numbering.numbering(blocks.star(t)))


def p_topk(t) -> Relation:
    return blocks.star(t).top(10, "heading_confidence DESC, page, block_id", "doc_id").pick(*KEY, "heading_confidence")


def p_union_by_name(t) -> Relation:
    r = blocks.star(t)
    both = r.where("bold").pick(*KEY, "font_size").union(r.where("italic").pick(*KEY, "text"))
    return both.pick(*KEY, font_size="coalesce(font_size, 0)", text="coalesce(text, '')")


def q_numbered(t) -> Relation:
    r = blocks.star(t)
    return r.where(r.d.rx(r.d.first_char("text"), "[0-9]") + " AND is_heading = 1").top(50, "page, block_id", "doc_id").pick(*KEY, "page", "text")


def a_ocr_lines(t) -> Relation:
    words = blocks.star(t).pick(*KEY, "page", "text", x="x0", y="y0", width="CAST(60 AS DOUBLE)", height="8 * (font_size - 6) / 3", confidence="CAST(block_id % 100 AS INT)")
    return rounded(assembly.ocr_lines(words), "x0", "y0", "x1", "y1", "font_size")


def a_pages_without_text(t) -> Relation:
    r = assembly.text_flags(blocks.star(t))
    pages = r.group("doc_id", "page", blocks="count(*)")
    return assembly.pages_without_text(pages, r.add(page="page * 2"))


def b_legacy_stats(t) -> Relation:
    return assembly.legacy_stats(blocks.star(t)).pick(*KEY, "text_length", "num_words", "contains_digits", "contains_punctuation", "language")


def b_legacy_stats_lines(t) -> Relation:
    return assembly.legacy_stats(blocks.lines(t)).pick(*KEY, "text_length", "num_words", "contains_digits", "contains_punctuation", "language")


def g_tune_thresholds(t) -> Relation:
    r = filtering.score(blocks.star(t)).where("is_heading_pred = 1").add(filter_score="round(filter_score, 6)")
    return rounded(evaluation.sweep(r, [round(0.20 + 0.05 * i, 2) for i in range(14)], "filter_score"), "precision", "recall", "f1")


def j_predicted_outline(t) -> Relation:
    return outline.predicted_outline(assembly.size_rank(blocks.star(t)), "size_level")


def k_first_title(t) -> Relation:
    rows = outline.outline_rows(classify.rule_headings(blocks.star(t)))
    return outline.first_heading_title(rows, rows.d)


def l_local(t) -> Relation:
    return features.local_features(features.complete(blocks.star(t))).pick(*KEY, "font_size_p90", "font_size_p75", "font_size_p50", "bold", "text_length", "contains_keyword")


def q_listing(t) -> Relation:
    return outline.listing(blocks.star(t).where("is_heading = 1"), ["^blue "], 20).pick(*KEY, "kind", "page", "text")


#: Queries that are not plans of one relation; their SQL, where there is any, is in ``oracle``.
DIRECT = {f.__name__: f for f in (a_token_rows, l_tfidf)}
PLANS: dict[str, Callable] = {k: f for k, f in globals().items() if k[1:2] == "_" and callable(f) and k[0] in "abcdefghijklmnopq" and k not in DIRECT}


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, folder, f=f: f(SparkTables(spark, folder)).df) for k, f in PLANS.items()} | DIRECT | SPARK_ONLY


def sql_queries() -> dict[str, str]:
    """SQL for DuckDB: written by hand where there is a text in ``oracle``, else the query's own plan."""
    return {k: f(SqlTables()).sql() for k, f in PLANS.items()} | oracle.SQL


def h_broken_merge(spark: SparkSession, folder: str) -> DataFrame:
    df = blocks.star(SparkTables(spark, folder)).pick("doc_id", "block_id", "page", "line_position_on_page", "text", "is_heading_pred").df
    return api.merge_broken(df)


def h_outline_merge(spark: SparkSession, folder: str) -> DataFrame:
    return api.merge_outline(outline.outline_rows(classify.rule_headings(blocks.star(SparkTables(spark, folder)))).df)


def k_outline_nested(spark: SparkSession, folder: str) -> DataFrame:
    return api.outlines(blocks.page(SparkTables(spark, folder)).df)


def n_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of a forest on the held-out part. No SQL: trees are random, if seeded."""
    from .operators import models

    columns = ["text_length", "word_count", "text_upper_ratio", "text_digit_ratio", "starts_with_capital", "font_size_normalized", "font_ge_90p", "bold", "is_early_page"]
    rows = features.passed_features(features.page_features(features.font_features(features.text_features(evaluation.split(blocks.star(SparkTables(spark, folder))))))).df
    model = models.train_forest(rows.where("NOT held_out"), columns, settings=models.ForestSettings())
    return models.predict(model, rows.where("held_out")).select("doc_id", "block_id", "is_heading", "is_heading_pred", "heading_confidence")


def q_outline_listing(spark: SparkSession, folder: str) -> DataFrame:
    """What is numbered in the outlines themselves."""
    rows = outline.entries(SparkRelation(api.outlines(blocks.star(SparkTables(spark, folder)).df)))
    return outline.listing(rows, ["^blue "], 20).pick("doc_id", "kind", "level", "text").df


def g_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The whole filter: decisions, titles and merges; no SQL, since the last merge is greedy."""
    columns = [*KEY, "text", "is_heading_pred", "filter_decision", "title_role", "merge_decision", "broken_decision"]
    return api.filter_predictions(blocks.star(SparkTables(spark, folder)).df, columns)


def g_full_report(spark: SparkSession, folder: str) -> DataFrame:
    """Reports as text, one row a document."""
    rows = api.report(blocks.star(SparkTables(spark, folder)).df)
    return rows.select("doc_id", F.to_json(F.struct(*(c for c in rows.columns if c != "doc_id"))).alias("report"))


def n_predict(spark: SparkSession, folder: str) -> DataFrame:
    """A bundle trained on the even documents and applied to the odd ones, filtered; trees are random, if seeded."""
    from .operators import models

    rows = blocks.star(SparkTables(spark, folder)).df
    bundle = api.train(rows.where("doc_id % 2 = 0"), ["text_length", "word_count", "font_size_normalized", "font_ge_90p", "bold"], models.ForestSettings(trees=20, depth=8))
    found, _ = api.predict_headings(rows.where("doc_id % 2 = 1").drop("heading_confidence", "is_heading_pred"), bundle)
    return found.select(*KEY, "heading_confidence", "is_heading_pred", "filter_decision")


#: Queries that SQL cannot express: greedy merges, nested results, random forests.
SPARK_ONLY = {f.__name__: f for f in (h_broken_merge, h_outline_merge, k_outline_nested, n_forest, q_outline_listing, g_filter, g_full_report, n_predict)}
