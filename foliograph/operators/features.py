"""Feature tables for heading classifiers."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import portable
from ..plans import Relation
from .metadata import DOC

PERCENTILES = (70, 75, 80, 85, 90, 95, 98, 99)
POS = ("num_nouns", "num_verbs", "num_adjs", "num_advs", "num_propn", "num_pronouns", "num_other_pos")


def text_features(r: Relation) -> Relation:
    d = r.d
    r = r.add(__x="coalesce(text, '')")
    flag = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    r = r.add(text_length="CAST(length(__x) AS INT)", char_count="CAST(length(__x) AS INT)", word_count=d.words("__x"))
    share = lambda p: f"CAST({d.count('__x', p)} AS DOUBLE) / (text_length + 1)"
    return r.add(
        avg_word_length="CAST(char_count AS DOUBLE) / (word_count + 1)",
        text_upper_ratio=share("[A-Z]"), text_digit_ratio=share(r"\p{Nd}"), text_punct_ratio=share("[.!?]"), text_space_ratio=share(portable(r"\s")),
        starts_with_capital=flag(d.rx("__x", "^[A-Z]")), all_caps=flag(d.upper("__x")), title_case=flag(d.title("__x")), starts_with_number=flag(d.rx("__x", r"^\p{Nd}")),
        ends_with_colon=flag("__x LIKE '%:'"), has_bold_markers=flag(d.rx("__x", r"\*\*|\bBOLD\b")),
        single_word=flag("word_count = 1"), short_heading=flag("word_count BETWEEN 2 AND 5"), medium_heading=flag("word_count BETWEEN 6 AND 10"),
        has_common_heading_words=flag(d.rx("__x", r"\b(?:chapter|section|part|introduction|conclusion|summary|abstract|references|appendix)\b", "i")),
    ).drop("__x")


def box_features(r: Relation) -> Relation:
    """Place and shape of the box; constants where there is none, or all boxes are at the left edge."""
    d = r.d
    flat = {"x_position": 0.0, "y_position": 0.0, "width": 100.0, "height": 20.0, "center_x": 0.0, "center_y": 0.0, "aspect_ratio": 5.0, "area": 2000.0, "x_position_norm": 0.0, "y_position_norm": 0.0}
    flags = ("left_aligned", "top_of_page", "center_aligned")
    if not (r.has("x0") and r.has("y0")):
        return r.add(**{k: d.num(v) for k, v in flat.items()}, **{k: "0" for k in flags})
    r = r.add(__flat=f"coalesce(min(x0) OVER ({DOC}) = 0 AND max(x0) OVER ({DOC}) = 0, FALSE)", __mx=d.quantile("x0", 0.5, DOC), __my=d.quantile("y0", 0.5, DOC))
    ends = r.has("x1") and r.has("y1")
    z = lambda c: f"coalesce({c}, 0)"
    r = r.add(
        x_position="coalesce(x0, __mx)", y_position="coalesce(y0, __my)",
        width=f"greatest({z('x1')} - {z('x0')}, 0)" if ends else d.num(100.0), height=f"greatest({z('y1')} - {z('y0')}, 0)" if ends else d.num(20.0),
        center_x=f"({z('x0')} + {z('x1')}) / 2" if ends else "coalesce(x0, __mx)", center_y=f"({z('y0')} + {z('y1')}) / 2" if ends else "coalesce(y0, __my)",
    )
    r = r.add(aspect_ratio="width / (height + 1)" if ends else d.num(5.0), area="width * height" if ends else d.num(2000.0))
    r = r.add(
        **{f"{k}_norm": f"({k} - min({k}) OVER ({DOC})) / (max({k}) OVER ({DOC}) - min({k}) OVER ({DOC}) + 1)" for k in ("x_position", "y_position")},
        __x10=d.quantile("x_position", 0.1, DOC), __y10=d.quantile("y_position", 0.1, DOC), __c=d.quantiles("center_x", (0.4, 0.6), DOC),
    )
    r = r.add(__c40=d.item("__c", 1), __c60=d.item("__c", 2))
    r = r.add(
        left_aligned="CASE WHEN x_position <= __x10 THEN 1 ELSE 0 END", top_of_page="CASE WHEN y_position <= __y10 THEN 1 ELSE 0 END",
        center_aligned="CASE WHEN center_x >= __c40 AND center_x <= __c60 THEN 1 ELSE 0 END",
    )
    r = r.add(**{k: f"CASE WHEN __flat THEN {d.num(v)} ELSE {k} END" for k, v in flat.items()}, **{k: f"CASE WHEN __flat THEN 0 ELSE {k} END" for k in flags})
    return r.add(is_wide="CASE WHEN aspect_ratio > 5 THEN 1 ELSE 0 END", is_tall="CASE WHEN aspect_ratio < 2 THEN 1 ELSE 0 END").drop("__flat", "__mx", "__my", "__x10", "__y10", "__c", "__c40", "__c60")


def font_features(r: Relation, percentiles=PERCENTILES) -> Relation:
    d = r.d
    if not r.has("font_size"):
        return r.add(font_size=d.num(12.0), **{f"font_ge_{p}p": "0" for p in percentiles}, font_size_normalized=d.num(0.5), font_size_zscore=d.num(0.0), is_largest_font="0", above_median_font="0")
    r = r.add(font_size=f"coalesce(font_size, {d.quantile('font_size', 0.5, DOC)})")
    r = r.add(__min=f"min(font_size) OVER ({DOC})", __max=f"max(font_size) OVER ({DOC})", __mean=f"avg(font_size) OVER ({DOC})", __std=f"stddev_samp(font_size) OVER ({DOC})", __q=d.quantiles("font_size", [0.5, *(p / 100 for p in percentiles)], DOC))
    r = r.add(__mid=d.item("__q", 1), **{f"__p{p}": d.item("__q", i) for i, p in enumerate(percentiles, 2)})
    return r.add(
        **{f"font_ge_{p}p": f"CASE WHEN font_size >= __p{p} THEN 1 ELSE 0 END" for p in percentiles},
        font_size_normalized="(font_size - __min) / (__max - __min + 1)", font_size_zscore="(font_size - __mean) / (__std + 1)",
        is_largest_font="CASE WHEN font_size = __max THEN 1 ELSE 0 END", above_median_font="CASE WHEN font_size > __mid THEN 1 ELSE 0 END",
    ).drop("__min", "__max", "__mean", "__std", "__q", "__mid", *(f"__p{p}" for p in percentiles))


def page_features(r: Relation) -> Relation:
    r = r.add(page_num="page" if r.has("page") else "1")
    return r.add(is_first_page="CASE WHEN page_num = 1 THEN 1 ELSE 0 END", is_early_page="CASE WHEN page_num <= 3 THEN 1 ELSE 0 END")


def pos_features(r: Relation) -> Relation:
    """Ratios of parts of speech; without a tagger all counts are 0."""
    d = r.d
    r = r.add(**{c: f"coalesce({c}, 0)" if r.has(c) else "0" for c in POS})
    r = r.add(total_pos_tags=" + ".join(POS))
    r = r.add(**{f"{k}_ratio": f"CAST({c} AS DOUBLE) / (total_pos_tags + 1)" for k, c in (("noun", "num_nouns"), ("verb", "num_verbs"), ("adj", "num_adjs"), ("propn", "num_propn"))})
    r = r.add(high_noun_content=f"CASE WHEN noun_ratio > {d.num(0.5)} THEN 1 ELSE 0 END", has_proper_nouns="CASE WHEN num_propn > 0 THEN 1 ELSE 0 END", minimal_verbs=f"CASE WHEN verb_ratio < {d.num(0.2)} THEN 1 ELSE 0 END")
    return r.add(heading_pos_pattern="CASE WHEN high_noun_content = 1 AND has_proper_nouns = 1 AND minimal_verbs = 1 THEN 1 ELSE 0 END")


def passed_features(r: Relation) -> Relation:
    """Columns that come with the blocks, by their defaults where they are missing."""
    d = r.d
    defaults = {"distance_to_previous_heading": "0", "line_spacing_above": d.num(0.0), "relative_font_size": d.num(1.0), "line_position_on_page": d.num(0.5)}
    r = r.add(**{c: f"coalesce({c}, {v})" if r.has(c) else v for c, v in defaults.items()})
    return r.add(**{c: f"CASE WHEN coalesce({c}, FALSE) THEN 1 ELSE 0 END" if r.has(c) else "0" for c in ("bold", "italic", "underline")})


def short_features(r: Relation) -> Relation:
    """The smaller feature set of the precision model."""
    d = r.d
    r = r.add(__n=d.words("coalesce(text, '')"), __left=d.quantile("x0", 0.25, DOC) if r.has("x0") else d.num(0.0))
    cases = {"very_short": "__n <= 3", "short": "__n BETWEEN 4 AND 8", "medium": "__n BETWEEN 9 AND 15", "long": "__n > 15"}
    left = "x0 <= __left" if r.has("x0") else "FALSE"
    return r.add(**{f"text_{k}": f"CASE WHEN {c} THEN 1 ELSE 0 END" for k, c in cases.items()}, left_quarter=f"CASE WHEN {left} THEN 1 ELSE 0 END").drop("__n", "__left")


def retraining_features(r: Relation, exclusions: Mapping[str, int] | None = None) -> Relation:
    """Questions and list entries; addresses and long sentences too, if reports count so many of them excluded.

    ``exclusions``: how often each reason excluded a text, by its name.
    """
    d, seen = r.d, exclusions or {}
    x = "coalesce(text, '')"
    more = {"is_question": f"{x} LIKE '%?'", "is_list_item": d.any_rx(x, map(portable, (r"^\s*[•◦▪▫◾▸►‣⁃]", r"^\s*\d+\.\s+[a-z]")))}
    if seen.get("excluded_urls", 0) > 20:
        more["enhanced_url_detection"] = d.rx(x, r"https?://|www\.|\.com|\.org|\.edu|\.gov|ftp://", "i")
    if seen.get("excluded_long_sentences", 0) > 30:
        more["is_long_sentence"] = f"length({x}) > 100 AND {x} LIKE '%.'"
    return r.add(**{k: f"CASE WHEN {c} THEN 1 ELSE 0 END" for k, c in more.items()})


def aligned(r: Relation, columns: list[str], keys: list[str]) -> Relation:
    """A model's columns in its order: 0 for what is missing, without what is not asked for."""
    return r.pick(*keys, **{c: c if r.has(c) else "0" for c in columns})


def tfidf_rows(blocks: DataFrame, stop_words: list[str], most_terms: int = 50, least: int = 2, most: float = 0.95, pairs: bool = True, fallback: bool = False) -> DataFrame:
    """(doc_id, block_id, term, weight): one- and two-word terms, the most frequent ones, sublinear, smoothed idf, unit rows.

    A table of fewer than 1,000 rows has settings of its own: every term counts however rare, and half as many terms as rows
    at most; under 100 rows, however common, and 20 at most. ``fallback``: plain counts of terms however rare or common.

    The vocabulary is counted by term, added up before the shuffle; it has ``most_terms`` rows at most, which go to every
    task. Only its terms leave the rows they are in.
    """
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda x: ~x.isin(stop_words or [""]))
    once = lambda array: F.explode(F.array(array)).alias("w")  # noqa: E731  # a generator's column is made once and not in each place of its use
    rows = blocks.select("doc_id", "block_id", once(words))
    if pairs:
        n = F.greatest(F.size("w") - 1, F.lit(0))
        rows = rows.select("doc_id", "block_id", once(F.concat("w", F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda x, y: F.concat(x, F.lit(" "), y)))))
    # each term once for the rows it is in, and once each time it occurs
    seen = F.explode(F.concat(F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("tf"))), F.transform("w", lambda x: F.struct(x.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("tf")))))
    counts = rows.select(seen.alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"), F.sum("x.tf").alias("total"))
    size = blocks.count()
    if fallback or size < 100:
        least, most, most_terms = 1, 1.0, min(most_terms if fallback else 20, size)
    elif size < 1000:
        least, most_terms = 1, min(most_terms, size // 2)
    known = counts.where((F.col("df") >= least) & (F.col("df") <= most * size)).orderBy(F.desc("total"), "term").limit(most_terms)
    known = {r.term: math.log((1 + size) / (1 + r.df)) + 1 for r in known.collect()}  # most_terms rows
    kind = "doc_id long, block_id long, term string, weight double"
    if not known:
        return blocks.sparkSession.createDataFrame([], kind)
    idf = F.create_map(*(F.lit(x) for pair in sorted(known.items()) for x in pair))
    own = rows.select("doc_id", "block_id", once(F.filter("w", lambda x: x.isin(list(known))))).where(F.size("w") > 0)
    tf = lambda x: F.size(F.filter("w", lambda y: y == x))
    raw = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("term"), ((tf(x) if fallback else 1 + F.log(tf(x).cast("double"))) * idf[x]).alias("raw")))
    own = own.select("doc_id", "block_id", raw.alias("r"))
    norm = F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, x: a + x["raw"] * x["raw"]))
    return own.select("doc_id", "block_id", norm.alias("norm"), F.inline("r")).select("doc_id", "block_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def local_features(r: Relation) -> Relation:
    """The set of the multi-class model: size strictly above the document's percentiles, length, keyword, numbers for flags."""
    from .quality import keyword

    d = r.d
    r = keyword(r).add(__q=d.quantiles("font_size", (0.9, 0.75, 0.5), DOC), text_length="CAST(length(coalesce(text, '')) AS INT)")
    flags = [c for c in ("bold", "italic", "underline", "bullet", "math", "hyperlink") if r.has(c)]
    return r.add(**{f"font_size_p{p}": f"CASE WHEN font_size > {d.item('__q', i)} THEN 1 ELSE 0 END" for i, p in enumerate((90, 75, 50), 1)}, **{c: f"CASE WHEN coalesce({c}, FALSE) THEN 1 ELSE 0 END" for c in flags}).drop("__q")


COERCED = ("punctuation_count", "line_position_on_page", "relative_font_size", "distance_to_previous_heading", "line_spacing_above", "contains_colon", "contains_semicolon", "word_count")
COERCED_FLAGS = ("bold", "italic", "underline", "bullet", "math", "hyperlink", "is_all_caps", "is_title_case", "ends_with_colon", "starts_with_number")


def coerced(r: Relation) -> Relation:
    """Flags and counts as whole numbers: 0 for what is missing or no number; what lies behind the point is cut off."""
    whole = lambda x: f"CAST(CASE WHEN {x} < 0 THEN ceil({x}) ELSE floor({x}) END AS INT)"
    number = lambda c: f"coalesce(TRY_CAST({c} AS DOUBLE), 0)" if r.has(c) else "CAST(0 AS DOUBLE)"
    r_ = r.add(**{f"__{c}": number(c) for c in COERCED}, **{c: f"CAST(coalesce(CAST({c} AS DOUBLE), 0) AS INT)" for c in COERCED_FLAGS if r.has(c)})
    return r_.add(**{c: whole(f"__{c}") for c in COERCED}).drop(*(f"__{c}" for c in COERCED))


def must_compute(r: Relation) -> Relation:
    """One row: whether the distance to the previous heading, and the parts of speech, have to be computed anew.

    The distance if it is missing or null anywhere; the parts of speech if one of them is missing or all are 0.
    """
    gaps = "count(*) > count(distance_to_previous_heading)" if r.has("distance_to_previous_heading") else "TRUE"
    none = "NOT (" + " OR ".join(f"coalesce(sum({c}), 0) > 0" for c in POS) + ")" if all(map(r.has, POS)) else "TRUE"
    return r.group(blocks="count(*)", needs_distance=gaps, needs_pos=none)


def complete(r: Relation, required=("text", "font_size", "page", "x0", "y0", "x1", "y1", "heading_level")) -> Relation:
    """The rows that lack none of the required columns."""
    return r.where(" AND ".join(f"{c} IS NOT NULL" for c in required))


def missing_columns(columns: list[str], model_columns: list[str]) -> tuple[list[str], list[str]]:
    """What a model asks for and a table lacks, and what the table has besides."""
    return [c for c in model_columns if c not in columns], [c for c in columns if c not in model_columns]
