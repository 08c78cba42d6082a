"""Scores and decisions that keep or drop predicted headings, and reports of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window

from ..functions import patterns as P
from ..functions.patterns import portable
from ..plans import Relation, SparkRelation
from .metadata import DOC, ORDERED, comprehensive
from .rules import exclusion, positive, rule_filter

PERCENTILES = (50, 70, 75, 80, 85, 90, 95, 98, 99)
HIGH, MEDIUM, LOW, VIOLATIONS = 0.8, 0.5, 0.3, 8


def document_stats(r: Relation) -> Relation:
    """One row a document: blocks, font sizes and their percentiles, words, pages."""
    d = r.d
    r = r.add(__n=d.words("coalesce(text, '')"))
    r = r.group(
        "doc_id",
        total_blocks="count(*)", avg_font_size="avg(font_size)", font_size_std="stddev_samp(font_size)",
        __q=d.quantiles("font_size", [p / 100 for p in PERCENTILES]),
        avg_word_count="avg(__n)", total_pages="max(page)", blocks_per_page="CAST(count(*) AS DOUBLE) / CASE WHEN max(page) > 0 THEN max(page) ELSE 1 END",
    )
    return r.add(**{f"font_p{p}": d.item("__q", i) for i, p in enumerate(PERCENTILES, 1)}).drop("__q")


def context(r: Relation) -> Relation:
    """Two blocks before and after: how the font compares, how many are predicted; and the place on the page."""
    d = r.d
    near = f"{ORDERED} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"
    r = r.add(
        __rows=f"count(*) OVER ({near}) - 1", __known=f"count(font_size) OVER ({near})", __sum=f"sum(font_size) OVER ({near})", __hits=f"sum(is_heading_pred) OVER ({near})",
        __most="max(line_position_on_page) OVER (PARTITION BY doc_id, page)",
    )
    r = r.add(__mean="CASE WHEN font_size IS NOT NULL AND __known = __rows + 1 AND __rows > 0 THEN (__sum - font_size) / __rows END")
    return r.add(
        font_size_context=d.cases((f"font_size > __mean * {d.num(1.2)}", "'larger'"), (f"font_size < __mean * {d.num(0.8)}", "'smaller'"), otherwise="'normal'"),
        position_context=d.cases(("coalesce(line_position_on_page, 0) <= 3", "'top'"), ("line_position_on_page >= __most - 3", "'bottom'"), otherwise="'middle'"),
        heading_density=f"coalesce(CAST(__hits - is_heading_pred AS DOUBLE) / nullif(__rows, 0), {d.num(0.0)})",
    ).drop("__rows", "__known", "__sum", "__hits", "__most", "__mean")


def score(r: Relation) -> Relation:
    """The additive score of a block and its reasons. Needs is_heading_pred and heading_confidence."""
    d = r.d
    t, n, q = {"__t": d.strip("coalesce(text, '')")}, {"__n": d.words("__t")}, {"__q": d.quantiles("font_size", (0.5, 0.9, 0.95, 0.98), DOC)}
    tests = {"short": "__n <= 1 AND length(__t) < 5", "caps": f"{d.upper('__t')} AND length(__t) > 50", "sentence": "__t LIKE '%.' AND __n > 10"}
    said = {"rule_reject": "concat('rule_reject_', replace(rule_reasons, ';', '; rule_reject_'))", "excluded": "concat('excluded_', exclusion_reason)", "positive": "concat('positive_', positive)"}
    steps, once = [positive, rule_filter, exclusion], {}
    if isinstance(r, SparkRelation):  # what is asked and said of the text alone is made once a text, and comes to the rows when the windows are done
        once = {f"__{k}": v for k, v in (tests | said).items()}
        near = context(r).add(**q)
        found = near.by_text(*steps, lambda r: r.add(**t).add(**n).add(**once))
        r = found.pick(*r.columns, *(c for c in found.columns if c not in near.columns), *(c for c in near.columns if not r.has(c)))
        tests, said = {k: f"__{k}" for k in tests}, {k: f"__{k}" for k in said}
    else:
        r = context(r.by_text(*steps)).add(**t, **q)
    r = r.add(**({} if once else n), **{f"__p{p}": d.item("__q", i) for i, p in enumerate((50, 90, 95, 98), 1)})
    c = f"coalesce(heading_confidence, {d.num(HIGH)})"
    figure = lambda name: f"concat('{name}_', {d.fixed(c, 3)})"
    own = {k: figure(k) for k in ("high_confidence", "medium_confidence", "low_confidence", "very_low_confidence")} | said
    confident = [(f"{c} >= {d.num(HIGH)}", 0.4, "high_confidence"), (f"{c} >= {d.num(MEDIUM)}", 0.2, "medium_confidence"), (f"{c} >= {d.num(LOW)}", 0.0, "low_confidence"), ("TRUE", -0.05, "very_low_confidence")]
    length = [(tests["short"], -0.2, "very_short"), ("__n > 30", -0.3, "too_long"), ("__n > 20", -0.1, "moderately_long"), ("__n BETWEEN 2 AND 15", 0.15, "good_length")]
    font = [("font_size >= __p98", 0.4, "very_large_font"), ("font_size >= __p95", 0.3, "large_font"), ("font_size >= __p90", 0.2, "above_avg_font"), ("font_size >= __p50", 0.1, "normal_font")]
    around = [("font_size_context = 'larger'", 0.15, "larger_than_context"), ("font_size_context = 'smaller'", -0.15, "smaller_than_context")]
    place = [("position_context = 'top'", 0.2, "top_position"), ("position_context = 'bottom'", -0.15, "bottom_position")]
    density = [(f"heading_density > {d.num(0.5)}", -0.2, "high_heading_density"), ("heading_density = 0", 0.1, "isolated_heading")]
    high = [("line_position_on_page <= 2", 0.2, "page_top"), ("line_position_on_page <= 5", 0.1, "near_top")]
    alone = [[("rule_reject", -0.2, "rule_reject")], confident, [("excluded", -0.2, "excluded")], [("positive IS NOT NULL", 0.5, "positive")], length, font, around, place, density]
    alone += [[(tests["caps"], -0.3, "long_all_caps")], [(tests["sentence"], -0.4, "long_sentence")]]
    alone += [[(f"coalesce({c}, FALSE)", p, f"{c}_text")] for c, p in (("bold", 0.15), ("italic", 0.1)) if r.has(c)] + [high]
    if r.has("num_nouns") and r.has("num_verbs"):
        alone.append([(f"__n > 0 AND {d.ratio('num_nouns', '__n')} > {d.num(0.4)} AND {d.ratio('num_verbs', '__n')} < {d.num(0.2)}", 0.1, "good_pos_ratio")])
    if r.has("num_propn"):
        names = {n: (portable(p), f) for n, p, f in P.EXCLUSIONS}
        person = " OR ".join(d.rx("__t", *names[n]) for n in ("person_names", "university_patterns"))
        alone.append([(f"num_propn > 0 AND NOT ({person})", 0.05, "contains_proper_nouns")])
    total = " + ".join(d.cases(*((cond, d.num(p)) for cond, p, _ in part), otherwise=d.num(0.0)) for part in alone)
    why = ", ".join(d.cases(*((cond, own.get(n, f"'{n}'")) for cond, _, n in part)) for part in alone)
    return r.add(filter_score=f"{d.num(0.5)} + {total}", filter_reasons=f"concat_ws('; ', {why})").drop("__t", "__n", "__q", "__p50", "__p90", "__p95", "__p98", *once)


def _hard(d) -> str:
    return f"(__t LIKE '%,' OR {d.rx('__t', '^(the|this|that|these|it) ')} OR {d.words('__t')} > 15 OR lower(__t) IN ('initially,', 'bcrypt.js', 'dockerfile', 'docker-based'))"


def enhanced_score(r: Relation, by_text: bool = True, more: tuple[Callable[[Relation], Relation], ...] = ()) -> Relation:
    """The score from the metadata of comprehensive(), within 0 and 1: filter_score, hard_filter, and why, as filter_reasons."""
    d = r.d
    stripped = {"__t": d.strip("coalesce(text, '')")}
    if not r.has("heading_likelihood"):
        r = comprehensive(r, by_text, (lambda r: r.add(**stripped).add(__hard=_hard(d)).drop("__t"), *more))
    r = r.add(**({} if r.has("__hard") else stripped), __c=f"coalesce(heading_confidence, {d.num(HIGH)})")
    hard = "__hard" if r.has("__hard") else _hard(d)
    parts = [
        d.cases((f"__c >= {d.num(HIGH)}", d.num(0.2)), (f"__c >= {d.num(MEDIUM)}", d.num(0.1)), otherwise=d.num(-0.1)),
        f"- {d.num(0.15)} * syntax_violations",
        d.cases(("content_type = 'heading_candidate'", d.num(0.1)), ("content_type IN ('technical', 'fragment')", d.num(-0.2)), otherwise=d.num(0.0)),
        d.cases(("font_category IN ('very_large', 'large')", d.num(0.1)), otherwise=d.num(0.0)),
        f"greatest(structure_score, 0) * {d.num(0.05)}", f"greatest(position_score, 0) * {d.num(0.03)}",
    ]
    text = lambda c: f"CAST({c} AS STRING)"
    why = [
        d.cases((f"__c >= {d.num(HIGH)}", f"concat('high_confidence_', {d.fixed('__c', 3)})"), (f"__c >= {d.num(MEDIUM)}", f"concat('medium_confidence_', {d.fixed('__c', 3)})"), otherwise=f"concat('low_confidence_', {d.fixed('__c', 3)})"),
        f"CASE WHEN syntax_violations > 0 THEN concat('syntax_violations_', {text('syntax_violations')}) END",
        "CASE WHEN content_type = 'heading_candidate' THEN content_type WHEN content_type IN ('technical', 'fragment') THEN concat('content_type_', content_type) END",
        "CASE WHEN font_category IN ('very_large', 'large') THEN concat('font_', font_category) END",
        *(f"CASE WHEN {c} > 0 THEN concat('{c}_', {text(c)}) END" for c in ("structure_score", "position_score")),
        f"CASE WHEN {hard} THEN 'hard_filter_applied' END",
    ]
    r = r.add(filter_reasons=f"concat_ws('; ', {', '.join(why)})", __s="heading_likelihood + " + " + ".join(parts).replace("+ - ", "- "))
    return r.add(filter_score=f"greatest({d.num(0.0)}, least({d.num(1.0)}, CASE WHEN {hard} THEN least(__s, {d.num(0.2)}) ELSE __s END))", hard_filter=hard).drop("__t", "__c", "__s", "__hard")


def decide(r: Relation) -> Relation:
    """filter_decision, the prediction after it, and the level. Needs enhanced_score(); only predicted rows are judged."""
    d = r.d
    c = f"coalesce(heading_confidence, {d.num(HIGH)})"
    r = r.add(filter_decision=d.cases(
        ("is_heading_pred <> 1", "'not_predicted'"),
        (f"syntax_violations >= {VIOLATIONS} OR heading_likelihood < {d.num(0.01)}", "'filtered_hard_criteria'"),
        (f"content_type = 'technical' AND {c} < {d.num(LOW)} AND filter_score < {d.num(0.1)}", "'filtered_soft_criteria'"),
        (f"{c} >= {d.num(HIGH)}", "'keep_high_confidence'"),
        (f"filter_score >= {d.num(0.2)}", "'keep_good_score'"),
        (f"{c} >= {d.num(MEDIUM)}", "'keep_medium_quality'"),
        otherwise="'keep_low_quality'",
    ))
    return r.add(
        original_prediction="is_heading_pred",
        is_heading_pred="CASE WHEN filter_decision LIKE 'keep%' THEN 1 ELSE 0 END",
        final_heading_level="CASE WHEN filter_decision LIKE 'keep%' THEN recommended_level WHEN filter_decision LIKE 'filtered%' THEN 'H3' END",
    )


def report(r: Relation) -> Relation:
    """One row a document and decision: how many blocks."""
    return r.group("doc_id", "filter_decision", blocks="count(*)")


def summary(r: Relation) -> Relation:
    """One row a document: predictions before and after, and the share that went."""
    d = r.d
    r = r.group("doc_id", total_blocks="count(*)", original_predictions="sum(original_prediction)", final_predictions="sum(is_heading_pred)")
    return r.add(
        original_predictions="CAST(original_predictions AS BIGINT)", final_predictions="CAST(final_predictions AS BIGINT)",
        filtered_count="CAST(original_predictions - final_predictions AS BIGINT)",
        reduction_rate=f"coalesce({d.ratio('100 * (original_predictions - final_predictions)', 'original_predictions')}, {d.num(0.0)})",
    )


def reports(r: Relation) -> Relation:
    """report() with the reduction_rate of summary(); Spark reads the decided blocks once and adds up their counts."""
    if not isinstance(r, SparkRelation):
        return report(r).join(summary(r).pick("doc_id", "reduction_rate"), ["doc_id"])
    d = r.d
    r = r.group("doc_id", "filter_decision", blocks="count(*)", __o="sum(original_prediction)", __f="sum(is_heading_pred)")
    r = r.add(__o=f"sum(__o) OVER ({DOC})", __f=f"sum(__f) OVER ({DOC})")
    return r.add(reduction_rate=f"coalesce({d.ratio('100 * (__o - __f)', '__o')}, {d.num(0.0)})").drop("__o", "__f")


def full_report(r: SparkRelation, reasons: str = "filter_reasons", n: int = 10) -> SparkRelation:
    """One row a document, in the shape of a report: document_stats, filtering_summary, decision_breakdown, examples, thresholds.

    Needs decide(); examples are the first ``n`` blocks kept and the first ``n`` filtered for a low score, in order.
    """
    from pyspark.sql import functions as F

    by = Window.partitionBy("doc_id", "__example").orderBy("page", "block_id")
    kind = F.when(F.col("filter_decision") == "filtered_low_score", "filtered").when(F.contains("filter_decision", F.lit("keep")), "preserved")
    first = r.df.withColumn("__example", kind).where("__example is not null").withColumn("__i", F.row_number().over(by)).where(F.col("__i") <= n)
    why = F.col(reasons) if r.has(reasons) else F.lit(None).cast("string")
    own = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("__example") == k, F.struct("__i", "text", "filter_score", why.alias("filter_reasons"))))), lambda x: x.dropFields("__i")).alias(k)
    examples = first.groupBy("doc_id").agg(F.struct(own("filtered"), own("preserved")).alias("examples"))
    stats, sums = document_stats(r).df, summary(r).df
    stats = stats.select("doc_id", F.struct(*(c for c in stats.columns if c != "doc_id")).alias("document_stats"))
    sums = sums.select("doc_id", F.struct(*(c for c in sums.columns if c != "doc_id")).alias("filtering_summary"))
    counts = report(r).df.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("filter_decision", "blocks")))).alias("decision_breakdown"))
    out = sums.join(stats, "doc_id").join(counts, "doc_id").join(examples, "doc_id", "left")
    limits = F.struct(*(F.lit(v).alias(f"{k}_confidence") for k, v in (("high", HIGH), ("medium", MEDIUM), ("low", LOW))))
    empty = F.from_json(F.lit('{"filtered": [], "preserved": []}'), out.schema["examples"].dataType)
    return SparkRelation(out.select("doc_id", "document_stats", "filtering_summary", "decision_breakdown", F.coalesce("examples", empty).alias("examples"), limits.alias("thresholds")))
