"""Typography, language, position, meaning and structure of blocks, and how likely each is a heading."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import patterns as P
from ..functions.patterns import portable
from ..plans import Relation, SparkRelation

DOC = "PARTITION BY doc_id"
ORDERED = "PARTITION BY doc_id ORDER BY page, block_id"
#: All rows of a window that has an order: Spark runs windows of one order together, and each window copies all rows.
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
SCORES = {"typography_score": 0.25, "linguistic_score": 0.20, "position_score": 0.15, "semantic_score": 0.20, "structure_score": 0.20}


def fonts(r: Relation) -> Relation:
    """Font size against its document: mean, spread, rank with ties averaged, category, jump over the block before."""
    if not r.has("font_size"):
        return r.add(font_size_percentile_rank="CAST(50 AS DOUBLE)", font_category="'medium'", font_size_relative="CAST(1 AS DOUBLE)", font_size_jump="FALSE")
    d = r.d
    doc = f"{ORDERED} {WHOLE}" if isinstance(r, SparkRelation) else DOC
    r = r.add(
        font_size_mean=f"avg(font_size) OVER ({doc})",
        font_size_std=f"stddev_samp(font_size) OVER ({doc})",
        __rank=f"rank() OVER ({DOC} ORDER BY CASE WHEN font_size IS NULL THEN 1 ELSE 0 END, font_size)",
        __known=f"count(font_size) OVER ({doc})",
        __q75=d.quantile("font_size", 0.75, doc),
        __q90=d.quantile("font_size", 0.9, doc),
        __q95=d.quantile("font_size", 0.95, doc),
        __before=f"lag(font_size) OVER ({ORDERED})",
    )
    r = r.add(__ties="count(*) OVER (PARTITION BY doc_id, font_size)")
    return r.add(
        font_size_percentile_rank="CASE WHEN font_size IS NOT NULL THEN (CAST(__rank AS DOUBLE) + (__ties - 1) / CAST(2 AS DOUBLE)) / __known * 100 END",
        font_category=d.cases(("font_size >= __q95", "'very_large'"), ("font_size >= __q90", "'large'"), ("font_size >= __q75", "'medium'"), otherwise="'small'"),
        font_size_relative="font_size / nullif(font_size_mean, 0)",
        font_size_jump=f"coalesce(font_size > __before * {d.num(1.2)}, FALSE)",
    ).drop("__rank", "__known", "__q75", "__q90", "__q95", "__before", "__ties")


def typography(r: Relation) -> Relation:
    """3, 2 and 1 points for strong, moderate and weak patterns, each group once."""
    d = r.d
    groups = {k: d.any_match("coalesce(text, '')", map(portable, v)) for k, v in P.TYPOGRAPHY.items()}
    return r.add(
        typography_score=d.points((groups["strong"], 3), (groups["moderate"], 2), (groups["weak"], 1)),
        typography_patterns=d.listed(*((c, f"{k}_typography") for k, c in groups.items())),
    )


def linguistics(r: Relation) -> Relation:
    """Length, case and ending of a text, and patterns that speak against a heading. No tagger: its score is 0."""
    d = r.d
    r = r.add(__x="coalesce(text, '')")
    r = r.add(__n=d.words("__x"))
    caps, title = f"{d.upper('__x')} AND __n > 8", d.title("__x")
    anti = {k: d.any_match("__x", map(portable, v), "i") for k, v in P.ANTI_HEADINGS.items()}
    ends = d.rx("__x", r"[.!?]\z")
    r = r.add(
        __case=d.cases((caps, "'excessive_caps'"), (title, "'title_case'"), (d.upper_first("__x"), "'capital_start'"), (d.lower_first("__x"), "'lowercase_start'")),
        __end=d.cases((ends, "'sentence_ending'"), ("__x LIKE '%:'", "'colon_ending'"), ("__x LIKE '%,'", "'comma_ending'")),
        __size=d.cases(("__n BETWEEN 1 AND 8", "'good_length'"), ("__n > 20", "'too_long'")),
        __anti=d.listed(*((c, f"anti_{k}") for k, c in anti.items())),
        __weight=d.points(*((c, 1 if k in ("sentence_fragments", "incomplete_phrases") else 2) for k, c in anti.items())),
    )
    score = d.points(("__size = 'good_length'", 2.0), ("__case = 'title_case'", 1.0), ("__case = 'capital_start'", 0.5), ("__end = 'colon_ending'", 1.0))
    wrong = d.points(("__size = 'too_long'", 1), ("__case IN ('excessive_caps', 'lowercase_start')", 1), ("__end IN ('sentence_ending', 'comma_ending')", 1))
    return r.add(
        linguistic_score=f"CASE WHEN __n = 0 THEN {d.num(0.0)} ELSE {score} END",
        syntax_violations=f"CASE WHEN __n = 0 THEN 0 ELSE {wrong} + __weight END",
        linguistic_patterns="CASE WHEN __n = 0 THEN '' ELSE concat_ws(';', __size, __case, __end, nullif(__anti, '')) END",
        pos_heading_score=d.num(0.0),
    ).drop("__x", "__n", "__case", "__end", "__size", "__anti", "__weight")


def tagged(r: Relation) -> Relation:
    """Add pos_heading_score, pos_patterns and pos_violations by counts of tags: favourable, neutral, unfavourable, has_subject, has_verb.

    The counts are a tagger's, as ``functions.udf.heading_tags`` makes them; without them the score is 0.
    """
    d = r.d
    if not (r.has("tags_favourable") and r.has("tags_unfavourable")):
        return r.add(pos_heading_score=d.num(0.0), pos_patterns="''", pos_violations="0")
    r = r.add(__all="tags_favourable + tags_neutral + tags_unfavourable")
    r = r.add(__good=f"coalesce({d.ratio('tags_favourable', '__all')}, 0)", __bad=f"coalesce({d.ratio('tags_unfavourable', '__all')}, 0)")
    good, bad, sentence = f"__good > {d.num(0.6)}", f"NOT __good > {d.num(0.6)} AND __bad > {d.num(0.4)}", "has_subject AND has_verb AND tags > 1"
    return r.add(
        pos_heading_score="2 * __good - 2 * __bad",
        pos_patterns=d.listed((good, "favorable_pos"), (bad, "unfavorable_pos"), (sentence, "sentence_structure")),
        pos_violations=d.points((bad, 1), (sentence, 2)),
    ).drop("__all", "__good", "__bad")


def whitespace_above(r: Relation, least: float = 20.0) -> Relation:
    """Add whitespace_above: over ``least`` between a block and the end of the one before it on the page."""
    return r.add(whitespace_above=f"coalesce(y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, block_id) > {r.d.num(least)}, FALSE)")


def positions(r: Relation) -> Relation:
    """Place on the page, and short texts next to long ones."""
    d = r.d
    down = "y0 DESC, block_id" if r.has("y0") else "line_position_on_page, block_id" if r.has("line_position_on_page") else "block_id"
    if not r.has("line_position_on_page"):
        r = r.add(line_position_on_page="CAST(NULL AS DOUBLE)")
    page = "PARTITION BY doc_id, page"
    all_of_it = f"{page} ORDER BY {down} {WHOLE}" if isinstance(r, SparkRelation) else page
    r = r.add(__n="__words" if r.has("__words") else d.words("coalesce(text, '')"), __most=f"max(line_position_on_page) OVER ({all_of_it})")
    r = r.add(__up=f"coalesce(lag(__n) OVER ({page} ORDER BY {down}), 0)", __next=f"coalesce(lead(__n) OVER ({page} ORDER BY {down}), 0)")
    r = r.add(
        __place=d.cases(
            ("__most IS NULL OR __most <= 0 OR line_position_on_page IS NULL", "NULL"),
            ("line_position_on_page <= 3", "'page_top'"),
            ("line_position_on_page >= __most - 2", "'page_bottom'"),
            (f"line_position_on_page / __most < {d.num(0.3)}", "'upper_third'"),
        ),
        __alone="__n <= 6 AND (__up > 10 OR __next > 10)",
    )
    return r.add(
        position_score=d.points(("__place = 'page_top'", 2), ("__place = 'page_bottom'", -1), ("__place = 'upper_third'", 1), ("__alone", 1)),
        position_patterns="concat_ws(';', __place, CASE WHEN __alone THEN 'isolated_short_text' END)",
    ).drop("__n", "__most", "__up", "__next", "__place", "__alone")


def semantics(r: Relation) -> Relation:
    """Heading keywords against sentence starters, technical terms and length; the type of content."""
    d = r.d
    words = sorted({w for v in P.KEYWORDS.values() for w in v})
    r = r.add(__x=d.strip("lower(coalesce(text, ''))"))
    r = r.add(__n=d.words("__x"), __first=d.extract("__x", portable(r"^(\S+)")), __second=d.extract("__x", portable(r"^\S+\s+(\S+)")))
    keyword = d.cases(*((d.has_any("__x", v), f"'heading_{k}'") for k, v in P.KEYWORDS.items()))
    whole = d.rx("__x", portable(rf"(^|\s)({'|'.join(words)})($|\s)"))
    r = r.add(
        __keyword=keyword, __starter=d.isin("__first", P.SENTENCE_STARTERS), __conj=d.isin("__first", P.CONJUNCTIONS),
        __prep=f"{d.isin('__first', P.PREPOSITIONS)} OR {d.isin('__second', P.PREPOSITIONS)}", __tech=d.any_rx("__x", map(portable, P.TECHNICAL), "i"),
        __whole=whole,
    )
    score = d.points(("__keyword IS NOT NULL", 2), ("__starter", -2), ("__conj", -3), ("__prep", -1), ("__tech", -2), ("__whole AND __n BETWEEN 2 AND 8", 2), ("__whole AND __n BETWEEN 9 AND 15", 1))
    return r.add(
        semantic_score=f"CASE WHEN __n = 0 THEN 0 ELSE {score} END",
        content_type=d.cases(
            ("__n = 0", "'unknown'"), ("__n = 1", "'fragment'"), ("__n <= 8 AND __whole", "'heading_candidate'"), ("__n <= 8", "'text'"), ("__n <= 15 AND __whole", "'heading_candidate'"),
            ("__tech", "'technical'"), ("__keyword IS NOT NULL", "'heading_candidate'"), otherwise="'text'",
        ),
        semantic_patterns="CASE WHEN __n = 0 THEN '' ELSE concat_ws(';', __keyword, CASE WHEN __starter THEN 'sentence_starter' END, CASE WHEN __conj THEN 'conjunction_start' END, CASE WHEN __prep THEN 'early_preposition' END, "
        "CASE WHEN __tech THEN 'technical_term' END, CASE WHEN __n = 1 THEN 'single_word' WHEN __n <= 8 AND __whole THEN 'title_phrase' WHEN __n BETWEEN 9 AND 15 AND __whole THEN 'longer_heading' END) END",
    ).drop("__x", "__n", "__first", "__second", "__keyword", "__starter", "__conj", "__prep", "__tech", "__whole")


def hierarchy_level(r: Relation) -> Relation:
    """Level by the kind of numbering, 0 where there is none."""
    d = r.d
    return r.add(hierarchy_level=d.cases(*((d.any_match("coalesce(text, '')", map(portable, v), "i"), str(k)) for k, v in P.LEVEL_NUMBERING.items()), otherwise="0"))


def structure(r: Relation) -> Relation:
    """Level by the kind of numbering, and where sections begin. Needs fonts() and positions()."""
    d = r.d
    if not r.has("hierarchy_level"):
        r = hierarchy_level(r)
    r = r.add(section_boundary=f"(font_size_jump OR {d.has('position_patterns', 'page_top')} OR hierarchy_level > 0)")
    return r.add(
        structure_score="CASE hierarchy_level WHEN 0 THEN 0 ELSE 4 - hierarchy_level END + CASE WHEN section_boundary THEN 1 ELSE 0 END",
        structure_patterns="concat_ws(';', CASE WHEN hierarchy_level > 0 THEN concat('level_', CAST(hierarchy_level AS STRING), '_numbering') END, CASE WHEN section_boundary THEN 'section_boundary' END)",
    )


def likelihood(r: Relation) -> Relation:
    """The five scores, each scaled over its document, weighted, less a tenth for each violation, within 0 and 1."""
    d = r.d
    r = r.add(**{f"__{side}_{c}": f"CAST({side}({c}) OVER ({DOC}) AS DOUBLE)" for c in SCORES for side in ("min", "max")})
    r = r.add(**{f"{c}_norm": f"CASE WHEN __max_{c} > __min_{c} THEN ({c} - __min_{c}) / (__max_{c} - __min_{c}) ELSE {d.num(0.5)} END" for c in SCORES})
    total = " + ".join(f"{c}_norm * {d.num(w)}" for c, w in SCORES.items())
    r = r.add(heading_likelihood=f"greatest({d.num(0.0)}, least({d.num(1.0)}, {total} - syntax_violations * {d.num(0.1)}))")
    return r.drop(*(f"__{side}_{c}" for c in SCORES for side in ("min", "max")))


def _loud(d) -> str:
    return d.has_any("upper(coalesce(text, ''))", ["CHAPTER", "SECTION"])


def levels(r: Relation) -> Relation:
    """H1 to H3 for likely headings; where no H1 came before, a document's first H2 is one."""
    d = r.d
    loud = "__loud" if r.has("__loud") else _loud(d)
    one = f"(hierarchy_level = 1 OR coalesce(font_size_percentile_rank, {d.num(50.0)}) >= 95 OR {loud})"
    two = "(hierarchy_level = 2 OR font_category IN ('large', 'medium') AND typography_score >= 1 AND semantic_score >= 0)"
    r = r.add(__level=d.cases((f"heading_likelihood < {d.num(0.3)}", "NULL"), (one, "'H1'"), (two, "'H2'"), otherwise="'H3'"))
    by = "line_position_on_page, block_id" if r.has("line_position_on_page") else "block_id"
    r = r.add(__nth=f"sum(CASE WHEN __level IN ('H1', 'H2') THEN 1 ELSE 0 END) OVER ({DOC} ORDER BY page, {by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    r = r.add(__up="__level = 'H2' AND __nth = 1")
    return r.add(
        recommended_level="CASE WHEN __up THEN 'H1' ELSE coalesce(__level, 'H3') END",
        level_confidence=d.cases(("__level IS NULL", d.num(0.5)), ("__level = 'H1'", d.num(0.9)), ("__level = 'H2'", d.num(0.8)), otherwise=d.num(0.7)),
    ).drop("__level", "__nth", "__up")


def comprehensive(r: Relation, by_text: bool = True, more: tuple[Callable[[Relation], Relation], ...] = ()) -> Relation:
    """All of the above, in order; ``by_text``: Spark looks at each distinct text once, at the cost of reading the blocks twice.

    ``more``: steps of the text alone that are taken with it then, and whose columns stay.
    """
    if by_text and isinstance(r, SparkRelation):
        r = r.by_text(typography, linguistics, semantics, hierarchy_level, lambda r: r.add(__words=r.d.words("coalesce(text, '')"), __loud=_loud(r.d)), *more)
        steps = (fonts, positions, structure, likelihood, levels)
    else:
        steps = (fonts, typography, linguistics, positions, semantics, structure, likelihood, levels)
    for step in steps:
        r = step(r)
    return r.drop("__words", "__loud") if r.has("__words") else r
