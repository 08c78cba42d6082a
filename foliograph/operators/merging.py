"""Titles, fragments that belong together, distances and splits: what depends on the order of a document's blocks."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.patterns import portable
from ..plans import Relation, SparkRelation
from .metadata import ORDERED, WHOLE
from .rules import named

_NAMES = {n: (portable(p), f) for n, p, f in P.EXCLUSIONS}


def _order(r: Relation) -> str:
    return "page, line_position_on_page, block_id" if r.has("line_position_on_page") else "page, block_id"


def document_title(r: Relation, first: int = 100, near: int = 15, within: int = 120) -> Relation:
    """Add title_role: 'document_title' for the first fit heading of the first blocks, 'document_subtitle' for the next."""
    d = r.d
    r = r.add(__pos=f"row_number() OVER (PARTITION BY doc_id ORDER BY {_order(r)}) - 1", __t=d.strip("coalesce(text, '')"))
    r = r.add(__n=d.words("__t"))
    title, sub = _titles(d, first, near, within)
    r = r.add(__title=f"min({title}) OVER (PARTITION BY doc_id)")
    r = r.add(__sub=f"min({sub}) OVER (PARTITION BY doc_id)")
    return r.add(title_role=_ROLE).drop("__pos", "__t", "__n", "__title", "__sub")


_ROLE = "CASE WHEN __pos = __title THEN 'document_title' WHEN __pos = __sub THEN 'document_subtitle' END"


def _titles(d, first: int, near: int, within: int) -> tuple[str, str]:
    """The place of a block that may be its document's title, and of one that may be the subtitle; needs __pos, __t, __n, and __title for the second."""
    technical = " OR ".join(d.rx("__t", *_NAMES[k]) for k in ("technical_terms", "technical_fragments", "programming_terms", "file_paths"))
    unfit = f"__n = 1 AND length(__t) < 4 OR lower(__t) IN ('the', 'a', 'an') OR {technical} OR __t LIKE '%.' AND __n > 10"
    clean = named(d, "__t", P.EXCLUSIONS) + " IS NULL"
    return (
        f"CASE WHEN is_heading_pred = 1 AND __pos < {first} AND NOT ({unfit}) THEN __pos END",
        f"CASE WHEN is_heading_pred = 1 AND __pos > __title AND __pos <= __title + {near} AND __pos < {within} AND __n BETWEEN 2 AND 15 AND ({clean}) THEN __pos END",
    )


def merge_prefixes(r: Relation) -> Relation:
    """Join a heading that is a bare number or letter to the next on its page: merged_text, merge_decision, is_heading_pred."""
    d = r.d
    r = r.add(__t=d.strip("coalesce(text, '')"))
    over = f"OVER (PARTITION BY doc_id ORDER BY {_order(r)})"
    r = r.add(__kind=named(d, "__t", P.PREFIXES), __next=f"lead(__t) {over}", __nexth=f"lead(is_heading_pred) {over}", __nextp=f"lead(page) {over}", __prev=f"lag(__t) {over}")
    r = r.add(__gives=f"coalesce(__kind IS NOT NULL AND is_heading_pred = 1 AND __nexth = 1 AND __nextp = page AND {_begins(d, '__next')}, FALSE)")
    r = r.add(__takes=f"coalesce(lag(__gives) {over}, FALSE)")
    return r.add(
        merged_text="CASE WHEN __takes THEN concat(__prev, ' ', __t) ELSE text END",
        merge_decision="CASE WHEN __gives THEN 'merged_into_next' WHEN __takes THEN 'merged_consecutive' END",
        is_heading_pred="CASE WHEN __gives THEN 0 ELSE is_heading_pred END",
    ).drop("__t", "__kind", "__next", "__nexth", "__nextp", "__prev", "__gives", "__takes")


def _begins(d, text: str) -> str:
    """Whether a text can go on after a bare number or letter."""
    word = d.rx(f"lower({text})", portable(rf"(^|\s)({'|'.join(P.HEADING_WORDS)})($|\s)"))
    return f"({d.upper_first(text)} OR {word})"


def of_text(r: Relation) -> Relation:
    """What titles_and_prefixes() asks of the text alone: __bare, __begins."""
    d = r.d
    return r.add(__t=d.strip("coalesce(text, '')")).add(__bare=f"{named(d, '__t', P.PREFIXES)} IS NOT NULL", __begins=_begins(d, "__t")).drop("__t")


def titles_and_prefixes(r: SparkRelation, first: int = 100, near: int = 15, within: int = 120) -> SparkRelation:
    """document_title() and merge_prefixes() in three windows of one order, not five of two; texts are stripped only where they are asked or joined.

    Takes the columns of of_text(), which it adds if they aren't there.
    """
    d = r.d
    r = r if r.has("__bare") else of_text(r)
    over = f"PARTITION BY doc_id ORDER BY {_order(r)}"
    r = r.add(
        __pos=f"row_number() OVER ({over}) - 1", __next=f"lead(__begins) OVER ({over})", __nexth=f"lead(is_heading_pred) OVER ({over})", __nextp=f"lead(page) OVER ({over})",
        __prev=f"lag(text) OVER ({over})",
    )
    r = r.add(
        __gives="coalesce(__bare AND is_heading_pred = 1 AND __nexth = 1 AND __nextp = page AND __next, FALSE)",
        __t=f"CASE WHEN is_heading_pred = 1 AND __pos < {max(first, within)} THEN {d.strip("coalesce(text, '')")} END",
    ).add(__n=d.words("__t"))
    title, sub = _titles(d, first, near, within)
    r = r.add(__title=f"min({title}) OVER ({over} {WHOLE})", __takes=f"coalesce(lag(__gives) OVER ({over}), FALSE)")
    r = r.add(__sub=f"min({sub}) OVER ({over} {WHOLE})")
    return r.add(
        title_role=_ROLE,
        merged_text=f"CASE WHEN __takes THEN concat({d.strip("coalesce(__prev, '')")}, ' ', {d.strip("coalesce(text, '')")}) ELSE text END",
        merge_decision="CASE WHEN __gives THEN 'merged_into_next' WHEN __takes THEN 'merged_consecutive' END",
        is_heading_pred="CASE WHEN __gives THEN 0 ELSE is_heading_pred END",
    ).drop("__bare", "__begins", "__pos", "__next", "__nexth", "__nextp", "__prev", "__gives", "__takes", "__t", "__n", "__title", "__sub")


def distance(r: Relation, before: str = "NULL") -> Relation:
    """Add distance_to_previous_heading: rows since the last heading; ``before`` where there was none."""
    d = r.d
    r = r.add(__i=f"CAST(row_number() OVER ({ORDERED}) AS INT)")
    r = r.add(__h="CASE WHEN is_heading = 1 THEN __i END")
    r = r.add(__last=d.last_known("__h", f"{ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"))
    return r.add(distance_to_previous_heading=f"coalesce(__i - __last, {before})" if before != "NULL" else "__i - __last").drop("__i", "__h", "__last")


def split_rows(r: Relation, headings_only: bool = False) -> Relation:
    """Split each text after its first mark that is not by a digit; what follows is a row of its own and no heading."""
    d = r.d
    head = d.extract("coalesce(text, '')", r"^((?s:.)*?(?:^|[^\p{Nd}])[.,:;])(?:[^\p{Nd}]|$)")
    r = r.add(__head=f"CASE WHEN {'is_heading = 1' if headings_only else 'TRUE'} THEN {head} ELSE '' END")
    r = r.add(__rest=f"CASE WHEN __head = '' THEN '' ELSE {d.strip('substr(text, CAST(length(__head) + 1 AS INT))')} END")
    left = r.add(text=f"CASE WHEN __head = '' THEN text ELSE {d.strip('__head')} END", part="0")
    right = r.where("__rest <> ''").add(text="__rest", is_heading="0", heading_level="0", part="1")
    return left.drop("__head", "__rest").union(right.drop("__head", "__rest"))


def combine_runs(r: Relation) -> Relation:
    """One row for each run of headings of one level, their texts joined; other rows stay."""
    d = r.d
    r = r.add(__h="is_heading = 1 AND heading_level > 0")
    r = r.add(__new=f"CASE WHEN __h AND lag(__h) OVER ({ORDERED}) AND lag(heading_level) OVER ({ORDERED}) = heading_level THEN 0 ELSE 1 END")
    r = r.add(__run=f"sum(__new) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return r.group("doc_id", "__run", block_id="min(block_id)", page="min(page)", is_heading="min(is_heading)", heading_level="min(heading_level)", text=d.joined("text", "block_id"), blocks="count(*)").drop("__run")


def combine_tokens(r: Relation, label: str = "label") -> Relation:
    """One row for each run of tokens of one label on one line: texts joined, box widened."""
    d = r.d
    same = " AND ".join(f"lag({c}) OVER ({ORDERED}) = {c}" for c in (label, "page", "y0"))
    r = r.add(__new=f"CASE WHEN {same} THEN 0 ELSE 1 END")
    r = r.add(__run=f"sum(__new) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return r.group("doc_id", "__run", block_id="min(block_id)", text=d.joined("text", "block_id"), x0="min_by(x0, block_id)", y0="min(y0)", x1="max(x1)", y1="max(y1)", page="min(page)", **{label: f"min({label})"}).drop("__run")


def corpus_level(r: Relation, label: str = "label") -> Relation:
    """Add heading_level to labelled tokens: titles 1; numbered short texts, then short sections, 2; others 0."""
    d = r.d
    r = r.add(__t=d.strip("coalesce(text, '')"))
    numbered = d.rx("__t", portable(r"^\d+(\.\d+)*(\s|\.|:)"))
    return r.add(heading_level=d.cases((f"lower({label}) = 'title'", "1"), (f"length(__t) < 100 AND ({numbered} OR lower({label}) = 'section')", "2"), otherwise="0")).drop("__t")
