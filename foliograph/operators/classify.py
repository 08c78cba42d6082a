"""Which blocks are headings by rule and by typography, and of which level."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.patterns import portable
from ..plans import Relation, SparkRelation
from .quality import CONTROL, valid_text
from .rules import exclusion, named, positive


def rule_headings(r: Relation, personal: list[tuple[str, str]] = ()) -> Relation:
    """Add heading (BOOLEAN), heading_reason, typography_points and level (H1 to H3, null if no heading)."""
    d = r.d
    has = lambda c, other: f"coalesce({c}, {other})" if r.has(c) else other
    first = dict(
        __clean=d.strip(d.replace("__x", CONTROL)), __size=has("font_size", d.num(12.0)), __rel=has("relative_font_size", d.num(1.0)), __bold=has("bold", "FALSE"), __italic=has("italic", "FALSE"),
        __pos=has("line_position_on_page", d.num(999.0)), __gap=has("line_spacing_above", d.num(0.0)), __bad=d.has_any("lower(__x)", P.BAD_HEADING_PARTS), __titled=d.count("__x", r"\b[A-Z][a-z]+"),
        __bullet=has("bullet", "FALSE"), __math=has("math", "FALSE"),
    )
    then = dict(__n=d.words("__clean"), __letters=d.rx("__clean", "[a-zA-Z]"), __caps=f"({d.upper('__x')} AND {d.rx('__clean', '[a-zA-Z]')})")
    known = d.few_words("__x", 8, d.rx("upper(__x)", P.KNOWN_HEADINGS))
    rules = lambda t: exclusion(positive(valid_text(t)), personal).add(__x="coalesce(text, '')")
    if isinstance(r, SparkRelation):
        of_text = {c: first.pop(c) for c in ("__clean", "__bad", "__titled")}
        r = r.by_text(lambda t: rules(t).add(**of_text).add(**then).add(__known=known)).add(**first)
    else:
        r = rules(r).add(**first).add(**then)
    part = lambda *pairs: d.cases(*((c, str(p)) for c, p in pairs), otherwise="0")
    n = d.num
    points = [
        part((f"__size > 18 OR __rel > {n(1.5)}", 3), (f"__size > 15 OR __rel > {n(1.3)}", 2), (f"__size > 13 OR __rel > {n(1.1)}", 1)),
        part(("__bold", 2), ("__italic", 1)),
        part(("__caps AND __n <= 8", 2), ("__caps AND __n <= 15", 1)),
        part(("__titled >= 2 AND __n <= 10", 2)),
        part(("__x LIKE '%:' AND __n <= 8", 2)),
        part(("__n <= 8 AND NOT __bad", 1)),
        part((f"{d.rx('__clean', '^[A-Z]')} AND NOT __bad", 1)),
        part((f"__pos <= {n(0.1)}", 1)),
        part(("__gap > 20", 1)),
        part(("__bad", -2)),
        part(("__n > 20", -2), ("__n > 15", -1)),
        part(("__x LIKE '%.' AND __n > 10", -1)),
        part((f"__bullet OR {d.isin(d.first_char(d.strip('__x')), ['•', '-', '*', '○', '▪'])}", -2)),
        part((f"__math OR {d.has_any('__x', ['=', '()', '{}', '[]', '//'])}", -1)),
    ]
    r = r.add(typography_points=" + ".join(points), **({} if r.has("__known") else {"__known": known}))
    r = r.add(heading_reason=d.cases(
        ("length(__x) < 3 OR NOT valid_text", "'skipped'"),
        ("excluded", "concat('excluded_', exclusion_reason)"),
        ("numbered", "concat('numbered_', number_type, '_level_', CAST(number_level AS STRING))"),
        ("positive IS NOT NULL", "concat('positive_', positive)"),
        ("__known", "'known_heading_pattern'"),
        ("typography_points >= 3 AND __letters AND length(__clean) >= 3", "concat('typography_score_', CAST(typography_points AS STRING))"),
        ("(__size > 15 OR __bold) AND __n <= 15 AND NOT __bad AND __letters", "'typography_fallback'"),
        otherwise="'not_heading'",
    ))
    r = r.add(heading="(heading_reason NOT IN ('skipped', 'not_heading') AND heading_reason NOT LIKE 'excluded%')")
    w = d.words("__x")
    one = f"__size >= 22 OR __rel >= {n(1.8)} OR __size >= 18 AND __bold OR __size >= 16 AND __bold AND __caps OR __caps AND {w} <= 3 AND __size >= 14"
    two = f"__size >= 16 OR __rel >= {n(1.4)} OR __size >= 14 AND __bold OR __caps AND {w} <= 6 AND __size >= 12"
    r = r.add(level=d.cases(("NOT heading", "NULL"), ("numbered", "CASE number_level WHEN 1 THEN 'H1' WHEN 2 THEN 'H2' ELSE 'H3' END"), (one, "'H1'"), (two, "'H2'"), otherwise="'H3'"))
    return r.drop("__x", "__clean", "__size", "__rel", "__bold", "__italic", "__pos", "__gap", "__bad", "__titled", "__bullet", "__math", "__n", "__letters", "__caps", "__known")


def document_size_level(r: Relation) -> Relation:
    """Add size_heading: H1 to H3 for the three greatest font sizes of the document among plain headings, else null."""
    r = r.add(__r="dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC)")
    return r.add(size_heading="CASE WHEN plain_heading AND __r <= 3 THEN concat('H', CAST(__r AS STRING)) END").drop("__r")


def heading_size_level(r: Relation) -> Relation:
    """Add heading_rank_level: among a document's predicted headings, the greatest size is H1, the next H2, others H3."""
    r = r.add(__r="dense_rank() OVER (PARTITION BY doc_id, is_heading_pred ORDER BY font_size DESC)")
    return r.add(heading_rank_level="CASE WHEN is_heading_pred = 1 THEN concat('H', CAST(least(__r, 3) AS STRING)) END").drop("__r")


def pattern_level(r: Relation) -> Relation:
    """Add outline_level: by the text's pattern, else by the font size among the document's headings."""
    d = r.d
    r = r.add(__t=d.strip("coalesce(text, '')"), **{f"__p{p}": d.quantile("CASE WHEN is_heading_pred = 1 THEN font_size END", p / 100, "PARTITION BY doc_id") for p in (75, 90, 95)})
    by_text = [(d.any_match("__t", map(portable, v), "i"), f"'{k}'") for k, v in P.LEVEL_BY_TEXT.items()]
    short = f"{d.rx('__t', portable(r'^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$'))} AND {d.words('__t')} <= 4"
    y = "y0" if r.has("y0") else "0"
    return r.add(outline_level=d.cases(
        *by_text,
        (f"font_size >= coalesce(__p90, 16)", "'H1'"),
        (f"font_size >= coalesce(__p75, 14)", f"CASE WHEN page = 1 AND {y} < 300 OR font_size >= coalesce(__p95, 18) THEN 'H1' ELSE 'H2' END"),
        (f"font_size >= 12", f"CASE WHEN {short} THEN 'H2' ELSE 'H3' END"),
        otherwise="'H3'",
    )).drop("__t", "__p75", "__p90", "__p95")


def matched_pattern(r: Relation) -> Relation:
    """Add matched: the name of the first excluding pattern, whatever speaks for the text."""
    return r.add(matched=named(r.d, r.d.strip("coalesce(text, '')"), P.EXCLUSIONS))
