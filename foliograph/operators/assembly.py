"""From spans to lines, and the features of a line as it is extracted."""

from __future__ import annotations

from ..functions import patterns as P
from ..plans import Relation

LINE = ("doc_id", "page", "line_no")
BOLD, ITALIC, UNDERLINE = 2, 1, 4


def merge_spans(r: Relation, masks: dict[str, int] | None = None) -> Relation:
    """One row a line: its spans' texts joined by spaces, their boxes united, style, font and colour of the first.

    ``masks``: the flag bits of bold, italic and underline.
    """
    d, masks = r.d, masks or {"bold": BOLD, "italic": ITALIC, "underline": UNDERLINE}
    r = r.add(__t=d.strip("coalesce(text, '')")).where("__t <> ''")
    first = {c: f"min_by({c}, span_no)" for c in ("size", "font", "flags", "color") if r.has(c)}
    r = r.group(*LINE, text=d.joined("__t", "span_no"), x0="min(x0)", y0="min(y0)", x1="max(x1)", y1="max(y1)", page_height="max(page_height)", **first)
    return r.add(font_size="size", **{k: f"(flags & {m}) <> 0" for k, m in masks.items()}).drop("size", "flags")


def page_sizes(r: Relation) -> Relation:
    """The median font size of each page's spans; 1 if there is none."""
    return r.group("doc_id", "page", page_median=f"coalesce({r.d.quantile('size', 0.5)}, {r.d.num(1.0)})")


def relative_size(lines: Relation, spans: Relation) -> Relation:
    """Add relative_font_size: a line's size over its page's median span."""
    return lines.join(page_sizes(spans), ["doc_id", "page"], "left").add(relative_font_size="font_size / nullif(page_median, 0)").drop("page_median")


def size_rank(r: Relation, by: str = "doc_id, page", top: int = 4) -> Relation:
    """Add size_level: the rank of the font size among the distinct sizes of the page (or document), 0 beyond ``top``."""
    return r.add(__r=f"dense_rank() OVER (PARTITION BY {by} ORDER BY font_size DESC)").add(size_level=f"CAST(CASE WHEN __r <= {top} THEN __r ELSE 0 END AS INT)").drop("__r")


def text_flags(r: Relation) -> Relation:
    """The 0/1 and counting features of a line's text."""
    d = r.d
    r = r.add(__x="coalesce(text, '')")
    r = r.add(__t=d.strip("__x"))
    flag = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    return r.add(
        bullet=d.isin(d.first_char("__t"), list(P.BULLETS)),
        math=d.rx("__x", r"[=+\-×÷∑∫√π∞]"),
        hyperlink=f"(__t LIKE 'http%' OR {d.has('__x', 'www.')} OR {d.has('__x', '.com')})",
        is_all_caps=flag(d.upper("__x")),
        is_title_case=flag(d.title("__x")),
        ends_with_colon=flag("__t LIKE '%:'"),
        contains_colon=flag(d.has("__x", ":")),
        contains_semicolon=flag(d.has("__x", ";")),
        starts_with_number=flag(d.rx("__t", r"^\p{Nd}")),
        punctuation_count=f"CAST({d.count('__x', '[.,;:!?—()' + chr(92) + '[' + chr(92) + ']{}' + chr(34) + chr(39) + chr(92) + '-]')} AS INT)",
        word_count=d.words("__x"),
        text_length="CAST(length(__x) AS INT)",
        contains_digits=d.rx("__x", r"\p{Nd}"),
        language_is_english=f"NOT {d.rx('__x', r'[^\x{0}-\x{7F}]')}",
    ).drop("__x", "__t")


def heading_level(r: Relation) -> Relation:
    """Add heading_level: the size level of short lines that are no bullet, formula or link. Needs text_flags(), size_rank()."""
    return r.add(heading_level="CASE WHEN word_count <= 12 AND NOT bullet AND NOT math AND NOT hyperlink THEN size_level ELSE 0 END")


def spans_long(r: Relation, least: int = 3) -> Relation:
    """Spans of more than ``least`` characters, each a row of its own: text, page_num, and style by the font's name."""
    keys = [c for c in ("doc_id", "line_no", "span_no") if r.has(c)]
    return r.where(f"length(text) > {least}").pick(*keys, "text", page_num="page", bold="contains(font, 'Bold')", italic="contains(font, 'Italic')")


def line_position(r: Relation, height: str = "page_height") -> Relation:
    """Add line_position_on_page: the top of the line over the page's height, 0 if that is 0 or unknown."""
    return r.add(line_position_on_page=f"coalesce(y0 / nullif(CAST({height} AS DOUBLE), 0), 0)")


def spacing(r: Relation) -> Relation:
    """Add line_spacing_above: the gap to the line before on the page, null on the first."""
    return r.add(line_spacing_above="y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY block_id)")


def auto_label(r: Relation) -> Relation:
    """Add auto_label: 1 for large short lines in bold or capitals, or larger and shorter ones. Needs text_flags()."""
    d = r.d
    clean = "NOT bullet AND NOT math AND NOT hyperlink"
    punctuation = d.rx("coalesce(text, '')", r"[!-/:-@\[-`{-~]")
    one = f"font_size >= 14 AND text_length <= 80 AND (coalesce(bold, FALSE) OR is_title_case = 1 OR is_all_caps = 1) AND {clean} AND NOT contains_digits AND NOT {punctuation}"
    two = f"font_size >= 16 AND text_length <= 60 AND word_count <= 8 AND {clean}"
    return r.add(auto_label=f"CASE WHEN {one} OR {two} THEN 1 ELSE 0 END")


def garbage_ratio(r: Relation) -> Relation:
    """One row a page: the share of its longer lines that are garbage, and whether over 0.4. Needs valid_text()."""
    d = r.d
    r = r.group("doc_id", "page", blocks="count(*)", garbage="sum(CASE WHEN NOT valid_text AND length(text) > 5 THEN 1 ELSE 0 END)")
    return r.pick("doc_id", "page", "blocks", garbage_ratio=d.ratio("garbage", "blocks"), switch_extraction=f"{d.ratio('garbage', 'blocks')} > {d.num(0.4)}")


def ocr_lines(r: Relation, scale: float = 2.0, least: int = 30) -> Relation:
    """Recognised words (text, confidence, x, y, width, height in scaled pixels) as blocks: sure and valid ones, with size and level by height."""
    from .quality import strip_control, valid_text

    d = r.d
    r = strip_control(r.where(f"confidence > {least}").add(text=d.strip("coalesce(text, '')")))
    r = valid_text(r.add(text=d.strip("text"))).where("text <> '' AND valid_text", derived=True).drop("valid_text").add(__t="text")
    r = r.add(**{c: f"CAST({c} AS DOUBLE) / {d.num(scale)}" for c in ("x", "y", "width", "height")})
    r = r.add(font_size=f"greatest({d.num(8.0)}, height * {d.num(0.75)})")
    level = d.cases(*((f"font_size > {size}", str(n)) for n, size in enumerate((20, 16, 14, 12), 1)), otherwise="0")
    return r.add(text="__t", x0="x", y0="y", x1="x + width", y1="y + height", heading_level=level, extraction_method="'ocr'", ocr_confidence="confidence").drop("__t", "x", "y", "width", "height", "confidence")


def pages_without_text(pages: Relation, lines: Relation) -> Relation:
    """The pages that no line of text comes from, for recognition."""
    return pages.join(lines.where("text <> ''").pick("doc_id", "page"), ["doc_id", "page"], "left_anti")


def legacy_stats(r: Relation) -> Relation:
    """Length, words, digits, punctuation and language of a text, as the older extraction has them."""
    d = r.d
    x = "coalesce(text, '')"
    return r.add(
        text_length=f"CAST(length({x}) AS INT)", num_words=d.words(x), contains_digits=d.rx(x, r"\p{Nd}"), contains_punctuation=d.rx(x, r"[!-/:-@\[-`{-~]"),
        language=f"CASE WHEN {d.rx(x, r'[^\x{0}-\x{7F}]')} THEN 'non-english' ELSE 'english' END",
    )
