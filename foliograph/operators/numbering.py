"""Hierarchical numbering: which system a text's number follows, its level, and whether it heads a section."""

from __future__ import annotations

from ..functions.patterns import NUMBERINGS, ROMAN, portable
from ..plans import Relation

ROMAN_VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ROMAN_STEPS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def valid_roman(d, text: str) -> str:
    """Whether a text is a canonical roman numeral, in either case."""
    return f"({text} <> '' AND {d.rx(f'upper({text})', ROMAN)})"


def roman_value(text: str) -> str:
    """The value of a roman numeral: every letter, less twice those that stand before a greater one."""
    up, parts = f"upper({text})", []
    count = lambda what: f"(length({up}) - length(replace({up}, '{what}', ''))) / {len(what)}"
    for letter, value in ROMAN_VALUES.items():
        parts.append(f"{value} * {count(letter)}")
    for value, pair in ROMAN_STEPS:
        if len(pair) == 2:
            parts.append(f"- {2 * ROMAN_VALUES[pair[0]]} * {count(pair)}")
    return "CAST(" + " + ".join(parts).replace("+ -", "-") + " AS INT)"


def to_roman(number: str) -> str:
    """The roman numeral of 1 to 3999: for each decimal place, its numeral."""
    out = []
    for base, (one, five, ten) in ((1000, ("M", "", "")), (100, ("C", "D", "M")), (10, ("X", "L", "C")), (1, ("I", "V", "X"))):
        digit = f"CAST(floor({number} / {base}) % 10 AS INT)"
        names = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        out.append(f"CASE {digit} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END")
    return f"concat({', '.join(out)})"


def numbering(r: Relation, text: str = "text") -> Relation:
    """Add numbered (BOOLEAN), number_type and number_level; 'none' and 0 where a text has no valid heading number."""
    d = r.d
    r = r.add(__t=d.strip(f"coalesce({text}, '')"))
    r = r.add(__system=d.cases(*((d.rx("__t", portable(p), f), f"'{n}'") for n, p, f in NUMBERINGS), otherwise="'none'"))
    by_name = {n: (portable(p), ("(?i)" if f else "")) for n, p, f in NUMBERINGS}

    def part(group: int, *names: str) -> str:
        return "CASE __system " + " ".join(f"WHEN '{n}' THEN {d.extract('__t', by_name[n][1] + by_name[n][0], group)}" for n in names) + " ELSE '' END"

    several = ["decimal_dotted", "roman_dotted", "alpha_dotted"]
    r = r.add(__a=part(1, *by_name), __b=part(2, "roman_dotted", "alpha_dotted", "mixed_alpha_num", "mixed_num_alpha"), __c=part(3, *several[1:]))
    kind = "CASE WHEN __system LIKE 'decimal%' THEN 'decimal' WHEN __system LIKE 'roman%' THEN 'roman' WHEN __system LIKE 'alpha%' THEN 'alphabetical' WHEN __system LIKE 'mixed%' THEN 'mixed' ELSE __system END"
    kinds = (d.rx("__a", r"(^|\.)\p{Nd}"), d.rx("upper(__a)", r"(^|\.)[IVXLCDM](\.|$)"), d.rx("upper(__a)", r"(^|\.)[ABE-HJKN-UWYZ](\.|$)"))
    mixed = " + ".join(f"CASE WHEN {k} THEN 1 ELSE 0 END" for k in kinds)
    complex_ = f"CASE WHEN {mixed} > 1 THEN 'mixed' WHEN {kinds[0]} THEN 'decimal' WHEN {kinds[1]} THEN 'roman' WHEN {kinds[2]} THEN 'alphabetical' ELSE 'unknown' END"
    dots = "length(__a) - length(replace(__a, '.', '')) + 1"
    parts = "1 + CASE WHEN __b <> '' THEN 1 ELSE 0 END + CASE WHEN __c <> '' THEN 1 ELSE 0 END"
    zero = d.rx("__a", r"(^|\.)0+(\.|$)")
    valid = d.cases(
        ("__system = 'none'", "FALSE"),
        ("__system LIKE 'decimal%'", f"NOT {zero}"),
        ("__system LIKE 'roman%'", f"{valid_roman(d, '__a')} AND (__b = '' OR {valid_roman(d, '__b')}) AND (__c = '' OR {valid_roman(d, '__c')})"),
        otherwise="TRUE",
    )
    r = r.add(
        __kind=f"CASE WHEN __system = 'complex_hierarchy' THEN {complex_} ELSE {kind} END",
        __level=f"CAST(CASE WHEN __system = 'none' THEN 0 WHEN __system = 'complex_hierarchy' OR __system LIKE 'decimal%' THEN {dots} ELSE {parts} END AS INT)",
        __valid=valid,
    )
    lead = d.extract("__t", r"^([IVXLCDMivxlcdm]+)")
    letter = d.any_rx("__t", [r"^[A-Za-z]\s*\.?\s*$", r"^[A-Za-z]\.\s+[A-Z]", r"^[A-Za-z]\s+[A-Z]"])
    roman = d.any_rx("__t", [r"^[IVXLCDMivxlcdm]+\s*\.?\s*$", r"^[IVXLCDMivxlcdm]+\.\s+[A-Z]", r"^[IVXLCDMivxlcdm]+\s+[A-Z]"])
    r = r.add(numbered=f"(__valid AND __kind <> 'unknown' AND CASE __kind WHEN 'alphabetical' THEN {letter} WHEN 'roman' THEN {roman} AND {valid_roman(d, lead)} ELSE TRUE END)")
    r = r.add(number_type="CASE WHEN numbered THEN __kind ELSE 'none' END", number_level="CASE WHEN numbered THEN __level ELSE 0 END", number_parts="CASE WHEN numbered AND __kind = 'decimal' THEN __a END")
    return r.drop("__t", "__system", "__a", "__b", "__c", "__kind", "__level", "__valid")


def hierarchy(r: Relation) -> Relation:
    """Of each document's numbered blocks in order: whether no level is skipped on the way down."""
    r = r.where("numbered", derived=True).add(__before="coalesce(lag(number_level) OVER (PARTITION BY doc_id ORDER BY page, block_id), 0)")
    return r.group("doc_id", has_proper_hierarchy="bool_and(number_level <= __before + 1)", numbered_blocks="count(*)")


def sequence_check(r: Relation) -> Relation:
    """One row a document: whether its numbers skip no level and count up in each decimal place.

    In each place the first number seen may be any, and each later one is the one before it plus one. Parts beyond 18 digits,
    or in digits other than ASCII, count as out of sequence unless they are the first. Needs numbering().
    """
    d = r.d
    order = "ORDER BY page, block_id"
    ids = r.group("doc_id", __any="count(*)").pick("doc_id")
    rows = r.where("numbered", derived=True).pick("doc_id", "block_id", "page", "number_level", "number_parts")
    rows = rows.add(__before=f"coalesce(lag(number_level) OVER (PARTITION BY doc_id {order}), 0)")
    levels = rows.group("doc_id", numbered_blocks="count(*)", has_proper_hierarchy="bool_and(number_level <= __before + 1)")
    parts = rows.where("number_parts IS NOT NULL").add(__parts=d.split("number_parts", "."))
    parts = parts.explode("place", d.numbers(d.size("__parts"))).add(part=d.item_at("__parts", "place")).where("part <> ''")
    parts = parts.add(value="TRY_CAST(part AS BIGINT)").add(__last=f"lag(value) OVER (PARTITION BY doc_id, place {order})", __nth=f"row_number() OVER (PARTITION BY doc_id, place {order})")
    good = parts.group("doc_id", has_sequential_numbering="bool_and(__nth = 1 OR coalesce(value = __last + 1, FALSE))")
    out = ids.join(levels, ["doc_id"], "left").join(good, ["doc_id"], "left")
    out = out.add(numbered_blocks="coalesce(numbered_blocks, 0)", has_proper_hierarchy="coalesce(has_proper_hierarchy, TRUE)", has_sequential_numbering="coalesce(has_sequential_numbering, TRUE)")
    return out.add(is_consistent="has_proper_hierarchy AND has_sequential_numbering")
