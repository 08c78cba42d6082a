"""Rules that accept, exclude or reject a text as a heading, with the reason.

Personal data is no part of the rules: callers pass ``personal``, (name, pattern) pairs that exclude.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.patterns import portable
from ..plans import Relation, SparkRelation
from .numbering import numbering


def named(d, text: str, table, otherwise: str = "NULL") -> str:
    """The name of the first pattern found."""
    return d.cases(*((d.rx(text, portable(p), f), f"'{n}'") for n, p, f in table), otherwise=otherwise)


def positive(r: Relation) -> Relation:
    """Add positive: what speaks for a heading, or null. Adds the numbering if it isn't there."""
    if not r.has("numbered"):
        r = numbering(r)
    d = r.d
    r = r.add(__t=d.strip("coalesce(text, '')"))
    pattern = named(d, "__t", P.POSITIVES)
    return r.add(positive=f"CASE WHEN numbered THEN concat('hierarchical_', number_type, '_level_', CAST(number_level AS STRING)) ELSE {pattern} END").drop("__t")


def _start(d) -> dict[str, str]:
    """Conditions on how a text begins, by the reason they give."""
    first = d.first_char("__t")
    return {
        "starts_with_bad_special_char": d.isin(first, list("&_,.\\%*!~")),
        "dollar_not_followed_by_alphanumeric": d.rx("__t", r"^\$[^\p{L}\p{N}]"),
        "too_short_less_than_4_chars": f"(length(__t) <= 3 AND NOT {d.rx('__t', '^[IVX]+$', 'i')} AND NOT {d.rx('__t', r'^([A-Z]|[\p{Nd}]+)$')}",
    }


def rule_filter(r: Relation) -> Relation:
    """Add rule_reject (BOOLEAN) and rule_reasons, the chain of rules up to the first that decides."""
    if not r.has("positive"):
        r = positive(r)
    d = r.d
    r = r.add(__t=d.strip("coalesce(text, '')"))
    r = r.add(__n=d.words("__t"), __low="lower(__t)")
    start, one = _start(d), "__n = 1"
    roman = d.rx("__t", r"^[IVX]+\.?[ \t]*$", "i")
    soft = [
        ("__t LIKE '%.' AND __n > 15", "long_sentence_with_period"), ("__n > 20", "too_many_words"), ("length(__t) > 150", "too_many_characters"),
        (d.has_any("__low", P.IDENTITY), "clear_identity_pattern"), (d.isin("__low", P.OBVIOUS), "obvious_false_positive"),
    ]
    r = r.add(
        __hard=d.cases(
            (start["starts_with_bad_special_char"], "'starts_with_bad_special_char'"),
            (start["dollar_not_followed_by_alphanumeric"], "'dollar_not_followed_by_alphanumeric'"),
            (start["too_short_less_than_4_chars"] + " AND __low <> 'a')", "'too_short_less_than_4_chars'"),
            (f"{one} AND {d.isin('__low', P.FUNCTION_WORDS)} AND NOT {d.rx('__t', '^([IVXivx]|[A-Z])$')}", "'single_word_function_word'"),
            (f"{d.lower_first('__t')} AND NOT {d.isin('__t', P.LOWERCASE_NAMES)}", "'starts_with_lowercase'"),
        ),
        __kept=d.cases(
            ("numbered", "concat('preserved_hierarchical_', number_type, '_level_', CAST(number_level AS STRING))"),
            ("positive IS NOT NULL", "concat('preserved_positive_pattern_', positive)"),
            (f"{one} AND {d.isin('__low', P.SINGLE_HEADINGS + P.MORE_SINGLE_HEADINGS)} AND {d.upper_first('__t')}", "'preserved_single_word_heading'"),
            (f"{roman} AND {d.upper('__t')}", "'preserved_roman_numeral'"),
            (d.rx("__t", r"^(\p{Nd}+(\.\p{Nd}+)*|[A-Z](\.\p{Nd}+)*)\.?$"), "'preserved_numbered_heading'"),
        ),
        __soft=d.listed(*soft),
        __count=d.points(*((c, 1) for c, _ in soft)),
    )
    return r.add(
        rule_reject=f"CASE WHEN __hard IS NOT NULL THEN TRUE WHEN __kept IS NOT NULL THEN FALSE ELSE __count >= 2 OR {d.has('__soft', 'obvious')} END",
        rule_reasons="coalesce(__hard, __kept, __soft)",
    ).drop("__t", "__n", "__low", "__hard", "__kept", "__soft", "__count")


def exclusion(r: Relation, personal: list[tuple[str, str]] = ()) -> Relation:
    """Add excluded (BOOLEAN) and exclusion_reason; what speaks for a heading comes first."""
    if not r.has("positive"):
        r = positive(r)
    d = r.d
    r = r.add(__t=d.strip("coalesce(text, '')"))
    r = r.add(__low="lower(__t)")
    start = _start(d)
    patterns = [*P.EXCLUSIONS, *((n, p, "i") for n, p in personal)]
    safe, bad = (
        d.cases(
            ("positive IS NOT NULL", "concat('positive_override_', positive)"),
            (f"{d.rx('__t', r'^[IVX]+\.?$', 'i')} OR {d.rx('__t', portable(r'^[IVX]+\.\s+[A-Z].*$'), 'i')}", "'protected_roman_numeral'"),
            (d.rx("__t", portable(r"^\d+(?:\.\d+)*\.?\s*(?:[A-Z].*)?$")), "'protected_numbered_heading'"),
            (d.rx("__t", portable(r"^[A-Z]\.?\s*(?:[A-Z].*)?$")), "'protected_letter_heading'"),
            (f"{d.isin('__low', P.SINGLE_HEADINGS)} AND {d.upper_first('__t')}", "'legitimate_single_word'"),
        ),
        d.cases(
            (start["starts_with_bad_special_char"], "'starts_with_bad_special_char'"),
            (f"{start['dollar_not_followed_by_alphanumeric']} OR __t = '$'", "'dollar_not_followed_by_alphanumeric'"),
            (start["too_short_less_than_4_chars"] + ")", "'too_short_less_than_4_chars'"),
            (f"{d.lower_first('__t')} AND __low <> 'etc'", "'starts_with_lowercase'"),
            (f"{d.words('__t')} = 1 AND {d.isin('__low', P.EXCLUDED_WORDS)}", "'single_word_function_word'"),
            otherwise=named(d, "__t", patterns),
        ),
    )
    if isinstance(r, SparkRelation):  # what is safe is not looked at further
        r = r.add(__safe=safe).add(__bad=f"CASE WHEN __safe IS NULL THEN {bad} END")
    else:
        r = r.add(__safe=safe, __bad=bad)
    return r.add(excluded="__safe IS NULL AND __bad IS NOT NULL", exclusion_reason="coalesce(__safe, __bad, '')").drop("__t", "__low", "__safe", "__bad")


def prefix_kind(d, text: str) -> str:
    """Which kind of bare number or letter a text is, or null."""
    return named(d, text, P.PREFIXES)
