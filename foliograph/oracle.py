"""SQL for DuckDB written by hand, as a second definition of what the operators compute.

Nothing here comes from the plans of ``operators``: the texts follow the rules as users of the results know them, in other
forms (lists and folds for window functions, positions for patterns). Shared are the block tables, which are no operators, and
the fixed values of ``functions.patterns``.
"""

from __future__ import annotations

import re

from .functions import patterns as P
from .functions.dialect import WS
from .functions.patterns import portable
from .sources import blocks
from .sources.blocks import SqlTables


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(text: str, pattern: str, either_case: bool = False) -> str:
    return f"regexp_matches({text}, {q('(?i)' * either_case + portable(pattern))})"


def at_start(text: str, pattern: str, either_case: bool = False) -> str:
    return rx(text, f"^(?:{pattern})", either_case)


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def split_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{WS}]+'), lambda w: w <> '')"


def n_words(text: str) -> str:
    return f"len({split_words(text)})"


def any_of(conditions) -> str:
    return "(" + " OR ".join(conditions) + ")"


def words_in(text: str, words) -> str:
    return f"list_contains([{', '.join(map(q, words))}], {text})"


def first_name(text: str, table) -> str:
    """The first name of a table of (name, pattern, flags) whose pattern occurs."""
    return "list_extract(list_filter([" + ", ".join(f"CASE WHEN {rx(text, p, bool(f))} THEN {q(n)} END" for n, p, f in table) + "], lambda n: n IS NOT NULL), 1)"


def names_joined(by: str, *pairs: tuple[str, str]) -> str:
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {n} END' for c, n in pairs)}], lambda n: n IS NOT NULL), {q(by)})"


def is_upper(t: str) -> str:
    return f"({t} = upper({t}) AND {t} <> lower({t}))"


def is_title(t: str) -> str:
    """Every run of letters begins with a capital, has no other, and there is one at least."""
    runs = rf"regexp_extract_all({t}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+')"
    return f"(len({runs}) > 0 AND len(list_filter({runs}, lambda r: NOT regexp_full_match(r, '[\\p{{Lu}}\\p{{Lt}}]\\p{{Ll}}*'))) = 0)"


TEXT = "coalesce(text, '')"
TABLES = {"star": blocks.star, "lines": blocks.lines}


def query(source: str, select: str, *ctes: tuple[str, str]) -> str:
    base = f"b AS ({TABLES[source](SqlTables()).sql()})" if source in TABLES else source
    return "WITH " + ",\n".join([base, *(f"{name} AS ({text})" for name, text in ctes)]) + f"\n{select}"


# Numbering. A text's system is the first of the table that it matches; its parts decide level and validity.

def _group(k: int) -> str:
    """A group of the pattern of the text's system; the pattern of a system has not always so many."""
    cases = " ".join(f"WHEN {q(n)} THEN regexp_extract(t, {q('(?i)' * bool(f) + portable(p))}, {k})" for n, p, f in P.NUMBERINGS if re.compile(p).groups >= k)
    return f"CASE sys {cases} ELSE '' END"


def _roman(text: str) -> str:
    return f"({text} <> '' AND regexp_full_match(upper({text}), 'M{{0,3}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})'))"


NUMBERED = (
    ("t0", f"SELECT *, {strip(TEXT)} AS t FROM b"),
    ("t1", f"SELECT *, {first_name('t', P.NUMBERINGS)} AS sys FROM t0"),
    ("t2", f"SELECT *, {_group(1)} AS g1, {_group(2)} AS g2, {_group(3)} AS g3 FROM t1"),
    ("t3", "SELECT *, list_filter([g1, g2, g3], lambda g: g <> '') AS gs, string_split(g1, '.') AS ps FROM t2"),
    (
        "t4",
        f"""SELECT *,
  list_distinct(list_transform(ps, lambda p: CASE WHEN regexp_full_match(p, '\\p{{Nd}}+') THEN 'decimal' WHEN {_roman('p')} THEN 'roman' WHEN regexp_full_match(p, '[A-Za-z]') THEN 'alphabetical' ELSE 'bad' END)) AS kinds
  FROM t3""",
    ),
    (
        "t5",
        f"""SELECT *,
  CASE WHEN sys IS NULL THEN 'none' WHEN sys[:7] = 'decimal' THEN 'decimal' WHEN sys[:5] = 'roman' THEN 'roman' WHEN sys[:5] = 'alpha' THEN 'alphabetical' WHEN sys[:5] = 'mixed' THEN 'mixed'
    WHEN list_contains(kinds, 'bad') THEN 'bad' WHEN len(kinds) = 1 THEN kinds[1] ELSE 'mixed' END AS kind,
  CASE WHEN sys IS NULL THEN 0 WHEN sys[:7] = 'decimal' OR sys = 'complex_hierarchy' THEN len(ps) WHEN contains(sys, 'with_text') THEN 1 ELSE len(gs) END AS lev,
  CASE WHEN sys IS NULL THEN FALSE WHEN sys[:7] = 'decimal' THEN len(list_filter(ps, lambda p: regexp_full_match(p, '0+'))) = 0
    WHEN sys[:5] = 'roman' THEN CASE WHEN contains(sys, 'with_text') THEN {_roman('g1')} ELSE len(list_filter(gs, lambda g: NOT {_roman('g')})) = 0 END
    WHEN sys = 'complex_hierarchy' THEN NOT list_contains(kinds, 'bad') ELSE TRUE END AS good
  FROM t4""",
    ),
    (
        "t6",
        f"""SELECT *, good AND lev > 0 AND CASE kind
    WHEN 'alphabetical' THEN {any_of(at_start('t', p) for p in (r'[A-Za-z]\s*\.?\s*$', r'[A-Za-z]\.\s+[A-Z]', r'[A-Za-z]\s+[A-Z]'))}
    WHEN 'roman' THEN {any_of(at_start('t', p) for p in (r'[IVXLCDMivxlcdm]+\s*\.?\s*$', r'[IVXLCDMivxlcdm]+\.\s+[A-Z]', r'[IVXLCDMivxlcdm]+\s+[A-Z]'))} AND {_roman("regexp_extract(t, '^([IVXLCDMivxlcdm]+)', 1)")}
    ELSE TRUE END AS numbered FROM t5""",
    ),
    ("num", "SELECT *, CASE WHEN numbered THEN kind ELSE 'none' END AS number_type, CASE WHEN numbered THEN lev ELSE 0 END AS number_level FROM t6"),
)
POSITIVE = (*NUMBERED, ("pos", f"SELECT *, CASE WHEN numbered THEN format('hierarchical_{{}}_level_{{}}', number_type, number_level) ELSE {first_name('t', P.POSITIVES)} END AS positive FROM num"))

_BAD_FIRST = "strpos('&_,.\\%*!~', substr(t, 1, 1)) > 0 AND t <> ''"
_SHORT = f"length(t) <= 3 AND NOT {rx('t', '^[IVX]+$', True)} AND NOT {rx('t', '^[A-Z]$')} AND NOT {rx('t', r'^\d+$')}"
_CAPITAL, _SMALL = r"regexp_matches(t, '^\p{Lu}')", r"regexp_matches(t, '^\p{Ll}')"
_SOFT = names_joined(
    ";",
    ("t LIKE '%.' AND n > 15", "'long_sentence_with_period'"), ("n > 20", "'too_many_words'"), ("length(t) > 150", "'too_many_characters'"),
    (any_of(f"contains(lower(t), {q(x)})" for x in P.IDENTITY), "'clear_identity_pattern'"), (words_in("lower(t)", P.OBVIOUS), "'obvious_false_positive'"),
)
RULES = (
    *POSITIVE,
    (
        "r1",
        f"""SELECT *, {n_words('t')} AS n,
  CASE WHEN {_BAD_FIRST} THEN 'starts_with_bad_special_char'
    WHEN t[1:1] = '$' AND length(t) > 1 AND NOT regexp_matches(t, '^.[\\p{{L}}\\p{{N}}]') THEN 'dollar_not_followed_by_alphanumeric'
    WHEN {_SHORT} AND lower(t) <> 'a' THEN 'too_short_less_than_4_chars'
    WHEN {n_words('t')} = 1 AND {words_in('lower(t)', P.FUNCTION_WORDS)} AND NOT {rx('t', '^[IVX]$', True)} AND NOT {rx('t', '^[A-Z]$')} THEN 'single_word_function_word'
    WHEN {_SMALL} AND NOT {words_in('t', P.LOWERCASE_NAMES)} THEN 'starts_with_lowercase' END AS hard FROM pos""",
    ),
    (
        "r2",
        f"""SELECT *, {_SOFT} AS soft,
  CASE WHEN numbered THEN format('preserved_hierarchical_{{}}_level_{{}}', number_type, number_level) WHEN positive IS NOT NULL THEN 'preserved_positive_pattern_' || positive
    WHEN n = 1 AND {words_in('lower(t)', P.SINGLE_HEADINGS + P.MORE_SINGLE_HEADINGS)} AND {_CAPITAL} THEN 'preserved_single_word_heading'
    WHEN {at_start('t', r'[IVX]+\.?\s*$', True)} AND {is_upper('t')} THEN 'preserved_roman_numeral'
    WHEN {at_start('t', r'\d+(\.\d+)*\.?\s*$')} OR {at_start('t', r'[A-Z](\.\d+)*\.?\s*$')} THEN 'preserved_numbered_heading' END AS safe FROM r1""",
    ),
    (
        "rules",
        """SELECT *, CASE WHEN hard IS NOT NULL THEN TRUE WHEN safe IS NOT NULL THEN FALSE ELSE len(string_split(soft, ';')) >= 2 OR contains(soft, 'obvious') END AS rule_reject,
  coalesce(hard, safe, soft) AS rule_reasons FROM r2""",
    ),
)


def _exclusion(source: str, personal=()) -> tuple[tuple[str, str], ...]:
    return (
        (
            "e1",
            f"""SELECT *, CASE WHEN positive IS NOT NULL THEN 'positive_override_' || positive
    WHEN {at_start('t', r'[IVX]+\.?\s*$', True)} OR {at_start('t', r'[IVX]+\.\s+[A-Z].*$', True)} THEN 'protected_roman_numeral'
    WHEN {at_start('t', r'\d+(?:\.\d+)*\.?\s*(?:[A-Z].*)?$')} THEN 'protected_numbered_heading'
    WHEN {at_start('t', r'[A-Z]\.?\s*(?:[A-Z].*)?$')} THEN 'protected_letter_heading'
    WHEN {words_in('lower(t)', P.SINGLE_HEADINGS)} AND {_CAPITAL} THEN 'legitimate_single_word' END AS kept_as,
  CASE WHEN {_BAD_FIRST} THEN 'starts_with_bad_special_char'
    WHEN t[1:1] = '$' AND (length(t) <= 1 OR NOT regexp_matches(t, '^.[\\p{{L}}\\p{{N}}]')) THEN 'dollar_not_followed_by_alphanumeric'
    WHEN {_SHORT} THEN 'too_short_less_than_4_chars'
    WHEN {_SMALL} AND lower(t) <> 'etc' THEN 'starts_with_lowercase'
    WHEN {n_words('t')} = 1 AND {words_in('lower(t)', P.EXCLUDED_WORDS)} THEN 'single_word_function_word'
    ELSE {first_name('t', [*P.EXCLUSIONS, *((n, p, 'i') for n, p in personal)])} END AS lost_as FROM {source}""",
        ),
        ("exc", "SELECT *, kept_as IS NULL AND lost_as IS NOT NULL AS excluded, coalesce(kept_as, lost_as, '') AS exclusion_reason FROM e1"),
    )


# Text quality.

_CLEAN = strip(r"regexp_replace(coalesce(text, ''), '[\x{0}-\x{1F}\x{7F}-\x{9F}]', '', 'g')")
_REAL = "len(list_filter(ws, lambda w: length(w) >= 2 AND regexp_matches(w, '[a-zA-Z]')))"
VALID = (
    ("v1", f"SELECT *, coalesce(text, '') AS x, {_CLEAN} AS cl FROM b"),
    ("v2", f"SELECT *, {split_words('cl')} AS ws FROM v1"),
    (
        "val",
        f"""SELECT *, NOT (length({strip('x')}) < 2 OR length(cl) < 2
  OR (length(x) - length(cl))::DOUBLE / nullif(length(x), 0) > 0.3
  OR length(regexp_replace(cl, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE / nullif(length(cl), 0) < 0.3
  OR {at_start('x', r'[\d\s/\-.,\x{1}]+$')} OR {at_start('x', r'[\d\s\x{1}/\-.,;:!?()]+$')} OR {at_start('x', r'[^\w\s]*$')} OR {at_start('x', r'\s*[\x{1}-\x{1F}]+\s*$')}
  OR len(ws) = 0 OR length(regexp_replace(x, '[^#@$%^&*!?()]', '', 'g')) > length(x) * 0.4
  OR contains(x, '%') AND length(x) > 20 OR length(x) - length(replace(x, '?', '')) > 1 OR {any_of(f'contains(x, {q(p)})' for p in P.CORRUPT_PARTS)}
  OR contains(x, 'bY') AND length(x) > 15 OR contains(x, 'Wg') AND length(x) > 10 OR {any_of(rx('x', p) for p in P.CORRUPT)}
  OR len(ws) <= 2 AND {_REAL} = 0 OR {any_of(rx('x', p) for p in P.GARBAGE)}) AS valid_text FROM v2""",
    ),
)

# Typography, language, meaning, structure.

TYPOGRAPHY = (
    ("y1", "SELECT *, coalesce(text, '') AS x FROM b"),
    ("y2", "SELECT *, " + ", ".join(f"{any_of(at_start('x', p) for p in v)} AS {k}" for k, v in P.TYPOGRAPHY.items()) + " FROM y1"),
    (
        "typ",
        f"""SELECT *, 3 * strong::INT + 2 * moderate::INT + weak::INT AS typography_score,
  {names_joined(';', *((k, q(k + '_typography')) for k in P.TYPOGRAPHY))} AS typography_patterns FROM y2""",
    ),
)


def linguistics(source: str, name: str = "lin") -> tuple[tuple[str, str], ...]:
    anti = {k: any_of(at_start("x", p, True) for p in v) for k, v in P.ANTI_HEADINGS.items()}
    return (
        (f"{name}1", f"SELECT *, coalesce(text, '') AS x, {n_words(TEXT)} AS wc FROM {source}"),
        (
            f"{name}2",
            f"""SELECT *, CASE WHEN {is_upper('x')} AND wc > 8 THEN 'excessive_caps' WHEN {is_title('x')} THEN 'title_case' WHEN regexp_matches(x, '^\\p{{Lu}}') THEN 'capital_start' WHEN regexp_matches(x, '^\\p{{Ll}}') THEN 'lowercase_start' END AS cas,
  CASE WHEN right(x, 1) IN ('.', '!', '?') THEN 'sentence_ending' WHEN right(x, 1) = ':' THEN 'colon_ending' WHEN right(x, 1) = ',' THEN 'comma_ending' END AS fin,
  CASE WHEN wc BETWEEN 1 AND 8 THEN 'good_length' WHEN wc > 20 THEN 'too_long' END AS siz, {', '.join(f'{c} AS {k}' for k, c in anti.items())} FROM {name}1""",
        ),
        (
            name,
            f"""SELECT *, CASE WHEN wc = 0 THEN 0 ELSE 2 * coalesce(siz = 'good_length', FALSE)::INT + coalesce(cas = 'title_case', FALSE)::INT + 0.5 * coalesce(cas = 'capital_start', FALSE)::INT + coalesce(fin = 'colon_ending', FALSE)::INT END::DOUBLE AS linguistic_score,
  CASE WHEN wc = 0 THEN 0 ELSE coalesce(siz = 'too_long', FALSE)::INT + coalesce(cas IN ('excessive_caps', 'lowercase_start'), FALSE)::INT + coalesce(fin IN ('sentence_ending', 'comma_ending'), FALSE)::INT
    + sentence_fragments::INT + incomplete_phrases::INT + 2 * technical_terms::INT + 2 * list_items::INT END AS syntax_violations,
  CASE WHEN wc = 0 THEN '' ELSE {names_joined(';', ('siz IS NOT NULL', 'siz'), ('cas IS NOT NULL', 'cas'), ('fin IS NOT NULL', 'fin'), *((k, q('anti_' + k)) for k in anti))} END AS linguistic_patterns FROM {name}2""",
        ),
    )


def semantics(source: str) -> tuple[tuple[str, str], ...]:
    every = sorted({w for v in P.KEYWORDS.values() for w in v})
    found = "list_extract(list_filter([" + ", ".join("CASE WHEN " + any_of(f"contains(s, {q(w)})" for w in v) + f" THEN {q('heading_' + k)} END" for k, v in P.KEYWORDS.items()) + "], lambda k: k IS NOT NULL), 1)"
    lowered = strip("lower(coalesce(text, ''))")
    return (
        ("m1", f"SELECT *, {lowered} AS s, {split_words(lowered)} AS sw FROM {source}"),
        (
            "m2",
            f"""SELECT *, {found} AS kw, {words_in('sw[1]', P.SENTENCE_STARTERS)} AS starts, {words_in('sw[1]', P.CONJUNCTIONS)} AS joins,
  len(list_filter(sw[1:2], lambda w: {words_in('w', P.PREPOSITIONS)})) > 0 AS early, {any_of(rx('s', p, True) for p in P.TECHNICAL)} AS tech,
  len(list_filter(sw, lambda w: {words_in('w', every)})) > 0 AS entire FROM m1""",
        ),
        (
            "sem",
            f"""SELECT *, CASE WHEN len(sw) = 0 THEN 0 ELSE 2 * (kw IS NOT NULL)::INT - 2 * coalesce(starts, FALSE)::INT - 3 * coalesce(joins, FALSE)::INT - early::INT - 2 * tech::INT
    + CASE WHEN entire AND len(sw) BETWEEN 2 AND 8 THEN 2 WHEN entire AND len(sw) BETWEEN 9 AND 15 THEN 1 ELSE 0 END END AS semantic_score,
  CASE WHEN len(sw) = 0 THEN 'unknown' WHEN len(sw) = 1 THEN 'fragment' WHEN len(sw) <= 8 THEN CASE WHEN entire THEN 'heading_candidate' ELSE 'text' END
    WHEN len(sw) <= 15 AND entire THEN 'heading_candidate' WHEN tech THEN 'technical' WHEN kw IS NOT NULL THEN 'heading_candidate' ELSE 'text' END AS content_type,
  CASE WHEN len(sw) = 0 THEN '' ELSE {names_joined(';', ('kw IS NOT NULL', 'kw'), ('starts', "'sentence_starter'"), ('joins', "'conjunction_start'"), ('early', "'early_preposition'"), ('tech', "'technical_term'"), ('len(sw) = 1', "'single_word'"), ('entire AND len(sw) BETWEEN 2 AND 8', "'title_phrase'"), ('entire AND len(sw) BETWEEN 9 AND 15', "'longer_heading'"))} END AS semantic_patterns FROM m2""",
        ),
    )


def fonts(source: str) -> tuple[tuple[str, str], ...]:
    return (
        ("doc_fonts", f"SELECT doc_id, avg(font_size) AS fm, stddev_samp(font_size) AS fs, quantile_cont(font_size, [0.75, 0.9, 0.95]) AS fq, list(font_size) FILTER (font_size IS NOT NULL) AS fl FROM {source} GROUP BY doc_id"),
        ("size_ranks", f"SELECT doc_id, font_size, (sum(k) OVER (PARTITION BY doc_id ORDER BY font_size) - (k - 1) / 2.0) / sum(k) OVER (PARTITION BY doc_id) * 100 AS fr FROM (SELECT doc_id, font_size, count(*) AS k FROM {source} GROUP BY ALL)"),
        (
            "fon",
            f"""SELECT a.*, fm AS font_size_mean, fs AS font_size_std, fr AS font_size_percentile_rank, a.font_size / fm AS font_size_relative,
  CASE WHEN a.font_size >= fq[3] THEN 'very_large' WHEN a.font_size >= fq[2] THEN 'large' WHEN a.font_size >= fq[1] THEN 'medium' ELSE 'small' END AS font_category,
  coalesce(a.font_size > p.font_size * 1.2, FALSE) AS font_size_jump
  FROM {source} AS a JOIN doc_fonts USING (doc_id) JOIN size_ranks AS k ON k.doc_id = a.doc_id AND k.font_size = a.font_size LEFT JOIN {source} AS p ON p.doc_id = a.doc_id AND p.block_id = a.block_id - 1""",
        ),
    )


def positions(source: str) -> tuple[tuple[str, str], ...]:
    down = "OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, block_id)"
    return (
        ("p0", f"SELECT *, {n_words('text')} AS pw FROM {source}"),
        ("p1", f"SELECT *, max(line_position_on_page) OVER (PARTITION BY doc_id, page) AS pm, lag(pw, 1, 0) {down} AS pu, lead(pw, 1, 0) {down} AS pd FROM p0"),
        ("p2", "SELECT *, CASE WHEN NOT pm > 0 THEN NULL WHEN line_position_on_page <= 3 THEN 'page_top' WHEN line_position_on_page >= pm - 2 THEN 'page_bottom' WHEN line_position_on_page / pm < 0.3 THEN 'upper_third' END AS pp, pw <= 6 AND greatest(pu, pd) > 10 AS pa FROM p1"),
        ("pst", f"SELECT *, CASE pp WHEN 'page_top' THEN 2 WHEN 'page_bottom' THEN -1 WHEN 'upper_third' THEN 1 ELSE 0 END + pa::INT AS position_score, {names_joined(';', ('pp IS NOT NULL', 'pp'), ('pa', q('isolated_short_text')))} AS position_patterns FROM p2"),
    )


def structure(source: str) -> tuple[tuple[str, str], ...]:
    levels = " ".join("WHEN " + any_of(at_start("coalesce(text, '')", p, True) for p in v) + f" THEN {k}" for k, v in P.LEVEL_NUMBERING.items())
    return (
        ("u1", f"SELECT *, CASE {levels} ELSE 0 END AS hierarchy_level FROM {source}"),
        ("u2", "SELECT *, font_size_jump OR strpos(position_patterns, 'page_top') > 0 OR hierarchy_level > 0 AS section_boundary FROM u1"),
        ("str", f"SELECT *, [0, 3, 2, 1][hierarchy_level + 1] + section_boundary::INT AS structure_score, {names_joined(';', ('hierarchy_level > 0', chr(39) + 'level_' + chr(39) + ' || hierarchy_level || ' + chr(39) + '_numbering' + chr(39)), ('section_boundary', q('section_boundary')))} AS structure_patterns FROM u2"),
    )


_WEIGHTS = {"typography": 0.25, "linguistic": 0.2, "position": 0.15, "semantic": 0.2, "structure": 0.2}
_NORMS = ", ".join(f"min({k}_score) AS {k}_lo, max({k}_score) AS {k}_hi" for k in _WEIGHTS)
_TOTAL = " + ".join(f"CASE WHEN {k}_hi > {k}_lo THEN ({k}_score - {k}_lo)::DOUBLE / ({k}_hi - {k}_lo) ELSE 0.5::DOUBLE END * {w}::DOUBLE" for k, w in _WEIGHTS.items())


def likelihood(source: str) -> tuple[tuple[str, str], ...]:
    """Everything up to the levels. The first H2 before any H1 counts as an H1, and only the first of either can be it."""
    return (
        *fonts(source),
        ("y1", "SELECT *, coalesce(text, '') AS x FROM fon"), *TYPOGRAPHY[1:],
        ("typ2", "SELECT * EXCLUDE (x) FROM typ"),
        *linguistics("typ2"), *positions("lin"), *semantics("pst"), *structure("sem"),
        ("ranges", f"SELECT doc_id, {_NORMS} FROM str GROUP BY doc_id"),
        ("lik", f"SELECT *, greatest(0, least(1, {_TOTAL} - syntax_violations * 0.1::DOUBLE)) AS heading_likelihood FROM str JOIN ranges USING (doc_id)"),
        (
            "k1",
            """SELECT *, CASE WHEN heading_likelihood < 0.3 THEN NULL WHEN hierarchy_level = 1 OR font_size_percentile_rank >= 95 OR contains(upper(text), 'CHAPTER') OR contains(upper(text), 'SECTION') THEN 'H1'
    WHEN hierarchy_level = 2 OR font_category IN ('large', 'medium') AND typography_score >= 1 AND semantic_score >= 0 THEN 'H2' ELSE 'H3' END AS own FROM lik""",
        ),
        ("k2", "SELECT doc_id AS kd, arg_min(block_id, (page, line_position_on_page, block_id)) AS first_major FROM k1 WHERE own IN ('H1', 'H2') GROUP BY doc_id"),
        (
            "lev",
            """SELECT *, CASE WHEN own = 'H2' AND block_id = first_major THEN 'H1' ELSE coalesce(own, 'H3') END AS recommended_level,
  CASE WHEN own IS NULL THEN 0.5 WHEN own = 'H1' THEN 0.9 WHEN own = 'H2' THEN 0.8 ELSE 0.7 END::DOUBLE AS level_confidence FROM k1 LEFT JOIN k2 ON kd = doc_id""",
        ),
    )


_HARD = f"(right(t, 1) = ',' OR {any_of(f'starts_with(t, {q(w)})' for w in ('the ', 'this ', 'that ', 'these ', 'it '))} OR {n_words('t')} > 15 OR {words_in('lower(t)', ['initially,', 'bcrypt.js', 'dockerfile', 'docker-based'])})"
def enhanced(source: str) -> tuple[tuple[str, str], ...]:
    """The score from the metadata, its reasons, and the decision."""
    return (
        *likelihood(source),
        ("n1", f"SELECT *, {strip(TEXT)} AS t, coalesce(heading_confidence, 0.8) AS c FROM lev"),
        (
            "n2",
            f"""SELECT *, {_HARD} AS hard_filter, heading_likelihood + (CASE WHEN c >= 0.8 THEN 0.2 WHEN c >= 0.5 THEN 0.1 ELSE -0.1 END)::DOUBLE - 0.15::DOUBLE * syntax_violations
        + (CASE WHEN content_type = 'heading_candidate' THEN 0.1 WHEN content_type IN ('technical', 'fragment') THEN -0.2 ELSE 0 END)::DOUBLE + (CASE WHEN font_category IN ('very_large', 'large') THEN 0.1 ELSE 0 END)::DOUBLE
        + CASE WHEN structure_score > 0 THEN structure_score * 0.05::DOUBLE ELSE 0 END + CASE WHEN position_score > 0 THEN position_score * 0.03::DOUBLE ELSE 0 END AS raw FROM n1""",
        ),
        (
            "enh",
            f"""SELECT *, greatest(0, least(1, CASE WHEN hard_filter THEN least(raw, 0.2::DOUBLE) ELSE raw END)) AS filter_score,
      {names_joined('; ', ('TRUE', "CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END || '_confidence_' || format('{:.3f}', c)"), ('syntax_violations > 0', "'syntax_violations_' || syntax_violations"), ("content_type = 'heading_candidate'", "'heading_candidate'"), ("content_type IN ('technical', 'fragment')", "'content_type_' || content_type"), ("font_category IN ('very_large', 'large')", "'font_' || font_category"), ('structure_score > 0', "'structure_score_' || structure_score"), ('position_score > 0', "'position_score_' || position_score"), ('hard_filter', "'hard_filter_applied'"))} AS filter_reasons FROM n2""",
        ),
        (
            "dec",
            """SELECT *, CASE WHEN is_heading_pred <> 1 THEN 'not_predicted' WHEN syntax_violations >= 8 OR heading_likelihood < 0.01 THEN 'filtered_hard_criteria'
        WHEN content_type = 'technical' AND c < 0.3 AND filter_score < 0.1 THEN 'filtered_soft_criteria' WHEN c >= 0.8 THEN 'keep_high_confidence' WHEN filter_score >= 0.2 THEN 'keep_good_score'
        WHEN c >= 0.5 THEN 'keep_medium_quality' ELSE 'keep_low_quality' END AS filter_decision FROM enh""",
        ),
    )


ENHANCED = enhanced("b")

_ROUND = "round({0}, 6) AS {0}"


def _r(*names: str) -> str:
    return ", ".join(_ROUND.format(n) for n in names)


_UNSCALED = ("b_", "SELECT * REPLACE (CAST(block_id % 40 AS DOUBLE) AS line_position_on_page) FROM b")

# Rule headings: an accepted number or pattern, a known word, or enough points of typography.

def rule_headings(personal=()) -> tuple[tuple[str, str], ...]:
    bad = any_of(f"contains(lower(x), {q(w)})" for w in P.BAD_HEADING_PARTS)
    points = f"""CASE WHEN fz > 18 THEN 3 WHEN fz > 15 THEN 2 WHEN fz > 13 THEN 1 ELSE 0 END + CASE WHEN bold THEN 2 WHEN italic THEN 1 ELSE 0 END
    + CASE WHEN caps AND jn <= 8 THEN 2 WHEN caps AND jn <= 15 THEN 1 ELSE 0 END + CASE WHEN titled >= 2 AND jn <= 10 THEN 2 ELSE 0 END
    + CASE WHEN right(x, 1) = ':' AND jn <= 8 THEN 2 ELSE 0 END + (jn <= 8 AND NOT bad)::INT + (regexp_matches(cl, '^[A-Z]') AND NOT bad)::INT + (line_position_on_page <= 0.1)::INT
    - 2 * bad::INT - CASE WHEN jn > 20 THEN 2 WHEN jn > 15 THEN 1 ELSE 0 END - (right(x, 1) = '.' AND jn > 10)::INT
    - 2 * {words_in("substr(t, 1, 1)", ["•", "-", "*", "○", "▪"])}::INT - {any_of(f"contains(x, {q(w)})" for w in ('=', '()', '{}', '[]', '//'))}::INT"""
    return (
        *VALID,
        ("b2", "SELECT * EXCLUDE (ws) FROM val"), *((n, s.replace("FROM b", "FROM b2") if n == "t0" else s) for n, s in POSITIVE), *_exclusion("pos", personal),
        ("j1", f"SELECT *, font_size AS fz, {bad} AS bad, len(regexp_extract_all(x, '\\b[A-Z][a-z]+')) AS titled, {n_words('cl')} AS jn, regexp_matches(cl, '[a-zA-Z]') AS letters, {n_words('x')} AS xn FROM exc"),
        ("j2", f"SELECT *, letters AND {is_upper('x')} AS caps FROM j1"),
        ("j3", f"SELECT *, {points} AS pts, regexp_matches(upper(x), {q(P.KNOWN_HEADINGS)}) AND xn <= 8 AS known FROM j2"),
        (
            "j4",
            """SELECT *, CASE WHEN length(x) < 3 OR NOT valid_text THEN 'skipped' WHEN excluded THEN 'excluded_' || exclusion_reason WHEN numbered THEN format('numbered_{}_level_{}', number_type, number_level)
    WHEN positive IS NOT NULL THEN 'positive_' || positive WHEN known THEN 'known_heading_pattern' WHEN pts >= 3 AND letters AND length(cl) >= 3 THEN 'typography_score_' || pts
    WHEN (fz > 15 OR bold) AND jn <= 15 AND NOT bad AND letters THEN 'typography_fallback' ELSE 'not_heading' END AS heading_reason FROM j3""",
        ),
        ("j5", "SELECT *, heading_reason NOT IN ('skipped', 'not_heading') AND NOT starts_with(heading_reason, 'excluded') AS heading FROM j4"),
        (
            "jud",
            """SELECT *, CASE WHEN NOT heading THEN NULL WHEN numbered THEN 'H' || least(number_level, 3)
    WHEN fz >= 22 OR fz >= 18 AND bold OR fz >= 16 AND bold AND caps OR caps AND xn <= 3 AND fz >= 14 THEN 'H1'
    WHEN fz >= 16 OR fz >= 14 AND bold OR caps AND xn <= 6 AND fz >= 12 THEN 'H2' ELSE 'H3' END AS level FROM j5""",
        ),
    )


# Blocks of web pages: block-level tags become marks, all other tags go, and each mark's tag keeps the text up to the next.

_BLOCK_TAGS = "html|head|body|title|meta|link|base|h[1-6]|p|ul|ol|li|dl|dt|dd|div|article|section|aside|nav|header|footer|main|table|thead|tbody|tr|td|th|form|pre|blockquote|figure|figcaption|hr|address|script|style"
PAGE = f"""g1 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script[\\s>].*?</script>|<style[\\s>].*?</style>', '', 'g'), '(?i)<br\\s*/?>', ' ', 'g') AS h FROM pages),
g2 AS (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '(?i)<(/?(?:{_BLOCK_TAGS}))(?:\\s[^>]*)?/?>', chr(1) || '\\1' || chr(2), 'g'), '</?[a-zA-Z][^>]*>', '', 'g'), chr(1)) AS parts FROM g1),
g3 AS (SELECT page_id, list_filter(list_transform(parts, lambda p: string_split(p, chr(2))), lambda p: regexp_full_match(lower(p[1]), 'h[1-6]|title|p|li|footer')) AS ps FROM g2),
g4 AS (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS block_id FROM g3),
b AS (SELECT page_id AS doc_id, block_id::BIGINT AS block_id, lower(p[1]) AS tag, {strip('p[2]')} AS text, 1 AS page,
  (CASE lower(p[1]) WHEN 'title' THEN 24 WHEN 'h1' THEN 18 WHEN 'h2' THEN 16 WHEN 'h3' THEN 14 WHEN 'h4' THEN 13 WHEN 'h5' THEN 12 WHEN 'h6' THEN 11 WHEN 'p' THEN 10 WHEN 'li' THEN 9 ELSE 8 END)::DOUBLE AS font_size,
  lower(p[1]) NOT IN ('p', 'li', 'footer') AS bold, FALSE AS italic, least(block_id, 40) / 40.0::DOUBLE AS line_position_on_page FROM g4)"""

OUTLINE = (*rule_headings(), ("ent", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, block_id)::INT AS place, level, t AS text, page FROM jud WHERE heading"))
_SHOWN = r"regexp_replace(array_to_string(list(t ORDER BY block_id), ' '), '[ \t\n\r]+', ' ', 'g')"
_UNWANTED = any_of(rx("lower(t)", p) for p in P.UNWANTED_TITLES)
TITLES = (
    *OUTLINE,
    ("w1", f"SELECT doc_id, block_id, font_size, {strip('text')} AS t FROM b WHERE page = 1 AND length({strip('text')}) > 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY block_id) <= 20"),
    ("w2", f"SELECT doc_id, {strip(_SHOWN)} AS shown FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS i, max(font_size) OVER (PARTITION BY doc_id) AS top FROM w1) WHERE i <= 15 AND font_size >= top - 0.5 AND NOT {_UNWANTED} GROUP BY doc_id"),
    ("w3", "SELECT doc_id, list(text ORDER BY place)[1] AS h1 FROM ent WHERE level = 'H1' AND place <= 100 GROUP BY doc_id"),
)

_FLAG = "({0})::INT AS {1}"


def _share(p: str) -> str:
    return f"(length({TEXT}) - length(regexp_replace({TEXT}, '{p}', '', 'g')))::DOUBLE / (length({TEXT}) + 1)"


L_TEXT = query(
    "star",
    f"""SELECT doc_id, block_id, length({TEXT})::INT AS text_length, length({TEXT})::INT AS char_count, {n_words(TEXT)}::INT AS word_count, round(length({TEXT})::DOUBLE / ({n_words(TEXT)} + 1), 6) AS avg_word_length,
  round({_share('[A-Z]')}, 6) AS text_upper_ratio, round({_share('[0-9]')}, 6) AS text_digit_ratio, round({_share('[.!?]')}, 6) AS text_punct_ratio, round({_share('[' + WS + ']')}, 6) AS text_space_ratio,
  {', '.join(_FLAG.format(c, n) for c, n in ((f"regexp_matches({TEXT}, '^[A-Z]')", 'starts_with_capital'), (is_upper(TEXT), 'all_caps'), (is_title(TEXT), 'title_case'), (f"regexp_matches({TEXT}, '^[0-9]')", 'starts_with_number'), (f"right({TEXT}, 1) = ':'", 'ends_with_colon'), (f"contains({TEXT}, '**') OR regexp_matches({TEXT}, '{chr(92)}bBOLD{chr(92)}b')", 'has_bold_markers'), (f'{n_words(TEXT)} = 1', 'single_word'), (f'{n_words(TEXT)} BETWEEN 2 AND 5', 'short_heading'), (f'{n_words(TEXT)} BETWEEN 6 AND 10', 'medium_heading'), (f"len(list_intersect(regexp_extract_all(lower({TEXT}), '[a-z0-9_]+'), ['chapter', 'section', 'part', 'introduction', 'conclusion', 'summary', 'abstract', 'references', 'appendix'])) > 0", 'has_common_heading_words')))} FROM b""",
)

_FONT_P = (70, 75, 80, 85, 90, 95, 98, 99)
L_FONT = query(
    "star",
    f"""SELECT doc_id, block_id, font_size, {', '.join(f'(font_size >= list_extract(qs, {i + 1}))::INT AS font_ge_{p}p' for i, p in enumerate(_FONT_P))},
  round((font_size - lo) / (hi - lo + 1), 6) AS font_size_normalized, round((font_size - mean) / (sd + 1), 6) AS font_size_zscore, (font_size = hi)::INT AS is_largest_font, (font_size > mid)::INT AS above_median_font,
  (page = 1)::INT AS is_first_page, (page <= 3)::INT AS is_early_page FROM b JOIN d USING (doc_id)""",
    ("d", f"SELECT doc_id, min(font_size) AS lo, max(font_size) AS hi, avg(font_size) AS mean, stddev_samp(font_size) AS sd, median(font_size) AS mid, quantile_cont(font_size, [{', '.join(str(p / 100) for p in _FONT_P)}]) AS qs FROM b GROUP BY doc_id"),
)
L_BOX = query(
    "star",
    f"""SELECT doc_id, block_id, {_r('x_position', 'y_position', 'width', 'height', 'center_x', 'center_y', 'aspect_ratio', 'area')}, round((x_position - xl) / (xh - xl + 1), 6) AS x_position_norm, round((y_position - yl) / (yh - yl + 1), 6) AS y_position_norm,
  (x_position <= xq)::INT AS left_aligned, (y_position <= yq)::INT AS top_of_page, (center_x BETWEEN cq[1] AND cq[2])::INT AS center_aligned, (aspect_ratio > 5)::INT AS is_wide, (aspect_ratio < 2)::INT AS is_tall FROM s JOIN d USING (doc_id)""",
    ("s", "SELECT doc_id, block_id, x0 AS x_position, y0 AS y_position, x1 - x0 AS width, y1 - y0 AS height, (x0 + x1) / 2 AS center_x, (y0 + y1) / 2 AS center_y, (x1 - x0) / (y1 - y0 + 1) AS aspect_ratio, (x1 - x0) * (y1 - y0) AS area FROM b"),
    ("d", "SELECT doc_id, min(x_position) AS xl, max(x_position) AS xh, min(y_position) AS yl, max(y_position) AS yh, quantile_cont(x_position, 0.1) AS xq, quantile_cont(y_position, 0.1) AS yq, quantile_cont(center_x, [0.4, 0.6]) AS cq FROM s GROUP BY doc_id"),
)
L_POS = query(
    "star",
    f"""SELECT doc_id, block_id, n + v + p AS total_pos_tags, round(n::DOUBLE / (n + v + p + 1), 6) AS noun_ratio, round(v::DOUBLE / (n + v + p + 1), 6) AS verb_ratio, 0.0::DOUBLE AS adj_ratio, round(p::DOUBLE / (n + v + p + 1), 6) AS propn_ratio,
  (n > 0.5 * (n + v + p + 1))::INT AS high_noun_content, (p > 0)::INT AS has_proper_nouns, (v < 0.2 * (n + v + p + 1))::INT AS minimal_verbs, (n > 0.5 * (n + v + p + 1) AND p > 0 AND v < 0.2 * (n + v + p + 1))::INT AS heading_pos_pattern,
  (w <= 3)::INT AS text_very_short, (w BETWEEN 4 AND 8)::INT AS text_short, (x0 <= xq)::INT AS left_quarter, (right(text, 1) = '?')::INT AS is_question,
  (regexp_matches(text, '^[{WS}]*(?:[•◦▪▫◾▸►‣⁃]|\\p{{Nd}}+\\.[{WS}]+[a-z])'))::INT AS is_list_item,
  (len(list_filter(['http://', 'https://', 'www.', '.com', '.org', '.edu', '.gov', 'ftp://'], lambda s: contains(lower(text), s))) > 0)::INT AS enhanced_url_detection, (length(text) > 100 AND right(text, 1) = '.')::INT AS is_long_sentence
  FROM (SELECT *, (block_id % 4)::INT AS n, (block_id % 2)::INT AS v, (block_id % 3)::INT AS p, {n_words('text')} AS w FROM b) JOIN d USING (doc_id)""",
    ("d", "SELECT doc_id, quantile_cont(x0, 0.25) AS xq FROM b GROUP BY doc_id"),
)

_STOP = "the of and to in is that it for on".split()
L_TFIDF = query(
    "lines",
    """SELECT doc_id, block_id, term, round((1 + ln(tf)) * idf / norm, 6) AS weight FROM scored""",
    ("size", "SELECT count(*) AS rows FROM b"),
    ("w", f"SELECT doc_id, block_id, list_filter(regexp_extract_all(lower({TEXT}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT {words_in('w', _STOP)}) AS ws FROM b"),
    ("terms", "SELECT doc_id, block_id, unnest(list_concat(ws, list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2]))) AS term FROM w"),
    ("tf", "SELECT doc_id, block_id, term, count(*) AS tf FROM terms WHERE term IS NOT NULL GROUP BY ALL"),
    (
        "voc",
        """SELECT term, ln((1 + rows)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term), size
  WHERE df >= CASE WHEN rows < 1000 THEN 1 ELSE 2 END AND df <= CASE WHEN rows < 100 THEN 1.0 ELSE 0.95 END * rows
  QUALIFY row_number() OVER (ORDER BY total DESC, term) <= CASE WHEN rows < 100 THEN least(20, rows) WHEN rows < 1000 THEN least(50, rows // 2) ELSE 50 END""",
    ),
    ("scored", "SELECT *, sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY doc_id, block_id)) AS norm FROM tf JOIN voc USING (term)"),
)

_PREFIX = first_name("t", P.PREFIXES)
H_PREFIX = query(
    "star",
    """SELECT a.doc_id, a.block_id, CASE WHEN p.gives THEN p.t || ' ' || a.t ELSE a.text END AS merged_text, CASE WHEN a.gives THEN 0 ELSE a.is_heading_pred END AS is_heading_pred,
  CASE WHEN a.gives THEN 'merged_into_next' WHEN p.gives THEN 'merged_consecutive' ELSE '' END AS merge_decision FROM o AS a LEFT JOIN o AS p ON p.doc_id = a.doc_id AND p.i = a.i - 1""",
    ("s", f"SELECT *, {strip(TEXT)} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_position_on_page, block_id) AS i FROM b"),
    ("o", f"SELECT a.*, coalesce(a.is_heading_pred = 1 AND n.is_heading_pred = 1 AND n.page = a.page AND {_PREFIX.replace('(t,', '(a.t,')} IS NOT NULL AND (regexp_matches(n.t, '^\\p{{Lu}}') OR len(list_filter({split_words('n.t')}, lambda w: {words_in('lower(w)', P.HEADING_WORDS)})) > 0), FALSE) AS gives FROM s AS a LEFT JOIN s AS n ON n.doc_id = a.doc_id AND n.i = a.i + 1"),
)
_NAMED = {n: (p, bool(f)) for n, p, f in P.EXCLUSIONS}
H_TITLE = query(
    "star",
    """SELECT doc_id, block_id, CASE WHEN i = ti THEN 'document_title' ELSE 'document_subtitle' END AS title_role, text FROM s JOIN d USING (doc_id) LEFT JOIN e USING (doc_id) WHERE i = ti OR i = si""",
    ("s", f"SELECT doc_id, block_id, text, is_heading_pred, {strip(TEXT)} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_position_on_page, block_id) AS i FROM b"),
    ("d", f"SELECT doc_id, min(i) AS ti FROM s WHERE is_heading_pred = 1 AND i <= 100 AND NOT ({n_words('t')} = 1 AND length(t) < 4 OR lower(t) IN ('the', 'a', 'an') OR {any_of(rx('t', *_NAMED[k]) for k in ('technical_terms', 'technical_fragments', 'programming_terms', 'file_paths'))} OR right(t, 1) = '.' AND {n_words('t')} > 10) GROUP BY doc_id"),
    ("e", f"SELECT s.doc_id, min(i) AS si FROM s JOIN d ON d.doc_id = s.doc_id WHERE is_heading_pred = 1 AND i > ti AND i <= ti + 15 AND i <= 120 AND {n_words('t')} BETWEEN 2 AND 15 AND NOT {any_of(rx('t', p, bool(f)) for _, p, f in P.EXCLUSIONS)} GROUP BY s.doc_id"),
)
_MARK = "list_filter(range(1, length(x) + 1), lambda i: strpos('.,:;', substr(x, i, 1)) > 0 AND (i = 1 OR NOT regexp_matches(substr(x, i - 1, 1), '\\p{Nd}')) AND (i = length(x) OR NOT regexp_matches(substr(x, i + 1, 1), '\\p{Nd}')))"


def i_split(source: str, headings_only: bool) -> str:
    own = "SELECT doc_id, block_id, (block_id = 0)::INT AS is_heading, (block_id = 0)::INT AS heading_level, text AS x FROM b" if headings_only else "SELECT doc_id, block_id, is_heading, heading_level, coalesce(text, '') AS x FROM b"
    return query(
        source,
        f"""SELECT doc_id, block_id, 0 AS part, CASE WHEN k IS NULL THEN x ELSE {strip('substr(x, 1, k)')} END AS text, is_heading, heading_level FROM m
UNION ALL SELECT doc_id, block_id, 1, {strip('substr(x, k + 1)')}, 0, 0 FROM m WHERE k IS NOT NULL AND {strip('substr(x, k + 1)')} <> ''""",
        ("s", own),
        ("m", f"SELECT *, ({_MARK if not headings_only else 'CASE WHEN is_heading = 1 THEN ' + _MARK + ' END'})[1] AS k FROM s"),
    )


H_TOKENS = query(
    "star",
    """SELECT doc_id, min(block_id) AS block_id, string_agg(text, ' ' ORDER BY block_id) AS text, round(arg_min(x0, block_id), 6) AS x0, min(y0) AS y0, round(max(x1), 6) AS x1, max(y1) AS y1, min(page) AS page, any_value(label) AS label,
  CASE WHEN any_value(label) = 'title' THEN 1 WHEN length(string_agg(text, ' ' ORDER BY block_id)) < 100 THEN 2 ELSE 0 END AS heading_level FROM g GROUP BY doc_id, run""",
    ("s", "SELECT doc_id, block_id, page, text, x0, x0 + 10 AS x1, (block_id // 5)::DOUBLE AS y0, (block_id // 5 + 8)::DOUBLE AS y1, CASE WHEN bold THEN 'title' ELSE 'section' END AS label FROM b"),
    ("g", "SELECT a.*, sum(fresh) OVER (PARTITION BY doc_id ORDER BY page, block_id) AS run FROM (SELECT a.*, (p.block_id IS NULL OR (p.label, p.page, p.y0) <> (a.label, a.page, a.y0))::INT AS fresh FROM s AS a LEFT JOIN s AS p ON p.doc_id = a.doc_id AND p.block_id = a.block_id - 1) AS a"),
)

SEQUENCE = (
    *NUMBERED,
    ("o", "SELECT doc_id, list({'l': number_level, 'p': CASE WHEN number_type = 'decimal' THEN list_transform(list_filter(ps, lambda p: p <> ''), lambda p: TRY_CAST(p AS BIGINT)) ELSE [] END} ORDER BY page, block_id) FILTER (numbered) AS xs FROM num GROUP BY doc_id"),
    ("o1", "SELECT doc_id, coalesce(len(xs), 0) AS n, len(list_filter(range(1, coalesce(len(xs), 0) + 1), lambda i: xs[i].l > CASE WHEN i = 1 THEN 0 ELSE xs[i - 1].l END + 1)) = 0 AS proper, xs FROM o"),
    ("o2", "SELECT doc_id, unnest(range(1, 7)) AS k, xs FROM o1"),
    ("o3", "SELECT doc_id, list_transform(list_filter(xs, lambda x: len(x.p) >= k), lambda x: x.p[k]) AS vs FROM o2 WHERE xs IS NOT NULL"),
    ("o4", "SELECT doc_id, bool_and(len(list_filter(range(2, coalesce(len(vs), 0) + 1), lambda i: coalesce(vs[i] <> vs[i - 1] + 1, TRUE))) = 0) AS counts FROM o3 GROUP BY doc_id"),
)

SWEEP = (
    ("hs", "SELECT unnest(list_transform(range(0, 35), lambda i: round(0.10 + 0.02 * i, 2)))::DOUBLE AS h"),
    ("tot", "SELECT h, count(*) FILTER (is_heading = 1 AND heading_confidence >= h) AS tp, count(*) FILTER (is_heading = 0 AND heading_confidence >= h) AS fp, count(*) FILTER (is_heading = 1 AND heading_confidence < h) AS fn FROM b, hs GROUP BY h"),
    ("pr", "SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS r FROM tot"),
    ("fs", "SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr"),
)
AUC = (
    ("cs", "SELECT heading_confidence AS v, count(*) FILTER (is_heading = 1) AS p, count(*) FILTER (is_heading = 0) AS n FROM b GROUP BY v"),
    ("cum", "SELECT v, p, n, sum(n) OVER (ORDER BY v) - n AS below, sum(p) OVER (ORDER BY v DESC) AS pu, sum(n) OVER (ORDER BY v DESC) AS nu, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM cs"),
)
REPORTS = (
    *ENHANCED,
    ("each", "SELECT doc_id, filter_decision, count(*) AS blocks FROM dec GROUP BY ALL"),
    ("rate", "SELECT doc_id, coalesce(100.0::DOUBLE * (sum(is_heading_pred) - count(*) FILTER (starts_with(filter_decision, 'keep'))) / nullif(sum(is_heading_pred), 0), 0) AS reduction_rate FROM dec GROUP BY doc_id"),
    ("rep", "SELECT doc_id, filter_decision, blocks, reduction_rate FROM each JOIN rate USING (doc_id) UNION ALL SELECT -doc_id, 'filtered_low_score', blocks, reduction_rate FROM each JOIN rate USING (doc_id)"),
)
_ADVICE = names_joined("; ", ("r > 50", q("High false positive rate detected - consider stricter training criteria")), ("k > 100", q("Many predictions filtered due to low scores - improve feature engineering")))
_DECIDED_11 = "CASE WHEN block_id % 11 = 0 THEN 'filtered_low_score' ELSE filter_decision END"

def context(source: str) -> tuple[tuple[str, str], ...]:
    """Two blocks before and after, as lists."""
    return (
        ("docs", f"SELECT doc_id, list({{'f': font_size, 'h': is_heading_pred}} ORDER BY page, block_id) AS xs FROM {source} GROUP BY doc_id"),
        ("tops", f"SELECT doc_id, page, max(line_position_on_page) AS most FROM {source} GROUP BY ALL"),
        ("c1", f"SELECT s.*, most, list_concat(xs[greatest(1, block_id - 1):block_id], xs[block_id + 2:block_id + 3]) AS around FROM {source} AS s JOIN docs USING (doc_id) JOIN tops ON tops.doc_id = s.doc_id AND tops.page = s.page"),
        ("c2", "SELECT *, list_avg(list_transform(around, lambda z: z.f)) AS mean, list_avg(list_transform(around, lambda z: z.h)) AS dense FROM c1"),
        (
            "con",
            """SELECT *, CASE WHEN font_size > mean * 1.2 THEN 'larger' WHEN font_size < mean * 0.8 THEN 'smaller' ELSE 'normal' END AS font_size_context,
  CASE WHEN line_position_on_page <= 3 THEN 'top' WHEN line_position_on_page >= most - 3 THEN 'bottom' ELSE 'middle' END AS position_context, coalesce(dense, 0) AS heading_density FROM c2""",
        ),
    )


_SCORE = [
    ("rule_reject", -0.2, "'rule_reject_' || replace(rule_reasons, ';', '; rule_reject_')"),
    ("c >= 0.8", 0.4, "'high_confidence_' || format('{:.3f}', c)"), ("c >= 0.5 AND c < 0.8", 0.2, "'medium_confidence_' || format('{:.3f}', c)"), ("c >= 0.3 AND c < 0.5", 0.0, "'low_confidence_' || format('{:.3f}', c)"), ("c < 0.3", -0.05, "'very_low_confidence_' || format('{:.3f}', c)"),
    ("excluded", -0.2, "'excluded_' || exclusion_reason"), ("positive IS NOT NULL", 0.5, "'positive_' || positive"),
    ("n <= 1 AND length(t) < 5", -0.2, "'very_short'"), ("n > 30", -0.3, "'too_long'"), ("n > 20 AND n <= 30", -0.1, "'moderately_long'"), ("n BETWEEN 2 AND 15", 0.15, "'good_length'"),
    ("font_size >= fq[4]", 0.4, "'very_large_font'"), ("font_size >= fq[3] AND font_size < fq[4]", 0.3, "'large_font'"), ("font_size >= fq[2] AND font_size < fq[3]", 0.2, "'above_avg_font'"), ("font_size >= fq[1] AND font_size < fq[2]", 0.1, "'normal_font'"),
    ("font_size_context = 'larger'", 0.15, "'larger_than_context'"), ("font_size_context = 'smaller'", -0.15, "'smaller_than_context'"), ("position_context = 'top'", 0.2, "'top_position'"), ("position_context = 'bottom'", -0.15, "'bottom_position'"),
    ("heading_density > 0.5", -0.2, "'high_heading_density'"), ("heading_density = 0", 0.1, "'isolated_heading'"), (f"{is_upper('t')} AND length(t) > 50", -0.3, "'long_all_caps'"), ("right(t, 1) = '.' AND n > 10", -0.4, "'long_sentence'"),
    ("bold", 0.15, "'bold_text'"), ("italic", 0.1, "'italic_text'"), ("line_position_on_page <= 2", 0.2, "'page_top'"), ("line_position_on_page > 2 AND line_position_on_page <= 5", 0.1, "'near_top'"),
]

A_OCR = query(
    "star AS ({}),\nb AS (SELECT doc_id, block_id, page, text, x0, y0, 8 * (font_size - 6) / 3 AS h, block_id % 100 AS c FROM star WHERE block_id % 100 > 30)".format(blocks.star(SqlTables()).sql()),
    """SELECT doc_id, block_id, page, x AS text, round(x0 / 2, 6) AS x0, round(y0 / 2, 6) AS y0, round((x0 + 60) / 2, 6) AS x1, round((y0 + h) / 2, 6) AS y1, round(z, 6) AS font_size,
  CASE WHEN z > 12 THEN 5 - len(list_filter([12, 14, 16, 20], lambda s: z > s)) ELSE 0 END AS heading_level, 'ocr' AS extraction_method, c::INT AS ocr_confidence
FROM (SELECT *, greatest(8, h / 2 * 0.75)::DOUBLE AS z FROM val) WHERE valid_text""",
    *VALID,
)

_POINTS = " + ".join(f"({p})::DOUBLE * coalesce({c}, FALSE)::INT" for c, p, _ in _SCORE)
G_SCORE = query(
    "star",
    "SELECT doc_id, block_id, round(filter_score, 6) AS filter_score, filter_reasons FROM sco",
    *RULES, *_exclusion("rules"),
    ("quarters", "SELECT doc_id, quantile_cont(font_size, [0.5, 0.9, 0.95, 0.98]) AS fq FROM b GROUP BY doc_id"),
    ("judged", "SELECT * REPLACE (CAST(block_id % 40 AS DOUBLE) AS line_position_on_page), coalesce(heading_confidence, 0.8) AS c FROM exc JOIN quarters USING (doc_id)"),
    *context("judged"),
    ("sco", f"SELECT *, 0.5::DOUBLE + {_POINTS} AS filter_score, {names_joined('; ', *((c, n) for c, _, n in _SCORE))} AS filter_reasons FROM con"),
)

SQL: dict[str, str] = {
    "c_valid_text": query("lines", "SELECT doc_id, block_id, valid_text FROM val", *VALID),
    "c_valid_text_star": query("star", "SELECT doc_id, block_id, valid_text FROM val", *VALID),
    "d_numbering": query("star", "SELECT doc_id, block_id, text, numbered, number_type, number_level FROM num", *NUMBERED),
    "d_sequence": query("star", "SELECT doc_id, n AS numbered_blocks, proper AS has_proper_hierarchy, coalesce(counts, TRUE) AS has_sequential_numbering, proper AND coalesce(counts, TRUE) AS is_consistent FROM o1 LEFT JOIN o4 USING (doc_id)", *SEQUENCE),
    "e_positive": query("star", "SELECT doc_id, block_id, coalesce(positive, '') AS positive FROM pos", *POSITIVE),
    "e_rule_filter": query("star", "SELECT doc_id, block_id, text, rule_reject, rule_reasons FROM rules", *RULES),
    "e_exclusion": query("star", "SELECT doc_id, block_id, excluded, exclusion_reason FROM exc", *POSITIVE, *_exclusion("pos", [("named_people", r"^(blue|red)\s+bolt$")])),
    "e_exclusion_lines": query("lines", "SELECT doc_id, block_id, rule_reject, rule_reasons, excluded, exclusion_reason FROM exc", *RULES, *_exclusion("rules")),
    "f_fonts": query("star", f"SELECT doc_id, block_id, font_category, font_size_jump, {_r('font_size_mean', 'font_size_std', 'font_size_percentile_rank', 'font_size_relative')} FROM fon", *fonts("b")),
    "f_typography": query("star", "SELECT doc_id, block_id, typography_score, typography_patterns FROM typ", *TYPOGRAPHY),
    "f_linguistics": query("star", "SELECT doc_id, block_id, linguistic_score, syntax_violations, linguistic_patterns FROM lin", *linguistics("b")),
    "f_linguistics_lines": query("lines", "SELECT doc_id, block_id, linguistic_score, syntax_violations, linguistic_patterns FROM lin", *linguistics("b")),
    "f_position": query("star", "SELECT doc_id, block_id, position_score, position_patterns FROM pst", _UNSCALED, *positions("b_")),
    "f_semantics": query("star", "SELECT doc_id, block_id, semantic_score, content_type, semantic_patterns FROM sem", *semantics("b")),
    "f_structure": query("star", "SELECT doc_id, block_id, hierarchy_level, section_boundary, structure_score, structure_patterns FROM str", _UNSCALED, *fonts("b_"), *positions("fon"), *structure("pst")),
    "f_likelihood": query("star", "SELECT doc_id, block_id, round(heading_likelihood, 6) AS heading_likelihood, recommended_level, level_confidence FROM lev", _UNSCALED, *likelihood("b_")),
    "g_context": query("star", "SELECT doc_id, block_id, font_size_context, position_context, round(heading_density, 6) AS heading_density FROM con", _UNSCALED, *context("b_")),
    "g_score": G_SCORE,
    "g_enhanced_score": query("star", "SELECT doc_id, block_id, round(filter_score, 6) AS filter_score, hard_filter FROM enh", _UNSCALED, *enhanced("b_")),
    "g_enhanced_reasons": query("star", "SELECT doc_id, block_id, filter_reasons FROM enh", *ENHANCED),
    "g_decision": query("star", "SELECT doc_id, block_id, filter_decision, is_heading_pred AS original_prediction, starts_with(filter_decision, 'keep')::INT AS is_heading_pred, CASE WHEN starts_with(filter_decision, 'keep') THEN recommended_level WHEN starts_with(filter_decision, 'filtered') THEN 'H3' ELSE '' END AS final_heading_level FROM dec", *ENHANCED),
    "h_prefix_merge": H_PREFIX,
    "h_title": H_TITLE,
    "h_combine_tokens": H_TOKENS,
    "i_split": i_split("star", False),
    "i_split_lines": i_split("lines", True),
    "j_rule_heading": query("star", "SELECT doc_id, block_id, heading, heading_reason, coalesce(level, '') AS level FROM jud", *rule_headings()),
    "j_rule_heading_pages": query(PAGE, "SELECT doc_id, block_id, tag, text, heading, heading_reason, coalesce(level, '') AS level FROM jud", *rule_headings()),
    "k_outline": query(PAGE, "SELECT * FROM ent", *OUTLINE),
    "k_titles": query(PAGE, "SELECT doc_id, CASE WHEN length(shown) > 5 THEN shown ELSE coalesce(h1, doc_id::VARCHAR) END AS title FROM (SELECT DISTINCT doc_id FROM b) LEFT JOIN w2 USING (doc_id) LEFT JOIN w3 USING (doc_id)", *TITLES),
    "l_text": L_TEXT,
    "l_font": L_FONT,
    "l_box": L_BOX,
    "l_pos": L_POS,
    "l_tfidf": L_TFIDF,
    "n_threshold_recall": query("star", "SELECT h AS threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, round(0.4 * f + 0.6 * r, 6) AS goal FROM fs ORDER BY 0.4 * f + 0.6 * r DESC, h LIMIT 1", *SWEEP),
    "n_auc": query("star", "SELECT round(sum(p * (below + n / 2.0))::DOUBLE / any_value(ap * an), 6) AS auc, round(max(pu / ap::DOUBLE - nu / an::DOUBLE), 6) AS youden_index, arg_max(v, (round(pu / ap::DOUBLE - nu / an::DOUBLE, 9), -v)) AS youden_threshold FROM cum", *AUC),
    "o_feedback": query("star", f"SELECT n AS reports, round(r, 6) AS average_reduction_rate, {_ADVICE} AS recommendations FROM (SELECT count(*) AS n, avg(one) AS r, sum(low) AS k FROM (SELECT doc_id, max(reduction_rate) AS one, sum(blocks) FILTER (filter_decision = 'filtered_low_score') AS low FROM rep GROUP BY doc_id))", *REPORTS),
    "o_feedback_reasons": query("star", "SELECT filter_decision AS reason, CASE WHEN contains(filter_decision, 'filtered') THEN 'exclusion' ELSE 'preservation' END AS kind, sum(blocks)::BIGINT AS blocks FROM rep WHERE contains(filter_decision, 'filtered') OR contains(filter_decision, 'keep') GROUP BY ALL", *REPORTS),
    "o_training_rows": query(
        "star",
        f"""SELECT doc_id, block_id, is_heading, 'original_labels' AS data_source FROM b WHERE italic UNION ALL SELECT doc_id, block_id, is_heading, 'reviewed_corrections' FROM b WHERE heading_level = 2
UNION ALL SELECT doc_id, block_id, 1, 'high_conf_preserved' FROM dec WHERE {_DECIDED_11} = 'keep_high_confidence' AND heading_confidence >= 0.9
UNION ALL SELECT doc_id, block_id, 0, 'high_conf_filtered' FROM dec WHERE block_id % 11 = 0 AND heading_confidence <= 0.6""",
        *ENHANCED,
    ),
    "a_ocr_lines": A_OCR,
    "k_named_titles": query(
        PAGE.replace(" FROM g4)", " FROM g4 WHERE lower(p[1]) NOT IN ('title', 'h1'))"),
        """SELECT doc_id, CASE WHEN length(shown) > 5 THEN shown ELSE coalesce(h1, array_to_string(list_transform(string_split(format('annual report of {}', doc_id), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')) END AS title
FROM (SELECT DISTINCT doc_id FROM b) LEFT JOIN w2 USING (doc_id) LEFT JOIN w3 USING (doc_id)""",
        *TITLES,
    ),
    "a_token_rows": query(
        "star",
        """SELECT format('/in/{}/{}_{}.txt', doc_id, block_id, page - 1) AS path, text, CASE WHEN bold THEN 'title' ELSE 'paragraph' END AS label, page, trunc(x0) AS x0, trunc(y0) AS y0, trunc(x1) AS x1, trunc(y1) AS y1
FROM b WHERE block_id % 7 <> 0 AND block_id % 3 <> 0""",
    ),
}
