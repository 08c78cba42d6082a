"""Numbering and rules: worked examples, and chains written out in Python."""

import re

import pytest

from foliograph.functions import patterns as P
from foliograph.operators import numbering, rules
from foliograph.plans import SparkRelation

NUMBERED = {
    "1. Introduction": ("decimal", 1), "1.1 Overview": ("decimal", 2), "1.1": ("decimal", 1), "1.1.1.1 Details": ("decimal", 4), "I. Introduction": ("roman", 1), "C. Continuous parts": ("roman", 1),
    "D. Deployment": ("roman", 1), "A. First": ("alphabetical", 1), "E. Fifth": ("alphabetical", 1), "A.1 Sub": ("mixed", 2), "C.1 Sub": ("mixed", 2), "I.I Overview": None, "Problem Analysis": None,
    "A Full-Stack View": ("alphabetical", 1), "XYZ. Not Roman": None, "123.456.789.012.345.678": ("decimal", 6), "2024 annual report": ("decimal", 1), "0": None, "0.1 Zero": None, "IV": ("roman", 1), "IIII": None,
    "II.III": None, "1.A": ("mixed", 2), "B": ("alphabetical", 1), "b. small": None, "MIX Of Things": ("roman", 1), "": None, "  2.  Spaced  ": ("decimal", 1), "A.1.b": None, "7.": ("decimal", 1), "x": ("roman", 1),
}


def relation(spark, texts):
    return SparkRelation(spark.createDataFrame([(t,) for t in texts], "text string"))


def test_numbering(spark):
    for r in numbering.numbering(relation(spark, NUMBERED)).df.collect():
        assert ((r.number_type, r.number_level) if r.numbered else None) == NUMBERED[r.text], r.text


def roman(n):
    out = ""
    for value, name in numbering.ROMAN_STEPS:
        out += name * (n // value)
        n %= value
    return out


def test_roman(spark):
    r = SparkRelation(spark.range(1, 4000).selectExpr("cast(id as int) as n")).add(roman=numbering.to_roman("n"))
    rows = r.add(value=numbering.roman_value("roman"), valid=numbering.valid_roman(r.d, "lower(roman)")).df.collect()
    assert all(x.roman == roman(x.n) and x.value == x.n and x.valid for x in rows)
    bad = relation(spark, ["", "IIX", "VV", "IC", "ABC", "IXX", "MMMM"])
    assert not any(x.v for x in bad.pick(v=numbering.valid_roman(bad.d, "text")).df.collect())


CASES = [
    "&start", "_x", ".hidden", "$ 12", "$12 fund", "ab", "IV", "a", "A", "12", "the", "Between", "lower start", "iPhone", "1. Scope", "Chapter 2", "Design", "Scalability", "XII.", "A.1.2", "Plain words here",
    "This sentence has quite a few words in it and it goes on until more than fifteen of them are there.", "word " * 25, "Word " * 40, "Registration : 12", "dockerfile", "Dockerfile", "", "XYZ. Not", "Some Thing",
    "References [1]", "see (2020)", "See www.here.com now", "I am", "etc", "$", "Student list of the year", "Powered by steam", "The machine", "John Smith", "AI", "AI Methods of old", "In summary", "A",
]


def python_rules(text, numbered, positive):
    """(reject, reasons) as the chain of rules gives them."""
    t = text.strip()
    low, n = t.lower(), len(t.split())
    if t and t[0] in "&_,.\\%*!~":
        return True, "starts_with_bad_special_char"
    if len(t) > 1 and t[0] == "$" and not t[1].isalnum():
        return True, "dollar_not_followed_by_alphanumeric"
    if len(t) <= 3 and not (re.match("^[IVX]+$", t, re.I) or re.match("^[A-Z]$", t) or re.match(r"^\d+$", t) or low == "a"):
        return True, "too_short_less_than_4_chars"
    if n == 1 and low in P.FUNCTION_WORDS and not re.match("^([IVXivx]|[A-Z])$", t):
        return True, "single_word_function_word"
    if t and t[0].islower() and t not in P.LOWERCASE_NAMES:
        return True, "starts_with_lowercase"
    if numbered:
        return False, "preserved_hierarchical_" + numbered
    if positive:
        return False, "preserved_positive_pattern_" + positive
    if n == 1 and low in P.SINGLE_HEADINGS + P.MORE_SINGLE_HEADINGS and t[0].isupper():
        return False, "preserved_single_word_heading"
    if re.match(r"^[IVX]+\.?\s*$", t, re.I) and t.isupper():
        return False, "preserved_roman_numeral"
    if re.match(r"^\d+(\.\d+)*\.?$", t) or re.match(r"^[A-Z](\.\d+)*\.?$", t):
        return False, "preserved_numbered_heading"
    soft = [("long_sentence_with_period", t.endswith(".") and n > 15), ("too_many_words", n > 20), ("too_many_characters", len(t) > 150), ("clear_identity_pattern", any(k in low for k in P.IDENTITY)), ("obvious_false_positive", low in P.OBVIOUS)]
    reasons = [k for k, c in soft if c]
    return len(reasons) >= 2 or "obvious_false_positive" in reasons, ";".join(reasons)


def python_exclusion(text, positive, personal):
    t = text.strip()
    low = t.lower()
    if positive:
        return False, "positive_override_" + positive
    for name, p, f in [("protected_roman_numeral", r"^[IVX]+\.?\s*$", re.I), ("protected_roman_numeral", r"^[IVX]+\.\s+[A-Z].*$", re.I), ("protected_numbered_heading", r"^\d+(?:\.\d+)*\.?\s*(?:[A-Z].*)?$", 0), ("protected_letter_heading", r"^[A-Z]\.?\s*(?:[A-Z].*)?$", 0)]:
        if re.match(p, t, f):
            return False, name
    if low in P.SINGLE_HEADINGS and t[0].isupper():
        return False, "legitimate_single_word"
    if t and t[0] in "&_,.\\%*!~":
        return True, "starts_with_bad_special_char"
    if t.startswith("$") and (len(t) == 1 or not t[1].isalnum()):
        return True, "dollar_not_followed_by_alphanumeric"
    if len(t) <= 3 and not (re.match("^[IVX]+$", t, re.I) or re.match("^[A-Z]$", t) or re.match(r"^\d+$", t)):
        return True, "too_short_less_than_4_chars"
    if t and t[0].islower() and low != "etc":
        return True, "starts_with_lowercase"
    if len(t.split()) == 1 and low in P.EXCLUDED_WORDS:
        return True, "single_word_function_word"
    for name, p, f in [*P.EXCLUSIONS, *((n, p, "i") for n, p in personal)]:
        if re.search(p, t, re.I if f else 0):
            return True, name
    return False, ""


def test_chains(spark):
    personal = [("somebody", r"plain\s+words")]
    rows = rules.exclusion(rules.rule_filter(relation(spark, CASES)), personal).df.collect()
    kinds = set()
    for r in rows:
        numbered = f"{r.number_type}_level_{r.number_level}" if r.numbered else ""
        want = f"hierarchical_{numbered}" if numbered else next((n for n, p, f in P.POSITIVES if re.search(p, r.text.strip(), re.I if f else 0)), None)
        assert r.positive == want, r.text
        assert (r.rule_reject, r.rule_reasons) == python_rules(r.text, numbered, want), r.text
        assert (r.excluded, r.exclusion_reason) == python_exclusion(r.text, want, personal), r.text
        kinds |= {r.rule_reject, r.excluded}
    assert kinds == {True, False} and any(r.exclusion_reason == "somebody" for r in rows)


@pytest.mark.parametrize("texts,proper,sequential", [
    (["1. A", "2. B", "3. C"], True, True), (["1.1 A", "1.2 B"], False, False), (["1. A", "1.1 B"], True, False), (["5. A", "6. B", "8. C", "7. D"], True, False), (["Words"], True, True), (["I. A", "II. B"], True, True),
])
def test_sequences(spark, texts, proper, sequential):
    from foliograph import api

    df = spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(texts)], "doc_id long, block_id long, page int, text string")
    r = api.check_sequences(df).first()
    assert (r.has_proper_hierarchy, r.has_sequential_numbering, r.is_consistent) == (proper, sequential, proper and sequential)


def test_long_words_take_time_in_proportion(spark):
    """A word of 300,000 characters: the rule of addresses once looked through the rest of it from each of them."""
    import time

    texts = ["a" * 300000, "a" * 300000 + " @ b", "a" * 300000 + "@b.c", "see a@b.c", "@b.c", "a@b. c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    start = time.time()
    pattern, flags = next((p, f) for n, p, f in P.EXCLUSIONS if n == "emails")
    d = SparkRelation(df).d
    found = df.selectExpr("i", d.rx("text", P.portable(pattern), flags) + " AS found").orderBy("i").collect()
    assert [r.found for r in found] == [False, False, True, True, False, False]
    assert time.time() - start < 30


def test_sooner_patterns_find_the_same(spark):
    """What Java's engine is given in place of a rule's pattern finds the same texts as the pattern itself."""
    from foliograph.functions.dialect import SPARK, WS

    texts = ["HTTPS://x", "wWw.x", "x.COM", "(2020)", "x1999a", "1999_", "12/1/20", "x12/1/20", "C:\\x", "/a", "/", "\u017ftudent", "un\u0131versity", "v1.2", "version 3", "version", "v1.", "AB12", "12ABc", "employs x", "employs ", "updates  ", "X.js", "a web", "WEB", "b.tech - x", "INTRO", "TRADE-OFF", "FAQS", "ROI", "A\u00c9", "the application is"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    table = {P.portable(p): f for _, p, f in P.EXCLUSIONS} | {P.KNOWN_HEADINGS: ""}
    plain = lambda p: f"text RLIKE {SPARK.string(('(?iud)' if table[p] else '(?d)') + p)}"
    assert df.where(" OR ".join(f"({SPARK.rx('text', p, table[p])}) <> ({plain(p)})" for p in SPARK.quick)).count() == 0
    spaced = spark.createDataFrame([(t,) for t in ["", " ", "\u0085a  b\u2028", "\x1ca\x1fb\x1c", "\u200bx", "\u3000x y\u00a0z"]], "text string")
    strip, words = SPARK.strip("text"), SPARK.words("text")
    assert [tuple(r) for r in spaced.selectExpr("text", strip, words).collect()] == [(r.text, r.text.strip(), len(r.text.split())) for r in spaced.collect()]
    assert WS not in strip + words


def test_decided_blocks_are_made_once(spark):
    """Reports and training rows read the line items once for the decided blocks, not once for each use of them."""
    from foliograph import queries

    found = queries.spark_queries()
    for name, reads in (("o_feedback", 1), ("o_feedback_reasons", 1), ("o_training_rows", 3)):
        plan = found[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [l_orderkey") == reads, name


def test_safe_texts_are_not_looked_at_further(spark):
    plan = rules.exclusion(relation(spark, ["1. One"])).df._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnull(__safe" in plan


def test_rows_stay_where_they_are_if_their_distinct_texts_are_few(spark, monkeypatch):
    """The rules' columns come to the rows of a document, which are not sent to the texts and back; many or long texts go by a join."""
    from foliograph import queries
    from foliograph.plans import relation as plans

    found, plans_of = {}, lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name, few, short in (("few", plans.FEW, plans.SHORT), ("many", 50, plans.SHORT), ("long", plans.FEW, 10)):
        monkeypatch.setattr(plans, "FEW", few)
        monkeypatch.setattr(plans, "SHORT", short)
        found[name] = queries.spark_queries()["g_score"](spark, "/root/testdata/sf0.001")
        plan = plans_of(found[name])
        assert (plan.count("hashpartitioning(doc_id") == 1 and "coalesce(text" in plan.split("BroadcastHashJoin")[1]) if name == "few" else "LocalTableScan" not in plan, name
    assert all(found["few"].exceptAll(found[k]).isEmpty() and found[k].exceptAll(found["few"]).isEmpty() for k in ("many", "long"))


def test_rules_take_each_distinct_text_once(spark):
    """Columns made of text alone come of the distinct texts, with the values that the rules give row by row."""
    from foliograph.operators import classify, filtering, metadata
    from foliograph.plans import Relation

    texts = [*NUMBERED, None, None, "Introduction", "Introduction", "the end.", "$ 12"]
    df = spark.createDataFrame([(i % 2, i, t, 10.0 + i % 9, i % 3 == 0, 1, 1, 0.4, i / 40) for i, t in enumerate(texts)], "doc_id long, block_id long, text string, font_size double, bold boolean, page int, is_heading_pred int, heading_confidence double, line_position_on_page double")
    r = SparkRelation(df)
    steps = (numbering.numbering, rules.positive, rules.exclusion, metadata.linguistics)
    found, plain = r.by_text(*steps).df, Relation.by_text(r, *steps).df
    assert set(found.columns) == set(plain.columns)
    assert found.count() == len(texts) and found.select(plain.columns).exceptAll(plain).isEmpty()
    again = SparkRelation(plain).by_text(rules.rule_filter, rules.exclusion).df
    assert again.count() == len(texts) and again.columns.count("positive") == 1
    for step in (classify.rule_headings, filtering.score, filtering.enhanced_score):
        plan = step(r).df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftOuter" in plan and "Aggregate [text" in plan, step
