"""Expressions against Python's own string methods and regular expressions."""

import re

import pytest

from foliograph.functions import patterns as P
from foliograph.functions.dialect import SPARK as d
from foliograph.functions.patterns import portable
from foliograph.operators import quality
from foliograph.plans import SparkRelation

TEXTS = [
    "", " ", "a", "A", "Title Case", "It's A Test", "A-B Cd", "123", "ABC", "ABC 12", "abc Def", "É É", "Été Là", "x\n", "\tx y\u00a0z ", "one two  three", "\u3000wide\u3000", "\x1cfs\x1c", "٣ ٤",
    "1. Introduction", "1.1 Overview", "IV. Results", "A. Scope", "A.1 Detail", "Chapter 3 The end", "CHAPTER 3", "SECTION 12: More", "appendix b", "Introduction", "the end", "and", "mix of things",
    "see http://x.org/a?b=c", "me@here.org", "C:\\dir\\file", "12/03/2024", "2024-01-02", "Page 12", "• item", "- item", "* item", "3) small", "1. small", "[12] ref", "in (2019) a", "$ 12", "$12", "&x", "_x",
    "node.js", "api", "API", "Docker-based", "localhost:80", "word,", "word word,", "word and word of", "v1.2 of", "AB12", "12AB", "Some Title Here Now", "John Smith", "university of", "Name: x", "b.tech - x",
    "Whatever is the meaning of this very long line that goes on and on, and never ends?", "A sentence that is long enough to be matched by the rule for sentence endings, really.", "x" * 160,
    "###", "??", "a?b?c", "9ZeXX CXag%TfT", "%%%", "AbCdEfG", "HELLOworldHELLO", "(a) Some", "a) Some", "a. Some", "1.2.3 Deep", "1.2.3", "Overview:", "REGISTRATION : 12", "iPhone", "etc", "I", "i", "ivx", "Xiv. hello",
]


@pytest.fixture(scope="module")
def texts(spark):
    return SparkRelation(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string"))


def test_string_methods(texts):
    rows = texts.pick("i", u=d.upper("text"), t=d.title("text"), w=d.words("text"), s=d.strip("text"), lo=d.lower_first("text"), up=d.upper_first("text")).df.collect()
    for r in rows:
        x = TEXTS[r.i]
        assert (r.u, r.t, r.w, r.s) == (x.isupper(), x.istitle(), len(x.split()), x.strip()), x
        assert (r.lo, r.up) == (x[:1].islower(), x[:1].isupper()), x


def test_patterns_match_as_in_python(texts):
    tables = {f"{k}_{n}": (p, f) for k, t in (("x", P.EXCLUSIONS), ("p", P.POSITIVES), ("m", P.PREFIXES), ("n", P.NUMBERINGS)) for n, p, f in t}
    for k, groups in (("t", P.TYPOGRAPHY), ("a", P.ANTI_HEADINGS), ("l", P.LEVEL_BY_TEXT), ("g", {"": P.GARBAGE, "c": P.CORRUPT, "q": P.TECHNICAL})):
        tables |= {f"{k}_{g}_{i}": (p, "") for g, ps in groups.items() for i, p in enumerate(ps)}
    r = texts.pick("i", **{f"`{k}`": d.rx(d.strip("text"), portable(p), f) for k, (p, f) in tables.items()})
    wrong = [(k, TEXTS[row["i"]]) for row in r.df.collect() for k, (p, f) in tables.items() if row[f"`{k}`"] != bool(re.search(p, TEXTS[row["i"]].strip(), re.I if f else 0))]
    assert not wrong


def python_valid(text):
    """The checks in the order they are made, in plain Python."""
    clean = re.sub("[\x00-\x1f\x7f-\x9f]", "", text).strip()
    if len(text.strip()) < 2 or len(clean) < 2 or (len(text) - len(clean)) / len(text) > 0.3:
        return False
    if sum(c.isalnum() for c in clean) / len(clean) < 0.3 or re.match(r"^[\d\s\x01/\-.,;:!?()]+$", text) or re.match(r"^[^\w\s]*$", text):
        return False
    if len(re.findall(r"[#@$%^&*!?()]", text)) > len(text) * 0.4:
        return False
    if "%" in text and len(text) > 20 or text.count("?") > 1 or any(p in text for p in P.CORRUPT_PARTS) or "bY" in text and len(text) > 15 or "Wg" in text and len(text) > 10 or any(re.search(p, text) for p in P.CORRUPT):
        return False
    words = clean.split()
    if len(words) <= 2 and not any(len(w) >= 2 and re.search("[a-zA-Z]", w) for w in words):
        return False
    return not any(re.search(p, text) for p in P.GARBAGE)


def test_valid_text(texts):
    for r in quality.valid_text(texts).df.collect():
        assert r.valid_text == python_valid(r.text), r.text


def test_other_predicates(texts):
    r = quality.unwanted_title(quality.keyword(quality.plain_heading(quality.false_positive(quality.mojibake(texts)))), ["^john"])
    for row in r.df.collect():
        x, t = row.text, row.text.strip()
        assert row.mojibake == (any(c in P.MOJIBAKE for c in x) or bool(x) and sum(ord(c) > 127 for c in x) / len(x) > 0.3), x
        marks = sum(c in ".,;:!?-—()[]{}\"'/\\" for c in t)
        assert row.false_positive == (len(t.split()) == 1 and t.endswith((".", ",", ":", ";")) or len(t) < 3 or marks > len(t) * 0.5 or t.isdigit() or len(t) > 200), x
        assert row.plain_heading == (len(x) < 100 and not x.endswith("."))
        assert row.contains_keyword == int(any(k in x.lower() for k in P.FEATURE_KEYWORDS))
        assert row.unwanted_title == any(re.search(p, x.lower()) for p in [*P.UNWANTED_TITLES, "^john"])


def test_null_text(spark):
    r = SparkRelation(spark.createDataFrame([(None,)], "text string"))
    row = quality.keyword(quality.false_positive(quality.valid_text(r))).df.first()
    assert (row.valid_text, row.false_positive, row.contains_keyword) == (False, True, 0)
