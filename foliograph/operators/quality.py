"""Text-quality predicates: what is too garbled, too long or too much like a sentence to be a heading."""

from __future__ import annotations

from ..functions import patterns as P
from ..functions.patterns import portable
from ..plans import Relation

CONTROL = r"[\x{0}-\x{1F}\x{7F}-\x{9F}]"


def strip_control(r: Relation) -> Relation:
    """Texts without control characters other than tabs and line feeds."""
    return r.add(text=r.d.replace("coalesce(text, '')", r"[\x{0}-\x{8}\x{B}-\x{1F}\x{7F}-\x{9F}]"))


def valid_text(r: Relation) -> Relation:
    """Add valid_text: whether a text is fit to be a heading at all."""
    d = r.d
    r = r.add(__x="coalesce(text, '')")
    r = r.add(__clean=d.strip(d.replace("__x", CONTROL)))
    alnum = d.count("__clean", r"[\p{L}\p{N}]")
    numeric = d.rx("__x", r"^[\p{Nd}" + portable(r"[\s]")[1:-1] + r"\x{1}/\-.,;:!?()]+$")
    symbols = d.rx("__x", portable(r"^[^\w\s]*$"))
    corrupt = d.any_rx("__x", map(portable, P.CORRUPT))
    garbage = d.any_rx("__x", map(portable, P.GARBAGE))
    real = d.rx("__clean", portable(r"(^|\s)(\S+[a-zA-Z]\S*|\S*[a-zA-Z]\S+)($|\s)"))
    tests = [
        f"length({d.strip('__x')}) < 2 OR length(__clean) < 2",
        f"CAST(length(__x) - length(__clean) AS DOUBLE) / length(__x) > {d.num(0.3)}",
        f"CAST({alnum} AS DOUBLE) / length(__clean) < {d.num(0.3)}",
        numeric, symbols,
        f"{d.count('__x', r'[#@$%^&*!?()]')} > length(__x) * {d.num(0.4)}",
        f"{d.has('__x', '%')} AND length(__x) > 20 OR {d.count('__x', '[?]')} > 1 OR {d.has_any('__x', P.CORRUPT_PARTS)} OR {d.has('__x', 'bY')} AND length(__x) > 15 OR {d.has('__x', 'Wg')} AND length(__x) > 10 OR {corrupt}",
        f"{d.words('__clean')} <= 2 AND NOT {real}",
        garbage,
    ]
    return r.add(valid_text=d.cases(*((t, "FALSE") for t in tests), otherwise="TRUE")).drop("__x", "__clean")


def mojibake(r: Relation) -> Relation:
    """Add mojibake: suspicious characters, or over 30 % beyond ASCII."""
    d = r.d
    beyond = d.count("coalesce(text, '')", r"[^\x{0}-\x{7F}]")
    return r.add(mojibake=f"({d.rx('coalesce(text, %s)' % d.string(''), '[' + P.MOJIBAKE + ']')} OR coalesce({d.ratio(beyond, 'length(text)')}, 0) > {d.num(0.3)})")


def false_positive(r: Relation) -> Relation:
    """Add false_positive: lone words that end a sentence, very short or long texts, mere punctuation or digits."""
    d = r.d
    r = r.add(__t=d.strip("coalesce(text, '')"))
    marks = d.count("__t", r"[.,;:!?\-—()\[\]{}" + "\"'" + r"/\\]")
    test = f"{d.words('__t')} = 1 AND {d.rx('__t', '[.,:;]$')} OR length(__t) < 3 OR {marks} > length(__t) * {d.num(0.5)} OR {d.rx('__t', r'^\p{Nd}+$')} OR length(__t) > 200"
    return r.add(false_positive=f"({test})").drop("__t")


def plain_heading(r: Relation) -> Relation:
    """Add plain_heading: shorter than 100 characters and without a full stop at the end."""
    return r.add(plain_heading="(length(coalesce(text, '')) < 100 AND coalesce(text, '') NOT LIKE '%.')")


def keyword(r: Relation) -> Relation:
    """Add contains_keyword: 1 if a heading keyword occurs anywhere."""
    return r.add(contains_keyword=f"CASE WHEN {r.d.has_any('lower(coalesce(text, %s))' % r.d.string(''), P.FEATURE_KEYWORDS)} THEN 1 ELSE 0 END")


def unwanted_title(r: Relation, personal: list[str] = ()) -> Relation:
    """Add unwanted_title: texts that are no document title. Personal data is the caller's to name."""
    d = r.d
    own = f" OR {d.any_rx('coalesce(text, %s)' % d.string(''), map(portable, personal), 'i')}" if personal else ""
    return r.add(unwanted_title=f"({d.any_rx('lower(coalesce(text, %s))' % d.string(''), map(portable, P.UNWANTED_TITLES))}{own})")
