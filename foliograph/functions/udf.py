"""What no built-in function does: Unicode normalisation, and a tagger where one is at hand."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = ["NOUN", "VERB", "ADJ", "ADV", "PROPN", "PRON"]
COUNTS = ["num_nouns", "num_verbs", "num_adjs", "num_advs", "num_propn", "num_pronouns", "num_other_pos"]


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC normalisation; null stays null."""
    return texts.str.normalize("NFKC")


FAVOURABLE, NEUTRAL, UNFAVOURABLE = ("NOUN", "PROPN", "ADJ"), ("NUM", "X"), ("VERB", "ADP", "CONJ", "PRON", "DET", "PART")


def heading_tags(tagger: Callable[[str], list[tuple[str, str]]]):
    """A function of a text column: a struct of what metadata.tagged() needs, by a tagger from text to (tag, dependency)."""
    kind = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("tags", "tags_favourable", "tags_neutral", "tags_unfavourable")), *(T.StructField(c, T.BooleanType()) for c in ("has_subject", "has_verb"))])

    @F.pandas_udf(kind)
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = tagger(text) if text and text.strip() else []
            tags = [t for t, _ in found]
            rows.append([len(tags), *(sum(t in group for t in tags) for group in (FAVOURABLE, NEUTRAL, UNFAVOURABLE)), any(x in ("nsubj", "nsubjpass") for _, x in found), "VERB" in tags])
        return pd.DataFrame(rows, columns=kind.names)

    return count


def tag_counts(tagger: Callable[[str], list[str]] | None = None, english_only: bool = False):
    """A function of a text column: counts of parts of speech by a tagger from text to tags; all 0 without one.

    ``english_only``: texts with characters beyond ASCII are not tagged.
    """
    kind = T.StructType([T.StructField(c, T.IntegerType()) for c in COUNTS])

    @F.pandas_udf(kind)
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            tags = tagger(text or "") if tagger and (not english_only or (text or "").isascii()) else []
            known = [tags.count(t) for t in TAGS]
            rows.append([*known, len(tags) - sum(known)])
        return pd.DataFrame(rows, columns=COUNTS)

    return count
