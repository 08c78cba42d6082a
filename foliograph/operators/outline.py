"""Document titles and outlines, flat and nested, and checks of them."""

from __future__ import annotations

from ..plans import Relation, SparkRelation
from .quality import unwanted_title


def _titled(r: Relation, personal: list[str] = ()) -> tuple[Relation, str]:
    """Blocks with what decides the structure title, and the aggregate that makes it: empty where none is fit."""
    d = r.d
    y = "y0, block_id" if r.has("y0") else "block_id"
    r = unwanted_title(r, personal).add(__t=d.strip("coalesce(text, '')"))
    r = r.add(__fit="page = 1 AND length(__t) > 2")
    r = r.add(__i=f"CASE WHEN __fit THEN row_number() OVER (PARTITION BY doc_id, __fit ORDER BY {y}) END")
    r = r.add(__most="max(CASE WHEN __i <= 20 THEN font_size END) OVER (PARTITION BY doc_id)")
    return r, d.strip(d.replace(d.joined("__t", "__i", where=f"__i <= 15 AND font_size >= __most - {d.num(0.5)} AND NOT unwanted_title"), r"[ \t\n\r]+", " "))


def structure_title(r: Relation, personal: list[str] = ()) -> Relation:
    """One row a document: the largest texts at the top of page one, joined; empty where none is fit."""
    r, title = _titled(r, personal)
    return r.group("doc_id", structure_title=title)


def outline_rows(r: Relation, level: str = "level", heading: str = "heading") -> Relation:
    """The headings in order, as outline entries: doc_id, place, level, text, page."""
    return r.where(heading, derived=True).pick("doc_id", place="CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, block_id) AS INT)", level=level, text=r.d.strip("coalesce(text, '')"), page="page")


def titles(r: Relation, names: Relation | None = None) -> Relation:
    """One row a document: its structure title of over five characters, else its first H1 among 100 headings, else a name.

    The blocks are read once: titles and headings are aggregates of one group.
    """
    r, title = _titled(r)
    r = r.add(__place="CASE WHEN heading THEN row_number() OVER (PARTITION BY doc_id, heading ORDER BY page, block_id) END")
    one = "level = 'H1' AND __place <= 100"
    out = r.group("doc_id", structure_title=title, __h1=f"min_by(CASE WHEN {one} THEN __t END, CASE WHEN {one} THEN __place END)")
    other = "CAST(doc_id AS STRING)"
    if names is not None:
        out, other = out.join(names, ["doc_id"], "left"), filename_title(out.d, "name")
    return out.pick("doc_id", title=f"CASE WHEN length(structure_title) > 5 THEN structure_title ELSE coalesce(__h1, {other}) END")


def filename_title(d, name: str) -> str:
    """A file's name as a title: no ending, spaces for underscores and hyphens, words capitalised."""
    return f"initcap(translate({d.replace(name, r'\.[A-Za-z]+$')}, '_-', '  '))"


def metadata_title(d, title: str, name: str, keep_empty: bool = False) -> str:
    """A title from a document's metadata, else its name; ``keep_empty``: an empty title is one."""
    return f"coalesce({title}, {name})" if keep_empty else f"coalesce(nullif({title}, ''), {name})"


def boxed(r: Relation) -> Relation:
    """Headings as outline entries with a box: place, text, level, page and x1, y1, x2, y2 by their defaults where missing."""
    d = r.d
    box = {c: f"coalesce({c}, {d.num(v)})" if r.has(c) else d.num(v) for c, v in (("x1", 0.0), ("y1", 0.0), ("x2", 100.0), ("y2", 20.0))}
    level = "coalesce(CAST(heading_level AS STRING), 'H1')" if r.has("heading_level") else "'H1'"
    return r.where("is_heading = 1").pick("doc_id", place="CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, block_id) AS INT)", text=d.strip("coalesce(text, '')"), level=level, page="coalesce(page, 1)", **box)


def with_first_h1(rows: Relation) -> Relation:
    """Outline entries with h1, the text of the document's first H1 among 100 entries."""
    h1 = "level = 'H1' AND place <= 100"
    return rows.add(h1=f"min_by(CASE WHEN {h1} THEN text END, CASE WHEN {h1} THEN place END) OVER (PARTITION BY doc_id)")


def nested(rows: SparkRelation, blocks: SparkRelation, personal: list[str] = ()) -> SparkRelation:
    """One row a document of ``blocks``: title and outline, an array of level, text and page in order.

    ``rows``: the entries with h1. The title is the structure's if over five characters long, else h1, else the doc_id.
    """
    from pyspark.sql import functions as F

    entry = F.struct("place", "level", "text", "page")
    outline = rows.df.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("o"), F.max("h1").alias("h1"))
    both = structure_title(blocks, personal).df.join(outline, "doc_id", "left")
    empty = F.array().cast("array<struct<level:string,text:string,page:int>>")
    shaped = F.transform("o", lambda x: F.struct(x["level"].alias("level"), x["text"].alias("text"), x["page"].alias("page")))
    title = F.when(F.length("structure_title") > 5, F.col("structure_title")).otherwise(F.coalesce("h1", F.col("doc_id").cast("string")))
    return SparkRelation(both.select("doc_id", title.alias("title"), F.coalesce(shaped, empty).alias("outline")))


def valid_outline(r: SparkRelation, strict: bool = True) -> SparkRelation:
    """Add valid: levels H1 to H3 on pages from 1 (``strict``), or H1 to H4 on pages from 0; texts and title not empty."""
    from pyspark.sql import functions as F

    levels, least = (["H1", "H2", "H3"], 1) if strict else (["H1", "H2", "H3", "H4"], 0)
    good = F.forall("outline", lambda x: x["level"].isin(levels) & (x["page"] >= least) & (F.length(F.trim(x["text"])) > 0))
    return SparkRelation(r.df.withColumn("valid", F.coalesce(F.col("title").isNotNull() & good, F.lit(False))))


def first_heading_title(rows: Relation, d, name: str = "CAST(doc_id AS STRING)") -> Relation:
    """One row a document of outline entries: the text of its first H1, else its name."""
    r = rows.group("doc_id", __h1="min_by(CASE WHEN level = 'H1' THEN text END, CASE WHEN level = 'H1' THEN place END)")
    return r.pick("doc_id", title=f"coalesce(nullif(__h1, ''), {name})")


def predicted_outline(r: Relation, level: str = "predicted_level") -> Relation:
    """Entries of a multi-class prediction: levels over 0 of what is no likely false positive, by page and place."""
    from .quality import false_positive

    y = "y0, block_id" if r.has("y0") else "block_id"
    r = false_positive(r).where(f"{level} > 0 AND NOT false_positive", derived=True)
    return r.pick("doc_id", "block_id", "page", "text", place=f"CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, {y}) AS INT)", level=f"concat('H', CAST({level} AS STRING))")


def entries(outlines: SparkRelation) -> SparkRelation:
    """The entries of nested outlines as rows, each with its title's document and its place, for listing()."""
    rows = outlines.df.selectExpr("doc_id", "posexplode(outline) AS (block_id, e)")
    return SparkRelation(rows.selectExpr("doc_id", "CAST(block_id AS BIGINT) AS block_id", "e.level AS level", "e.text AS text", "e.page AS page"))


def listing(r: Relation, personal: list[str] = (), n: int = 50) -> Relation:
    """For browsing: each document's first numbered entries and those with personal data, as the caller names it."""
    d = r.d
    kind = d.cases((d.any_rx("text", personal, "i") if personal else "FALSE", "'personal'"), (d.rx("substr(text, 1, 10)", "[0-9]"), "'numbered'"), (d.rx("text", r"^[IVX]+\.?$"), "'roman'"))
    return r.add(kind=kind).where("kind IS NOT NULL", derived=True).top(n, "page, block_id", "doc_id, kind")
