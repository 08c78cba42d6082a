"""Block tables made of the driver's tables, alike in every dialect.

``star`` has the numbering, type and position of printed documents (a document is a supplier), ``page`` the blocks of web
pages, ``lines`` the lines of plain documents.
"""

from __future__ import annotations

from ..plans import Relation, SparkRelation, SqlRelation

TABLES = {
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "pages": "page_id url html",
    "documents": "doc_id text lang source n_chars",
    "labels": "doc_id quality toxic",
}


class SparkTables:
    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        # the rules are long expressions, and Java never compiles a method of over 8,000 bytes: such stages run as split functions
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")

    def __call__(self, name: str) -> Relation:
        return SparkRelation(self.spark.read.parquet(f"{self.folder}/{name}.parquet").select(*TABLES[name].split()))


class SqlTables:
    def __init__(self):
        self._first: SqlRelation | None = None

    def __call__(self, name: str) -> Relation:
        columns = TABLES[name].split()
        if self._first is None:
            self._first = SqlRelation(name, columns)
            return self._first
        return self._first.table(name, columns)


def dealt(r: Relation, key: str) -> Relation:
    """Rows dealt to all tasks if Spark reads them from fewer files than it has cores: a file may be one group of rows, one task's work."""
    if not isinstance(r, SparkRelation) or len(r.df.inputFiles()) >= r.df.sparkSession.sparkContext.defaultParallelism:
        return r
    return SparkRelation(r.df.repartition(key))


#: A total order of the line items.
ORDER = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_suppkey, l_tax, l_shipdate"


def star(tables) -> Relation:
    """Blocks with every column of the canonical schema; about 600 a document."""
    r = tables("lineitem").add(p_partkey="l_partkey").join(tables("part").pick("p_partkey", "p_name"), ["p_partkey"])
    d = r.d
    name, n = "concat(upper(substr(p_name, 1, 1)), substr(p_name, 2))", "CAST(l_linenumber AS STRING)"
    roman = "CASE l_linenumber WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' ELSE 'VII' END"
    letter = "substr('ABCDEFGHIJ', CAST(1 + l_orderkey % 10 AS INT), 1)"
    minor = "CAST(1 + l_orderkey % 5 AS STRING)"
    kinds = [
        f"concat({n}, '. ', {name})", f"concat({n}, '.', {minor}, ' ', {name})", f"concat({roman}, '. ', {name})", f"concat({letter}, '. ', {name})",
        f"concat({letter}, '.', {n}, ' ', {name})", f"concat({n}, '.')", "p_name", name,
        f"concat('Chapter ', {n}, ' ', {name})", "CASE WHEN l_linenumber < 4 THEN 'Introduction' ELSE 'System design' END", "upper(p_name)", "concat('the ', p_name)",
        "concat('• ', p_name)", "concat(substr(p_name, 1, 4), '.js')", f"concat({name}, ' and ', p_name, ', ', p_name, ' or ', p_name, ' with ', p_name, ' for ', p_name, ' of ', p_name, '.')",
        f"{d.extract(name, '^([A-Za-z]+)')}", f"concat({name}, ':')", "'$ 12'", f"concat({n}, ') ', p_name)", "concat('see www.', substr(p_name, 1, 3), '.com')",
        "CASE WHEN l_linenumber < 4 THEN 'and' ELSE 'these' END", "'2024-01-02'", roman, letter,
    ]
    text = f"CASE l_partkey % {len(kinds)} " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(kinds)) + " END"
    r = r.add(doc_id="CAST(l_suppkey AS BIGINT)", text=text).add(block_id=f"CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) - 1 AS BIGINT)")
    r = r.pick(
        "doc_id", "block_id", "text",
        page="CAST(floor(block_id / 40) + 1 AS INT)",
        font_size="CAST(8 + l_quantity % 17 AS DOUBLE)",
        line_position_on_page="CAST(block_id % 40 AS DOUBLE) / CAST(40 AS DOUBLE)",
        x0="CAST(40 + l_extendedprice % 400 AS DOUBLE)",
        y0="CAST(20 * (block_id % 40) AS DOUBLE) + l_tax",
        width="CAST(20 + l_extendedprice % 90 AS DOUBLE)",
        height="CAST(8 + l_quantity % 17 AS DOUBLE)",
        bold="l_returnflag = 'R'", italic="l_returnflag = 'N' AND l_linenumber = 1",
        is_heading="CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END",
        heading_level="CAST(CASE WHEN l_linestatus = 'O' THEN 1 + l_linenumber % 3 ELSE 0 END AS INT)",
        heading_confidence="CAST(round(l_extendedprice - floor(l_extendedprice), 2) AS DOUBLE)",
        is_heading_pred="CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END",
    )
    return r.add(x1="x0 + width", y1="y0 + height").drop("width", "height")


#: Elements within a line of text.
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()


def page(tables) -> Relation:
    """Blocks of web pages: titles, headings, paragraphs, list entries and footers, each up to the next block-level tag.

    Comments, scripts and styles go, and so do the tags of inline elements, whose text stays.
    """
    r = dealt(tables("pages"), "page_id")
    d = r.d
    text = d.replace("html", r"(?s)<!--.*?-->|(?i:<script[\s>].*?</script>|<style[\s>].*?</style>)")
    text = d.replace(d.replace(text, r"(?i)<br\s*/?>", " "), rf"(?i)</?(?:{'|'.join(INLINE)})(?:\s[^>]*)?/?>")
    r = r.pick("page_id", html=text)
    s = d.string(r"(?i)<(h[1-6]|title|p|li|footer)(?:\s[^>]*)?>([^<]*)")
    zipped = "arrays_zip({0}, {1})" if isinstance(r, SparkRelation) else "list_zip({0}, {1})"
    r = r.pick(doc_id="page_id", __tags=f"regexp_extract_all(html, {s}, 1)", __texts=f"regexp_extract_all(html, {s}, 2)")
    if isinstance(r, SparkRelation):
        r = SparkRelation(r.df.selectExpr("doc_id", f"posexplode({zipped.format('__tags', '__texts')}) as (__pos, __x)").selectExpr("doc_id", "CAST(__pos AS BIGINT) AS block_id", "__x.`0` AS tag" if "0" in str(r.df.selectExpr(zipped.format("__tags", "__texts") + " as z").schema) else "__x.__tags AS tag", "__x.__texts AS text"))
    else:
        r = r.pick("doc_id", tag="unnest(__tags)", text="unnest(__texts)", block_id="CAST(unnest(range(len(__tags))) AS BIGINT)")
    return r.add(tag="lower(tag)").pick(
        "doc_id", "block_id", "tag", text=d.strip("text"), page="1",
        font_size="CAST(CASE tag WHEN 'title' THEN 24 WHEN 'h1' THEN 18 WHEN 'h2' THEN 16 WHEN 'h3' THEN 14 WHEN 'h4' THEN 13 WHEN 'h5' THEN 12 WHEN 'h6' THEN 11 WHEN 'p' THEN 10 WHEN 'li' THEN 9 ELSE 8 END AS DOUBLE)",
        bold="tag <> 'p' AND tag <> 'li' AND tag <> 'footer'", italic="FALSE", line_position_on_page="CAST(least(block_id, 40) AS DOUBLE) / CAST(40 AS DOUBLE)",
    )


def lines(tables) -> Relation:
    """The lines of plain documents."""
    r = dealt(tables("documents"), "doc_id").pick("doc_id", text="coalesce(text, '')")
    if isinstance(r, SparkRelation):
        r = SparkRelation(r.df.selectExpr("doc_id", "posexplode(split(text, '\\n')) as (__pos, text)").selectExpr("doc_id", "CAST(__pos AS BIGINT) AS block_id", "text"))
    else:
        r = r.pick("doc_id", text="unnest(string_split(text, chr(10)))", block_id="CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT)")
    return r.pick(
        "doc_id", "block_id", text=r.d.strip("text"), page="CAST(floor(block_id / 40) + 1 AS INT)", font_size="CAST(10 + length(text) % 5 AS DOUBLE)",
        bold="FALSE", italic="FALSE", line_position_on_page="CAST(block_id % 40 AS DOUBLE) / CAST(40 AS DOUBLE)",
    )
