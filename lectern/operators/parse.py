"""Layout, paragraphs and tables across pages, Markdown, HTML and JSON.

Blocks are rows (doc_id, page_num, block_no, content, ...), tables rows (doc_id, page_num, pos, data).
State machines over lines are windows of one document: islands by a running sum of breaks.
"""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lectern.functions import text as T

# What begins and ends a paragraph.
STARTS = r"^(\s+|[A-Z]|\d+\.|[一二三四五六七八九十]、|第[一二三四五六七八九十]+章)"
ENDS = r"[。！？.!?]$"


def column_intervals(chars: DataFrame, by: tuple[str, ...] = ("doc_id", "page_num")) -> DataFrame:
    """(by, column_no, left, right): x positions, rounded to 50, that lie within 100 of each other form a column.

    chars: (by, x0, page_width). One column spans the page.
    """
    at = chars.select(*by, "page_width", (F.bround(F.col("x0") / 50) * 50).alias("x")).distinct()
    order = Window.partitionBy(*by).orderBy("x")
    gap = F.when(F.col("x") - F.lag("x").over(order) > 100, 1).otherwise(0)
    numbered = at.withColumn("__new", gap).withColumn("column_no", F.sum("__new").over(order))
    spans = numbered.groupBy(*by, "column_no").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("page_width").alias("page_width"))
    many = F.count(F.lit(1)).over(Window.partitionBy(*by)) > 1
    return spans.select(
        *by,
        F.col("column_no").cast("int").alias("column_no"),
        F.when(many, F.greatest(F.lit(0.0), F.col("lo") - 30)).otherwise(F.lit(0.0)).alias("left"),
        F.when(many, F.least(F.col("page_width"), F.col("hi") + 30)).otherwise(F.col("page_width")).alias("right"),
    )


def lines_of_chars(chars: DataFrame, columns: DataFrame, by: tuple[str, ...] = ("doc_id", "page_num")) -> DataFrame:
    """Text lines: characters with the same y (rounded to 5) from left to right, and the first column that holds their start."""
    y = F.bround(F.col("y0") / 5) * 5
    rows = chars.groupBy(*by, y.alias("y0")).agg(F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("c"))
    rows = rows.select(*by, "y0", F.get("c", 0)["x0"].alias("x0"), F.get("c", F.size("c") - 1)["x1"].alias("x1"), F.array_join(F.col("c.text"), "").alias("content"))
    rows = rows.where(T.strip(F.col("content")) != "")
    spans = columns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("column_no", "left", "right"))).alias("__cols"))
    inside = F.filter("__cols", lambda k: (k["left"] <= F.col("x0")) & (F.col("x0") <= k["right"]))
    placed = rows.join(spans, list(by), "left")
    return placed.select(*by, "content", "x0", "y0", "x1", (F.col("y0") + 10).alias("y1"), F.coalesce(F.get(inside, 0)["column_no"], F.lit(0)).alias("column"))


def layout_type(tables: Column) -> Column:
    return F.when(F.size(tables) > 0, F.lit("text_with_tables")).otherwise(F.lit("single_column"))


def simple_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One page, one block for each line that isn't blank."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("block_no", "content"))
    return lines.where(T.strip(F.col("content")) != "").select(id_col, F.lit(1).alias("page_num"), "block_no", "content")


def connect_paragraphs(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, page_num, para_no, content, members, pages): blocks joined until one ends a sentence or the next begins a paragraph."""
    order = Window.partitionBy(id_col).orderBy("page_num", "block_no")
    ended = F.coalesce(F.lag(F.col("content").rlike(ENDS) | (F.col("content") == "")).over(order), F.lit(True))
    new = (ended | F.col("content").rlike(STARTS)).cast("int")
    rows = blocks.withColumn("__new", new).withColumn("para_no", F.sum("__new").over(order))
    parts = F.array_sort(F.collect_list(F.struct("page_num", "block_no", "content")))
    out = rows.groupBy(id_col, "para_no").agg(parts.alias("p"), F.countDistinct("page_num").alias("pages"))
    return out.select(id_col, F.get("p", 0)["page_num"].alias("page_num"), F.col("para_no").cast("int").alias("para_no"), F.array_join(F.col("p.content"), " ").alias("content"), F.size("p").alias("members"), "pages")


def connect_tables(tables: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, page_num, pos, data, pages): tables at one position with equal stripped headers on consecutive pages become one.

    Whole chains join, however many pages; repeated headers are dropped.
    """
    order = Window.partitionBy(id_col, "pos").orderBy("page_num")
    head = F.transform(F.get("data", 0), lambda x: T.strip(F.coalesce(x, F.lit(""))))
    rows = tables.where(F.size("data") > 0).withColumn("__head", head)
    goes_on = (F.lag("page_num").over(order) == F.col("page_num") - 1) & (F.lag("__head").over(order) == F.col("__head"))
    rows = rows.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__chain", F.sum("__new").over(order))
    out = rows.groupBy(id_col, "pos", "__chain").agg(F.array_sort(F.collect_list(F.struct("page_num", "data"))).alias("t"))
    merged = F.concat(F.get("t", 0)["data"], F.flatten(F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda x: F.slice(x["data"], 2, F.greatest(F.size(x["data"]) - 1, F.lit(0))))))
    return out.select(id_col, F.get("t", 0)["page_num"].alias("page_num"), "pos", merged.alias("data"), F.size("t").alias("pages"))


def page_text(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text): blocks of a page on lines of their own, an empty line between pages. Tables aren't part of it."""
    kept = blocks.where(T.strip(F.col("content")) != "")
    pages = kept.groupBy(id_col, "page_num").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block_no", "content")))["content"], "\n").alias("t"))
    return pages.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_num", "t")))["t"], "\n\n").alias("text"))


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sections, tables) of Markdown: (id, line_no, text, kind) and (id, line_no, data).

    A pipe table takes two adjacent lines that begin and end with a pipe; an HTML table reaches to the
    line with its end. Other lines are headings or paragraphs, joined by spaces up to an empty line.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("n", "line")).withColumn("s", T.strip(F.col("line")))
    order = Window.partitionBy(id_col).orderBy("n")
    before, sofar = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    pipe = F.col("s").rlike(r"(?s)^\|(.*\|)?$")
    opens, closes = ~pipe & F.lower("line").contains("<table"), F.lower("line").contains("</table>")
    # inside an HTML table: the last opening line isn't yet followed by a closing one
    lines = lines.withColumn("__pipe", pipe).withColumn("__opens", opens).withColumn("__closes", closes)
    opened = F.max(F.when(F.col("__opens"), F.col("n"))).over(sofar)
    closed = F.coalesce(F.max(F.when(F.col("__closes"), F.col("n"))).over(before), F.lit(-1))
    lines = lines.withColumn("__html", opened.isNotNull() & (closed < opened))
    kind = F.when(F.col("__html"), F.lit("html")).when(F.col("__pipe"), F.lit("pipe")).when(F.col("s") == "", F.lit("blank")).when(F.col("s").startswith("#"), F.lit("heading")).otherwise(F.lit("text"))
    lines = lines.withColumn("k", kind)
    first_html = F.col("__html") & (~F.coalesce(F.lag("__html").over(order), F.lit(False)) | F.coalesce(F.lag("__closes").over(order), F.lit(False)))
    new = F.when((F.col("k") == "heading") | (F.col("k") != F.coalesce(F.lag("k").over(order), F.lit(""))) | first_html, 1).otherwise(0)
    lines = lines.withColumn("__new", new).withColumn("g", F.sum("__new").over(order))
    runs = lines.groupBy(id_col, "g").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct("n", "line", "s"))).alias("r"))
    runs = runs.withColumn("line_no", F.get("r", 0)["n"]).withColumn("k", F.when((F.col("k") == "pipe") & (F.size("r") < 2), F.lit("text")).otherwise(F.col("k")))
    data = F.when(F.col("k") == "pipe", T.parse_pipe_table(F.col("r.s"))).otherwise(T.parse_html_table(F.array_join(F.col("r.line"), "\n")))
    tables = runs.where("k in ('pipe', 'html')").select(id_col, "line_no", data.alias("data")).where(F.size("data") > 0)
    # a lone pipe line is text of the paragraph around it
    order = Window.partitionBy(id_col).orderBy("line_no")
    texts = runs.where("k in ('heading', 'text', 'blank', 'pipe', 'html')")
    joins = F.when((F.col("k") == "text") & (F.lag("k").over(order) == "text"), 0).otherwise(1)
    texts = texts.withColumn("__j", joins).withColumn("p", F.sum("__j").over(order)).where("k in ('heading', 'text')")
    cleaned = F.filter(F.transform(F.col("r.s"), T.clean_markdown), lambda x: x != "")
    texts = texts.select(id_col, "p", "line_no", "k", cleaned.alias("c"), F.length(F.regexp_extract(F.get("r", 0)["s"], "^(#+)", 1)).alias("level"))
    parts = texts.groupBy(id_col, "p").agg(F.min("line_no").alias("line_no"), F.first("k").alias("k"), F.first("level").alias("level"), F.flatten(F.array_sort(F.collect_list(F.struct("line_no", "c")))["c"]).alias("c"))
    name = F.when(F.col("k") == "heading", F.concat(F.lit("heading_"), F.least(F.col("level"), F.lit(6)).cast("string"))).otherwise(F.lit("paragraph"))
    sections = parts.select(id_col, "line_no", F.array_join("c", " ").alias("text"), name.alias("kind")).where("text <> ''")
    return sections, tables


class _Text(HTMLParser):
    """Text outside the elements that carry none."""

    def __init__(self, skipped):
        super().__init__(convert_charrefs=True)
        self.skipped, self.depth, self.parts, self.title, self.in_title = skipped, 0, [], "", False

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.skipped
        self.in_title = tag == "title"

    def handle_endtag(self, tag):
        self.depth -= tag in self.skipped and self.depth > 0
        self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.depth:
            self.parts.append(data)


# Elements without running text.
SKIPPED = ("script", "style", "nav", "footer", "header")


def html_to_text(page: str | None, skipped: tuple[str, ...] = SKIPPED) -> str:
    p = _Text(skipped)
    p.feed(page or "")
    p.close()
    return "\n".join(x for x in (line.strip() for line in "\n".join(p.parts).split("\n")) if x)


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Text of pages, a line for each run; script, style, nav, footer and header go."""
    return pages.map(html_to_text)


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(StructType([StructField("title", StringType()), StructField("lines", ArrayType(StringType()))]))
def html_main(pages: pd.Series) -> pd.DataFrame:
    """Title and lines of the main text."""
    out = []
    for page in pages:
        p = _Text((*SKIPPED, "title"))
        p.feed(page or "")
        p.close()
        out.append((p.title.strip(), [x.strip() for x in "\n".join(p.parts).split("\n") if x.strip()]))
    return pd.DataFrame(out, columns=["title", "lines"])


def lists_to_objects(c: Column) -> Column:
    """JSON text with every list as an object item_0, item_1, ..., and blanks behind commas and colons alone.

    A fold over the text's tokens: the state has the containers that are open (for a list the number of its next item, else -1) and the
    text so far, in runs of some thousand characters.
    """
    found = F.regexp_extract_all(c, F.lit(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\[\]{},:"\s]+'), F.lit(0))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.array().cast("array<int>").alias("open"))

    def step(a: Column, t: Column) -> Column:
        top = F.when(F.size(a["open"]) > 0, F.element_at(a["open"], -1)).otherwise(F.lit(-1))
        below = F.slice(a["open"], 1, F.greatest(F.size(a["open"]) - 1, F.lit(0)))
        counted = F.when(top >= 0, F.concat(below, F.array(top + 1))).otherwise(a["open"])
        item = F.when(top >= 0, F.concat(F.lit('"item_'), top.cast("string"), F.lit('": '))).otherwise(F.lit(""))
        said = F.when(t == ",", F.lit(", ")).when(t == ":", F.lit(": ")).when(t.isin("]", "}"), F.lit("}")).when(t.isin("[", "{"), F.concat(item, F.lit("{"))).otherwise(F.concat(item, t))
        now = F.when(t.isin(",", ":"), a["open"]).when(t.isin("]", "}"), below).when(t == "[", F.concat(counted, F.array(F.lit(0)))).when(t == "{", F.concat(counted, F.array(F.lit(-1)))).otherwise(counted)
        full = F.length(a["held"]) > 4000
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]).alias("done"), F.when(full, said).otherwise(F.concat(a["held"], said)).alias("held"), now.alias("open"))

    return F.aggregate(found, start, step, lambda a: F.concat(F.array_join(a["done"], ""), a["held"]))


def json_sections(c: Column, max_size: int = 2000) -> Column:
    """Top-level keys, in their order, packed into objects whose values are at most twice max_size characters, where that can be.

    Values are variants, lists become objects. Text that isn't JSON, null, and scalars that are null, false, zero or empty have no sections;
    any other scalar is one.
    """
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    value = lambda v: lists_to_objects(F.to_json(v))
    quoted = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    text, kind = F.trim(c), F.substring(F.trim(c), 1, 1)
    of_object = F.transform(F.map_entries(F.from_json(text, "map<string,variant>")), lambda e: entry(e["key"], value(e["value"])))
    of_list = F.transform(F.from_json(text, "array<variant>"), lambda v, i: entry(F.concat(F.lit("item_"), i.cast("string")), value(v)))
    entries = F.when(kind == "{", of_object).when(kind == "[", of_list)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))
    whole = lambda held: F.concat(F.lit("{"), held, F.lit("}"))

    def step(a: Column, e: Column) -> Column:
        pair, n = F.concat(quoted(e["k"]), F.lit(": "), e["v"]), F.length(e["v"])
        full = (a["held"] != "") & (a["n"] + n > 2 * max_size)
        fresh = F.struct(F.concat(a["done"], F.array(whole(a["held"]))).alias("done"), pair.alias("held"), n.alias("n"))
        return F.when(full, fresh).otherwise(F.struct(a["done"].alias("done"), F.concat(a["held"], F.when(a["held"] == "", F.lit("")).otherwise(F.lit(", ")), pair).alias("held"), (a["n"] + n).alias("n")))

    none = F.array().cast("array<string>")
    packed = F.aggregate(entries, start, step, lambda a: F.when(a["held"] == "", none).otherwise(F.concat(a["done"], F.array(whole(a["held"])))))
    scalar = F.when(text.isin("null", "false", '""') | text.rlike(r"^-?0+(\.0+)?([eE].*)?$"), none).otherwise(F.array(text))
    return F.when(F.try_parse_json(text).isNull(), none).when(kind.isin("{", "["), packed).otherwise(scalar)
