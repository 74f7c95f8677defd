"""Page text to blocks (headings, lists, tables, paragraphs), blocks to sections and to rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions.text import BLANK, BLANKS, strip, words

ITEM = r"^\s*(?:[-*•●▪]|\d+[.)]|\([A-Za-z]\)|[A-Za-z]\.)\s+(.+)$"
NUMBERED = r"^(\d+(\.\d+)*)[.)]?\s+\S"
CAPS = r"^[A-Z0-9 \-:/&,.]{3,}$"


def html_to_text(c: Column) -> Column:
    """The article's text, block ends as blank lines, list items as dashes."""
    t = F.regexp_extract(c, r"(?s)<article>(.*?)</article>", 1)
    t = F.regexp_replace(t, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    t = F.regexp_replace(F.regexp_replace(t, "</h1>|</p>|</ul>", "\n\n"), "<li>", "- ")
    return F.regexp_replace(F.regexp_replace(t, "</li>", "\n"), "<[^>]*>", "")


def paragraphs(pages: DataFrame, text: str = "text") -> DataFrame:
    """One row a paragraph that isn't blank: pos, paragraph; `text` goes."""
    return pages.select("*", F.posexplode(F.split(F.col(text), "\n\n")).alias("pos", "paragraph")).where(F.ltrim(F.col("paragraph"), F.lit(BLANKS)) != "").drop(text)


def is_heading(line: Column) -> Column:
    return _is_heading(line, words(line))


def _is_heading(line: Column, w: Column) -> Column:
    n = F.size(w)
    upper = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}")))
    any_of = line.rlike(NUMBERED) | (line.rlike(CAPS) & line.rlike("[A-Z]")) | line.endswith(":") | (upper >= F.lit(0.7) * n)
    return n.between(1, 12) & ~line.rlike("[.,;]$") & any_of


def heading_level(line: Column) -> Column:
    return F.when(line.rlike(NUMBERED) & F.contains(F.split_part(line, F.lit(" "), F.lit(1)), F.lit(".")), 2).otherwise(1)


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are evaluated once a row: what is asked of them later isn't merged into their expressions, as it is with select."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def blocks(paras: DataFrame) -> DataFrame:
    """Adds block_type, level, items, n_rows, n_columns and confidence: a table first, then a list, a heading, a paragraph.

    What only some blocks need is computed for those that may be such: cells where there are gaps, items of several
    lines, words (13 at most, and the rest) of a single line without a mark at its end.
    """
    x = _once(paras, F.filter(F.transform(F.split("paragraph", "\n"), strip), lambda s: s != "").alias("__lines"))
    lines = F.col("__lines")
    first = F.get(lines, 0)
    gaps = F.lit(False)
    for blank in ("  ", "\t", "\x0b", "\f", "\r"):
        gaps = gaps | F.contains("paragraph", F.lit(blank))
    cells = F.transform(lines, lambda s: F.size(F.filter(F.split(s, r"\s{2,}|\t"), lambda c: c != "")))
    wide = F.when(gaps & (F.size(lines) >= 2), F.filter(cells, lambda n: n >= 2)).otherwise(F.array().cast("array<int>"))
    items = F.when(F.size(lines) >= 2, F.transform(F.filter(lines, lambda s: s.rlike(ITEM)), lambda s: F.regexp_extract(s, ITEM, 1))).otherwise(F.array().cast("array<string>"))
    marked = first.endswith(".") | first.endswith(",") | first.endswith(";")
    x = _once(x, wide.alias("__wide"), items.alias("__items"), F.when((F.size(lines) == 1) & ~marked, F.split(first, f"{BLANK}+", 14)).alias("__words"))
    w, items = F.col("__wide"), F.col("__items")
    # The most frequent number of cells, the smallest of equals.
    mode = F.array_max(F.transform(F.array_distinct(w), lambda v: F.struct(F.size(F.filter(w, lambda y: y == v)).alias("n"), (-v).alias("v"))))
    kind = F.when(F.size(w) >= 2, "table").when(F.size(items) >= 2, "list").when(F.col("__words").isNotNull() & _is_heading(first, F.col("__words")), "heading").otherwise("paragraph")
    x = x.withColumn("block_type", kind)
    table = F.col("block_type") == "table"
    x = x.withColumn("__mode", F.when(table, mode))
    return x.select(
        *[c for c in paras.columns], "block_type", F.when(F.col("block_type") == "heading", heading_level(first)).alias("level"),
        F.when(F.col("block_type") == "list", items).alias("items"), F.when(table, F.size(lines)).alias("n_rows"), F.when(table, -F.col("__mode.v")).alias("n_columns"),
        F.when(table, F.round(F.least(F.lit(0.95), F.lit(0.4) + F.lit(0.5) * F.col("__mode.n") / F.size(w)), 2)).alias("confidence"))


def sections(blks: DataFrame, doc: str = "doc_id", page: str = "page_number") -> DataFrame:
    """Blocks from one heading to the next. end_page is the page of the next heading, the last page for the last section."""
    order = Window.partitionBy(doc).orderBy(page, "pos")
    x = blks.withColumn("section", F.sum((F.col("block_type") == "heading").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, "pos", "paragraph"))), lambda b: b["paragraph"]), "\n\n")
    head = F.col("block_type") == "heading"
    g = x.groupBy(doc, "section").agg(F.max(F.when(head, F.col("paragraph"))).alias("title"), F.max(F.when(head, F.col("level"))).alias("level"), F.min(page).alias("start_page"), F.max(page).alias("last"), text.alias("text"), F.count(F.lit(1)).alias("n_blocks"))
    nxt = F.lead("start_page").over(Window.partitionBy(doc).orderBy("section"))
    return g.select(doc, "section", F.coalesce("title", F.lit("Document Start")).alias("title"), F.coalesce("level", F.lit(0)).alias("level"), "start_page", F.coalesce(nxt, "last").alias("end_page"), "text", "n_blocks")


def render(blks: DataFrame, doc: str = "doc_id", page: str = "page_number") -> DataFrame:
    """Marked-up text of each document, pages announced by number."""
    body = F.when(F.col("block_type") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("paragraph"))).when(
        F.col("block_type") == "list", F.array_join(F.transform("items", lambda i: F.concat(F.lit("- "), i)), "\n")).when(
        F.col("block_type") == "table", F.array_join(F.transform(F.split("paragraph", "\n"), lambda s: F.array_join(F.filter(F.split(strip(s), r"\s{2,}|\t"), lambda c: c != ""), " | ")), "\n")).otherwise(F.col("paragraph"))
    pages = blks.withColumn("body", body).groupBy(doc, page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "body"))), lambda b: b["body"]), "\n").alias("t"))
    line = F.concat(F.lit("[Page "), F.col(page), F.lit("]\n"), F.col("t"))
    return pages.withColumn("line", line).groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, "line"))), lambda b: b["line"]), "\n\n").alias("rendered"))
