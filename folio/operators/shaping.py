"""Table-level shaping: Markdown tables, conversations, notebooks, pages and output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as ft
from folio.runtime import stash


def markdown_table(rows: DataFrame, columns: list[str], order: list[str], group: list[str] | None = None, header: list[str] | None = None) -> DataFrame:
    """Rows as Markdown tables, one for each group (or one in all): columns ``group`` and ``markdown``.

    Cells are escaped; nulls are empty. A group's table is one string, so a group must fit a row.
    """
    line = ft.table_row(*[ft.safe_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    names = header or columns
    head = "| " + " | ".join(names) + " |\n| " + " | ".join(["---"] * len(names)) + " |"
    grouped = rows.groupBy(*(group or []))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x["_line"]), "\n")
    return grouped.agg(body.alias("_body")).select(*(group or []), F.concat_ws("\n", F.lit(head), F.when(F.col("_body") != "", F.col("_body"))).alias("markdown"))


def ordered_sections(rows: DataFrame, group: str, order: str, section: Column, between: str = "\n\n") -> DataFrame:
    """The sections of each group in order, as one Markdown; the shape of notebooks, feeds, books and chats."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), section.alias("s"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda p: p["s"]), between).alias("markdown"))


def notebook_markdown(content: Column) -> Column:
    """Markdown of a notebook's JSON, as a plain expression; null for what isn't JSON of that form."""
    cell = "array<struct<cell_type:string,source:array<string>>>"
    cells = F.from_json(content, f"struct<cells:{cell}>")["cells"]

    def render(c: Column) -> Column:
        body = F.array_join(c["source"], "")
        return F.when(c["cell_type"] == "markdown", body).when(c["cell_type"] == "code", F.concat(F.lit("```python\n"), body, F.lit("\n```"))).when(c["cell_type"] == "raw", F.concat(F.lit("```\n"), body, F.lit("\n```")))

    return F.array_join(F.filter(F.transform(cells, render), lambda x: x.isNotNull()), "\n\n")


def feed_items(xml: Column) -> Column:
    """Title, date and description of a feed's items, as a plain expression."""
    tag = lambda name: F.xpath(xml, F.lit(f"/rss/channel/item/{name}/text()"))
    return F.arrays_zip(tag("title").alias("title"), tag("pubDate").alias("pubDate"), tag("description").alias("description"))


def pages(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """A row for each page of ``size`` characters: key, page (from 0), offset, body. Empty texts have none."""
    n = F.ceil(F.char_length(text) / size).cast("int")
    numbered = docs.where(F.char_length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("page"))
    return numbered.select(key, "page", (F.col("page") * size).alias("offset"), F.substring(text, F.col("page") * size + 1, F.lit(size)).alias("body"))


#: Rows of one name that are numbered in one piece.
PIECE = 100_000


def output_names(docs: DataFrame, key: str, name: str, keep_extension: bool = False) -> DataFrame:
    """``docs`` with ``output``: a file name of its own for every row. A column of that name is replaced.

    The stem and ".md"; where stems collide the whole name and ".md"; where whole names collide a number
    after it, in the order of ``key``, from the first that is free: a name that already ends in a hyphen and
    a number keeps it, and numbers for the name before the hyphen go on after the largest of these. Folders are cut
    off and ".." never gets through; a null or empty name is "output". Null keys come first.

    Names are counted by aggregations, written so that a join on a hot name can be split; a name that more than
    PIECE rows share is numbered in pieces by the key's hash, in the order of key within each.
    """
    kept = [c for c in docs.columns if c != "output"]
    base = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{name}`"), F.lit("")), r"[?#].*$", ""), r"^.*[/\\]", "")
    base = F.when(F.regexp_replace(base, r"[.\s]", "") == "", F.lit("output")).otherwise(base)
    stem = F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), base.alias("base"), (base if keep_extension else stem).alias("stem"))
    stems = stash(rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "stems")
    rows = rows.join(stems, "stem", "left").select("row", F.when(F.col("n") > 1, F.col("base")).otherwise(F.col("stem")).alias("wanted"))
    names = stash(rows.groupBy("wanted").agg(F.count(F.lit(1)).alias("n")), "names")
    own = r"^(.*)-([0-9]{1,9})$"
    numbered = names.where(F.col("wanted").rlike(own)).groupBy(F.regexp_extract("wanted", own, 1).alias("wanted")).agg(F.max(F.regexp_extract("wanted", own, 2).cast("long")).alias("after"))
    shared = stash(names.where("n > 1").join(numbered, "wanted", "left"), "sharednames")
    rows = rows.join(shared, "wanted", "left")
    by = F.col("row").getField(key)
    rows = rows.withColumn("piece", F.when(F.col("n") > PIECE, F.pmod(F.xxhash64(by), F.ceil(F.col("n") / PIECE))).otherwise(F.lit(0).cast("long")))
    # the rows of a name before each piece: a few rows for each hot name
    hot = rows.where(F.col("n") > PIECE).groupBy("wanted", "piece").agg(F.count(F.lit(1)).alias("k"))
    order = Window.partitionBy("wanted").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = stash(hot.withColumn("before", F.coalesce(F.sum("k").over(order), F.lit(0))).drop("k"), "namepieces")
    nth = F.row_number().over(Window.partitionBy("wanted", "piece").orderBy(by))
    rows = rows.withColumn("nth", nth).join(F.broadcast(before), ["wanted", "piece"], "left")  # at most a row for each PIECE rows
    nth = F.col("nth") + F.coalesce("before", F.lit(0))
    out = F.concat(F.col("wanted"), F.when(nth > 1, F.concat(F.lit("-"), (nth - 1 + F.coalesce("after", F.lit(0))).cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    return rows.select("row", out.alias("output")).select(*[F.col("row").getField(c).alias(c) for c in kept], "output")
