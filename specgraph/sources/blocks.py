"""Plain text as ordered blocks, and blocks as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, kind, level, ordered, content) of texts (doc_id, text).

    Lines become headings (marked, or short and in capitals), list items, table rows or paragraphs. Two or
    more rows in a run are one table, its rows joined by line ends and cells by " | "; a single row is a paragraph. Blank lines are no blocks.
    """
    bare = lambda c: F.regexp_replace(c, r"^[\s\x{FEFF}]+|\s+$", "")
    l = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).withColumn("s", bare(F.col("raw"))).drop("raw")
    is_row = F.contains("s", F.lit("|"))
    cells = F.transform(F.split(F.regexp_replace("s", r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))
    capital = (F.length("s") <= 60) & F.col("s").rlike(r"^[A-Z0-9][A-Z0-9 \-/&:]{2,60}$") & (F.size(F.split("s", r"\s+")) <= 8)
    kind = F.when(is_row, "row").when(F.col("s") == "", "blank").when(F.col("s").rlike(r"^#{1,6}\s+"), "heading").when(F.col("s").rlike(r"^[-*•]\s+"), "bullet").when(F.col("s").rlike(r"^\d{1,3}[.)]\s+"), "numbered").when(capital, "capitals").otherwise("paragraph")
    l = l.withColumn("k", kind)
    w = W.partitionBy("doc_id").orderBy("line_no")
    l = l.withColumn("run", F.sum(F.when((F.col("k") == "row") & F.coalesce(F.lag("k").over(w) == "row", F.lit(False)), 0).otherwise(1)).over(w))
    l = l.filter("k != 'blank'").withColumn("row", F.when(F.col("k") == "row", F.when(F.exists(cells, lambda c: c != ""), F.array_join(cells, " | "))))
    g = l.groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.first("k").alias("k"), F.first("s").alias("s"), F.transform(F.array_sort(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("line_no", "row")))), lambda x: x["row"]).alias("rows"))
    g = g.filter("k != 'row' or size(rows) > 0")
    content = F.when(F.col("k") == "row", F.array_join("rows", "\n")).when(F.col("k") == "heading", F.trim(F.regexp_replace("s", r"^#{1,6}\s+", ""))).when(F.col("k").isin("bullet", "numbered"), F.trim(F.regexp_replace("s", r"^(?:[-*•]|\d{1,3}[.)])\s+", ""))).when(F.col("k") == "capitals", F.initcap(F.lower("s"))).otherwise(F.col("s"))
    name = F.when(F.col("k") == "row", F.when(F.size("rows") >= 2, "table").otherwise("paragraph")).when(F.col("k").isin("heading", "capitals"), "heading").when(F.col("k").isin("bullet", "numbered"), "list_item").otherwise("paragraph")
    level = F.when(F.col("k") == "heading", F.length(F.regexp_extract("s", "^(#{1,6})", 1))).when(F.col("k") == "capitals", 2).when(F.col("k").isin("bullet", "numbered"), 1)
    return g.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")) - 1).alias("block_no"), name.alias("kind"), level.alias("level"), (F.col("k") == "numbered").alias("ordered"), content.alias("content"))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown): headings, paragraphs and tables set off by blank lines, items of a list not; numbers restart after anything but an item."""
    w = W.partitionBy("doc_id").orderBy("block_no")
    b = blocks.withColumn("span", F.sum(F.when(F.col("kind") == "list_item", 0).otherwise(1)).over(w))
    b = b.withColumn("part", F.sum(F.when(F.col("ordered"), 0).otherwise(1)).over(W.partitionBy("doc_id", "span").orderBy("block_no")))
    n = F.row_number().over(W.partitionBy("doc_id", "span", "part", "ordered").orderBy("block_no"))
    rows = F.split("content", "\n")
    width = F.array_max(F.transform(rows, lambda r: F.size(F.split(r, r" \| "))))
    line = lambda r: F.concat(F.lit("| "), r, F.lit(" |"))
    table = F.concat_ws("\n", line(rows[0]), line(F.array_join(F.array_repeat(F.lit("---"), width), " | ")), F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line), "\n"))
    text = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.coalesce("level", F.lit(1)), F.lit(6))), F.lit(" "), F.col("content"), F.lit("\n")))
        .when(F.col("kind") == "list_item", F.concat(F.when(F.col("ordered"), F.concat(n.cast("string"), F.lit("."))).otherwise("-"), F.lit(" "), F.col("content")))
        .when(F.col("kind") == "table", F.concat(table, F.lit("\n")))
        .otherwise(F.concat(F.col("content"), F.lit("\n")))
    )
    b = b.withColumn("md", text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "md"))), lambda x: x["md"]), "\n")
    return b.groupBy("doc_id").agg(F.concat(F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def plain_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): contents in order, a line each."""
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "content"))), lambda x: x["content"]), "\n").alias("text"))


def anchored_items(blocks: DataFrame, family: str) -> DataFrame:
    """(doc_id, item_id, content): blocks that begin with an id (pattern ``family``) and the paragraphs and list items after it, up to the next heading or table."""
    w = W.partitionBy("doc_id").orderBy("block_no")
    own = F.regexp_extract("content", rf"^\s*({family})", 1)
    b = blocks.withColumn("own", F.nullif(own, F.lit(""))).withColumn("start", F.when(F.col("own").isNotNull() | F.col("kind").isin("heading", "table"), F.col("block_no")))
    b = b.withColumn("anchor", F.last("start", ignorenulls=True).over(w))
    g = b.groupBy("doc_id", "anchor").agg(F.max(F.when(F.col("block_no") == F.col("anchor"), F.col("own"))).alias("item_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "content"))), lambda x: x["content"]), "\n").alias("content"))
    return g.filter("item_id is not null").select("doc_id", "item_id", "content")


def excel_requirements(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """(row_id, title, description, module) of spreadsheet rows (with row_no): columns by any of their names; rows need a description."""
    have = {c.strip().lower(): c for c in rows.columns}
    col = lambda k: F.coalesce(*[F.nullif(F.trim(F.col(f"`{have[a]}`").cast("string")), F.lit("")) for a in aliases[k] if a in have], F.lit(None).cast("string"))
    d = rows.select("row_no", col("id").alias("id"), col("title").alias("title"), col("description").alias("description"), col("module").alias("module")).filter("description is not null")
    slug = F.regexp_replace(F.lower(F.coalesce("id", F.concat(F.lit("ROW-"), F.col("row_no")))), "[^a-z0-9_]", "_")
    return d.select(slug.alias("row_id"), F.coalesce("title", F.substring("description", 1, 60)).alias("title"), "description", F.coalesce("module", F.lit("Unspecified")).alias("module"))
