"""Tables out of Markdown pages: links, labelled fields, sections and embedded tables, in long form."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A link with its balanced parentheses: anchor, target, title.
LINK = r'\[([^\[\]\n]*+)\]\(([^()\s]*+(?:\([^()\s]*+\)[^()\s]*+)*+)(?:\s+"([^"\n]*+)")?\s*\)'


def links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, anchor, target, missing) of each link in order of occurrence; `missing` if the target is marked as not existing."""
    found = F.regexp_extract_all(text_col, F.lit(LINK), F.lit(0))
    part = lambda i: F.regexp_extract("x", LINK, i)
    rows = df.select(F.col(id_col).alias("id"), F.explode(found).alias("x"))
    return rows.select("id", part(1).alias("anchor"), F.regexp_replace(part(2), r"\?action=edit&redlink=1$", "").alias("target"), part(2).endswith("redlink=1").alias("missing"))


def fields(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, value, pos) of lines such as "**Label:** value" or "*Label:* value"."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    pattern = r"^\s*(?:[-*]\s+)?\*{1,2}([^*:\n]+):\*{0,2}\s*(.*?)\*{0,2}\s*$"
    return rows.where(F.col("line").rlike(pattern)).select("id", F.regexp_extract("line", pattern, 1).alias("label"), F.regexp_extract("line", pattern, 2).alias("value"), "pos")


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, level, heading): headings in order; a section reaches to the next heading of its level or above."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    pattern = r"^(#{1,6})\s+(.+?)\s*$"
    return rows.where(F.col("line").rlike(pattern)).select("id", "pos", F.length(F.regexp_extract("line", pattern, 1)).alias("level"), F.regexp_extract("line", pattern, 2).alias("heading"))


def table_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, cells, rule): lines of pipe tables; `rule` marks the line under a header."""
    rows = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    return rows.select("id", "pos", cells.alias("cells"), F.col("line").rlike(r"^[\s|:-]*-[\s|:-]*$").alias("rule"))


def table_cells(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, table_no, row_no, col_name, value): cells of pipe tables by their header; tables and rows count from 1.

    A header is the line directly above a rule. Cells without a header, or under a blank one, are left out, as are lines before the first header.
    """
    rows = table_rows(df, id_col, text_col)
    w = W.partitionBy("id").orderBy("pos")
    head = F.coalesce(F.lead("rule").over(w) & (F.lead("pos").over(w) == F.col("pos") + 1), F.lit(False)) & ~F.col("rule")
    marked = rows.withColumn("_head", head).withColumn("table_no", F.sum(F.col("_head").cast("int")).over(w)).where("table_no > 0 AND NOT rule")
    t = W.partitionBy("id", "table_no").orderBy("pos")
    body = marked.withColumn("_names", F.first("cells").over(t)).withColumn("row_no", F.row_number().over(t) - 1).where("row_no > 0")
    cells = body.select("id", "table_no", "row_no", F.explode(F.arrays_zip(F.col("_names").alias("h"), F.col("cells").alias("v"))).alias("x"))
    return cells.where("x.h IS NOT NULL AND x.h <> '' AND x.v IS NOT NULL").select("id", "table_no", "row_no", F.col("x.h").alias("col_name"), F.col("x.v").alias("value"))


def unfold(df: DataFrame, cells: str, width: int, names: list[str]) -> DataFrame:
    """Rows of a table folded into groups of `width` side-by-side columns, one row a group; blank groups are left out.

    `cells` is an array of a row's cells, in which empty cells between the groups have been dropped.
    """
    kept = F.filter(F.col(cells), lambda x: x != "")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.size(kept) / width).cast("int") - 1)), lambda i: F.slice(kept, i * width + 1, width))
    rows = df.withColumn("_g", F.explode(groups)).where(F.size("_g") == width)
    return rows.select(*[c for c in df.columns if c != cells], *[F.get("_g", i).alias(n) for i, n in enumerate(names)])


def merged_header(rows: DataFrame) -> DataFrame:
    """(id, name, col_name, value) of tables whose real column names stand in the first row under the header, without one for the first column.

    `rows` are lines of `table_rows` without rules. Rows beyond the names are left out, as are cells beyond a row's end.
    """
    w = W.partitionBy("id").orderBy("pos")
    numbered = rows.withColumn("_n", F.row_number().over(w)).withColumn("_names", F.nth_value("cells", 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).where("_n > 2")
    cells = numbered.select("id", F.col("cells")[0].alias("name"), F.explode(F.arrays_zip(F.col("_names").alias("h"), F.slice("cells", 2, 10_000).alias("v"))).alias("x"))
    return cells.where("x.h IS NOT NULL AND x.v IS NOT NULL").select("id", "name", F.col("x.h").alias("col_name"), F.col("x.v").alias("value"))
