"""Lines repeated across one source's documents (problem 5).

Lines are normalised and hashed; the distinct documents of each (source, hash) are counted; lines
whose count reaches the threshold are joined back, and documents are rebuilt without them. All in
the JVM. Counting goes in two steps, (source, hash, document) before (source, hash), so a source
that holds a third of all rows is pre-aggregated on the map side and spread by hash.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.sources.scratch import materialize
from quernstone.sources.tables import spread

#: White space as Unicode has it, and the separators U+001C to U+001F.
_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def normal_form(line: Column) -> Column:
    """Lower case, digit runs as one 0, white space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), _SPACE, " "))


def lines(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, line_no, line) with line_no from 1, split at line feeds. Null texts have no lines; an empty text has one."""
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.posexplode(F.split(F.col(text_col), "\n")).alias("p", "line")).select(
        "id", "source", (F.col("p") + 1).cast("long").alias("line_no"), "line"
    )


def _hashed(df: DataFrame, min_words: int) -> DataFrame:
    """Lines with at least min_words words (runs of letters) as (id, source, line_no, h1, h2)."""
    norm = normal_form(F.col("line"))
    pattern = "(?s)" + r"[^\p{L}]+".join([r"\p{L}+"] * min_words)
    return df.where(F.col("line").rlike(pattern)).select("id", "source", "line_no", F.xxhash64(norm).alias("h1"), F.xxhash64(norm, F.lit(1)).alias("h2"))


def repeated_lines(df: DataFrame, id_col: str, source_col: str, text_col: str, min_docs: int = 6, min_share: float = 0.0, min_words: int = 2) -> DataFrame:
    """(id, line_no) of every line whose normal form stands in at least min_docs documents of its source, and in at least min_share of them.

    A null source is a source of its own. Lines of fewer than min_words words are never repeated lines. Rows with equal
    ids count as one document. Null texts give nothing; an empty table gives an empty result.
    """
    df = spread(df.select(id_col, source_col, text_col))
    # Lines are split, normalised and hashed once, for counting and for looking up.
    hashed = materialize(_hashed(lines(df, id_col, source_col, text_col), min_words), "lines")
    docs = hashed.groupBy("source", "h1", "h2", "id").agg(F.lit(1).alias("one"))
    counts = docs.groupBy("source", "h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    if min_share > 0:
        totals = df.groupBy(F.col(source_col).alias("source")).agg(F.count_distinct(id_col).alias("total"))
        t = totals.alias("t")
        counts = counts.alias("c").join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).where(F.col("docs") >= min_share * F.col("total")).select("c.source", "h1", "h2")
    c = counts.select(F.col("source").alias("s"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    return hashed.join(c, on, "left_semi").select("id", "line_no")


@F.pandas_udf(T.StringType())
def _rebuilt(text: pd.Series, drop: pd.Series) -> pd.Series:
    """Texts without the lines of these numbers, in time linear in their length."""
    out = []
    for t, d in zip(text, drop):
        if t is not None and d is not None:
            gone = set(d)
            t = "\n".join(s for n, s in enumerate(t.split("\n"), 1) if n not in gone)
        out.append(t)
    return pd.Series(out, dtype=object)


def without_lines(df: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """df with `text_col` rebuilt without the lines in `found` (id, line_no). Other columns and rows stay, null texts stay null.

    Rows with equal ids lose the same lines.
    """
    drop = found.groupBy(F.col("id").alias("__drop_id")).agg(F.collect_set("line_no").alias("__drop"))
    return df.join(drop, F.col(id_col) == F.col("__drop_id"), "left").withColumn(text_col, _rebuilt(text_col, "__drop")).drop("__drop_id", "__drop")
