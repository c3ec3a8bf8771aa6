"""Typed values out of text cells; what doesn't parse is null, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_DICE = r"^\s*(\d+)d(\d+)(?:\s*([+-]\s*\d+))?(?:\s*[x×]\s*(\d+))?\s*$"


def number(c: Column) -> Column:
    """A whole number with a sign or thousands separators."""
    return F.regexp_replace(F.trim(c), "[,+]", "").try_cast("int")


def quantity(c: Column) -> Column:
    """(amount, unit) of texts such as "2.2 kg"."""
    return F.struct(
        F.regexp_replace(F.regexp_extract(c, r"^\s*([\d,.]+)", 1), ",", "").try_cast("decimal(12,2)").alias("amount"), F.nullif(F.regexp_extract(c, r"^\s*[\d,.]+\s*(\p{L}+)", 1), F.lit("")).alias("unit")
    )


def bounds(c: Column) -> Column:
    """(lo, hi) of texts such as "0-30 Squares", "8th-14th", "28+", "15th and Higher" (hi null) or "7"."""
    lo = F.regexp_extract(c, r"^\D*?(\d+)", 1).try_cast("int")
    hi = F.regexp_extract(c, r"^\D*?\d+(?:st|nd|rd|th)?\s*[-–]\s*(\d+)", 1).try_cast("int")
    open_ = c.rlike(r"^\D*?\d+(?:st|nd|rd|th)?\s*(?:\+|and\s+(?:Higher|Up|More))")
    return F.struct(lo.alias("lo"), F.when(open_, F.lit(None).cast("int")).otherwise(F.coalesce(hi, lo)).alias("hi"))


def dice(c: Column) -> Column:
    """(n, sides, add, mul) of a dice expression such as "3d8", "6d10x2" or "2d6 + 3"; null for anything else."""
    part = lambda i: F.regexp_extract(c, _DICE, i)
    whole = F.struct(
        part(1).try_cast("int").alias("n"), part(2).try_cast("int").alias("sides"), F.coalesce(F.regexp_replace(part(3), r"\s", "").try_cast("int"), F.lit(0)).alias("add"), F.coalesce(part(4).try_cast("int"), F.lit(1)).alias("mul")
    )
    return F.when(c.rlike(_DICE), whole)


def alternatives(c: Column) -> Column:
    """Dice expressions joined by "or", as an array; parts that are none are left out."""
    return F.filter(F.transform(F.split(c, r"\s+or\s+"), dice), lambda x: x.isNotNull())


def mean_roll(d: Column) -> Column:
    """Expected value of a dice struct."""
    return (d["n"] * (d["sides"] + 1) / 2 + d["add"]) * d["mul"]


def without_footnote(c: Column) -> Column:
    """A name without footnote digits stuck to it."""
    return F.regexp_replace(F.trim(c), r"(?<=\p{L})\d+(?:,\d+)*$", "")


def items(c: Column) -> Column:
    """Parts of a comma- or semicolon-separated cell, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def effects(c: Column) -> Column:
    """A map from name to amount of texts such as "+2 Int, -2 Dex"."""
    parts = F.regexp_extract_all(c, F.lit(r"([+-]\d+)\s+(\p{L}+)"), F.lit(0))
    pair = lambda x: F.struct(F.regexp_extract(x, r"(\p{L}+)$", 1).alias("k"), F.regexp_extract(x, r"^([+-]\d+)", 1).try_cast("int").alias("v"))
    return F.map_from_entries(F.array_distinct(F.transform(parts, pair)))
