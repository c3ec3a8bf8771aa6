"""Splitting oversized texts at natural boundaries (problem 4).

Recursive bisection: a text that exceeds the limit is cut at the strongest boundary near its
midpoint (section before paragraph before line before sentence before word), and halves that still exceed the limit minus
the overlap are cut again. Overlaps are attached after cutting: each piece but the first begins with the
last `overlap` characters of the piece before, so a part may be `limit - overlap` long.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.sources.tables import spread

#: Boundaries from strongest to weakest; a cut lies at the end of the match.
BOUNDARIES = [
    re.compile(r"\n(?=#{1,6} )"),
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n"),
    re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？]"),
    re.compile(r"\s+"),
]


def _cut(text: str, lo: int, hi: int, room: int) -> int:
    """The place to cut text[lo:hi]: at the strongest kind of boundary that the middle half has, nearest to the midpoint."""
    middle = (lo + hi) // 2
    reach = (hi - lo) // 4
    if hi - lo <= 2 * room:  # then one cut can do, if it leaves no half above the room
        reach = min(max(reach, 1), room - (hi - lo + 1) // 2)
    left, right = max(lo + 1, middle - reach), min(hi - 1, middle + reach)
    for pattern in BOUNDARIES:
        best = None
        for m in pattern.finditer(text, max(lo, left - 200), min(hi, right + 200)):
            at = m.end()
            if left <= at <= right and (best is None or abs(at - middle) < abs(best - middle)):
                best = at
        if best is not None:
            return best
    return middle


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the parts of `text`, in order; one part if the text is within the limit."""
    if len(text) <= limit:
        return [len(text)]
    room, out, stack = limit - overlap, [], [(0, len(text))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= room:
            out.append(hi)
        else:
            at = _cut(text, lo, hi, room)
            stack += [(at, hi), (lo, at)]
    return out


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                lo, ends = 0, cuts(text, limit, overlap)
                for n, hi in enumerate(ends):
                    rows.append((i, n + 1, len(ends), max(0, lo - overlap), hi, text[max(0, lo - overlap) : hi]))
                    lo = hi
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "start", "end", "piece"])

    return run


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = 8000, overlap: int = 200) -> DataFrame:
    """(id, piece_no, n_pieces, start, end, piece) for every row; a text within the limit is one piece.

    Lengths are in Unicode code points. start and end are places in the text; piece_no counts from 1. Null texts have no
    pieces; an empty text is one empty piece. Rows with a null id are left out; rows with equal ids are split on their own. Needs 0 <= overlap < limit / 2.
    A part shorter than the overlap (a boundary stands there) passes on all the text before it that fits, so
    that every piece after the first still begins with the last `overlap` characters of the one before.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("needs 0 <= overlap < limit / 2")
    kind = T.StructType(
        [T.StructField("id", df.schema[id_col].dataType)]
        + [T.StructField(c, T.IntegerType()) for c in ("piece_no", "n_pieces", "start", "end")]
        + [T.StructField("piece", T.StringType())]
    )
    texts = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL"))
    return texts.mapInPandas(_pieces(limit, overlap), kind)
