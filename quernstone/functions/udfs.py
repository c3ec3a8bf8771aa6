"""The user-defined function surface: scalar, vectorised, aggregate and table functions."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.IntegerType())
def doubled_length(s: pd.Series) -> pd.Series:
    return (s.str.len() * 2).astype("Int32")


@F.pandas_udf(T.DoubleType())
def scale(s: pd.Series) -> pd.Series:
    return s * 1.5


@F.pandas_udf(T.DoubleType())
def span(s: pd.Series) -> float:
    return float(s.max() - s.min())


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType())]))
class Words:
    """The blank-separated words of a text, one row each."""

    def eval(self, text: str):
        for word in (text or "").split(" "):
            yield (word,)
