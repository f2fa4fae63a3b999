"""Functions whose results must be Python's to the last bit, as Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no such function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratcliff-Obershelp ratio of two strings; 0 where the characters that they share rule out `least`; null for a null."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, match = [], SequenceMatcher(None)
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            match.set_seqs(x, y)
            out.append(match.ratio() if match.quick_ratio() >= least else 0.0)
        return pd.Series(out, dtype="float64")

    return ratio(a, b)


def exact_round(digits: int):
    """Rounding of the exact binary value, ties to even."""

    @F.pandas_udf(DoubleType())
    def rounded(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else round(float(v), digits)).astype("float64")

    return rounded


@F.pandas_udf(StringType())
def quoted(text: pd.Series) -> pd.Series:
    """A text as a Python literal."""
    return text.map(lambda t: None if t is None else repr(t))
