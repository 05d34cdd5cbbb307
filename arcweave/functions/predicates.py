"""Predicate filters over value vectors, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wave_predicate(v: Column) -> Column:
    """v >= sin(cos(exp(v) * sin(v)) / (cos((sin(v) + 3) / (exp(v) + 2)) + 4))."""
    x = v.cast("double")
    a, b = F.exp(x), F.sin(x)
    return x >= F.sin(F.cos(a * b) / (F.cos((b + 3) / (a + 2)) + 4))


def wave_on_host(v):
    """:func:`wave_predicate` of a numpy array or pandas series."""
    x = np.asarray(v, np.float64)
    a, b = np.exp(x), np.sin(x)
    return x >= np.sin(np.cos(a * b) / (np.cos((b + 3) / (a + 2)) + 4))


def keep(df: DataFrame, predicate: Callable[[Column], Column], col: str = "value") -> DataFrame:
    return df.where(predicate(F.col(col)))


def kept_count(df: DataFrame, predicate: Callable[[Column], Column], col: str = "value") -> DataFrame:
    return df.agg(F.count_if(predicate(F.col(col))).alias("kept"))


def add_constant(df: DataFrame, col: str, by) -> DataFrame:
    return df.withColumn(col, F.col(col) + F.lit(by))


def keep_with_pandas(df: DataFrame, test: Callable, col: str = "value") -> DataFrame:
    """The slow path for a predicate that has no column form: ``test`` maps a pandas Series to booleans."""
    @F.pandas_udf("boolean")
    def ok(s: pd.Series) -> pd.Series:
        return pd.Series(test(s))

    return df.where(ok(F.col(col)))
