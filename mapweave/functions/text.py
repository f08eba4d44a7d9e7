"""Text helpers that Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s))


def nfkc(c: Column) -> Column:
    """Unicode NFKC form; meant for header cells, which are few, not for data."""
    return _nfkc(c)
