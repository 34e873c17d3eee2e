"""Functions on batches whose errors are values of rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def said(error: BaseException) -> str:
    """An exception as the text that goes into tables: its type and its first line, 300 characters at most."""
    lines = str(error).splitlines() or [""]
    return f"{type(error).__name__}: {lines[0][:300]}"


def guarded(function: Callable[..., Any], returns: T.DataType) -> Callable[..., Column]:
    """A pandas function over columns, by rows ``function(*values)``, that returns a struct (value, error) of which one is null.

    Arrays arrive as lists, missing values as None. Whatever ``function``
    raises is the row's error.
    """

    def plain(value: Any) -> Any:
        return list(value) if hasattr(value, "__array__") and not isinstance(value, str) and getattr(value, "ndim", 0) else None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else value

    @F.pandas_udf(T.StructType([T.StructField("value", returns), T.StructField("error", T.StringType())]))
    def run(*columns: pd.Series) -> pd.DataFrame:
        out = []
        for row in zip(*columns, strict=True):
            try:
                out.append((function(*map(plain, row)), None))
            except Exception as e:  # noqa: BLE001  the row's value, whatever it is
                out.append((None, said(e)))
        return pd.DataFrame(out, columns=["value", "error"], dtype=object)

    return run
