"""Rows of Spark and DuckDB results in one form, whatever their order."""

import math

import pandas as pd


def canon(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        return repr(round(float(x), 9)) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(one, row)) for row in df.itertuples(index=False))
