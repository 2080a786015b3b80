"""Order-insensitive comparison of result tables."""

import numpy as np
import pandas as pd


def value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return None
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(map(value, v))
    if isinstance(v, (bool, np.bool_)):
        return ("b", bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)) or type(v).__name__ == "Decimal":
        return round(float(v), 9)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=repr)
