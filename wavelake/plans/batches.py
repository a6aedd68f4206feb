"""Small helpers for pandas batches inside tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import types as T

KINDS = {T.LongType: "int64", T.IntegerType: "int32", T.DoubleType: "float64", T.BooleanType: "bool"}


def empty(schema: T.StructType) -> pd.DataFrame:
    """A batch without rows whose columns still have the right kinds."""
    return pd.DataFrame({f.name: pd.Series([], dtype=KINDS.get(type(f.dataType), object)) for f in schema.fields})


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Text columns as plain objects: Arrow-backed text may come back in chunks, which the way to the JVM refuses."""
    texts = {c: object for c, kind in frame.dtypes.items() if isinstance(kind, pd.StringDtype)}
    return frame.astype(texts) if texts else frame
