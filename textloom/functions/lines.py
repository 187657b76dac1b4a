"""An index of a text's lines by bytes, and ranges of lines cut out by it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.ArrayType(T.LongType()))
def line_starts(data: pd.Series) -> pd.Series:
    """Byte offset of each line's first byte, of a binary column; none for an empty text, null for null. A final line feed begins no line."""

    def starts(raw: bytes | None) -> np.ndarray | None:
        if raw is None:
            return None
        after = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
        return np.concatenate(([0] if len(raw) else [], after[after < len(raw)])).astype(np.int64)

    return data.map(starts)


def line_range(data: Column, starts: Column, first: Column, count: Column) -> Column:
    """`count` lines from line `first` on (from 1), as a binary with their ends; empty where there are none.

    Only the bytes in question are touched: the index says where they begin and end, so a preview can go anywhere in a long text. Null without data.
    """
    begin = F.get(starts, (F.greatest(first, F.lit(1)) - 1).cast("int"))
    end = F.coalesce(F.get(starts, (F.greatest(first, F.lit(1)) - 1 + F.greatest(count, F.lit(0))).cast("int")), F.octet_length(data).cast("bigint"))
    cut = F.substring(data, (begin + 1).cast("int"), (end - begin).cast("int"))
    return F.when(data.isNotNull(), F.coalesce(cut, F.unhex(F.lit(""))))


def without_end(line: Column) -> Column:
    """A line as text, without its line feed and the carriage return before it."""
    return F.regexp_replace(line.cast("string"), r"\r?\n\z|\r\z", "")
