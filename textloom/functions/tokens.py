"""Token counts: an estimate from bytes by default, a real encoder where its vocabulary is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import profile


def estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded up; never to be shown as an exact count."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("bigint")


def scaled(count: Column, factor: float | Column) -> Column:
    """An encoding's count times a profile's factor, rounded per file, halves up."""
    return F.round(count.cast("double") * (F.lit(float(factor)) if isinstance(factor, (int, float)) else factor)).cast("bigint")


def counted(text: Column, name: str = "cl100k", encoder: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """Tokens of a text under a profile. `encoder` returns a counting function; it is called once per task, not per batch."""
    factor = profile(name)[2]
    if encoder is None:
        return scaled(estimate(text), factor)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        length = encoder()
        for batch in batches:
            yield batch.map(length, na_action="ignore").astype("Int64")

    return scaled(count(text), factor)


def tiktoken_encoder(encoding: str) -> Callable[[], Callable[[str], int]]:
    """An encoder for `counted`; needs the encoding's vocabulary, which tiktoken loads itself."""

    def make() -> Callable[[str], int]:
        import tiktoken

        known = tiktoken.get_encoding(encoding)
        return lambda text: len(known.encode(text, allowed_special="all"))

    return make
