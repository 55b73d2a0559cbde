"""Bounded samples that models are fitted on. Everything else in this subpackage covers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows a fitted sample holds at most.
SAMPLE_ROWS = 8_000


def bounded_sample(df: DataFrame, key: Column, columns: list[str], rows: int = SAMPLE_ROWS, where: Column | None = None) -> list[tuple]:
    """About ``rows`` rows, the same ones at every run, chosen by a hash of the key; never more than 1.5 times that many.

    Duplicates of a key are all in or all out; ``where`` leaves out rows of the sample. One pass over the columns, besides
    a count of rows that reads none.
    """
    total = df.count()
    every = max(1, total // rows)
    picked = (df if where is None else df.where(where)).where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(*columns)
    return [tuple(r) for r in picked.limit(rows + rows // 2).collect()]
