"""E-20: where a text starts to repeat itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _start(text: str, shortest: int) -> int:
    """First offset whose pattern is followed by two equal copies, shortest pattern lengths first.

    Two copies after the pattern mean text[i:i+2p] equals text[i+p:i+3p], so a
    run of 2p equal characters at distance p is looked for, only in the last
    10 p characters.
    """
    n = len(text)
    if n < shortest * 2:
        return -1
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    for p in range(shortest, min(500, n // 3), 10):
        lo = max(0, n - p * 10)
        same = code[lo : n - p] == code[lo + p :]
        if len(same) < 2 * p:
            continue
        runs = np.concatenate([[0], np.cumsum(same)])
        full = np.flatnonzero(runs[2 * p :] - runs[: -2 * p] == 2 * p)
        full = full[full < n - 2 * p - lo]
        if len(full):
            return int(full[0]) + lo
    return -1


def repetition_start(text: Column, shortest: int = 50) -> Column:
    @F.pandas_udf("long")
    def starts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: -1 if t is None else _start(t, shortest))

    return starts(text)


def repeated(df: DataFrame, text: str, shortest: int = 50) -> DataFrame:
    return df.withColumn("repeats_from", repetition_start(F.col(text), shortest))
