"""The engine in SQL: a table function that detects, and functions that mask and check."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import validators as V
from .detectors import Lists
from .masking import find_entities, mask_text
from .rules import Policy


def register(spark: SparkSession, policy: Policy, secret: bytes, lists: Lists | None = None) -> None:
    """Registers pd_detect(text) (a table: pd_type, start, end, score, source), pd_mask(text) and pd_valid(kind, text)."""
    words = lists or Lists()

    @F.udtf(returnType="pd_type string, start bigint, end bigint, score double, source string")
    class Detect:
        def eval(self, text: str) -> Iterator[tuple]:
            if text:
                for e in find_entities(text, policy, words)[1]:
                    yield e.pd_type, e.start, e.end, float(e.score), e.source

    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask_text(t, policy, words, secret).text)

    def valid(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([V.VALIDATORS[k](t) if k in V.VALIDATORS and t is not None else None for k, t in zip(kinds, texts, strict=True)])

    spark.udtf.register("pd_detect", Detect)
    spark.udf.register("pd_mask", F.pandas_udf(mask, "string"))
    spark.udf.register("pd_valid", F.pandas_udf(valid, "boolean"))
