"""Whole tables through the engine: detect, mask, demask, check, in batches of Arrow rows.

Every step is per document, so none of these plans shuffles. Only the text column and the
columns kept go through Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validators as V
from ..functions.spans import found_in
from ..functions.text import Document, normalize_col
from ..operators import json_paths, masking
from ..operators.detectors import DETECTORS, Lists
from ..operators.rules import Policy

ENTITIES = "array<struct<type:string,start:long,end:long,masked_start:long,masked_end:long,replacement:string,score:double,source:string>>"
ENTRIES = "array<struct<key:string,pd_type:string,original:string,masked:string>>"


def _with(df: DataFrame, columns: dict[str, str], f: Callable[[tuple], tuple], uses: list[str]) -> DataFrame:
    """df with columns that f makes of a row's values of uses."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    df = df.drop(*columns)
    schema = df.withColumns({k: F.lit(None).cast(v) for k, v in columns.items()}).schema
    kinds = to_arrow_schema(schema)
    at = [df.columns.index(c) for c in uses]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                rows = [f(r) for r in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
                new = [pa.array([r[i] for r in rows], kinds.field(len(b.columns) + i).type) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=kinds.names)

    return df.mapInArrow(run, schema)


def mask_documents(df: DataFrame, policy: Policy, secret: bytes, text: str = "text", lists: Lists | None = None, extra: tuple = (), dry_run: bool = False) -> DataFrame:
    """df with masked, entities and entries (what restores the text). A null text stays null."""
    lists = lists or Lists()

    def one(row: tuple) -> tuple:
        if row[0] is None:
            return None, [], []
        m = masking.mask_text(row[0], policy, lists, secret, extra=extra, dry_run=dry_run)
        return m.text, m.entities, m.entries

    return _with(df, {"masked": "string", "entities": ENTITIES, "entries": ENTRIES}, one, [text])


def demask_documents(df: DataFrame, text: str = "masked") -> DataFrame:
    """df with demasked, restored and unresolved, by the row's entries."""

    def one(row: tuple) -> tuple:
        return (None, 0, 0) if row[0] is None else masking.demask_text(row[0], row[1] or [])

    return _with(df, {"demasked": "string", "restored": "long", "unresolved": "long"}, one, [text, "entries"])


def leaks(df: DataFrame, policy: Policy, text: str = "masked", lists: Lists | None = None) -> DataFrame:
    """pd_type and leaks: what detectors still see in masked texts, before any threshold."""
    lists = lists or Lists()
    seen = _with(df.select(text), {"types": "array<string>"}, lambda r: (masking.leaks(r[0] or "", policy, lists),), [text])
    return seen.select(F.explode("types").alias("pd_type")).groupBy("pd_type").agg(F.count("*").alias("leaks"))


def summarise(df: DataFrame) -> DataFrame:
    """df with types (how many entities of each type, by type) and spans (type, start and end, by place), of its entities."""
    names = F.array_sort(F.array_distinct(F.col("entities.type")))
    count = F.transform(names, lambda t: F.struct(t.alias("type"), F.size(F.filter("entities", lambda e: e["type"] == t)).alias("n")))
    spans = F.transform("entities", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type")))
    return df.withColumns({"types": F.map_from_entries(count), "spans": F.array_sort(spans)})


def explode_entities(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode("entities").alias("e")).select(*keep, "e.*")


def mask_json(df: DataFrame, paths: list[str], policy: Policy, secret: bytes, body: str = "body", lists: Lists | None = None) -> DataFrame:
    """df with masked and entries: strings at the paths of a JSON body are masked under one numbering.

    A body that isn't JSON becomes null, with the reason in error; nothing goes out unmasked.
    """
    lists = lists or Lists()

    def one(row: tuple) -> tuple:
        state, entries = masking.State(), []

        def mask(s: str) -> str:
            m = masking.mask_text(s, policy, lists, secret, state)
            entries.extend(m.entries)
            return m.text

        def reserve(s: str) -> str:
            state.reserve(s)
            return s

        try:
            json_paths.replace_strings(row[0], paths, reserve)
            return json_paths.replace_strings(row[0], paths, mask), entries, None
        except (TypeError, json.JSONDecodeError) as e:
            return None, [], f"bad_json: {e}"

    return _with(df, {"masked": "string", "entries": ENTRIES, "error": "string"}, one, [body])


def demask_json(df: DataFrame, paths: list[str], body: str = "body") -> DataFrame:
    """df with demasked: strings at the paths of a JSON body restored by the row's entries."""

    def one(row: tuple) -> tuple:
        met: dict[str, int] = {}
        try:
            return (json_paths.replace_strings(row[0], paths, lambda s: masking.demask_text(s, row[1] or [], met)[0]),)
        except (TypeError, json.JSONDecodeError):
            return (None,)

    return _with(df, {"demasked": "string"}, one, [body, "entries"])


def extract_json(df: DataFrame, path: str, body: str = "body") -> DataFrame:
    return _with(df, {"strings": "array<string>"}, lambda r: (json_paths.extract_strings(r[0], path) if r[0] else [],), [body])


def mask_batch(df: DataFrame, policy: Policy, secret: bytes, lists: Lists | None = None) -> DataFrame:
    """request_id, results and error of each request with texts, in one pass and without a shuffle.

    Each text is a session of its own, order kept; a null one has no result, but the error
    bad_request, and doesn't touch the others. Without texts (null) the request is a
    bad_request; with none, results are empty. Where there is a system_id, a request without
    one is unauthorized. No request is lost.
    """
    lists = lists or Lists()
    if "system_id" not in df.columns:
        df = df.withColumn("system_id", F.lit(""))

    def item(index: int, text: str | None) -> dict:
        if text is None:
            return {"index": index, "masked": None, "entities": 0, "error": "bad_request"}
        m = masking.mask_text(text, policy, lists, secret)
        return {"index": index, "masked": m.text, "entities": len(m.entities), "error": None}

    def one(row: tuple) -> tuple:
        if row[1] is None:
            return None, "unauthorized"
        if row[0] is None:
            return None, "bad_request"
        return [item(i, t) for i, t in enumerate(row[0])], None

    kinds = {"results": "array<struct<index:int,masked:string,entities:int,error:string>>", "error": "string"}
    return _with(df.select("request_id", "texts", "system_id"), kinds, one, ["texts", "system_id"]).select("request_id", "results", "error")


#: Texts whose characters keep their bytes when normalised: ASCII, and letters of Latin-1 and of Russian.
_UNFOLDED = r"^[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u0401\u0410-\u044F\u0451]*$"


def _spans(text: Column, name: str, nth: int, keep=None) -> Column:
    """array<struct<start, end, value>>: bytes of the original, and the normalised match.

    The JVM does it where nothing changes places under normalisation; other texts go to the detector.
    """
    pattern = DETECTORS[name][nth][1]
    plain = F.coalesce(text.rlike(_UNFOLDED), F.lit(True))

    @F.pandas_udf("array<struct<start:long,end:long,value:string>>")
    def folded(texts: pd.Series) -> pd.Series:
        docs = [None if t is None else Document(t) for t in texts]
        return pd.Series([[] if d is None else [{"start": c.start, "end": c.end, "value": d.norm[c.n_start : c.n_end]} for c in pattern(d, Lists())] for d in docs])

    return F.when(plain, found_in(normalize_col(text), pattern.regex, pattern.gate, keep)).otherwise(folded(F.when(~plain, text)))


def email_spans(text: Column) -> Column:
    return _spans(text, "email", 0)


def card_spans(text: Column) -> Column:
    return _spans(text, "card_number", 0, V.luhn_col)


def phone_spans(text: Column) -> Column:
    """International numbers."""
    return _spans(text, "phone", 1, lambda v: F.length(V.digits_col(v)).between(8, 15))


def date_spans(text: Column) -> Column:
    return _spans(text, "date", 0, V.date_col)


def recognise(df: DataFrame, engine: Callable[[list[str]], list[list[dict]]], text: str = "text") -> DataFrame:
    """Hands texts to an external recogniser, batch by batch. It returns label, start, end (bytes) and
    score of each find; persons become FIO, places ADDR_CITY, scores count nine tenths. Its failure
    degrades the batch: no finds, degraded true."""
    kinds = {"PER": "FIO", "LOC": "ADDR_CITY"}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            try:
                found, bad = engine([t or "" for t in p[text]]), False
            except Exception:  # noqa: BLE001  whatever the engine raises, the texts go on without it
                found, bad = [[]] * len(p), True
            p["candidates"] = [[{"pd_type": kinds[f["label"]], "start": f["start"], "end": f["end"], "score": f["score"] * 0.9} for f in fs if f["label"] in kinds] for fs in found]
            p["degraded"] = bad
            yield p

    schema = df.withColumns({"candidates": F.lit(None).cast("array<struct<pd_type:string,start:long,end:long,score:double>>"), "degraded": F.lit(False)}).schema
    return df.mapInPandas(run, schema)
