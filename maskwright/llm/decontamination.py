"""Benchmark decontamination by a hash set of normalised test n-grams.

Words are mapped to numbers of the benchmark's vocabulary; only stretches of known words
are hashed window by window, hits in the sorted hash array are verified on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, mix64, set_aside, slices

#: Benchmark text bytes that one set is made of; a larger benchmark is scanned for in several passes.
SET_BYTES = 16 << 20
#: Lower-cases A-Z and turns every ASCII character that is in no word into a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<at:int,end:int>>"
#: Columns that find_contamination() adds.
ADDED = ("n_words", "hits", "items")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class WindowSet:
    """The windows of some items: consecutive words, window of them, or all of a shorter item."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            n = min(window, len(ids))
            for at in range(len(ids) - n + 1 if n else 0):
                self.of.setdefault(tuple(ids[at : at + n]), set()).add(str(item))
        self.hashes = {n: np.unique(self._hash(np.array([k for k in self.of if len(k) == n], np.int64), n)) for n in sorted({len(k) for k in self.of})}

    @staticmethod
    def _hash(windows: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(windows), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * FACTOR + mix64(windows[:, k].astype(np.uint64))
        return h

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The stretches of hit words, and the items whose windows occur."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        hit, items = np.zeros(len(ids) + 1, np.int64), set()
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if len(at):
                windows = np.lib.stride_tricks.sliding_window_view(ids, n)[at]
                h = self._hash(windows, n)
                near = hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h
                for k, w in zip(at[near].tolist(), windows[near].tolist(), strict=True):
                    if found := self.of.get(tuple(w)):
                        items |= found
                        hit[k] += 1
                        hit[k + n] -= 1
        inside = np.concatenate([[False], np.cumsum(hit[:-1]) > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, set_bytes: int = SET_BYTES, keep_text: bool = True) -> DataFrame:
    """docs with n_words long, hits (word stretches [at, end)) and items (item_ids as text).

    docs has text, benchmark has item_id and text; docs' other columns stay, but for those
    three names, text only if keep_text. A null or empty text has no words and no hits. Repeated items share windows.
    An item without words has none. Empty docs: no rows; empty benchmark: no hits.
    """
    import pyarrow as pa

    docs = docs.drop(*ADDED)
    size = int(benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    passes = size // set_bytes + 1
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.lit(None).cast(HITS), "items": F.array().cast("array<string>")})
    at = out.columns.index("text")
    for k in range(passes):
        part = benchmark.select("item_id", F.col("text").cast("string")).where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        windows = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in part.collect()], window))

        schema = out.schema if keep_text or k < passes - 1 else out.drop("text").schema
        kept = [i for i, c in enumerate(out.columns[:-3]) if c in schema.names]

        def run(batches: Iterator[pa.RecordBatch], windows=windows, kept=kept, names=schema.names) -> Iterator[pa.RecordBatch]:
            forget()
            seen = windows.value
            for whole in batches:
                for b in slices(whole):
                    n, hits, items = [], [], []
                    for text, h, i in zip(b.column(at).to_pylist(), b.column(-2 + b.num_columns).to_pylist(), b.column(-1 + b.num_columns).to_pylist(), strict=True):
                        words = words_of(text)
                        spans, found = seen.scan(words)
                        n.append(len(words))
                        hits.append([{"at": x, "end": y} for x, y in _merged([(s["at"], s["end"]) for s in h or []] + spans)])
                        items.append(sorted(found | set(i)))
                    kind = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32())]))
                    yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(n, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))], names=names)

        out = out.mapInArrow(run, schema)
    return out


def contaminated() -> Column:
    """Over find_contamination()'s columns: a twentieth of the words or more are hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["at"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """docs without the contaminated ones, columns as they were."""
    aside, back = set_aside(docs, ADDED)
    return find_contamination(aside, benchmark, window).where(~contaminated()).select(*aside.columns).withColumnsRenamed(back)


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """docs whose texts have lost every hit stretch, from its first word's start to its last word's end."""

    def without(text: str | None, hits) -> str | None:
        if not text or not len(hits):
            return text
        raw = text.encode("utf-8", "surrogatepass")
        word = np.concatenate([[False], np.frombuffer(raw.translate(TABLE), np.uint8) != 32, [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        for s in reversed(hits):
            raw = raw[: edge[2 * s["at"]]] + raw[edge[2 * s["end"] - 1] :]
        return raw.decode("utf-8", "surrogatepass")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([without(t, list(h)) for t, h in zip(texts, hits, strict=True)], dtype=object)

    aside, back = set_aside(docs, ADDED)
    found = find_contamination(aside, benchmark, window)
    return found.withColumn("text", F.when(F.size("hits") > 0, cut("text", "hits")).otherwise(F.col("text"))).select(*aside.columns).withColumnsRenamed(back)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs.select("doc_id", "text"), bench, keep_text=False)
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
