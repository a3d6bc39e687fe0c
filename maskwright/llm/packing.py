"""Best-fit packing by large-item matching.

Items above a third of the capacity stand at most two in a sequence: the largest is matched
with the largest partner that still fits. Smaller ones then go, largest first, into the
tightest gap that takes them. All of it runs on counts per length: a run of equal items in
equal gaps is placed in one step, so the plan's size depends on the capacity, not the data.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, slices, tokenizer_file
from .encoding import PIECES, encoder


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """Where the items of each length go.

    Returns for each length rows (first rank, items a sequence, first sequence, offset), by
    first rank, and the number of sequences: item of rank r in the row's run goes to
    sequence first + (r - rank) // items at offset + (r - rank) % items * length.
    """
    left = {k: int(v) for k, v in counts.items() if v > 0}
    runs: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in left}
    placed = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number of sequences)
    sizes: list[int] = []  # the gaps there are, ascending
    n_seq = 0

    def put(length: int, each: int, first: int, offset: int, items: int) -> None:
        runs[length].append((placed[length], each, first, offset))
        placed[length] += items
        left[length] -= items

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            heapq.heappush(gaps[gap], (first, n))

    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        for b in (b for b in large if b <= min(a, capacity - a)):
            if not left[a]:
                break
            n = left[a] // 2 if a == b else min(left[a], left[b])
            if n:
                if a == b:
                    put(a, 2, n_seq, 0, 2 * n)
                else:
                    put(a, 1, n_seq, 0, n)
                    put(b, 1, n_seq, a, n)
                free(capacity - a - b, n_seq, n)
                n_seq += n
        if n := left[a]:
            put(a, 1, n_seq, 0, n)
            free(capacity - a, n_seq, n)
            n_seq += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(sizes, s)
            if at == len(sizes):
                each = capacity // s
                n = -(-left[s] // each)
                free(capacity, n_seq, n)
                n_seq += n
                continue
            gap = sizes[at]
            first, n = heapq.heappop(gaps[gap])
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            each = gap // s
            full = min(n, left[s] // each)
            offset = capacity - gap
            if full:
                put(s, each, first, offset, full * each)
                free(gap - each * s, first, full)
            if full < n and (rest := left[s]) and rest < each:
                put(s, rest, first + full, offset, rest)
                free(gap - rest * s, first + full, 1)
                full += 1
            free(gap, first + full, n - full)
    return {k: np.array(v, np.int64).reshape(-1, 4) for k, v in runs.items()}, n_seq


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int, remember: int) -> DataFrame:
    """A row for each piece, with its task and its number among the task's pieces of that length."""
    import pyarrow as pa

    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        encode, seen, part = encoder(path, remember), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for b in slices(whole):
                rows = []
                for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                    ids += end
                    n, at, k = len(ids) // 4, 0, 0
                    while at < n:
                        length = (n - at) % capacity or capacity
                        rows.append((doc, k, at, length, crc32(memoryview(ids)[4 * at : 4 * (at + length)]), part, seen[length]))
                        seen[length] += 1
                        at, k = at + length, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, remember: int = PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    docs has doc_id and text; other columns are ignored. A null or empty text is just the
    end id. A document of more than capacity tokens is cut; only its first piece is shorter.
    Rows with equal or null doc_ids are documents of their own. Empty input: no rows.
    A worker remembers twice remember pieces of text, which costs memory and saves time.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(_pieces(docs, tokenizer, capacity, end_id, remember), "pieces")
    each = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    # A row for each length up to capacity at most comes to the driver.
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_packing(counts, capacity)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranked = pieces.join(each.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), ["length", "part"])

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            seq, off = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            length, rank = p["length"].to_numpy(), (p["before"] + p["nth"]).to_numpy()
            for k in np.unique(length):
                at, r = np.flatnonzero(length == k), runs[int(k)]
                row = r[np.searchsorted(r[:, 0], rank[at], "right") - 1]
                d = rank[at] - row[:, 0]
                seq[at], off[at] = row[:, 2] + d // row[:, 1], row[:, 3] + d % row[:, 1] * k
            yield p.drop(columns=["before", "nth", "part"]).assign(sequence_id=seq, offset=off)

    return ranked.mapInPandas(place, "length long, doc_id long, piece int, start long, ids_crc32 long, sequence_id long, offset long").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"))
