"""Shared helpers of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, shared_dir  # noqa: F401


def open_fs(uri: str):
    """The pyarrow file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of these names renamed, and what brings their names back: an operator may then add its own."""
    mark = "_aside_"
    while any(c.startswith(mark) for c in df.columns):
        mark = "_" + mark
    back = {mark + c: c for c in df.columns if c in names}
    return df.withColumnsRenamed({c: k for k, c in back.items()}), back


def bucket_of(col: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")) % n


def input_bytes(df: DataFrame, col: str = "text") -> int:
    """Bytes of a text column over all rows: partition counts follow it, so tasks stay bounded."""
    return int(df.agg(F.sum(F.octet_length(F.col(col).cast("string")))).first()[0] or 0)


def parts_for(spark: SparkSession, n_bytes: float, each: float) -> int:
    """Tasks of about each bytes, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes // each) + 1)


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= MIX1
        x ^= x >> np.uint64(27)
        x *= MIX2
        x ^= x >> np.uint64(31)
    return x


class WordHashes:
    """64-bit hashes of words, remembered; two generations bound the memory."""

    def __init__(self, limit: int = 250_000):
        self.limit, self.new, self.old = limit, {}, {}

    def __call__(self, words: list) -> np.ndarray:
        import xxhash

        get = self.new.get
        got = [get(w) for w in words]
        if None in got:
            new, old, h = self.new, self.old, xxhash.xxh3_64_intdigest
            for i, v in enumerate(got):
                if v is None:
                    w = words[i]
                    v = new.get(w)
                    if v is None:
                        v = old.get(w)
                        new[w] = v = h(w) if v is None else v
                    got[i] = v
            if len(new) > self.limit:
                self.old, self.new = new, {}
        return np.array(got, dtype=np.uint64)


_KEPT: dict = {}


def keep(name, make: Callable):
    """What make() returns, remembered for the worker process's later tasks under name.

    A process remembers one thing at a time: what another operator (or another model) left in
    it is given back to the system first, so that stages don't add up in an executor's memory.
    """
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drops what this process remembers, and returns freed memory to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch, rows: int = 256):
    """An Arrow batch in small pieces: what is expanded in Python at once stays bounded."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """The path of a public tokenizer; the folder is a parameter, else the installed package's."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
