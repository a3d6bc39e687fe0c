"""Language-model scoring: interpolated modified Kneser-Ney over word pairs, counted in Spark.

Words are known by 64-bit hashes. The model is files in the shared folder: sorted hash
arrays with counts (a word's number is its place in them), arrays of statistics by word
number, and sorted arrays of pairs (context number, word number) with counts. Workers map
the files into memory and search them; no task holds a whole table, and the number of
shards follows the input. Contexts so frequent that one shard would swell are dealt by pair.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, input_bytes, mix64, open_fs, slices

#: Training text bytes for each shard, about.
SHARD_BYTES = 24 << 20
#: Tokens that a task counts before it passes the counts on.
FLUSH = 3_000_000
END = b"\n"  # no word has it
LOW = np.uint64(0xFFFFFFFF)


def words_of(text: str | None) -> list[bytes]:
    """The text's words, A-Z lower-cased, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def hashes_of(words: list[bytes]) -> np.ndarray:
    """Words' 64-bit hashes. To compute one takes less time than to look it up in a large table."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _write(root: str, array: np.ndarray) -> str:
    fs, path = open_fs(root)
    fs.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{path}/{name}") as f:
        f.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
    return f"{root}/{name}"


def _map(uri: str | None, kind: str) -> np.ndarray:
    """The array in a file: mapped into memory where the shared folder is mounted, read elsewhere."""
    if not uri:
        return np.zeros(0, kind)
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        return np.memmap(at.path, dtype=kind, mode="r") if os.path.getsize(at.path) else np.zeros(0, kind)  # an empty file can't be mapped
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        return np.frombuffer(f.read(), kind)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts (one column or several)."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first, axis=0) if len(k) else c


def _dealt(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pd.DataFrame:
    """A row for each shard that has keys."""
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.diff(shard[order])) + 1
    parts = [p for p in np.split(order, edge) if len(p)]
    return pd.DataFrame({"shard": [int(shard[p[0]]) for p in parts], "k": [keys[p].tobytes() for p in parts], "c": [counts[p].tobytes() for p in parts]})


BLOBS = "shard long, k binary, c binary"


def by_shard(blobs: DataFrame, n: int):
    """Groups of rows by shard, dealt to as many tasks as there are shards."""
    many = max(int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n, 100_000))
    return blobs.repartition(many, "shard").groupBy("shard")


@dataclass
class Model:
    """Where the files are, and the totals."""

    shards: int
    words: list = field(default_factory=list)  # (hashes, counts, n) by shard
    stats: list = field(default_factory=list)  # by shard: pairs that end in the word; of those that begin with it, how many occur once, twice, more
    pairs: list = field(default_factory=list)  # (pairs, counts) by shard
    hot: np.ndarray = None  # contexts dealt by pair, ascending
    n_tokens: int = 0
    n_types: int = 0
    n_docs: int = 0
    n_pairs: int = 0
    start: np.ndarray = None  # of the empty context: how many pairs occur once, twice, more
    cut: np.ndarray = None  # discounts of pairs
    cut_low: np.ndarray = None  # discounts of continuation counts
    low_share: float = 1.0  # what they leave for words never seen

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([n for _, _, n in self.words])]).astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney's discounts of counts 0, 1, 2 and more, from how many keys occur 1, 2, 3 and 4 times."""
    n = np.maximum(np.asarray(n, float), 1e-9)
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05 * k), 0.95 * k) for k in (1, 2, 3))])


class Reader:
    """A model's files, mapped: numbers of words, counts and statistics."""

    def __init__(self, model: Model, pairs: bool = True):
        self.m, self.first = model, model.first
        self.hashes = [_map(h, "<u8") for h, _, _ in model.words]
        self.counts = [_map(c, "<i8") for _, c, _ in model.words]
        self.pair_keys = [_map(k, "<u8") for k, _ in model.pairs if pairs]
        self.pair_counts = [_map(c, "<u4") for _, c in model.pairs if pairs]
        self.stats = [_map(s, "<i8").reshape(-1, 4) for s in model.stats]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        shard = shard_of_hash(hashes, self.m.shards)
        for s in np.unique(shard):
            at, have = np.flatnonzero(shard == s), self.hashes[s]
            if len(have):
                k = np.minimum(np.searchsorted(have, hashes[at]), len(have) - 1)
                out[at] = np.where(have[k] == hashes[at], k + self.first[s], -1)
        return out

    def distinct(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the distinct words (-1: training hasn't seen it), and each word's place among them."""
        hashes, place = np.unique(hashes_of(words), return_inverse=True)
        return self._find(hashes), place

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 if training hasn't seen it."""
        numbers, place = self.distinct(words)
        return numbers[place]

    def of_words(self, table: list[np.ndarray], numbers: np.ndarray, width: int) -> np.ndarray:
        """Rows of a table by word number; zeros for -1."""
        out = np.zeros((len(numbers), width), np.int64)
        shard = np.searchsorted(self.first, numbers, "right") - 1
        for s in np.unique(shard[numbers >= 0]):
            at = np.flatnonzero((shard == s) & (numbers >= 0))
            out[at] = table[s][numbers[at] - self.first[s]].reshape(-1, width)
        return out

    def lower(self, words: np.ndarray) -> np.ndarray:
        """The lower order's probability of words by number (-1: unseen), from the words that they follow."""
        m, ends = self.m, self.of_words(self.stats, words, 4)[:, 0]
        return np.maximum(ends - m.cut_low[np.minimum(ends, 3)], 0) / max(m.n_pairs, 1) + m.low_share / (m.n_types + 1)

    def context(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts (n_types: a text's start; -1: unseen) how often each occurs and the share that goes to the lower order."""
        m, inside = self.m, (numbers >= 0) & (numbers < self.m.n_types)
        known = np.where(inside, numbers, -1)
        total, begins = self.of_words(self.counts, known, 1)[:, 0].astype(float), self.of_words(self.stats, known, 4)[:, 1:].astype(float)
        total[numbers == m.n_types], begins[numbers == m.n_types] = m.n_docs, m.start
        return total, np.where(total > 0, begins @ m.cut[1:] / np.maximum(total, 1), 1.0)

    def of_pairs(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        shard = shard_of_pair(pairs, self.m.shards, self.m.hot)
        for s in np.unique(shard):
            at, have = np.flatnonzero(shard == s), self.pair_keys[s]
            if len(have):
                k = np.minimum(np.searchsorted(have, pairs[at]), len(have) - 1)
                out[at] = np.where(have[k] == pairs[at], self.pair_counts[s][k], 0)
        return out


def shard_of_hash(h: np.ndarray, n: int) -> np.ndarray:
    """By the leading bits, so that shard after shard the hashes ascend; n is a power of two."""
    return (h >> np.uint64(64 - n.bit_length() + 1)).astype(np.int64) if n > 1 else np.zeros(len(h), np.int64)


def shard_of_pair(pairs: np.ndarray, n: int, hot: np.ndarray) -> np.ndarray:
    left = pairs >> np.uint64(32)
    return (mix64(np.where(np.isin(left, hot), pairs, left)) % np.uint64(n)).astype(np.int64)


def _pairs_of(numbers: list[np.ndarray], start: int) -> np.ndarray:
    """(context, word) of each token as one integer; the context of a text's first is start."""
    right = np.concatenate(numbers)
    left = np.concatenate([[start], right[:-1]])
    left[np.cumsum([len(x) for x in numbers])[:-1]] = start
    return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)


def train(docs: DataFrame, scratch: Scratch) -> Model:
    """Counts the texts of docs (null: empty) and writes the model's files.

    Every task's counts are summed before they are passed on, and again by shard. Only totals
    and a row for each shard, and each context that holds more than an eighth of a shard's
    tokens (8 * shards at most), come to the driver.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string"))
    n = 1 << max(0, int(np.ceil(np.log2(max(1, input_bytes(texts)) / SHARD_BYTES))))
    m, root = Model(n), scratch.path("model")

    def count_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got, size = [], 0
        for p in parts:
            for at in range(0, len(p), 256):
                words = [w for t in p["text"].iloc[at : at + 256] for w in words_of(t)]
                got.append(hashes_of(words))
                size += len(words)
                if size > FLUSH:
                    k, c = np.unique(np.concatenate(got), return_counts=True)
                    yield _dealt(k, c.astype("<i8"), shard_of_hash(k, n))
                    got, size = [], 0
        if got:
            k, c = np.unique(np.concatenate(got), return_counts=True)
            yield _dealt(k, c.astype("<i8"), shard_of_hash(k, n))

    def merge_words(p: pd.DataFrame) -> pd.DataFrame:
        k, c = _summed([np.frombuffer(x, "<u8") for x in p["k"]], [np.frombuffer(x, "<i8") for x in p["c"]])
        return pd.DataFrame({"shard": p["shard"].iloc[:1], "k": [_write(root, k)], "c": [_write(root, c)], "types": [len(k)], "tokens": [int(c.sum())]})

    rows = {r["shard"]: r for r in by_shard(texts.mapInPandas(count_words, BLOBS), n).applyInPandas(merge_words, "shard long, k string, c string, types long, tokens long").collect()}
    m.words = [(rows[s]["k"], rows[s]["c"], rows[s]["types"]) if s in rows else (None, None, 0) for s in range(n)]
    m.n_tokens, m.n_types = sum(r["tokens"] for r in rows.values()), sum(r["types"] for r in rows.values())
    start = m.n_types  # the number of the context of a text's first word
    limit = max(1, m.n_tokens // (8 * n))

    def frequent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for uri, first in zip(p["uri"], p["first"], strict=True):
                yield pd.DataFrame({"word": np.flatnonzero(_map(uri, "<i8") > limit) + first})

    files = [(c, int(at)) for (_, c, k), at in zip(m.words, m.first, strict=False) if k]
    often = spark.createDataFrame(files, "uri string, first long").repartition(min(max(1, len(files)), 100_000)).mapInPandas(frequent, "word long").collect()
    m.hot = np.array(sorted({*(r["word"] for r in often), start}), np.uint64)

    def count_pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, got, size = Reader(m), [], 0
        for p in parts:
            for at in range(0, len(p), 256):
                texts = [words_of(t) for t in p["text"].iloc[at : at + 256]]
                flat = read.numbers([w for t in texts for w in t])
                got.append(_pairs_of(np.split(flat, np.cumsum([len(t) for t in texts])[:-1]), start))
                size += len(flat)
                if size > FLUSH:
                    k, c = np.unique(np.concatenate(got), return_counts=True)
                    yield _dealt(k, c.astype("<u4"), shard_of_pair(k, n, m.hot))
                    got, size = [], 0
        if got:
            k, c = np.unique(np.concatenate(got), return_counts=True)
            yield _dealt(k, c.astype("<u4"), shard_of_pair(k, n, m.hot))

    def merge_pairs(p: pd.DataFrame) -> pd.DataFrame:
        k, c = _summed([np.frombuffer(x, "<u8") for x in p["k"]], [np.frombuffer(x, "<u4").astype(np.int64) for x in p["c"]])
        left, right = (k >> np.uint64(32)).astype(np.int64), (k & LOW).astype(np.int64)
        row = np.zeros((len(k), 4), np.int64)
        row[np.arange(len(k)), np.minimum(c, 3)] = 1
        v, begin = _summed([left], [row])
        w, end = np.unique(right, return_counts=True)
        number, stats = np.concatenate([v, w]), np.concatenate([begin, np.stack([end, *[np.zeros_like(end)] * 3], axis=1)])
        of = np.where(number == start, n, np.searchsorted(m.first, number, "right") - 1)
        out = _dealt(number.astype("<u4"), stats.astype("<u4"), of)
        of_counts = np.bincount(np.minimum(c, 5), minlength=6)[1:5]
        head = pd.DataFrame({"shard": [-1 - int(p["shard"].iloc[0])], "k": [_write(root, k).encode()], "c": [_write(root, np.minimum(c, LOW).astype("<u4")).encode()], "n": [[len(k), *of_counts.tolist()]]})
        return pd.concat([head, out.assign(n=None)])

    merged = scratch.write(by_shard(texts.mapInPandas(count_pairs, BLOBS), n).applyInPandas(merge_pairs, BLOBS + ", n array<long>"), "pairs")
    heads = {-1 - r["shard"]: r for r in merged.where("shard < 0").collect()}
    m.pairs = [(heads[s]["k"].decode(), heads[s]["c"].decode()) if s in heads else (None, None) for s in range(n)]
    m.n_pairs = sum(r["n"][0] for r in heads.values())
    m.cut = discounts(sum((np.array(r["n"][1:]) for r in heads.values()), np.zeros(4)))

    def merge_stats(p: pd.DataFrame) -> pd.DataFrame:
        s = int(p["shard"].iloc[0])
        k, c = _summed([np.frombuffer(x, "<u4").astype(np.int64) for x in p["k"]], [np.frombuffer(x, "<u4").astype(np.int64).reshape(-1, 4) for x in p["c"]])
        if s == n:
            return pd.DataFrame({"shard": [s], "uri": [None], "n": [c[0].tolist()]})
        full = np.zeros((m.words[s][2], 4), np.int64)
        full[k - m.first[s]] = c
        return pd.DataFrame({"shard": [s], "uri": [_write(root, full)], "n": [np.bincount(np.minimum(full[:, 0], 5), minlength=6)[1:].tolist()]})

    stats = {r["shard"]: r for r in by_shard(merged.where("shard >= 0").select("shard", "k", "c"), n).applyInPandas(merge_stats, "shard long, uri string, n array<long>").collect()}
    scratch.drop("pairs")
    m.stats = [stats[s]["uri"] if s in stats else None for s in range(n)]
    m.start = np.array(stats[n]["n"][1:] if n in stats else [0, 0, 0])
    low = sum((np.array(r["n"]) for s, r in stats.items() if s < n), np.zeros(5))
    m.cut_low = discounts(low[:4])
    m.low_share = float((m.cut_low[1:] * [low[0], low[1], low[2:].sum()]).sum() / m.n_pairs) if m.n_pairs else 1.0
    m.n_docs = int(texts.count())
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score (add-one single words) and score (both log10).

    A null text counts as empty: it has one token, its end. Other columns stay, but for those
    five names. A word that training hasn't seen gets the share that the discounts leave; a
    model trained on nothing gives every token the same.
    """
    import pyarrow as pa

    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*names)
    at, m = docs.columns.index("text"), model

    def of_tokens(read: Reader, words: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and both log10 probabilities of words; texts begin at the places first."""
        every, place = read.distinct(words)  # what depends on one word only is computed once for each
        count, stat = read.of_words(read.counts, every, 1)[:, 0], read.of_words(read.stats, every, 4)
        ends = stat[:, 0]
        low = (np.maximum(ends - m.cut_low[np.minimum(ends, 3)], 0) / max(m.n_pairs, 1) + m.low_share / (m.n_types + 1))[place]
        # As contexts; the last one is a text's start.
        context, total = np.append(every, m.n_types), np.append(count, m.n_docs).astype(float)
        some = np.maximum(total, 1)
        share = np.append(stat[:, 1:].astype(float), [m.start], axis=0) @ m.cut[1:] / some
        before = np.concatenate([[0], place[:-1]])
        before[first] = len(every)
        w, v = every[place], context[before]
        both = np.zeros(len(w), np.int64)
        known = np.flatnonzero((w >= 0) & (v >= 0))
        pair, back = np.unique(v[known].astype(np.uint64) << np.uint64(32) | w[known].astype(np.uint64), return_inverse=True)
        both[known] = read.of_pairs(pair)[back]
        high = np.maximum(both - m.cut[np.minimum(both, 3)], 0) / some[before] + share[before] * low
        p = np.where(total[before] > 0, high, low)
        return count[place], np.log10((count + 1) / (m.n_tokens + m.n_types + 1))[place], np.log10(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(m)
        for whole in batches:
            for b in slices(whole):
                texts = [words_of(t) for t in b.column(at).to_pylist()]
                n = np.array([len(t) for t in texts], np.int64)
                first = np.cumsum(n) - n
                c, base, own = of_tokens(read, [x for t in texts for x in t], first)
                sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), base, own)]
                cols = [pa.array(x, t) for x, t in zip((n, sums[0], np.full(len(n), m.n_tokens), *sums[1:]), (pa.int64(),) * 3 + (pa.float64(),) * 2, strict=True)]
                yield pa.RecordBatch.from_arrays([*(x for i, x in enumerate(b.columns) if i != at), *cols], names=[*(x for i, x in enumerate(b.schema.names) if i != at), *names])

    schema = docs.drop("text").withColumns({x: F.lit(None).cast("double" if "score" in x else "long") for x in names}).schema
    return docs.mapInArrow(run, schema)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = bucket_of("doc_id", 7) == 2
    model = train(docs.where(~held_out), Scratch(spark, "op2"))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
