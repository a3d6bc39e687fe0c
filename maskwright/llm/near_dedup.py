"""Near-duplicate components: banded MinHash candidates, odd sketches, links confirmed on full sets.

Texts with equal shingle sets form a class; only class representatives are compared. In a
bucket (equal minima in one band) every representative is first compared with the smallest.
Buckets that share members make a cluster; a cluster of several components is compared in
blocks across them, so no pair that shares a bucket goes untested unless it is connected already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, keep, mix64, slices
from .components import connected_components

ROWS = 4
#: The most that the chance of missing a link at the threshold may be.
MISS = 1e-6
SKETCH_BITS = 512
#: Members of a bucket that one block holds.
BLOCK = 256
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def shingle_set(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; fewer words: of their whole sequence."""
    if not words:
        return np.zeros(0, np.uint64)
    h, n = hashes(words), min(k, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix64(out * FACTOR + h[i : i + len(out)])
    return np.unique(out)


class Signer:
    """MinHash minima of a set, their band keys and their odd sketch."""

    def __init__(self, bands: int):
        self.a = mix64(np.arange(1, bands * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        self.b = mix64(self.a)
        self.bands = bands

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        with np.errstate(over="ignore"):
            low = np.full(len(self.a), np.iinfo(np.uint64).max)
            for at in range(0, len(shingles), 4096):
                low = np.minimum(low, (shingles[at : at + 4096] * self.a[:, None] + self.b[:, None]).min(axis=1))
            keys = np.arange(self.bands, dtype=np.uint64)
            for col in low.reshape(self.bands, ROWS).T:
                keys = mix64(keys * FACTOR + col)
            bits = np.bincount((mix64(low + self.b) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        return keys.astype(np.int64), np.packbits(bits.astype(np.uint8)).tobytes()


def most_odd_bits(threshold: float, samples: int) -> int:
    """XOR bits beyond which a pair's similarity is under the threshold, six deviations off."""
    differ = samples * (1 - threshold) + 6 * math.sqrt(samples * threshold * (1 - threshold))
    expected = SKETCH_BITS / 2 * (1 - math.exp(-2 * 2 * differ / SKETCH_BITS))
    return math.ceil(expected + 3 * math.sqrt(expected))


def _sets(docs: DataFrame, k: int, bands: int, full: bool) -> DataFrame:
    """Of each document the size and hash of its set, and its signature or (full) the set itself."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, sign = keep("word hashes", WordHashes), Signer(bands)
        for whole in batches:
            for b in slices(whole):
                n, h1, h2, more = [], [], [], []
                for t in b.column(1).to_pylist():
                    s = shingle_set((t or "").encode("utf-8", "surrogatepass").lower().split(), k, hashes)
                    n.append(len(s))
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    h1.append((h >> 64) - (1 << 63))
                    h2.append((h & (1 << 64) - 1) - (1 << 63))
                    more.append(s.tobytes() if full else sign(s) if len(s) else (None, None))
                extra = [pa.array(more, pa.binary())] if full else [pa.array([x[0] for x in more], pa.list_(pa.int64())), pa.array([x[1] for x in more], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *extra], names=["doc_id", "n", "h1", "h2", *(["shingles"] if full else ["bands", "sketch"])])

    schema = "doc_id long, n long, h1 long, h2 long, " + ("shingles binary" if full else "bands array<long>, sketch binary")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                keep = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    keep.append(_linked(x, y, percent))
                yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    s = sets.select("doc_id", "shingles")
    with_a = pairs.join(s.withColumnsRenamed({"doc_id": "a", "shingles": "x"}), "a")
    return with_a.join(s.withColumnsRenamed({"doc_id": "b", "shingles": "y"}), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _similar(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of x and y (sketches as 64-bit words) differ in at most so many bits."""
    bits = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        bits += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return np.nonzero(bits <= most)


def _across(members: DataFrame, most: int, percent: int) -> DataFrame:
    """Links (a, b) between different labels of a cluster.

    members: cluster, rep, label, sketch, shingles. A cluster's largest label is set against
    the others, and these against one another, in blocks: a group never holds more than two
    blocks. Near sketches are confirmed on the full sets at once, so that only links come out;
    of the links between two labels in a pair of blocks, one.
    """
    size = members.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    of = size.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).select("cluster", F.col("top.label").alias("main"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("ga"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("go"))
    m = members.join(of, "cluster").withColumn("is_main", F.col("label") == F.col("main"))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("ga")).otherwise(F.col("go"))).cast("int")
    m = m.withColumn("mine", mine)
    rows = F.sequence(F.lit(0), F.when(F.col("is_main"), F.col("go")).otherwise(F.col("ga")) - 1)
    cols = ["rep", "label", "sketch", "shingles"]
    main = m.withColumn("other", F.explode(rows)).select("cluster", F.when(F.col("is_main"), F.col("mine")).otherwise(F.col("other")).alias("i"), F.when(F.col("is_main"), F.col("other")).otherwise(F.col("mine")).alias("j"), F.col("is_main").alias("left"), *cols)
    rest = m.where("not is_main").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("go") - 1))).select("cluster", (-1 - F.least("mine", "other")).alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"), *cols)

    def compare(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        same = key[1] < 0 and -1 - key[1] == key[2]
        x, y = (p, p) if same else (p[p["left"]], p[~p["left"]])
        out, joined = [], set()
        if len(x) and len(y):
            i, j = _similar(*(np.frombuffer(b"".join(q["sketch"]), np.uint64).reshape(len(q), -1) for q in (x, y)), most)
            lx, ly = x["label"].to_numpy(), y["label"].to_numpy()
            cross = (lx[i] < ly[j]) if same else (lx[i] != ly[j])
            sx, sy = ([np.frombuffer(t, np.uint64) for t in q["shingles"]] for q in (x, y))
            rx, ry = x["rep"].to_numpy(), y["rep"].to_numpy()
            for u, v in zip(i[cross].tolist(), j[cross].tolist(), strict=True):
                if (lx[u], ly[v]) not in joined and _linked(sx[u], sy[v], percent):
                    joined.add((lx[u], ly[v]))
                    out.append((rx[u], ry[v]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    n = 2 * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return main.unionByName(rest).repartition(n, "cluster", "i", "j").groupBy("cluster", "i", "j").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id it is linked with, over any number of links).

    docs has doc_id and text; other columns are ignored. Words are runs of anything but blanks
    and control white space, A-Z lower-cased. A text of fewer than k words is one shingle; a
    null or blank one has none and no links. Rows with one doc_id count as one document; a null
    doc_id is linked with nothing and gets a null component. Empty input: no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    threshold = percent / 100
    bands = bands_for(threshold)
    most = most_odd_bits(threshold, bands * ROWS)
    sig = scratch.write(_sets(docs, k, bands, False), "signatures")
    classes = scratch.write(sig.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    filed = classes.select("rep", F.explode("bands").alias("bucket"))
    pivots = filed.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).where("pivot < last").drop("last")
    members = scratch.write(filed.join(pivots, "bucket"), "members")
    sketches = classes.select("rep", "sketch")
    stars = members.where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = stars.join(sketches.withColumnsRenamed({"rep": "a", "sketch": "x"}), "a").join(sketches.withColumnsRenamed({"rep": "b", "sketch": "y"}), "b")
    near = F.pandas_udf(lambda x, y: pd.Series(np.bitwise_count(np.frombuffer(b"".join(x), np.uint64) ^ np.frombuffer(b"".join(y), np.uint64)).reshape(len(x), -1).sum(axis=1).astype("int32") if len(x) else [], dtype="int32"), "int")
    stars = scratch.write(stars.where(near("x", "y") <= most).select("a", "b"), "stars")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.write(_sets(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi"), k, bands, True), "sets")
    links = scratch.write(_confirm(stars, sets, percent), "star-links")
    labels = scratch.write(connected_components(links, scratch, "stars"), "labels")

    # Whatever shares buckets, over any number of members, is a cluster; those of several labels are looked through.
    clusters = connected_components(members.where("rep != pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), scratch, "clusters")
    labelled = clusters.withColumnsRenamed({"v": "rep", "label": "cluster"}).join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("cluster", "rep", F.coalesce("label", "rep").alias("label"))
    open_ = labelled.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("cluster")
    rest = labelled.join(open_, "cluster", "left_semi").join(classes.select("h1", "h2", "rep", "sketch"), "rep").join(sets.select("h1", "h2", "shingles").dropDuplicates(["h1", "h2"]), ["h1", "h2"])
    more = scratch.write(_across(scratch.write(rest, "open"), most, percent), "pairs")
    for end in ("a", "b"):
        more = more.join(labels.withColumnsRenamed({"v": end, "label": "l"}), end, "left").withColumn(end, F.coalesce("l", end)).drop("l")
    merged = scratch.write(connected_components(scratch.write(more.where("a != b"), "more-links"), scratch, "all"), "merged")
    final = classes.select("h1", "h2", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left").withColumn("v", F.coalesce("label", "rep")).drop("label")
    final = final.join(merged, "v", "left").select("h1", "h2", F.coalesce("label", "v").alias("component"))
    out = sig.select("doc_id", "n", "h1", "h2").join(final, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose component has a smaller doc_id; columns as they were, null doc_ids stay."""
    gone = near_duplicates(docs, k, percent).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
