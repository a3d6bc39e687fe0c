"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding.

File format, one file a shard: the magic ``FRQ1``, then for each document its control
bytes followed by its data bytes, then a footer of little-endian arrays, the footer's
length (8 bytes) and the magic again. A value is the frequency rank of a token (0: the
most frequent), written in 1 to 4 bytes; a control byte holds the lengths of four
values, less one, in two bits each. ``ranks.u32`` maps ranks to ids; the table ``manifest``
lists the shards in ascending doc_id order with the position of their first id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, input_bytes, open_fs, parts_for, slices, tokenizer_file
from .encoding import TextEncoder, encoder

MAGIC = b"FRQ1"
#: Text bytes a shard holds, about.
SHARD_BYTES = 64 << 20
#: Shards whose positions are summed in one task.
RUN = 4096
#: For each control byte, the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = size
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by looking up each control byte in LENGTHS."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenise(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    import pyarrow as pa

    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        wide = encode.vocab_size > 1 << 16
        for whole in batches:
            for b in slices(whole):
                ids = [x + end for x in encode(b.column(1).to_pylist())]
                if not wide:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids binary")


def token_counts(ids: DataFrame, vocab_size: int) -> DataFrame:
    """How often each token occurs; a task sends a row for each token it has met at most."""
    width = "<u4" if vocab_size > 1 << 16 else "<u2"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocab_size, np.int64)
        for p in parts:
            for at in range(0, len(p), 256):
                total += np.bincount(np.frombuffer(b"".join(p["ids"].iloc[at : at + 256]), width), minlength=vocab_size)
        token = np.flatnonzero(total)
        yield pd.DataFrame({"token": token, "n": total[token]})

    return ids.select("ids").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def encode_corpus(docs: DataFrame, tokenizer: str, out: str, end_id: int | None = 1) -> dict:
    """Writes the ids of all documents under the URI out and returns how many shards, ids and ranks there are.

    docs has doc_id and text; other columns are ignored. A null or empty text gives just
    the end id. Documents stand in ascending doc_id order, a null doc_id first; equal
    doc_ids are kept, in the order of a hash of their ids. Empty input: no shards.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-ids")
    vocab = max(TextEncoder(tokenizer).vocab_size, (end_id or 0) + 1)
    ids = scratch.write(_tokenise(docs, tokenizer, end_id), "ids")
    # A row for each token of the vocabulary at most comes to the driver.
    ranked = [r["token"] for r in token_counts(ids, vocab).orderBy(F.desc("n"), "token").collect()]
    rank_of = np.zeros(vocab, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    width = "<u4" if vocab > 1 << 16 else "<u2"

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, null, n, sizes, f = [], [], [], [], None
        for p in parts:
            if f is None:
                name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.frq"
                fs, root = open_fs(out)
                fs.create_dir(root, recursive=True)
                f = fs.open_output_stream(f"{root}/{name}")
                f.write(MAGIC)
            for x in p["ids"]:
                values = np.frombuffer(x, width)
                c, d = encode_values(rank_of[values])
                f.write(c)
                f.write(d)
                sizes.append((len(c), len(d)))
                n.append(len(values))
            null.append(p["doc_id"].isna().to_numpy())
            doc.append(p["doc_id"].fillna(0).to_numpy(np.int64))
        if f is not None:
            n_docs, counts = len(n), np.array(n, np.int64)
            foot = np.int64(n_docs).tobytes() + np.concatenate(doc).tobytes() + np.concatenate(null).astype(np.uint8).tobytes() + counts.tobytes() + np.array(sizes, np.int64).tobytes()
            f.write(foot + np.int64(len(foot)).tobytes() + MAGIC)
            f.close()
            yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "name": [name], "n_docs": [n_docs], "n_ids": [int(counts.sum())]})

    n_shards = parts_for(spark, input_bytes(docs), SHARD_BYTES)
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), "ids"]
    shards = ids.repartitionByRange(n_shards, *by[:2]).sortWithinPartitions(*by)
    made = scratch.write(shards.mapInPandas(write, "shard long, name string, n_docs long, n_ids long").withColumn("run", F.floor(F.col("shard") / RUN)), "shards")
    # A row for each run of shards comes to the driver.
    runs = made.groupBy("run").agg(F.sum("n_ids").alias("n"), F.count("*").alias("shards")).orderBy("run").collect()
    starts = spark.createDataFrame([(r["run"], at) for r, at in zip(runs, accumulate((r["n"] for r in runs), initial=0), strict=False)], "run long, before long")
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("run").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    made.join(F.broadcast(starts), "run").withColumn("start", F.col("before") + inside).drop("run", "before").write.mode("overwrite").parquet(f"{out}/manifest")
    fs, root = open_fs(out)
    with fs.open_output_stream(f"{root}/ranks.u32") as f:
        f.write(np.array(ranked, "<u4").tobytes())
    scratch.drop("shards")
    scratch.drop("ids")
    return {"n_shards": sum(r["shards"] for r in runs), "n_ids": sum(r["n"] for r in runs), "n_ranks": len(ranked)}


def read_corpus(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, unsigned 32-bit) of each document, from the files;
    with digest, ids_crc32 of the decoded ids in their place."""
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    shards = spark.read.schema("name string, start long").parquet(f"{out}/manifest")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = open_fs(out)
        with fs.open_input_stream(f"{root}/ranks.u32") as f:
            id_of = np.frombuffer(f.read(), "<u4")
        for p in parts:
            for name, start in zip(p["name"], p["start"], strict=True):
                for part in _read_shard(fs, f"{root}/{name}", start, id_of):
                    yield part.assign(ids_crc32=part["ids"].map(crc32)).drop(columns="ids") if digest else part

    return shards.repartition(min(max(1, shards.count()), 100_000)).mapInPandas(run, schema)


def _read_shard(fs, path: str, start: int, id_of: np.ndarray, rows: int = 2000) -> Iterator[pd.DataFrame]:
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 12)
        foot_len, magic = int(np.frombuffer(f.read(8), "<i8")[0]), f.read(4)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        f.seek(size - 12 - foot_len)
        foot = f.read(foot_len)
        m = int(np.frombuffer(foot, "<i8", 1)[0])
        doc = np.frombuffer(foot, "<i8", m, 8)
        null = np.frombuffer(foot, np.uint8, m, 8 + 8 * m)
        n = np.frombuffer(foot, "<i8", m, 8 + 9 * m)
        sizes = np.frombuffer(foot, "<i8", 2 * m, 8 + 17 * m).reshape(-1, 2)
        starts = start + np.cumsum(n) - n
        f.seek(len(MAGIC))
        for at in range(0, m, rows):
            ids = [id_of[decode_values(f.read(c), f.read(d), k)].astype("<u4").tobytes() for (c, d), k in zip(sizes[at : at + rows], n[at : at + rows], strict=True)]
            yield pd.DataFrame({"doc_id": pd.array(doc[at : at + rows], "Int64").copy(), "start": starts[at : at + rows], "n_tokens": n[at : at + rows], "ids": ids}).assign(doc_id=lambda x, q=null[at : at + rows]: x["doc_id"].mask(q.astype(bool)))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes documents into files and returns each document's digest from them."""
    scratch = Scratch(spark, "op1")
    out = scratch.path("corpus")
    encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("word_bpe_49k.json"), out, end_id=1)
    return read_corpus(spark, out, digest=True)
