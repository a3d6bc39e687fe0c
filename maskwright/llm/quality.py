"""Quality: perplexity under Kneser-Ney models of trusted text, and repetition, cut at a quantile of each language.

The models' counts of word pairs lie in sorted shards. Documents' pairs are dealt by shard into
files, and each shard's counts are joined with its pairs: a stored pair adds to its document
what it is likelier than the back-off says. The sums by document are the log probabilities. The
vocabulary, in shards too, is mapped where texts are read.

There are two models, each of one half of the trusted texts (by hash), all of them, and a text is scored by the model
of the other half: no model knows what it scores, so the quantiles are over all trusted
documents and hold for every other one, too. Text that says one thing over and over has no
odd perplexity under word pairs on either side; the share of its pairs that it had before tells it.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StructField, StructType

from .common import Scratch, keep, set_aside, slices
from .lm_scoring import BLOBS, Model, Reader, _dealt, _map, _write, by_shard, shard_of_hash, shard_of_pair, train, words_of
from .suffix_dedup import _among

#: The share of a language's trusted documents that lie under each of its two cuts.
QUANTILE = 0.995


def _half() -> Column:
    """0 or 1 by the text, so that copies are in one half; the bits above those that draw the sample."""
    return F.pmod(F.shiftright(F.xxhash64(F.col("text").cast("string")), 20), F.lit(2))


def _repeats(words: list[bytes]) -> float:
    """The share of a text's word pairs that stand further up in it, too."""
    return 1 - len(set(zip(words, words[1:], strict=False))) / (len(words) - 1) if len(words) > 1 else 0.0


def gains(model: Model, scratch: Scratch) -> list[tuple[str, str] | None]:
    """By shard the files of its pairs and of the log10 of how much likelier each is than by back-off alone."""
    spark, root = scratch.spark, scratch.path("gains")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader(model, pairs=False)
        for p in parts:
            for shard, keys, counts in zip(p["shard"], p["k"], p["c"], strict=True):
                k, c = _map(keys, "<u8"), _map(counts, "<u4").astype(np.int64)
                total, rest = read.context((k >> np.uint64(32)).astype(np.int64))
                low = rest * read.lower((k & np.uint64(0xFFFFFFFF)).astype(np.int64))
                gain = np.log10(np.maximum(c - model.cut[np.minimum(c, 3)], 0) / np.maximum(total, 1) + low) - np.log10(low)
                yield pd.DataFrame({"shard": [shard], "uri": [_write(root, gain)]})

    files = [(s, *f) for s, f in enumerate(model.pairs) if f[0]]
    if not files:
        return [None] * model.shards
    made = spark.createDataFrame(files, "shard long, k string, c string").repartition(len(files)).mapInPandas(run, "shard long, uri string").collect()
    uri = {r["shard"]: r["uri"] for r in made}
    return [(model.pairs[s][0], uri[s]) if s in uri else None for s in range(model.shards)]


def _planes(a: np.ndarray) -> bytes:
    """An array with all first bytes first, then all second bytes: the files' compression finds the empty ones."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: Tokens of which pairs are dealt together.
DEAL = 1_000_000
#: Folders that tasks deal pairs into, at most: files are as many as tasks times these.
FOLDERS = 64
ADDED = ("_chunk", "_row", "_shard", "_part", "_pairs", "_rows", "_base", "_gain", "n_tokens", "perplexity", "repeats")


def perplexity(docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """docs without text, with n_tokens, repeats and perplexity (of a token, the text's end included). Other columns stay, but for those names.

    A null text counts as empty. A model of nothing gives every token the same probability.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs, back = set_aside(docs.drop("n_tokens", "perplexity", "repeats"), ADDED)
    at, others = docs.columns.index("text"), [i for i, c in enumerate(docs.columns) if c != "text"]
    schema = docs.drop("text").withColumns({c: F.lit(None).cast(k) for c, k in (("n_tokens", "long"), ("repeats", "double"), ("_base", "double"), ("_chunk", "string"), ("_row", "int"), ("_shard", "int"), ("_pairs", "binary"), ("_rows", "binary"))}).schema
    schema = StructType([StructField(f.name, f.dataType) for f in schema])  # rows of pairs have no document
    kinds, name = to_arrow_schema(schema), ("quality", uuid.uuid4().hex)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = keep(name, lambda: Reader(model, pairs=False))
        chunk, rows, got, size = uuid.uuid4().hex, 0, [], 0

        def blobs() -> Iterator[pa.RecordBatch]:
            key, row = (np.concatenate(x) for x in zip(*got, strict=True))
            shard = shard_of_pair(key, model.shards, model.hot)
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                mine = mine[np.argsort(key[mine], kind="stable")]
                pairs, of = np.diff(key[mine], prepend=np.uint64(0)), row[mine].astype("<u4")
                last = [None, None, None, chunk, None, int(s), _planes(pairs), _planes(of)]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, kinds.field(j).type) for j in range(len(others))), *(pa.array([x], kinds.field(len(others) + j).type) for j, x in enumerate(last))], names=kinds.names)

        for whole in batches:
            for b in slices(whole):
                texts = [words_of(t) for t in b.column(at).to_pylist()]
                n = np.array([len(t) for t in texts], np.int64)
                w = read.numbers([x for t in texts for x in t])
                first = np.cumsum(n) - n
                v = np.concatenate([[0], w[:-1]])
                v[first] = model.n_types
                every, place = np.unique(np.concatenate([v, w]), return_inverse=True)
                _, rest = read.context(every)
                base = np.log10(rest[place[: len(v)]] * read.lower(np.where(every < model.n_types, every, -1))[place[len(v) :]])
                both = np.flatnonzero((v >= 0) & (w >= 0))
                got.append((v[both].astype(np.uint64) << np.uint64(32) | w[both].astype(np.uint64), np.repeat(np.arange(rows, rows + len(n)), n)[both]))
                size += len(both)
                new = [n, [_repeats(t) for t in texts], np.add.reduceat(base, first), [chunk] * len(n), np.arange(rows, rows + len(n), dtype=np.int32), np.full(len(n), -1, np.int32), [None] * len(n), [None] * len(n)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in others), *(pa.array(x, kinds.field(len(others) + j).type) for j, x in enumerate(new))], names=kinds.names)
                rows += len(n)
                if size > DEAL:
                    yield from blobs()
                    chunk, rows, got, size = uuid.uuid4().hex, 0, [], 0
        if size:
            yield from blobs()

    # Written, so that a task that runs again can't number documents otherwise; a folder a shard, up to so many, and shard after shard in a file.
    part = F.when(F.col("_shard") < 0, -1).otherwise(F.col("_shard") % FOLDERS).alias("_part")
    rows = docs.mapInArrow(deal, schema).select("*", part)
    (rows.sortWithinPartitions("_part", "_shard") if model.shards > FOLDERS else rows).write.partitionBy("_part").option("compression", "zstd").parquet(scratch.path("dealt"))
    dealt = spark.read.schema(StructType([*schema, StructField("_part", IntegerType())])).parquet(scratch.path("dealt"))
    files = gains(model, scratch)

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, have, gain = None, None, None
        for p in parts:
            for shard, chunk, pairs, of in zip(p["_shard"], p["_chunk"], p["_pairs"], p["_rows"], strict=True):
                if files[shard] is None:
                    continue
                if shard != last:
                    last, have, gain = shard, *(_map(f, k) for f, k in zip(files[shard], ("<u8", "<f8"), strict=True))
                key, row = np.cumsum(_from_planes(pairs, "<u8"), dtype=np.uint64), _from_planes(of, "<u4")
                k = np.minimum(np.searchsorted(have, key), len(have) - 1)
                hit = np.flatnonzero(have[k] == key)
                total = np.bincount(row[hit], gain[k[hit]])
                some = np.flatnonzero(total)
                yield pd.DataFrame({"_c": chunk, "_r": some.astype(np.int32), "_g": total[some]})

    sums = dealt.where("_part >= 0").select("_shard", "_chunk", "_pairs", "_rows").mapInPandas(join, "_c string, _r int, _g double")
    # Added in order of size, so that a sum doesn't depend on which shard came first.
    sums = sums.groupBy("_c", "_r").agg(F.aggregate(F.array_sort(F.collect_list("_g")), F.lit(0.0), lambda a, x: a + x).alias("_gain"))
    out = dealt.where("_part = -1").join(sums, (F.col("_chunk") == F.col("_c")) & (F.col("_row") == F.col("_r")), "left")
    score = F.col("_base") + F.coalesce("_gain", F.lit(0.0))
    out = out.withColumn("perplexity", F.pow(F.lit(10.0), -score / F.col("n_tokens")))
    return out.select(*(c for c in docs.columns if c != "text"), "n_tokens", "repeats", "perplexity").withColumnsRenamed(back)


def with_perplexity(docs: DataFrame, models: tuple[Model, Model]) -> DataFrame:
    """docs without text, with n_tokens, repeats and perplexity by the model that hasn't learned the text's half, written."""
    docs, halves = docs.withColumn("text", F.col("text").cast("string")), []
    for h in (0, 1):  # one after the other: the pairs of one half are gone when the other's are dealt
        scratch = Scratch(docs.sparkSession, "quality")
        halves.append(scratch.write(perplexity(docs.where(F.coalesce(_half(), F.lit(0)) == h), models[1 - h], scratch), "scored"))
        scratch.drop("dealt")
        scratch.drop("gains")
    return halves[0].unionByName(halves[1])


def _good(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select(F.col("doc_id").alias("_good")).dropna().distinct()


def trusted(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The texts of all documents with labels.quality 1, one of each row; null texts go.

    The ids' hashes are sorted files that workers map, so no text is shuffled. Spark's hash of
    a long is a bijection; other ids are compared after it, on what is left.
    """
    good, root = _good(labels), scratch.path("good")
    whole = all(isinstance(d.schema[c].dataType, IntegralType) for d, c in ((docs, "doc_id"), (good, "_good")))
    key = lambda c: F.xxhash64(F.col(c).cast("long" if whole else "string"))
    n = 1 << max(0, int(np.ceil(np.log2(max(1, good.count()) / (1 << 20)))))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            h = p["h"].to_numpy().view(np.uint64)
            yield _dealt(h, np.zeros(len(h), np.uint8), shard_of_hash(h, n))

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        h = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in p["k"]]))
        return pd.DataFrame({"shard": p["shard"].iloc[:1], "uri": [_write(root, h)]})

    uris: list = [None] * n
    for r in by_shard(good.select(key("_good").alias("h")).mapInPandas(deal, BLOBS), n).applyInPandas(merge, "shard long, uri string").collect():
        uris[r["shard"]] = r["uri"]

    def pick(batches):
        import pyarrow as pa

        have = [_map(u, "<u8") for u in uris]
        for b in batches:
            yield b.filter(pa.array(_among(have, b.column(0).to_numpy().view(np.uint64))))

    mine = docs.select(key("doc_id").alias("_h"), F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).dropna()
    found = mine.mapInArrow(pick, mine.schema)
    return (found if whole else found.join(good, F.col("_id") == F.col("_good"), "left_semi")).select("text")


def learn(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> tuple[Model, Model]:
    """Models of all documents with labels.quality 1, a half each; with sample, of about so many, drawn by a hash of the text.

    Null texts and labels without a document teach nothing; repeated rows teach each.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    good = trusted(docs, labels, scratch)
    picked = scratch.write(good, "trusted")
    if sample is not None:
        share = int((1 << 20) * min(1.0, sample / max(picked.count(), 1)))
        picked = picked.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share)
    models = tuple(train(picked.where(_half() == h), Scratch(docs.sparkSession, "quality")) for h in (0, 1))
    scratch.drop("trusted")
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()  # else what training shuffled stays until the driver happens to collect its garbage
    return models


def cuts_of(scored: DataFrame, labels: DataFrame, models: tuple[Model, Model]) -> dict[str | None, tuple[float, float]]:
    """The cuts of perplexity and of repeats by language (None: over all), over all trusted documents of a scored table.

    Unless both models have learned there is no cut.
    """
    if not all(m.n_tokens for m in models):
        return {}
    seen = scored.where(F.col("_known")).join(_good(labels), F.col("doc_id") == F.col("_good"), "left_semi").withColumn("lang", F.col("lang").cast("string"))
    cut = [F.percentile_approx(c, QUANTILE, 10_000).alias(c) for c in ("perplexity", "repeats")]
    rows = seen.where("lang IS NOT NULL").groupBy("lang").agg(*cut).collect()  # a row for each language
    whole = seen.agg(*cut).first()
    return {r["lang"]: (r["perplexity"], r["repeats"]) for r in rows} | {None: (whole["perplexity"], whole["repeats"])}


def _scored(docs: DataFrame, models: tuple[Model, Model]) -> DataFrame:
    """doc_id, lang, whether there is a text (_known) and with_perplexity()'s columns, written."""
    rows = docs.select("doc_id", "lang", "text", F.col("text").isNotNull().alias("_known"))
    return with_perplexity(rows, models)


def fit(docs: DataFrame, labels: DataFrame, sample: int | None = None) -> tuple[tuple[Model, Model], dict[str | None, tuple[float, float]]]:
    """The models of learn() and the cuts of cuts_of() over the trusted documents among docs (doc_id, lang, text)."""
    models = learn(docs, labels, sample)
    return models, cuts_of(_scored(docs, models), labels, models)


def decide(scored: DataFrame, cuts: dict[str | None, tuple[float, float]]) -> DataFrame:
    """A scored table with cut, repeats_cut and kept (both up to the cuts of the row's lang).

    A language without trusted documents takes the overall cuts; without any cut every document is kept.
    """
    out = scored
    for side, name in enumerate(("cut", "repeats_cut")):
        cut = F.lit(cuts[None][side] if cuts else None).cast("double")
        for k, v in cuts.items():
            if k is not None:
                cut = F.when(F.col("lang") == k, F.lit(v[side])).otherwise(cut)
        out = out.withColumn(name, cut)
    return out.withColumn("kept", F.coalesce((F.col("perplexity") <= F.col("cut")) & (F.col("repeats") <= F.col("repeats_cut")), F.lit(True)))


def judge(docs: DataFrame, models: tuple[Model, Model], cuts: dict[str | None, tuple[float, float]]) -> DataFrame:
    """docs without text, with n_tokens, perplexity, repeats, cut, repeats_cut and kept.

    A null or empty text has one token, its end; long ones are read whole; repeated rows are
    judged alike; an empty table gives no rows. Other columns stay, but for those names.
    """
    return decide(with_perplexity(docs.drop("cut", "repeats_cut", "kept"), models), cuts)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    models = learn(docs, labels)
    scored = _scored(docs, models)
    return decide(scored, cuts_of(scored, labels, models)).select("doc_id", "n_tokens", "perplexity", "cut", "kept")
