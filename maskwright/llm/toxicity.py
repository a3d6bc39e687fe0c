"""Toxicity: a convolutional text classifier trained in numpy.

Hashed word embeddings, filters of several widths, maximum over the whole text, logistic
output. A start is trained on a bounded draw; from it every task trains on all labelled texts that
it reads, and the tasks' weights are averaged. The scale of the output and the decision thresholds
by language are over all labelled texts kept from training.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, keep, slices
from .decontamination import words_of
from .lm_scoring import BLOBS, _dealt, _map, _write, by_shard, shard_of_hash

BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
#: Bytes of a word's beginning that has an embedding too, shared by the words that begin with it.
PREFIX = 4
#: Distinct labelled texts of each class that the start is trained on, about, and their bytes at most.
SAMPLE, SAMPLE_BYTES = 2000, 32 << 20
#: Texts, and their bytes about, that a task trains on at once; how fast; and steps of a logit in calibration.
CHUNK, CHUNK_BYTES, RATE, GRID = 1024, 4 << 20, 0.002, 64


class TextCnn:
    """score(text) between 0 and 1; the empty text's score comes from the output's bias alone.

    A word's vector is the sum of two hashed embeddings, of the word and of its beginning.
    """

    def __init__(self, seed: int = 7, remember: int = 150_000):
        r = np.random.default_rng(seed)
        self.p = {"emb": r.normal(0, 0.3, (BUCKETS, SIZE)), "out": r.normal(0, 0.3, len(WIDTHS) * FILTERS), "bias": np.zeros(1)}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = r.normal(0, (w * SIZE) ** -0.5, (w, SIZE, FILTERS)), np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.thresholds, self.remember, self.number, self.rows, self.trained = {}, remember, {}, None, 0

    def __getstate__(self):
        return self.__dict__ | {"number": {}, "rows": None}

    @staticmethod
    def ids(words: list[bytes]) -> np.ndarray:
        """The two embeddings of each word."""
        import xxhash

        h = xxhash.xxh3_64_intdigest
        return np.array([(h(w) % BUCKETS, h(w[:PREFIX], 1) % BUCKETS) for w in words], np.int64).reshape(-1, 2)

    def project(self, ids: np.ndarray) -> np.ndarray:
        """What each word adds to each filter at each place in it."""
        every = np.concatenate([self.p[f"w{w}"][j] for w in WIDTHS for j in range(w)], axis=1)
        return self.p["emb"][ids].sum(axis=1) @ every

    def pool(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filters' largest values, 0 at least, over a text's projected words, and where they are (-1: nowhere)."""
        top, where, at = [], [], 0
        for w in WIDTHS:
            n = len(rows) - w + 1
            best, arg = np.zeros(FILTERS, np.float32), np.full(FILTERS, -1)
            if n > 0:
                v = rows[:n, at : at + FILTERS]
                for j in range(1, w):
                    v = v + rows[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
                k = v.argmax(axis=0)
                m = v[k, np.arange(FILTERS)] + self.p[f"b{w}"]
                best, arg = np.where(m > 0, m, 0), np.where(m > 0, k, -1)
            top.append(best)
            where.append(arg)
            at += w * FILTERS
        return np.concatenate(top), np.concatenate(where)

    def logit(self, text: str | None) -> float:
        """Projections of words are remembered; a long text is pooled block by block."""
        words, tops = words_of(text), [np.zeros(len(WIDTHS) * FILTERS, np.float32)]
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192 + max(WIDTHS) - 1]
            got = list(map(self.number.get, part))
            if None in got:
                if self.rows is None or len(self.number) + len(part) > self.remember:
                    self.number, got = {}, [None] * len(part)
                    self.rows = np.empty((self.remember, sum(WIDTHS) * FILTERS), np.float32) if self.rows is None else self.rows
                new = list({w for w, g in zip(part, got, strict=True) if g is None})
                n = len(self.number)
                self.rows[n : n + len(new)] = self.project(self.ids(new))
                self.number.update(zip(new, range(n, n + len(new)), strict=True))
                got = list(map(self.number.get, part))
            tops.append(self.pool(self.rows[got])[0])
        return float(np.max(tops, axis=0) @ self.p["out"] + self.p["bias"][0])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 7, least_steps: int = 800, share: float | None = None) -> None:
        """Adam on the logistic loss over ids() of texts; only the words at the maxima get a gradient. Both classes weigh the same, by their share of label 1 (None: as in labels)."""
        share = float(labels.mean()) if share is None else share
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        step, epochs = 0, max(epochs, -(-least_steps * batch // len(docs)))
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for at in range(0, len(docs), batch):
                g = {k: np.zeros_like(v) for k, v in self.p.items() if k != "emb"}
                words, pulls = [], []
                for d in order[at : at + batch]:
                    h, where = self.pool(self.project(docs[d]))
                    z = np.clip(float(h @ self.p["out"] + self.p["bias"][0]), -30, 30)
                    e = np.float32((1 / (1 + np.exp(-z)) - labels[d]) * weight[d] / batch)
                    g["out"] += e * h
                    g["bias"] += e
                    for i, w in enumerate(WIDTHS):
                        f = np.flatnonzero(where[i * FILTERS : (i + 1) * FILTERS] >= 0)
                        if len(f):
                            back = e * self.p["out"][i * FILTERS + f]
                            found = docs[d][where[i * FILTERS + f][:, None] + np.arange(w)]
                            g[f"b{w}"][f] += back
                            g[f"w{w}"][:, :, f] += (back[:, None, None] * self.p["emb"][found].sum(axis=2)).transpose(1, 2, 0)
                            words.append(found.reshape(-1, 2))
                            pulls.append((back[:, None, None] * self.p[f"w{w}"][:, :, f].transpose(2, 0, 1)).reshape(-1, SIZE))
                step += 1
                fix = rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, v in g.items():
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.001 * (v * v - second[k])
                    self.p[k] -= (fix * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
                if words:
                    k, to = np.unique(np.concatenate(words).T.ravel(), return_inverse=True)
                    v = np.zeros((len(k), SIZE), np.float32)
                    np.add.at(v, to, np.tile(np.concatenate(pulls), (2, 1)))
                    first["emb"][k] += 0.1 * (v - first["emb"][k])
                    second["emb"][k] += 0.001 * (v * v - second["emb"][k])
                    self.p["emb"][k] -= (fix * first["emb"][k] / (np.sqrt(second["emb"][k]) + 1e-8)).astype(np.float32)
        self.number, self.rows = {}, None


def _best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Midway between the two logits where the weighted F1 of what lies above is greatest."""
    order = np.argsort(-logits, kind="stable")
    z, y, w = logits[order], labels[order], weights[order]
    hit, marked = np.cumsum(y * w), np.cumsum(w)
    f1 = 2 * hit / (marked + (labels * weights).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def _logistic(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """a > 0 and b with which 1 / (1 + exp(-(a z + b))) fits y, targets smoothed by the classes' sizes."""
    n1, n0 = (y * weights).sum(), ((1 - y) * weights).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (t - p)) - 1e-2 * (beta - [1.0, 0.0])
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return max(float(beta[0]), 1e-3), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> TextCnn:
    """Learns labels.toxic from all labelled texts of docs, each distinct one once for a class.

    About sample of each class, drawn by a hash of the text and of SAMPLE_BYTES at most, give a
    start; _refine() goes on over all. Three in four texts train; on all the others the output is
    scaled to a probability, and a cut for each language with 20 of either class is kept in
    thresholds. Null labels, and labels without a document, teach nothing; a text with both
    labels, from rows of one doc_id or copies, counts in both classes. Without both classes the
    model stays as it was drawn, with the classes' share as its bias.
    """
    text = F.col("text").cast("string")
    # Only ids and hashes of texts meet all labels.
    known = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"))
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().distinct()
    marked = known.join(marks, "id").groupBy("h", "toxic").agg(F.min(F.struct("id", "bytes")).alias("one")).select("h", "toxic", "one.*")
    marked = Scratch(docs.sparkSession, "toxicity").write(marked, "marked")
    size = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    model = TextCnn()
    if not size.get(0) or not size.get(1):
        model.p["out"][:] = 0
        model.p["bias"][0] = 4.0 if size.get(1) else -4.0
        return model
    share = {k: min(1.0, sample / n) for k, n in size.items()}
    cut = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * (1 << 20)
    # Bounded by the sample's size: first ids, then the texts of those that fit.
    picked, room = [], {0: SAMPLE_BYTES, 1: SAMPLE_BYTES}
    for r in marked.where(F.col("toxic").isin(0, 1) & (F.pmod("h", F.lit(1 << 20)) < cut)).orderBy("h", "toxic").collect():
        if r["bytes"] <= room[r["toxic"]]:
            room[r["toxic"]] -= r["bytes"]
            picked.append((r["id"], r["h"], r["toxic"]))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, marked.select("id", "h", "toxic").schema))
    lang = (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")
    found = docs.select(F.col("doc_id").alias("id"), text.alias("text"), lang).withColumn("h", F.xxhash64("text")).join(wanted, ["id", "h"])
    rows = found.groupBy("h", "toxic").agg(F.min("text").alias("text"), F.min("lang").alias("lang")).select("text", "lang", "toxic", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(4)).alias("fold")).orderBy("h", "toxic").collect()
    y, fold = np.array([r["toxic"] for r in rows], np.float32), np.array([r["fold"] for r in rows])
    train = np.flatnonzero(fold != 0)
    model.fit([model.ids(words_of(rows[i]["text"])) for i in train], y[train])
    pick = _picker(marked, sum(size.values()), Scratch(docs.sparkSession, "toxicity").path("marks"))
    texts = docs.select(F.xxhash64(F.xxhash64(text), F.col("doc_id").cast("string")).alias("key"), F.coalesce(F.pmod(F.xxhash64(text, F.lit(1)), F.lit(4)), F.lit(1)).alias("fold"), text.alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    _refine(model, texts.where("fold <> 0").select("key", "text"), pick, size[1] / (size[0] + size[1]))
    bins = _logits(model, texts.where("fold = 0").select("key", "text", "lang"), pick)
    z, y, weight, lang = (np.array([r[k] for r in bins]) for k in ("z", "toxic", "n", "lang"))
    if len(bins) and 0 < (y * weight).sum() < weight.sum():
        scale, shift = _logistic(z, y, weight)
        model.p["out"] *= np.float32(scale)
        model.p["bias"][0] = model.p["bias"][0] * scale + shift
        z = z * scale + shift
        for k in np.unique(lang):
            at = lang == k
            if min((y * weight)[at].sum(), ((1 - y) * weight)[at].sum()) >= 20:
                model.thresholds[str(k)] = float(1 / (1 + np.exp(-_best_threshold(z[at], y[at], weight[at].astype(float)))))
    return model


def _picker(marked: DataFrame, size: int, root: str):
    """A function of keys (of a text and its id): the places of those that are marked, and 1 or 0 of each; a text with both has two.

    The keys are sorted files that workers map, so no text is shuffled.
    """
    n = 1 << max(0, int(np.ceil(np.log2(max(1, size) / (1 << 20)))))

    def deal(parts):
        for p in parts:
            k = p["key"].to_numpy().view(np.uint64)
            yield _dealt(k, p["toxic"].to_numpy().astype(np.uint8), shard_of_hash(k, n))

    def merge(p):
        import pandas as pd

        k, y = np.concatenate([np.frombuffer(x, "<u8") for x in p["k"]]), np.concatenate([np.frombuffer(x, np.uint8) for x in p["c"]])
        return pd.DataFrame({"shard": p["shard"].iloc[:1], **{f"of{v}": [_write(root, np.unique(k[y == v]))] for v in (0, 1)}})

    keys = marked.where(F.col("toxic").isin(0, 1)).select(F.xxhash64("h", F.col("id").cast("string")).alias("key"), "toxic")
    files = {r["shard"]: r for r in by_shard(keys.mapInPandas(deal, BLOBS), n).applyInPandas(merge, "shard long, of0 string, of1 string").collect()}
    uris = [[files[s][f"of{v}"] if s in files else None for s in range(n)] for v in (0, 1)]

    def pick(keys: np.ndarray) -> list[tuple[int, int]]:
        from .suffix_dedup import _among

        keys = keys.view(np.uint64)
        return [(int(i), v) for v in (0, 1) for i in np.flatnonzero(_among([_map(u, "<u8") for u in uris[v]], keys))]

    return pick


def _refine(model: TextCnn, texts: DataFrame, pick, share: float) -> None:
    """One pass over all marked texts: each task trains the model on its own, and weights are averaged by how many texts it had."""
    import pandas as pd

    parts, shapes = 16, {k: v.shape for k, v in model.p.items()}
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def train(batches):
        import copy

        import pyarrow as pa

        m, n, got, size = copy.deepcopy(sent.value), 0, [], 0

        def step():
            order = np.random.default_rng(n).permutation(len(got))
            m.fit([m.ids(words_of(got[i][0])) for i in order], np.array([got[i][1] for i in order], np.float32), epochs=1, rate=RATE, least_steps=0, share=share)

        for b in batches:
            column = b.column(1)
            for i, v in pick(b.column(0).to_numpy()):
                got.append((column[i].as_py(), v))
                size += len(got[-1][0] or "")
                if len(got) >= CHUNK or size > CHUNK_BYTES:
                    step()
                    n, got, size = n + len(got), [], 0
        if got:
            step()
            n += len(got)
        if n:
            flat = np.array_split(np.concatenate([v.ravel() for v in m.p.values()]), parts)
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int64()), pa.array([n] * parts, pa.int64()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["part", "n", "w"])

    def mean(p):
        total = sum(n * np.frombuffer(w, np.float32).astype(float) for n, w in zip(p["n"], p["w"], strict=True)) / p["n"].sum()
        return pd.DataFrame({"part": p["part"].iloc[:1], "w": [total.astype(np.float32).tobytes()], "n": [int(p["n"].sum())]})

    rows = sorted(texts.mapInArrow(train, "part long, n long, w binary").groupBy("part").applyInPandas(mean, "part long, w binary, n long").collect())
    if rows:
        flat, at = np.concatenate([np.frombuffer(r["w"], np.float32) for r in rows]), 0
        for k, shape in shapes.items():
            n = int(np.prod(shape))
            model.p[k], at = flat[at : at + n].reshape(shape).copy(), at + n
        model.trained = rows[0]["n"]


def _logits(model: TextCnn, texts: DataFrame, pick) -> list:
    """How many marked texts have a logit z (in steps of 1/GRID), by lang and label."""
    import pyarrow as pa

    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            found = pick(b.column(0).to_numpy())
            z = [round(float(np.clip(m.logit(b.column(1)[i].as_py()), -30, 30)) * GRID) / GRID for i, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.float64()), pa.array([v for _, v in found], pa.int64()), pa.array([b.column(2)[i].as_py() for i, _ in found], pa.string())], names=["z", "toxic", "lang"])

    return texts.mapInArrow(run, "z double, toxic long, lang string").groupBy("z", "toxic", "lang").agg(F.count("*").alias("n")).orderBy("z", "toxic", "lang").collect()


def classify(docs: DataFrame, model: TextCnn) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from 0.5 on) and toxic_calibrated (by the cut of the row's lang).

    Only the text bears on the score; a null text counts as empty. Without a lang column, or
    for a language without a cut of its own, the cut is 0.5. Other columns stay, but for those
    three names.
    """
    import pyarrow as pa

    docs = docs.drop("score", "predicted", "toxic_calibrated")
    sent, at, name = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), ("toxicity", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = keep(name, lambda: sent.value)
        for whole in batches:
            for b in slices(whole):
                got = [m.score(t) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], names=[*b.schema.names, "score"])

    out = docs.mapInArrow(run, docs.withColumn("score", F.lit(None).cast("double")).schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    cut = F.lit(0.5)
    if "lang" in docs.columns:
        for k, v in model.thresholds.items():
            cut = F.when(F.col("lang") == k, F.lit(v)).otherwise(cut)
    return out.withColumn("toxic_calibrated", F.col("score") >= cut)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(bucket_of("doc_id", 5) != 0))
    held_out = (bucket_of("doc_id", 5) == 0).alias("held_out")
    return classify(docs.select("doc_id", "text", "lang", held_out), model).select("doc_id", "held_out", "score", "predicted", "toxic_calibrated")
