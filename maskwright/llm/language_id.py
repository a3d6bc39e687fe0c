"""Language identification, word first, backing off to shorter and shorter character n-grams.

A known word scores its log frequency in each language. A word that training has not seen
scores the mean log frequency of its n-grams of the greatest length of which any is known.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, keep, set_aside, slices

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Distinct training texts of each language, about, and how much of them all: beyond that a hash of the text draws.
SAMPLE, SAMPLE_BYTES = 1500, 32 << 20
GRAMS = (5, 4, 3, 2, 1)
#: Words of a text that are looked up together.
BLOCK = 8192


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(word: str) -> list[str]:
    """All n-grams of the padded word."""
    p = f"<{word}>"
    return [p[at : at + k] for k in GRAMS for at in range(len(p) - k + 1)]


class LanguageModel:
    """Log frequencies by language of words and of the n-grams of padded words."""

    def __init__(self, counts: dict[str, dict[str, int]], least: int = 2, remember: int = 150_000, grams: dict[str, dict[str, int]] | None = None):
        """counts: by language, how often each word occurs; words rarer than least are known by n-grams only.

        grams: the same of their n-grams, by gram and language, if counted already. What
        back-off finds for unseen words is remembered, for remember of them at most.
        """
        self.langs, self.remember = sorted(counts), remember
        words: dict[str, dict[str, int]] = defaultdict(dict)
        for lang in self.langs:
            for w, n in counts[lang].items():
                words[w][lang] = n
        if grams is None:
            grams = defaultdict(Counter)
            for w, of in words.items():
                for g in grams_of(w):
                    grams[g].update(of)
        self.words, self.rows = self._table({w: c for w, c in words.items() if sum(c.values()) >= least})
        self.grams = {k: self._table({g: c for g, c in grams.items() if len(g) == k}) for k in GRAMS}
        self.known = len(self.rows)
        self.floor = self.rows.min(axis=0) if self.known else np.zeros(len(self.langs))
        self.unseen: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"unseen": {}, "rows": self.rows[: self.known]}

    def _table(self, counts: dict[str, dict[str, int]]) -> tuple[dict[str, int], np.ndarray]:
        c = np.zeros((len(counts), len(self.langs)))
        for i, lang in enumerate(self.langs):
            c[:, i] = [of.get(lang, 0) for of in counts.values()]
        return dict(zip(counts, range(len(counts)), strict=True)), np.log10((c + 0.1) / (c.sum(axis=0) + 0.1 * max(len(c), 1)))

    def back_off(self, word: str) -> np.ndarray:
        p = f"<{word}>"
        for k in GRAMS:
            number, rows = self.grams[k]
            at = [number[g] for i in range(len(p) - k + 1) if (g := p[i : i + k]) in number]
            if at:
                return rows[at].mean(axis=0)
        return self.floor

    def _number(self, words: list[str]) -> list[int]:
        """Rows of known and remembered words; room is made for all of words at once, so that no row is overwritten that they use."""
        known, unseen = self.words.get, self.unseen
        at = [i if (i := known(w)) is not None else unseen.get(w) for w in words]
        if None not in at:
            return at
        gaps = [j for j, i in enumerate(at) if i is None]
        new = dict.fromkeys(words[j] for j in gaps)
        if len(unseen) + len(new) > self.remember:
            unseen.clear()
            gaps = [j for j, i in enumerate(at) if i is None or i >= self.known]
            new = dict.fromkeys(words[j] for j in gaps)
        if len(self.rows) == self.known:
            self.rows = np.concatenate([self.rows, np.zeros((max(self.remember, BLOCK), len(self.langs)))])
        for w in new:
            i = unseen[w] = self.known + len(unseen)
            self.rows[i] = self.back_off(w)
        for j in gaps:
            at[j] = unseen[words[j]]
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of the likelihood, tempered by the text's length."""
        words = words_of(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        for at in range(0, len(words), BLOCK):
            rows = self._number(words[at : at + BLOCK])
            total += self.rows[rows].sum(axis=0)
        score = total * (np.log(10) / len(words) ** 0.5)
        share = np.exp(score - score.max())
        best = int(share.argmax())
        return self.langs[best], float(share[best] / share.sum())


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learns from text and lang of docs, from about sample distinct texts of each language.

    Texts are drawn by a hash, so copies of one teach once and a language made of copies is
    learned too; one that would take its language over SAMPLE_BYTES is passed over. Rows with a
    null text or lang teach nothing. The bound on the sample bounds the model.
    """
    docs = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).dropna().withColumn("h", F.xxhash64("text"))
    # Of each text a hash and a length, and of each language a row, go about; texts don't.
    scratch = Scratch(docs.sparkSession, "language")
    texts = scratch.write(docs.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("bytes")), "texts")
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    room, picked = dict.fromkeys(sizes, SAMPLE_BYTES), []
    for r in texts.where(F.pmod("h", F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20)).orderBy("h").collect():
        if r["bytes"] <= room[r["lang"]]:
            room[r["lang"]] -= r["bytes"]
            picked.append((r["lang"], r["h"]))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, "lang string, h long"))
    chosen = docs.join(wanted, ["lang", "h"]).dropDuplicates(["lang", "h"])

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for p in parts:
            for text, lang in zip(p["text"], p["lang"], strict=True):
                seen.update((lang, w) for w in words_of(text))
        yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["lang", "word", "n"])

    words = scratch.write(chosen.select("text", "lang").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    places = F.flatten(F.transform(F.array(*map(F.lit, GRAMS)), lambda k: F.transform(F.when(F.length(padded) >= k, F.sequence(F.lit(1), F.length(padded) - k + 1)).otherwise(F.array().cast("array<int>")), lambda at: F.substring(padded, at, k))))
    grams = words.select("lang", F.explode(places).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    counts: dict[str, dict[str, int]] = {k: {} for k in sizes}
    got = words.toArrow()
    for lang, w, n in zip(*(got[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts[lang][w] = n
    of: dict[str, dict[str, int]] = defaultdict(dict)
    got = grams.toArrow()
    for lang, g, n in zip(*(got[c].to_pylist() for c in ("lang", "gram", "n")), strict=True):
        of[g][lang] = n
    return LanguageModel(counts, grams=of)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred (a learned language; ``und`` if text is null or has no letter) and score (0 to 1).

    Other columns stay, but for those two names. Only the text is looked at. A model that has
    learned nothing predicts ``und``. Ties go to the language first in the alphabet.
    """
    import pyarrow as pa

    docs = docs.drop("lang_pred", "score")
    sent, at, name = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), ("language", uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = keep(name, lambda: sent.value)
        for whole in batches:
            for b in slices(whole):
                got = [m.predict(t) for t in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = docs.withColumns({"lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}).schema
    return docs.mapInArrow(run, schema)


def keep_recognised(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """docs whose language is recognised with a share of least or more; columns as they were."""
    aside, back = set_aside(docs, ("lang_pred", "score"))
    found = identify(aside, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*aside.columns).withColumnsRenamed(back)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = bucket_of("doc_id", 3) == 1
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
