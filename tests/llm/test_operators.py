"""The training-data operators against brute force, and on awkward rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from maskwright.llm import components, decontamination, encoding, language_id, lm_scoring, near_dedup, packing, quality, suffix_dedup, token_ids, toxicity, vector_search
from maskwright.llm.common import Scratch, tokenizer_file

DOC = "doc_id long, text string, score double, n long, text_bytes string"
WORDS = "the of and to in that with from tree river stone cloud house green quick little under over away below".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing", "est"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, blanks, repeats, copies, near copies, shared passages, long and odd texts; extra columns with names of results."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    near = base[0].split()
    near[5] = "changed"
    shared = prose(rng, 90)
    texts = [None, "", " ", "a", "Ünïcode ñ 日本 語 😀 " * 8, *base, *base[:6], " ".join(near), prose(rng, 30) + " " + shared + " " + prose(rng, 20), shared + prose(rng, 50), prose(rng, 4000), "ab" * 700, "word " * 300, "word " * 300]
    return [(i * 7 % 211, t, 0.5, 1, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOC)


# 1: token ids


def test_values_come_back():
    v = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(v) + 1):
        c, d = token_ids.encode_values(v[:n])
        assert len(c) == -(-n // 4) and (token_ids.decode_values(c, d, n) == v[:n]).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(rows, name):
    e = encoding.TextEncoder(tokenizer_file(name), limit=50)
    odd = ["", " a", "a ", "a\nb", "a \n b", "a  b", "\n\nx\n", "it's don't, x!", "<|endoftext|>,", "a <|endoftext|>  b", "a\x1cb", "İ ΑΣ é ﬁ", "x y", "A.B,C é. ²."]
    texts = [r[1] for r in rows] + odd
    for t, got in zip(texts, e(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_over_awkward_characters(name):
    rng = random.Random(21)
    e = encoding.TextEncoder(tokenizer_file(name), limit=3000)
    odd = [*"abcXYZ .,;:!?'\n\t-019 ", *"İıŞßÀéÿªºµΣςσ日ﬁ½²№қक़ǅẞŉǰΐﬃΩ😀", "\u0301", "\u0307", "\u200b", "\u0085", "\xa0", "\u3000", "\x1c", "<|endoftext|>", "'s", "the ", *(chr(rng.randrange(0x20, 0x3000)) for _ in range(60))]
    for _ in range(150):
        texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(64)]
        for t, got, want in zip(texts, e(texts), e.tok.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, repr(t)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_asks_the_model_once_for_a_word_and_its_marks(name):
    e = encoding.TextEncoder(tokenizer_file(name))
    asked, whole = [], e._encode
    e._encode = lambda texts: asked.extend(texts) or whole(texts)
    texts = ["Hier größere***, größere&&& und größere.%%% größere$$$", "Größere### ÀÉª*** straße&&&'s straße*'t a<|endoftext|>*** 日本 STRASSE&&& ÉTÉ"]
    for t, got in zip(texts, e(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.tok.encode(t, add_special_tokens=False).ids
    assert not any("größere" in x and x != "größere" for x in asked)


def test_token_files(spark, docs, rows):
    out = Scratch(spark, "t").path("ids")
    tok = encoding.TextEncoder(tokenizer_file("word_bpe_49k.json"))
    manifest = token_ids.encode_corpus(docs, tokenizer_file("word_bpe_49k.json"), out)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in token_ids.read_corpus(spark, out).collect()), key=lambda r: r[1])
    want = {i: np.array(tok.tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t, *_ in rows}
    assert [g[0] for g in got] == sorted(want)
    at = 0
    for i, start, n, ids in got:
        assert start == at and ids == want[i] and n == len(ids) // 4
        at += n
    assert manifest["n_ids"] == at
    none = Scratch(spark, "t").path("none")
    token_ids.encode_corpus(empty(spark), tokenizer_file("word_bpe_49k.json"), none)
    assert token_ids.read_corpus(spark, none).count() == 0
    ties = spark.createDataFrame([(None, "b"), (1, "x"), (1, "a")], "doc_id long, text string")
    token_ids.encode_corpus(ties, tokenizer_file("word_bpe_49k.json"), out + "2")
    assert [r["doc_id"] for r in token_ids.read_corpus(spark, out + "2").orderBy("start").collect()] == [None, 1, 1]


# 2: language model


def test_kneser_ney_equals_its_formula(spark, docs, rows):
    train = [r for r in rows if r[0] % 3]
    model = lm_scoring.train(docs.where("doc_id % 3 != 0"), Scratch(spark, "lm"))
    assert model.n_tokens == sum(len(lm_scoring.words_of(r[1])) for r in train)
    uni, pairs = collections.Counter(), collections.Counter()
    for r in train:
        w = lm_scoring.words_of(r[1])
        uni.update(w)
        pairs.update(zip([None, *w], w, strict=False))
    begins, ends = collections.defaultdict(list), collections.Counter(w for _, w in pairs)
    for (v, _), c in pairs.items():
        begins[v].append(c)
    of = lambda counts: [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    cut, low_cut = lm_scoring.discounts(of(pairs.values())), lm_scoring.discounts(of(ends.values()))
    left = sum(low_cut[min(c, 3)] for c in ends.values()) / len(pairs)

    def prob(v, w):
        low = max(ends[w] - low_cut[min(ends[w], 3)], 0) / len(pairs) + left / (len(uni) + 1)
        if v not in begins:
            return low
        total = sum(begins[v])
        return max(pairs[v, w] - cut[min(pairs[v, w], 3)], 0) / total + sum(cut[min(c, 3)] for c in begins[v]) / total * low

    got = {r["doc_id"]: r for r in lm_scoring.score(docs, model).collect()}
    for i, t, *_ in rows:
        w = lm_scoring.words_of(t)
        assert math.isclose(got[i]["score"], sum(math.log10(prob(a, b)) for a, b in zip([None, *w], w, strict=False)), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(got[i]["base_score"], sum(math.log10((uni[x] + 1) / (model.n_tokens + len(uni) + 1)) for x in w), rel_tol=1e-9)
        assert got[i]["n_known"] == sum(uni[x] > 0 for x in w) and got[i]["n_tokens"] == len(w)
    assert abs(sum(prob("the" and b"the", w) for w in uni) + prob(b"the", b"never seen") - 1) < 1e-9


def test_language_model_of_nothing(spark, docs):
    model = lm_scoring.train(empty(spark), Scratch(spark, "lm"))
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in lm_scoring.score(docs, model).collect())
    assert lm_scoring.score(empty(spark), model).count() == 0


def test_language_model_keeps_no_table_of_words(spark, docs, rows):
    """Numbers come from the files, in any order of words; nothing is remembered that grows with the words met."""
    model = lm_scoring.train(docs, Scratch(spark, "lm"))
    read = lm_scoring.Reader(model)
    words = [w for r in rows for w in lm_scoring.words_of(r[1])] + [b"never", b"seen", b"never"]
    before = {k: len(v) for k, v in vars(read).items() if hasattr(v, "__len__")}
    got = read.numbers(words)
    assert before == {k: len(v) for k, v in vars(read).items() if hasattr(v, "__len__")}
    every = sorted({*words} - {b"never", b"seen"}, key=lambda w: int(lm_scoring.hashes_of([w])[0]))
    number = dict(zip(every, range(len(every)), strict=True))
    assert got.tolist() == [number.get(w, -1) for w in words]
    assert len(read.numbers([])) == 0


# 3: language ID


def test_languages(spark):
    rng = random.Random(5)
    tongue = {"en": "the and of that with house".split(), "de": "der und die nicht haus straße".split(), "fr": "le et la maison très école".split()}
    data = [(i, " ".join(rng.choices(tongue[k], k=rng.randint(3, 30))), k) for i in range(150) for k in [rng.choice(list(tongue))]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 3 != 1"))
    got = language_id.identify(df.where("doc_id % 3 = 1"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "123 !", "z"), (4, "日本", "q"), (5, "Häuser " * 5000, "q")], "doc_id long, text string, lang_pred string")
    got = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in tongue and all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_unseen_words_fall_back_and_memory_is_bounded():
    m = language_id.LanguageModel({"en": {"house": 5, "the": 9}, "de": {"haus": 5, "der": 9}}, remember=4)
    assert m.predict("houses")[0] == "en" and m.predict("hauses")[0] == "de"
    text = " ".join(f"haus{chr(97 + i)}" for i in range(20))
    big = language_id.LanguageModel({"en": {"house": 5, "the": 9}, "de": {"haus": 5, "der": 9}})
    (lang, score), (want, sure) = m.predict(text), big.predict(text)
    assert lang == want and score == pytest.approx(sure)


def test_back_off_equals_its_definition():
    """Against a slow form, with memories of any size, over many texts one after another."""
    rng = random.Random(11)
    counts = {k: collections.Counter("".join(rng.choices("abcdeü", k=rng.randint(1, 7))) for _ in range(150)) for k in ("x", "y", "z")}
    langs, least, words = sorted(counts), 2, {w for c in counts.values() for w in c}
    grams = {k: collections.Counter() for k in langs}
    for k in langs:
        for w, n in counts[k].items():
            for size in (5, 4, 3, 2, 1):
                for at in range(len(w) + 3 - size):
                    grams[k][f"<{w}>"[at : at + size]] += n
    known = {w for w in words if sum(c[w] for c in counts.values()) >= least}

    def logs(of, keys, key):
        return np.array([math.log10((of[k][key] + 0.1) / (sum(of[k][x] for x in keys) + 0.1 * len(keys))) for k in langs])

    word_logs = {w: logs(counts, known, w) for w in known}
    sizes = {n: {g for c in grams.values() for g in c if len(g) == n} for n in range(1, 6)}
    gram_logs = {n: {g: logs(grams, sizes[n], g) for g in sizes[n]} for n in sizes}

    def slow(text):
        total = np.zeros(3)
        for w in language_id.words_of(text):
            p = f"<{w}>"
            rows = [word_logs[w]] if w in known else next((r for n in (5, 4, 3, 2, 1) if (r := [gram_logs[n][p[i : i + n]] for i in range(len(p) - n + 1) if p[i : i + n] in sizes[n]])), [np.min(list(word_logs.values()), axis=0)])
            total += np.mean(rows, axis=0)
        z = total * math.log(10) / len(language_id.words_of(text)) ** 0.5
        e = np.exp(z - z.max())
        return langs[int(e.argmax())], float(e.max() / e.sum())

    texts = [" ".join("".join(rng.choices("abcdeüq", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    for remember in (3, 50, 100_000):
        m = language_id.LanguageModel(counts, remember=remember)
        for t in texts:
            (lang, score), (want, sure) = m.predict(t), slow(t)
            assert lang == want and score == pytest.approx(sure, rel=1e-9)


def test_copies_teach_once(spark):
    """A language made of copies is learned, repeated rows change nothing, and empty tables have no rows."""
    rows = [(i, "der und das haus", "de") for i in range(400)] + [(500 + i, f"the house {i} of stone {chr(97 + i)}", "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = language_id.fit(df.dropDuplicates(["text"]), sample=10**6)
    many = language_id.fit(df, sample=10**6)
    got = {r["lang_pred"] for r in language_id.identify(df.where("lang = 'de'"), many).collect()}
    assert got == {"de"}
    assert once.predict("das house")[1] == pytest.approx(many.predict("das house")[1]) and once.predict("das house")[0] == many.predict("das house")[0]
    assert language_id.identify(df.limit(0), many).count() == 0


# 4: quality


def test_quality_cuts_are_over_all_trusted_documents(spark):
    """Quantiles over every trusted row, by language, with a small one among them; text of one word goes."""
    rng = random.Random(6)
    good = [(i, "de" if i % 50 == 0 else "en", prose(rng, rng.randint(30, 90))) for i in range(1000)]
    bad = [(1000 + i, "en", " ".join([rng.choice(WORDS)] * 60)) for i in range(20)] + [(1020 + i, "en", " ".join(f"{rng.getrandbits(30):x}" for _ in range(40))) for i in range(20)]
    docs = spark.createDataFrame([*good, *bad, (2000, "fr", prose(rng, 40)), (2001, None, None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in range(1040)], "doc_id long, quality int")
    models, cuts = quality.fit(docs, labels, sample=300)
    assert all(100 < m.n_docs < 200 for m in models)
    got = {r["doc_id"]: r for r in quality.judge(docs, models, cuts).collect()}
    for lang in ("en", "de", None):
        mine = [got[i] for i, x, _ in good if lang in (None, x)]
        for side, name in enumerate(("perplexity", "repeats")):
            assert cuts[lang][side] == pytest.approx(sorted(r[name] for r in mine)[math.ceil(0.995 * len(mine)) - 1])
    assert not any(got[i]["kept"] for i, *_ in bad) and sum(got[i]["kept"] for i, *_ in good) >= 0.985 * len(good)
    assert got[2000]["cut"] == cuts[None][0]
    models, cuts = quality.fit(docs, labels.limit(0))
    assert cuts == {} and all(r["kept"] for r in quality.judge(docs, models, cuts).collect())


def test_quality_learns_from_every_trusted_document(spark):
    """21,000 trusted documents, more than any bounded draw of before; ids of another kind, null and unknown ones too."""
    rows = [(i, f"alpha beta w{i}" if i % 7 else None) for i in range(24_500)]
    docs = spark.createDataFrame([*rows, (None, "gone")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, 1 if i < 24_000 else 0) for i in range(25_000)] + [(None, 1), (5, 1)], "doc_id long, quality int")
    want = sum(t is not None for i, t in rows if i < 24_000)
    models = quality.learn(docs, labels)
    assert sum(m.n_docs for m in models) == want > 20_000 and min(m.n_docs for m in models) > 0
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert quality.trusted(named, labels.withColumn("doc_id", labels.doc_id.cast("string")), Scratch(spark, "q")).count() == want


def test_joined_perplexity_equals_the_scorer(spark, docs, rows):
    """The sharded join of counts gives what scoring word by word gives, which is held against the formula; awkward rows included."""
    model = lm_scoring.train(docs.where("doc_id % 3 != 0"), Scratch(spark, "lm"))
    twice = docs.unionByName(docs.where("doc_id < 60")).withColumnRenamed("n", "_row").withColumnRenamed("score", "_gain")
    got = sorted((r["doc_id"], r["n_tokens"], r["perplexity"], r["_row"], r["_gain"]) for r in quality.perplexity(twice, model, Scratch(spark, "q")).collect())
    want = sorted((r["doc_id"], r["n_tokens"], 10 ** (-r["score"] / r["n_tokens"])) for r in lm_scoring.score(twice, model).collect())
    assert len(got) == len(rows) + sum(r[0] < 60 for r in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-9) and g[3:] == (1, 0.5)
    nothing = lm_scoring.train(empty(spark), Scratch(spark, "lm"))
    assert {r["perplexity"] for r in quality.perplexity(docs, nothing, Scratch(spark, "q")).collect()} == {1.0}
    assert quality.perplexity(empty(spark), model, Scratch(spark, "q")).count() == 0


# 5: suffix dedup


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[s : s + length] for b in raw for s in range(len(b) - length + 1))
    keep = []
    for b in raw:
        k = np.ones(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                k[s : s + length] = False
        keep.append(k)
    return raw, keep


@pytest.mark.parametrize("length", [400, 120])
def test_repeats(spark, docs, rows, length):
    raw, keep = brute_repeats([r[1] for r in rows], length)
    got = {r["doc_id"]: r for r in suffix_dedup.digests(docs, length).collect()}
    for (i, *_), b, k in zip(rows, raw, keep, strict=True):
        kept = np.frombuffer(b, np.uint8)[k].tobytes()
        edges = np.concatenate([[True], k])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(b), int((~k).sum()), hashlib.sha256(kept).hexdigest())
        assert got[i]["n_spans"] == int((edges[:-1] & ~edges[1:]).sum())
    assert suffix_dedup.digests(empty(spark), length).count() == 0


def test_planted_passages_show_in_n_removed(spark):
    """A passage of over 50 words goes from where it takes 400 bytes; n_bytes is the whole text's length, with or without one."""
    rng = random.Random(15)
    fresh = lambda n: " ".join(f"u{rng.getrandbits(40)}" for _ in range(n))
    planted = [" ".join(f"{rng.randrange(10**6, 10**7)}"[: 6 if k < n else 7] for k in range(51)) for n in (51, 10, 7, 0)]
    assert [len(p) for p in planted] == [356, 397, 400, 407]
    texts = [f"{fresh(30)}{i}({planted[i // 2]}){i}{fresh(9 + i)}" for i in range(8)] + [fresh(60), ""]
    got = {r["doc_id"]: r for r in suffix_dedup.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, t in enumerate(texts):
        gone = {4: 402, 5: 402, 6: 409, 7: 409}.get(i, 0)  # with the brackets, which are equal too
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(t), gone, int(gone > 0))


def test_passages_under_400_bytes_go_by_words_only(spark):
    """Passages of 51, 55, 70 and 90 words: op5's columns equal its SQL, which is 0 for the first two; the word rule cuts all."""
    import duckdb

    from maskwright.llm.queries import ORACLES

    rng = random.Random(16)
    fresh = lambda n: " ".join(f"{rng.getrandbits(20):05x}" for _ in range(n))
    planted = [fresh(n) for n in (51, 55, 70, 90)]
    assert [len(p) for p in planted] == [305, 329, 419, 539]
    texts = [f"{fresh(20 + i)}{i} {planted[i // 2]} {i}{fresh(40 - i)}" for i in range(8)] + [fresh(100), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    db = duckdb.connect()
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in enumerate(texts)])
    got = sorted(tuple(r) for r in suffix_dedup.digests(docs).collect())
    assert got == sorted(db.sql(ORACLES["op5_suffix_array_dedup"]).fetchall())
    assert [r[2] > 0 for r in got] == [False] * 4 + [True] * 4 + [False] * 3
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs, words=suffix_dedup.PASSAGE).collect()}
    for i, t in enumerate(texts):
        # Blanks beside a passage may go with it.
        assert cut[i] == t if i >= 8 else cut[i].replace(" ", "") == t.replace(planted[i // 2], "").replace(" ", "")


def test_repeats_with_frequent_anchors_put_last(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].encode()) >= 400]
    raw = texts[0].encode()
    late = np.unique(suffix_dedup._gram_hashes(np.frombuffer(raw, np.uint8))[::3])
    for t in texts[:5]:
        spans = [(int(a), int(z)) for _, _, first, last in suffix_dedup.anchors(t.encode(), 400, late) for a, z in zip(first, last, strict=True)]
        assert spans[0][0] == 0 and spans[-1][1] == len(t.encode()) - 400 and all(b[0] == a[1] + 1 for a, b in zip(spans, spans[1:], strict=False))


def test_merged_transforms_are_sorted():
    rng = random.Random(2)
    core = bytes(rng.randrange(97, 101) for _ in range(600))
    contexts = [bytes(rng.randrange(97, 101) for _ in range(rng.randrange(0, 40))) + core[: rng.randrange(380, 600)] + bytes(rng.randrange(97, 101) for _ in range(30)) for _ in range(9)]
    offsets = [c.find(core[8:40]) for c in contexts]
    masks = suffix_dedup.repeated_windows(contexts, offsets, 400)
    seen = collections.Counter(c[s : s + 400] for c in contexts for s in range(len(c) - 399))
    for c, m in zip(contexts, masks, strict=True):
        assert m.tolist() == [seen[c[s : s + 400]] > 1 for s in range(len(c) - 399)]


def test_columns_with_the_names_it_uses(spark):
    s = "word " * 100
    names = ["_j1", "_j2", "_k1", "_k2", "_spans", "_aside__j1", "_full"]
    df = spark.createDataFrame([(1, "x" + s, *names), (2, s + "y", *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = suffix_dedup.remove_repeats(df, words=51).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == [tuple(names)] * 2 and got[0].asDict().keys() == set(df.columns)


def test_cut_texts_stay_text(spark):
    s = "é" * 300
    df = spark.createDataFrame([(1, "x" + s + "y"), (2, s), (3, None), (4, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(df).collect()}
    assert got[1] == "xy" and got[2] == "" and got[3] is None and got[4] == "short"


def test_frequent_anchors_fill_no_bucket(spark, tmp_path):
    """700 texts with one string of 60 bytes, 30 of them with one of 500: no group of contexts grows with them."""
    rng = random.Random(4)
    common, passage = prose(rng, 40)[:60], prose(rng, 200)[:500]
    texts = [prose(rng, 70) + " " + common + " " + (passage if i < 30 else "") + prose(rng, 70) for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    uris, many, _, _ = suffix_dedup._count_anchors(docs, 400, 2, np.zeros(0, np.uint64), Scratch(spark, "frequent").path("anchors"))
    groups = suffix_dedup.contexts(docs, uris, many, np.zeros(0, np.uint64), 400).select("anchor", "context").distinct().groupBy("anchor").count()
    assert 0 < groups.agg({"count": "max"}).first()[0] <= 64
    raw, keep = brute_repeats(texts, 400)
    got = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.digests(docs).collect()}
    assert any(not k.all() for k in keep)
    assert got == {i: hashlib.sha256(np.frombuffer(b, np.uint8)[k].tobytes()).hexdigest() for i, (b, k) in enumerate(zip(raw, keep, strict=True))}


def test_stage_cuts_every_passage_of_over_50_words(spark):
    import corpus_pipeline as c

    rng = random.Random(12)
    fresh = lambda n: " ".join(f"u{rng.getrandbits(40)}" for _ in range(n))
    planted = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n)) for n in (51, 52, 60, 70)] + [" ".join(rng.choice("abcdefgh") for _ in range(51))]
    fifty = " ".join(rng.choice(WORDS) for _ in range(50))
    rows = []
    for k, p in enumerate(planted):
        assert len(p) < 400
        rows += [(10 * k, f"{fresh(30)} {p} {fresh(9)}"), (10 * k + 1, f"{p} {fresh(20)}"), (10 * k + 2, f"{fresh(20)}\n" + p.replace(" ", "\n", 3))]
    rows += [(100, f"{fresh(60)} {fifty} {fresh(60)}"), (101, f"{fresh(60)} {fifty} {fresh(60)}"), (102, f"{fresh(5)} {planted[0]}"), (103, planted[0]), (104, None), (105, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    windows = collections.Counter(tuple(w[i : i + 51]) for _, t in rows for w in [(t or "").split()] for i in range(len(w) - 50))
    got = {r["doc_id"]: r["text"] for r in c.cut_repeated_strings(spark, df, "").collect()}
    for i, t in rows:
        w = (t or "").split()
        gone = {x for a in range(len(w) - 50) if windows[tuple(w[a : a + 51])] > 1 for x in range(a, a + 51)}
        if i == 103:
            assert i not in got
        else:
            assert (got[i] or "").split() == [x for k, x in enumerate(w) if k not in gone]
    assert got[100] == rows[-6][1] and c.cut_repeated_strings(spark, df.limit(0), "").count() == 0


# 6: toxicity


def test_toxicity_learns(spark):
    rng = random.Random(8)
    data = []
    for i in range(500):
        w = prose(rng, rng.randint(5, 60)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["awful", "nasty", "vile"]))
        data.append((i, " ".join(w), rng.choice(["en", "de"]), int(bad)))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, toxic int")
    docs, labels = df.drop("toxic"), df.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where("doc_id % 4 != 0"))
    got = {r["doc_id"]: r for r in toxicity.classify(docs, model).collect()}
    held = [(got[i]["predicted"], y) for i, _, _, y in data if i % 4 == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "the vile " * 20000, 3.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in toxicity.classify(odd, model).collect()}
    assert got[1]["score"] == got[2]["score"] and got[3]["predicted"] == 1 and all(0 <= r["score"] <= 1 for r in got.values())
    untaught = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r["predicted"] for r in toxicity.classify(docs, untaught).collect()} == {0}


def test_toxicity_trains_on_every_labelled_text(spark):
    """5,000 distinct texts of one class, more than the start draws; copies and a null text count once or not at all."""
    rows = [(i, f"plain words {i}" if i % 9 else f"vile words {i}", int(i % 9 == 0)) for i in range(6000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7000, "plain words 1"), (7001, "never marked")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7000, 0), (9999, 1), (7001, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.trained == docs.where("doc_id < 6000 AND pmod(xxhash64(text, 1), 4) <> 0").count() > 2 * toxicity.SAMPLE
    right = [r["predicted"] == r["text"].startswith("vile") for r in toxicity.classify(docs, model).collect()]
    assert sum(right) >= 0.99 * len(right)


# 7: vectors


def brute_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float((np.array(vectors[q]) * np.array(v)).sum()), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SHARD", 150)
    rng = np.random.default_rng(4)
    v = {i: x.tolist() for i, x in enumerate(rng.normal(size=(700, 8)) * rng.uniform(0.2, 3, (700, 1)))}
    for i in range(600, 640):
        v[i] = v[0]
    bad = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] * 4), (904, [1.0] * 3), (None, [1.0] * 8), (905, [float("inf")] * 8)]
    df = spark.createDataFrame([*v.items(), (5, v[5]), *bad], "vec_id long, embedding array<double>")
    got = vector_search.nearest(df, df.where("vec_id % 20 = 0"), k=20)
    found = collections.defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert dict(found) == brute_nearest(v, [i for i in v if i % 20 == 0], 20)
    loose = vector_search.nearest(df, df.where("vec_id % 20 = 0"), k=20, factor=1.5)
    assert vector_search.recall(loose, got) >= 0.7
    few = vector_search.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), k=20)
    assert few.count() == 2
    assert vector_search.nearest(df.limit(0), df, k=3).count() == 0 and vector_search.nearest(df, df.limit(0), k=3).count() == 0


def test_vectors_with_equal_products(spark, monkeypatch):
    """Hundreds of distinct vectors with the very same product, spread over shards: the smallest ids come."""
    monkeypatch.setattr(vector_search, "SHARD", 130)
    rng = np.random.default_rng(5)
    v = {0: [1.0, 0.0, 0.0]} | {i: [0.5, float(rng.uniform(-3, 3)), float(rng.uniform(-1, 1)) * 1e-6] for i in range(1, 401)} | {i: [0.25 * int(rng.integers(0, 3)), 8.0, 0.0] for i in range(401, 500)}
    v |= {20: [3.0, 3.0, 0.0], 40: [0.0, 1.0, 0.0]}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>").repartition(3)
    found = collections.defaultdict(list)
    for r in vector_search.nearest(df, df.where("vec_id in (0, 20, 40)"), k=20).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert dict(found) == brute_nearest(v, [0, 20, 40], 20)


def test_vectors_of_any_size_of_numbers(spark):
    rng = np.random.default_rng(6)
    for scale in (1e-12, 1e9):
        v = {i: (x * scale).tolist() for i, x in enumerate(rng.integers(-2, 3, (300, 4)).astype(float)) if x.any()}
        df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
        asked = [i for i in v if i % 20 == 0]
        found = collections.defaultdict(list)
        for r in vector_search.nearest(df, df.where("vec_id % 20 = 0"), k=7).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append(r["vec_id"])
        assert dict(found) == brute_nearest(v, asked, 7)


# 8: decontamination


def brute_hits(text, items, window=13):
    words = decontamination.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        w = decontamination.words_of(t)
        n = min(window, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == w[at : at + n]:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
    return words, hit, found


@pytest.mark.parametrize("set_bytes", [1 << 20, 200])
def test_contamination(spark, docs, rows, set_bytes):
    base = [r[1] for r in rows]
    items = [(1, " ".join(base[20].split()[:20])), (2, "Changed"), (3, None), (4, "..."), (10, base[25]), (11, base[25])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_contamination(docs, bench, set_bytes=set_bytes).collect()}
    for i, t, *_ in rows:
        words, hit, found = brute_hits(t, items)
        assert got[i]["n_words"] == len(words) and sorted(got[i]["items"]) == sorted(found)
        assert {x for s in got[i]["hits"] for x in range(s["at"], s["end"])} == hit
    bad = {i for i, t, *_ in rows for w, h, _ in [brute_hits(t, items)] if h and 20 * len(h) >= len(w)}
    assert {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()} == {r[0] for r in rows} - bad
    left = {r["doc_id"]: r["text"] for r in decontamination.remove_hits(docs, bench).collect()}
    assert all(not brute_hits(left[i], [items[0], items[4]])[1] for i in left)
    assert decontamination.find_contamination(docs, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0


# 9: packing


def test_plan_places_everything_once():
    rng = random.Random(9)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 30))}
        runs, n = packing.plan_packing(counts, 64)
        used = collections.defaultdict(list)
        for length, r in runs.items():
            for rank in range(counts[length]):
                first, each, seq, off = r[np.searchsorted(r[:, 0], rank, "right") - 1]
                d = rank - first
                used[seq + d // each].append((off + d % each * length, length))
        for s in used.values():
            s.sort()
            assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= 64
        assert len(used) == n
        total = sum(k * v for k, v in counts.items())
        assert n <= max(math.ceil(total / 64) * 1.25 + 2, sum(v for k, v in counts.items() if 2 * k > 64) + total / 64)


def test_packing(spark, docs, rows):
    tok = encoding.TextEncoder(tokenizer_file("byte_bpe_50k.json")).tok
    got = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), capacity=256).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert [p["length"] for p in pieces[1:]] == [256] * (len(pieces) - 1) and sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part) and len(part) == 4 * p["length"]
    seq = collections.defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seq.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= 256
    assert packing.pack(empty(spark), tokenizer_file("byte_bpe_50k.json")).count() == 0


# 10: near duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components(spark, docs, rows, k, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_chains_of_near_copies(spark, monkeypatch):
    """Each text links with its neighbours only, so labels must travel, and blocks must meet."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(1)
    w = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(40):
        rows.append((200 - i, " ".join(w)))
        w[rng.randrange(len(w))] = f"n{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)
    kept = {r["doc_id"] for r in near_dedup.drop_near_duplicates(df, 3, 85).collect()}
    assert kept == {c for _, c in brute_components(rows, 3, 85).values()}
    odd = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(odd).orderBy("doc_id").collect()]
    assert got == [(None, None), (1, 1), (1, 1), (2, 2)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_paths_have_one_label(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "a long, b long")
    got = {r["v"]: r["label"] for r in components.connected_components(links, Scratch(spark, "cc"), "p").collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0


def test_ties_keep_the_components(spark):
    """Random links, some doubled, turned round or from a vertex to itself, against a plain search."""
    rng = random.Random(5)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(7, 7), (300, 300), (9, 8), (8, 9), (8, 9)]
    label = {v: v for e in links for v in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["v"]: r["label"] for r in components.connected_components(df, Scratch(spark, "cc"), "t").collect()}
    assert got == label
    # forty vertices tied to the same five smaller ones: one link each, and four among the five
    star = [(v, u) for v in range(10, 50) for u in range(5)]
    assert components.tied(spark.createDataFrame(star, "a long, b long")).count() == 44


# the pipeline


def test_filters_keep_columns_of_any_name(spark):
    names = "doc_id long, text string, lang string, score string, lang_pred string, hits string, items string, n_words string"
    df = spark.createDataFrame([(i, t, "en", "s", "p", "h", "i", "w") for i, t in enumerate(["the house and the tree", "the river", None, "12"])], names)
    bench = spark.createDataFrame([(1, "the river")], "item_id long, text string")
    kept = language_id.keep_recognised(df, language_id.LanguageModel({"en": {"the": 5, "house": 2}, "de": {"der": 5}}))
    assert kept.columns == df.columns and {(r["doc_id"], r["score"], r["lang_pred"]) for r in kept.collect()} == {(0, "s", "p"), (1, "s", "p")}
    clean = decontamination.decontaminate(df, bench)
    assert clean.columns == df.columns and {(r["doc_id"], r["hits"]) for r in clean.collect()} == {(0, "h"), (2, "h"), (3, "h")}
    assert decontamination.remove_hits(df, bench).where("n_words = 'w'").count() == 4


def test_pipeline(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = docs
    for name, stage in c.STAGES[:-1]:
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = Scratch(spark, "stage").write(stage(spark, kept, d), name)
        after = {r["doc_id"]: r for r in kept.collect()}
        assert kept.columns == docs.columns and set(after) <= set(before)
        if name == "near_dedup":
            want = brute_components([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i, (_, root) in want.items() if i == root}
        if name == "suffix_dedup":
            raw, keep = brute_repeats([before[i]["text"] for i in sorted(before)], 400)
            for i, b, k in zip(sorted(before), raw, keep, strict=True):
                assert (i in after) == (bool(k.any()) or not len(b))
                if i in after and k.all():
                    assert after[i]["text"] == before[i]["text"]
    packed = c.STAGES[-1][1](spark, kept, d)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)


def test_every_stage_equals_brute_force(spark):
    """The stages over sf0.001, each on its own input: what goes, what stays, and every byte of what is cut."""
    import re

    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    kept = docs
    for name, stage in c.STAGES[:-1]:
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = Scratch(spark, "stage").write(stage(spark, kept, d), name)
        after = {r["doc_id"]: r for r in kept.collect()}
        if name == "language_id":
            model = language_id.fit(docs)
            want = {i for i, r in before.items() for lang, sure in [model.predict(r["text"])] if lang != "und" and sure >= c.SURE}
            assert set(after) == want
        if name == "suffix_dedup":
            ids = sorted(before)
            raw, keep = brute_repeats([before[i]["text"] for i in ids], 400)
            places = [[(m.start(), m[0]) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", b)] for b in raw]
            windows = collections.Counter(tuple(w for _, w in p[k : k + 51]) for p in places for k in range(len(p) - 50))
            for i, b, k, p in zip(ids, raw, keep, places, strict=True):
                for at in range(len(p) - 50):
                    if windows[tuple(w for _, w in p[at : at + 51])] > 1:
                        k[p[at][0] : p[at + 51][0] if at + 51 < len(p) else len(b)] = False
                char = np.cumsum((np.frombuffer(b, np.uint8) & 0xC0) != 0x80) - 1
                whole = (np.bincount(char, k) > 0)[char] if len(b) else k
                left = np.frombuffer(b, np.uint8)[whole].tobytes().decode()
                assert (i in after) == (bool(left) or not b) and (i not in after or after[i]["text"] == left)
        if name == "decontamination":
            bad = {i for i, r in before.items() for w, hit, _ in [brute_hits(r["text"], items)] if hit and 20 * len(hit) >= len(w)}
            assert set(after) == set(before) - bad
    none = docs.limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, none, d).count() == 0
