"""Suffix-array deduplication: every byte inside a string of some length that also starts elsewhere.

1. Winnowing: each window of that many bytes has one anchor, the 32-byte string in it whose
   hash is smallest. Equal windows have equal anchors at equal places, so only windows whose
   anchor occurs twice can repeat. The sorted hashes of such anchors are files that workers
   map into memory. Anchors met in very many texts are chosen last (this only spreads work).
2. The windows of one anchor, with the bytes they reach over, are a context. Contexts are
   dealt by anchor; equal ones are counted once, before the shuffle and after it. A frequent
   anchor's are cut by the anchor's place in the window, and dealt by the bytes that all
   windows of such a piece have, so that no anchor fills a bucket however large the input is.
3. In a bucket of contexts: suffixes at every eighth byte (counted from the anchor, eight
   bytes a symbol) are sorted shard by shard into Burrows-Wheeler transforms. Transforms are
   merged by refining their interleave, a stable sort by preceding symbol each time, which
   also yields common prefixes: intervals of suffixes that share the length less 8 bytes.
4. In an interval, the up to eight bytes before and after decide about each window exactly.

Passages of so many words are found beside that, as their bytes vary: each window of words has
one anchor, the eight words in it whose hash is smallest; windows whose anchor occurs twice are
counted by a 64-bit hash of their words, in the same sorted files.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forget, input_bytes, mix64, set_aside, slices
from .lm_scoring import BLOBS, _dealt, _map, _summed, _write, by_shard, shard_of_hash

LENGTH, ANCHOR = 400, 32
SHARD_BYTES, BUCKET_BYTES, FLUSH_BYTES = 48 << 20, 8 << 20, 24 << 20
#: Occurrences from which an anchor's contexts are cut, and the places in a window that a piece spans.
FREQUENT, PIECE = 256, 48
#: Windows of a text that are looked at together.
SEGMENT = 1 << 20
#: Contexts of which one shard's transform is built.
SHARD_ITEMS = 4096
PLACE = np.uint64((1 << 21) - 1)
LATE = np.uint64(1 << 63)
#: Words of a repeated passage at least (over 50), and of its anchor.
PASSAGE, GRAM = 51, 8


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte strings of b: words of 2, 4 and 8 bytes at every place, then two steps of mixing."""
    two = b[:-1].astype(np.uint16) | b[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    w = four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)
    with np.errstate(over="ignore"):
        h = (w[:-8] ^ (w[:-8] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h = h[:-16] * np.uint64(0x165667B19E3779F9) + (h[16:] ^ (h[16:] >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h) >> np.uint64(1)


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v) - w + 1
    padded = np.concatenate([v, np.full(-len(v) % w, np.iinfo(np.uint64).max)]).reshape(-1, w)
    up = np.minimum.accumulate(padded, axis=1).ravel()
    down = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[w - 1 : w - 1 + n])


def anchors(raw: bytes, length: int, late: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By segment: anchors' hashes and places, and their first and last window's start.

    late: sorted hashes that are chosen only where a window has no other.
    """
    for at in range(0, len(raw) - length + 1, SEGMENT):
        b = np.frombuffer(raw, np.uint8)[at : at + SEGMENT + length - 1]
        h = _gram_hashes(b)
        v = h & ~PLACE | np.arange(len(h), dtype=np.uint64)
        if len(late):
            k = np.minimum(np.searchsorted(late, h), len(late) - 1)
            v |= np.where(late[k] == h, LATE, np.uint64(0))
        place = (_sliding_min(v, length - ANCHOR + 1) & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        yield h[place[first]], place[first] + at, first + at, last + at


def _keys() -> list[Column]:
    """What a text is known by: two hashes and its length."""
    t = F.col("text")
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")]


def _count_anchors(texts: DataFrame, length: int, n: int, late: np.ndarray, root: str) -> tuple[list, list, int, np.ndarray]:
    """Files of the anchors that occur twice or more, and of the frequent ones; how often the former do in all; the very frequent ones."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        got, size = [], 0
        for p in parts:
            for t in p["text"]:
                for h, *_ in anchors(t.encode("utf-8", "surrogatepass"), length, late):
                    got.append(h)
                    size += len(h)
            if size > 1_000_000:
                k, c = np.unique(np.concatenate(got), return_counts=True)
                yield _dealt(k, c.astype("<i8"), shard_of_hash(k << np.uint64(1), n))
                got, size = [], 0
        if got:
            k, c = np.unique(np.concatenate(got), return_counts=True)
            yield _dealt(k, c.astype("<i8"), shard_of_hash(k << np.uint64(1), n))

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        k, c = _summed([np.frombuffer(x, "<u8") for x in p["k"]], [np.frombuffer(x, "<i8") for x in p["c"]])
        total, k, c = int(c.sum()), k[c > 1], c[c > 1]
        top = np.argsort(-c, kind="stable")[:64]
        return pd.DataFrame({"shard": p["shard"].iloc[:1], "uri": [_write(root, k)], "many": [_write(root, k[c > FREQUENT])], "total": [total], "again": [int(c.sum())], "top": [k[top].astype(np.int64).tolist()], "times": [c[top].tolist()]})

    rows = by_shard(texts.mapInPandas(count, BLOBS), n).applyInPandas(merge, "shard long, uri string, many string, total long, again long, top array<long>, times array<long>").collect()
    total = sum(r["total"] for r in rows)
    often = max(512, total // 400)
    hot = sorted(k for r in rows for k, c in zip(r["top"], r["times"], strict=True) if c > often)
    uris, many = [None] * n, [None] * n
    for r in rows:
        uris[r["shard"]], many[r["shard"]] = r["uri"], r["many"]
    return uris, many, sum(r["again"] for r in rows), np.array(hot, np.uint64)


def pieces(raw: bytes, anchor: int, place: int, first: int, last: int, length: int) -> Iterator[tuple[int, int, int]]:
    """The context of a frequent anchor in pieces: what each is dealt by, and its first and last window's start.

    Windows are parted by how far the anchor stands in them, which equal windows have alike.
    Those of a piece of so many places have length - places + 1 bytes in common, and are dealt by them.
    """
    import xxhash

    n = min(PIECE, max(1, length // 8))
    for o in range((place - last) // n * n, place - first + 1, n):
        sure = raw[place - o : place - o - n + 1 + length]
        yield xxhash.xxh3_64_intdigest(sure, seed=anchor + o) >> 1, max(first, place - o - n + 1), min(last, place - o)


def _frequent(texts: DataFrame, length: int, hot: np.ndarray) -> np.ndarray:
    """Hashes of the strings that two far-off contexts of a frequent anchor have in common."""

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo: dict[int, bytes] = {}
        hi: dict[int, bytes] = {}
        for p in parts:
            for t in p["text"]:
                raw = t.encode("utf-8", "surrogatepass")
                for h, at, _, _ in anchors(raw, length, np.zeros(0, np.uint64)):
                    for i in np.flatnonzero(np.isin(h, hot)):
                        c = raw[max(0, at[i] - 2 * length) : at[i] + 2 * length]
                        k = int(h[i])
                        lo[k], hi[k] = min(lo.get(k, c), c), max(hi.get(k, c), c)
        yield pd.DataFrame({"k": list(lo), "lo": list(lo.values()), "hi": list(hi.values())})

    ends = texts.mapInPandas(find, "k long, lo binary, hi binary").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    grams = [np.intersect1d(*(_gram_hashes(np.frombuffer(bytes(x), np.uint8)) for x in (r["lo"], r["hi"]))) for r in ends]
    return np.unique(np.concatenate([hot, *grams]))


class Transform:
    """The suffixes of some symbol strings in order: the symbol before each, and where it starts."""

    def __init__(self, before: np.ndarray, start: np.ndarray):
        self.before, self.start = before, start

    @classmethod
    def build(cls, symbols: np.ndarray, first: np.ndarray, start: np.ndarray) -> Transform:
        """By prefix doubling. symbols: strings one after another, each ended by a symbol of its own; first: where they begin."""
        n = len(symbols)
        after = np.arange(1, n + 1)
        ends = np.concatenate([first[1:], [n]]) - 1
        after[ends] = first
        rank, step = np.unique(symbols, return_inverse=True)[1], after
        while True:
            key = rank.astype(np.int64) * n + rank[step]
            distinct, new = np.unique(key, return_inverse=True)
            step = step[step]
            done = len(distinct) == n or len(distinct) == rank.max() + 1
            rank = new
            if done:
                break
        order = np.argsort(rank, kind="stable")
        previous = np.empty(n, np.int64)
        previous[after] = np.arange(n)
        return cls(symbols[previous[order]], start[order])


def _stable_order(symbols: np.ndarray) -> np.ndarray:
    """argsort, stable, of integers from 0 on: by their lower 16 bits, then by their upper (radix sorts)."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and symbols.max() > 0xFFFF:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """The merged transform, and for each suffix the number of the interval that shares depth symbols.

    The interleave says which side each next suffix is from. Sorted stably by the symbols
    before, an interleave right to p symbols becomes one that is right to p + 1.
    """
    side = np.repeat([False, True], [len(a.start), len(b.start)])
    group = np.zeros(len(side), np.int64)
    at_depth, p = None, 0
    while True:
        symbol = np.empty(len(side), a.before.dtype)
        symbol[~side], symbol[side] = a.before, b.before
        order = _stable_order(symbol)
        s, g = symbol[order], group[order]
        new = np.cumsum(np.concatenate([[False], (s[1:] != s[:-1]) | (g[1:] != g[:-1])]))
        turned = side[order]
        same, p = np.array_equal(turned, side) and new[-1] == group[-1], p + 1
        side, group = turned, new
        if p == depth:
            at_depth = group
        if same or (p >= depth and group[-1] == len(group) - 1):
            break
    at_depth = group if at_depth is None else at_depth
    before, start = np.empty(len(side), a.before.dtype), np.empty(len(side), np.int64)
    before[~side], before[side] = a.before, b.before
    start[~side], start[side] = a.start, b.start
    return Transform(before, start), at_depth


def repeated_windows(contexts: list[bytes], offsets: list[int], length: int) -> list[np.ndarray]:
    """Of distinct contexts with their anchors' offsets, a mask of the windows that repeat among them."""
    size = np.array([len(c) for c in contexts])
    base = np.concatenate([[0], np.cumsum(size + 16)])[:-1] + 8
    text = np.frombuffer(b"\0" * 8 + b"".join(c + b"\0" * 16 for c in contexts), np.uint8)
    lead = np.array(offsets) % 8
    n = (size - lead) // 8
    first = np.concatenate([[0], np.cumsum(n + 1)])
    item = np.repeat(np.arange(len(contexts)), n + 1)
    start = base[item] + lead[item] + 8 * (np.arange(first[-1]) - first[item])

    def eight(at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(8):
            out = out << np.uint64(8) | text[np.minimum(at + j, len(text) - 1)]
        return out

    symbols = np.unique(eight(start), return_inverse=True)[1].astype(np.int32)
    symbols[first[1:] - 1] = symbols.max() + 1 + np.arange(len(contexts), dtype=np.int32)
    parts = np.array_split(np.arange(len(contexts)), max(2, -(-len(contexts) // SHARD_ITEMS)))
    shards = [Transform.build(symbols[first[q[0]] : first[q[-1] + 1]], first[q] - first[q[0]], start[first[q[0]] : first[q[-1] + 1]]) for q in parts if len(q)]
    depth, group = length // 8 - 1, np.zeros(0)
    while len(shards) > 1:
        pairs = [merge(a, b, depth) for a, b in zip(shards[::2], shards[1::2], strict=False)]
        shards, group = [t for t, _ in pairs] + shards[len(shards) - len(shards) % 2 :], pairs[0][1]
    at = shards[0].start
    many = np.bincount(group)[group] > 1
    at, group = at[many], group[many].astype(np.uint64)
    owner = np.searchsorted(base, at, "right") - 1
    fits = at + 8 * depth <= (base + size)[owner]
    at, group, owner = at[fits], group[fits], owner[fits]
    masks = [np.zeros(max(0, len(c) - length + 1), bool) for c in contexts]
    if not len(at):
        return masks
    left, right = eight(at - 8), eight(at + 8 * depth)
    flat = np.zeros(len(text) + length, bool)
    for e in range(8):
        s = at - e
        ok = (s >= base[owner]) & (s + length <= (base + size)[owner])
        if not ok.any():
            continue
        key = np.stack([group[ok], left[ok] & np.uint64((1 << 8 * e) - 1), right[ok] >> np.uint64(8 * e)])
        # Equal keys come together by a hash; whether neighbours are equal is seen on the keys.
        order = np.argsort(mix64(mix64(mix64(key[0]) ^ key[1]) ^ key[2]), kind="stable")
        k = key[:, order]
        new = np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)])
        run = np.cumsum(new) - 1
        flat[s[ok][order][(np.bincount(run) > 1)[run]]] = True
    for i, m in enumerate(masks):
        m[:] = flat[base[i] : base[i] + len(m)]
    return masks


def _spans(mask: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes under the marked windows, as stretches."""
    at = np.flatnonzero(mask)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + length).tolist(), strict=True))


def contexts(texts: DataFrame, uris: list, many: list, late: np.ndarray, length: int) -> DataFrame:
    """The contexts of anchors in the files: what each is dealt by (anchor), the anchor's place in it, its bytes, and where it is (k1, k2, start)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, often = ([_map(u, "<u8") for u in f] for f in (uris, many))
        found: dict[tuple[int, int, bytes], array] = {}
        size = 0

        def out() -> pd.DataFrame:
            return pd.DataFrame({"anchor": [k[0] for k in found], "place": [k[1] for k in found], "context": [k[2] for k in found], "at": [v.tobytes() for v in found.values()]})

        for p in parts:
            for k1, k2, t in zip(p["k1"], p["k2"], p["text"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                for h, place, first, last in anchors(raw, length, late):
                    keep = _among(have, h << np.uint64(1), h)
                    frequent = _among(often, h << np.uint64(1), h) & keep
                    for i in np.flatnonzero(keep).tolist():
                        whole = int(h[i]), int(place[i]), int(first[i]), int(last[i])
                        for group, a, z in pieces(raw, *whole, length) if frequent[i] else (whole[:1] + whole[2:],):
                            key = group, whole[1] - a, raw[a : z + length]
                            if key not in found:
                                found[key] = array("q")
                                size += 250 + len(key[2])  # what Python takes for it
                            found[key].extend((k1, k2, a))
                            size += 24
            if size > FLUSH_BYTES:
                yield out()
                found, size = {}, 0
        yield out()

    return texts.select(*_keys(), "text").mapInPandas(run, "anchor long, place long, context binary, at binary")


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """k1, k2 and spans (array of blobs of 64-bit [start, end) pairs of bytes) of texts with repeated strings."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= length)
    n = 1 << max(0, int(np.ceil(np.log2(max(1, input_bytes(texts)) / SHARD_BYTES))))
    none = np.zeros(0, np.uint64)
    uris, many, again, hot = _count_anchors(texts, length, n, none, scratch.path("anchors"))
    late = none
    if len(hot):
        late = _frequent(texts, length, hot)
        uris, many, again, _ = _count_anchors(texts, length, n, late, scratch.path("anchors"))
    buckets = int(again * 1.5 * length // BUCKET_BYTES) + int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        where: dict[tuple[int, int, bytes], list[np.ndarray]] = defaultdict(list)
        for h, place, c, at in zip(p["anchor"], p["place"], p["context"], p["at"], strict=True):
            where[h, place, bytes(c)].append(np.frombuffer(at, "<i8").reshape(-1, 3))
        of_anchor: dict[int, int] = defaultdict(int)
        for h, _, _ in where:
            of_anchor[h] += 1
        open_ = [k for k in where if of_anchor[k[0]] > 1]
        masks = dict(zip(open_, repeated_windows([k[2] for k in open_], [k[1] for k in open_], length), strict=True)) if open_ else {}
        found = []
        for k, places in where.items():
            every = np.concatenate(places)
            whole = [(0, len(k[2]))] if len(every) > 1 else _spans(masks[k], length) if k in masks else []
            found += [np.stack([every[:, 0], every[:, 1], every[:, 2] + x, every[:, 2] + y], axis=1) for x, y in whole]
        rows = np.unique(np.concatenate([np.zeros((0, 4), np.int64), *found]), axis=0)
        cut = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
        ends = np.concatenate([cut[1:], [len(rows)]])
        return pd.DataFrame({"k1": rows[cut, 0], "k2": rows[cut, 1], "spans": [rows[i:j, 2:].tobytes() for i, j in zip(cut.tolist(), ends.tolist(), strict=False)]})

    dealt = contexts(texts, uris, many, late, length)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).repartition(min(buckets, 100_000), "bucket")
    solved = dealt.groupBy("bucket").applyInPandas(solve, "k1 long, k2 long, spans binary")
    # Written, so that the join with the texts is a plain one, whose heavy keys (copies) Spark can split.
    return scratch.write(scratch.write(solved, "spans").groupBy("k1", "k2").agg(F.collect_list("spans").alias("spans")), "grouped")


def _merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(tuple(x) for s in (() if spans is None else spans) for x in np.frombuffer(s, "<i8").reshape(-1, 2).tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, dict[str, str]]:
    """docs with column _spans (array of blobs; null: nothing repeats), and what brings back the names of columns set aside for it."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup-" + uuid.uuid4().hex[:6])
    docs, back = set_aside(docs, ("_j1", "_j2", "_k1", "_k2", "_spans"))
    spans = repeated_spans(docs, scratch, length).withColumnsRenamed({"k1": "_k1", "k2": "_k2", "spans": "_spans"})
    keyed = docs.withColumns(dict(zip(("_j1", "_j2"), (F.xxhash64(F.col("text").cast("string")), F.xxhash64(F.lit(1), F.col("text").cast("string"))), strict=True)))
    return keyed.join(spans, (F.col("_j1") == F.col("_k1")) & (F.col("_j2") == F.col("_k2")), "left").drop("_j1", "_j2", "_k1", "_k2"), back


_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_BACK = np.uint64(pow(int(_STEP[1]), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base)]))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words (between ASCII blanks) start and end, and their 64-bit hashes."""
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[b], [True]])))
    start, end = edge[::2], edge[1::2]
    size, out = end - start, np.zeros(len(start), np.uint64)
    power = _powers(_STEP[0], int(size.max(initial=1)))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(start, np.arange(SEGMENT, len(b), SEGMENT)), [len(start)]]))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        first = np.cumsum(size[i:j]) - size[i:j]
        off = np.arange(size[i:j].sum()) - np.repeat(first, size[i:j])
        out[i:j] = np.add.reduceat(_BYTE[b[off + np.repeat(start[i:j], size[i:j])]] * power[off], first)
    return start, end, mix64(out)


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words that follow one another."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_STEP[1], len(words)))])
        return mix64((total[n:] - total[:-n]) * _powers(_BACK, len(words))[: len(words) - n + 1])


def _passages(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts and ends; by window of n words its hash and its anchor's; and the hash of each place that is an anchor."""
    start, end, words = _words(raw)
    if len(words) < n:
        none = np.zeros(0, np.uint64)
        return start, end, none, none, none
    gram, of, places = _runs(words, GRAM), [], []
    for at in range(0, len(words) - n + 1, SEGMENT):
        h = gram[at : at + SEGMENT + n - GRAM]
        place = (_sliding_min(h & ~PLACE | np.arange(len(h), dtype=np.uint64), n - GRAM + 1) & PLACE).astype(np.int64)
        of.append(h[place])
        places.append(place + at)
    return start, end, _runs(words, n), np.concatenate(of), gram[np.unique(np.concatenate(places))]


def _among(have: list[np.ndarray], h: np.ndarray, key: np.ndarray | None = None) -> np.ndarray:
    """Which hashes (or the keys in their place) stand in the shards, sorted, of the hashes' leading bits."""
    shard, out = shard_of_hash(h, len(have)), np.zeros(len(h), bool)
    h = h if key is None else key
    for s in np.unique(shard):
        if len(have[s]):
            mine = np.flatnonzero(shard == s)
            out[mine] = have[s][np.minimum(np.searchsorted(have[s], h[mine]), len(have[s]) - 1)] == h[mine]
    return out


def _met_again(texts: DataFrame, hashes_of, n: int, root: str) -> list:
    """Files, by leading bits, of the hashes that hashes_of finds twice or more in all texts."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, got, size = hashes_of(), [], 0
        for p in parts:
            for t in p["text"]:
                got.append(find(t.encode("utf-8", "surrogatepass")))
                size += len(got[-1])
                if size > 1_000_000:
                    k, c = np.unique(np.concatenate(got), return_counts=True)
                    yield _dealt(k, c.astype("<i8"), shard_of_hash(k, n))
                    got, size = [], 0
        if size:
            k, c = np.unique(np.concatenate(got), return_counts=True)
            yield _dealt(k, c.astype("<i8"), shard_of_hash(k, n))

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        k, c = _summed([np.frombuffer(x, "<u8") for x in p["k"]], [np.frombuffer(x, "<i8") for x in p["c"]])
        return pd.DataFrame({"shard": p["shard"].iloc[:1], "uri": [_write(root, k[c > 1])]})

    uris: list = [None] * n
    for r in by_shard(texts.mapInPandas(count, BLOBS), n).applyInPandas(merge, "shard long, uri string").collect():
        uris[r["shard"]] = r["uri"]
    return uris


def passage_finder(docs: DataFrame, scratch: Scratch, n: int = PASSAGE):
    """What makes, in a worker, a function of a text's bytes: [start, end) of its n words that also stand elsewhere.

    Words are compared byte by byte, the blanks between them aren't; the blanks after a passage go with it.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= 2 * n - 1)
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, input_bytes(texts)) / SHARD_BYTES))))
    anchored = _met_again(texts, lambda: lambda raw: _passages(raw, n)[4], shards, scratch.path("word-anchors"))

    def candidates():
        have = [_map(u, "<u8") for u in anchored]

        def find(raw: bytes) -> np.ndarray:
            _, _, windows, of, _ = _passages(raw, n)
            return windows[_among(have, of)]

        return find

    repeated = _met_again(texts, candidates, shards, scratch.path("passages"))

    def finder():
        have, again = [_map(u, "<u8") for u in anchored], [_map(u, "<u8") for u in repeated]

        def find(raw: bytes) -> list[tuple[int, int]]:
            start, _, windows, of, _ = _passages(raw, n)
            at = np.flatnonzero(_among(have, of))
            at = at[_among(again, windows[at])]
            after = np.concatenate([start, [len(raw)]])
            return list(zip(start[at].tolist(), after[at + n].tolist(), strict=True))

        return find

    return finder


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """docs with every repeated string of length bytes cut from text; columns as they were.

    A string counts if it also starts anywhere else: in another row, an equal one too, or in
    the same text. With words, so many words that also stand elsewhere are cut too, however
    few bytes they take. Texts are UTF-8; a character that is only partly covered stays. Null
    and shorter texts stay as they are. Empty input: no rows.
    """
    finder = passage_finder(docs, Scratch(docs.sparkSession, "passages"), words) if words else lambda: lambda raw: []

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        passages = finder()
        for texts, spans in batches:
            out = []
            for t, s in zip(texts, spans, strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                cuts = _merged(s) + passages(raw)
                if t is None or not cuts:
                    out.append(t)
                    continue
                raw = np.frombuffer(raw, np.uint8)
                keep = np.ones(len(raw), bool)
                for a, b in cuts:
                    keep[a:b] = False
                char = np.cumsum((raw & 0xC0) != 0x80) - 1
                keep = (np.bincount(char, keep) > 0)[char]
                out.append(raw[keep].tobytes().decode("utf-8", "surrogatepass"))
            yield pd.Series(out, dtype=object)

    # Were it deterministic, a filter on the new text would be pushed below and run it a second time, in workers of its own.
    cut = cut.asNondeterministic()
    found, back = with_spans(docs, length)
    return found.withColumn("text", cut(F.col("text").cast("string"), "_spans")).drop("_spans").withColumnsRenamed(back).select(*docs.columns)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; a null text counts as empty."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                rows = []
                for doc, t, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw, kept, at, spans = (t or "").encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, _merged(s)
                    for x, y in spans:
                        kept.update(raw[at:x])
                        at = y
                    kept.update(raw[at:])
                    rows.append((doc, len(raw), sum(y - x for x, y in spans), len(spans), kept.hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found, _ = with_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), length)
    return found.select("doc_id", "text", "_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
