"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

A vector x of norm |x| gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, and
a query gets 0 there: then the nearest by distance has the largest inner product, and the
triangle inequality can prune. Equal vectors are one point of the tree with several ids.
Index shards, each with its tree, and query blocks are files in the shared folder, each of
bounded size; a task searches one shard for one block after another. Every point as near as
the k-th is kept, but for rounding; exact products and ids then decide among them.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, open_fs

SHARD, BLOCK, LEAF = 8192, 1024, 128
#: Blocks that one task searches a shard for, about, and queries that it looks up at once.
RUN, STEP = 8, 256


class VpTree:
    """Nodes as rows of an array: a node is a vantage point, and the points nearer and farther than its radius.

    A leaf is (lo, hi) in order and -1s; an inner node is its point, the least and greatest distance
    of the nearer and of the farther half, and the two halves' nodes.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray):
        self.x, self.order, self.nodes = points, order, nodes
        self.x2 = (points**2).sum(axis=1)

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 7) -> VpTree:
        order, nodes, rng = np.arange(len(points)), [], np.random.default_rng(seed)

        def node(lo: int, hi: int) -> int:
            k = len(nodes)
            nodes.append([lo, hi, -1, -1, -1, -1, -1])
            if hi - lo <= LEAF:
                return k
            pick = int(rng.integers(lo, hi))
            order[[lo, pick]] = order[[pick, lo]]
            d = np.sqrt(np.maximum(((points[order[lo + 1 : hi]] - points[order[lo]]) ** 2).sum(axis=1), 0))
            by = np.argsort(d, kind="stable")
            order[lo + 1 : hi] = order[lo + 1 : hi][by]
            d, mid = d[by], (hi - lo - 1) // 2
            nodes[k] = [order[lo], d[0], d[mid - 1], d[mid], d[-1], node(lo + 1, lo + 1 + mid), node(lo + 1 + mid, hi)]
            return k

        if len(points):
            node(0, len(points))
        return cls(points, order, np.array(nodes, float).reshape(-1, 7))

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) of the points found no farther than the query's k-th nearest, and a little beyond for rounding.

        A branch is left out if factor times the least distance that the triangle inequality
        allows in it exceeds the k-th distance so far; factor 1 leaves out nothing nearer.
        """
        best = np.full((len(queries), k), np.inf)  # squared
        q2 = (queries**2).sum(axis=1)
        near2 = 1e-9 * (float(self.x2.max(initial=0)) + float(q2.max(initial=0)))
        slack = 4 * near2**0.5  # of a distance whose square is off by so much
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def offer(q: np.ndarray, points: np.ndarray) -> np.ndarray:
            d = np.maximum(q2[q][:, None] + self.x2[points] - 2 * queries[q] @ self.x[points].T, 0)
            both = np.concatenate([best[q], d], axis=1)
            best[q] = np.partition(both, k - 1, axis=1)[:, :k]
            i, j = np.nonzero(d <= best[q].max(axis=1)[:, None] + near2)
            found.append((q[i], points[j], d[i, j]))
            return d

        def visit(node: int, q: np.ndarray) -> None:
            if not len(q):
                return
            at = self.nodes[node]
            if at[6] < 0:
                offer(q, self.order[int(at[0]) : int(at[1])])
                return
            near, far, a, b = at[1:3], at[3:5], int(at[5]), int(at[6])
            d = np.sqrt(offer(q, np.array([int(at[0])]))[:, 0])
            gap = {a: np.maximum(np.maximum(near[0] - d, d - near[1]), 0), b: np.maximum(np.maximum(far[0] - d, d - far[1]), 0)}
            first = d <= (near[1] + far[0]) / 2
            for order, mine in (((a, b), first), ((b, a), ~first)):
                for child in order:
                    open_ = mine & (factor * gap[child] <= np.sqrt(best[q].max(axis=1)) + slack)
                    visit(child, q[open_])

        if not len(self.nodes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        visit(0, np.arange(len(queries)))
        q, point, d = (np.concatenate(x) for x in zip(*found, strict=True))
        fine = d <= best.max(axis=1)[q] + near2
        return q[fine], point[fine]


def _save(uri: str, **arrays: np.ndarray) -> None:
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    with fs.open_output_stream(path) as f:
        f.write(buffer.getvalue())


def _load(uri: str) -> dict[str, np.ndarray]:
    fs, path = open_fs(uri)
    with fs.open_input_stream(path) as f:
        got = np.load(io.BytesIO(f.read()))
        return {k: got[k] for k in got.files}


def _lifted(points: np.ndarray, top: float) -> np.ndarray:
    """The points with one more component, which makes all of squared norm top."""
    return np.concatenate([points, np.sqrt(np.maximum(top - (points**2).sum(axis=1), 0))[:, None]], axis=1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array of double) of the vectors that can take part: neither null nor zero, and finite throughout."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def _blocks(rows: DataFrame, n: int, root: str, more=None) -> DataFrame:
    """Writes ids and v, or what more makes of them, in n files, dealt by a hash of the id, and returns the table of their URIs."""

    def write(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        uri = f"{root}/{uuid.uuid4().hex}.npz"
        ids, v = p["id"].to_numpy(np.int64), np.stack(p["v"].to_numpy())
        _save(uri, **(more(ids, v) if more else {"ids": ids, "v": v}))
        return pd.DataFrame({"part": p["part"].iloc[:1], "uri": [uri]})

    return rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("part").applyInPandas(write, "part long, uri string")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k vectors with the largest inner product with each query.

    Both tables have the id and the vector; other columns are ignored. A query's own id is no
    candidate. Ties go to the smaller id. Vectors that are null, zero or not finite throughout,
    rows with a null id and vectors of another length than most (the greater, if tied) take no
    part. factor is the pruning's: 1 is exact, more visits less. Rows that repeat an id and its
    vector count once. Empty input: no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    schema = "query_id long, vec_id long, score double"
    all_ = usable(vectors, id_col, vec_col)
    sizes = all_.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fits = F.size("v") == sizes["d"]
    asked = usable(queries, id_col, vec_col).where(fits).dropDuplicates()
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top = float(sizes["m"])

    def tree_of(ids: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        """The shard's distinct vectors, their ids one after another, and the tree."""
        points, number = np.unique(v, axis=0, return_inverse=True)
        start = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(points)))])
        tree = VpTree.build(_lifted(points, top))
        return {"points": points, "ids": ids[np.argsort(number, kind="stable")], "start": start, "order": tree.order, "nodes": tree.nodes}

    index = scratch.write(_blocks(all_.where(fits).dropDuplicates(), sizes["n"] // SHARD + 1, scratch.path("trees"), tree_of), "index")
    blocks = scratch.write(_blocks(asked, n_asked // BLOCK + 1, scratch.path("queries")), "blocks")

    def found_in(s: dict[str, np.ndarray], tree: VpTree, asker: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        """The k nearest ids in one shard of some queries."""
        scale = np.sqrt((v**2).sum(axis=1)) / max(top, 1e-300) ** 0.5
        # One more than asked for, as the query itself may be among them.
        who, point = tree.search(np.concatenate([v / scale[:, None], np.zeros((len(scale), 1))], axis=1), k + 1, factor)
        score = np.concatenate([(s["points"][point[at : at + 65536]] * v[who[at : at + 65536]]).sum(axis=1) for at in range(0, len(who), 65536)] or [np.zeros(0)])
        # Of equal vectors the k + 1 smallest ids are enough.
        many = np.minimum(np.diff(s["start"])[point], k + 1)
        row = np.repeat(np.arange(len(who)), many)
        ids = s["ids"][s["start"][point[row]] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
        other = ids != asker[who[row]]
        row, ids = row[other], ids[other]
        by = np.lexsort((ids, -score[row], who[row]))
        row, ids = row[by], ids[by]
        of = who[row]
        mine = np.arange(len(row)) - np.searchsorted(of, of, "left") < k
        return pd.DataFrame({"query_id": asker[of[mine]], "vec_id": ids[mine], "score": score[row[mine]]})

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, s, tree = None, {}, None
        for p in parts:
            for uri, block in zip(p["shard"], p["block"], strict=True):
                if uri != last:
                    last, s = uri, _load(uri)
                    tree = VpTree(_lifted(s["points"], top), s["order"], s["nodes"])
                q = _load(block)
                for at in range(0, len(q["ids"]), STEP):
                    yield found_in(s, tree, q["ids"][at : at + STEP], q["v"][at : at + STEP])

    # Every shard with every run of blocks; a task goes through a run's blocks one after another.
    n_shards, n_runs = sizes["n"] // SHARD + 1, n_asked // (BLOCK * RUN) + 1
    grid = spark.range(n_shards * n_runs).select((F.col("id") % n_shards).alias("part"), F.floor(F.col("id") / n_shards).alias("run"))
    cells = grid.join(index.select("part", F.col("uri").alias("shard")), "part").join(blocks.select((F.col("part") % n_runs).alias("run"), F.col("uri").alias("block")), "run")
    cells = cells.repartition(min(n_shards * n_runs, 100_000), "part", "run").sortWithinPartitions("part")
    hits = cells.mapInPandas(search, schema)
    pair = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("vec_id"))
    best = hits.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("part")).agg(F.slice(F.array_sort(F.collect_list(pair)), 1, k).alias("h"))
    best = best.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("h"))), 1, k).alias("h"))
    return best.select("query_id", F.posexplode("h").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.s")).alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's (query_id, vec_id) that found has too."""
    return found.join(exact, ["query_id", "vec_id"], "left_semi").count() / max(1, exact.count())


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(v, v.where(F.col("vec_id") % 20 == 0), k=20)
