"""Operator 12: exact top-k search by inner product, with a KD-tree per shard.

Vectors are quantised to integers and dealt to shards by hash; a task builds the tree of its shard by median splits on the
widest side, with a tight box and the least vec_id at each node. A query searches best first: the inner product with a box is at most the sum
of each side's better end, and a node that can't beat the kth result so far, nor tie it with a smaller vec_id, ends the search. Each
query first asks one shard; its kth result there is propagated to all other shards, which return only what is better.
Shards and slices of queries meet in blocks of bounded size, so a task holds one tree and one slice.

Equal vectors score alike, so of a group of copies only the first k + 1 by vec_id can be among any query's k results
(one of them may be the query itself); the others are set aside before the shards are dealt, however many they are.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without a vec_id; vectors of
different lengths are not comparable, each length is searched on its own; rows that repeat a vec_id count once, with the
least vector; fewer candidates than k give fewer rows; ties go to the smaller vec_id; scores are exact, and one that
64 bits can't hold raises; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dendrovox.llm.common import table
from dendrovox.plans.iterate import materialize, settle

SCALE, TOP, EVERY = 64, 20, 20
#: Numbers in a shard and in a slice of queries, about.
SHARD_NUMBERS, SLICE_NUMBERS = 4_000_000, 1_000_000
#: Vectors in a leaf of a tree; queries whose bounds a task works out at once.
LEAF, BATCH = 512, 64
HITS = "query_id long, vec_id long, score long"


class Tree:
    """A KD-tree over integer vectors: nodes with boxes, in arrays; the rows of a node are neighbours."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        low, high, span, children, least = [], [], [], [], []
        todo = [(order, 0, -1, 0)]
        placed = np.empty(len(ids), np.int64)
        while todo:
            members, start, parent, side = todo.pop()
            node, box = len(low), rows[members]
            low.append(box.min(axis=0))
            high.append(box.max(axis=0))
            span.append((start, start + len(members)))
            children.append([-1, -1])
            least.append(ids[members].min())
            if parent >= 0:
                children[parent][side] = node
            if len(members) <= LEAF:
                placed[start : start + len(members)] = members
                continue
            wide, half = int(np.argmax(_spread(low[-1], high[-1]))) if rows.shape[1] else 0, len(members) // 2
            split = np.argpartition(box[:, wide], half) if rows.shape[1] else np.arange(len(members))
            todo.append((members[split[half:]], start + half, node, 1))
            todo.append((members[split[:half]], start, node, 0))
        self.rows, self.ids = rows[placed], ids[placed]
        self.low, self.high = np.array(low), np.array(high)
        self.span, self.children, self.least = np.array(span), np.array(children), np.array(least)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, known: list) -> list[list[tuple[int, int]]]:
        """For each query its ``k`` best (score, -vec_id) here that beat ``known``, the kth pair it has already (or None)."""
        number = _exact(self.rows, queries)
        rows, low, high, queries = number(self.rows), number(self.low), number(self.high), number(queries)
        first, end = self.span[:, 0].tolist(), self.span[:, 1].tolist()
        children, least, out = self.children.tolist(), self.least.tolist(), []
        for at in range(0, len(queries), BATCH):
            some = queries[at : at + BATCH]
            zero = some - some
            bounds = np.maximum(some, zero) @ high.T + np.minimum(some, zero) @ low.T
            for q, bound, me, limit in zip(some, bounds, own[at : at + BATCH].tolist(), known[at : at + BATCH], strict=True):
                best: list[tuple[int, int]] = []  # a heap, the worst first
                todo = [(-bound[0], least[0], 0)]
                while todo:
                    up, smallest, node = heapq.heappop(todo)
                    if limit is not None and (-up, -smallest) <= limit:
                        break
                    if children[node][0] >= 0:
                        for child in children[node]:
                            if limit is None or (bound[child], -least[child]) > limit:
                                heapq.heappush(todo, (-bound[child], least[child], child))
                        continue
                    scores = rows[first[node] : end[node]] @ q
                    hits = np.arange(len(scores)) if limit is None else np.flatnonzero(scores >= limit[0])
                    for s, i in zip(scores[hits].tolist(), self.ids[first[node] + hits].tolist(), strict=True):
                        pair = (int(s), -i)
                        if i == me or (limit is not None and pair <= limit):
                            continue
                        if len(best) < k:
                            heapq.heappush(best, pair)
                        else:
                            heapq.heappushpop(best, pair)
                        if len(best) == k:
                            limit = best[0] if limit is None else max(limit, best[0])
                out.append(best)
        return out

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, **vars(self))
        return to.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as x:
            for name in x.files:
                setattr(tree, name, x[name])
        return tree


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return high.astype(np.float64) - low.astype(np.float64)


def _exact(*parts: np.ndarray):
    """A function that makes integers into numbers whose inner products are exact: doubles while sums stay below 2^53, else Python's."""
    most = [max(abs(int(p.min())), abs(int(p.max()))) if p.size else 0 for p in parts]
    safe = most[0] * most[1] * max(1, parts[0].shape[1]) < 1 << 53
    return lambda x: x.astype(np.float64) if safe else x.astype(object)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if width else np.empty(0)
    return flat.astype(np.int64).reshape(len(column), width)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, width, q``: floor(scale * x) of each component; one row for each vec_id."""
    x = vectors.where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    q = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    return x.where("x is not null").where(F.coalesce(finite, F.lit(False))).groupBy("vec_id").agg(F.min(q).alias("q")).select("vec_id", F.size("q").alias("width"), "q")


def _build(rows: pa.Table) -> pa.Table:
    width = rows["width"][0].as_py()
    tree = Tree(_matrix(rows["q"], width), rows["vec_id"].to_numpy())
    return pa.table({"width": rows["width"].slice(0, 1), "shard": rows["shard"].slice(0, 1), "tree": pa.array([tree.dump()], pa.binary())})


def _finder(k: int):
    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        none = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if not len(asked) or not len(held):
            return pa.table(none)
        tree = Tree.load(held["tree"][0].as_py())
        known = [None if s is None else (s, -i) for s, i in zip(asked["kth_score"].to_pylist(), asked["kth_id"].to_pylist(), strict=True)]
        ids = asked["vec_id"].to_numpy()
        found = tree.search(_matrix(asked["q"], asked["width"][0].as_py()), ids, k, known)
        return pa.table({"query_id": pa.array(np.repeat(ids, [len(f) for f in found])), "vec_id": pa.array([-i for f in found for _, i in f], pa.int64()), "score": pa.array([s for f in found for s, _ in f], pa.int64())})

    return find


def top_by_inner_product(vectors: DataFrame, queries: str, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other vectors for each vector that meets the condition ``queries``."""
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, scale), "quantised")
    copies = F.row_number().over(Window.partitionBy("width", "q").orderBy("vec_id"))
    fit = rows.withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy")
    sizes = {r["width"]: (r["n"], r["m"]) for r in rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(queries)).alias("m")).collect()}
    cores = spark.sparkContext.defaultParallelism
    plan = []
    for width, (n, m) in sorted(sizes.items()):
        shards = max(1, -(-n * width // SHARD_NUMBERS))
        plan.append((width, shards, max(1, -(-m * width // SLICE_NUMBERS), min(m, -(-cores // shards)))))
    lengths = spark.createDataFrame(plan, "width int, shards long, slices long")
    deal = lambda df, seed, n: F.pmod(F.xxhash64(F.lit(seed), df["vec_id"]), F.col(n)).cast("int")
    dealt = fit.join(F.broadcast(lengths), "width")
    trees = materialize(dealt.select("vec_id", "width", "q", deal(dealt, 0, "shards").alias("shard")).groupBy("width", "shard").applyInArrow(_build, "width int, shard int, tree binary"), "trees")
    asked = rows.where(queries).join(F.broadcast(lengths), "width")
    asked = asked.select("vec_id", "width", "q", "shards", deal(asked, 1, "slices").alias("slice"), deal(asked, 2, "shards").alias("home"))
    every = F.explode(F.sequence(F.lit(0), (F.col("slices") - 1).cast("int"))).alias("slice")
    held = trees.join(F.broadcast(lengths), "width").select("width", "shard", "tree", every)
    block = ["width", "shard", "slice"]

    def meet(asked: DataFrame, name: str) -> DataFrame:
        return materialize(asked.groupBy(*block).cogroup(held.groupBy(*block)).applyInArrow(_finder(k), HITS), name)

    no = F.lit(None).cast("long")
    first = meet(asked.select("vec_id", "width", "q", "slice", F.col("home").alias("shard"), no.alias("kth_score"), no.alias("kth_id")), "home")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("score", (-F.col("vec_id")).alias("i"))).alias("_k")).where(F.col("_n") >= k)
    kth = kth.select(F.col("query_id").alias("vec_id"), F.col("_k.score").alias("kth_score"), (-F.col("_k.i")).alias("kth_id"))
    others = F.explode(F.filter(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int")), lambda s: s != F.col("home"))).alias("shard")
    rest = meet(asked.join(kth, "vec_id", "left").select("vec_id", "width", "q", "slice", others, "kth_score", "kth_id"), "others")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(lambda: top_by_inner_product(table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0"), "hits")


ORACLE_OP12 = """
with x as (select vec_id, list_transform(embedding, lambda c: floor(64 * c::double)) as q from embeddings
           where vec_id is not null and embedding is not null and not coalesce(list_bool_or(list_transform(embedding, lambda c: c is null or not isfinite(c::double))), false)),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from x a join x b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
