"""Exact top-k inner products: a ball tree for each shard, branch and bound, k-th scores shared from wave to wave."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenloom.llm._common import drop_stash, stash

#: Sums of this size and more are not exact as doubles.
EXACT = float(1 << 53)


def dumps(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def loads(block: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(block)) as f:
        return dict(f)


def stack(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    wide = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), wide), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b, in doubles where these are exact."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * wide < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def narrow(vectors: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    return vectors.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


NO_SCORE, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row's candidates, by descending score, then ascending id; NO_SCORE where there are fewer."""
    by = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~x is -x - 1, without overflow
    return np.take_along_axis(scores, by, 1), np.take_along_axis(ids, by, 1)


class BallTree:
    """Balls around halves of halves of a shard's vectors; leaves hold at most `leaf` vectors, by ascending id.

    A ball is halved between two far points of it: the one farthest from its centre, and the one farthest from
    that. A node bounds its vectors' products with a query twice, by the ball around its centre and by the cone
    and the lengths they lie in; the smaller bound holds.
    """

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = 256) -> dict[str, np.ndarray]:
        points = vectors.astype(np.float64)
        order = np.argsort(ids, kind="stable")
        length = np.sqrt((points**2).sum(axis=1))
        made: dict[str, list] = {name: [] for name in ("center", "radius", "cosine", "longest", "shortest", "child", "span")}
        todo, at = [(0, len(ids))], 0
        while at < len(todo):  # by level: a node's children have neighbouring numbers, above its own
            a, b = todo[at]
            own, norm = points[order[a:b]], length[order[a:b]]
            middle = own.mean(axis=0)
            apart = np.sqrt(((own - middle) ** 2).sum(axis=1))
            size = np.sqrt((middle**2).sum())
            cosine = ((own @ middle) / np.maximum(norm * size, 1e-300)).min() if size > 0 and norm.min() > 0 else -1.0
            for name, value in (("center", middle), ("radius", apart.max(initial=0.0)), ("cosine", max(-1.0, min(1.0, cosine))), ("longest", norm.max(initial=0.0)), ("shortest", norm.min(initial=0.0))):
                made[name].append(value)
            if b - a <= leaf:
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
                made["span"].append((a, b))
                made["child"].append(-1)
            else:
                one = own[int(np.argmax(apart))]
                other = own[int(np.argmax(((own - one) ** 2).sum(axis=1)))]
                half = (b - a) // 2  # halves, so that equal vectors cannot make the tree deep
                order[a:b] = order[a:b][np.argsort(own @ (other - one), kind="stable")]
                made["span"].append((a, b))
                made["child"].append(len(todo))
                todo += [(a, a + half), (a + half, b)]
            at += 1
        out = {name: np.array(value) for name, value in made.items()}
        return out | {"ids": ids[order], "vectors": narrow(vectors[order])}

    def bound(self, q: np.ndarray, norm: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """At least the largest product of each query with any vector of its node; rounding errors are added."""
        center = self.center[nodes][:, : q.shape[1]]
        q, full = q[:, : center.shape[1]], np.sqrt((self.center[nodes] ** 2).sum(axis=1))
        along = (q * center).sum(axis=1)
        ball = along + norm * self.radius[nodes]
        cos_q = np.clip(along / np.maximum(norm * full, 1e-300), -1, 1)
        cos_n = self.cosine[nodes]
        # the angle to the query is at least that to the centre less the cone's
        inside = np.where(cos_q >= cos_n, 1.0, cos_q * cos_n + np.sqrt((1 - cos_q**2) * (1 - cos_n**2)))
        cone = norm * np.where(inside >= 0, self.longest[nodes], self.shortest[nodes]) * np.minimum(1.0, inside + 1e-7 * (inside >= 0))
        cone = np.where(full > 0, cone + 1e-7 * norm * self.longest[nodes], np.inf)
        return np.minimum(ball, cone) + 1 + 1e-9 * norm * (full + self.radius[nodes])

    def search(self, queries: np.ndarray, own: np.ndarray, best: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries' running best (scores and ids, k of each) after this shard, and the leaves each has visited.

        Depth first, all queries at once: each goes on from the node of the highest bound on its own stack, pushes
        the children whose bound reaches its k-th score so far, and scans leaves. Bounds are worked out for
        children of visited nodes alone, and a node that has fallen behind the k-th score is left out when its
        turn comes. Ties with the k-th score are visited, since a smaller id may win.
        """
        n, k = best.shape
        q, norm = queries.astype(np.float64), np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        best, who, visits = best.copy(), who.copy(), np.zeros(n, np.int64)
        depth = int(np.ceil(np.log2(max(2, len(self.child))))) + 4
        node, edge, top = np.zeros((n, 2 * depth), np.int64), np.full((n, 2 * depth), np.inf), np.ones(n, np.int64)
        while True:
            live = np.flatnonzero(top)
            if not len(live):
                return best, who, visits
            top[live] -= 1
            at, most = node[live, top[live]], edge[live, top[live]]
            go = most >= best[live, k - 1].astype(np.float64)
            live, at = live[go], at[go]
            inner = self.child[at] >= 0
            mine, child = live[inner], self.child[at[inner]]
            if len(mine):
                both = np.stack([self.bound(q[mine], norm[mine], child + i) for i in (0, 1)])
                far = both.argmin(axis=0)
                for turn in (far, 1 - far):  # the nearer one lies on top
                    value = both[turn, np.arange(len(mine))]
                    reach = value >= best[mine, k - 1].astype(np.float64)
                    who_, at_ = mine[reach], top[mine[reach]]
                    node[who_, at_], edge[who_, at_] = (child + turn)[reach], value[reach]
                    top[who_] += 1
            mine, leaf = live[~inner], at[~inner]
            visits[mine] += 1
            for x in np.unique(leaf):
                self.scan(x, mine[leaf == x], queries, own, best, who)

    def scan(self, leaf: int, mine: np.ndarray, queries: np.ndarray, own: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        a, b = self.span[leaf]
        k, ids = best.shape[1], self.ids[a:b]
        score = products(queries[mine], self.vectors[a:b].astype(np.int64))
        score[ids[None, :] == own[mine, None]] = NO_SCORE
        if b - a > 4 * k:  # what is below the leaf's own k-th score has no part
            least = np.partition(score, b - a - k, axis=1)[:, b - a - k]
            some = np.flatnonzero((score >= least[:, None]).any(axis=0))
            score, ids = score[:, some], ids[some]
        wide = np.broadcast_to(ids, score.shape)
        best[mine], who[mine] = best_of(np.concatenate((best[mine], score), axis=1), np.concatenate((who[mine], np.where(score > NO_SCORE, wide, NO_ID)), axis=1), k)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null if the vector or a component is null or not finite."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def top_k(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, query_step: int = 50, shard_rows: int = 16_384, block_rows: int = 1024, waves: int = 3) -> DataFrame:
    """Highest `k` integer inner products for every row whose id is divisible by `query_step`, against all others.

    Vectors are quantised and dealt to shards of about `shard_rows` by a hash of the id; each shard's ball tree
    is one row of a table. Queries are packed into blocks of about `block_rows`. A block searches the shards in
    `waves`: first one shard, then a few, then all the rest. After each wave its queries' best k of all shards
    so far are merged, and their k-th scores are the floor from which the next wave's searches start. Within a
    shard the search is branch and bound. A task holds one tree and one block at a time.

    The bound on the work is honest, not small: an exact answer costs, for vectors that no ball tells apart,
    queries x vectors products; what is sent is a block (its integers in the smallest type) for each shard.

    Returns query_id, rank (from 1), vec_id, score, by descending score, then ascending vec_id. Null vectors,
    vectors with null or non-finite components and null ids take no part. Rows that repeat an id count once,
    the least vector of them (with all its equals). Vectors of other lengths count as filled up with zeros. A
    lone vector has no candidates; an empty table gives no rows. Scores are exact modulo 2**64. Other columns
    are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
    rows = stash(rows.groupBy("id").agg(F.min("v").alias("v")), "topk-rows")
    total, asked = rows.agg(F.count("*"), F.count(F.when(F.col("id") % query_step == 0, 1))).first()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-asked // block_rows))

    def build(t: pa.Table) -> pa.Table:
        made = BallTree.build(t["id"].to_numpy(), stack([np.array(v, np.int64) for v in t["v"].to_pylist()]))
        return pa.table({"shard": t["shard"][:1], "tree": pa.array([dumps(**made)], pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        ids = t["id"].to_numpy()
        made = dumps(ids=ids, vectors=narrow(stack([np.array(v, np.int64) for v in t["v"].to_pylist()])))
        state = dumps(best=np.full((len(ids), k), NO_SCORE), who=np.full((len(ids), k), NO_ID))
        return pa.table({"part": t["part"][:1], "queries": pa.array([made], pa.binary()), "state": pa.array([state], pa.binary())})

    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)))
    trees = stash(placed.groupBy("shard").applyInArrow(build, "shard long, tree binary"), "topk-trees")
    packed = rows.where(F.col("id") % query_step == 0).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)))
    packed = stash(packed.groupBy("part").applyInArrow(gather, "part long, queries binary, state binary"), "topk-queries")
    queries, state = packed.select("part", "queries"), packed.select("part", "state")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shard = None, None
        for batch in batches:
            for at, part, block, before in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part < 0:
                    tree, shard = BallTree(**loads(block)), at
                    continue
                if shard != at:
                    continue  # a shard without rows
                q, held = loads(block), loads(before)
                best, who, _ = tree.search(q["vectors"].astype(np.int64), q["ids"], held["best"], held["who"])
                yield pa.RecordBatch.from_pydict({"part": [part], "state": pa.array([dumps(best=best, who=who)], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        parts = [loads(x) for x in t["state"].to_pylist()]
        best, who = parts[0]["best"], parts[0]["who"]
        for x in parts[1:]:
            new = ~(x["who"][:, :, None] == who[:, None, :]).any(axis=2)  # all parts hold what the wave began with
            best, who = best_of(np.concatenate((best, np.where(new, x["best"], NO_SCORE)), axis=1), np.concatenate((who, np.where(new, x["who"], NO_ID)), axis=1), k)
        return pa.table({"part": t["part"][:1], "state": pa.array([dumps(best=best, who=who)], pa.binary())})

    # the shards of a block's waves, counted from a place of its own so that no shard is first for all
    bounds = sorted({0, min(1, shards), *(min(shards, round(shards ** (i / waves))) for i in range(1, waves)), shards})
    for first, last in zip(bounds, bounds[1:], strict=False):
        of_wave = F.transform(F.sequence(F.lit(first).cast("long"), F.lit(last - 1).cast("long")), lambda i: F.pmod(F.xxhash64("part") + i, F.lit(shards)))
        asks = queries.join(state, "part").select(F.explode(of_wave).alias("shard"), "part", F.col("queries").alias("block"), "state")
        both = trees.select("shard", F.lit(-1).cast("long").alias("part"), F.col("tree").alias("block"), F.lit(None).cast("binary").alias("state")).unionByName(asks)
        dealt = both.repartition(min(shards, 2000), "shard").sortWithinPartitions("shard", "part")
        found = dealt.mapInArrow(search, "part long, state binary").unionByName(state)  # a wave of shards without rows leaves the state
        after = stash(found.groupBy("part").applyInArrow(merge, "part long, state binary"), "topk-state")
        if first:
            drop_stash(state)
        state = after

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, x = loads(block)["ids"], loads(held)
                row, rank = np.nonzero(x["best"] > NO_SCORE)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array((rank + 1).astype(np.int32)), pa.array(x["who"][row, rank]), pa.array(x["best"][row, rank])], ["query_id", "rank", "vec_id", "score"])

    return queries.join(state, "part").select("queries", "state").mapInArrow(listed, "query_id long, rank int, vec_id long, score long")
