"""Nearest neighbours by cosine: a vantage-point tree per shard, and one over shards.

On unit vectors the Euclidean distance is a metric with the cosine's order. A tree splits its
vectors at the median distance to a vantage point. A search with the best k distances so far (radius
r) needs the far side of a split at mu only if |d(query, vantage) - mu| <= r, by the triangle
inequality; it goes there while |d - mu| * factor <= r. Factor 1 is exact, larger ones prune more.

Shards are the leaves of such a tree over a bounded sample (the router), so near vectors share one; leaves of more than
SHARD_ROWS are dealt out by hash as several. A query first searches the shards of its own leaf. Then the
same inequality, with the radius found there, says which other leaves it has to visit.

Distances by matrix products only choose what is scored: whatever comes within their rounding of the k-th best is
scored by the measure itself, in double precision, summed in the vectors' order. So equal scores
are equal to the last bit and ties go by id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import written

LEAF = 64
SHARD_ROWS = 4096
BLOCK_QUERIES = 512
#: Vectors that the router is fitted on, at most, and the least number of them in one of its leaves.
ROUTER_SAMPLE, ROUTER_LEAF = 16_384, 8
#: Cosines by matrix products are this near to the measure.
ROUNDING = 1e-9
#: Rounding of distances that pruning must not mistake for a difference.
SLACK = 1e-6
#: Pairs scored at once.
_PAIRS = 50_000


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with v as doubles; vectors null, zero, or holding null or non-finite components take no part."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & whole & F.exists("v", lambda x: x != 0))


def _units(vectors: np.ndarray) -> np.ndarray:
    # scaled by the largest component first: squares of huge or tiny ones stay finite
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _sums(products: np.ndarray) -> np.ndarray:
    """Row sums, one term after the other."""
    return np.add.accumulate(products, axis=1)[:, -1]


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (points @ others.T)))


def _split(unit: np.ndarray, rows: np.ndarray):
    """(vantage, mu, inner rows, outer rows); None where all are at one distance."""
    # of a few candidates, the one whose distances spread most
    some = rows[:: max(1, len(rows) // 64)]
    picks = rows[np.linspace(0, len(rows) - 1, 8).astype(int)]
    vantage = picks[np.argmax(_distances(unit[some], unit[picks]).std(axis=0))]
    d = _distances(unit[rows], unit[vantage][None])[:, 0]
    mu = float(np.median(d))
    outer = d > mu
    if not outer.any():  # half or more at one distance: split just below it
        outer = d >= mu
        if outer.all():
            return None
        mu = float(np.nextafter(d[outer].min(), 0))
    return int(vantage), mu, rows[~outer], rows[outer]


class Tree:
    """Nodes: (vantage row, mu, inner, outer) or the rows of a leaf; rows count in the order of ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self._prepare()
        self.root = self._grow(np.arange(len(ids)))

    def _prepare(self) -> None:
        self.unit = _units(self.vectors)
        with np.errstate(over="ignore"):
            self.norms = np.sqrt(_sums(self.vectors * self.vectors))

    def __getstate__(self):
        return self.ids, self.vectors, self.root

    def __setstate__(self, state) -> None:
        self.ids, self.vectors, self.root = state
        self._prepare()

    def _grow(self, rows: np.ndarray):
        found = _split(self.unit, rows) if len(rows) > LEAF else None
        if found is None:
            return rows
        vantage, mu, inner, outer = found
        return vantage, mu, self._grow(inner), self._grow(outer)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows), each queries x k, nearest first, ties to smaller ids; row -1: none.

        least: scores that are of no use if they are below.
        """
        unit = _units(queries)
        with np.errstate(over="ignore"):
            norms = np.sqrt(_sums(queries * queries))
        best = np.full((len(queries), k), -np.inf)
        found = np.full((len(queries), k), -1, np.int64)
        floor = np.full(len(queries), -np.inf) if least is None else least
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            node, active, gap = todo.pop()
            wanted = np.maximum(best[active, -1], floor[active]) - ROUNDING
            radius = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.maximum(wanted, -1.0)))
            open_ = (gap * factor <= radius + SLACK) | np.isneginf(wanted)
            active, wanted = active[open_], wanted[open_]
            if not len(active):
                continue
            if isinstance(node, np.ndarray):
                near = unit[active] @ self.unit[node].T
                near[query_ids[active][:, None] == self.ids[node][None, :]] = -np.inf
                if len(node) > k:  # of a leaf, no more than its k best matter, and what is as good
                    wanted = np.maximum(wanted, np.partition(near, -k, axis=1)[:, -k] - ROUNDING)
                self._score(queries, norms, near, wanted, active, node, best, found)
                continue
            vantage, mu, inner, outer = node
            d = _distances(self.unit[vantage][None], unit[active])[0]
            inside = d <= mu
            far = np.abs(d - mu)
            # the near sides are taken off the stack first
            todo += [(outer, active[inside], far[inside]), (inner, active[~inside], far[~inside])]
            todo += [(inner, active[inside], np.zeros(inside.sum())), (outer, active[~inside], np.zeros((~inside).sum()))]
        return best, found

    def _score(self, queries, norms, near, wanted, active, node, best, found) -> None:
        """Put a leaf's rows that may be among the best there, by their measures."""
        k = best.shape[1]
        some = (near >= wanted[:, None]) & np.isfinite(near)
        q, r = np.nonzero(some)
        exact = np.full(near.shape, -np.inf)
        for at in range(0, len(q), _PAIRS):
            a, b = q[at : at + _PAIRS], r[at : at + _PAIRS]
            own, other = active[a], node[b]
            with np.errstate(over="ignore", invalid="ignore"):
                score = _sums(queries[own] * self.vectors[other]) / (norms[own] * self.norms[other])
                usable = np.isfinite(norms[own]) & np.isfinite(self.norms[other]) & (norms[own] * self.norms[other] >= 1e-290)
            exact[a, b] = np.where(usable & np.isfinite(score), score, near[a, b])
        at = np.flatnonzero(some.any(axis=1))
        scores = np.concatenate([best[active[at]], exact[at]], axis=1)
        rows = np.concatenate([found[active[at]], np.broadcast_to(node, (len(at), len(node)))], axis=1)
        rows = np.where(np.isneginf(scores), -1, rows)
        order = np.lexsort((np.where(rows < 0, np.iinfo(np.int64).max, rows), -scores), axis=1)[:, :k]
        best[active[at]], found[active[at]] = np.take_along_axis(scores, order, 1), np.take_along_axis(rows, order, 1)


class Router:
    """A tree over a sample; its leaves are numbered cells. Per length of vectors; other lengths share 64 cells."""

    def __init__(self, samples: dict[int, np.ndarray], leaf: int):
        self.leaf, self.cells = leaf, 64
        self.trees = {n: self._grow(_units(x), np.arange(len(x))) for n, x in samples.items()}

    def _grow(self, unit: np.ndarray, rows: np.ndarray):
        found = _split(unit, rows) if len(rows) > self.leaf else None
        if found is None:
            self.cells += 1
            return self.cells - 1
        vantage, mu, inner, outer = found
        return unit[vantage], mu, self._grow(unit, inner), self._grow(unit, outer)

    def cells_of(self, vectors: np.ndarray) -> np.ndarray:
        n = vectors.shape[1]
        if n not in self.trees:
            return np.full(len(vectors), n % 64)
        unit, out = _units(vectors), np.zeros(len(vectors), np.int64)
        todo = [(self.trees[n], np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                inside = _distances(node[0][None], unit[rows])[0] <= node[1]
                todo += [(node[2], rows[inside]), (node[3], rows[~inside])]
        return out

    def visits(self, vectors: np.ndarray, radius: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows of vectors that have to look there)."""
        n = vectors.shape[1]
        if n not in self.trees:
            yield n % 64, np.arange(len(vectors))
            return
        unit = _units(vectors)
        todo = [(self.trees[n], np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                yield node, rows
            elif len(rows):
                d = _distances(node[0][None], unit[rows])[0] - node[1]
                reach = radius[rows] + SLACK
                todo += [(node[2], rows[d * factor <= reach]), (node[3], rows[-d * factor <= reach])]


def _by_length(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of a batch's column v, for each length of vectors."""
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False)
    offsets = v.offsets.to_numpy()
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, flat[(offsets[at] - offsets[0])[:, None] + np.arange(n)]


def fit_router(vectors: DataFrame, rows: int, shard_rows: int) -> Router:
    """A router with about a cell for each shard_rows of vectors(id, v), fitted on about ROUTER_SAMPLE of them at most."""
    cells = -(-rows // shard_rows)
    if cells < 2:
        return Router({}, ROUTER_LEAF)
    share = min(1 << 30, -(-(ROUTER_SAMPLE << 30) // rows))
    drawn = vectors.where(F.pmod(F.xxhash64("id", "v", F.lit(5)), F.lit(1 << 30)) < share).select("v").limit(2 * ROUTER_SAMPLE).toArrow()
    samples: dict[int, list[np.ndarray]] = {}
    for batch in drawn.to_batches():
        for _, x in _by_length(batch):
            samples.setdefault(x.shape[1], []).append(x)
    return Router({n: np.concatenate(x) for n, x in samples.items()}, max(ROUTER_LEAF, -(-drawn.num_rows // cells)))


class Index:
    """shards: a row (shard, tree) each; first and count: the shards of a cell."""

    def __init__(self, shards: DataFrame, router: Router, first: np.ndarray, count: np.ndarray):
        self.shards, self.router, self.first, self.count = shards, router, first, count


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> Index:
    """Every one of vectors(id, v) is in one shard's tree; shards hold about shard_rows at most.

    Only the router is fitted on a sample. Counts of its cells, of which there are at most ROUTER_SAMPLE / ROUTER_LEAF + 64 or so, go to the driver.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(fit_router(vectors, vectors.count(), shard_rows))

    def deal(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for at, x in _by_length(batch):
                cell[at] = shared.value.cells_of(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "cell"])

    dealt = written(vectors.select("id", "v").mapInArrow(deal, "id long, v array<double>, cell long"), "vp-cells")
    count = np.zeros(shared.value.cells, np.int64)
    for r in dealt.groupBy("cell").count().collect():
        count[r["cell"]] = -(-r["count"] // shard_rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    known = vectors.sparkSession.createDataFrame([(c, int(first[c]), int(count[c])) for c in np.flatnonzero(count).tolist()], "cell long, first long, n long")
    # rows that share an id, if many, still spread: the shard also depends on the vector and the place in the table
    place = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.col("n"))
    rows = dealt.join(F.broadcast(known), "cell").withColumn("shard", F.col("first") + place)

    def plant(key, table):
        import pyarrow as pa

        out = [(x.shape[1], Tree(table.column("id").to_numpy()[at], x)) for at, x in _by_length(table.combine_chunks().to_batches()[0])]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(out)], pa.binary())})

    shards = rows.select("shard", "id", "v").groupBy("shard").applyInArrow(plant, "shard long, tree binary")
    return Index(written(shards, "vp-index"), shared.value, first, count)


def _visited(index: Index, queries: DataFrame, k: int, factor: float, others: bool) -> DataFrame:
    """(query_id, id, score): up to k from each shard that a query visits; queries(id, v, least score wanted or null).

    A query visits the shards of its own cell, or those of the other cells that its least score leaves open.
    """
    shared = queries.sparkSession.sparkContext.broadcast((index.router, index.first, index.count))

    def route(batches: Iterator):
        import pyarrow as pa

        router, first, count = shared.value
        for batch in batches:
            least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            radius = np.where(np.isnan(least), 2.0, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (least - ROUNDING))))
            for at, x in _by_length(batch):
                own = router.cells_of(x)
                going = router.visits(x, radius[at], factor) if others else ((c, np.flatnonzero(own == c)) for c in np.unique(own).tolist())
                for cell, rows in going:
                    if others:
                        rows = rows[own[rows] != cell]
                    for shard in range(first[cell], first[cell] + count[cell]) if len(rows) else ():
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard)), *(c.take(pa.array(at[rows])) for c in batch.columns)], names=["shard", "id", "v", "least"])

    asked = queries.select("id", "v", "least").mapInArrow(route, "shard long, id long, v array<double>, least double")
    # a shard's tree, then the queries that visit it
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("id", "long"), ("v", "array<double>"), ("least", "double"))]
    met = index.shards.select("shard", "tree", *nothing).unionByName(asked.withColumn("tree", F.lit(None).cast("binary")))
    met = met.repartition("shard").sortWithinPartitions("shard", F.col("tree").isNull())

    def run(batches: Iterator):
        import pyarrow as pa

        trees: dict[int, Tree] = {}
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            planted = batch.column("tree").is_valid().to_numpy(zero_copy_only=False)
            # runs of queries between trees
            cuts = np.unique(np.concatenate([[0, len(shard)], np.flatnonzero(planted), np.flatnonzero(planted) + 1]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if planted[a]:
                    trees = dict(pickle.loads(batch.column("tree")[a].as_py()))
                    continue
                for c in range(a, b, BLOCK_QUERIES):
                    part = batch.slice(c, min(b - c, BLOCK_QUERIES))
                    ids, least = part.column("id").to_numpy(), part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    for at, x in _by_length(part):
                        tree = trees.get(x.shape[1])
                        if tree is None:
                            continue
                        best, found = tree.search(ids[at], x, k, factor, np.where(np.isnan(least[at]), -np.inf, least[at]))
                        q, j = np.nonzero(found >= 0)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at][q]), pa.array(tree.ids[found[q, j]]), pa.array(best[q, j])], names=["query_id", "id", "score"])

    return met.mapInArrow(run, "query_id long, id long, score double")


def search(index: Index, queries: DataFrame, k: int = 5, factor: float = 1.0) -> DataFrame:
    """(query_id, id, score): the k nearest and others, for each of queries(id, v) of distinct ids.

    Rows with a query's id, repeated ones too, are no candidates of it. Equal candidates (id and vector repeated)
    count each.
    """
    asked = queries.select("id", "v", F.lit(None).cast("double").alias("least"))
    near = written(_visited(index, asked, k, factor, others=False), "vp-near")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    kth = near.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    return near.unionByName(_visited(index, queries.select("id", "v").join(kth.hint("merge"), "id", "left"), k, factor, others=True))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of vectors by cosine for each row of queries.

    A query's own id is no candidate. Ties go to the smaller vec_id; repeated rows are candidates
    each; a repeated query's answer comes once. Rows with null ids or unusable vectors take no part, and
    vectors of different lengths don't meet. The score is the dot product over the product of the norms, in double
    precision; where squares overflow or vanish, it is that of the vectors scaled to length 1. Empty tables give no rows;
    columns but key and vector are not looked at.
    """
    index = build_index(valid_vectors(vectors, key, vector), shard_rows)
    asked = valid_vectors(queries, key, vector).dropDuplicates(["id"])
    scored = search(index, written(asked, "vp-queries"), k, factor).withColumnRenamed("id", "vec_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
