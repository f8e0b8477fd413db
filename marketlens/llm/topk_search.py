"""Exact top-k inner-product search, best first over a forest of M-trees.

Vectors go to the cell of their nearest routing vector; a cell of more than GROUP vectors is dealt
into parts by hash. Each part is an M-tree: inner nodes hold FAN routing vectors at most with their
covering radii and their distances to the parent's, leaves are pages of PAGE vectors with
their distances to the page's routing vector. For a query q, a subtree of routing vector p and radius r
holds no inner product above q.p + |q| r (triangle inequality).

A query's search keeps a heap of subtrees in order of that bound and stops when the best one left is below
its k-th best score. Before a product with a child's routing vector or a member is computed, the stored
parent distance gives the bound q.parent + |q| (distance + radius), which often makes it unnecessary.

A first pass searches each query's own part, for its k-th best score there. With that score as floor, a
query is sent to those cells only whose covering radius allows a better one; it travels as small integers, and
a task holds one part and at most about RUN queries. A part returns only scores that can still count. Scores
are exact integers; ties go to the smaller vec_id.

Vectors that are null or hold null or non-finite components, or whose row has no vec_id, take no
part; vectors of different lengths never meet. Every row is a candidate of its own and, if its
vec_id is divisible by EVERY, a query of its own whose candidates are all other rows, those with an equal vec_id
or vector included. Routing vectors come from about SAMPLE rows picked by hash; they change cost only.
"""

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.llm.common import checkpointed, lean, lean_group, lean_pair, table

K = 20
SCALE = 64
EVERY = 20  # queries are vec_ids divisible by this
SAMPLE = 2048  # vectors from which routing vectors are chosen
CELLS = (16, 256)  # routing vectors of cells: least and most
GROUP = 16384  # vectors of a tree
RUN = 16384  # queries that meet a tree in one task
FAN = 16
PAGE = 512


def usable(table_):
    """Rows that take part: a number of their own, vec_id, integer components, their number."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = table_.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return checkpointed(rows.withColumn("dim", F.size("x")))


def far_apart(x, n):
    """Up to n rows of x, each the farthest from those before."""
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def routing_vectors(vectors, n):
    """Far-apart vectors of each length, from a sample picked by hash."""
    cells = int(min(CELLS[1], max(CELLS[0], n // GROUP)))
    rows = vectors.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n))) < SAMPLE).select("dim", "x").collect()
    found = {}
    for dim in {r.dim for r in rows}:
        x = np.array([r.x for r in rows if r.dim == dim], float).reshape(-1, dim)
        found[dim] = far_apart(x[np.lexsort(x.T)], cells) if dim else x[:1]
    return found


def matrix(column, dim):
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), dim)


def _cells(shared):
    def assign(batches):
        routes = shared.value
        for batch in batches:
            cell, dist = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.inf)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim in routes:  # lengths that the sample lacks make one cell of unknown radius
                    x, p = matrix(batch.column("x").take(pa.array(at)), dim), routes[dim]
                    cell[at] = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
                    dist[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist)], [*batch.schema.names, "cell", "dist"])

    return lean(assign)


class Tree:
    """An M-tree over vectors; nodes are (route, radius, members or children)."""

    def __init__(self, rows, ids, x):
        self.rows, self.ids, self.x = rows, ids, x
        self.largest = float(np.abs(x).max()) if x.size else 0.0
        self.root = self.node(np.arange(len(ids)), x[0]) if len(ids) else None

    def node(self, at, route):
        dist = np.sqrt(((self.x[at] - route) ** 2).sum(axis=1))
        if len(at) <= PAGE:
            order = np.argsort(-dist, kind="stable")
            return route, float(dist.max()), (dist[order], at[order], self.x[at[order]]), None
        routes = far_apart(self.x[at[:: max(1, len(at) // 256)]], min(FAN, 1 + len(at) // PAGE))
        own = ((routes**2).sum(axis=1) - 2 * self.x[at] @ routes.T).argmin(axis=1)
        if np.bincount(own).max() > 0.75 * len(at):  # equal or crowded vectors: cut at distances instead
            own = np.argsort(np.argsort(dist, kind="stable")) * FAN // len(at)
            routes = np.stack([self.x[at[own == i]].mean(axis=0) for i in range(FAN)])
        children = [self.node(at[own == i], routes[i]) for i in range(len(routes)) if (own == i).any()]
        routes = np.stack([c[0] for c in children])
        between = np.sqrt(((routes - route) ** 2).sum(axis=1))
        return route, float(dist.max()), (between, np.array([c[1] for c in children]), routes), children

    def search(self, row, q, floor, k):
        """The k best (score, vec_id) of a query, best first; scores under floor are left out."""
        best, tie = [], itertools.count()
        if self.root is None:
            return best
        norm = float(np.sqrt(q @ q))
        exact = self.largest * float(np.abs(q).max(initial=0)) * len(q) < 2**53
        center = float(q @ self.root[0])
        heap = [(-np.inf, next(tie), center, self.root)]
        while heap:
            bound, _, center, (_, _, stored, children) = heapq.heappop(heap)
            if -bound < floor:
                break
            slack = 1e-6 * (1 + abs(center))
            if children is None:
                dist, at, x = stored
                if norm * dist[0] + center + slack < floor:  # members are in order of falling distance
                    continue
                near = int(np.searchsorted(-dist, (center + slack - floor) / norm, "right")) if norm and floor > -np.inf else len(dist)
                score = products(q, x[:near], exact)
                for i in np.flatnonzero(score >= floor):
                    j = at[i]
                    if self.rows[j] != row:
                        item = (int(score[i]), -int(self.ids[j]))
                        if len(best) < k:
                            heapq.heappush(best, item)
                        elif item > best[0]:
                            heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
                continue
            between, radii, routes = stored
            use = np.flatnonzero(center + slack + norm * (between + radii) >= floor)
            near = routes[use] @ q
            bounds = near + norm * radii[use] + 1e-6 * (1 + np.abs(near))
            for i in np.flatnonzero(bounds >= floor):
                heapq.heappush(heap, (-bounds[i], next(tie), float(near[i]), children[use[i]]))
        return [(s, -v) for s, v in sorted(best, reverse=True)]


def products(q, x, exact=True):
    """Integer inner products of a vector with rows; exact says whether floating point holds them."""
    return x @ q if exact else x.astype(np.int64) @ q.astype(np.int64)


def packed(v):
    """A vector's bytes, as 16-bit integers where they hold it."""
    return v.astype(np.int16).tobytes() if len(v) and np.abs(v).max() < 2**15 else v.tobytes()


def unpacked(column, dim):
    values = [np.frombuffer(b.as_buffer(), np.int16 if len(b.as_buffer()) == 2 * dim else float) for b in column]
    return np.array(values, float).reshape(len(values), dim)


def _tree(rows):
    order = np.lexsort((rows["row"].to_numpy(), rows["vec_id"].to_numpy()))
    rows = rows.take(pa.array(order))
    return Tree(rows["row"].to_numpy(), rows["vec_id"].to_numpy(), matrix(rows["x"], rows["dim"][0].as_py()))


ASKED = "row long, query_id long, dim int, floor double, q binary"


def _floors(k, every):
    def floors(rows):
        tree = _tree(rows)
        ask = np.flatnonzero(tree.ids % every == 0)
        least = [-np.inf if len(got) < k else float(got[-1][0]) for got in (tree.search(tree.rows[i], tree.x[i], -np.inf, k) for i in ask)]
        columns = [pa.array(tree.rows[ask]), pa.array(tree.ids[ask]), pa.array(np.full(len(ask), tree.x.shape[1], np.int32)), pa.array(least, pa.float64()), pa.array([packed(tree.x[i]) for i in ask], pa.binary())]
        return pa.table(columns, names=["row", "query_id", "dim", "floor", "q"])

    return lean_group(floors)


def _routed(shared):
    """Each query once per cell whose bound reaches its floor."""

    def route(batches):
        routes, radii = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                cells = sorted(c for d, c in radii if d == dim)
                if not cells:
                    continue
                r = np.array([radii[dim, c] for c in cells])
                if dim in routes:
                    q = unpacked(part.column("q"), dim)
                    near = q @ routes[dim][cells].T
                    bound = near + np.sqrt((q**2).sum(axis=1))[:, None] * r + 1e-6 * (1 + np.abs(near))
                else:
                    bound = np.full((part.num_rows, len(cells)), np.inf)
                i, j = np.nonzero(bound >= part.column("floor").to_numpy()[:, None])
                if len(i):
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(i)).columns, pa.array(np.array(cells, np.int64)[j])], [*part.schema.names, "cell"])

    return lean(route)


def _search(k):
    def search(rows, asked):
        out = [[], [], [], []]
        if rows.num_rows and asked.num_rows:
            tree = _tree(rows)
            q = unpacked(asked["q"], tree.x.shape[1])
            for i, (row, query, floor) in enumerate(zip(*(asked[c].to_pylist() for c in ("row", "query_id", "floor")), strict=True)):
                for score, vec in tree.search(row, q[i], floor, k):
                    for o, v in zip(out, (row, query, vec, score), strict=True):
                        o.append(v)
        return pa.table([pa.array(o, pa.int64()) for o in out], names=["row", "query_id", "vec_id", "score"])

    return lean_pair(search)


def top_k(table_, k=K, every=EVERY):
    """query_id, rank, vec_id, score: the k greatest integer inner products of every query."""
    context = table_.sparkSession.sparkContext
    vectors = usable(table_)
    n = vectors.count()
    routes = routing_vectors(vectors, n)
    placed = checkpointed(vectors.mapInArrow(_cells(context.broadcast(routes)), "row long, vec_id long, x array<double>, dim int, cell long, dist double"))
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / GROUP).alias("parts"), F.max("dist").alias("radius"))
    radii = {(r.dim, r.cell): r.radius for r in cells.collect()}
    placed = placed.join(cells.select("dim", "cell", "parts"), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).select("dim", "cell", "part", "row", "vec_id", "x")
    asked = checkpointed(placed.groupBy("dim", "cell", "part").applyInArrow(_floors(k, every), ASKED))
    runs = max(1, -(-asked.count() // RUN))
    sent = asked.mapInArrow(_routed(context.broadcast((routes, radii))), f"{ASKED}, cell long").join(cells.select("dim", "cell", "parts"), ["dim", "cell"])
    sent = sent.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    key = ["dim", "cell", "part", "run"]
    found = dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    """op9: the 20 greatest scores of every vector whose vec_id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 64)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.id AS id, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.id <> c.id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
