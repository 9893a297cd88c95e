"""Approximate nearest neighbours by balanced posting lists.

Centroids are found by recursive balanced clustering of a bounded sample
(``MAX_SAMPLE`` rows, those with the smallest hash of their id), so that no
list holds much more than its share. Vectors are compared on the unit sphere of
one more dimension: x / M with a last component sqrt(1 - |x/M|^2), M the
largest norm; a query becomes [q/|q|, 0], so that the order of distances to it
is the order of inner products whatever the norms. Every row, not only the sample, is indexed: it goes to the
list of its nearest centroid and, if it lies near a boundary, also to further
ones whose distance is within ``BOUNDARY`` of the nearest (``REPLICAS`` at
most).

Centroids sit in memory with a navigable graph (each one's nearest centroids
and a few long edges). A search walks it from fixed entries, in waves: every
centroid met that is among the ``beam`` nearest, or within the limit, opens its
neighbours. It keeps every list whose distance ratio to the best is within a
limit, and the nearest lists until they hold enough rows. No number of lists
caps it. The limit is measured, not set: the exact neighbours of ``PROBES``
rows are found by one pass over all rows, and the limit is the least ratio that
keeps ``TARGET`` of them; the walk's beam is doubled until walks meet those
lists. Where distances say little, most lists are read.
Scores are inner products of the original vectors in double precision.

Lists that lie near each other stand on one shelf of about ``SHELF_ROWS``
postings; a longer list is cut over several shelves by a hash of the id, so a
vector that a third of all rows share does not end in one task. Queries go to
the shelves of their lists, in blocks of about ``QUERY_ROWS``, and meet them in
one matrix product. First each query reads only the shelf of its nearest list;
the score of its k-th best there is a floor, and the other shelves return only
what reaches it, so what leaves them does not grow with the number of lists
read. No row is dropped or capped.

A query is refused nothing for want of rows: if its lists hold fewer than k
other rows, it reads all of them (``exact=True`` does so for every query, which
is brute force in blocks).

Defined cases: rows whose vector is null, empty, zero, of another length than
the most common, or holds a null or non-finite component take no part, as
query or candidate; a query never finds its own id; fewer than k candidates
give fewer rows; ties go to the smaller id; of rows with one id a query finds
the best one;
empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import inline_rows, stored, table

MAX_SAMPLE = 20_000
LIST_ROWS = 400
MAX_CENTROIDS = 4096
BOUNDARY = 1.03
REPLICAS = 4
PROBES = 256
TARGET = 0.96
#: What the walk may lose of ``TARGET``.
WALK_LOSS = 0.01
GRAPH_EDGES = 16
BEAM = 64
SHELF_ROWS = 16_384
QUERY_ROWS = 4096
#: Scores of one matrix product.
BLOCK_SCORES = 1 << 21
TOP = 20


def lift(x: np.ndarray, scale: float) -> np.ndarray:
    """Rows of x / scale with one more component that makes them unit vectors."""
    x = x / scale
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], 1)


def aim(q: np.ndarray) -> np.ndarray:
    """Rows of q as unit vectors of the lifted space: nearer there means a larger inner product."""
    return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], 1)


def balanced_centroids(x: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Centroids of ``n`` parts of nearly equal size: repeated halving along 2-means directions."""
    rng = np.random.default_rng(seed)
    parts, out = [(np.arange(len(x)), n)], []
    while parts:
        own, k = parts.pop()
        if k <= 1 or len(own) <= 1:
            if len(own):
                out.append(x[own].mean(0))
            continue
        a, b = x[rng.choice(own, 2, replace=len(own) < 2)]
        for _ in range(6):
            side = x[own] @ (b - a)
            cut = np.argpartition(side, len(own) // 2)
            near, far = own[cut[: len(own) // 2]], own[cut[len(own) // 2 :]]
            a, b = x[near].mean(0), x[far].mean(0)
        split = len(own) * (k // 2) // k
        cut = np.argsort(x[own] @ (b - a), kind="stable")
        parts += [(own[cut[split:]], k - k // 2), (own[cut[:split]], k // 2)]
    out = np.array(out)  # in the order of the tree, so that neighbours stand together
    return out[np.sort(np.unique(out, axis=0, return_index=True)[1])]


def best_of(q: np.ndarray, own: np.ndarray, floor: np.ndarray, read: np.ndarray, x: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, spare: int = REPLICAS):
    """Rows (query, vector, score) of the k best per query among the lists it reads, ties to the smaller id.

    own: id of each query; floor: score that a result must reach; read: which
    list numbers (0 up) each query reads; lists: the list number of each vector.
    """
    out, step, norm = [], max(1, BLOCK_SCORES // max(1, len(x))), np.sqrt((x * x).sum(1).max(initial=0.0))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        rough = part @ x.T
        rough[~read[a : a + step][:, lists] | (own[a : a + step, None] == ids)] = -np.inf
        slack = 1e-9 * (1 + norm * np.sqrt((part * part).sum(1)))
        least = floor[a : a + step] - slack
        wide = k * spare  # a vector may stand in so many lists
        if len(x) > wide:
            least = np.maximum(least, np.partition(rough, len(x) - wide, axis=1)[:, len(x) - wide] - slack)
        r, c = np.nonzero((rough >= least[:, None]) & (rough > -np.inf))
        score = (x[c] * part[r]).sum(1)  # the same sum for equal vectors, whatever block they are in
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (ids[c[1:]] != ids[c[:-1]])
        r, c, score = r[new], c[new], score[new]
        rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
        keep = (rank < k) & (score >= floor[a : a + step][r])
        few = np.flatnonzero((np.bincount(r[keep], minlength=len(part)) < k) & (least > floor[a : a + step] - slack))
        if len(few):  # an id in more rows than that: look at all
            keep &= ~np.isin(r, few)
            again = best_of(part[few], own[a : a + step][few], floor[a : a + step][few], read[a : a + step][few], x, ids, lists, k, max(spare, -(-len(x) // k)))
            out.append((few[again[0]] + a, again[1], again[2]))
        out.append((r[keep] + a, c[keep], score[keep]))
    return [np.concatenate(z) for z in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow column of lists of ``dim`` numbers as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class CentroidGraph:
    """Centroids and their neighbours; ``search`` is a best-first walk."""

    def __init__(self, centroids: np.ndarray, edges: int = GRAPH_EDGES, seed: int = 7):
        self.c, n = centroids, len(centroids)
        self.sq = np.einsum("ij,ij->i", centroids, centroids)
        near = np.empty((n, min(edges, n)), np.int64)
        for i in range(0, n, 512):
            d = self.sq[None, :] - 2 * centroids[i : i + 512] @ centroids.T
            near[i : i + 512] = np.argsort(d, 1, kind="stable")[:, : min(edges, n)]
        far = np.random.default_rng(seed).integers(0, n, (n, min(4, n)))
        ring = (np.arange(n)[:, None] + 1) % n  # every centroid can be reached
        self.links = np.concatenate([near, far, ring], 1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, q: np.ndarray, beam: int, ratio: float, floor: float) -> np.ndarray:
        """Distances of the rows of q to the centroids that their walks meet; infinite for the others.

        A walk goes on while it meets one of the ``beam`` nearest or one within
        ``ratio`` of the least distance (of ``floor`` where that is less).
        """
        n = len(self.c)
        met, opened, own = np.full((len(q), n), np.inf), np.zeros((len(q), n), bool), np.einsum("ij,ij->i", q, q)
        new = np.zeros((len(q), n), bool)
        new[:, self.entries] = True
        while new.any():
            rows, ids = np.nonzero(new)
            for a in range(0, len(rows), 1 << 15):
                r, i = rows[a : a + (1 << 15)], ids[a : a + (1 << 15)]
                met[r, i] = np.sqrt(np.maximum(0.0, self.sq[i] - 2 * np.einsum("ij,ij->i", self.c[i], q[r]) + own[r]))
            nearest = np.partition(met, min(beam, n) - 1, axis=1)[:, min(beam, n) - 1]
            bound = np.maximum(nearest, ratio * np.maximum(met.min(1), floor))
            todo = (met <= bound[:, None]) & np.isfinite(met) & ~opened
            opened |= todo
            rows, ids = np.nonzero(todo)
            new[:] = False
            new[np.repeat(rows, self.links.shape[1]), self.links[ids].ravel()] = True
            new &= np.isinf(met)
        return met

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest centroids of every row, by blocks over all centroids."""
        ids, dist = [], []
        k = min(k, len(self.c))
        for i in range(0, len(x), 1024):
            d = self.sq[None, :] - 2 * x[i : i + 1024] @ self.c.T + np.einsum("ij,ij->i", x[i : i + 1024], x[i : i + 1024])[:, None]
            top = np.argpartition(d, k - 1, 1)[:, :k]
            v = np.take_along_axis(d, top, 1)
            order = np.argsort(v, 1, kind="stable")
            ids.append(np.take_along_axis(top, order, 1))
            dist.append(np.sqrt(np.maximum(0.0, np.take_along_axis(v, order, 1))))
        return np.concatenate(ids), np.concatenate(dist)


def chosen(graph: CentroidGraph, lengths: np.ndarray, q: np.ndarray, k: int, ratio: float, floor: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists each aimed query reads (those within the ratio, and the nearest until they hold enough rows), and its nearest list."""
    read, first = np.zeros((len(q), len(lengths)), bool), np.zeros(len(q), np.int64)
    step = max(1, (1 << 20) // len(lengths))
    for a in range(0, len(q), step):
        met = graph.search(q[a : a + step], beam, ratio, floor)
        order = np.argsort(met, 1, kind="stable")
        dist, size = np.take_along_axis(met, order, 1), lengths[order]
        keep = (dist <= np.maximum(dist[:, :1], floor) * ratio + 1e-12) | (np.cumsum(size, 1) - size <= k * REPLICAS)
        np.put_along_axis(read[a : a + step], order, keep & np.isfinite(dist), 1)
        first[a : a + step] = order[:, 0]
    read[(read * lengths).sum(1) <= k * REPLICAS] = True
    return read, first


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns vec_id and v (array<double>) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


class Index:
    """Posting lists: columns list, piece, vec_id, v; and the graph over their centroids."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", list_rows: int = LIST_ROWS):
        rows = usable(vectors, id_col, vector_col)
        spark = rows.sparkSession
        stats = rows.select(F.size("v").alias("n"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")).groupBy("n").agg(F.count("*").alias("rows"), F.max("norm").alias("norm")).orderBy(F.desc("rows"), "n").first()
        self.rows, self.empty = rows, stats is None
        if self.empty:
            return
        self.dim = dim = stats["n"]
        n_rows, self.scale = stats["rows"], float(stats["norm"])
        rows = self.rows = rows.filter(F.size("v") == dim)
        # distinct vectors by hash order, so that copies of one vector do not fill the sample
        sample = rows.groupBy(F.xxhash64("v").alias("h")).agg(F.min_by(F.struct("vec_id", "v"), "vec_id").alias("r")).select("r.*", "h").orderBy("h").limit(MAX_SAMPLE).collect()
        self.probes, self.limits = [(r["vec_id"], r["v"]) for r in sample[:PROBES]], {}
        x = lift(np.array([r["v"] for r in sample], float), self.scale)
        n_lists = int(max(1, min(MAX_CENTROIDS, n_rows // list_rows, len(x) // 2)))
        self.graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(x, n_lists)))
        graph, scale = self.graph, self.scale

        def post(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column("v")
                lifted = lift(v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim), scale)
                ids, dist = graph.value.nearest(lifted, REPLICAS)
                row, k = np.nonzero(dist <= dist[:, :1] * BOUNDARY + 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, k]), batch.column("vec_id").take(pa.array(row)), v.take(pa.array(row))], ["list", "vec_id", "v"])

        self.postings = stored(rows.mapInArrow(post, "list long, vec_id long, v array<double>"), "ann-postings")
        # one row a list, MAX_CENTROIDS at most
        self.lengths = np.zeros(len(graph.value.c), np.int64)
        for r in self.postings.groupBy("list").count().collect():
            self.lengths[r["list"]] = r["count"]
        self.shelves, at, held = [], 0, 0  # first shelf and number of shelves of each list
        for n in self.lengths.tolist():
            if held and held + n > SHELF_ROWS:
                at, held = at + 1, 0
            own = max(1, -(-n // SHELF_ROWS))
            self.shelves.append((at, own))
            at, held = (at + own, 0) if own > 1 else (at, held + n)

    def limit(self, k: int) -> tuple[float, float, int]:
        """The distance ratio that keeps ``TARGET`` of the probes' true k best, the least distance it is taken of, the beam."""
        if k not in self.limits:
            spark, graph = self.rows.sparkSession, self.graph.value
            own, q = np.array([i for i, _ in self.probes]), np.array([v for _, v in self.probes], float)
            shared, (n, dim) = spark.sparkContext.broadcast((own, q)), q.shape

            def exact(batches):
                own, q = shared.value
                score, ids, x = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros((n, k, dim))
                at = np.arange(n)[:, None]
                for batch in batches:
                    every = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
                    number = batch.column("vec_id").to_numpy()
                    for b in range(0, batch.num_rows, 4096):
                        v, i = every[b : b + 4096], number[b : b + 4096]
                        new = np.where(own[:, None] == i, -np.inf, q @ v.T)
                        top = np.argpartition(-new, min(k, len(i)) - 1, 1)[:, :k]
                        score, ids = np.concatenate([score, new[at, top]], 1), np.concatenate([ids, i[top]], 1)
                        x = np.concatenate([x, v[top]], 1)
                        top = np.argsort(-score, 1, kind="stable")[:, :k]
                        score, ids, x = score[at, top], ids[at, top], x[at, top]
                p, j = np.nonzero(score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(ids[p, j]), pa.array(score[p, j]), pa.array(list(x[p, j]), pa.list_(pa.float64()))], ["probe", "vec_id", "score", "v"])

            order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
            true = self.rows.mapInArrow(exact, "probe long, vec_id long, score double, v array<double>").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("probe", "v").collect()
            # distances of every probe to all centroids, and the nearest list that holds each neighbour
            aimed = aim(q)
            far = np.sqrt(np.maximum(0.0, graph.sq + 1 - 2 * aimed @ graph.c.T))
            least = far.min(1)
            floor = float(np.median(least))
            if not true:
                self.limits[k] = (np.inf, floor, BEAM)
            else:
                lists, dist = graph.nearest(lift(np.array([r["v"] for r in true], float), self.scale), REPLICAS)
                p = np.array([r["probe"] for r in true])
                posted = dist <= dist[:, :1] * BOUNDARY + 1e-12
                held = np.where(posted, far[p[:, None], lists], np.inf).min(1)
                ratios = held / np.maximum(np.maximum(least, floor)[p], 1e-12)
                ratio, beam, met = float(np.quantile(ratios, TARGET, method="higher")), BEAM // 2, 0.0
                while met < TARGET - WALK_LOSS and beam < len(graph.c):
                    beam *= 2
                    read, _ = chosen(graph, self.lengths, aimed, k, ratio, floor, beam)
                    met = (read[p[:, None], lists] & posted).any(1).mean()
                self.limits[k] = (ratio, floor, max(beam, BEAM))
        return self.limits[k]

    def search(self, queries: DataFrame, k: int = TOP, exact: bool = False) -> DataFrame:
        """queries: columns query_id and q. The k best of each: query_id, rank, vec_id, score."""
        spark = queries.sparkSession
        if self.empty:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        graph, lengths, dim = self.graph, self.lengths, self.dim
        limit = (np.inf, 0.0, BEAM) if exact else self.limit(k)
        shelves = inline_rows(spark, [(i, *s) for i, s in enumerate(self.shelves)], "list int, shelf int, own int")
        first_shelf, shelf_count = np.array(self.shelves).T

        def route(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = matrix(batch.column("q"), dim)
                if exact:
                    read, first = np.ones((len(q), len(lengths)), bool), np.zeros(len(q), np.int64)
                else:
                    read, first = chosen(graph.value, lengths, aim(q), k, *limit)
                rows, shelf, lists, near = [], [], [], []
                for i in range(len(q)):
                    own = np.flatnonzero(read[i])
                    own, at = np.repeat(own, shelf_count[own]), np.concatenate([np.arange(first_shelf[x], first_shelf[x] + shelf_count[x]) for x in own])
                    cuts = np.flatnonzero(np.diff(at, prepend=-1))
                    rows += [i] * len(cuts)
                    shelf += at[cuts].tolist()
                    lists += np.split(own.astype(np.int32), cuts[1:])
                    near += [first_shelf[first[i]] <= s < first_shelf[first[i]] + shelf_count[first[i]] for s in at[cuts]]
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(rows), batch.column("q").take(rows), pa.array(shelf, pa.int32()), pa.array(lists, pa.list_(pa.int32())), pa.array(near, pa.bool_())],
                    ["query_id", "q", "shelf", "lists", "first"])

        # by query, shelf after shelf: the lists it reads there
        routed = stored(queries.select("query_id", "q").mapInArrow(route, "query_id long, q array<double>, shelf int, lists array<int>, first boolean"), "ann-routes")
        postings = self.postings.withColumn("list", F.col("list").cast("int")).join(F.broadcast(shelves), "list")
        postings = postings.withColumn("shelf", F.col("shelf") + F.pmod(F.xxhash64("vec_id"), "own").cast("int")).select("shelf", "list", "vec_id", "v")

        def scan(key, left: pa.Table, right: pa.Table) -> pa.Table:
            r, c, score, ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
            if len(left) and len(right):
                ids, x = right.column("vec_id").to_numpy(), matrix(right.column("v"), dim)
                numbers, lists = np.unique(right.column("list").to_numpy(), return_inverse=True)
                wanted = left.column("lists").combine_chunks()
                where = np.searchsorted(numbers, wanted.flatten().to_numpy())
                there = where < len(numbers)
                there[there] &= numbers[where[there]] == wanted.flatten().to_numpy()[there]
                read = np.zeros((len(left), len(numbers)), bool)
                read[np.repeat(np.arange(len(left)), np.diff(wanted.offsets.to_numpy()))[there], where[there]] = True
                r, c, score = best_of(matrix(left.column("q"), dim), left.column("query_id").to_numpy(), left.column("floor").to_numpy(), read, x, ids, lists, k)
            return pa.table({"query_id": left.column("query_id").combine_chunks().take(pa.array(r, pa.int64())) if len(r) else pa.array([], pa.int64()), "vec_id": pa.array(ids[c], pa.int64()), "score": pa.array(score, pa.float64())})

        def meet(rows: DataFrame) -> DataFrame:
            """rows: query_id, q, shelf, lists, floor. What those lists hold at or above the floor, the k best of each shelf."""
            blocks = rows.groupBy("shelf").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
            rows = rows.join(blocks, "shelf").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
            spread = postings.join(blocks, "shelf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
            return stored(rows.drop("blocks").groupBy("shelf", "block").cogroup(spread.groupBy("shelf", "block")).applyInArrow(scan, "query_id long, vec_id long, score double"), "ann-found")

        near = meet(routed.filter("first").withColumn("floor", F.lit(float("-inf"))))
        floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
        rest = routed.filter("NOT first").join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        # a boundary vector is found in several lists
        best = near.union(meet(rest)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    index = Index(vectors)
    queries = index.rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return index.search(queries)
