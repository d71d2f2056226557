"""Exact top-k search by inner product in an M-tree.

Vectors are routed down two levels of centres fitted on a bounded sample (every row is indexed),
and each region is cut into shells around its centre that hold about CHUNK_BYTES. A shell is a
subtree: its nodes are split around members that lie far apart until a page holds at most PAGE
vectors. Every node stores its routing vector, its covering radius and its distance to its parent;
a page also the distance of each entry to its routing vector.

For a query q and a ball (c, r), q.x <= q.c + |q| r for all x in it, and q.c <= q.p + |q| d for a
child at distance d from its parent p: nodes are visited best first, and nodes, routing products
and entries are left out by the stored distances alone where the bound is below the k-th best so
far. That bound starts with the k-th best among the sample's rows and is carried from subtree to
subtree within a task. Ties are never left out.

Queries are written to the shared folder; a task that holds subtrees reads them there in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, load

K, EVERY, SCALE = 10, 100, 1024
#: Rows that the centres are fitted on, children of a node, vectors of a page, bytes of a subtree's vectors, distances told apart when shells are cut, queries read at once.
SAMPLE, FAN, PAGE, CHUNK_BYTES, BINS, QUERY_BLOCK = 4096, 8, 128, 4 << 20, 256, 4096
#: Bounds are compared with this relative slack, so that rounding never leaves out a row.
SLACK = 1e-9


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array of double, whole numbers), dim: floor(1024 x) of each component. Null vectors, and vectors with null or non-finite components, are left out."""
    good = F.col(vector).isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < math.inf))
    exact = F.transform(F.col(vector), lambda e: e.cast("double") * SCALE)
    v = F.transform(exact, lambda e: F.when(F.abs(e) < float(1 << 53), F.floor(F.when(F.abs(e) < float(1 << 53), e).otherwise(0.0)).cast("double")).otherwise(e))
    return vectors.where(good).select(F.col(key).alias("vec_id"), v.alias("v"), F.size(vector).alias("dim"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, in Python integers where doubles can't hold every sum."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < float(1 << 53):
        return a @ b.T
    return np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(-1))


def spread(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """At most k distinct centres: members far from those before them, moved to the means of what is nearest to them."""
    at, far = [0], distances(x, x[0])
    while len(at) < k and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[at[-1]]))
    c = x[at].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def fitted(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The upper centres, and the lower centres of each."""
    top = spread(x, FAN)
    near = nearest(x, top)
    return top, [spread(x[near == j], FAN) if (near == j).any() else top[j : j + 1] for j in range(len(top))]


class Tree:
    """The nodes of a subtree. Node 0 is the root; a node's children follow each other; a page holds entries first to first + count."""

    FIELDS = (("routing", "<f8"), ("radius", "<f8"), ("to_parent", "<f8"), ("child", "<i4"), ("children", "<i4"), ("first", "<i4"), ("count", "<i4"), ("ids", "<i8"), ("entries", "<f8"), ("to_page", "<f8"))

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray) -> Tree:
        t = Tree()
        t.order, nodes, at = [], [(np.arange(len(x)), 0.0, None)], 0
        routing, radius, to_parent, child, children, first, count = ([] for _ in range(7))
        placed = 0
        while at < len(nodes):
            members, _, parent = nodes[at]
            mean = x[members].mean(0)
            c = x[members[int(distances(x[members], mean).argmin())]]  # a routing vector is a member
            far = distances(x[members], c)
            routing.append(c)
            radius.append(float(far.max()))
            to_parent.append(0.0 if parent is None else float(distances(c, routing[parent])))
            if len(members) <= PAGE:
                child.append(-1)
                children.append(0)
                first.append(placed)
                count.append(len(members))
                t.order.append(members)
                placed += len(members)
            else:
                near = nearest(x[members], spread(x[members], FAN, 1))
                parts = [members[near == j] for j in np.unique(near)]
                if len(parts) == 1 or max(map(len, parts)) == len(members):
                    parts = np.array_split(members, FAN)  # equal vectors
                child.append(len(nodes))
                children.append(len(parts))
                first.append(-1)
                count.append(0)
                nodes += [(p, 0.0, at) for p in parts]
            at += 1
        t.routing, t.radius, t.to_parent = np.array(routing), np.array(radius), np.array(to_parent)
        t.child, t.children, t.first, t.count = (np.array(v, "<i4") for v in (child, children, first, count))
        order = np.concatenate(t.order)
        t.ids, t.entries = ids[order], x[order]
        t.to_page = np.concatenate([distances(x[m], t.routing[k]) for k, m in zip(np.flatnonzero(t.child < 0), t.order)])
        return t

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, n), t).tobytes() for n, t in self.FIELDS]

    @staticmethod
    def read(values: list[bytes], dim: int) -> Tree:
        t = Tree()
        for (n, kind), v in zip(Tree.FIELDS, values):
            setattr(t, n, np.frombuffer(v, kind))
        t.routing, t.entries = t.routing.reshape(len(t.radius), dim), t.entries.reshape(len(t.ids), dim)
        return t

    def search(self, q: np.ndarray, k: int, worst: float) -> tuple[list[tuple[int, int, bool]], float, int]:
        """Best first: the rows (vec_id, score, whether the vector is q itself) that may be among the k best, the k-th best score (or worst), and how many products it took."""
        norm = math.sqrt(float(q @ q))
        at_root = float(self.routing[0] @ q)
        made, queue = 1, [(-(at_root + norm * self.radius[0]), 0, at_root)]
        scores, ids, own = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

        def slack(bound: float) -> float:
            return SLACK * (abs(bound) + norm * norm + 1)

        while queue:
            bound, node, here = heapq.heappop(queue)
            if -bound + slack(bound) < worst:
                break  # what is left is bounded lower
            if self.child[node] >= 0:
                c = slice(self.child[node], self.child[node] + self.children[node])
                rough = here + norm * (self.to_parent[c] + self.radius[c])  # without a product
                open_ = np.flatnonzero(rough + slack(float(np.abs(rough).max())) >= worst) + c.start
                there = self.routing[open_] @ q
                made += len(open_)
                for j, product in zip(open_.tolist(), there.tolist()):
                    heapq.heappush(queue, (-(product + norm * float(self.radius[j])), j, product))
                continue
            e = np.arange(self.first[node], self.first[node] + self.count[node])
            rough = here + norm * self.to_page[e]
            e = e[rough + slack(float(np.abs(rough).max(initial=0))) >= worst]
            if not len(e):
                continue
            s = products(q[None], self.entries[e])[0]
            made += len(e)
            scores, ids, own = np.concatenate([scores, s]), np.concatenate([ids, self.ids[e]]), np.concatenate([own, (self.entries[e] == q).all(1)])
            if len(scores) > k:
                best = sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k] if scores.dtype == object else np.lexsort((ids, -scores))[:k]
                scores, ids, own = scores[best], ids[best], own[best]
            if len(scores) == k:
                worst = max(worst, float(scores[-1]))
        return [(int(i), int(s), bool(o)) for i, s, o in zip(ids, scores, own)], worst, made


ROUTED = "vec_id long, v array<double>, dim int, top int, leaf int, far double"
CHUNKS = "dim int, top int, leaf int, to_top double, far double, tree array<binary>"


def indexed(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, dict]:
    """The subtrees of all rows of `quantised` vectors, written, and the fit: by dim the sample's vectors, upper and lower centres."""
    spark = vectors.sparkSession
    drawn = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toPandas()  # at most SAMPLE rows
    fit = {}
    for dim, rows in drawn.groupby("dim"):
        x = np.stack(rows["v"].to_numpy()) if dim else np.zeros((len(rows), 0))
        fit[int(dim)] = (x, rows["vec_id"].to_numpy(np.int64), *fitted(x))
    told = spark.sparkContext.broadcast(fit)

    def centres(dim: int) -> tuple[np.ndarray, list[np.ndarray]]:
        # A length that the sample has missed is one region around 0.
        return told.value[dim][2:] if dim in told.value else (np.zeros((1, dim)), [np.zeros((1, dim))])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            top, leaf, far = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                i = np.flatnonzero(dims == dim)
                x = np.asarray(b.column(1).take(pa.array(i)).flatten()).reshape(len(i), dim)
                upper, lower = centres(int(dim))
                t = nearest(x, upper)
                for j in np.unique(t):
                    m = t == j
                    near = nearest(x[m], lower[j])
                    top[i[m]], leaf[i[m]], far[i[m]] = j, near, distances(x[m], lower[j][near])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top), pa.array(leaf), pa.array(far)], names=["vec_id", "v", "dim", "top", "leaf", "far"])

    rows = scratch.save("routed", vectors.mapInArrow(routed, ROUTED))
    region = ["dim", "top", "leaf"]
    size = rows.groupBy(*region).agg(F.max("far").alias("most"))
    capacity = F.greatest(F.lit(PAGE), F.floor(F.lit(float(CHUNK_BYTES)) / (8 * F.col("dim") + 8)))
    # At most FAN * FAN regions a length, with BINS distances each. Bins that are too large for a subtree are dealt out by hash: their rows are equally far.
    place = F.when(F.col("most") > 0, F.least(F.floor(F.col("far") / F.col("most") * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
    binned = rows.join(F.broadcast(size), region).withColumn("bin", place).drop("most")
    counts = binned.groupBy(*region, "bin").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / capacity))
    before = Window.partitionBy(*region).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    small = F.when(F.col("parts") == 1, F.col("n")).otherwise(0)
    shell = F.when(F.col("parts") > 1, -1 - F.col("bin").cast("long")).otherwise(F.floor(F.coalesce(F.sum(small).over(before), F.lit(0)) / capacity))
    cut = scratch.save("shells", counts.withColumn("shell", shell).select(*region, "bin", "shell", "parts"))
    dealt = binned.join(F.broadcast(cut), [*region, "bin"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts")))

    def built(t: pa.Table) -> pa.Table:
        dim, top, leaf = (t.column(c)[0].as_py() for c in region)
        x = np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, dim)
        upper, lower = centres(dim)
        tree = Tree.of(t.column("vec_id").to_numpy(), x)
        to_top = float(distances(tree.routing[0], upper[top]))
        return pa.Table.from_pylist([{"dim": dim, "top": top, "leaf": leaf, "to_top": to_top, "far": float(tree.radius[0]), "tree": tree.packed()}], schema=pa.schema([("dim", pa.int32()), ("top", pa.int32()), ("leaf", pa.int32()), ("to_top", pa.float64()), ("far", pa.float64()), ("tree", pa.list_(pa.binary()))]))

    chunks = dealt.groupBy(*region, "shell", "part").applyInArrow(built, CHUNKS)
    return scratch.save("chunks", chunks), fit


FOUND = "query_id long, query long, times long, vec_id long, score long, own boolean"


class Queries:
    """Blocks of queries of one length, read from the folder, and what a task knows of each: 8 bytes a query."""

    def __init__(self, uri: str, k: int, fit: dict):
        fs, base = pafs.FileSystem.from_uri(uri)
        self.files = pads.dataset(base, filesystem=fs, format="parquet")
        self.k, self.fit, self.worst = k, fit, {}

    def blocks(self, dim: int) -> Iterator[tuple[int, list, np.ndarray]]:
        """Number, (vec_id, query, times) and vectors of each block."""
        for n, b in enumerate(self.files.to_batches(columns=["vec_id", "query", "times", "v"], filter=pads.field("dim") == dim, batch_size=QUERY_BLOCK)):
            if b.num_rows:
                yield n, list(zip(*(b.column(c).to_pylist() for c in range(3)))), np.asarray(b.column(3).flatten()).reshape(b.num_rows, dim)

    def bounds(self, dim: int, n: int, q: np.ndarray) -> np.ndarray:
        """The k-th best score of each query so far: at first, among the sample."""
        if (dim, n) not in self.worst:
            x = self.fit[dim][0] if dim in self.fit else np.zeros((0, dim))
            worst = np.full(len(q), -math.inf)
            if len(x) >= self.k:
                worst = np.array(-np.partition(-products(q, x), self.k - 1, axis=1)[:, self.k - 1], float)
            self.worst[dim, n] = worst
        return self.worst[dim, n]


def searched(rows: list[dict], queries: Queries) -> Iterator[list[tuple]]:
    """Rows of FOUND of each block of queries in some subtrees, by one pass over the queries; whole subtrees are left out by their distance to the upper centre."""
    trees: dict[int, list[tuple[Tree, np.ndarray, float]]] = {}
    for r in rows:
        upper = queries.fit[r["dim"]][2][r["top"]] if r["dim"] in queries.fit else np.zeros(r["dim"])
        trees.setdefault(r["dim"], []).append((Tree.read(r["tree"], r["dim"]), upper, r["to_top"] + r["far"]))
    for dim, held in trees.items():
        for n, keys, q in queries.blocks(dim):
            worst, out = queries.bounds(dim, n, q), []
            norm = np.sqrt((q * q).sum(1))
            for tree, upper, far in held:
                bound = q @ upper + norm * far
                for j in np.flatnonzero(bound + SLACK * (np.abs(bound) + norm * norm + 1) >= worst).tolist():
                    got, worst[j], _ = tree.search(q[j], queries.k, float(worst[j]))
                    out += [(*keys[j], i, s, o and i == keys[j][0]) for i, s, o in got]
            if out:
                yield out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row among all other rows; ties to the smaller id.

    Both tables as `quantised` gives them; a query is a row of `vectors`. Only vectors of the
    query's length are compared. Null ids take no part. Repeated rows are candidates each, and
    queries each: rows that share an id are told apart by their vectors, and the result of a row
    that stands several times is repeated as often. Other columns are not looked at; an empty table
    gives none. A result whose score needs over 64 bits raises. A task holds the subtrees of a split of their files, one block of queries, and 8 bytes for each query.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "mtree")
    chunks, fit = indexed(vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v", "dim"), scratch)
    asked = queries.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id"), "v", "dim").agg(F.count("*").alias("times"))
    scratch.save("queries", asked.withColumn("query", F.xxhash64("vec_id", "v")))
    folder, told = f"{scratch.base}/queries", spark.sparkContext.broadcast(fit)  # at most SAMPLE vectors and FAN * FAN centres a length
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("times", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.bool_())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Queries(folder, k + 1, told.value)  # the query's own row may be among the best
        for b in batches:
            for rows in searched(b.to_pylist(), known):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    found = chunks.mapInArrow(search, FOUND)
    # Of each query the k + 1 best rows are kept before and after the shuffle; its own row, if it is among them, is left out once.
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    mine = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("query_id", "query"))
    top = top.withColumn("_own", mine).where("_own is null or rank <> _own").withColumn("rank", F.when(F.col("rank") > F.col("_own"), F.col("rank") - 1).otherwise(F.col("rank"))).where(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return top.withColumn("_k", again).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
