"""Exact top-k search by inner product with M-trees.

Vectors are integers after quantising.  With one more coordinate,
sqrt(M - |x|^2) for a candidate x (M the largest squared length) and 0 for a
query, the Euclidean distance orders candidates as the inner product does,
and a metric tree applies.

* Rows with one vector collapse to their ``k + 1`` smallest ids (a partial
  top-k before the shuffle), which is all a result can show of them.
* Shards: every vector goes to its nearest of at most ``MAX_PIVOTS`` pivots;
  a large cell is dealt into several shards of about ``SHARD_ROWS`` rows.
* One M-tree per shard: pages of metric nodes with covering radii and
  distances to the parent, written as one row per shard.
* A query first searches a shard of its nearest cell; its k-th distance then
  rules out cells by the pivots' radii.  Shards stream: the tree of a shard is
  followed by its queries in a sorted partition.
* Within a tree the search is best-first; entries are skipped without a
  distance computation when |d(q, parent) - d(entry, parent)| already exceeds
  the k-th distance and the entry's radius.

Scores are exact integer products.  Cases: vectors that are null, empty or
hold null or non-finite components, and rows with a null id, take no part; of
lengths that differ only the most frequent one (ties: the larger) takes part;
repeated rows count once; equal scores go to the smaller id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import keep

SHARD_ROWS, MAX_PIVOTS, PAGE = 8192, 256, 96
SCALE = 256


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    out = (rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
           .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
           .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    if nonzero:
        out = out.where(F.exists("v", lambda x: x != 0.0))
    top = (out.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    return out.where(F.size("v") == (top[0]["d"] if top else 0))


def smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector with its ``k`` smallest ids.  The ids are
    ranked per salted part first, so a hot vector is dealt over many tasks."""
    from pyspark.sql import Window
    part = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for by in (["v", "salt"], ["v"]):
        w = Window.partitionBy(*by).orderBy("id")
        part = part.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    return part.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


class MTree:
    """M-tree over rows of ``x``.  A page is (child pages or None, rows of the
    routing objects, covering radii, distances to the page's own object)."""

    def __init__(self, x: np.ndarray, page: int = PAGE):
        self.x, self.pages = x, []
        self.root = self._build(np.arange(len(x)), None, page)

    def _dist(self, at: np.ndarray, o: int) -> np.ndarray:
        d = self.x[at] - self.x[o]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def _build(self, at: np.ndarray, parent: int | None, page: int) -> int:
        far = np.zeros(len(at)) if parent is None else self._dist(at, parent)
        if len(at) <= page:
            self.pages.append((None, at, np.zeros(len(at)), far))
            return len(self.pages) - 1
        fan = min(page, -(-len(at) // (page // 2)))
        picks = at[np.linspace(0, len(at) - 1, fan).astype(np.int64)]
        dots = self.x[at] @ self.x[picks].T
        home = np.argmin((self.x[picks] ** 2).sum(axis=1) - 2 * dots, axis=1)
        if (home == home[0]).all():  # nothing to tell apart: cut evenly
            home = np.arange(len(at)) * fan // len(at)
        children, objects, radii = [], [], []
        for g in np.unique(home):
            members = at[home == g]
            middle = self.x[members].mean(axis=0)
            o = int(members[np.argmin(((self.x[members] - middle) ** 2).sum(axis=1))])
            radii.append(float(self._dist(members, o).max()))
            objects.append(o)
            children.append(self._build(members, o, page))
        objects = np.array(objects)
        far = np.zeros(len(objects)) if parent is None else self._dist(objects, parent)
        self.pages.append((children, objects, np.array(radii), far))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, limit: float, offer) -> None:
        """Best-first: ``offer(rows, distances)`` takes found rows and returns
        the distance beyond which nothing more is wanted."""
        q2 = float(q @ q)
        heap = [(0.0, self.root, -1.0)]
        while heap:
            bound, p, d_parent = heapq.heappop(heap)
            if bound > limit:
                return
            children, objects, radii, far = self.pages[p]
            pick = np.arange(len(objects))
            if d_parent >= 0:  # stored distances first: no vector is touched
                pick = pick[np.abs(d_parent - far) - radii <= limit]
                if not len(pick):
                    continue
            x = self.x[objects[pick]]
            d = np.sqrt(np.maximum(self.norms[objects[pick]] + q2 - 2 * (x @ q), 0))
            if children is None:
                limit = min(limit, offer(objects[pick], d))
                continue
            low = np.maximum(d - radii[pick], 0)
            for i in np.flatnonzero(low <= limit):
                heapq.heappush(heap, (float(low[i]), children[pick[i]], float(d[i])))

    @property
    def norms(self) -> np.ndarray:
        if not hasattr(self, "_norms"):
            self._norms = (self.x ** 2).sum(axis=1)
        return self._norms


def _lift(v: np.ndarray, m: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(m - (v * v).sum(axis=1), 0))[:, None]])


def build_index(groups: DataFrame, m: float, pivots: np.ndarray, chunks: list[int]) -> DataFrame:
    """(v array<long>, ids) -> one row per shard: cell, shard, radius of the
    shard about its pivot, tree (pickled pages)."""
    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = _lift(np.stack(part["v"].to_numpy()).astype(float), m)
            d = np.sqrt(np.maximum((x ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * x @ pivots.T, 0))
            cell = d.argmin(axis=1)
            first = np.array([i[0] for i in part["ids"]], dtype=np.int64)
            part["cell"] = cell.astype("int32")
            part["chunk"] = [int(f) * 2654435761 % 4294967296 % chunks[c] for f, c in zip(first, cell)]
            yield part

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda s: s.map(lambda i: i[0]))
        v = np.stack(part["v"].to_numpy()).astype(np.int64)
        tree = MTree(_lift(v.astype(float), m))
        pivot = pivots[part["cell"].iloc[0]]
        radius = float(np.sqrt(((tree.x - pivot) ** 2).sum(axis=1)).max())
        blob = pickle.dumps((tree, [list(map(int, i)) for i in part["ids"]]), protocol=5)
        return pd.DataFrame({"cell": part["cell"].iloc[:1], "chunk": part["chunk"].iloc[:1], "radius": [radius],
                             "tree": [blob]})

    routed = groups.mapInPandas(route, "v array<long>, ids array<long>, cell int, chunk int")
    return routed.groupBy("cell", "chunk").applyInPandas(build, "cell int, chunk int, radius double, tree binary")


def _search(index: DataFrame, wanted: DataFrame, m: float, k: int, n_parts: int) -> DataFrame:
    """``wanted`` (cell, chunk, id, v, bound) -> (query_id, vec_id, score):
    up to k rows of each (query, shard)."""
    both = (index.select("cell", "chunk", "tree", F.lit(None).cast("long").alias("id"),
                         F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast("double").alias("bound"))
            .unionByName(wanted.select("cell", "chunk", F.lit(None).cast("binary").alias("tree"), "id", "v", "bound"))
            .repartition(n_parts, "cell", "chunk")
            .sortWithinPartitions("cell", "chunk", F.col("id").asc_nulls_first()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, ids = None, []
        for part in parts:
            out = []
            for blob, q_id, v, bound in zip(part["tree"], part["id"], part["v"], part["bound"]):
                if blob is not None:
                    tree, ids = pickle.loads(blob)
                    whole = tree.x[:, :-1].astype(np.int64)
                    continue
                q = np.asarray(v, dtype=np.int64)
                best: list[tuple[int, int]] = []  # (score, -id), the worst first
                q2 = float(q @ q)

                def offer(rows, d, best=best, q=q, q2=q2, q_id=int(q_id)):
                    order = np.argsort(d, kind="stable")
                    for r in rows[order]:
                        score = int(whole[r] @ q)
                        if len(best) == k and score < best[0][0]:
                            break
                        for i in ids[r]:
                            if i != q_id:
                                if len(best) < k:
                                    heapq.heappush(best, (score, -i))
                                elif (score, -i) > best[0]:
                                    heapq.heapreplace(best, (score, -i))
                    if len(best) < k:
                        return np.inf
                    # a hair more than the exact distance, for rounding
                    return np.sqrt(max(q2 + m - 2 * best[0][0], 0)) * (1 + 1e-9) + 1e-3

                tree.search(np.append(q.astype(float), 0.0), bound, offer)
                out += [(int(q_id), -i, s) for s, i in best]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    return both.mapInPandas(run, "query_id long, vec_id long, score long")


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50,
          scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products
    of every row whose id is divisible by ``every`` with all other rows."""
    from pyspark.sql import Window
    spark = rows.sparkSession
    vectors = usable_vectors(rows, id_col, vector_col).select(
        "id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    vectors = keep(vectors.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    groups = keep(smallest_ids(vectors, k + 1), "groups")
    length = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    n, m = groups.agg(F.count("*"), F.max(length)).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], empty)
    m = float(m)
    n_pivots = int(min(MAX_PIVOTS, max(1, n // shard_rows)))
    pivots = _lift(np.array([r["v"] for r in groups.orderBy(F.xxhash64("v"), "v").limit(n_pivots).collect()],
                            dtype=float), m)

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.stack(part["v"].to_numpy()).astype(float)
            x = np.hstack([x, np.zeros((len(x), 1))])
            part["far"] = list(np.sqrt(np.maximum(
                (x ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * x @ pivots.T, 0)))
            yield part

    # rows of each cell (at most MAX_PIVOTS numbers) give the shards of a cell
    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(pivots), dtype=np.int64)
        for part in parts:
            if len(part):
                x = _lift(np.stack(part["v"].to_numpy()).astype(float), m)
                total += np.bincount(((pivots ** 2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1), minlength=len(pivots))
        yield pd.DataFrame({"cell": np.arange(len(pivots), dtype="int32"), "n": total})

    counted = groups.select("v").mapInPandas(cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    chunks = [1] * len(pivots)
    for r in counted:
        chunks[r["cell"]] = max(1, -(-r["n"] // shard_rows))
    index = keep(build_index(groups, m, pivots, chunks), "trees")
    radius = {r["cell"]: r["r"] for r in index.groupBy("cell").agg(F.max("radius").alias("r")).collect()}
    queries = keep(vectors.where(F.col("id") % every == 0).mapInPandas(
        nearest, "id long, v array<long>, far array<double>"), "queries")
    radii = F.array(*[F.lit(float(radius.get(c, -1.0))) for c in range(len(pivots))])
    sizes = F.array(*[F.lit(c) for c in chunks])
    n_parts = max(sum(chunks), 1)
    near = F.array_position("far", F.array_min("far")).cast("int") - 1
    own = queries.withColumn("cell", near).withColumn("chunk", F.pmod(F.col("id"), sizes[F.col("cell")]).cast("int"))
    live = index.select("cell", "chunk")
    first = keep(_search(index, own.join(F.broadcast(live), ["cell", "chunk"], "left_semi")
                         .withColumn("bound", F.lit(float("inf"))), m, k, n_parts), "first")
    q2 = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    kth = first.groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("got"))
    bounded = (own.join(kth, own["id"] == kth["query_id"], "left")
               .withColumn("bound", F.when(F.col("got") == k, F.sqrt(F.greatest(q2 + m - 2 * F.col("low"), F.lit(0.0)))
                                           * (1 + 1e-9) + 1e-3).otherwise(float("inf"))))
    others = (bounded.select("id", "v", "bound", F.col("cell").alias("c0"), F.col("chunk").alias("h0"),
                             F.posexplode(F.arrays_zip("far", radii.alias("r"), sizes.alias("s"))).alias("cell", "z"))
              .where((F.col("z.r") >= 0) & (F.col("z.far") - F.col("z.r") <= F.col("bound") + 1e-3))
              .select("id", "v", "bound", "cell", "c0", "h0", F.explode(F.sequence(F.lit(0), F.col("z.s") - 1)).alias("chunk"))
              .where((F.col("cell") != F.col("c0")) | (F.col("chunk") != F.col("h0")))
              .join(F.broadcast(live), ["cell", "chunk"], "left_semi"))
    second = _search(index, others, m, k, n_parts)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(second).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
