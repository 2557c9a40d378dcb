"""Approximate nearest neighbours: a robust-pruned directed graph per shard.

* Rows with one vector collapse to their ``k + 1`` smallest ids; every row is
  indexed, none is sampled.
* A shard (about ``SHARD_ROWS`` vectors, dealt by a hash) builds its graph in
  batches: a greedy search on the graph so far proposes neighbours, relaxed
  distance pruning (``ALPHA``) keeps diverse ones, reverse edges are added and
  pruned again when a node has too many.
* A shard centres and scales its vectors, and a search begins at ``ENTRIES``
  nodes spread over the shard, so that shifted, huge, tiny or clustered vectors
  are found as well as others.
* Every query is beam-searched on every shard's graph; the shards' answers
  meet in one ranking per query.  Distances of the result are computed in
  double precision on the original vectors.

Cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; of lengths that differ only
the most frequent one (ties: the larger) takes part; rows repeated with one id
count once (their smallest vector); ties go to the smaller id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import keep
from tabsight.llm.topk_mtree import smallest_ids, usable_vectors

SHARD_ROWS = 4096
DEGREE, SLACK, ALPHA = 32, 16, 1.2
BEAM_BUILD, BEAM_SEARCH, WIDTH = 64, 128, 4
#: Nodes of a shard at which every search begins.
ENTRIES = 48


class PrunedGraph:
    """Graph over the rows of ``x``; ``edges`` holds up to DEGREE + SLACK
    neighbours of each node, padded with -1."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, slack: int = SLACK, alpha: float = ALPHA,
                 beam: int = BEAM_BUILD):
        # centred and scaled in double precision, so that single precision
        # resolves vectors that are far off, huge or tiny
        size = np.abs(x).max(axis=0).max() or 1.0
        self.middle = (x / size).mean(axis=0) * size
        self.scale = np.abs(x - self.middle).max() or 1.0
        self.x = self.placed(x)
        self.degree, self.alpha2 = degree, alpha * alpha
        n = len(x)
        self.edges = np.full((n, degree + slack), -1, dtype=np.int32)
        self.count = np.zeros(n, dtype=np.int32)
        self.entries = self._spread(min(n, ENTRIES))
        order = np.random.default_rng(n).permutation(n)
        order = order[order != self.entries[0]]
        at, size = 0, 1
        while at < len(order):
            self._insert(order[at:at + size], beam)
            at += size
            size = min(2 * size, 256)

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Vectors as the graph holds them."""
        return np.ascontiguousarray((x - self.middle) / self.scale, dtype=np.float32)

    def _spread(self, n: int) -> np.ndarray:
        """Entry points: the most central node, then ever the one farthest from
        those taken, so that each group of vectors has one near."""
        d = (self.x ** 2).sum(axis=1)
        out = [int(d.argmin())]
        d = np.full(len(self.x), np.inf, dtype=np.float32)
        while len(out) < n:
            d = np.minimum(d, ((self.x - self.x[out[-1]]) ** 2).sum(axis=1))
            out.append(int(d.argmax()))
            if d[out[-1]] == 0:
                return np.array(out[:-1])
        return np.array(out)

    def beam(self, q: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest found nodes of each query: ids and squared distances, both
        sorted by distance; -1 pads."""
        b, n = len(q), len(self.x)
        rows = np.arange(b)
        ids = np.full((b, size), -1, dtype=np.int64)
        dist = np.full((b, size), np.inf, dtype=np.float32)
        todo = np.zeros((b, size), dtype=bool)
        seen = np.zeros((b, n + 1), dtype=bool)
        seen[:, n] = True
        start = self.entries[:size]
        m = len(start)
        d = np.stack([((q - self.x[e]) ** 2).sum(axis=1) for e in start], axis=1)
        by = np.argsort(d, axis=1, kind="stable")
        ids[:, :m], dist[:, :m] = start[by], np.take_along_axis(d, by, axis=1)
        todo[:, :m], seen[:, start] = True, True
        while True:
            live = rows[todo.any(axis=1)]
            if not len(live):
                return ids, dist
            t = todo[live]
            pick = t & (np.cumsum(t, axis=1) <= WIDTH)  # the nearest that are not expanded
            todo[live] = t & ~pick
            who, col = np.nonzero(pick)
            near = self.edges[ids[live[who], col]].astype(np.int64)
            near[near < 0] = n
            own = np.repeat(live[who], near.shape[1])
            near = near.ravel()
            new = ~seen[own, near]
            own, near = own[new], near[new]
            if not len(own):
                continue
            code = np.unique(own * (n + 1) + near)
            own, near = code // (n + 1), code % (n + 1)
            seen[own, near] = True
            gap = self.x[near] - q[own]
            d = np.einsum("ij,ij->i", gap, gap)
            start = np.searchsorted(own, live)
            length = np.searchsorted(own, live, side="right") - start
            slot = np.arange(len(own)) - np.repeat(start, length)
            wide = int(length.max())
            place = np.searchsorted(live, own)
            more_i = np.full((len(live), wide), -1, dtype=np.int64)
            more_d = np.full((len(live), wide), np.inf, dtype=np.float32)
            more_i[place, slot], more_d[place, slot] = near, d
            all_i = np.concatenate([ids[live], more_i], axis=1)
            all_d = np.concatenate([dist[live], more_d], axis=1)
            all_t = np.concatenate([todo[live], more_i >= 0], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :size]
            ids[live] = np.take_along_axis(all_i, best, axis=1)
            dist[live] = np.take_along_axis(all_d, best, axis=1)
            todo[live] = np.take_along_axis(all_t, best, axis=1)

    def _prune(self, p: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning of the candidates (padded with -1) of nodes ``p``: up
        to ``degree`` of them; a candidate goes once a kept neighbour is
        closer to it, by the factor alpha, than the node is."""
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == p[:, None]] = -1
        x = self.x[cand] - self.x[p][:, None, :]  # seen from the node, so close pairs keep their digits
        d = np.einsum("bcd,bcd->bc", x, x)
        d[cand < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        cand, d = np.take_along_axis(cand, order, axis=1), np.take_along_axis(d, order, axis=1)
        x = np.take_along_axis(x, order[:, :, None], axis=1)
        norm = np.einsum("bcd,bcd->bc", x, x)
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        live = np.isfinite(d)
        out = np.full((len(p), self.degree), -1, dtype=np.int32)
        rows = np.arange(len(p))
        for r in range(self.degree):
            some = live.any(axis=1)
            if not some.any():
                break
            j = live.argmax(axis=1)
            out[some, r] = cand[rows, j][some]
            live &= self.alpha2 * between[rows, j] > d
            live[rows, j] = False
        return out

    def _insert(self, p: np.ndarray, beam: int) -> None:
        ids, _ = self.beam(self.x[p], beam)
        out = self._prune(p, ids)
        self.edges[p, :self.degree] = out
        self.count[p] = (out >= 0).sum(axis=1)
        to, frm = out.ravel(), np.repeat(p, self.degree)
        frm, to = frm[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        frm, to = frm[order], to[order]
        nodes, start, n_new = np.unique(to, return_index=True, return_counts=True)
        cap = self.edges.shape[1]
        full = []
        for v, s, m in zip(nodes, start, n_new):
            c = self.count[v]
            if c + m <= cap:
                self.edges[v, c:c + m] = frm[s:s + m]
                self.count[v] = c + m
            else:
                full.append(np.concatenate([[v], self.edges[v, :c], frm[s:s + m]]))
        for i in range(0, len(full), 128):
            part = full[i:i + 128]
            cand = np.full((len(part), max(map(len, part)) - 1), -1, dtype=np.int64)
            for k, f in enumerate(part):
                cand[k, :len(f) - 1] = f[1:]
            v = np.array([f[0] for f in part])
            kept = self._prune(v, cand)
            self.edges[v] = -1
            self.edges[v, :self.degree] = kept
            self.count[v] = (kept >= 0).sum(axis=1)


def build_index(groups: DataFrame, shard_rows: int = SHARD_ROWS, n: int | None = None) -> DataFrame:
    """(v array<double>, ids) -> one row per shard: shard, graph (pickled)."""
    shards = max(1, -(-(groups.count() if n is None else n) // shard_rows))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ids", key=lambda s: s.map(lambda i: i[0]))
        x = np.stack(part["v"].to_numpy())
        blob = pickle.dumps((PrunedGraph(x), x, [list(map(int, i)) for i in part["ids"]]), protocol=5)
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "graph": [blob]})

    dealt = groups.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, graph binary")


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM_SEARCH) -> DataFrame:
    """(id, v) -> (query_id, rank, vec_id, score): k nearest found."""
    from pyspark.sql import Window
    n_shards, last = index.agg(F.count("*"), F.max("shard")).first()
    wanted = queries.select(F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"),
                            F.lit(None).cast("binary").alias("graph"), "id", "v")
    both = (index.select("shard", "graph", F.lit(None).cast("long").alias("id"),
                         F.lit(None).cast("array<double>").alias("v")).unionByName(wanted)
            .repartition(n_shards, "shard")
            .sortWithinPartitions("shard", F.col("id").asc_nulls_first()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = x = ids = at = None

        def answer(q_ids, vs):
            q = np.stack(vs)
            rows, _ = graph.beam(graph.placed(q), beam)
            out = []
            for q_id, v, row in zip(q_ids, q, rows):
                row = row[row >= 0]
                d = np.sqrt(((x[row] - v) ** 2).sum(axis=1))
                found = sorted((float(s), i) for s, r in zip(d, row) for i in ids[r] if i != q_id)[:k]
                out += [(int(q_id), i, s) for s, i in found]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

        for part in parts:
            q_ids, vs = [], []
            for shard, blob, i, v in zip(part["shard"], part["graph"], part["id"], part["v"]):
                if blob is None and shard == at:  # no row has a number whose hash gave no shard
                    q_ids.append(i)
                    vs.append(v)
                if vs and (blob is not None or len(vs) == 256):
                    yield answer(q_ids, vs)
                    q_ids, vs = [], []
                if blob is not None:
                    at, (graph, x, ids) = shard, pickle.loads(blob)
            if vs:
                yield answer(q_ids, vs)

    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (both.mapInPandas(run, "query_id long, vec_id long, score double")
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def nearest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100,
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """k nearest found of every row whose id is divisible by ``every``, among
    all other rows."""
    vectors = usable_vectors(rows, id_col, vector_col, nonzero=True)
    vectors = keep(vectors.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    groups = keep(smallest_ids(vectors, k + 1), "groups")
    index = keep(build_index(groups, shard_rows), "graphs")
    if not index.limit(1).count():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, vectors.where(F.col("id") % every == 0), k)
