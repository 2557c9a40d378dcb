"""Mixing sources to target weights with a multivariate-hypergeometric
splitting tree.

* Targets: sources weigh 5, 2, 1, 5, ... in code-point order and share
  ``share`` times all words; a target stops at ``most`` times its source.
* A target is a number of whole passes over the source plus a part of one.
  A pass is cut into blocks by a hash of the document id.  The part is a
  permuted prefix of the blocks; the block in which it ends is filled document
  by document.
* The blocks drawn from each source are exact quotas.  A binary tree over the
  output shards splits them: each node gives its left half a
  multivariate-hypergeometric draw of what is left.  A shard's draws are
  disjoint stretches of every source's permuted blocks, and its rows are
  ordered by a hash, which is the local shuffle.

Only sizes (no texts) are aggregated; the driver sees one row per source and
per block, and at most ``MAX_BLOCKS`` blocks of a source.  Everything follows
from hashes and seeds, so reruns agree.

Cases: null and empty texts have size 0 and are taken 0 words; a null source
is a source of its own, last in order; null ids share one block; rows repeated
with one id and size are drawn together; an empty table gives an empty mix;
other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import BROADCAST_BYTES, WORD, fresh, keep

#: Fixed values of the mixing rule.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_ROWS, MAX_BLOCKS = 256, 4096
SHARDS = 16


def targets(sizes: list[int], share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> list[float]:
    """Words wanted of each source, given in order: shares by weight, no one
    above ``most`` times its size; excess is shared again among the others."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    cap = most * np.array(sizes, dtype=float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool), share * float(sum(sizes))
    while free.any():
        want = left * w[free] / w[free].sum()
        over = np.flatnonzero(free)[want > cap[free]]
        if not len(over):
            out[free] = want
            break
        out[over] = cap[over]
        left -= cap[over].sum()
        free[over] = False
    return out.tolist()


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas (one per source) dealt over ``shards``: a (shards, sources)
    table whose columns sum to the quotas, every shard of nearly equal size."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def deal(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        part = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, part, method="marginals") if total else have * 0
        deal(lo, mid, left)
        deal(mid, hi, have - left)

    deal(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


@dataclass
class Mix:
    """Per source: size, target, blocks, passes; per drawn block: its copies
    and shard; ``edge``: the documents taken once more from the block in which
    a source's part ends."""

    sources: DataFrame
    blocks: DataFrame
    edge: DataFrame
    n_blocks: int
    n_edge: int


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _block(n_blocks, seed: int):
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), n_blocks)


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = 42) -> tuple[Mix, DataFrame]:
    """The mix, and the table (id, source, size, block) it was planned on."""
    spark = docs.sparkSession
    sized = keep(_sized(docs, id_col, text_col, source_col), "sizes")
    stats = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["words"] for r in stats], share, most)
    per_source = [(r["source"], r["words"], t, int(np.clip(-(-r["rows"] // BLOCK_ROWS), 1, MAX_BLOCKS)),
                   int(t // r["words"]) if r["words"] else 0, i)
                  for i, (r, t) in enumerate(zip(stats, wanted))]
    sources = spark.createDataFrame(
        per_source, "source string, source_size long, target double, n_blocks long, passes long, at long")
    rows = (sized.join(F.broadcast(sources.select("source", "n_blocks")) if len(per_source) < 100_000 else
                       sources.select("source", "n_blocks"), sized["source"].eqNullSafe(sources["source"]))
            .select("id", sized["source"], "size", _block(F.col("n_blocks"), seed).alias("block")))
    totals = rows.groupBy("source", "block").agg(F.sum("size").alias("words")).collect()
    by_source: dict = {}
    for r in totals:
        by_source.setdefault(r["source"], []).append((r["block"], r["words"]))
    drawn, edges, quotas = [], [], []
    for source, words, target, _, passes, i in per_source:
        order = np.random.default_rng([seed, i])
        blocks = sorted(by_source.get(source, []))
        left, extra = target - passes * words, set()
        for k in order.permutation(len(blocks)):
            if left < blocks[k][1]:
                if left > 0:
                    edges.append((source, blocks[k][0], float(left)))
                break
            extra.add(blocks[k][0])
            left -= blocks[k][1]
        draws = [(source, b, p) for p in range(passes) for b, _ in blocks] + [
            (source, b, passes) for b, _ in blocks if b in extra]
        draws = [draws[k] for k in order.permutation(len(draws))]
        drawn.append(draws)
        quotas.append(len(draws))
    dealt = split_quotas(np.array(quotas or [0]), shards, seed)
    table = []
    for i, draws in enumerate(drawn):
        ends = np.cumsum(dealt[:, i])
        shard_of = np.searchsorted(ends, np.arange(len(draws)), side="right")
        table += [(s, int(b), int(p), int(x)) for (s, b, p), x in zip(draws, shard_of)]
    blocks = spark.createDataFrame(table, "source string, block long, pass long, shard int")
    edge_blocks = spark.createDataFrame(edges, "source string, block long, words double")

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        """Documents in hash order while they fit; then, of the rest, the
        largest that still fit."""
        left, taken = float(part["words"].iloc[0]), []
        part = part.sort_values(["h", "id", "size"])  # the hash is the permutation
        n, size = part["n"].to_numpy(), part["size"].to_numpy()
        at = 0
        while at < len(part) and size[at] * n[at] <= left:
            taken.append(at)
            left -= size[at] * n[at]
            at += 1
        for k in sorted(range(at, len(part)), key=lambda k: -size[k]):
            if 0 < size[k] * n[k] <= left:
                taken.append(k)
                left -= size[k] * n[k]
        # quotas of the shards, from the same tree; the hash order deals them
        dealt = split_quotas(np.array([len(taken)]), shards, seed + int(part["block"].iloc[0]))[:, 0]
        out = part.iloc[sorted(taken)][["id", "source", "size"]]
        return out.assign(shard=np.repeat(np.arange(shards), dealt).astype("int32"))

    id_type = sized.schema["id"].dataType.simpleString()
    there = (rows["source"].eqNullSafe(edge_blocks["source"])) & (rows["block"] == edge_blocks["block"])
    edge = (rows.join(F.broadcast(edge_blocks), there)  # one block of a source at most
            .groupBy("id", rows["source"], rows["block"], "size", "words").agg(F.count("*").alias("n"))
            .withColumn("h", F.xxhash64("id", F.lit(seed + 1)))
            .withColumn("id", F.col("id").cast("string"))
            .groupBy("source", "block").applyInPandas(fill, "id string, source string, size long, shard int"))
    edge = keep(edge.withColumn("id", F.col("id").cast(id_type)), "edge")
    return Mix(sources, blocks, edge, len(table), edge.count()), rows


def _copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` (id, source, size, block, ...) with the shards that take each:
    an array column ``shards`` with one entry per copy."""
    blocks = mix.blocks.groupBy("source", "block").agg(F.sort_array(F.collect_list("shard")).alias("whole"))
    few = mix.n_blocks * 64 <= BROADCAST_BYTES
    blocks = blocks.toDF("b_source", "b_block", "whole")
    edge = mix.edge.select(F.col("id").alias("e_id"), F.col("source").alias("e_source"), F.col("size").alias("e_size"),
                           F.col("shard").alias("e_shard"))
    one = mix.n_edge * 64 <= BROADCAST_BYTES
    return (rows.join(F.broadcast(blocks) if few else blocks,
                      F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")), "left")
            .join(F.broadcast(edge) if one else edge,
                  F.col("id").eqNullSafe(F.col("e_id")) & F.col("source").eqNullSafe(F.col("e_source"))
                  & (F.col("size") == F.col("e_size")), "left")
            .withColumn("shards", F.concat(
                F.coalesce("whole", F.array().cast("array<int>")),
                F.when(F.col("e_size").isNotNull(), F.array("e_shard"))
                .otherwise(F.array().cast("array<int>"))))
            .drop("b_source", "b_block", "whole", "e_id", "e_source", "e_size", "e_shard"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **rule) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, and the
    output shards of its copies, comma-joined."""
    mix, rows = plan_mix(docs, id_col, text_col, source_col, **rule)
    s = mix.sources.select(F.col("source").alias("s_source"), "source_size", "target")
    return (_copies(rows, mix).join(F.broadcast(s) if s.count() * 64 <= BROADCAST_BYTES else s,
                                    F.col("source").eqNullSafe(F.col("s_source")))
            .select(F.col("id").alias(id_col), "size", "source_size", "target",
                    (F.size("shards") * F.col("size")).cast("long").alias("taken"),
                    F.array_join(F.array_sort(F.col("shards")).cast("array<string>"), ",").alias("shards")))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  seed: int = 42, **rule) -> DataFrame:
    """The mixed rows themselves: the columns of ``docs``, each row as often as
    it is taken, then two columns ``mix_shard`` and ``mix_order`` (with
    underscores added if ``docs`` has such columns); order rows of a shard by
    the second for the local shuffle (:func:`deal_out` does)."""
    mix, _ = plan_mix(docs, id_col, text_col, source_col, seed=seed, **rule)
    mine = ["__row", "__n", "__shard"]
    s = mix.sources.select(F.col("source").alias("s_source"), "n_blocks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(mine[0]),
                       F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = (rows.join(F.broadcast(s), F.col("source").eqNullSafe(F.col("s_source")))
            .withColumn("block", _block(F.col("n_blocks"), seed)))
    out = _copies(rows, mix).select("id", mine[0], F.posexplode("shards").alias(mine[1], mine[2]))
    shard, order = fresh(docs, "mix_shard", "mix_order")
    return out.select(f"{mine[0]}.*", F.col(mine[2]).alias(shard),
                      F.xxhash64("id", mine[1], F.lit(seed + 2)).alias(order))


def deal_out(mixed: DataFrame) -> DataFrame:
    """The result of :func:`mix_documents` with every shard in one partition,
    its rows in the order of the local shuffle; the two columns go."""
    shard, order = mixed.columns[-2:]
    n = (mixed.agg(F.max(shard)).first()[0] or 0) + 1
    dealt = mixed.repartitionById(n, F.col(shard)).sortWithinPartitions(shard, order)
    return dealt.drop(shard, order)
