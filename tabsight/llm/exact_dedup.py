"""Exact duplicates by a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z.

1. Every row becomes (id, row number, digest), written once; all later steps
   read this narrow table and no text.
2. Spark's ``freqItems`` (the Misra-Gries summary of Karp, Schenker and
   Papadimitriou: it merges, and misses no digest above its support) names at
   most ``1 / SUPPORT`` candidates.  They are counted exactly, combined before
   the shuffle, and those above the support are the verified winners.
3. The winners (a digest, the row that stays, the size: at most ``1 / SUPPORT``
   rows, whatever the table holds) are broadcast, and their rows are answered
   and taken out on the map side.
4. What is left has no group above ``SUPPORT`` of all rows and is shuffled by
   digest as usual.

Cases: a null text counts as empty; a null id is smaller than any other, so
such a row stays only where its group has no id at all; of rows that repeat an
id and a text one stays; an empty table gives an empty result; other columns
are not read, and :func:`deduplicate` hands them on whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import keep

#: Share of all rows above which a digest is a heavy hitter.
SUPPORT = 0.001

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased; a text of ASCII alone takes the cheap way."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(F.length(text) == F.octet_length(text), F.lower(text))
            .otherwise(F.translate(text, _UPPER, _UPPER.lower())))


def heavy_hitters(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, best, size) of the digests that hold more than ``support`` of
    ``rows``; ``best`` is the (id, -row number) of the row that stays."""
    found = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    exact = rows.join(F.broadcast(found), "digest").groupBy("digest").agg(*_winner())
    return exact.where(F.col("size") > support * rows.count())


def _winner(over=None) -> list[Column]:
    cols = F.max(F.struct("id", (-F.col("row")).alias("order"))), F.count(F.lit(1))
    return [(c.over(over) if over else c).alias(n) for c, n in zip(cols, ("best", "size"))]


def _resolve(rows: DataFrame, support: float) -> DataFrame:
    heavy = F.broadcast(keep(heavy_hitters(rows, support), "heavy"))
    common = rows.join(heavy, "digest")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti")
    found = common.unionByName(rest.select("*", *_winner(Window.partitionBy("digest"))))
    return found.withColumn("kept", F.col("row") == -F.col("best.order"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id`` (id of the row of its
    group that stays), ``group_size``, ``kept`` and ``text_sha256``."""
    rows = docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.sha2(normalised(docs[text_col]).cast("binary"), 256).alias("digest"))
    return _resolve(keep(rows, "digests"), support).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), "kept",
        F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.  The rows are
    written once beside their digests, so that both come from one reading."""
    whole = keep(docs.select(docs[id_col].alias("id"), F.monotonically_increasing_id().alias("row"),
                             F.sha2(normalised(docs[text_col]).cast("binary"), 256).alias("digest"),
                             F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole")), "documents")
    gone = _resolve(whole.select("id", "row", "digest"), support).where("NOT kept").select("row")
    return whole.join(gone, "row", "left_anti").select("whole.*")
