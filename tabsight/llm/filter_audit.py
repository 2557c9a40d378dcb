"""How a set of document filters interact, over every order of applying them.

Wide packed counters.  Every document fails a subset of the filters: its mask.
For a given mask (and the two label bits) the outcome of every step of every
order is fixed, so each of these states maps to one big integer that holds, in
``FIELD_BITS``-wide fields, all outcomes of all steps: for five filters 600
steps with six counts each.  A part's report is the sum of its documents'
integers, unpacked at the end.  Rows of one state are counted before the
shuffle, by Spark; a part then has at most 128 states, however many documents,
and each adds its integer times its count.  A field holds a count of documents
of one part: below 2**63, so no field runs into the next.

Cases: a null text is empty; a null part is the empty string; a null id has no
labels and is neither smaller than another id nor larger; rows that repeat an
id count each; labels that repeat an id count as one that has a bit if any of
them has it; an empty table gives an empty report; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tabsight.llm.common import join_small, keep, small_batches

FILTERS = "ABCDE"
FIELD_BITS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = b"#$%&*|"


def text_mask(text: str | None) -> int:
    """Bits of the filters A to D that ``text`` fails."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # at the ASCII white space of the word pattern
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return ((len(words) < 100)
            | (100 * len(set(words)) < 80 * len(words)) << 1
            | (100 * capitals > 10 * len(text or "")) << 2
            | (len(raw.translate(None, _SIGNS)) < len(raw)) << 3)


@F.pandas_udf(IntegerType())
def _text_masks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([text_mask(t) for t in part], dtype="int32")


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document."""
    small_batches(docs.sparkSession)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = keep(docs.select(docs["doc_id"].alias("id"), F.coalesce(docs["lang"], F.lit("")).alias("part"),
                            _text_masks(docs["text"]).alias("mask"),
                            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "masks")
    first = (rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
             .where("first < last").select("digest", "first"))
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    rows = join_small(join_small(rows, first, "digest", "left", 64), marks, "id", "left", 32)
    no = F.lit(False)
    return rows.select("part", (F.col("mask") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)).alias("mask"),
                       F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def orders(names: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(names)]


@cache
def packed(mask: int, good: bool, toxic: bool, names: str = FILTERS) -> int:
    """All outcomes of one document as one integer: field
    ``(order * steps + step) * len(COUNTS) + count``."""
    total = at = 0
    for order in orders(names):
        gone = False
        for name in order:
            fails = bool(mask >> names.index(name) & 1)
            removed = fails and not gone
            outcome = (not fails and not gone, removed, fails and gone, mask == 1 << names.index(name),
                       removed and good, removed and toxic)
            gone = gone or fails
            for yes in outcome:
                total |= int(yes) << at
                at += FIELD_BITS
    return total


def unpack(total: int, names: str = FILTERS) -> np.ndarray:
    """The fields of a sum: an array (orders, steps, counts)."""
    n = len(orders(names)) * len(names) * len(COUNTS)
    raw = total.to_bytes(n * FIELD_BITS // 8, "little")
    return np.frombuffer(raw, f"<u{FIELD_BITS // 8}").reshape(-1, len(names), len(COUNTS)).astype(np.int64)


def interaction_audit(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """Report of ``masks`` (part, mask, good, toxic; bit k of a mask is the
    k-th of ``names``): one row per part, order and step."""
    def report(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(int(n) * packed(int(m), bool(g), bool(t), names)
                    for m, g, t, n in zip(part["mask"], part["good"], part["toxic"], part["n"]))
        fields, every = unpack(total, names), orders(names)
        out = pd.DataFrame(fields.reshape(-1, len(COUNTS)), columns=list(COUNTS))
        out.insert(0, "part", part["part"].iloc[0])
        out.insert(1, "filter_order", np.repeat(every, len(names)))
        out.insert(2, "step", np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(every)))
        at = pd.Series([c for o in every for c in o])
        out["shapley"] = out["removed"].groupby(at).transform("sum")
        return out

    states = masks.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    longs = ", ".join(f"{c} long" for c in (*COUNTS, "shapley"))
    return states.groupBy("part").applyInPandas(report, f"part string, filter_order string, step int, {longs}")
