"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct shingles of five words (the whole
sequence, if it has fewer).  ``COLLECTIONS`` small collections of
``PER_COLLECTION`` min-hashes each are computed once; a table key combines a
pair of collections.  With 14 collections of 2, 28 min-hashes serve 91 tables
of 4, and a pair of similarity 0.75 misses all of them with probability 2e-4.

Work per step, so that no group is ever expanded into all its pairs:

1. documents with equal sets collapse to one representative (partial
   aggregation, so copies never meet in one task);
2. every bucket links its members to its smallest one; the distinct links are
   confirmed on full sets, rebuilt from the texts;
3. in buckets whose members still lie in different components, the members
   outside the bucket's first component are compared with the others.  Pairs
   within a component need no comparison, as they cannot change the result,
   and neither do pairs whose rare shingles leave too little to share (an
   exact bound: heavily edited members of a large group fall out here instead
   of meeting the whole group).

Cases: null and empty texts, and texts without words, have an empty set and
are linked with nothing; rows sharing an id are one document, that of their
smallest text (``n_rows`` tells their number); a null id is linked with nothing
and gets a null component; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import join_large, join_small, keep, small_batches
from tabsight.llm.components import components

WORDS = 5
PERCENT = 75
COLLECTIONS = 14
PER_COLLECTION = 2
#: Sets holding a shingle, up to which it counts as rare in step 3.
RARE = 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of hashed shingles."""

    def __init__(self, words: int = WORDS):
        import xxhash
        self.hash, self.words = xxhash.xxh3_64_intdigest, words

    def word_hashes(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.hash, found), dtype=np.uint64, count=len(found))

    def sequence(self, text: str | None) -> np.ndarray:
        """One hash per shingle, in order; one for a short text."""
        h = self.word_hashes(text)
        k = min(self.words, len(h))
        if not k:
            return h
        n = len(h) - k + 1
        out = h[:n] + np.uint64(k)
        for i in range(1, k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
        return _mix(out)

    def of(self, text: str | None) -> np.ndarray:
        """The sorted set."""
        return np.unique(self.sequence(text))


def signature_udf(collections: int = COLLECTIONS, per: int = PER_COLLECTION):
    """Column function text -> struct(set size, fingerprint of the set,
    collection hashes); the last two are null for an empty set."""
    @F.pandas_udf("n long, print binary, bands array<long>")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import hashlib
        sets = Shingles()
        seeds = _mix(np.arange(1, collections * per + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for part in parts:
            out = []
            for text in part:
                s = sets.of(text)
                if not len(s):
                    out.append((0, None, None))
                    continue
                low = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(s), 4096):
                    x = (s[at:at + 4096, None] ^ seeds) * np.uint64(0xD6E8FEB86659FD93)
                    np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0), out=low)
                acc = np.zeros(collections, dtype=np.uint64)
                for col in low.reshape(collections, per).T:
                    acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + col)
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), acc.view(np.int64)))
            yield pd.DataFrame(out, columns=["n", "print", "bands"])
    return sign


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, last, left = Shingles(), None, None
        for part in parts:
            good = []
            for a, b, ta, tb in zip(part["u"], part["v"], part["ta"], part["tb"]):
                if a != last:
                    last, left = a, sets.of(ta)
                right = sets.of(tb)
                both = len(np.intersect1d(left, right, assume_unique=True))
                good.append(100 * both >= percent * (len(left) + len(right) - both))
            yield part.loc[np.array(good, dtype=bool), ["u", "v"]]

    full = join_large(join_large(pairs, texts.select(F.col("id").alias("u"), F.col("text").alias("ta")), "u"),
                      texts.select(F.col("id").alias("v"), F.col("text").alias("tb")), "v")
    return full.select("u", "v", "ta", "tb").mapInPandas(check, "u long, v long")


def _key(i: Column, j: Column, bands: Column, collections: int) -> Column:
    """Table key of collections i > j."""
    return F.xxhash64(i * collections + j, bands[i], bands[j])


def _open_pairs(shared: DataFrame, roots: DataFrame, texts: DataFrame, groups: DataFrame, percent: int,
                collections: int) -> DataFrame:
    """Pairs in buckets of several components that may still be linked.

    Two sets share at most the smaller of their counts of common shingles plus
    the rare ones (in at most ``RARE`` sets) that both hold.  Pairs that share
    rare shingles are listed from the short lists of those; for all others the
    common shingles alone must allow the similarity."""
    member = join_large(shared, roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = (member.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low <> high").select("key", "low"))
    open_ = keep(join_large(member, mixed, "key"), "open")
    reps = keep(join_large(open_.select("rep", "root").distinct(), groups.select("rep", "n", "bands"), "rep"), "reps")

    def spell(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Shingles()
        for part in parts:
            found = [sets.of(text).view(np.int64) for text in part["text"]]
            if found:
                yield pd.DataFrame({"rep": np.repeat(part["id"].to_numpy(), [len(f) for f in found]),
                                    "shingle": np.concatenate(found)})

    held = join_small(texts, reps.select(F.col("rep").alias("id")), "id", "left_semi", 16).mapInPandas(
        spell, "rep long, shingle long")
    few = held.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") <= RARE)
    rare = keep(join_large(held, few, "shingle"), "rare")
    known = keep(join_large(reps, rare.groupBy("rep").agg(F.count("*").alias("r")), "rep", "left")
                 .select("rep", "root", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("common"), "bands"), "known")
    both = known.toDF("u", "ru", "nu", "cu", "bu")
    other = known.toDF("v", "rv", "nv", "cv", "bv")

    def allowed(shared_rare):
        most = F.least("cu", "cv") + shared_rare
        return (F.col("ru") != F.col("rv")) & (100 * most >= percent * (F.col("nu") + F.col("nv") - most))

    lists = rare.where("df > 1").select("shingle", "rep")
    listed = (join_large(lists.toDF("shingle", "u"), lists.toDF("shingle", "v"), "shingle").where("u < v")
              .groupBy("u", "v").agg(F.count("*").alias("k")))
    listed = join_large(join_large(listed, both, "u"), other, "v").where(allowed(F.col("k")))
    # a member whose common shingles can't reach the similarity even with the
    # bucket's smallest set has no partner but listed ones; the others meet in
    # bands of set sizes, of which only neighbours are similar enough
    able = join_large(open_.select("key", "low", "rep"), known, "rep")
    least = able.groupBy("key").agg(F.min("n").alias("least"))
    able = keep(join_large(able, least, "key").where(100 * F.col("common") >= percent * (F.col("n") + F.col("least") - F.col("common")))
                .withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(max(100 / percent, 1.01))).cast("int")), "able")
    left = able.where("root <> low").select("key", "band", F.col("rep").alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu"),
                                            F.col("common").alias("cu"), F.col("bands").alias("bu"))
    right = able.select("key", F.explode(F.sequence(F.col("band") - 2, F.col("band") + 2)).alias("band"), F.col("rep").alias("v"),
                        F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("common").alias("cv"), F.col("bands").alias("bv"))
    # a pair counts in the first table that it shares only
    same = F.filter(F.sequence(F.lit(0), F.lit(collections - 1)), lambda i: F.col("bu")[i] == F.col("bv")[i])
    once = F.transform(F.array(same), lambda m: _key(m[1], m[0], F.col("bu"), collections))[0] == F.col("key")
    bucketed = join_large(left, right, ["key", "band"]).where(allowed(F.lit(0)) & once)
    return (listed.select("u", "v").union(bucketed.select(F.least("u", "v"), F.greatest("u", "v"))).distinct())


def one_text_per_id(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``source`` with the smallest text of every repeated id, and a table
    (id, n_rows) of the ids that repeat.  Only rows of such ids are shuffled
    with their texts."""
    repeated = keep(source.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n_rows"))
                    .where("n_rows > 1"), "repeated")
    n = repeated.count()
    if not n:
        return source, repeated
    ids = repeated.select("id")
    again = join_small(source, ids, "id", "left_semi", 16, n).groupBy("id").agg(F.min("text").alias("text"))
    return join_small(source, ids, "id", "left_anti", 16, n).union(again.select(*source.columns)), repeated


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    collections: int = COLLECTIONS, per: int = PER_COLLECTION) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, n_rows."""
    source, repeated = one_text_per_id(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    small_batches(docs.sparkSession)
    sig = keep(source.select("id", signature_udf(collections, per)("text").alias("s")).select("id", "s.*"), "signatures")
    linked = sig.where("id IS NOT NULL AND n > 0")
    groups = keep(linked.groupBy("print").agg(F.min("id").alias("rep"), F.max("n").alias("n"),
                                              F.min_by("bands", "id").alias("bands")), "sets")
    keys = F.explode(F.array(*[_key(F.lit(i), F.lit(j), F.col("bands"), collections)
                               for i in range(collections) for j in range(i)]))
    rows = groups.select(keys.alias("key"), "rep")
    tops = rows.groupBy("key").agg(F.min("rep").alias("top"), F.count("*").alias("size")).where("size > 1")
    shared = keep(join_large(rows, tops.select("key", "top"), "key"), "buckets")
    sizes = groups.select("rep", "n")

    def sized(p: DataFrame) -> DataFrame:
        """Pairs whose set sizes alone allow the similarity."""
        return (join_large(join_large(p, sizes.toDF("u", "nu"), "u"), sizes.toDF("v", "nv"), "v")
                .where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v"))

    stars = shared.where("rep <> top").select(F.col("top").alias("u"), F.col("rep").alias("v")).distinct()
    first = keep(sized(stars), "pairs")
    wanted = keep(shared.select(F.col("rep").alias("id")).distinct(), "wanted")
    texts = keep(join_small(source, wanted, "id", "left_semi", 16), "texts")
    edges = keep(_confirm(first, texts, percent), "links")
    rest = join_large(_open_pairs(shared, components(edges), texts, groups, percent, collections), first, ["u", "v"], "left_anti")
    more = keep(_confirm(keep(rest, "pairs"), texts, percent), "links")
    roots = components(edges.union(more)).withColumnRenamed("node", "rep")
    home = join_large(groups, roots, "rep", "left").select("print", F.coalesce("root", "rep").alias("root"))
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id")))
    found = join_large(sig.select("id", "n", "print"), home, "print", "left")
    return (join_small(found, repeated, "id", "left", 24)
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                    F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
                    F.coalesce("n_rows", F.lit(1)).cast("long").alias("n_rows")))
