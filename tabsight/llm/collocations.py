"""Phrases whose words go together, by counts held in weighted acyclic automata.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words ``[^\\x20\\x09]+``.  Everything is counted per language.

1. Every task reads its texts in shards of about ``SHARD_BYTES``.  The four
   words from each word on (fewer at the end of a piece) are sorted, equal ones
   are added up, and the automaton of the shard is built from the sorted list:
   as every word sequence begins somewhere, the total below a prefix is the
   number of times that the prefix occurs.
2. Shards are cut at common places of the order of sequences, so that each
   prefix range meets in one task, which adds the automata up.  The places come
   from a sample of the texts and decide on the balance alone.  A range is
   bounded by its sequences, not by a word: a frequent word spans many ranges,
   and a sequence repeated in a third of all rows is one path per shard.
3. A range reports prefixes that occur ``LEAST`` times, and those of its first
   and last path, whose totals go on in the next range; Spark adds these up.
4. The parts of every candidate are sent to the range that they belong to, and
   the automaton of the parts asked for is composed with that of the range's
   frequent phrases.  A range with many questions (all that end in a frequent
   word, say) is answered by several tasks.
5. Scores, the test against longer candidates and the first ``TOP`` phrases of
   each language are Spark expressions; products are decimals.

Cases: a null text is empty, a null language ``und``; rows count as often as
they are there, whatever their ids; other columns are not read; an empty table
gives an empty result.  A task holds one shard and the longest piece of a text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import join_small, keep, small_batches
from tabsight.llm.count_transducer import DEPTH, END, CountTransducer, first_not_below, lower_bound, sum_paths

LEAST = 30
TOP = 2000
UNKNOWN = "und"
#: Text that a shard takes in; more only if one piece is longer.
SHARD_BYTES = 8 << 20
#: Sequences of a prefix range, about, before equal ones are added up.
RANGE_WORDS = 1_000_000
#: Questions that one task answers from one range, about.
QUESTIONS = 200_000
#: Texts sampled for each place to cut at, and sequences taken from a text.
SAMPLE_TEXTS, SAMPLE_PATHS = 4, 4

_CUT = 0xFF  # no byte of UTF-8
_TABLE = bytes(_CUT if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 9 else c for c in range(256))


def _normal(text: str | None) -> bytes:
    """Lower case, tabs as spaces, pieces ending in ``_CUT``."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE) + bytes([_CUT])


def sequences(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    """Words (sorted, the end symbol first) of normal text, and the numbers of
    the ``DEPTH`` words from each word on."""
    cut = bytes([_CUT])
    tokens = raw.replace(cut, b" " + cut + b" ").split()
    words = sorted({END, *tokens} - {cut})
    rank = {w: i for i, w in enumerate(words)}
    rank[cut] = 0
    col = np.fromiter(map(rank.__getitem__, tokens), dtype=np.int32, count=len(tokens))
    del tokens, rank
    out = np.zeros((len(col), DEPTH), dtype=np.int32)
    out[:, 0] = col
    for d in range(1, DEPTH):
        out[:-d, d] = np.where(out[:-d, d - 1] > 0, col[d:], 0) if len(col) > d else out[:-d, d]
    return words, out[col > 0]


def _parts(raw: bytes) -> Iterator[bytes]:
    """Normal text cut after pieces, ``SHARD_BYTES`` or one piece long."""
    at = 0
    while len(raw) - at > SHARD_BYTES:
        end = raw.find(_CUT, at + SHARD_BYTES) + 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _shards(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    """(language, normal text) of up to about ``SHARD_BYTES``."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for part in parts:
        for lang, text in zip(part["lang"], part["text"]):
            for raw in _parts(_normal(text)):
                if size and size + len(raw) > SHARD_BYTES:
                    yield from ((k, b"".join(v)) for k, v in held.items())
                    held, size = {}, 0
                held.setdefault(lang, []).append(raw)
                size += len(raw) + 100
    yield from ((k, b"".join(v)) for k, v in held.items())


def _shard_automata(cuts: list[tuple]):
    """Function of a task: (language, range, automaton) for each shard."""
    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, raw in _shards(parts):
            words, ids = sequences(raw)
            ids, counts = sum_paths(ids, np.ones(len(ids), dtype=np.int64))
            base = bisect_left(cuts, (lang,))
            own = cuts[base:bisect_left(cuts, (lang + "\x00",))]
            edges = [0, *(first_not_below(ids, lower_bound(words, path)) for _, path in own), len(ids)]
            rows = []
            for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                if lo < hi:
                    used, small = np.unique(ids[lo:hi], return_inverse=True)
                    if used[0]:
                        used, small = np.concatenate([[0], used]), small + 1
                    part = CountTransducer.build([words[i] for i in used], small.reshape(-1, DEPTH), counts[lo:hi])
                    rows.append((lang, base + k, part.to_bytes()))
            yield pd.DataFrame(rows, columns=["lang", "range", "automaton"])
    return build


def _union(least: int):
    """Function of a prefix range: (lang, k, phrase, f) of frequent prefixes."""
    def merge(part: pd.DataFrame) -> pd.DataFrame:
        whole = CountTransducer.union([CountTransducer.from_bytes(x) for x in part["automaton"]])
        words = [w.decode("utf-8", "surrogatepass") for w in whole.words]
        rows = [(len(p), " ".join([words[i] for i in p]), n)
                for found, totals in whole.prefixes(least) for p, n in zip(found.tolist(), totals.tolist())]
        out = pd.DataFrame(rows, columns=["k", "phrase", "f"])
        out.insert(0, "lang", part["lang"].iloc[0])
        return out
    return merge


def cut_places(texts: DataFrame, range_words: int = RANGE_WORDS) -> list[tuple]:
    """Places (language, words) at which the order of sequences is cut into
    about even ranges: one for each ``range_words`` words."""
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    ranges = (size or 0) // 6 // range_words + 1  # 6: bytes of a word, about
    if ranges == 1:
        return []

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for lang, text in zip(part["lang"], part["text"]):
                words, ids = sequences(_normal(text))
                for row in ids[len(ids) // (2 * SAMPLE_PATHS)::max(1, len(ids) // SAMPLE_PATHS)][:SAMPLE_PATHS]:
                    rows.append((lang, [words[i] for i in row], len(ids) / SAMPLE_PATHS))
            yield pd.DataFrame(rows, columns=["lang", "path", "weight"])

    share = min(1.0, SAMPLE_TEXTS * (ranges + 100) / n)
    found = sorted((r[0], tuple(map(bytes, r[1])), r[2]) for r in
                   texts.sample(share, 7).mapInPandas(pick, "lang string, path array<binary>, weight double").collect())
    if not found:
        return []
    upto = np.cumsum([r[2] for r in found])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return sorted({found[i][:2] for i in at})


def _range_of(cuts: list[tuple], lang: str, phrase: str) -> int:
    path = phrase.encode("utf-8", "surrogatepass").split(b" ")
    return bisect_right(cuts, (lang, (*path, *[END] * (DEPTH - len(path)))))


def _part_weights(frequent: DataFrame, cuts: list[tuple]) -> DataFrame:
    """(lang, phrase, a, cut, side, weight): the counts of both parts (sides 0
    and 1) of every candidate cut after its first 1, 2 or 3 words."""
    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for lang, phrase, f in zip(part["lang"], part["phrase"], part["f"]):
                rows.append((lang, _range_of(cuts, lang, phrase), phrase, None, f, 0, 0))
                words = phrase.split(" ")
                for c in range(1, len(words)):
                    for side, piece in enumerate((" ".join(words[:c]), " ".join(words[c:]))):
                        rows.append((lang, _range_of(cuts, lang, piece), piece, phrase, f, c, side))
            yield pd.DataFrame(rows, columns=["lang", "range", "part", "phrase", "f", "cut", "side"])

    def answer(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        # sent with the parts asked for, so that one range's table serves them all
        names, place = np.unique(asked["part"].to_numpy(dtype=object), return_inverse=True)
        questions = CountTransducer.of_phrases([p.encode("utf-8", "surrogatepass") for p in names], np.arange(len(names)))
        table = CountTransducer.of_phrases([p.encode("utf-8", "surrogatepass") for p in entries["part"]], entries["f"])
        which, weight = table.compose(questions)
        found = np.zeros(len(names), dtype=np.int64)
        found[which] = weight
        out = asked[["lang", "phrase", "f", "cut", "side"]].rename(columns={"f": "a"})
        return out.assign(weight=found[place])

    rows = keep(frequent.select("lang", "phrase", "f").mapInPandas(
        route, "lang string, range int, part string, phrase string, f long, cut int, side int"), "parts")
    asked, entries = rows.where("phrase IS NOT NULL"), rows.where("phrase IS NULL")
    tasks = keep(asked.groupBy("lang", "range").agg(F.ceil(F.count(F.lit(1)) / QUESTIONS).cast("int").alias("tasks")), "tasks")
    n = tasks.count()
    asked = join_small(asked, tasks, ["lang", "range"], "inner", 64, n).withColumn(
        "task", F.pmod(F.xxhash64("phrase", "cut"), F.col("tasks")).cast("int"))
    entries = join_small(entries, tasks, ["lang", "range"], "inner", 64, n).withColumn(
        "task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    by = ["lang", "range", "task"]
    entries = entries.select(*[F.col(c).alias(c) for c in (*by, "part", "f")])  # both sides come from one table
    return entries.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(
        answer, "lang string, phrase string, a long, cut int, side int, weight long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, range_words: int = RANGE_WORDS) -> tuple[DataFrame, list[tuple]]:
    """(lang, k, phrase, f) of all phrases of up to four words that occur
    ``least`` times or more, with the number of words at k = 0; and the places
    where the order was cut."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(docs["lang"], F.lit(UNKNOWN)).alias("lang"), docs["text"].alias("text"))
    cuts = cut_places(texts, range_words)
    ranges = texts.mapInPandas(_shard_automata(cuts), "lang string, range int, automaton binary").groupBy("lang", "range")
    found = ranges.applyInPandas(_union(least), "lang string, k int, phrase string, f long")
    return keep(found.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
                .where((F.col("f") >= least) | (F.col("k") == 0)), "phrases"), cuts


def _inside(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): of every phrase of two words or more that stands
    inside a longer one, the largest count of these."""
    w = F.split("phrase", " ")
    inner = [(k, n, at) for k in range(3, DEPTH + 1) for n in range(2, k) for at in range(1, k - n + 2)]
    parts = F.array(*[F.when(F.col("k") == k, F.array_join(F.slice(w, at, n), " ")) for k, n, at in inner])
    return (phrases.where("k > 2").select("lang", "f", F.explode(F.array_compact(parts)).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, range_words: int = RANGE_WORDS) -> DataFrame:
    """The first ``top`` phrases of every language: (lang, rank, phrase, a, l,
    r, n, score)."""
    phrases, cuts = frequent_phrases(docs, least, range_words)
    weights = _part_weights(phrases.where("k > 0"), cuts)
    sides = {(c, s): F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("weight"))).alias(f"w{c}{s}")
             for c in range(1, DEPTH) for s in (0, 1)}
    cand = weights.groupBy("lang", "phrase", "a").agg(*sides.values())
    cut = [F.when(F.col(f"w{c}0").isNotNull(), F.struct(
        F.expr(f"CAST(2000000 AS decimal(38, 0)) * a div (w{c}0 + w{c}1)").alias("score"), F.lit(c).alias("cut"),
        F.col(f"w{c}0").alias("l"), F.col(f"w{c}1").alias("r"))) for c in range(1, DEPTH)]
    cand = cand.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*cut))).alias("best"))
    hundred = F.lit(100).cast("decimal(20, 0)")
    left = (cand.join(_inside(phrases), ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (hundred * F.col("longer") < F.lit(80).cast("decimal(20, 0)") * F.col("a"))))
    rank = [F.col("best.score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # first within shares of a language, so that no task sees all its phrases
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*rank)
    first = left.withColumn("place", F.row_number().over(share)).where(F.col("place") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*rank))).where(F.col("rank") <= top)
    words = phrases.where("k = 0").select("lang", F.col("f").alias("n"))
    return join_small(first, words, "lang", "inner", 64).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
        F.col("best.score").alias("score"))
