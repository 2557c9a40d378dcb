"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-proximal,
elastic net) and calibrated with a temperature.

* Features: n-grams of one to three characters of the lower-cased text, every
  character but letters read as a space, hashed into ``DIMS`` buckets;
  weight (1 + ln count) * idf, scaled to length one.
* Document frequencies cover every training document, in one pass with one
  partial count per task.
* The weights are fitted on a bounded sample of labelled documents: at most
  ``per_language`` of each language, chosen by a hash of the document id.  The
  sample is drawn by a filter whose rate follows from the counts per language,
  so neither the corpus nor a hot language is shuffled.
* One fifth of the sample, never used for the weights, fixes the temperature.

Cases: a text that is null or without a letter gets ``und`` with score 0, as
does every text when nothing can be learned (an empty table, no label).  A
null id is never used for training and counts as held out.  Repeated rows are
predicted each on its own; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import small_batches

BITS = 15
DIMS = 1 << BITS
#: Bound of the training sample: documents of each language.
PER_LANGUAGE = 600
UNKNOWN = "und"
_SLICE = 1 << 19


class Grams:
    """Hashed n-gram counts of a text."""

    def __init__(self):
        self.letters = np.zeros(0x110000, dtype=bool)
        self.letters[[c for c in range(0x110000) if chr(c).isalpha()]] = True

    def counts(self, text: str) -> np.ndarray:
        raw = text.lower().encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(raw, dtype=np.uint32)
        codes = np.where(self.letters[codes], codes, np.uint32(32))
        gap = codes == 32
        if len(codes) > 1:
            codes = codes[~(gap & np.concatenate(([False], gap[:-1])))]
        total = np.zeros(DIMS, dtype=np.int64)
        for at in range(0, len(codes), _SLICE):
            c = codes[at:at + _SLICE + 2]
            shift = np.uint32(32 - BITS)
            one = c[:_SLICE] * np.uint32(0x9E3779B1)
            two = c[:-1][:_SLICE] * np.uint32(0x85EBCA6B) + c[1:][:_SLICE] * np.uint32(0xC2B2AE35)
            three = two[:len(c) - 2] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1) if len(c) > 2 else two[:0]
            for part in (one[c[:_SLICE] != 32], two * np.uint32(0x2C1B3C6D), three * np.uint32(0x297A2D39)):
                total += np.bincount(part >> shift, minlength=DIMS)
        return total

    def vector(self, text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts(text)
        at = np.flatnonzero(n)
        v = (1.0 + np.log(n[at])) * idf[at]
        norm = np.sqrt((v * v).sum())
        return at, v / norm if norm else v


@dataclass
class LanguageModel:
    """Learned languages with weights, biases, idf and temperature."""

    langs: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIMS))
    temperature: float = 1.0

    def column(self):
        """Column function text -> struct(lang_pred, score)."""
        model = self

        @F.pandas_udf("lang_pred string, score double")
        def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            grams = Grams()
            for part in parts:
                out = []
                for text in part:
                    if not model.langs or not text or not any(map(str.isalpha, text)):
                        out.append((UNKNOWN, 0.0))
                        continue
                    at, v = grams.vector(text, model.idf)
                    z = (model.weights[:, at] @ v + model.bias) / model.temperature
                    p = np.exp(z - z.max())
                    k = int(p.argmax())
                    out.append((model.langs[k], float(p[k] / p.sum())))
                yield pd.DataFrame(out, columns=["lang_pred", "score"])
        return predict


def held_out(id_col: str = "doc_id"):
    """True where a document may not be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Documents holding each bucket, over all rows of the column ``text``."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, total = Grams(), np.zeros(DIMS, dtype=np.int64)
        for part in parts:
            for text in part["text"]:
                total += grams.counts(text or "") > 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype("int32"), "n": total[at]})

    rows = (texts.select("text").mapInPandas(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).toPandas())  # at most DIMS rows
    out = np.zeros(DIMS)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"]
    return out


def ftrl(examples: list, classes: int, alpha: float, beta: float, l1: float, l2: float,
         epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (class, buckets, values) examples; the last of the
    ``DIMS + 1`` columns is the unpenalised bias."""
    z, n = np.zeros((classes, DIMS + 1)), np.zeros((classes, DIMS + 1))

    def weights(at):
        lasso = np.where(at == DIMS, 0.0, l1)
        ridge = np.where(at == DIMS, 0.0, l2)
        zz = z[:, at]
        return -np.sign(zz) * np.maximum(np.abs(zz) - lasso, 0) / ((beta + np.sqrt(n[:, at])) / alpha + ridge)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            y, at, v = examples[k]
            at, v = np.append(at, DIMS), np.append(v, 1.0)
            w = weights(at)
            s = w @ v
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = p[:, None] * v
            g2 = g * g
            step = (np.sqrt(n[:, at] + g2) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - step * w
            n[:, at] += g2
    w = weights(np.arange(DIMS + 1))
    return w[:, :DIMS], w[:, DIMS]


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """Temperature of least log loss, by a shrinking search over its log."""
    if not len(y):
        return 1.0

    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    mid, width = 0.0, 3.0
    for _ in range(12):
        grid = np.linspace(mid - width, mid + width, 13)
        mid = float(grid[int(np.argmin([loss(t) for t in grid]))])
        width /= 3
    return float(np.exp(np.clip(mid, -3.0, 3.0)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02,
        l2: float = 0.1, epochs: int = 4) -> LanguageModel:
    """Learn from the labelled rows of ``docs`` that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    train = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
             .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id")))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel()
    langs = sorted(sizes)
    df = document_frequencies(train)
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1.0
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_language / sizes[k])))])
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

    def to_vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for part in parts:
            out = []
            for i, lang, text in zip(part["id"], part["lang"], part["text"]):
                at, v = grams.vector(text, idf)
                out.append((i, lang, at.astype("<i4").tobytes(), v.astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["id", "lang", "at", "v"])

    id_type = train.schema["id"].dataType.simpleString()
    sample = (train.where(draw < F.element_at(rate, F.col("lang")))
              .mapInPandas(to_vectors, f"id {id_type}, lang string, at binary, v binary")
              .withColumn("aside", F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(5)) == 0))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "lang"])
        kinds = {k: i for i, k in enumerate(langs)}
        ex = [(kinds[k], np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float))
              for k, a, v in zip(rows["lang"], rows["at"], rows["v"])]
        aside = rows["aside"].to_numpy(dtype=bool)
        w, b = ftrl([e for e, x in zip(ex, aside) if not x], len(langs), alpha, beta, l1, l2, epochs)
        held = [e for e, x in zip(ex, aside) if x]
        scores = np.array([w[:, a] @ v + b for _, a, v in held]).reshape(-1, len(langs))
        t = fit_temperature(scores, np.array([e[0] for e in held], dtype=np.int64))
        return pd.DataFrame({"lang": langs, "bias": b, "w": [x.astype("<f8").tobytes() for x in w],
                             "temperature": t})

    # one group: the sample is bounded by per_language and the languages
    rows = (sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(learn, "lang string, bias double, w binary, temperature double")
            .orderBy("lang").collect())
    if not rows:
        return LanguageModel()
    return LanguageModel([r["lang"] for r in rows], np.array([np.frombuffer(r["w"]) for r in rows]),
                         np.array([r["bias"] for r in rows]), idf, rows[0]["temperature"])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out`` of lang_pred and score."""
    small_batches(docs.sparkSession)
    return docs.withColumn(out, model.column()(F.col(text_col)))
