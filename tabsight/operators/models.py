"""Models.

Every fitted model exposes ``transform(df)`` (appends ``prediction`` and, when
the model has one, ``probability`` as ``array<double>``), ``importances()``,
``coefficients()`` and ``save(path)``; :func:`load_model` reads any of them.

* MLlib where it exists: logistic/linear regression, decision tree, random
  forest, gradient-boosted trees (one-vs-rest for multi-class), PCA.
* Gaussian naive Bayes as SQL aggregates (class priors, means, variances),
  predicted in one projection with literal parameters, or of many classes by a
  search in boxes (:mod:`tabsight.operators.class_search`).
* Exact k-nearest neighbours over pivot cells cut into rings, of which a query
  visits those that the triangle inequality leaves
  (:mod:`tabsight.operators.neighbours`).
* Kernel SVM/SVR approximated with random Fourier features (Rahimi & Recht,
  2007) computed by an Arrow-batched pandas UDF, followed by ``LinearSVC``
  (classification) or a reweighted ridge regression (regression).  These are
  approximations.
"""

from __future__ import annotations

import json
import math
import os

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.columns import col, numeric_value
from tabsight.functions.gram import masked_gram, scaled_spread
from tabsight.functions.ranking import dense_codes, join_checked
from tabsight.operators.class_search import likeliest
from tabsight.operators.neighbours import BLOCK_ROWS, NeighbourIndex
from tabsight.session import keep

SEED = 42                 # fixed value: random_state of the reference
MAX_TREE_DEPTH = 30       # MLlib's limit stands for an unbounded depth
KNN_K = 5
LAYOUT_ROWS, LAYOUT_LEAST = 100_000, 8
SPREAD_BYTES = 32 << 20   # of the random Fourier features of one partition
FEW_CLASSES = 64          # up to so many, naive Bayes parameters are literals
CLASS_BLOCK = 256         # classes of one row of the parameter table


# ---------------------------------------------------------------- helpers
def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Feature vector column from numeric (or datetime) columns."""
    tmp = [f"__f{i}" for i in range(len(features))]
    d = df.select("*", *[numeric_value(df, f).alias(t) for f, t in zip(features, tmp)])
    return VectorAssembler(inputCols=tmp, outputCol=out).transform(d).drop(*tmp)


def fixed_layout(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """Deterministic row layout for estimators whose sampling depends on the
    partitioning (bootstraps, feature subsets): hash-partition by key into a
    count and sort within partitions.  The count follows from the number of
    rows alone (one partition per ``LAYOUT_ROWS``), so the layout, and with it
    the forest, is the same under any setting."""
    n = partitions or max(LAYOUT_LEAST, -(-df.count() // LAYOUT_ROWS))
    return df.repartition(n, *[col(k) for k in keys]).sortWithinPartitions(*[col(k) for k in keys])


def class_list(df: DataFrame, label: str) -> list:
    """Sorted distinct labels (one small row per class)."""
    vals = [r[0] for r in df.select(col(label)).where(col(label).isNotNull()).distinct().collect()]
    return sorted(vals)


def _index_expr(label: str, classes: list):
    m = F.create_map(*[e for i, c in enumerate(classes) for e in (F.lit(c), F.lit(float(i)))])
    return m[col(label)]


def _label_of(idx, classes: list):
    return F.element_at(F.array(*[F.lit(c) for c in classes]), idx.cast("int") + 1)


class FittedModel:
    """Common surface of every fitted model."""

    name = "model"
    classification = True
    approximate = False

    def __init__(self, features: list[str], label: str, classes: list | None):
        self.features, self.label, self.classes = list(features), label, classes

    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - abstract
        raise NotImplementedError

    def importances(self):
        return None

    def coefficients(self):
        return None

    def _meta(self) -> dict:
        return {"kind": type(self).__name__, "name": self.name, "features": self.features,
                "label": self.label, "classes": self.classes, "classification": self.classification}

    def save(self, path: str) -> str:
        spark = SparkSession.getActiveSession()
        meta = self._meta()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(path, "meta"))
        self._save_state(path)
        return path

    def _save_state(self, path: str) -> None:
        pass


# ------------------------------------------------------------ MLlib models
class SparkModel(FittedModel):
    def __init__(self, pm: PipelineModel, features, label, classes, name, classification, scaler=None):
        super().__init__(features, label, classes)
        self.pm, self.name, self.classification = pm, name, classification

    @property
    def stage(self):
        return self.pm.stages[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        cols = df.columns
        out = self.pm.transform(assemble(df, self.features, "__features"))
        sel = [col(c) for c in cols]
        if self.classification:
            sel.append(_label_of(F.col("__pred"), self.classes).alias("prediction"))
            if "__prob" in out.columns:
                sel.append(vector_to_array("__prob").alias("probability"))
        else:
            sel.append(F.col("__pred").alias("prediction"))
        return out.select(*sel)

    def importances(self):
        st = self.stage
        if hasattr(st, "featureImportances"):
            return list(zip(self.features, [float(v) for v in st.featureImportances.toArray()]))
        if hasattr(st, "models"):            # one-vs-rest: mean over the binary models
            arrs = [m.featureImportances.toArray() for m in st.models if hasattr(m, "featureImportances")]
            if arrs:
                return list(zip(self.features, [float(v) for v in np.mean(arrs, axis=0)]))
        return None

    def coefficients(self):
        st = self.stage
        if hasattr(st, "coefficientMatrix") and self.classification:
            m = st.coefficientMatrix.toArray()
            if m.shape[0] == 1 and self.classes and len(self.classes) == 2:
                return [(str(self.classes[1]), f, float(v)) for f, v in zip(self.features, m[0])]
            return [(str(self.classes[i]), f, float(v)) for i in range(m.shape[0])
                    for f, v in zip(self.features, m[i])]
        if hasattr(st, "coefficients"):
            return [(None, f, float(v)) for f, v in zip(self.features, st.coefficients.toArray())]
        return None

    def _save_state(self, path):
        self.pm.write().overwrite().save(os.path.join(path, "pipeline"))


def _fit_spark(train: DataFrame, features, label, estimator, name, classification, classes=None):
    data = assemble(train, features, "__features")
    if classification:
        classes = classes if classes is not None else class_list(train, label)
        data = data.withColumn("__label", _index_expr(label, classes))
    else:
        data = data.withColumn("__label", col(label).cast("double"))
    estimator = estimator.copy()
    estimator.setFeaturesCol("__features").setLabelCol("__label").setPredictionCol("__pred")
    if hasattr(estimator, "setProbabilityCol") and not isinstance(estimator, OneVsRest):
        estimator.setProbabilityCol("__prob").setRawPredictionCol("__raw")
    if isinstance(estimator, OneVsRest):
        estimator.setRawPredictionCol("__raw")
    pm = Pipeline(stages=[estimator]).fit(data)
    return SparkModel(pm, features, label, classes, name, classification)


def logistic(train, features, label, C: float = 1.0, max_iter: int = 1000, classes=None, elastic_net: float = 0.0):
    """Logistic regression with sklearn's C (M1): Spark averages the loss over
    n rows, so regParam = 1 / (C * n).  ``elastic_net`` 0 is the L2 penalty, 1
    the L1 penalty."""
    n = train.count()
    est = LogisticRegression(regParam=1.0 / (C * max(n, 1)), elasticNetParam=elastic_net, standardization=False,
                             maxIter=max_iter, tol=1e-6)
    return _fit_spark(train, features, label, est, "Logistic Regression", True, classes)


def linear(train, features, label):
    """Ordinary least squares (M2)."""
    est = LinearRegression(regParam=0.0, solver="normal", standardization=False)
    return _fit_spark(train, features, label, est, "Linear Regression", False)


def random_forest(train, features, label, classification=True, num_trees=100, max_depth=MAX_TREE_DEPTH,
                  feature_subset=None, bootstrap=True, name="Random Forest", classes=None, min_leaf: int = 1):
    """Random forest (M3): 100 trees, seed 42; sqrt features for
    classification, all for regression."""
    subset = feature_subset or ("sqrt" if classification else "all")
    cls = RandomForestClassifier if classification else RandomForestRegressor
    est = cls(numTrees=num_trees, maxDepth=max_depth, featureSubsetStrategy=subset, seed=SEED,
              bootstrap=bootstrap, maxBins=64, minInstancesPerNode=min_leaf)
    return _fit_spark(train, features, label, est, name, classification, classes)


def decision_tree(train, features, label, classification=True, max_depth=MAX_TREE_DEPTH, classes=None):
    """Decision tree (M4), seed 42."""
    cls = DecisionTreeClassifier if classification else DecisionTreeRegressor
    est = cls(maxDepth=max_depth, seed=SEED, maxBins=64)
    return _fit_spark(train, features, label, est, "Decision Tree", classification, classes)


def gbt(train, features, label, classification=True, rounds=100, rate=0.1, depth=3, classes=None,
        name="Gradient Boosting"):
    """Gradient-boosted trees (M5): 100 rounds, step 0.1, depth 3; MLlib's
    classifier is binary, so more classes use one-vs-rest."""
    if classification:
        classes = classes if classes is not None else class_list(train, label)
        # one-vs-rest reads its members' raw predictions under its own name for them
        base = GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=SEED).setRawPredictionCol("__raw")
        est = base if len(classes) <= 2 else OneVsRest(classifier=base)
    else:
        est = GBTRegressor(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=SEED)
    return _fit_spark(train, features, label, est, name, classification, classes)


# ----------------------------------------------------------- Gaussian NB
class GaussianNB(FittedModel):
    """Gaussian naive Bayes from per-class counts, means and variances
    (variance smoothing 1e-9 x the largest feature variance)."""

    name = "Naive Bayes"

    def __init__(self, features, label, classes, priors, means, variances):
        super().__init__(features, label, classes)
        self.priors, self.means, self.variances = priors, means, variances

    @staticmethod
    def fit(train: DataFrame, features, label, var_smoothing: float = 1e-9) -> "GaussianNB":
        xs = [numeric_value(train, f) for f in features]
        per = train.where(col(label).isNotNull()).groupBy(col(label).alias("__c")).agg(
            F.count(F.lit(1)).alias("__n"),
            *[F.avg(x).alias(f"__m{i}") for i, x in enumerate(xs)],
            *[F.var_pop(x).alias(f"__v{i}") for i, x in enumerate(xs)]).collect()
        glob = train.agg(*[F.var_pop(x).alias(f"__g{i}") for i, x in enumerate(xs)]).first()
        eps = var_smoothing * max([glob[f"__g{i}"] or 0.0 for i in range(len(features))] or [0.0])
        per = sorted(per, key=lambda r: r["__c"])
        n = sum(r["__n"] for r in per)
        classes = [r["__c"] for r in per]
        priors = [r["__n"] / n for r in per]
        means = [[r[f"__m{i}"] for i in range(len(features))] for r in per]
        # a feature without any spread would divide by zero: floor the variance
        variances = [[max((r[f"__v{i}"] or 0.0) + eps, 1e-300) for i in range(len(features))] for r in per]
        return GaussianNB(features, label, classes, priors, means, variances)

    def _loglik(self, df):
        xs = [numeric_value(df, f) for f in self.features]
        out = []
        for c, p, mu, var in zip(range(len(self.classes)), self.priors, self.means, self.variances):
            e = F.lit(math.log(p) - 0.5 * sum(math.log(2 * math.pi * v) for v in var))
            for x, m, v in zip(xs, mu, var):
                e = e - (x - F.lit(m)) * (x - F.lit(m)) / F.lit(2 * v)
            out.append(e)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        ll = self._loglik(df)
        best = F.greatest(*[F.struct(e.alias("ll"), F.lit(-i).alias("neg")) for i, e in enumerate(ll)]) \
            if len(ll) > 1 else F.struct(ll[0].alias("ll"), F.lit(0).alias("neg"))
        mx = F.greatest(*ll) if len(ll) > 1 else ll[0]
        probs = F.array(*[F.exp(e - mx) for e in ll])
        norm = F.aggregate(probs, F.lit(0.0), lambda a, b: a + b)
        known = ll[0].isNotNull()  # a row with a null feature gets no prediction
        return df.select("*", F.when(known, _label_of(-best["neg"], self.classes)).alias("prediction"),
                         F.when(known, F.transform(probs, lambda p: p / norm)).alias("probability"))

    def _meta(self):
        m = super()._meta()
        m.update(priors=self.priors, means=self.means, variances=self.variances)
        return m


class GaussianNBTable(FittedModel):
    """:class:`GaussianNB` for many classes: their parameters are a table of
    blocks of ``CLASS_BLOCK`` classes, which Spark joins to the rows.  Nothing
    per class is on the driver."""

    name = "Naive Bayes"

    def __init__(self, features, label, blocks: DataFrame, n_classes: int):
        super().__init__(features, label, None)
        self.blocks, self.n_classes = blocks, n_classes

    @staticmethod
    def fit(train: DataFrame, features, label, var_smoothing: float = 1e-9) -> "GaussianNBTable":
        from tabsight.operators.stats import class_moments
        per = class_moments(train, features, label)
        xs = [numeric_value(train, f) for f in features]
        eps = var_smoothing * max([v or 0.0 for v in train.agg(*[F.var_pop(x) for x in xs]).first()] or [0.0])
        n, k = per.agg(F.sum("rows"), F.count(F.lit(1))).first()
        var = F.transform("var", lambda v: F.greatest(F.coalesce(v, F.lit(0.0)) + F.lit(eps), F.lit(1e-300)))
        const = F.aggregate("v", F.log(F.col("rows") / F.lit(float(n or 1))), lambda s, v: s - 0.5 * F.log(2 * math.pi * v))
        per = per.withColumn("v", var).select("label", F.struct(
            F.col("label").alias("value"), const.alias("const"), F.col("mean"),
            F.transform("v", lambda v: 0.5 / v).alias("half")).alias("c"))
        codes = dense_codes(per.select(F.lit("").alias("g"), "label"), "g", "label")
        blocks = (per.join(codes, "label").groupBy(F.floor(F.col("code") / CLASS_BLOCK).cast("int").alias("block"))
                  .agg(F.sort_array(F.collect_list(F.struct("code", "c"))).alias("classes")))
        return GaussianNBTable(features, label, keep(blocks, "classes"), k)

    def transform(self, df: DataFrame) -> DataFrame:
        xs = [numeric_value(df, f) for f in self.features]
        whole = F.lit(True)
        for x in xs:
            whole = whole & x.isNotNull()
        rows = keep(df.select("*", F.monotonically_increasing_id().alias("__id"), F.when(whole, F.array(*xs)).alias("__x")), "rows")
        n_blocks = -(-self.n_classes // CLASS_BLOCK)

        def score(x):
            def one(e):
                gaps = F.zip_with(F.zip_with(x, e["c"]["mean"], lambda a, m: (a - m) * (a - m)), e["c"]["half"], lambda g, h: g * h)
                return F.struct(F.aggregate(gaps, e["c"]["const"], lambda s, g: s - g).alias("ll"), (-e["code"]).alias("neg"),
                                e["c"]["value"].alias("value"))
            return one

        asked = rows.where("__x IS NOT NULL").select("__id", "__x", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks - 1, 0))))
                                                     .alias("block"))
        scored = (join_checked(asked, self.blocks, "block", row_bytes=CLASS_BLOCK * (32 + 16 * len(self.features)))
                  .select("__id", "block", F.transform("classes", score(F.col("__x"))).alias("s"))
                  .select("__id", "block", F.array_max("s").alias("best"), F.transform("s", lambda e: e["ll"]).alias("ll")))
        per_row = scored.groupBy("__id").agg(F.max("best").alias("best"), F.sort_array(F.collect_list(F.struct("block", "ll"))).alias("parts"))
        ex = F.transform(F.flatten(F.transform("parts", lambda p: p["ll"])), lambda v: F.exp(v - F.col("best.ll")))
        # the sum is bound to a lambda variable, so that it is taken once and not per class
        both = F.array(F.struct(F.col("ex").alias("ex"), F.aggregate("ex", F.lit(0.0), lambda a, b: a + b).alias("total")))
        share = F.transform(both, lambda e: F.transform(e["ex"], lambda v: v / e["total"]))[0]
        shares = per_row.select("__id", ex.alias("ex")).select(F.col("__id").alias("__with"), share.alias("probability"))
        # the prediction has a search of its own: Spark leaves out the join with
        # all probabilities (a row per id) where nobody reads them
        classes = self.blocks.select(F.explode("classes").alias("e")).select("e.code", "e.c.*")
        best = likeliest(rows.where("__x IS NOT NULL").select(F.col("__id").alias("id"), F.col("__x").alias("x")), classes, len(xs))
        values = classes.select(F.col("code").cast("long").alias("code"), "value")
        lowest = values.orderBy("code").limit(1).collect()
        found = join_checked(best, keep(values, "values"), "code").select(F.col("id").alias("__of"), F.col("value").alias("prediction"))
        if lowest:  # no class has all its parameters: the first
            lone = F.lit(lowest[0]["value"]).cast(values.schema["value"].dataType)
        else:
            lone = F.lit(None).cast(values.schema["value"].dataType)
        out = (rows.join(found, rows["__id"] == found["__of"], "left")
               .withColumn("prediction", F.when(F.col("__x").isNotNull(), F.coalesce("prediction", lone))))
        out = out.join(shares, out["__id"] == shares["__with"], "left")
        return out.select(*[col(c) for c in df.columns], "prediction", "probability")

    def _meta(self):
        return super()._meta() | {"n_classes": self.n_classes}

    def _save_state(self, path):
        self.blocks.write.mode("overwrite").parquet(os.path.join(path, "classes"))


def gaussian_nb(train, features, label):
    """Gaussian naive Bayes (M6).  Up to ``FEW_CLASSES`` classes their
    parameters are literals of one projection, beyond that a table."""
    if train.select(col(label)).where(col(label).isNotNull()).distinct().limit(FEW_CLASSES + 1).count() > FEW_CLASSES:
        return GaussianNBTable.fit(train, features, label)
    return GaussianNB.fit(train, features, label)


# ------------------------------------------------------------------- KNN
class KNN(FittedModel):
    """Exact k-nearest neighbours on (optionally standardised) features;
    uniform vote (ties -> smallest label) or mean of the neighbours.  Labels
    and keys may be of any type, keys may repeat; a row with a null feature is
    nobody's neighbour and gets no prediction."""

    name = "K-Nearest Neighbors"

    def __init__(self, train: DataFrame, features, label, key: str, classification: bool, k: int = KNN_K,
                 scale=None, pivots: int | None = None, block_rows: int = BLOCK_ROWS):
        super().__init__(features, label, None)
        self.train, self.key, self.classification, self.k = train, key, classification, k
        self.scale = scale            # (means, stds) or None
        self.pivots, self.block_rows = pivots, block_rows
        self._index = None

    def _vec(self, df):
        xs = [numeric_value(df, f) for f in self.features]
        if self.scale is not None:
            mu, sd = self.scale
            xs = [(x - F.lit(m)) / F.lit(s) if s else F.when(x.isNotNull(), 0.0) for x, m, s in zip(xs, mu, sd)]
        xs = [F.nanvl(x, F.lit(None).cast("double")) for x in xs]
        whole = F.lit(True)
        for x in xs:
            whole = whole & x.isNotNull()
        return F.when(whole, F.array(*xs))

    def _meta(self):
        m = super()._meta()
        m.update(key=self.key, k=self.k, scale=self.scale, classification=self.classification)
        return m

    def _save_state(self, path):
        self.train.select(col(self.key), *[col(f) for f in self.features], col(self.label)) \
            .write.mode("overwrite").parquet(os.path.join(path, "train"))

    def _fitted(self):
        """The numbered train rows and the index over them, made once."""
        if self._index is None:
            rows = keep(self.train.select(F.monotonically_increasing_id().alias("tid"), col(self.key).alias("key"),
                                          self._vec(self.train).alias("x"), col(self.label).alias("y"))
                        .where("x IS NOT NULL AND y IS NOT NULL"), "train")
            self._index = rows, NeighbourIndex(rows.select("tid", "key", "x"), self.pivots, self.block_rows)
        return self._index

    def _numbered(self, df: DataFrame) -> DataFrame:
        return keep(df.select("*", F.monotonically_increasing_id().alias("__qid"), self._vec(df).alias("__x")), "queries")

    def _search(self, rows: DataFrame):
        return self._fitted()[1].search(rows.where("__x IS NOT NULL").select(F.col("__qid").alias("qid"), F.col("__x").alias("x")),
                                        self.k)

    def neighbours(self, df: DataFrame, qkey: str | None = None) -> DataFrame:
        """``(qkey, key, dist, y, rank)`` of the k nearest training rows."""
        rows = self._numbered(df)
        asked = rows.select(F.col("__qid").alias("qid"), col(qkey or self.key).alias("qkey"))
        return (self._search(rows)[0].join(self._fitted()[0].drop("x"), "tid").join(asked, "qid")
                .select("qkey", "key", "dist", "y", "rank"))

    def candidates(self, df: DataFrame) -> DataFrame:
        """How much the bounds leave: number of queries, of train rows, and of
        distances computed."""
        rows = self._numbered(df)
        cost = self._search(rows)[1]
        return cost.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("candidates"), F.lit(0)).alias("n_distances")) \
            .select("n_queries", F.lit(self._fitted()[1].n).cast("long").alias("n_train"), "n_distances")

    def transform(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """``df`` with ``prediction``; ``key`` is not needed, rows are told
        apart by number."""
        rows = self._numbered(df)
        nb = self._search(rows)[0].join(self._fitted()[0].select("tid", "y"), "tid")
        if self.classification:
            votes = nb.groupBy("qid", "y").agg(F.count(F.lit(1)).alias("n"))
            pred = votes.groupBy("qid").agg(
                F.min_by("y", F.struct((-F.col("n")).alias("a"), F.col("y").alias("b"))).alias("prediction"))
        else:
            pred = nb.groupBy("qid").agg(F.avg(F.col("y").cast("double")).alias("prediction"))
        return rows.join(pred, rows["__qid"] == pred["qid"], "left").select(*[col(c) for c in df.columns], "prediction")


def knn(train, features, label, key, classification=True, k=KNN_K, scale=True):
    """k-nearest neighbours (M7), k=5, Euclidean, standardised with the
    training statistics."""
    sc = None
    if scale:
        r = train.agg(*[e for i, f in enumerate(features) for e in (
            F.avg(numeric_value(train, f)).alias(f"m{i}"),
            F.stddev_pop(numeric_value(train, f)).alias(f"s{i}"))]).first()
        sc = ([r[f"m{i}"] for i in range(len(features))], [r[f"s{i}"] for i in range(len(features))])
    return KNN(train, features, label, key, classification, k, sc)


# ------------------------------------------------- random Fourier features
def rff_params(d: int, n_components: int, gamma: float, seed: int = SEED):
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(d, n_components))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    return W, b


def _spread(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` dealt to as many partitions as ``width`` numbers a row will
    fill with ``SPREAD_BYTES`` each: a narrow table of few partitions becomes
    wide here."""
    return rows.repartition(max(LAYOUT_LEAST, -(-rows.count() * width * 8 // SPREAD_BYTES)))


def rff_column(x_col, W: np.ndarray, b: np.ndarray):
    """sqrt(2/D) cos(x W + b), computed per Arrow batch."""
    scale = math.sqrt(2.0 / W.shape[1])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _rff(xs: pd.Series) -> pd.Series:
        X = np.stack(xs.to_numpy()).astype(float) if len(xs) else np.zeros((0, W.shape[0]))
        Z = X @ W
        Z += b  # in place: one array of the batch's features, not four
        np.cos(Z, out=Z)
        Z *= scale
        return pd.Series(list(Z))
    return _rff(x_col)


class RFFModel(FittedModel):
    """Random-Fourier-feature kernel approximation + linear model."""

    approximate = True

    def __init__(self, features, label, classes, classification, W, b, scale, inner, name, w_reg=None):
        super().__init__(features, label, classes)
        self.classification, self.W, self.b, self.scale = classification, W, b, scale
        self.inner, self.name, self.w_reg = inner, name, w_reg

    def _z(self, df):
        mu, sd = self.scale
        xs = [(numeric_value(df, f) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
              for f, m, s in zip(self.features, mu, sd)]
        return rff_column(F.array(*xs), self.W, self.b) if self.W is not None else F.array(*xs)

    def transform(self, df):
        z = df.select("*", self._z(df).alias("__z"))
        if self.classification:
            out = self.inner.transform(z.withColumn("__zv", array_to_vector("__z")))
            return out.select(*[col(c) for c in df.columns],
                              _label_of(F.col("__pred"), self.classes).alias("prediction"))
        w, b0 = self.w_reg
        dot = F.aggregate(F.zip_with("__z", F.array(*[F.lit(float(v)) for v in w]), lambda a, c: a * c),
                          F.lit(0.0), lambda acc, v: acc + v) + F.lit(b0)
        return z.select(*[col(c) for c in df.columns], dot.alias("prediction"))


    def margins(self, df):
        """Raw SVM margins per class as ``array<double>`` (classification)."""
        z = df.select("*", self._z(df).alias("__z")).withColumn("__zv", array_to_vector("__z"))
        out = self.inner.transform(z)
        return out.select(*[col(c) for c in df.columns], vector_to_array("__raw").alias("__margin"))

    def probabilities(self, df, calibrate_on):
        """Class probabilities from margins: Platt scaling (a one-feature
        logistic regression fitted on ``calibrate_on``) for two classes, a
        softmax of the one-vs-rest margins otherwise."""
        m = self.margins(df)
        if len(self.classes) == 2:
            cal = self.margins(calibrate_on).select(F.col("__margin")[1].alias("m"),
                                                    _index_expr(self.label, self.classes).alias("y"))
            lr = LogisticRegression(featuresCol="mv", labelCol="y", regParam=0.0).fit(
                cal.select(array_to_vector(F.array("m")).alias("mv"), "y"))
            a, b = float(lr.coefficients[0]), float(lr.intercept)
            p = F.lit(1.0) / (1 + F.exp(-(F.lit(a) * F.col("__margin")[1] + F.lit(b))))
            return m.select(*[col(c) for c in df.columns], F.array(1 - p, p).alias("probability"))
        mx = F.array_max("__margin")
        ex = F.transform("__margin", lambda v: F.exp(v - mx))
        tot = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
        return m.select(*[col(c) for c in df.columns], F.transform(ex, lambda v: v / tot).alias("probability"))


def _rff_meta(self):
    m = FittedModel._meta(self)
    m.update(W=self.W if self.W is None else self.W.tolist(), b=self.b if self.b is None else self.b.tolist(),
             scale=self.scale, w_reg=self.w_reg)
    return m


def _rff_save(self, path):
    if self.inner is not None:
        self.inner.write().overwrite().save(os.path.join(path, "inner"))


RFFModel._meta = _rff_meta
RFFModel._save_state = _rff_save


def _rff_setup(train, features, n_components, gamma):
    r = train.agg(*[e for i, f in enumerate(features) for e in (
        F.avg(numeric_value(train, f)).alias(f"m{i}"), F.stddev_pop(numeric_value(train, f)).alias(f"s{i}"))]).first()
    mu = [r[f"m{i}"] for i in range(len(features))]
    sd = [r[f"s{i}"] for i in range(len(features))]
    # gamma='scale' = 1 / (d * Var(X)); X is standardised, so Var(X) = 1
    g = 1.0 / len(features) if gamma in (None, "scale", "auto") else gamma
    W, b = rff_params(len(features), n_components, g)
    return mu, sd, W, b


def svm_rbf(train, features, label, C: float = 1.0, n_components: int = 128, gamma=None, classes=None,
            kernel: str = "rbf"):
    """SVM classifier (M8) on standardised input.  The RBF kernel is
    approximated by random Fourier features, then ``LinearSVC`` (one-vs-rest
    for >2 classes); with ``kernel="linear"`` the SVC sees the input itself.
    ``gamma``: a number, or "scale" / "auto", which are both 1 / features on
    standardised input.

    ``LinearSVC`` keeps the features in blocks of its own, so they are not kept
    a second time: for two classes they are made again for its two readings,
    for more they are on disk for the readings of each class."""
    classes = classes if classes is not None else class_list(train, label)
    mu, sd, W, b = _rff_setup(train, features, n_components, gamma)
    if kernel == "linear":
        W = b = None
    tmp = RFFModel(features, label, classes, True, W, b, (mu, sd), None, "SVM")
    rows = _spread(train.select(col(label), *[col(f) for f in features]), len(features) if W is None else n_components)
    data = rows.select(_index_expr(label, classes).alias("__label"), array_to_vector(tmp._z(rows)).alias("__zv"))
    n = train.count()
    base = LinearSVC(regParam=1.0 / (C * max(n, 1)), maxIter=50, tol=1e-4, featuresCol="__zv", labelCol="__label",
                     predictionCol="__pred", rawPredictionCol="__raw")
    est = base if len(classes) <= 2 else OneVsRest(classifier=base, featuresCol="__zv", labelCol="__label",
                                                   predictionCol="__pred", rawPredictionCol="__raw")
    if est is not base:
        data = data.persist(StorageLevel.DISK_ONLY)
    try:
        tmp.inner = est.fit(data)
    finally:
        if est is not base:
            data.unpersist()
    return tmp


def svr_rbf(train, features, label, C: float = 1.0, epsilon: float = 1.35, n_components: int = 128,
            gamma=None, rounds: int = 5):
    """RBF-kernel SVR (M9), approximated: random Fourier features, then a ridge
    regression of the standardised label with the SVR's penalty.  ``rounds``
    reweighted fits make the loss linear for residuals over ``epsilon`` times
    their spread, as the SVR's is for large ones.  Each fit solves its normal
    equations, so neighbouring features that are nearly alike do no harm.  A
    label without spread is predicted by its mean."""
    mu, sd, W, b = _rff_setup(train, features, n_components, gamma)
    tmp = RFFModel(features, label, None, False, W, b, (mu, sd), None, "SVM")
    y = col(label).cast("double")
    s = train.agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.stddev_pop(y).alias("sd")).first()
    if not s["sd"]:
        tmp.w_reg = ([0.0] * n_components, float(s["m"] or 0.0))
        return tmp
    rows = _spread(train.where(y.isNotNull()).select(col(label), *[col(f) for f in features]), n_components)
    data = keep(rows.select(((y - F.lit(s["m"])) / F.lit(s["sd"])).alias("__y"), tmp._z(rows).alias("__z")),
                "svr").withColumn("__zv", array_to_vector("__z"))
    est = LinearRegression(featuresCol="__zv", labelCol="__y", predictionCol="__p", regParam=1.0 / (C * s["n"]),
                           standardization=False, solver="normal")
    fit = est.fit(data)
    for _ in range(rounds):
        spread = fit.summary.rootMeanSquaredError
        if not spread > 1e-9:
            break
        gap = F.abs(F.col("__y") - F.col("__p"))
        weighted = fit.transform(data).withColumn("__w", F.least(F.lit(1.0), F.lit(epsilon * spread) / F.greatest(gap, F.lit(1e-12))))
        fit = est.copy({est.weightCol: "__w"}).fit(weighted.drop("__p"))
    tmp.w_reg = ((fit.coefficients.toArray() * s["sd"]).tolist(), float(fit.intercept * s["sd"] + s["m"]))
    return tmp


# ------------------------------------------------------------------- PCA
def pca(df: DataFrame, columns: list[str], k: int = 2):
    """PCA on rows without nulls, centred and unscaled (C7).  Returns
    ``(loadings, explained_ratio, means)``; each component's sign makes its
    largest absolute loading positive.

    One aggregate gives the ranges and means of the complete rows, one pass
    their sums of products as matrices (:mod:`tabsight.functions.gram`); the
    d x d eigen-decomposition runs on the driver, as MLlib's PCA does."""
    xs = [numeric_value(df, c) for c in columns]
    complete = F.lit(True)
    for x in xs:
        complete = complete & x.isNotNull()
    d, rows = len(columns), df.where(complete)
    r = rows.agg(*[e for i, x in enumerate(xs) for e in (F.avg(x).alias(f"m{i}"), F.min(x).alias(f"lo{i}"),
                                                         F.max(x).alias(f"hi{i}"))]).first()
    if r["m0"] is None:
        raise ValueError("PCA needs at least one complete row")
    scale = [scaled_spread(r[f"lo{i}"], r[f"hi{i}"]) for i in range(d)]
    cov = np.zeros((d, d))
    for s in masked_gram(rows, xs, [r[f"m{i}"] for i in range(d)], scale).collect():
        i, j = s["i"], s["j"]
        c = (s["sxy"] - s["sx"] * s["sy"] / s["n"]) / max(s["n"] - 1, 1)
        cov[i, j] = cov[j, i] = c * scale[i] * scale[j]
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:k]
    pcs = vecs[:, order].copy()
    for j in range(pcs.shape[1]):
        i = int(np.argmax(np.abs(pcs[:, j])))
        if pcs[i, j] < 0:
            pcs[:, j] = -pcs[:, j]
    total = float(np.clip(vals, 0, None).sum())
    ratio = [float(max(vals[o], 0.0) / total) if total > 0 else None for o in order]
    return pcs, ratio, [r[f"m{i}"] for i in range(d)]


def pca_loadings(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    pcs, ratio, _ = pca(df, columns, k)
    rows = [(f"PC{j + 1}", c, float(pcs[i, j]), ratio[j]) for j in range(pcs.shape[1]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "component string, feature string, loading double, "
                                                 "explained_variance_ratio double")


def pca_scores(df: DataFrame, columns: list[str], keys: list[str], k: int = 2) -> DataFrame:
    """Scores of every complete row: (x - mean) . loadings, as JVM
    expressions with literal loadings (no Python in the row path)."""
    pcs, _, mu = pca(df, columns, k)
    xs = [numeric_value(df, c) for c in columns]
    comp = []
    for j in range(pcs.shape[1]):
        e = F.lit(0.0)
        for x, m, i in zip(xs, mu, range(len(columns))):
            e = e + (x - F.lit(m)) * F.lit(float(pcs[i, j]))
        comp.append(e.alias(f"PC{j + 1}"))
    complete = F.lit(True)
    for x in xs:
        complete = complete & x.isNotNull()
    return df.where(complete).select(*[col(c) for c in keys], *comp)


# ----------------------------------------------------------- persistence
def load_model(path: str) -> FittedModel:
    """Load any model written by ``FittedModel.save``."""
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.parquet(os.path.join(path, "meta")).first()["meta"])
    kind = meta["kind"]
    if kind == "SparkModel":
        pm = PipelineModel.load(os.path.join(path, "pipeline"))
        return SparkModel(pm, meta["features"], meta["label"], meta["classes"], meta["name"], meta["classification"])
    if kind == "GaussianNB":
        return GaussianNB(meta["features"], meta["label"], meta["classes"], meta["priors"], meta["means"],
                          meta["variances"])
    if kind == "GaussianNBTable":
        return GaussianNBTable(meta["features"], meta["label"], spark.read.parquet(os.path.join(path, "classes")),
                               meta["n_classes"])
    if kind == "KNN":
        train = spark.read.parquet(os.path.join(path, "train"))
        return KNN(train, meta["features"], meta["label"], meta["key"], meta["classification"], meta["k"],
                   meta["scale"])
    if kind == "RFFModel":
        inner = None
        if meta["w_reg"] is None:
            from pyspark.ml.classification import LinearSVCModel, OneVsRestModel
            p = os.path.join(path, "inner")
            try:
                inner = LinearSVCModel.load(p)
            except Exception:  # noqa: BLE001 - multi-class models are one-vs-rest
                inner = OneVsRestModel.load(p)
        return RFFModel(meta["features"], meta["label"], meta["classes"], meta["classification"],
                        *(None if meta[x] is None else np.array(meta[x]) for x in ("W", "b")), tuple(meta["scale"]), inner, meta["name"],
                        tuple(meta["w_reg"]) if meta["w_reg"] else None)
    raise ValueError(f"cannot load model kind {kind}")
