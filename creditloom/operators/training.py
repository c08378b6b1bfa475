"""Credit models on Spark ML: fit on a DataFrame, score a DataFrame.

Every model is fitted from named feature columns and adds a ``pd`` column.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import schema as S
from creditloom.functions import columns as C
from creditloom.operators.cleaning import fit_scale, scaled
from creditloom.operators.forest_scores import forest_probabilities
from creditloom.operators.isotonic import fit_isotonic
from creditloom.operators.metrics import evaluate
from creditloom.operators.splits import class_counts, class_weight, stratified_folds
from creditloom.operators.state import Savable, get_options, get_parameters, put_options, put_parameters

# Search ranges of the boosted model.
SEARCH_SPACE = {
    "n_estimators": (100, 1000),
    "max_depth": (3, 9),
    "learning_rate": (0.005, 0.3),
    "subsample": (0.6, 1.0),
    "colsample_bytree": (0.5, 1.0),
    "min_child_weight": (1, 20),
}

#: Bytes of rows that a cached partition of training rows should hold.
PARTITION_BYTES = 64 << 20
#: Bytes of training rows up to which the calibration folds being fitted share the memory: each holds rows of its own.
FOLD_BYTES = 4 << 30


class NotFitted(RuntimeError):
    """Raised when a model is used before ``fit``."""


def _positive(prob: str = "probability") -> Column:
    return vector_to_array(F.col(prob))[1]


class Sigmoid:
    """Calibration 1 / (1 + exp(-(a s + b)))."""

    def __init__(self, a: float, b: float):
        self.a, self.b = a, b

    def __call__(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_s") * self.a + self.b))))


class Steps:
    """Calibration by a fitted monotone function."""

    def __init__(self, model: IsotonicRegressionModel):
        self.model = model

    def __call__(self, df: DataFrame, out: str) -> DataFrame:
        return self.model.setFeaturesCol("_s").setPredictionCol(out).transform(df)


class CreditModel(Savable):
    """Common contract: fit, transform, predict, score, feature names, save, load."""

    name = "model"
    weight_scheme = "balanced"
    calibration: str | None = None

    def __init__(self, features: Sequence[str], label: str = S.TARGET, key: str = S.ID, seed: int = S.SEED, folds: int = 5, parallelism: int = 5):
        self.features, self.label, self.key, self.seed, self.folds = list(features), label, key, seed, folds
        self.parallelism = parallelism  # calibration folds fitted at the same time, at most
        self.members: list | None = None  # fitted (model, calibrator) pairs

    # What a concrete model supplies.
    def estimator(self):
        raise NotImplementedError

    def prepare(self, train: DataFrame) -> None:
        """Fit what precedes the vector (scaling)."""

    def before_vector(self) -> dict[str, Column]:
        """What goes into the vector in place of a feature."""
        return {}

    #: Column of a member's output that its calibrator is fitted on.
    raw_column = "probability"

    def _vectors(self, df: DataFrame) -> DataFrame:
        """Add ``_x``; the features stay as they are."""
        instead = {f"_in_{f}": c for f, c in self.before_vector().items()}
        names = [f"_in_{f}" if f"_in_{f}" in instead else f for f in self.features]
        return VectorAssembler(inputCols=names, outputCol="_x").transform(df.withColumns(instead)).drop(*instead)

    @staticmethod
    def _only(model, column: str):
        """A member that adds no more than the asked column: each further one is a vector written and read again a row."""
        return model.copy({model.getParam(f"{name}Col"): "" for name in ("rawPrediction", "probability", "prediction") if name != column})

    def _positives(self, df: DataFrame, models: Sequence, column: str) -> DataFrame:
        """Add ``_s0``, ``_s1``, ...: what each model gives the positive class in ``column``."""
        for i, model in enumerate(models):
            df = model.transform(df).withColumn(f"_s{i}", _positive(column)).drop(column)
        return df

    def _weighted(self, df: DataFrame) -> DataFrame:
        weight = class_weight(class_counts(df, self.label), self.label, self.weight_scheme)
        return df.withColumn("_w", weight)

    #: Bytes that a fold being fitted holds a row beside its vector.
    draw_bytes = 0

    def _row_bytes(self) -> int:
        return 8 * len(self.features) + 64

    def _size(self, data: DataFrame) -> int:
        """Bytes of the rows once they are vectors, at most."""
        return data.count() * self._row_bytes()

    def _dealt(self, data: DataFrame) -> DataFrame:
        """Rows dealt by key to parts of ``PARTITION_BYTES``: a few small files may hold many rows. What fits one part stays as it is.

        Every iteration runs a task a part, so that there are no more parts than the rows and the cores need.
        """
        parts = math.ceil(self._size(data) / PARTITION_BYTES)
        return data.repartition(max(parts, data.sparkSession.sparkContext.defaultParallelism), self.key) if parts > 1 else data

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> CreditModel:
        self.prepare(train)
        data = self._vectors(train.select(self.key, self.label, *self.features)).select(self.key, self.label, "_x")
        data = self._weighted(data)
        if self.calibration is not None:
            self.members = self._cross_fit(data)
            return self
        data = self._dealt(data).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.members = [(self._fit_one(data, val), None)]
        finally:
            data.unpersist()
        return self

    def _fit_one(self, data: DataFrame, val: DataFrame | None):
        return self.estimator().fit(data)

    def _cross_fit(self, data: DataFrame) -> list:
        """One model per fold, its calibrator fitted on the fold left out.

        Every iteration runs a task a part, and each task answers to the driver: the parts are the cores times what
        the rows need, not as many as the shuffle made.
        """
        size, cores = self._size(data), data.sparkSession.sparkContext.defaultParallelism
        folded = stratified_folds(data, self.folds, self.label, self.seed, self.key)
        folded = folded.coalesce(cores * max(1, math.ceil(size / PARTITION_BYTES / cores))).persist(StorageLevel.MEMORY_AND_DISK)
        held = size + size // self._row_bytes() * self.draw_bytes
        at_once = max(1, min(self.folds, self.parallelism, FOLD_BYTES // max(held, 1)))
        calibrator = fit_platt if self.calibration == "sigmoid" else fit_steps

        def one(k: int):
            model = self.estimator().fit(folded.where(F.col("fold") != k))
            held = self._positives(folded.where(F.col("fold") == k), [model], self.raw_column)
            return model, calibrator(held.select(F.col(self.label).cast("double").alias("y"), F.col("_s0").alias("s")))

        try:
            with ThreadPool(at_once) as pool:
                return pool.map(inheritable_thread_target(data.sparkSession)(one), range(self.folds))
        finally:
            folded.unpersist()

    def _check(self) -> None:
        if self.members is None:
            raise NotFitted(f"{self.name} is not fitted")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``pd``: the mean probability over the fitted members."""
        self._check()
        column = "probability" if self.calibration is None else self.raw_column
        out = self._positives(self._vectors(df), [self._only(model, column) for model, _ in self.members], column)
        parts = []
        for i, (_, calibrate) in enumerate(self.members):
            out = out.withColumnRenamed(f"_s{i}", "_s")
            out = (out.withColumn(f"_p{i}", F.col("_s")) if calibrate is None else calibrate(out, f"_p{i}")).drop("_s")
            parts.append(F.col(f"_p{i}"))
        pd = reduce(lambda a, b: a + b, parts) / float(len(parts))
        return out.select(*df.columns, pd.alias("pd"))

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        scored = self.transform(df)
        return scored.withColumn("predicted", (F.col("pd") >= F.lit(threshold)).cast("int"))

    def score(self, df: DataFrame) -> float:
        """AUC over the rows of ``df``."""
        rows = self.transform(df).select(F.col(self.label).alias("label"), F.col("pd").alias("score"))
        return evaluate(rows, by=()).first()["auc"]

    @property
    def feature_names(self) -> list[str]:
        self._check()
        return list(self.features)

    def settings(self) -> dict:
        """Constructor arguments that are not common to all models."""
        return {}

    def save_state(self, spark: SparkSession, path: str) -> None:
        """Settings and calibration as tables, the members as Spark ML models."""
        self._check()
        common = {k: getattr(self, k) for k in ("features", "label", "key", "seed", "folds", "parallelism")}
        sections: dict[str, dict] = {"scale": getattr(self, "scaling", None) or {}, "sigmoid": {}}
        steps = []
        for i, (model, calibrate) in enumerate(self.members):
            model.write().save(f"{path}/members/{i}")
            if isinstance(calibrate, Sigmoid):
                sections["sigmoid"][str(i)] = (calibrate.a, calibrate.b)
            elif isinstance(calibrate, Steps):
                calibrate.model.write().save(f"{path}/steps/{i}")
                steps.append(i)
        state = {"common": common, "settings": self.settings(), "calibration": self.calibration, "members": len(self.members), "steps": steps}
        put_options(spark, path, type(self).__name__, state)
        put_parameters(spark, path, sections)

    @classmethod
    def load_state(cls, spark: SparkSession, path: str) -> CreditModel:
        kinds = {c.__name__: c for c in (LogisticCredit, ForestCredit, BoostedCredit, BoostedAltCredit) if issubclass(c, cls)}
        kind, state = get_options(spark, path, *kinds)
        found = get_parameters(spark, path)
        common = dict(state["common"])
        out = kinds[kind](common.pop("features"), **state["settings"], **common)
        out.calibration = state["calibration"]
        if found.get("scale"):
            out.scaling = {c: tuple(v) for c, v in found["scale"].items()}
        out.members = []
        for i in range(state["members"]):
            calibrate = None
            if str(i) in found.get("sigmoid", {}):
                calibrate = Sigmoid(*found["sigmoid"][str(i)])
            elif i in state["steps"]:
                calibrate = Steps(IsotonicRegressionModel.load(f"{path}/steps/{i}"))
            out.members.append((kinds[kind].fitted_kind.load(f"{path}/members/{i}"), calibrate))
        return out

    def importance(self, spark) -> DataFrame:
        """Mean tree importance per feature, descending."""
        self._check()
        sums = [0.0] * len(self.features)
        for model, _ in self.members:
            for i, v in enumerate(model.featureImportances.toArray()):
                sums[i] += float(v) / len(self.members)
        rows = sorted(zip(self.features, sums), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame(rows, "feature string, importance double")


class LogisticCredit(CreditModel):
    """Scaled inputs, ridge penalty, balanced weights, sigmoid calibration."""

    name = "LogisticRegression"
    fitted_kind = LogisticRegressionModel
    raw_column = "rawPrediction"

    def __init__(self, features, C: float = 1.0, max_iter: int = 1000, calibrate: bool = True, **kw):
        super().__init__(features, **kw)
        self.C, self.max_iter = C, max_iter
        self.calibration = "sigmoid" if calibrate else None

    def settings(self) -> dict:
        return {"C": self.C, "max_iter": self.max_iter}

    def prepare(self, train: DataFrame) -> None:
        self.scaling = fit_scale(train, self.features)
        self.n = train.count()

    def before_vector(self) -> dict[str, Column]:
        return scaled(self.scaling)

    def estimator(self):
        rows = self.n * (self.folds - 1) / self.folds if self.calibration else self.n
        return LogisticRegression(
            featuresCol="_x", labelCol=self.label, weightCol="_w", maxIter=self.max_iter,
            regParam=1.0 / (self.C * max(rows, 1)), elasticNetParam=0.0, standardization=False,
        )

    def coefficients(self, spark) -> DataFrame:
        """Mean coefficient over the members with its odds ratio, largest first."""
        self._check()
        rows = []
        for j, f in enumerate(self.features):
            c = sum(float(m.coefficients[j]) for m, _ in self.members) / len(self.members)
            rows.append((f, c, math.exp(c)))
        rows.sort(key=lambda r: (-abs(r[1]), r[0]))
        return spark.createDataFrame(rows, "feature string, coefficient double, odds_ratio double")

    def credit_scores(self, df: DataFrame) -> DataFrame:
        return self.transform(df).withColumn("credit_score", C.credit_score("pd"))


class ForestCredit(CreditModel):
    name = "RandomForest"
    fitted_kind = RandomForestClassificationModel

    def __init__(self, features, trees: int = 300, depth: int = 8, min_leaf: int = 20, calibrate: bool = True, **kw):
        super().__init__(features, **kw)
        self.trees, self.depth, self.min_leaf = trees, depth, min_leaf
        self.calibration = "isotonic" if calibrate else None
        self.draw_bytes = 4 * trees  # how often each tree draws the row

    def settings(self) -> dict:
        return {"trees": self.trees, "depth": self.depth, "min_leaf": self.min_leaf}

    def estimator(self):
        return RandomForestClassifier(
            featuresCol="_x", labelCol=self.label, weightCol="_w", numTrees=self.trees, maxDepth=self.depth,
            minInstancesPerNode=self.min_leaf, featureSubsetStrategy="sqrt", seed=self.seed,
        )

    @staticmethod
    def _only(model, column: str):
        return model

    def _positives(self, df: DataFrame, models: Sequence, column: str) -> DataFrame:
        out = forest_probabilities(df, models, "_x", column)
        return out.withColumns({f"_s{i}": F.col(column)[i] for i in range(len(models))}).drop(column)


class BoostedCredit(CreditModel):
    """Boosted trees; positives weigh n0/n1; stops early on a validation frame."""

    name = "GradientBoosting"
    weight_scheme = "ratio"
    fitted_kind = GBTClassificationModel

    def __init__(
        self, features, trees: int = 500, depth: int = 6, rate: float = 0.05, rows: float = 0.8, columns: float = 0.8,
        min_leaf: int = 5, early_tol: float = 0.0001, **kw,
    ):
        super().__init__(features, **kw)
        self.params = dict(trees=trees, depth=depth, rate=rate, rows=rows, columns=columns, min_leaf=min_leaf)
        self.early_tol = early_tol

    def settings(self) -> dict:
        return {**self.params, "early_tol": self.early_tol}

    def estimator(self):
        p = self.params
        return GBTClassifier(
            featuresCol="_x", labelCol=self.label, weightCol="_w", maxIter=p["trees"], maxDepth=p["depth"],
            stepSize=p["rate"], subsamplingRate=p["rows"], featureSubsetStrategy=str(p["columns"]),
            minInstancesPerNode=p["min_leaf"], seed=self.seed,
        )

    def _fit_one(self, data: DataFrame, val: DataFrame | None):
        est = self.estimator()
        if val is None:
            return est.fit(data)
        held = self._vectors(val.select(self.key, self.label, *self.features)).select(self.key, self.label, "_x")
        both = data.withColumn("_val", F.lit(False)).unionByName(
            self._dealt(held).withColumns({"_w": F.lit(1.0), "_val": F.lit(True)})
        )
        return est.fit(both, {est.validationIndicatorCol: "_val", est.validationTol: self.early_tol})

    def tune(self, train: DataFrame, trials: int = 100, folds: int = 5, space: dict | None = None, parallelism: int = 2) -> dict:
        """Best of seeded random settings by mean cross-validated AUC."""
        space = {**SEARCH_SPACE, **(space or {})}
        rng = random.Random(self.seed)
        est = self.estimator()
        maps = []
        for _ in range(trials):
            log_rate = rng.uniform(math.log(space["learning_rate"][0]), math.log(space["learning_rate"][1]))
            maps.append({
                est.maxIter: rng.randint(*space["n_estimators"]),
                est.maxDepth: rng.randint(*space["max_depth"]),
                est.stepSize: math.exp(log_rate),
                est.subsamplingRate: rng.uniform(*space["subsample"]),
                est.featureSubsetStrategy: str(round(rng.uniform(*space["colsample_bytree"]), 4)),
                est.minInstancesPerNode: rng.randint(*space["min_child_weight"]),
            })
        data = self._weighted(self._vectors(train.select(self.key, self.label, *self.features)).select(self.key, self.label, "_x"))
        data = stratified_folds(data, folds, self.label, self.seed, self.key).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            auc = BinaryClassificationEvaluator(labelCol=self.label, metricName="areaUnderROC", numBins=0)
            cv = CrossValidator(
                estimator=est, estimatorParamMaps=maps, evaluator=auc, numFolds=folds, foldCol="fold", parallelism=parallelism
            )
            self.trials = cv.fit(data)
        finally:
            data.unpersist()
        best = max(range(trials), key=lambda i: self.trials.avgMetrics[i])
        chosen = {p.name: v for p, v in maps[best].items()}
        self.params.update(
            trees=chosen["maxIter"], depth=chosen["maxDepth"], rate=chosen["stepSize"], rows=chosen["subsamplingRate"],
            columns=chosen["featureSubsetStrategy"], min_leaf=chosen["minInstancesPerNode"],
        )
        self.best_auc = self.trials.avgMetrics[best]
        return chosen


class BoostedAltCredit(BoostedCredit):
    """Second boosted benchmark: larger leaves, positives weigh 5."""

    name = "GradientBoostingAlt"
    weight_scheme = "fixed"

    def __init__(self, features, min_leaf: int = 20, **kw):
        super().__init__(features, min_leaf=min_leaf, **kw)


def fit_platt(held: DataFrame) -> Sigmoid:
    """Sigmoid on a raw score with smoothed targets.

    A target t in (0, 1) is a pair of rows, label 1 with weight t and label 0
    with weight 1 - t, so the standard estimator fits it.
    """
    counts = class_counts(held, "y")
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    t = F.when(F.col("y") == 1, F.lit((n1 + 1.0) / (n1 + 2.0))).otherwise(F.lit(1.0 / (n0 + 2.0)))
    pair = F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), t.alias("w")), F.struct(F.lit(0.0).alias("y"), (1.0 - t).alias("w"))
    ))
    rows = held.select("s", pair.alias("r")).select("s", "r.y", "r.w")
    data = VectorAssembler(inputCols=["s"], outputCol="_v").transform(rows)
    model = LogisticRegression(featuresCol="_v", labelCol="y", weightCol="w", regParam=0.0, maxIter=50).fit(data)
    a, b = float(model.coefficients[0]), float(model.intercept)
    return Sigmoid(a, b)


def fit_steps(held: DataFrame) -> Steps:
    """Monotone function of a raw score."""
    return Steps(fit_isotonic(held))
