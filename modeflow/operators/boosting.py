"""Multiclass gradient boosting on Spark: one regression tree for each class and round, on the gradients of the softmax loss."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BOOST = {"rounds": 20, "maxDepth": 4, "rate": 0.3, "minInstancesPerNode": 5, "seed": 42}
#: Rounds after which the scores are written down, so that plans stay short.
CUT_EVERY = 5


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    each = [F.exp(s - top) for s in scores]
    total = sum(each[1:], each[0])
    return [e / total for e in each]


@dataclass
class Boosted:
    """Fitted rounds: for each class a tree and the step of each of its leaves; `start` holds the classes' first scores."""

    classes: int
    start: list[float]
    rate: float
    rounds: list[list[tuple[DecisionTreeRegressionModel, dict[float, float]]]] = field(default_factory=list)
    columns: dict[str, str] = field(default_factory=lambda: {"probability": "probability", "prediction": "prediction"})

    def setProbabilityCol(self, name: str) -> Boosted:  # noqa: N802  (as Spark's models have it)
        self.columns["probability"] = name
        return self

    def setPredictionCol(self, name: str) -> Boosted:  # noqa: N802
        self.columns["prediction"] = name
        return self

    def setRawPredictionCol(self, name: str) -> Boosted:  # noqa: N802
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds the probability vector and the likeliest class (the first of equal ones)."""
        keep = rows.columns
        scores = [F.lit(s) for s in self.start]
        for r, trees in enumerate(self.rounds):
            for k, (tree, steps) in enumerate(trees):
                if steps:
                    rows = tree.copy().setLeafCol(f"__l{r}_{k}").setPredictionCol(f"__q{r}_{k}").transform(rows).drop(f"__q{r}_{k}")
                    scores[k] = scores[k] + self.rate * step_of(F.col(f"__l{r}_{k}"), steps)
        p = F.array(*softmax(scores))
        rows = rows.select(*keep, p.alias("__p"))
        best = (F.array_position("__p", F.array_max("__p")) - 1).cast("double")
        return rows.select(*keep, array_to_vector("__p").alias(self.columns["probability"]), best.alias(self.columns["prediction"]))


def step_of(leaf: Column, steps: dict[float, float]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in steps.items() for x in kv]), leaf), F.lit(0.0))


def boost(data: DataFrame, classes: int, features: str = "__features", label: str = "__y", weight: str = "__weight", **options) -> Boosted:
    """Fit on rows of a feature vector, a class number (0 to classes - 1) and a weight.

    A round fits one tree for each class, all at once, to the residuals of that class, and takes one Newton step in each leaf:
    (classes - 1) / classes times the sum of residuals by the sum of |r| (1 - |r|). What reaches the driver is a row for each
    leaf. Rows keep a score for each class, written down every few rounds.
    """
    options = BOOST | options
    names = [f"__f{k}" for k in range(classes)]
    shares = {int(r["y"]): r["w"] for r in data.groupBy(F.col(label).alias("y")).agg(F.sum(weight).alias("w")).collect()}
    total = sum(shares.values()) or 1.0
    first = [float(math.log(max(shares.get(k, 0.0), 1e-9 * total) / total)) for k in range(classes)]
    model = Boosted(classes, first, options["rate"])
    rows = cut(data.select(features, F.col(label).alias(label), F.col(weight).alias(weight), *[F.lit(s).alias(n) for s, n in zip(first, names, strict=True)]))
    tree = DecisionTreeRegressor(featuresCol=features, labelCol="__r", weightCol=weight, maxDepth=options["maxDepth"], minInstancesPerNode=options["minInstancesPerNode"], seed=options["seed"])
    for r in range(options["rounds"]):
        p = softmax([F.col(n) for n in names])
        residuals = rows.withColumns({f"__r{k}": (F.col(label) == k).cast("double") - p[k] for k in range(classes)}).persist(StorageLevel.MEMORY_AND_DISK)

        def one(k: int, residuals: DataFrame = residuals) -> tuple[DecisionTreeRegressionModel, dict[float, float]]:
            own = residuals.withColumn("__r", F.col(f"__r{k}"))
            fitted = tree.fit(own)
            size = F.abs("__r")
            leaves = fitted.setLeafCol("__leaf").setPredictionCol("__q").transform(own).groupBy("__leaf").agg(F.sum(F.col(weight) * F.col("__r")).alias("a"), F.sum(F.col(weight) * size * (1 - size)).alias("b"))
            return fitted, {x["__leaf"]: (classes - 1) / classes * x["a"] / max(x["b"], 1e-9 * total) for x in leaves.collect()}

        with ThreadPoolExecutor(classes) as pool:
            trees = list(pool.map(one, range(classes)))
        model.rounds.append(trees)
        moved = residuals
        for k, (fitted, steps) in enumerate(trees):
            moved = fitted.copy().setLeafCol(f"__l{k}").setPredictionCol(f"__q{k}").transform(moved)
            moved = moved.withColumn(names[k], F.col(names[k]) + options["rate"] * step_of(F.col(f"__l{k}"), steps))
        moved = moved.select(rows.columns)
        if (r + 1) % CUT_EVERY == 0:
            moved = cut(moved)
        residuals.unpersist()
        rows = moved
    return model

