"""The hierarchical classifier on Spark ML: still or moving, then the moving mode, then optional specialists."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import cumulated
from ..functions.quantiles import quantiles
from ..session import cut
from .boosting import BOOST, Boosted, boost

STILL = "Still"
SPECIALISTS = {"S1": ("Car", "Bus"), "S2": ("Train", "Subway")}
FOREST = {"numTrees": 400, "maxDepth": 30, "minInstancesPerNode": 5, "seed": 42}
#: Training rows of a task: each task sends the counts of all open nodes of all trees at every level, whatever its rows.
TASK_ROWS = 4096


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of the known values, 0 where there are none; all columns in the same passes, none in one task."""
    row = quantiles(df, [], {c: F.col(f"`{c}`") for c in columns}, [0.5]).first() if columns else {}
    return {c: 0.0 if row[c] is None or row[c][0] is None else float(row[c][0]) for c in columns}


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(v)) for c, v in values.items()})


def balanced(df: DataFrame, label: str, name: str = "__weight") -> DataFrame:
    """Adds weights that give all classes the same total."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    return df.join(F.broadcast(n.join(total)), label).withColumn(name, F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def stage(df: DataFrame, label: Column, classes: int, learner: str, options: dict, weight: Column | None = None) -> RandomForestClassificationModel | Boosted:
    """A fitted stage over numbered labels: a forest, or boosted trees ("boosted")."""
    data = balanced(df.withColumn("__y", label.cast("double")), "__y")
    if weight is not None:
        data = data.withColumn("__weight", F.col("__weight") * weight)
    if learner == "boosted":
        return boost(data, classes, **options)
    return RandomForestClassifier(featuresCol="__features", labelCol="__y", weightCol="__weight", **options).fit(data)


@dataclass
class Hierarchical:
    """Fitted stages and what is needed to apply them."""

    columns: list[str]
    classes: list[str]
    values: dict[str, float] = field(default_factory=dict)
    first: RandomForestClassificationModel | Boosted | None = None
    second: RandomForestClassificationModel | Boosted | None = None
    special: dict[str, RandomForestClassificationModel | Boosted] = field(default_factory=dict)
    learner: str = "forest"

    @property
    def moving(self) -> list[str]:
        return sorted(c for c in self.classes if c != STILL)

    def prepared(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.columns, outputCol="__features").transform(impute(df, self.values))

    def fit(self, df: DataFrame, label: str, specialists: tuple[str, ...] = (), weight: str | None = None, **options) -> Hierarchical:
        options = (BOOST if self.learner == "boosted" else FOREST) | options
        held = df.select(*self.columns, label, *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
        self.values = medians(held, self.columns)
        data = self.prepared(held.coalesce(max(1, -(-held.count() // TASK_ROWS))))
        w = F.col(weight) if weight else None
        self.first = stage(data, F.col(label) != STILL, 2, self.learner, options, w)
        number = F.array_position(F.array(*[F.lit(c) for c in self.moving]), F.col(label)) - 1
        self.second = stage(data.where(F.col(label) != STILL), number, len(self.moving), self.learner, options, w)
        for s in specialists:
            pair = data.where(F.col(label).isin(*SPECIALISTS[s]))
            if pair.count() > 20:
                self.special[s] = stage(pair, F.col(label) == SPECIALISTS[s][1], 2, self.learner, options, w)
        held.unpersist()
        return self

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Adds p_<class> for all classes: 1 - p for Still, p * p2 for the others; they sum to 1."""
        rows = self.prepared(df)
        keep = [c for c in rows.columns if c != "__features"]
        rows = self.first.setProbabilityCol("__p1").setPredictionCol("__h1").setRawPredictionCol("__r1").transform(rows)
        rows = self.second.setProbabilityCol("__p2").setPredictionCol("__h2").setRawPredictionCol("__r2").transform(rows)
        p = F.element_at(vector_to_array("__p1"), 2)
        second = vector_to_array("__p2")
        each = {f"p_{STILL}": 1 - p} | {f"p_{c}": F.coalesce(F.get(second, F.lit(i)), F.lit(0.0)) * p for i, c in enumerate(self.moving)}
        for s, model in self.special.items():
            rows = model.setProbabilityCol(f"__p{s}").setPredictionCol(f"__h{s}").setRawPredictionCol(f"__r{s}").transform(rows)
        extra = [vector_to_array(f"__p{s}")[1].alias(f"__{s}") for s in self.special]
        return rows.select(*keep, *[v.alias(n) for n, v in each.items()], F.col("__h1").alias("__moves"), F.col("__h2").alias("__which"), *extra)

    def predict(self, df: DataFrame, mode: str = "soft", forced_moving: bool = False) -> DataFrame:
        """Adds predicted and max_prob.

        mode "soft" takes the largest of all classes' probabilities, "hard" lets the first stage decide whether the second
        is asked. With forced_moving, Still is not an answer. Specialists decide between their two modes at last.
        """
        rows = self.probabilities(df)
        names = self.moving if forced_moving else [STILL, *self.moving]
        best = F.array_max(F.array(*[F.struct(F.col(f"p_{c}").alias("p"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(names)]))
        rows = rows.withColumn("__best", best)
        if mode == "hard" and not forced_moving:
            which = F.element_at(F.array(*[F.lit(c) for c in self.moving]), (F.col("__which") + 1).cast("int"))
            rows = rows.withColumn("predicted", F.when(F.col("__moves") == 1, which).otherwise(STILL))
        else:
            rows = rows.withColumn("predicted", F.col("__best.c"))
        rows = rows.withColumn("max_prob", F.col("__best.p"))
        for s in self.special:
            a, b = SPECIALISTS[s]
            inside, p = F.col("predicted").isin(a, b), F.col(f"__{s}")
            rows = rows.withColumn("max_prob", F.when(inside, F.greatest(p, 1 - p)).otherwise(F.col("max_prob"))).withColumn("predicted", F.when(inside, F.when(p > 0.5, b).otherwise(a)).otherwise(F.col("predicted")))
        return rows.drop("__best", "__moves", "__which", *[f"__{s}" for s in self.special])


def boosted(df: DataFrame, columns: list[str], label: str, **options):
    """An alternative learner: gradient boosted trees, one against the rest, over numbered labels."""
    data = VectorAssembler(inputCols=columns, outputCol="__features").transform(impute(df, medians(df, columns)))
    return OneVsRest(classifier=GBTClassifier(**({"maxIter": 20, "seed": 42} | options)), featuresCol="__features", labelCol=label).fit(data)


def routed(with_gps: Column, without: Column, gps_frac: Column) -> Column:
    """The inertial model's answer where a window has no positioning, else the other one's."""
    return F.when(gps_frac == 0, without).otherwise(with_gps)


def remapped(mode: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), mode), mode) if names else mode


def uncertainty(probabilities: list[Column]) -> dict[str, Column]:
    """Scores for choosing what to label next: least confidence, entropy and margin."""
    p = F.array(*probabilities)
    ordered = F.array_sort(p, lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    entropy = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return {"least_confidence": 1 - F.array_max(p), "entropy": entropy, "margin": 1 - (ordered[0] - ordered[1])}


def confident_weights(oof: DataFrame, label: str, classes: list[str], low: float = 0.1) -> DataFrame:
    """Adds weight: `low` where the out-of-fold probabilities (p_<class>) point confidently at another class.

    A class's bar is the mean of its own probability over its rows; a row is suspect if some other class passes its bar, and
    by more than the given class is the likeliest of those that do.
    """
    bars = oof.groupBy(label).agg(*[F.avg(F.when(F.col(label) == c, F.col(f"p_{c}"))).alias(f"__bar_{c}") for c in classes])
    one = bars.agg(*[F.max(f"__bar_{c}").alias(f"__bar_{c}") for c in classes])
    rows = oof.join(F.broadcast(one))
    over = F.filter(F.array(*[F.struct(F.when(F.col(f"p_{c}") >= F.coalesce(F.col(f"__bar_{c}"), F.lit(2.0)), F.col(f"p_{c}")).otherwise(-1.0).alias("p"), F.lit(c).alias("c")) for c in classes]), lambda x: x["p"] >= 0)
    best = F.array_max(over)["c"]
    return rows.withColumn("weight", F.when(best.isNotNull() & (best != F.col(label)), low).otherwise(1.0)).drop(*[f"__bar_{c}" for c in classes])


def cross_validate(windows: DataFrame, model, label: str, folds: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Predictions for all test rows with their fold; `model` makes an unfitted Hierarchical. The loop is over folds only."""
    out = None
    for name, train, test in folds:
        got = model().fit(train, label).predict(test).withColumn("fold", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def permuted(df: DataFrame, column: str, seed: int = 42) -> DataFrame:
    """df with one column's values dealt to other rows at random: each row takes that of the row at its place in a hashed
    order. Places are found in ranges of both orders, without a single-task window."""
    rows = cut(df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__one", F.lit(1).cast("bigint")))
    a = cumulated(rows.select("__id", "__one"), ["__id"], ["__one"]).select("__id", F.col("before___one").alias("__at"))
    dealt = rows.select("__id", "__one", F.col(column).alias("__v"), F.xxhash64("__id", F.lit(seed)).alias("__h"))
    b = cumulated(dealt, ["__h", "__id"], ["__one"]).select("__v", F.col("before___one").alias("__at"))
    return rows.drop("__one").join(a, "__id").join(b, "__at").withColumn(column, F.col("__v")).select(*df.columns)


def save(model: Hierarchical, spark: SparkSession, root: str, name: str, **meta) -> str:
    """Write the stages (forests only) and a JSON description under root/name/<time>, through Spark's own file systems."""
    if model.learner != "forest":
        raise ValueError("only models of forests can be saved")
    path = f"{root.rstrip('/')}/{name}/{int(time.time() * 1000)}"
    stages = {"first": model.first, "second": model.second, **model.special}
    for stage, fitted in stages.items():
        fitted.write().overwrite().save(f"{path}/{stage}")
    about = {"columns": model.columns, "classes": model.classes, "values": model.values, "stages": list(stages)} | meta
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return path


def load(spark: SparkSession, path: str) -> Hierarchical:
    about = json.loads(spark.read.text(f"{path}/meta").first()[0])
    stages = {s: RandomForestClassificationModel.load(f"{path}/{s}") for s in about["stages"]}
    return Hierarchical(about["columns"], about["classes"], about["values"], stages.pop("first"), stages.pop("second"), stages)


def versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """Paths of the saved models of a name, oldest first; the last is the latest."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(folder)) if fs.exists(folder) else []
