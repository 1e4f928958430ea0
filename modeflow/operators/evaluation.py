"""Training and evaluation loops: over folds, models and columns only, never over rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import labeling, metrics, models, quality, selection, smoothing, splits


def evaluate(rows: DataFrame, true: str, pred: str, classes: list[str]) -> dict[str, float]:
    """accuracy, macro F1 over seen and over all classes, F1 of each class."""
    each = {r["class"]: r for r in metrics.by_class(rows, true, pred).collect()}
    one = metrics.macro_f1(rows, true, pred, classes).first()
    return {"accuracy": one["accuracy"], "macro_seen": one["macro_seen"], "macro_all": one["macro_all"]} | {f"f1_{c}": each[c]["f1"] if c in each else 0.0 for c in classes}


def rolling_training(windows: DataFrame, columns: list[str], classes: list[str], label: str, folds: int = 5, keys: tuple[str, ...] = ("userId", "session_id"), prune: float | None = None, **options) -> tuple[dict[str, float], DataFrame]:
    """Mean and population spread of the measures over rolling-origin folds, and the out-of-fold predictions (smoothed).

    With prune, each fold leaves out the columns that are that close to an earlier one in its own training rows.
    """
    done, scores = None, []
    for r in splits.rolling(windows, folds).orderBy("fold").collect():
        train, test = splits.fold_rows(windows, r["fold"], folds)
        used = columns if prune is None else selection.apart(train, columns, prune)
        model = models.Hierarchical(used, classes).fit(train, label, **options)
        got = smoothing.majority(model.predict(test), list(keys)).withColumn("fold", F.lit(r["fold"]))
        scores.append(evaluate(got, label, "predicted", classes) | {"columns": float(len(used))})
        done = got if done is None else done.unionByName(got)
    out = {}
    for k in scores[0] if scores else ():
        values = [s[k] for s in scores]
        mean = sum(values) / len(values)
        out |= {f"{k}_mean": mean, f"{k}_std": (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5}
    return out, done


def tagged(rows: DataFrame, tested: DataFrame, label: str = "label", pred: str = "predicted") -> DataFrame:
    """Adds split (test, train or unlabeled) and correct, which is null without a label. tested: session_id of test sessions."""
    t = tested.select("session_id").distinct().withColumn("__test", F.lit(True))
    out = rows.join(t, "session_id", "left")
    split = F.when(F.col(label).isNull(), "unlabeled").when(F.col("__test"), "test").otherwise("train")
    return out.withColumn("split", split).withColumn("correct", F.col(label) == F.col(pred)).drop("__test")


def transfer(model: models.Hierarchical, target: DataFrame, label: str, smooth: bool = False, keys: tuple[str, ...] = ("userId", "session_id")) -> dict[str, float]:
    """Measures of a model on another city's windows: its columns aligned (absent ones null), classes of both only."""
    seen = {r[0] for r in target.select(label).distinct().collect()}
    classes = [c for c in model.classes if c in seen]
    rows = selection.align(target.where(F.col(label).isin(classes)), model.columns)
    got = model.predict(rows)
    if smooth:
        got = smoothing.majority(got, list(keys))
    return evaluate(got, label, "smooth" if smooth else "predicted", classes)


def rule_based(windows: DataFrame, label: str, classes: list[str], **options) -> dict[str, float]:
    """Measures of the rule cascade against labels; abstaining counts as wrong."""
    rows = labeling.cascade(windows.where(F.col(label).isin(classes)), **options)
    rows = rows.withColumn("__pred", F.coalesce("silver_label", F.lit("abstain")))
    rate = rows.agg(F.avg(F.col("silver_label").isNull().cast("double"))).first()[0]
    return evaluate(rows, label, "__pred", classes) | {"abstain_rate": rate}


def dealt_each(df: DataFrame, columns: list[str], seed: int = 42, block: int = 1024) -> DataFrame:
    """df once for each of the columns, whose name is in __column, with that column's values dealt to other rows; and once as it
    is, with __column null.

    Rows come to tasks by a seeded hash and are sorted by it, so a block of them is a random part of the table in random order;
    inside it a column is turned by a seeded number of places, which moves each value to another row (of a block of one row, to
    itself). All columns come from one read and one exchange of the rows; a task holds one block.
    """
    rows = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__h", F.xxhash64("__id", F.lit(seed)))
    placed = rows.repartition("__h").sortWithinPartitions("__h", "__id").drop("__h", "__id")
    names, at = df.columns, {c: df.columns.index(c) for c in columns}
    turns = {c: zlib.crc32(f"{c}/{seed}".encode()) for c in columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks() if held else None
            held.clear()
            while t is not None and t.num_rows and (last or t.num_rows >= block):
                part, t = t.slice(0, block).combine_chunks(), t.slice(block)
                arrays, n = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns], part.num_rows
                yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.string())], [*names, "__column"])
                for c in columns:
                    turned = (np.arange(n) + 1 + turns[c] % max(1, n - 1)) % n
                    out = list(arrays)
                    out[at[c]] = arrays[at[c]].take(pa.array(turned))
                    yield pa.RecordBatch.from_arrays([*out, pa.array([c] * n, pa.string())], [*names, "__column"])
            if t is not None and t.num_rows:
                held.extend(t.to_batches())

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= block:
                yield from full(False)
        yield from full(True)

    return placed.mapInArrow(run, StructType([*df.schema.fields, StructField("__column", StringType())]))


def permutation_importance(model: models.Hierarchical, rows: DataFrame, label: str, columns: list[str], seed: int = 42) -> dict[str, float]:
    """Loss of accuracy as each column's values are dealt to other rows; all columns in one job over one read."""
    scored = model.predict(dealt_each(rows.select(*dict.fromkeys([*model.columns, label, *columns])), columns, seed))
    hits = scored.groupBy("__column").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy")).collect()
    accuracy = {r["__column"]: r["accuracy"] for r in hits}
    return {c: accuracy[None] - accuracy[c] for c in columns} if accuracy else dict.fromkeys(columns, 0.0)


def learning_curve(train: DataFrame, test: DataFrame, make, label: str, shares: list[float], group: str = "session_id", seed: int = 42) -> dict[float, float]:
    """Accuracy on test after training on hashed shares of the groups."""
    out = {}
    for s in shares:
        part = train.where(F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(10_000)) < int(s * 10_000))
        got = make().fit(part, label).predict(test)
        out[s] = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    return out


def degradation_curve(fitted: dict[str, models.Hierarchical], rows: DataFrame, label: str, shares: list[float], keys: tuple[str, ...] = ("userId", "session_id", "ts_start"), seed: int = 42) -> dict[float, dict[str, float]]:
    """Macro F1 of each model over the same rows, a share of which lost their positions; larger shares hold the smaller ones."""
    out = {}
    for s in shares:
        part = quality.mask_positions(rows, s, seed, list(keys))
        out[s] = {name: evaluate(m.predict(part), label, "predicted", m.classes)["macro_all"] for name, m in fitted.items()}
    return out


def label_permutation(train: DataFrame, test: DataFrame, make, label: str, true: str, seeds: tuple[int, ...] = (0, 1, 2)) -> dict[str, float]:
    """Macro F1 on test of training on the labels, of training on the same labels dealt to other rows (mean and population
    spread over the seeds), and of always naming the most frequent label: what the labels are worth beyond their number."""
    classes = make().classes
    score = lambda got: evaluate(got, true, "predicted", classes)["macro_all"]
    dealt = [score(make().fit(models.permuted(train, label, s), label).predict(test)) for s in seeds]
    mean = sum(dealt) / len(dealt)
    top = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).first()[0]
    return {
        "labels": score(make().fit(train, label).predict(test)), "permuted_mean": mean, "permuted_std": (sum((d - mean) ** 2 for d in dealt) / len(dealt)) ** 0.5,
        "majority": score(test.withColumn("predicted", F.lit(top))),
    }


def physics_flags(windows: DataFrame, label: str, speed: Column, most: dict[str, float]) -> DataFrame:
    """Adds impossible: the speed is above what the labelled mode can reach."""
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col(label))
    return windows.withColumn("impossible", F.coalesce(speed > bound, F.lit(False)))
