"""Evaluation measures from counts: everything is one aggregation over the rows, then arithmetic on a few of them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.order import cumulated
from ..session import cut


def cells(rows: DataFrame, true: str, pred: str, weight: str | None = None) -> DataFrame:
    """t, p and n, the number of rows or the sum of their weights."""
    return rows.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def by_class(rows: DataFrame, true: str, pred: str, weight: str | None = None) -> DataFrame:
    """class, support, precision, recall, f1 of every class met on either side; a division by zero gives 0."""
    c = cells(rows, true, pred, weight)
    ends = c.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.when(F.col("t").eqNullSafe(F.col("p")), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("pp"), F.col("n").alias("tt")), F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("pp"), F.lit(0).cast("bigint").alias("tt")))).alias("e")).select("e.*")
    s = ends.where("class is not null").groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"), F.sum("tt").alias("support"))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    s = s.withColumn("precision", zero(F.col("tp"), F.col("pp"))).withColumn("recall", zero(F.col("tp"), F.col("support")))
    return s.withColumn("f1", zero(2 * F.col("tp"), F.col("pp") + F.col("support"))).select("class", "support", "precision", "recall", "f1")


def macro_f1(rows: DataFrame, true: str, pred: str, classes: list[str]) -> DataFrame:
    """accuracy, macro F1 over the classes met as true, and over all classes given."""
    each = by_class(rows, true, pred)
    macro = each.agg((F.coalesce(F.sum(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)) / F.greatest(F.count_if(F.col("support") > 0), F.lit(1))).alias("macro_seen"), (F.coalesce(F.sum(F.when(F.col("class").isin(*classes), F.col("f1"))), F.lit(0.0)) / len(classes)).alias("macro_all"))
    accuracy = rows.agg(F.avg((F.col(true).eqNullSafe(F.col(pred))).cast("double")).alias("accuracy"))
    return accuracy.join(macro)


def kappa(rows: DataFrame, true: str, pred: str, weight: str | None = None) -> DataFrame:
    """Observed and expected agreement, and Cohen's kappa (0 where they are both 1)."""
    c = cells(rows, true, pred, weight)
    total = c.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("t").eqNullSafe(F.col("p")), F.col("n")).otherwise(0)).alias("same"))
    t, p = (c.groupBy(F.col(x).alias("class")).agg(F.sum("n").alias(f"n_{x}")) for x in "tp")
    expected = t.join(p, "class").agg(F.sum(F.col("n_t").cast("double") * F.col("n_p")).alias("e"))
    po, pe = F.col("same") / F.col("total"), F.coalesce(F.col("e"), F.lit(0.0)) / F.col("total") / F.col("total")
    return total.join(expected).select(po.alias("observed"), pe.alias("expected"), F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0)).alias("kappa"))


def tvd(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.agg((F.sum(F.abs(a - b)) / 2).alias("tvd"))


def gini(rows: DataFrame, value: str, top: int = 5) -> DataFrame:
    """Gini coefficient of non-negative values and the share of the `top` largest.

    The rows are already one for each holder; ranks come from value counts in ranges of values, so equal values cost one row.
    """
    v = rows.groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    up = cumulated(v, ["x"], ["k"]).withColumnRenamed("before_k", "before").join(F.broadcast(v.agg(F.sum("k").alias("__all"))))
    up = up.withColumn("after", F.col("__all") - F.col("before") - F.col("k"))
    ranks = F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2
    largest = F.greatest(F.lit(0), F.least(F.col("k"), F.lit(top) - F.col("after")))
    s = up.agg(F.sum("k").alias("n"), F.sum(F.col("x") * F.col("k")).alias("sx"), F.sum(F.col("x") * ranks).alias("rx"), F.sum(F.col("x") * largest).alias("tx"))
    return s.select(((2 * F.col("rx") - (F.col("n") + 1) * F.col("sx")) / (F.col("n") * F.col("sx"))).alias("gini"), (F.col("tx") / F.col("sx")).alias("top_share"))


def ks(rows: DataFrame, value: str, second: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance; `second` tells the samples apart."""
    v = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count_if(~second).alias("a"), F.count_if(second).alias("b"))
    up = cumulated(v, ["x"], ["a", "b"]).join(F.broadcast(v.agg(F.sum("a").alias("__a"), F.sum("b").alias("__b"))))
    d = F.abs((F.col("before_a") + F.col("a")) / F.col("__a") - (F.col("before_b") + F.col("b")) / F.col("__b"))
    return up.withColumn("d", d).agg(F.max("d").alias("ks"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def average_rank(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ranks from 1, ties by their mean. Ranks come from value counts, joined back: equal values cost one row to sort."""
    v = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("__k"))
    v = cumulated(v, ["__x"], ["__k"]).select("__x", (F.col("before___k") + (F.col("__k") + 1) / 2).alias(name))
    return rows.join(v, F.col(value) == F.col("__x")).drop("__x")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks over the pairs that are complete."""
    from ..functions.stats import pearson

    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    return ranked.agg(pearson(F.col("rx"), F.col("ry")).alias("rho"), F.count(F.lit(1)).alias("n"))


def mutual_information(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information (nats) of two discrete columns from their counts."""
    c = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("nx", F.sum("n").over(W.partitionBy("x"))).withColumn("ny", F.sum("n").over(W.partitionBy("y"))).join(F.broadcast(c.agg(F.sum("n").alias("total"))))
    return c.agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / F.col("nx") / F.col("ny"))).alias("mi"))


def digamma(n: Column) -> Column:
    """The digamma function of a whole number from 1 on: six steps up, then its asymptotic series."""
    far = n.cast("double") + 6
    steps = sum((F.lit(1.0) / (n + i) for i in range(1, 6)), F.lit(1.0) / n)
    inverse = F.lit(1.0) / (far * far)
    return F.ln(far) - F.lit(0.5) / far - inverse * (F.lit(1 / 12) - inverse * (F.lit(1 / 120) - inverse * (F.lit(1 / 252) - inverse / 240))) - steps


def digammas(n: np.ndarray) -> np.ndarray:
    """digamma of an array."""
    far = n + 6.0
    inverse = 1 / (far * far)
    return np.log(far) - 0.5 / far - inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse / 240))) - sum(1 / (n + float(i)) for i in range(6))


#: Distinct numbers (by class) of a range.
RANGE_VALUES = 1 << 17


def ranged(values: DataFrame, x: str) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds __range, the number of the range of x in which a column lies; none of the ranges is empty."""
    n, least = values.agg(F.count(F.lit(1)), F.min(x)).first()
    parts = -(-n // RANGE_VALUES)
    bounds = values.stat.approxQuantile(x, [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({b for b in bounds if least < b < math.inf})
    if not bounds:
        return lambda df, column: df.withColumn("__range", F.lit(0).cast("bigint"))
    splits = [-math.inf, *bounds, math.inf]
    return lambda df, column: Bucketizer(splits=splits, inputCol=column, outputCol="__range", handleInvalid="keep").transform(df).withColumn("__range", F.col("__range").cast("bigint"))


def range_neighbours(values: DataFrame, k: int) -> DataFrame:
    """values (y, x, c: the rows of that x in that class, __ny, __range) to one row a range, with y null, and rows of its borders.

    All but the first and last k values of a class in a range have their k neighbours on either side, and all that is nearer, in
    the range: the range's row has n, the rows of these, and t, their sum of psi(k) - psi(rows of the class) - psi(m). It also has
    the total of the range and, for what comes from elsewhere, its numbers and the rows before each (numbers, sums). Borders are
    the first and last 2 k values of each class; __edge marks those that are not in t.
    """

    def measure(key, rows):
        labels = rows.column("y").combine_chunks().dictionary_encode()
        x, c, size = (rows.column(name).to_numpy() for name in ("x", "c", "__ny"))
        codes = labels.indices.to_numpy()
        order = np.lexsort((x, codes))
        x, c, size, codes = x[order], c[order], size[order], codes[order]
        first = np.searchsorted(codes, codes)
        place, after = np.arange(len(x)) - first, np.searchsorted(codes, codes, "right") - 1 - np.arange(len(x))
        side = np.minimum(place, after)
        numbers, which = np.unique(x, return_inverse=True)
        amounts = np.zeros(len(numbers), np.int64)
        np.add.at(amounts, which, c)
        sums = np.r_[0, np.cumsum(amounts)]

        at = np.flatnonzero(side >= k)
        steps = np.r_[-k:0, 1 : k + 1]
        away = np.abs(x[at[:, None] + steps] - x[at, None])
        by = np.argsort(away, axis=1, kind="stable")
        met = np.cumsum(np.take_along_axis(np.minimum(c[at[:, None] + steps], k), by, axis=1), axis=1)
        last = np.argmax(met >= (k - c[at] + 1)[:, None], axis=1)
        r = np.where(c[at] > k, 0.0, np.take_along_axis(away, by, axis=1)[np.arange(len(at)), last])
        low = np.where(r == 0, which[at], np.searchsorted(numbers, x[at] - r, "right"))
        high = np.where(r == 0, which[at] + 1, np.searchsorted(numbers, x[at] + r, "left"))
        t = float((c[at] * (digammas(np.array([k])) - digammas(size[at]) - digammas(sums[high] - sums[low]))).sum())

        ends = np.flatnonzero(side < 2 * k)
        none = lambda kind: pa.nulls(len(ends), kind)
        one = lambda value, kind: pa.array([value], kind)
        kinds = {"y": labels.dictionary.type, "x": pa.float64(), "c": pa.int64(), "__ny": pa.int64(), "__edge": pa.bool_()}
        border = [labels.dictionary.take(pa.array(codes[ends])), pa.array(x[ends]), pa.array(c[ends]), pa.array(size[ends]), pa.array(side[ends] < k)]
        whole = [(int(c[at].sum()), pa.int64()), (t, pa.float64()), (int(sums[-1]), pa.int64()), (numbers.tobytes(), pa.binary()), (sums.tobytes(), pa.binary())]
        columns = [pa.array([key[0].as_py()] * (1 + len(ends)), pa.int64())]
        columns += [pa.chunked_array([pa.nulls(1, kind), values]) for kind, values in zip(kinds.values(), border, strict=True)]
        columns += [pa.chunked_array([one(value, kind), none(kind)]) for value, kind in whole]
        return pa.table(columns, ["__range", *kinds, "n", "t", "total", "numbers", "sums"])

    kind = values.schema["y"].dataType.simpleString()
    schema = f"__range bigint, y {kind}, x double, c bigint, __ny bigint, __edge boolean, n bigint, t double, total bigint, numbers binary, sums binary"
    return values.select("__range", "y", "x", "c", "__ny").groupBy("__range").applyInArrow(measure, schema)


def edge_radii(borders: DataFrame, k: int) -> DataFrame:
    """The values at the edges of ranges with __k (k at most) and r, the distance to the __k-th nearest other row of the class: only
    the k values on either side can hold it, and borders are deep enough to have these."""
    own = W.partitionBy("y").orderBy("x")
    near = F.concat(F.collect_list(F.struct("x", "c")).over(own.rowsBetween(-k, -1)), F.collect_list(F.struct("x", "c")).over(own.rowsBetween(1, k)))
    away = F.array_sort(F.flatten(F.transform(near, lambda e: F.array_repeat(F.abs(e["x"] - F.col("x")), F.least(e["c"], F.lit(k)).cast("int")))))
    found = borders.withColumns({"__away": away, "__k": F.least(F.lit(k), F.col("__ny") - 1)}).where("__edge")
    return found.withColumn("r", F.when(F.col("c") > F.col("__k"), F.lit(0.0)).otherwise(F.get("__away", (F.col("__k") - F.col("c")).cast("int")))).drop("__away", "__edge")


def rows_before(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """asked (y, x, side, v, equal, __range) as y, x, side and before: the rows of all ranges below v, or up to it if `equal`."""
    ahead = F.coalesce(F.sum("total").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lists = asked.groupBy("__range").agg(F.collect_list(F.struct("y", "x", "side", "v", "equal")).alias("asked"))
    met = ranges.select("__range", "numbers", "sums").join(lists, "__range").join(F.broadcast(ranges.select("__range", ahead.alias("ahead"))), "__range")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                numbers, sums = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in ((0, np.float64), (1, np.int64)))
                y, x, side, v, equal = batch.column(2).slice(i, 1).flatten().flatten()
                v, equal = v.to_numpy(), equal.to_numpy(zero_copy_only=False)
                at = np.where(equal, np.searchsorted(numbers, v, "right"), np.searchsorted(numbers, v, "left"))
                yield pa.RecordBatch.from_arrays([y, x, side, pa.array(sums[at] + batch.column(3)[i].as_py())], ["y", "x", "side", "before"])

    kind = asked.schema["y"].dataType.simpleString()
    return met.select("numbers", "sums", "asked", "ahead").mapInArrow(answer, f"y {kind}, x double, side int, before bigint")


def knn_information(rows: DataFrame, x: str, y: str, k: int = 3) -> DataFrame:
    """n, estimate and mi (not below 0): mutual information (nats) of a number and a class by nearest neighbours.

    For each row the distance r to its k-th neighbour of the same class (the last one in smaller classes) and the number m of
    rows of any class nearer than r (as near, if r is 0; itself included) give psi(n) + mean(psi(k) - psi(rows of the class) -
    psi(m)). Rows with a null (or NaN) and classes of one row are left out. Equal numbers are counted, not repeated, and no
    noise is added. Numbers are dealt once to ranges, which answer for all but a few values at their edges; these ask the ranges
    that their distances reach.
    """
    known = rows.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(y).isNotNull())
    values = cut(known.groupBy(F.col(y).alias("y"), (F.col(x).cast("double") + 0.0).alias("x")).agg(F.count(F.lit(1)).alias("c")))
    sizes = values.groupBy("y").agg(F.sum("c").alias("__ny")).where("__ny > 1")
    values = values.join(F.broadcast(sizes), "y") if sizes.limit(10_001).count() <= 10_000 else cut(values.join(sizes, "y"))
    dealt = ranged(values, "x")
    found = cut(range_neighbours(dealt(values, "x"), k))
    ranges = found.where("y IS NULL")
    near = cut(edge_radii(found.where("y IS NOT NULL").select("y", "x", "c", "__ny", "__edge"), k))
    zero = F.col("r") == 0
    bound = lambda v, equal, side: near.select("y", "x", F.lit(side).alias("side"), v.alias("v"), equal.alias("equal"))
    asked = dealt(bound(F.col("x") - F.col("r"), ~zero, 0).unionByName(bound(F.col("x") + F.col("r"), zero, 1)), "v")
    m = rows_before(asked, ranges).groupBy("y", "x").agg((F.max(F.when(F.col("side") == 1, F.col("before"))) - F.max(F.when(F.col("side") == 0, F.col("before")))).alias("m"))
    term = F.col("c") * (digamma(F.col("__k")) - digamma(F.col("__ny")) - digamma(F.col("m")))
    both = ranges.select("n", "t").unionByName(near.join(m, ["y", "x"]).select(F.col("c").alias("n"), term.alias("t")))
    s = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("t").alias("t"))
    s = s.select("n", F.when(F.col("n") > 0, digamma(F.greatest("n", F.lit(1))) + F.col("t") / F.greatest("n", F.lit(1))).alias("estimate"))
    return s.withColumn("mi", F.greatest(F.col("estimate"), F.lit(0.0)))


def calibration(rows: DataFrame, prob: str, correct: Column, bins: int = 15) -> DataFrame:
    """Expected and maximum calibration error over equal bins (0, 1], and the Brier score."""
    k = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col(prob) * bins) - 1))
    b = rows.withColumn("__ok", correct.cast("double")).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("p"), F.avg("__ok").alias("a"), F.sum((F.col(prob) - F.col("__ok")) ** 2).alias("s"))
    gap = F.abs(F.col("p") - F.col("a"))
    return b.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), (F.sum("s") / F.sum("n")).alias("brier"))


def isotonic(rows: DataFrame, prob: str, correct: Column):
    """A fitted isotonic map from probability to observed accuracy."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    data = VectorAssembler(inputCols=[prob], outputCol="__f").transform(rows.withColumn("__y", correct.cast("double")))
    return IsotonicRegression(featuresCol="__f", labelCol="__y").fit(data)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def poisson(u: float, most: int = 8) -> list[float]:
    """The distribution function of a Poisson variable of mean u, at 0 to most - 1."""
    total, term, out = 0.0, math.exp(-u), []
    for k in range(most):
        total += term
        out.append(total)
        term *= u / (k + 1)
    return out


#: Limits of the weights 0 to 8 on a draw in [0, 1): a cluster weighs as many as its draw exceeds.
WEIGHTS = poisson(1.0)


_TURNS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_SINES = tuple(int(abs(math.sin(i + 1)) * 2**32) for i in range(64))
#: Digests made side by side (their arrays stay in the cache), clusters weighed at once.
SIDE_BY_SIDE, CLUSTERS = 1 << 15, 128


def digests(text: np.ndarray) -> np.ndarray:
    """MD5 of equally long messages of at most 55 bytes, the last axis of text: four little-endian words in its place."""
    size = text.shape[-1]
    block = np.zeros((*text.shape[:-1], size // 4 * 4 + 4), np.uint8)
    block[..., :size], block[..., size] = text, 128
    words = [np.ascontiguousarray(w) for w in np.moveaxis(block.view("<u4"), -1, 0)]
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(text.shape[:-1], x) for x in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            at, _ = i, np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at, _ = (5 * i + 1) % 16, np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at, _ = (3 * i + 5) % 16, np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at, _ = 7 * i % 16, np.invert(d, out=f)
            f |= b
            f ^= c
        if at < len(words):
            a += words[at]
        a += np.uint32((_SINES[i] + (8 * size if at == 14 else 0)) % 2**32)
        a += f
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=t)
        a <<= np.uint32(_TURNS[i])
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + y for x, y in zip((a, b, c, d), start, strict=True)], axis=-1)


def weights(clusters: list[str], replicates: int, seed: int) -> np.ndarray:
    """(clusters, replicates) weights: replicate r takes the (r mod 4)-th 32 bits of the MD5 digest of cluster/(r div 4)/seed.

    Digests of names and block numbers of equal lengths are made side by side, those of very long names one by one.
    """
    names, tail = [c.encode() for c in clusters], f"/{seed}".encode()
    blocks = [f"/{b}".encode() + tail for b in range(-(-replicates // 4))]
    draws = np.empty((len(names), len(blocks), 4), np.uint32)
    ends = {n: np.array([i for i, b in enumerate(blocks) if len(b) == n]) for n in {len(b) for b in blocks}}
    lengths = np.array([len(c) for c in names], int)
    for size in np.unique(lengths):
        same = np.flatnonzero(lengths == size)
        for n, at in ends.items():
            step = max(1, SIDE_BY_SIDE // len(at))
            for mine in (same[i : i + step] for i in range(0, len(same), step)):
                if size + n > 55:
                    got = np.frombuffer(b"".join(md5(names[c] + blocks[b]).digest() for c in mine for b in at), "<u4")
                else:
                    text = np.empty((len(mine), len(at), size + n), np.uint8)
                    text[:, :, :size] = np.frombuffer(b"".join(names[c] for c in mine), np.uint8).reshape(len(mine), 1, size)
                    text[:, :, size:] = np.frombuffer(b"".join(blocks[b] for b in at), np.uint8).reshape(-1, n)
                    got = digests(text)
                draws[np.ix_(mine, at)] = got.reshape(len(mine), len(at), 4)
    draws = draws.byteswap(inplace=True).reshape(len(names), -1)[:, :replicates]  # the 32 bits are read with the first byte in front
    out = np.zeros(draws.shape, np.int8)
    for x in WEIGHTS:
        out += draws > np.uint32(math.floor(x * 4294967296.0))
    return out


def bootstrap_cells(rows: DataFrame, cluster: str, true: str, pred: str, replicates: int, seed: int = 7) -> DataFrame:
    """replicate (from 1), t, p and w: confusion counts under Poisson weights of whole clusters (sessions).

    The counts of each cluster are summed first. Then each task multiplies the weights of its clusters, which lie together and
    are drawn once, with their counts, some clusters at a time, and sends one sum for each replicate and cell: tasks x
    replicates x cells rows, whatever the size of the data. A null cluster is the cluster of that name (an empty text).
    """
    c = rows.groupBy(F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias("c"), F.col(true).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            owner, n = names.indices.to_numpy(), batch.column(3).to_numpy()  # numbers of clusters ascend, as these lie together
            cells = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            place = {cell: i for i, cell in enumerate(dict.fromkeys(cells))}
            which, total = np.array([place[x] for x in cells]), np.zeros((len(place), replicates), np.int64)
            for first in range(0, len(names.dictionary), CLUSTERS):
                part = names.dictionary.slice(first, CLUSTERS).to_pylist()
                a, b = np.searchsorted(owner, [first, first + len(part)])
                w = weights(part, replicates, seed).astype(np.int64)
                for i in np.unique(which[a:b]):  # row by row: a product of matrices would start threads in every task
                    at = a + np.flatnonzero(which[a:b] == i)
                    total[i] += (n[at, None] * w[owner[at] - first]).sum(axis=0)
            for cell, i in place.items():
                sums[cell] = sums.get(cell, 0) + total[i]
        for (t, p), w in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1, dtype=np.int32)), pa.array([t] * replicates, pa.string()), pa.array([p] * replicates, pa.string()), pa.array(w)], ["replicate", "t", "p", "w"])

    dealt = c.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "c").sortWithinPartitions("c")  # the work is in the draws, not in the rows
    return dealt.mapInArrow(run, "replicate int, t string, p string, w bigint").groupBy("replicate", "t", "p").agg(F.sum("w").alias("w"))


def bootstrap_f1(rows: DataFrame, cluster: str, true: str, pred: str, replicates: int = 200, seed: int = 7) -> DataFrame:
    """replicate and macro F1 (over the classes met as true) under Poisson weights of clusters (sessions)."""
    w = cut(bootstrap_cells(rows, cluster, true, pred, replicates, seed))  # read three times, drawn once
    w = w.withColumn("tt", F.sum("w").over(W.partitionBy("replicate", "t"))).withColumn("pp", F.sum("w").over(W.partitionBy("replicate", "p")))
    diagonal = w.where(F.col("t") == F.col("p")).select("replicate", F.col("t").alias("class"), (2 * F.col("w")).alias("a"), (F.col("tt") + F.col("pp")).alias("b"))
    met = w.where("tt > 0").groupBy("replicate").agg(F.count_distinct("t").alias("k"))
    f1 = diagonal.groupBy("replicate").agg(F.sum(F.coalesce(F.try_divide("a", "b"), F.lit(0.0))).alias("f"))
    return met.join(f1, "replicate", "left").select("replicate", (F.coalesce("f", F.lit(0.0)) / F.col("k")).alias("macro_f1"))
