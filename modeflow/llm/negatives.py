"""Hard-negative mining by distributed radix selection on integer scores.

A query set of anchors meets all rows in blocks. Each pass over the rows makes, in every task, a histogram of one digit of the
scores for each window (an anchor's positives, then the negatives allowed by each anchor and positive); the summed histograms
tell which bucket holds the kth score, and the next pass refines that bucket by its next digit. When the kth score is known,
only the rows at or above it are gathered and ranked.

Scale: anchors go out in rounds of ROUND_BYTES, so what the driver and a task hold does not grow with the table; rows are only
scanned, never shuffled. A task sends at most k digits of a window, as the kth best of all rows cannot lie behind the kth best
of its own, and at the end at most k rows of a window, which holds for any number of equal scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, table

#: Bits of a digit; bytes of the anchors' vectors of a round; scores that one step of a task computes.
DIGIT, ROUND_BYTES, STEP = 8, 16 << 20, 1 << 22
_NONE = np.iinfo(np.int64).max


def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, quantised rows, short ones filled with 0) of the rows (id, label, vector) that take part."""
    ids, labels, lists = batch.column(0), batch.column(1), batch.column(2)
    if isinstance(lists, pa.ListArray):
        lists = lists.cast(pa.large_list(lists.type.value_type))
    there = ids.is_valid().to_numpy(False) & labels.is_valid().to_numpy(False) & lists.is_valid().to_numpy(False)
    sizes = np.where(there, lists.value_lengths().fill_null(0).to_numpy(False), 0).astype(np.int64)
    values = lists.flatten()  # of null lists there are none
    owner_sizes = lists.value_lengths().fill_null(0).to_numpy(False).astype(np.int64)
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.zeros(0)  # a null is NaN
    owner = np.repeat(np.arange(len(ids)), owner_sizes)
    bad = ~np.isfinite(flat)
    there[owner[bad]] = False
    width = int(sizes[there].max(initial=0))
    out = np.zeros((len(ids), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(owner_sizes) - owner_sizes, owner_sizes)
    use = there[owner]
    out[owner[use], at[use]] = np.floor(256.0 * flat[use])
    ids = ids.fill_null(0).to_numpy(False).astype(np.int64)
    labels = labels.fill_null(0).to_numpy(False).astype(np.int64)
    return ids[there], labels[there], out[there]


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def extent(rows: DataFrame, every: int) -> tuple[int, int, float]:
    """(anchors, longest vector, largest squared length) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width, most = 0, 0, 0.0
        for batch in batches:
            ids, _, q = vectors(batch)
            n, width = n + int((ids % every == 0).sum()), max(width, q.shape[1])
            with np.errstate(over="ignore"):
                most = max(most, float((q * q).sum(axis=1).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([width]), pa.array([most])], ["n", "width", "most"])

    found = rows.mapInArrow(run, "n bigint, width bigint, most double").agg(F.sum("n"), F.max("width"), F.max("most")).first()
    return found[0] or 0, found[1] or 0, found[2] or 0.0


class Round:
    """The anchors of a round and its windows; a window takes rows of the anchor's label, or of others, with low <= score <= high.

    `done` counts the rows known to be better than the bucket under search, `prefix` is that bucket, in digits of high - score.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, most: float):
        self.ids, self.labels = ids, labels
        # integers up to 2^24 are exact in single precision, up to 2^53 in double
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        self.q, self.bits = np.ascontiguousarray(q.astype(self.kind).T), DIGIT

    def windows(self, owner: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> None:
        order = np.argsort(owner, kind="stable")
        self.owner, self.same, self.low, self.high, self.k = owner[order], same, low[order], high[order], k
        self.width = np.bincount(self.owner, minlength=len(self.ids))
        self.first = np.cumsum(self.width) - self.width
        self.floor = np.full(len(self.ids), _NONE)
        np.minimum.at(self.floor, self.owner, self.low)
        self.ceiling = np.full(len(self.ids), -_NONE)
        np.maximum.at(self.ceiling, self.owner, self.high)
        span = int((self.high - self.low).max(initial=0)) + 1
        self.digits = max(1, -(-span.bit_length() // self.bits))
        self.prefix, self.done, self.level = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64), 0

    def pairs(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, score, id) of the rows that the windows take, bounded parts at a time."""
        ids, labels, q = vectors(batch)
        q = widened(q, self.q.shape[0]).astype(self.kind) if q.shape[1] < self.q.shape[0] else q.astype(self.kind)
        step = max(1, STEP // max(1, len(self.ids)))
        for i in range(0, len(ids), step):
            scores = q[i : i + step] @ self.q
            like = labels[i : i + step, None] == self.labels[None, :]
            r, a = np.nonzero((scores >= self.floor) & (scores <= self.ceiling) & (like if self.same else ~like))
            s, rid = scores[r, a].astype(np.int64), ids[i : i + step][r]
            if self.same:
                other = rid != self.ids[a]
                a, s, rid = a[other], s[other], rid[other]
            for j in range(int(self.width.max(initial=0))):
                w = self.first[a] + j
                ok = j < self.width[a]
                w, sj, ij = w[ok], s[ok], rid[ok]
                ok = (sj >= self.low[w]) & (sj <= self.high[w])
                if ok.any():
                    yield w[ok], sj[ok], ij[ok]

    def histogram(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(window, digit, rows) of a task, up to the digit with which the task alone has k rows."""
        size, shift = 1 << self.bits, self.bits * (self.digits - 1 - self.level)
        total = np.zeros(len(self.owner) * size, np.int64)
        for batch in batches:
            for w, s, _ in self.pairs(batch):
                d = (self.high[w] - s) >> shift
                here = (d >> self.bits) == self.prefix[w]
                total += np.bincount(w[here] * size + (d[here] & (size - 1)), minlength=len(total))
        counts = total.reshape(-1, size)
        before = np.cumsum(counts, axis=1) - counts
        w, d = np.nonzero((counts > 0) & (before < (self.k - self.done)[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(d), pa.array(counts[w, d])], ["w", "digit", "n"])

    def refine(self, found: pa.Table) -> None:
        """Take the summed histograms: the bucket that holds the kth row comes next; without so many rows, the last bucket."""
        counts = np.zeros((len(self.owner), 1 << self.bits), np.int64)
        counts[found["w"].to_numpy(), found["digit"].to_numpy()] = found["n"].to_numpy()
        upto = self.done[:, None] + np.cumsum(counts, axis=1)
        digit = np.minimum((upto < self.k).sum(axis=1), (1 << self.bits) - 1)
        self.done = (upto - counts)[np.arange(len(digit)), digit]
        self.prefix, self.level = (self.prefix << self.bits) + digit, self.level + 1

    def gather(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(window, score, id) of the rows at or above the kth score, of a task the first k of each window only."""
        kept = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for w, s, i in self.pairs(batch):
                ok = self.high[w] - s <= self.prefix[w]
                parts = [np.concatenate(p) for p in zip(kept, (w[ok], s[ok], i[ok]), strict=True)]
                order = np.lexsort((parts[2], -parts[1], parts[0]))
                w, s, i = (p[order] for p in parts)
                fresh = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
                rank = np.arange(len(w)) - np.repeat(fresh, np.diff(np.r_[fresh, len(w)]))
                kept = [w[rank < self.k], s[rank < self.k], i[rank < self.k]]
        yield pa.RecordBatch.from_arrays([pa.array(p) for p in kept], ["w", "score", "id"])


def selected(rows: DataFrame, work: Round) -> DataFrame:
    """(w, score, id, rank) of the first k rows of each window of the round."""
    context = rows.sparkSession.sparkContext
    for _ in range(work.digits):
        held = context.broadcast(work)
        sums = rows.mapInArrow(lambda batches, held=held: held.value.histogram(batches), "w bigint, digit bigint, n bigint").groupBy("w", "digit").agg(F.sum("n").alias("n"))
        found = sums.toArrow()
        work.refine(found)
        held.unpersist()
    held = context.broadcast(work)
    gathered = rows.mapInArrow(lambda batches: held.value.gather(batches), "w bigint, score bigint, id bigint")
    return gathered.withColumn("rank", F.row_number().over(W.partitionBy("w").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= work.k)


def hard_negatives(df: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, least: tuple[int, int] = (1, 2), most: tuple[int, int] = (19, 20), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, rows whose id `every` divides.

    Components are floor(256 x), scores integer inner products; the shorter of two vectors is filled with zeros. An anchor's
    positives are its first rows of the same label, its hard negatives the first rows of other labels whose score lies between
    `least` and `most` times the positive's; first is higher score, then smaller id. A row without id, label or vector, or
    with a null or non-finite component, takes no part. An anchor with no positives, or a window with no negatives, gives no
    rows. Rows that repeat an id are rows of their own, but never positives of an anchor of that id; repeated anchors, equal in
    all, count once. An id of two different rows makes two anchors. Scores that 63 bits cannot hold are an error. Columns of
    other names are ignored.
    """
    spark = df.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector"))
    anchors, width, longest = extent(rows, every)
    if not anchors:
        return spark.createDataFrame([], schema)
    if longest >= 2.0**62:
        raise ValueError("vectors too long: their scores pass 63 bits")
    rounds = -(-anchors * (width + 8) * 8 // round_bytes)
    parts: list[str] = []
    for k in range(rounds):
        near = rows.where((F.col("id") % every == 0) & (F.pmod(F.xxhash64("id"), F.lit(rounds)) == k))
        work = anchors_of(near, width, longest)
        if work is None:
            continue
        reach = int(longest) + 1
        n = len(work.ids)
        work.windows(np.arange(n), True, np.full(n, -reach), np.full(n, reach), positives)
        found = selected(rows, work).toArrow()
        if not found.num_rows:
            continue
        owner, score, pid = found["w"].to_numpy(), found["score"].to_numpy(), found["id"].to_numpy()
        low, high = -(-score * least[0] // least[1]), score * most[0] // most[1]
        some = low <= high
        owner, score, pid, low, high = (x[some] for x in (owner, score, pid, low, high))
        order = np.argsort(owner, kind="stable")
        owner, score, pid = owner[order], score[order], pid[order]
        work.windows(owner, False, low[order], high[order], negatives)
        names = spark.createDataFrame(pa.table({"w": np.arange(len(owner)), "anchor_id": work.ids[owner], "positive_id": pid, "positive_score": score}))
        best = selected(rows, work).join(F.broadcast(names), "w")  # a round's windows: their number is bounded
        parts.append(path := f"{shared_dir(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}")
        best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(path)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def anchors_of(near: DataFrame, width: int, longest: float) -> Round | None:
    """The different anchors among the rows, as a round: at most ROUND_BYTES, or those of one id."""
    batches = near.toArrow().combine_chunks().to_batches()
    got = [vectors(b) for b in batches]
    got = [(i, la, widened(q, width)) for i, la, q in got if len(i)]
    if not got:
        return None
    ids, labels, q = (np.concatenate(p) for p in zip(*got, strict=True))
    _, one = np.unique(np.column_stack([ids, labels, q.astype(np.int64)]), axis=0, return_index=True)
    return Round(ids[one], labels[one], q[one], longest)


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with the labels of every seventh id shifted by one, as the contract has them."""
    label = F.col("label").cast("bigint")
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(relabelled(spark, sf_dir))


OP13_SQL = """
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM valid a JOIN valid b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM scored WHERE alike) t WHERE k <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
