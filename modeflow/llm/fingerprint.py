"""Quartile bucket digests: locality-sensitive fingerprints of whole texts.

The three bytes of each window are hashed to one of BUCKETS counters. The digest holds a check byte, the code of the length,
the quartile ratios, and for each bucket in which quartile of all counters it lies (2 bits). Two digests are compared by a
difference score, the sum of bounded parts; likeness maps it to 0 to 1. A short text fills few buckets; its differences count
by the most that two such digests can differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BUCKETS = 256
#: The most that buckets, length and ratios add to the difference; from LIMIT on two digests are not alike at all.
LENGTH_MOST, RATIO_MOST, LIMIT = 60, 24, 420
#: Bytes of text of a range of ids, ranges at most (larger tables have larger ranges, which tasks sort and stream, so that what
#: the driver holds has a bound); bytes that one vectorised step takes.
RANGE_BYTES, MOST_RANGES, _STEP = 32 << 20, 1 << 14, 1 << 20
_SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_PAIR = np.array([[abs(a - b) * 2 if abs(a - b) < 3 else 8 for b in range(4)] for a in range(4)], np.int64)


def counters(data: bytes) -> np.ndarray:
    """How many triplets of consecutive bytes fall into each bucket."""
    x = np.frombuffer(data, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    with np.errstate(over="ignore"):
        for i in range(0, max(0, len(x) - 2), _STEP):
            part = x[i : i + _STEP + 2].astype(np.uint32)
            h = part[:-2] * _SPREAD[0] + part[1:-1] * _SPREAD[1] + part[2:] * _SPREAD[2]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return total


def length_code(n: int) -> int:
    """The length on a logarithmic scale of quarter octaves, 0 to 255 (lengths above 2^63 share the last code)."""
    return 0 if n < 1 else min(255, 1 + int(np.floor(4 * np.log2(n))))


def digest(text: str) -> str:
    """The hexadecimal fingerprint of a text; equal texts have equal ones, and so has every run of the job.

    A text of fewer than three bytes has empty counters and is told apart by the check bytes alone.
    """
    raw = text.encode("utf-8", "surrogatepass")
    counts = counters(raw)
    q1, q2, q3 = np.partition(counts, [63, 127, 191])[[63, 127, 191]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = np.packbits(np.stack([code >> 1, code & 1], axis=1).astype(np.uint8).reshape(-1)).tobytes()
    ratios = (int(q1 * 16 // q3) if q3 else 0) & 15, (int(q2 * 16 // q3) if q3 else 0) & 15
    check = hashlib.blake2b(raw, digest_size=2).digest()
    return (check + bytes([length_code(len(raw)), ratios[0] << 4 | ratios[1]]) + body).hex()


def parsed(fingerprint: str) -> tuple[int, int, int, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    bits = np.unpackbits(np.frombuffer(raw[4:], np.uint8)).reshape(-1, 2)
    return raw[2], raw[3] >> 4, raw[3] & 15, bits[:, 0] * 2 + bits[:, 1]


def circular(a: int, b: int, size: int) -> int:
    return min(abs(a - b), size - abs(a - b))


def difference(one: str, two: str) -> int:
    """0 for equal fingerprints; each bucket adds 0, 2, 4 or 8 by the distance of its quartiles, length and ratios up to
    LENGTH_MOST and RATIO_MOST."""
    if one == two:
        return 0
    (n, a, b, x), (m, c, d, y) = parsed(one), parsed(two)
    ratios = min(RATIO_MOST, 2 * (circular(a, c, 16) + circular(b, d, 16)))
    return 1 + int(_PAIR[x, y].sum()) + min(LENGTH_MOST, 4 * abs(n - m)) + ratios


def likeness(one: str, two: str) -> float:
    """1 for equal fingerprints; else 1 less the difference as a share of LIMIT, or of what the buckets of both add where they
    share none, if that is less (short texts). Without any triplet in either, unequal texts are not alike at all."""
    if one == two:
        return 1.0
    apart = int(sum(_PAIR[parsed(f)[3], 0].sum() for f in (one, two)))
    return max(0.0, 1.0 - difference(one, two) / max(1, min(LIMIT, apart)))


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as much of the start of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def ranges(rows: DataFrame) -> tuple[DataFrame, list[tuple[int | None, int, int]], int]:
    """rows with `part`, the number of their range of ids; for the first id of each range, that id, the range before it and
    whether the first range of all is meant; and the number of ranges.

    The ranges are quantiles of the ids, of RANGE_BYTES of text each or as many as there are shuffle partitions, but MOST_RANGES
    at most; a null id comes first. Only the limits and first ids of the ranges reach the driver.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    found = rows.select("id").dropna().approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    limits = spark.sparkContext.broadcast(np.array(sorted({int(x) for x in found}), np.int64))

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(limits.value, ids.fillna(0).astype("int64"), "right")).astype(np.int32))

    dealt = rows.withColumn("part", part("id"))
    first = F.min(F.struct(F.col("id").isNotNull().alias("has"), "id"))["id"]
    firsts = rows.select("id").withColumn("part", part("id")).groupBy("part").agg(first.alias("id")).orderBy("part").collect()
    return dealt, [(r["id"], firsts[k - 1]["part"], 1 + (k == 0)) for k, r in enumerate(firsts)], n


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row its id, n_chars, fingerprint, and those of its edited text and their likenesses.

    A null text counts as empty; the last row is followed by the first, a single row by itself. Ids are integers; a null id
    comes before all others. Rows with equal ids follow one another in the order of their texts. Each range of ids goes to a
    task of its own, together with a copy of the first row after it.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt, heads, n = ranges(rows)
    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not heads:
        return spark.createDataFrame([], schema)
    small = spark.createDataFrame(heads, "id bigint, to int, copy int")
    first = rows.join(F.broadcast(small), rows.id.eqNullSafe(small.id)).groupBy(rows.id, "to", "copy").agg(F.min("text").alias("text"))
    both = dealt.select("id", "text", "part", F.lit(0).alias("copy")).union(first.select("id", "text", F.col("to").alias("part"), "copy"))
    placed = both.repartitionById(n, F.col("part")).sortWithinPartitions("part", "copy", F.col("id").asc_nulls_first(), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id, text, part, fingerprint) still without its next
        out: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text, part, copy = (batch.column(c)[i].as_py() for c in range(4))
                own = digest(text)
                if held is not None and held[2] == part:
                    new = edited(held[1], text)
                    print_new = digest(new)
                    out.append((held[0], len(held[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held[3], print_new, likeness(held[3], print_new), likeness(held[3], own)))
                held = None if copy else (doc, text, part, own)
            yield rows_of(out)
            out = []

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return placed.mapInArrow(walk, schema)


def op7_fingerprint(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
