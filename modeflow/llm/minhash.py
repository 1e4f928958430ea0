"""Near-duplicate detection by b-bit MinHash.

Signatures keep the low bits of each minimum, packed into words. Bands of full minima give candidate groups; inside a group
pairs are compared by bit counts with the collision-corrected estimate, and only those near the threshold or above link
candidates. The candidate components then get their whole shingle sets once, and links are confirmed on these.

Scale: documents of equal sets are merged first; a band group or a candidate component of more than CHUNK members is dealt
out as blocks of two chunks each, so no task holds more than two chunks (those with whole sets are bounded by shingles, too);
only links that join different parts leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .common import cut, table
from .components import components

#: Minima, bits kept of each, members of a block side and shingles of one (about; a larger document is a side of its own).
MINIMA, BITS, CHUNK, CHUNK_SHINGLES = 192, 2, 512, 1 << 20
_rng = np.random.default_rng(20240611)
_MULTIPLIERS = (_rng.integers(0, 1 << 32, 256, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADDENDS = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
#: Shingles that one vectorised step of the minima takes.
_STEP = 4096


def band_rows(threshold: float, minima: int = MINIMA, miss: float = 2e-6) -> int:
    """The most rows of a band with which a pair at the threshold is missed by all bands with a chance below `miss`."""
    fits = [r for r in range(1, 17) if (1 - threshold**r) ** (minima // r) < miss]
    return max(fits, default=1)


def minima(sets: np.ndarray, offs: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """(rows, n) minima of the hashed sets under n permutations of 32 bits; empty sets must have been left out."""
    x = (sets >> np.uint64(16)).astype(np.uint32)
    out = np.full((len(offs) - 1, n), 0xFFFFFFFF, np.uint32)
    a, b = _MULTIPLIERS[:n, None], _ADDENDS[:n, None]
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + _STEP, "right")) - 1)
        if j == i + 1:
            for s in range(offs[i], offs[j], _STEP):
                np.minimum(out[i], (x[None, s : min(s + _STEP, offs[j])] * a + b).min(axis=1), out=out[i])
        else:
            h = x[None, offs[i] : offs[j]] * a + b
            out[i:j] = np.minimum.reduceat(h, offs[i:j] - offs[i], axis=1).T
        i = j
    return out


def packed(m: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of the minima, packed to bytes."""
    low = ((m[:, :, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(low.reshape(len(m), -1), axis=1)


def estimates(one: np.ndarray, many: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Collision-corrected similarities of a packed signature to many, by bit counts."""
    diff = one[None, :] ^ many
    if bits == 2:
        diff = (diff | (diff >> 1)) & np.uint8(0x55)
    equal = 1 - _POPCOUNT[np.ascontiguousarray(diff).view(np.uint16)].sum(axis=1, dtype=np.int64) / (one.size * 8 // bits)
    chance = 0.5**bits
    return (equal - chance) / (1 - chance)


def margin(threshold: float, minima: int = MINIMA, bits: int = BITS) -> float:
    """Five standard deviations of the estimate at the threshold."""
    chance = 0.5**bits
    e = chance + (1 - chance) * threshold
    return 5 * math.sqrt(e * (1 - e) / minima) / (1 - chance)


class Parts:
    """Union-find over local indices."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def signatures(batches: Iterator[pa.RecordBatch], k: int, rows: int, n: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n_shingles, SHA-256 of the sorted set, packed signature, band keys)."""
    bands = n // rows
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, count, data, offs in T.steps(texts):
            low = T.lowered(data)
            starts, ends, owner = T.words(data, offs)
            sets, at = T.shingles(T.word_hashes(low, starts, ends), owner, count, k)
            sizes = np.diff(at)
            some = np.flatnonzero(sizes)
            digests = [sha256(sets[at[r] : at[r + 1]].tobytes()).digest() for r in range(count)]
            signs = [None] * count
            keys = [None] * count
            if len(some):
                m = minima(sets, np.concatenate([at[some], at[-1:]]), n)
                with np.errstate(over="ignore"):
                    h = np.zeros((len(some), bands), np.uint64)
                    part = m[:, : bands * rows].reshape(len(some), bands, rows).astype(np.uint64)
                    for i in range(rows):
                        h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, :, i] + np.uint64(i + 1))
                    h = T.mix(h + np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
                for r, s, key in zip(some, packed(m), h, strict=True):
                    signs[r] = s.tobytes()
                    keys[r] = key
            yield pa.RecordBatch.from_arrays([ids.slice(first, count), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "digest", "signature", "keys"])


def runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal leading columns, from batches sorted by them; single rows are passed over."""
    held: list[pa.Table] = []

    def done(t: pa.Table) -> Iterator[pa.Table]:
        if t.num_rows < 2:
            return
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in range(columns):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        at = np.append(np.flatnonzero(new), t.num_rows)
        for i in np.flatnonzero(np.diff(at) > 1):
            yield t.slice(at[i], at[i + 1] - at[i])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table(batch)
        last = [t.column(c)[t.num_rows - 1].as_py() for c in range(columns)]
        same = np.ones(t.num_rows, bool)
        for c in range(columns):
            same &= t.column(c).to_numpy() == last[c]
        head = t.num_rows - int(same.sum())
        if head or (held and [held[-1].column(c)[0].as_py() for c in range(columns)] != last):
            yield from done(pa.concat_tables([*held, t.slice(0, head)]))
            held = []
        held.append(t.slice(head))
    if held:
        yield from done(pa.concat_tables(held))


def candidate_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of a band group's members whose estimate reaches `least`; a spanning forest of them."""
    for group in runs(batches, 2):
        ids = group.column("id").to_numpy()
        sign = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
        parts, a, b = Parts(len(ids)), [], []
        roots = parts.roots()
        for i in range(len(ids) - 1):
            other, changed = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1, False
            if len(other):
                for j in other[estimates(sign[i], sign[other]) >= least]:
                    if parts.join(i, int(j)):
                        a.append(ids[i])
                        b.append(ids[j])
                        changed = True
            if changed:
                roots = parts.roots()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirmed_links(batches: Iterator[pa.RecordBatch], k: int, numerator: int, denominator: int, least: float, n: int) -> Iterator[pa.RecordBatch]:
    """Links of a candidate component's members that hold on their whole sets; a spanning forest of them."""
    for group in runs(batches, 2):
        ids = group.column("id").to_numpy()
        sets: list[np.ndarray] = []
        for _, count, data, offs in T.steps(group.column("text")):
            low = T.lowered(data)
            starts, ends, owner = T.words(data, offs)
            h, at = T.shingles(T.word_hashes(low, starts, ends), owner, count, k)
            sets += [h[at[i] : at[i + 1]].copy() for i in range(count)]
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(sizes, kind="stable")
        sizes = sizes[order]
        sign = packed(minima(np.concatenate([sets[i] for i in order]), np.concatenate([[0], np.cumsum(sizes)]), n))
        parts, a, b = Parts(len(ids)), [], []
        roots = parts.roots()
        for i in range(len(ids) - 1):
            top = int(np.searchsorted(sizes * numerator, sizes[i] * denominator, "right"))  # |x| / |y| bounds the similarity
            other = np.flatnonzero(roots[i + 1 : top] != roots[i]) + i + 1
            if not len(other):
                continue
            near = other[estimates(sign[i], sign[other]) >= least]
            mine, changed = sets[order[i]], False
            for j in near:
                if parts.find(i) == parts.find(int(j)):
                    continue
                theirs = sets[order[j]]
                both = np.concatenate([mine, theirs])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if denominator * common >= numerator * (len(mine) + len(theirs) - common):
                    parts.join(i, int(j))
                    changed = True
                    a.append(ids[order[i]])
                    b.append(ids[order[j]])
            if changed:
                roots = parts.roots()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def in_blocks(rows: DataFrame, key: str, chunk: int, weight: str | None = None) -> DataFrame:
    """Adds `side`: 0 for all members of a group of up to `chunk`; members of larger groups go to all blocks of two chunks
    that theirs is part of, as a row for each block. A column of weights (shingles) bounds the chunks by CHUNK_SHINGLES, too."""
    heavy = F.sum(weight) / CHUNK_SHINGLES if weight else F.lit(0.0)
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.ceil(F.greatest(F.count(F.lit(1)) / chunk, heavy)).cast("int").alias("__chunks")).where("__n > 1").drop("__n")
    own = F.pmod(F.xxhash64("id"), F.col("__chunks")).cast("int")
    other = F.when(F.col("__chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__chunks") - 1))
    dealt = rows.join(many, key).withColumn("__own", own).withColumn("__other", F.explode(other))
    pair = F.least("__own", "__other") * F.col("__chunks") + F.greatest("__own", "__other")
    return dealt.withColumn("side", pair.cast("bigint")).drop("__chunks", "__own", "__other")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, numerator: int = 80, denominator: int = 100, minima_: int = MINIMA, chunk: int = CHUNK) -> DataFrame:
    """id, n_shingles (size of the set) and component_id (the smallest id reachable over links) of every row.

    Two documents are linked where denominator * intersection >= numerator * union of their sets of k-word shingles (A-Z in
    lower case). With 1 to k-1 words the whole sequence is the one shingle. A null or empty text, or one of white space only,
    has an empty set and is linked with nothing. Rows that repeat an id are compared as documents of their own and share its
    component. Ids must be integers; a row with a null id is linked with nothing and has a null component. Other columns are
    ignored.
    """
    threshold = numerator / denominator
    rows, least = band_rows(threshold, minima_), threshold - margin(threshold, minima_)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id bigint, n_shingles bigint, digest binary, signature binary, keys array<bigint>"
    signed = cut(docs.mapInArrow(lambda batches: signatures(batches, k, rows, minima_), schema))
    some = signed.where("n_shingles > 0 and id is not null")
    same = cut(some.groupBy("digest", "n_shingles").agg(F.min("id").alias("representative")))  # cut: the join below can then split a hot set
    representative = cut(some.select("id", "digest", "n_shingles").join(same, ["digest", "n_shingles"]).select("id", "representative"))
    unique = some.groupBy("digest").agg(F.min_by(F.struct("id", "signature", "keys"), "id").alias("r")).select("r.*")
    banded = unique.select("id", "signature", F.explode("keys").alias("key"))
    grouped = in_blocks(banded, "key", chunk).select("key", "side", "id", "signature")
    grouped = grouped.repartition("key", "side").sortWithinPartitions("key", "side", "id")
    links = grouped.mapInArrow(lambda batches: candidate_links(batches, least), "a bigint, b bigint").distinct()
    candidates = components(links)
    weights = some.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    wide = in_blocks(candidates.select(F.col("node").alias("id"), F.col("component").alias("key")).join(weights, "id"), "key", chunk, "n_shingles").drop("n_shingles")
    texts = docs.join(representative.where("id = representative").select("id").distinct().join(wide, "id"), "id").select("key", "side", "id", "text")
    texts = texts.repartition("key", "side").sortWithinPartitions("key", "side", "id")
    held = texts.mapInArrow(lambda batches: confirmed_links(batches, k, numerator, denominator, least, minima_), "a bigint, b bigint")
    found = components(held.union(representative.where("id <> representative").select("id", "representative")))
    sizes = signed.select("id", "n_shingles")
    return sizes.join(found, sizes.id == found.node, "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df without those whose component has a smaller id."""
    gone = near_groups(df, id_col, text_col, **options).where("id <> component_id").select(F.col("id").alias("__gone")).distinct()
    return df.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op8_minhash(spark, sf_dir):
    found = near_groups(table(spark, sf_dir, "documents"), k=3, numerator=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
