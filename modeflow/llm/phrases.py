"""Phrase collocation mining: exact counts in arrays that a minimal perfect hash addresses.

Words are counted first. Then, for each phrase length, tasks gather the phrases that are safe by the Apriori rule - all their
shorter parts are frequent - as keys of word hashes with counts, and deal them into shards by a hash of the key. A shard
drops keys whose hash bucket as a whole is too rare, makes a minimal perfect hash over the rest and stores each key at its slot;
every run of keys becomes an array of counts by slot (keys are verified against the stored ones, then bincount), and the
arrays are summed as a tree. Cuts are read from those shards by slot, verified again.

Scale: a shard holds about SHARD_WORDS words' phrases, so shards, not their size, grow with the corpus; runs are merged while
they stream in, so a phrase that stands in every task costs one entry. What is broadcast is a bit map of at most 2^MOST_BITS
bits; a fuller map prunes less and changes no count. The parts that a hot word is asked for are spread over REPLICAS copies of
its shard. A word is known by a 64-bit hash of language and text; the job fails should two words ever share one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textops as T
from .common import stored, table

#: Keys that a task holds before it sends them; words of a shard, about; bits of a filter (as a power of two); copies of a shard that is read.
FLUSH_KEYS, SHARD_WORDS, MOST_BITS, REPLICAS = 1 << 18, 1 << 22, 26, 4
#: Words after which a task sends its counts, which then fit 32 bits.
MOST_SEEN = 1 << 31
#: Languages whose word counts may be broadcast.
MOST_LANGS = 10_000
_GAMMA, _LEVELS = 2, 64
_STEP = np.uint64(0x9FB21C651E98DF25)
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[[ord(c) for c in ".,;:!?"]] = 10  # ends of pieces, as line ends are
_ENDS = np.zeros(256, bool)
_ENDS[10:14] = True


def key_hash(columns: list[np.ndarray], level: int = 0) -> np.ndarray:
    """A 64-bit hash of keys of several words; each level has another."""
    h = np.full(len(columns[0]), (level * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (1 << 64) - 1, np.uint64)
    for c in columns:
        h = T.mix(h * _STEP + c)
    return h


class Slots:
    """A minimal perfect hash over different keys: levels of bit maps, a key's slot is the rank of its first lone bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, at = levels, [], 0
        for bits in levels:
            self.ranks.append(at + np.cumsum(bits) - 1)
            at += int(bits.sum())

    @classmethod
    def of(cls, columns: list[np.ndarray]) -> Slots:
        levels, left = [], np.arange(len(columns[0]))
        while len(left):
            if len(levels) == _LEVELS:
                raise ValueError("keys that cannot be told apart")
            size = max(64, _GAMMA * len(left))
            at = (key_hash([c[left] for c in columns], len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def __call__(self, columns: list[np.ndarray]) -> np.ndarray:
        """The slot of each key, -1 where no level has it; a key that was not hashed may get any slot."""
        out, left = np.full(len(columns[0]), -1), np.arange(len(columns[0]))
        for i, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (key_hash([c[left] for c in columns], i + 1) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> Slots:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
        for size in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at))[:size].astype(bool))
            at += -(-size // 8)
        return cls(levels)


def verified(slots: Slots, keys: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Slots of keys that equal the key stored there; -1 for all others."""
    at = slots(columns)
    some = np.flatnonzero(at >= 0)
    same = (keys[at[some]] == np.column_stack([c[some] for c in columns])).all(axis=1)
    at[some[~same]] = -1
    return at


def merged(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different keys and their summed counts."""
    if not len(counts):
        return columns, counts
    h = key_hash(columns)
    order = np.argsort(h, kind="stable")
    same = np.ones(len(order) - 1, bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    if ((h[order[1:]] == h[order[:-1]]) & ~same).any():  # different keys of one hash: order by the keys themselves
        order = np.lexsort(columns)
        same = np.ones(len(order) - 1, bool)
        for c in columns:
            same &= c[order[1:]] == c[order[:-1]]
    first = np.flatnonzero(np.r_[True, ~same])
    return [c[order[first]] for c in columns], np.add.reduceat(counts[order], first)


def steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, rows, hashes, whether the next word follows in the same piece) of rows (lang, text)."""
    langs = np.concatenate([np.zeros(0, np.uint64), *(T.word_hashes(d, o[:-1], o[1:]) for _, _, d, o in T.steps(batch.column(0)))])
    for first, _, data, at in T.steps(batch.column(1)):
        low = _MAP[data]
        starts, ends, rows = T.words(low, at)
        if not len(starts):
            continue
        hashes = T.mix(T.word_hashes(low, starts, ends) + T.mix(langs[first + rows]))
        piece = np.cumsum(_ENDS[low])[starts]
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (piece[1:] == piece[:-1]) & (rows[1:] == rows[:-1])
        yield low, starts, ends, first + rows, hashes, follows


def taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    sizes = ends - starts
    offs = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offs[:-1], sizes) + np.arange(offs[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data[at]))


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, lang, word, n) of a task, words summed before they leave."""
    parts: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []

    def summed() -> None:
        h = np.concatenate([p[0] for p in parts])
        one, first, back = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
        parts[:] = [(one, n, *(pa.concat_arrays([p[i] for p in parts]).take(pa.array(first)) for i in (2, 3)))]

    def out() -> Iterator[pa.RecordBatch]:
        for h, n, lang, word in parts:
            yield from pa.table([pa.array(h.view(np.int64)), lang.cast(pa.string()), word.cast(pa.string()), pa.array(n)], ["h", "lang", "word", "n"]).to_batches(100_000)
        parts.clear()

    held = 0
    for batch in batches:
        for data, starts, ends, rows, hashes, _ in steps(batch):
            one, first, n = np.unique(hashes, return_index=True, return_counts=True)
            parts.append((one, n, batch.column(0).take(pa.array(rows[first])).cast(pa.large_string()), taken(data, starts[first], ends[first])))
            held += len(one)
            if held > FLUSH_KEYS:
                summed()
                held = len(parts[0][0])
                if held > FLUSH_KEYS // 2:
                    yield from out()
                    held = 0
    if parts:
        summed()
        yield from out()


def bit_map(rows: DataFrame, keys: int) -> np.ndarray:
    """A filter of the keys in column k: about 32 bits each, up to 2^MOST_BITS bits in all."""
    power = min(MOST_BITS, max(10, int(32 * keys).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = key_hash(columns_of(batch.column(0))) >> np.uint64(64 - power)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bits"])

    found = rows.select("k").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (power - 6), np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def may_be(words: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    power = len(words).bit_length() + 5
    at = key_hash(columns) >> np.uint64(64 - power)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def columns_of(keys: pa.Array) -> list[np.ndarray]:
    """The columns of a list column whose lists are equally long."""
    flat = keys.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(len(keys), -1) if len(keys) else np.zeros((0, 1), np.uint64)
    return [np.ascontiguousarray(c) for c in flat.T]


def dealt(columns: list[np.ndarray], shards: int) -> np.ndarray:
    return (T.mix(key_hash(columns, -1)) % np.uint64(shards)).astype(np.int64)


def occurrences(docs: DataFrame, length: int, frequent, shards: int) -> DataFrame:
    """(shard, keys, counts): the phrases of `length` words whose parts, one word shorter, pass the filter, packed by shard."""

    def sent(columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        to = dealt(columns, shards)
        order = np.argsort(to, kind="stable")
        keys, counts, to = np.column_stack(columns)[order], counts[order], to[order]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        ends = np.r_[first[1:], len(to)]
        counts = counts.astype(np.uint32)  # a task sends what it holds before 2^31 words have come
        packed = [(keys[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(first, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int32)), pa.array([k for k, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())], ["shard", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[list[np.ndarray], np.ndarray]] = []
        held = seen = 0
        for batch in batches:
            for _, _, _, _, hashes, follows in steps(batch):
                seen += len(hashes)
                n = len(hashes) - length + 1
                if n <= 0:
                    continue
                part = [hashes[i : i + n + 1] for i in range(length - 1)]  # the shorter phrases, one more than the longer
                ok = may_be(frequent.value, part)
                whole = ok[:n] & ok[1 : n + 1]
                for i in range(length - 1):
                    whole &= follows[i : i + n]
                at = np.flatnonzero(whole)
                parts.append(merged([hashes[i + at] for i in range(length)], np.ones(len(at), np.int64)))
                held += len(parts[-1][1])
                if held > FLUSH_KEYS or seen > MOST_SEEN:
                    parts = [merged([np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts]))]
                    held = len(parts[0][1])
                    if held > FLUSH_KEYS // 2 or seen > MOST_SEEN:
                        yield sent(*parts[0])
                        parts, held, seen = [], 0, 0
        if held:
            yield sent(*merged([np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts])))

    return docs.mapInArrow(run, "shard int, keys binary, counts binary")


def counted(runs: list[tuple[list[np.ndarray], np.ndarray]], least: int) -> tuple[Slots, np.ndarray, np.ndarray]:
    """The hash over the candidates of a shard, their keys and their counts by slot."""
    buckets = np.uint64((1 << max(6, int(2 * sum(len(c) for _, c in runs)).bit_length())) - 1)
    total = np.zeros(int(buckets) + 1, np.int64)
    for columns, counts in runs:
        np.add.at(total, (key_hash(columns) & buckets).astype(np.int64), counts)
    kept = []
    for columns, counts in runs:
        ok = total[(key_hash(columns) & buckets).astype(np.int64)] >= least
        kept.append(([c[ok] for c in columns], counts[ok]))
    candidates, _ = merged([np.concatenate(c) for c in zip(*(k[0] for k in kept), strict=True)], np.concatenate([k[1] for k in kept]))
    slots = Slots.of(candidates)
    keys = np.zeros((len(candidates[0]), len(candidates)), np.uint64)
    keys[slots(candidates)] = np.column_stack(candidates)
    arrays = []
    for columns, counts in kept:
        at = verified(slots, keys, columns)
        arrays.append(np.bincount(at, counts, len(keys)).astype(np.int64))  # weights below 2^53 are exact
    while len(arrays) > 1:  # the tree
        arrays = [a + b for a, b in zip(arrays[::2], [*arrays[1::2], *([np.zeros(len(keys), np.int64)] * (len(arrays) % 2))], strict=True)]
    return slots, keys, arrays[0]


def shards_of(found: DataFrame, length: int, least: int, shards: int) -> DataFrame:
    """(shard, slots, keys, counts): one row for each shard of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[list[np.ndarray], np.ndarray]] = []
        held, shard = 0, None

        def together() -> tuple[list[np.ndarray], np.ndarray]:
            return merged([np.concatenate(c) for c in zip(*(r[0] for r in runs), strict=True)], np.concatenate([r[1] for r in runs]))

        last = FLUSH_KEYS
        for batch in batches:
            for s, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                shard = s
                keys = np.frombuffer(k.as_buffer(), np.uint64).reshape(-1, length)
                runs.append(([np.ascontiguousarray(x) for x in keys.T], np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64)))
                held += len(keys)
                if held > 2 * last:
                    runs = [together()]
                    held = len(runs[0][1])
                    last = max(last, held)
        if shard is not None:
            slots, keys, counts = counted(runs, least)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([slots.dump()], pa.binary()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["shard", "slots", "keys", "counts"])

    return found.repartitionById(shards, F.col("shard")).mapInArrow(run, "shard int, slots binary, keys binary, counts binary")


def word_shards(words: DataFrame, shards: int) -> DataFrame:
    """(shard, slots, keys, counts, langs, words): the frequent words (k, f, lang, word), by slot."""

    def to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(dealt(columns_of(b.column(0)), shards).astype(np.int32)), *b.columns], ["shard", *b.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            t = pa.Table.from_batches(rows).combine_chunks()
            keys = columns_of(t["k"].combine_chunks())
            slots = Slots.of(keys)
            order = np.argsort(slots(keys))
            listed = lambda c: pa.array([t[c].take(pa.array(order)).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([t["shard"][0].as_py()], pa.int32()), pa.array([slots.dump()], pa.binary()), pa.array([keys[0][order].tobytes()], pa.binary()), pa.array([t["f"].to_numpy()[order].tobytes()], pa.binary()), listed("lang"), listed("word")], ["shard", "slots", "keys", "counts", "langs", "words"])

    placed = words.select("k", "f", "lang", "word").mapInArrow(to, "shard int, k array<bigint>, f bigint, lang string, word string").repartitionById(shards, F.col("shard"))
    return placed.mapInArrow(run, "shard int, slots binary, keys binary, counts binary, langs array<string>, words array<string>")


def phrases(held: DataFrame, length: int, least: int) -> DataFrame:
    """(k, a) of the stored keys that are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts = np.frombuffer(k.as_buffer(), np.int64).reshape(-1, length), np.frombuffer(c.as_buffer(), np.int64)
                keys, counts = keys[counts >= least], counts[counts >= least]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, length, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([lists, pa.array(counts)], ["k", "a"])

    return held.select("keys", "counts").mapInArrow(run, "k array<bigint>, a bigint")


def read(asked: DataFrame, held: DataFrame, length: int, shards: int) -> DataFrame:
    """asked (k, a, at, part) with f, lang and word of each part, read from the shard that stores it, by slot.

    lang and word are there for single words only. A part that is not stored (it is not frequent) gives no row; parts of frequent
    phrases always are.
    """

    def to(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, part = columns_of(b.column(0)), columns_of(b.column(3))
            copy = (key_hash(whole, 1) % np.uint64(REPLICAS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((dealt(part, shards) * REPLICAS + copy).astype(np.int32)), *b.columns], ["place", "k", "a", "at", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = keys = counts = langs = words = None
        for b in batches:
            start = 0
            if b.num_rows and b.column("slots")[0].is_valid:
                slots = Slots.load(b.column("slots")[0].as_py())
                keys = np.frombuffer(b.column("keys")[0].as_py(), np.uint64).reshape(-1, length)
                counts = np.frombuffer(b.column("counts")[0].as_py(), np.int64)
                langs, words = (b.column(c)[0].values for c in ("langs", "words"))
                start = 1
            b = b.slice(start)
            if not b.num_rows or slots is None:
                continue
            at = verified(slots, keys, columns_of(b.column("part")))
            ok = pa.array(at >= 0)
            at = at[at >= 0]
            text = [c.take(pa.array(at)) if c is not None else pa.nulls(len(at), pa.string()) for c in (langs, words)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(ok) for c in ("k", "a", "at")), pa.array(counts[at]), *text], ["k", "a", "at", "f", "lang", "word"])

    texts = [c if c in held.columns else F.lit(None).cast("array<string>").alias(c) for c in ("langs", "words")]
    copies = held.select(F.explode(F.sequence(F.col("shard") * REPLICAS, F.col("shard") * REPLICAS + REPLICAS - 1)).alias("place"), "slots", "keys", "counts", *texts)
    placed = asked.select("k", "a", "at", "part").mapInArrow(to, "place int, k array<bigint>, a bigint, at int, part array<bigint>")
    both = copies.unionByName(placed, allowMissingColumns=True).repartitionById(shards * REPLICAS, F.col("place")).sortWithinPartitions("place", F.col("slots").isNull())
    return both.mapInArrow(run, "k array<bigint>, a bigint, at int, f bigint, lang string, word string")


def cuts(found: DataFrame, length: int, held: dict[int, DataFrame], shards: int) -> DataFrame:
    """k, a, lang, phrase, and the lowest-scoring cut (score, l, r) of each phrase."""
    answers = None
    for size in range(1, length):
        places = sorted({*range(length)} if size == 1 else {0, length - size})
        asked = found.select("k", "a", F.explode(F.array(*map(F.lit, places))).alias("at")).withColumn("part", F.slice("k", F.col("at") + 1, F.lit(size)))
        got = read(asked, held[size], size, shards).withColumn("size", F.lit(size))
        answers = got if answers is None else answers.union(got)
    value = lambda column, size, at: F.max(F.when((F.col("size") == size) & (F.col("at") == at), F.col(column)))
    columns = [value("word", 1, i).alias(f"w{i}") for i in range(length)]
    for i in range(1, length):
        columns += [value("f", i, 0).alias(f"l{i}"), value("f", length - i, i).alias(f"r{i}")]
    rows = answers.groupBy("k", "a").agg(value("lang", 1, 0).alias("lang"), *columns)
    # a up to 10^15: the products stay below 10^38
    exact = lambda i: F.expr(f"cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l{i} as decimal(18,0)) * cast(r{i} as decimal(18,0)))")
    best = F.array_min(F.array(*[F.struct(exact(i).cast("bigint").alias("score"), F.lit(i).alias("cut"), F.col(f"l{i}").alias("l"), F.col(f"r{i}").alias("r")) for i in range(1, length)]))
    return rows.select("k", "a", "lang", F.concat_ws(" ", *[f"w{i}" for i in range(length)]).alias("phrase"), best.alias("best")).select("k", "a", "lang", "phrase", "best.score", "best.l", "best.r")


def collocations(df: DataFrame, longest: int = 3, least: int = 10, inside: tuple[int, int] = (1, 2), top: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the collocations of each language, by score, then a (both falling), then phrase.

    A-Z are lower-cased; texts end at `[.,;:!?\\x0A-\\x0D]` and words are runs of anything but space and tab between. A null
    text counts as empty, a null lang as `und`. Phrases of 2 to `longest` words and `least` occurrences (overlaps included) count,
    unless a longer one of them holds their words and has `inside` of their occurrences or more. score is
    floor(1000000 a a / (l r)) at the cut where it is lowest (of equal ones the first), n all words of the language. `top` rows of
    each language stay, all if None. Repeated rows count each time; other columns are ignored; no text, no rows.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    each = docs.mapInArrow(word_counts, "h bigint, lang string, word string, n bigint").repartition("h").groupBy("h", "lang", "word").agg(F.sum("n").alias("f"))
    one = each.groupBy("h").agg(F.max(F.struct("f", "lang", "word")).alias("top"), F.count(F.lit(1)).alias("words"))
    checked = F.when(F.col("words") == 1, F.col("top.f")).otherwise(F.raise_error(F.lit("two words share a hash")))
    words = stored(one.select(F.array("h").alias("k"), "top.lang", "top.word", checked.alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    langs, total = totals.agg(F.count(F.lit(1)), F.sum("n")).first()
    schema = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
    if not total:
        return spark.createDataFrame([], schema)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WORDS))
    frequent = words.where(F.col("f") >= least)
    held = {1: stored(word_shards(frequent, shards), "words-by-slot")}
    known, found = frequent, {}
    for length in range(2, longest + 1):
        bits = spark.sparkContext.broadcast(bit_map(known, known.count()))
        held[length] = stored(shards_of(occurrences(docs, length, bits, shards), length, least, shards), f"phrases-{length}")
        known = found[length] = phrases(held[length], length, least)
    rows = None
    for length, own in found.items():
        scored = cuts(own, length, held, shards)
        for longer in range(length + 1, longest + 1):
            starts = F.explode(F.sequence(F.lit(1), F.lit(longer - length + 1)))
            parts = found[longer].select("a", "k", starts.alias("at")).groupBy(F.slice("k", F.col("at"), F.lit(length)).alias("k")).agg(F.max("a").alias("most"))
            scored = scored.join(parts, "k", "left").where(F.col("most").isNull() | (F.col("most") * inside[1] < F.col("a") * inside[0])).drop("most")
        rows = scored if rows is None else rows.union(scored)
    if rows is None:
        return spark.createDataFrame([], schema)
    rows = rows.join(F.broadcast(totals) if langs <= MOST_LANGS else totals, "lang")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lines AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT id, lang, unnest(w) AS p, generate_subscripts(w, 1) AS i FROM lines),
following AS (SELECT lang, p, lead(p) OVER line AS p2, lead(p, 2) OVER line AS p3 FROM words WINDOW line AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, p, 1 AS size FROM words
  UNION ALL SELECT lang, p || ' ' || p2 AS p, 2 AS size FROM following WHERE p2 IS NOT NULL
  UNION ALL SELECT lang, p || ' ' || p2 || ' ' || p3 AS p, 3 AS size FROM following WHERE p3 IS NOT NULL
), f AS (SELECT lang, p, size, count(*) AS f FROM grams GROUP BY lang, p, size HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
split AS (SELECT lang, p, size, f AS a, string_split(p, ' ') AS w FROM f WHERE size > 1),
cut AS (
  SELECT lang, p, size, a, 1 AS k, w[1] AS one, array_to_string(w[2:], ' ') AS two FROM split
  UNION ALL SELECT lang, p, size, a, 2 AS k, w[1] || ' ' || w[2] AS one, w[3] AS two FROM split WHERE size = 3
), scored AS (
  SELECT c.lang, c.p, c.size, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.p = c.one JOIN f y ON y.lang = c.lang AND y.p = c.two
), low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, q, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS q, a FROM split WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3] AS q, a FROM split WHERE size = 3) t GROUP BY lang, q
), kept AS (SELECT low.* FROM low LEFT JOIN longer g ON low.size = 2 AND g.lang = low.lang AND g.q = low.p WHERE g.a IS NULL OR 100 * g.a < 50 * low.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.p) AS rank, k.p AS phrase, k.a, k.l, k.r, t.n, k.score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
