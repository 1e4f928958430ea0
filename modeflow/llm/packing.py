"""Hierarchical multi-length packing of tokenised documents.

Documents are routed to context-size tiers (powers of two). Whole windows of the longest tier are cut off documents beyond
it; what remains goes to the shortest tier that holds it. From the longest tier down, a window takes a document of its tier
and its gap is filled from shorter tiers, the longest fitting document first; a document is cut only where none fits. Full
windows have the size of their tier, a power of two, and so need no padding. What is left at the end of a partition is cut
into powers of two. The sequences of a block are dealt to step groups of about equal tokens.

No shuffle: each task packs the documents of its partition in blocks of bounded tokens, and hands the open rest to the next
block. Each partition ends in a few short sequences, so a table of very many tiny partitions is better coalesced before.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Window sizes; tokens of a block and of a step group; the id that ends a document; word parts kept with their ids by a worker.
TIERS = (2048, 1024, 512, 256, 128)
BLOCK_TOKENS, STEP_TOKENS, END_ID, KEPT_PARTS = 1 << 20, 16 * 2048, 1, 600_000
#: Texts without any other character split into words alike in Python and in the tokenizer; others go to the tokenizer whole.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ſ]")
_LETTERS, _NUMBERS = "a-zªµºÀ-ÖØ-öø-ÿĀ-ſ", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts as the tokenizer gives them; parts of words are encoded once and kept up to a bound.

    The tokenizer drops white space and splits what is left into parts that it encodes each for itself, so a text's ids are
    those of its parts. The last id of a part, and only that, stands for an end.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.kind = np.dtype("<u2" if len(self.ends) <= 1 << 16 else "<u4")
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if "<|" in t or _OTHER.search(t) else _SPLIT.findall(t.lower()) for t in texts]
        used = set().union(*[s for s in split if s])
        missing = used.difference(self.kept)
        if len(self.kept) + len(missing) > KEPT_PARTS:  # what these texts use stays, and with it all frequent parts
            self.kept = {p: self.kept[p] for p in used.difference(missing)}
        self.learn(list(missing))
        kept, out = self.kept, []
        for text, own in zip(texts, split, strict=True):
            if own is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))
            else:
                out.append(np.frombuffer(b"".join([kept[p] for p in own]), self.kind).astype("<u4"))
        return out

    def learn(self, missing: list[str]) -> None:
        for i in range(0, len(missing), 1000):
            some = missing[i : i + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, self.kind)
            raw, at = ids.tobytes(), 0
            for part, end in zip(some, ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist(), strict=True):
                self.kept[part] = raw[at:end]
                at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(encode: Encoder, texts: pa.Array, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """Ids of each text, about `size` characters at a time; null counts as empty."""
    held: list[str] = []
    for text in texts.to_pylist():
        held.append(text or "")
        if sum(map(len, held[-8:])) >= size or len(held) >= 250:
            yield from encode(held)
            held = []
    yield from encode(held)


class Packer:
    """Packs documents of known lengths; yields sequences as lists of (document, start, length)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.rest: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def add(self, document: int, length: int) -> Iterator[list[tuple[int, int, int]]]:
        """Cuts whole windows of the longest tier off the document and holds the rest."""
        start, most = 0, self.tiers[0]
        while length - start >= most:
            yield [(document, start, most)]
            start += most
        if start < length:
            insort(self.rest, (length - start, document, start))

    def window(self) -> list[tuple[int, int, int]] | None:
        """The next window, led by the longest document held; None where too little is held to fill it."""
        rest = self.rest
        size = min(t for t in self.tiers if t >= rest[-1][0])
        gap, taken = size, []
        while gap and rest:
            at = bisect_right(rest, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                length, document, start = rest.pop(at)
            else:  # none fits: the shortest is cut
                length, document, start = rest.pop(0)
                insort(rest, (length - gap, document, start + gap))
                length = gap
            taken.append((document, start, length))
            gap -= length
        if gap:
            for document, start, length in taken:
                insort(rest, (length, document, start))
            return None
        return taken

    def block(self) -> Iterator[list[tuple[int, int, int]]]:
        """All windows that what is held can fill."""
        while self.rest and (found := self.window()):
            yield found

    def finish(self) -> Iterator[list[tuple[int, int, int]]]:
        """The rest, less than a window, as sequences of powers of two."""
        yield from self.block()
        left = sum(x[0] for x in self.rest)
        while left:
            size = gap = 1 << (left.bit_length() - 1)
            taken = []
            while gap:
                length, document, start = self.rest.pop()
                if length > gap:
                    insort(self.rest, (length - gap, document, start + gap))
                    length = gap
                taken.append((document, start, length))
                gap -= length
            left -= size
            yield taken


def step_groups(sizes: list[int], tokens: int) -> list[int]:
    """A step group for each sequence: the longest first, each to the group with the fewest tokens so far."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, g = groups[0]
        heapq.heapreplace(groups, (load + sizes[i], g))
        out[i] = g
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, step_group.

    A null text counts as empty; an empty document is its end id alone. Rows that repeat an id are packed each for
    themselves. Other columns are ignored. No piece is longer than the longest tier. Sequence and group numbers are unique
    over all partitions and the same for the same partitions.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = encoder(path), Packer(tiers)
        base = TaskContext.get().partitionId() << 40
        ids: dict[int, tuple[object, np.ndarray]] = {}
        serial, n_sequences, n_groups, tokens = 0, 0, 0, 0
        ready: list[list[tuple[int, int, int]]] = []

        def out() -> pa.RecordBatch:
            nonlocal n_sequences, n_groups
            groups = step_groups([sum(p[2] for p in s) for s in ready], step_tokens)
            rows: list[tuple] = []
            for sequence, group in zip(ready, groups, strict=True):
                offset = 0
                for document, start, length in sequence:
                    doc, own = ids[document]
                    rows.append((doc, start, length, zlib.crc32(own[start : start + length].tobytes()), len(own), base + n_sequences, offset, base + n_groups + group))
                    offset += length
                n_sequences += 1
            n_groups += max(groups, default=-1) + 1
            ready.clear()
            held = {p[1] for p in packer.rest}
            for document in [d for d in ids if d not in held]:
                del ids[document]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_group"]
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, found in zip(batch.column(0).to_pylist(), encoded(encode, batch.column(1)), strict=True):
                own = np.append(found, np.uint32(end_id)).astype("<u4")
                ids[serial] = doc, own
                ready += packer.add(serial, len(own))
                serial += 1
                tokens += len(own)
                if tokens >= BLOCK_TOKENS:
                    ready += packer.block()
                    yield out()
                    tokens = 0
        ready += packer.finish()
        if ready:
            yield out()

    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    longs = ", ".join(f"{c} bigint" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_group"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {longs}")


def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
