"""Collocations equal those of plain counting, for any size of runs and shards."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from modeflow.llm import phrases
from modeflow.llm.phrases import Slots, collocations, counted, merged, verified

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, top=2000):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(words)
            for size in range(1, longest + 1):
                f.update((("und" if lang is None else lang), *words[i : i + size]) for i in range(len(words) - size + 1))
    good = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, *words), a in good.items():
        if len(words) < 2:
            continue
        inside = [b for (la, *other), b in good.items() if la == lang and len(other) > len(words) and any(other[i : i + len(words)] == words for i in range(len(other))) and 100 * b >= 50 * a]
        if inside:
            continue
        cut = min((1_000_000 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        k = cut[1]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, all_ in out.items() for i, (s, a, p, x, y) in enumerate(sorted(all_)[:top], 1))


def found(df, **more):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations(df, **more).collect())


def made(seed, n=150):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(12)] + ["É", "é", "ß", "A", "a", "x" * 3000]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(pool[: rng.randrange(2, len(pool))]) + rng.choice(ends) for _ in range(rng.randrange(40)))) for _ in range(n)]
    return rows + rows[:20] + [("en", None), ("en", ""), ("de", " \t"), ("de", "..."), ("fr", "one two"), (None, "a a a a a a a a a a a a a a")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as k", "2 as a", "3 as n", "'x' as word", "4 as rank").repartition(5)


@pytest.mark.parametrize("least", [2, 10])
def test_plain_counts(spark, least):
    rows = made(least)
    assert found(frame(spark, rows), least=least) == brute(rows, least=least) != []


def test_longer_phrases_and_all_rows(spark):
    rows = made(7, 60)
    assert found(frame(spark, rows), longest=4, least=4, top=None) == brute(rows, 4, 4, 10**9) != []
    assert found(frame(spark, rows), least=4, top=3) == brute(rows, 3, 4, 3) != []


def test_small_runs_and_filters_change_nothing(spark, monkeypatch):
    rows = made(3)
    monkeypatch.setattr(phrases, "FLUSH_KEYS", 8)
    monkeypatch.setattr(phrases, "MOST_BITS", 10)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 50)
    monkeypatch.setattr(phrases, "MOST_LANGS", 0)
    assert found(frame(spark, rows), least=3) == brute(rows, least=3) != []


def test_hot_pair(spark):
    """One pair of words in every text; counts whose product passes 64 bits are exact in the score's arithmetic."""
    rows = [("en", f"of the t{i % 700} of the end{i % 5}") for i in range(4000)]
    assert found(frame(spark, rows)) == brute(rows) != []


def test_nothing(spark, no_docs):
    assert found(no_docs) == []
    assert found(frame(spark, [("en", None), ("en", " ")])) == []
    assert found(frame(spark, [("en", "a b")] * 9)) == []
    assert found(frame(spark, [("en", "a b")] * 10)) == [("en", 1, "a b", 10, 10, 10, 20, 1_000_000)]


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, (50_000, 2), dtype=np.uint64), axis=0)
    columns = [np.ascontiguousarray(c) for c in keys.T]
    slots = Slots.load(Slots.of(columns).dump())
    assert sorted(slots(columns).tolist()) == list(range(len(keys)))
    held = np.zeros_like(keys)
    held[slots(columns)] = keys
    others = [columns[0] + np.uint64(1), columns[1]]
    assert (verified(slots, held, columns) >= 0).all() and (verified(slots, held, others) < 0).all()
    assert sum(len(b) for b in slots.levels) < 6 * len(keys)
    assert len(Slots.of([np.zeros(0, np.uint64)])([np.zeros(0, np.uint64)])) == 0
    with pytest.raises(ValueError, match="told apart"):
        Slots.of([np.ones(2, np.uint64)])


def test_counts_of_runs(monkeypatch):
    """Sums by slot equal those by key; keys that share a hash are told apart by themselves."""
    rng = np.random.default_rng(2)
    runs = [merged([rng.integers(0, 9, 500).astype(np.uint64), rng.integers(0, 9, 500).astype(np.uint64)], rng.integers(1, 4, 500)) for _ in range(5)]
    want = Counter()
    for c, n in runs:
        for key, k in zip(zip(*c, strict=True), n, strict=True):
            want[tuple(map(int, key))] += int(k)
    _, keys, counts = counted(runs, 40)
    assert {tuple(map(int, k)): int(c) for k, c in zip(keys, counts, strict=True) if c >= 40} == {k: c for k, c in want.items() if c >= 40}
    monkeypatch.setattr(phrases, "key_hash", lambda columns, level=0: np.zeros(len(columns[0]), np.uint64))
    columns, n = merged([np.array([3, 1, 3, 2], np.uint64), np.array([0, 0, 0, 1], np.uint64)], np.array([1, 1, 1, 1]))
    assert sorted(zip(columns[0].tolist(), columns[1].tolist(), n.tolist(), strict=True)) == [(1, 0, 1), (2, 1, 1), (3, 0, 2)]
