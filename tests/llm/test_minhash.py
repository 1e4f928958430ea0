import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from modeflow.llm import minhash, textops


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]) if w else frozenset()


def brute(docs, k, numerator):
    """Components over all pairs that share a shingle."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for ids in holders.values():
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= numerator * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def edited(rng, words, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def near(spark):
    """Chains and stars of edited copies, in which many links exist between copies only."""
    rng = random.Random(3)
    rows = []
    for g in range(6):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 80, 300]))]
        for _ in range(70):
            rows.append(edited(rng, text, rng.choice([0.0, 0.01, 0.03, 0.06])))
    rows += [" ".join(f"u{rng.randrange(10**5)}" for _ in range(50)) for _ in range(60)] + ["One two", "one TWO", "a b c", "a b c d", ""]
    return spark.createDataFrame([(7 * i + 3, t) for i, t in enumerate(rows)], "doc_id bigint, text string")


@pytest.mark.parametrize(("k", "numerator", "chunk"), [(3, 85, 512), (3, 85, 16), (5, 80, 512)])
def test_groups_equal_brute_force(near, k, numerator, chunk):
    want = brute([(r["doc_id"], r["text"]) for r in near.collect()], k, numerator)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(near, k=k, numerator=numerator, chunk=chunk).collect()}
    assert got == want


def test_one_large_group_of_different_texts(spark):
    """5,000 different members of one group, sub-groups of it that are not linked with the rest, and chains between."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**5)}" for _ in range(120)]
    rows = [edited(rng, base, 0.01) for _ in range(4500)]
    for _ in range(3):  # sub-groups below the threshold, some of them bridged
        other = edited(rng, base, 0.05).split()
        rows += [edited(rng, other, 0.01) for _ in range(150)]
    for _ in range(50):
        rows.append(edited(rng, base, 0.04))
    docs = [(3 * i + 1, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)
    got = {r["id"]: r["component_id"] for r in minhash.near_groups(df, k=3, numerator=85).collect()}
    sets = [shingle_set(t, 3) for _, t in docs]
    shared = [x for x, n in Counter(x for s in sets for x in s).items() if n > 1]
    number = {x: i for i, x in enumerate(shared)}
    has = np.zeros((len(docs), len(shared)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[x] for x in s if x in number]] = 1
    sizes, up = np.array([len(s) for s in sets]), list(range(len(docs)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(docs)):  # all pairs, by counts of common shingles
        common = has[:i] @ has[i]
        for j in np.flatnonzero(100 * common >= 85 * (sizes[i] + sizes[:i] - common)):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    assert got == {d: docs[root(i)][0] for i, (d, _) in enumerate(docs)} and len(set(got.values())) > 1


def test_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (None, text), (4, text), (5, text + " x")], "doc_id bigint, text string")
    assert sorted((r["id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in minhash.near_groups(df).collect()) == [(0, 26, 0), (0, 26, 0), (4, 26, 4), (5, 27, 4)]
    assert sorted(r["doc_id"] or 0 for r in minhash.near_dedup(df).collect()) == [0, 0, 4]


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, 3, 85)
    got = minhash.op8_minhash(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(odd_docs, no_docs):
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(odd_docs, k=3, numerator=85).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[5][1] == 4 and got[6][1] == 4 and got[8] == (1, 8) and got[9] == (1, 8) and got[7][1] == 7
    kept = minhash.near_dedup(odd_docs, k=3, numerator=85)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 7, 8, 10]
    assert minhash.near_groups(no_docs).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.85):
        pool = rng.integers(0, 1 << 63, 2000, dtype=np.int64).astype(np.uint64)
        n = int(1000 * 2 * j / (1 + j))
        a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:n], pool[1000 : 2000 - n]]))
        m = minhash.minima(np.concatenate([a, b]), np.array([0, 1000, 2000]))
        s = minhash.packed(m)
        assert abs(minhash.estimates(s[0], s[1:])[0] - j) < minhash.margin(j)


def test_word_hashes_ignore_position():
    texts = pa.array(["The cat  sat", None, "", "on THE\ncat " + "x" * 300_000 + " the", " "])
    (_, n, data, offs), = textops.steps(texts)
    starts, ends, owner = textops.words(data, offs)
    h = textops.word_hashes(textops.lowered(data), starts, ends)
    assert n == 5 and owner.tolist() == [0, 0, 0, 3, 3, 3, 3, 3] and h[0] == h[4] == h[7] and h[1] == h[5] and len(set(h.tolist())) == 5


def test_bands_miss_almost_nothing():
    for t in (0.7, 0.8, 0.85, 0.95):
        r = minhash.band_rows(t)
        assert (1 - t**r) ** (minhash.MINIMA // r) < 2e-6
