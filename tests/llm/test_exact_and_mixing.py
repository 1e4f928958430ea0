import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from modeflow.llm import exact, mixing
from modeflow.llm.components import components


def test_exact_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(exact.OP10_SQL + " ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in exact.op10_exact_dedup(spark, sf).orderBy("doc_id").collect()] == want


def test_exact_odd_rows(odd_docs, no_docs):
    got = exact.exact_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["keep_id"], by[1]["group_size"], by[1]["kept"], by[2]["kept"]) == (2, 2, False, True)  # null is empty
    assert (by[4]["keep_id"], by[4]["group_size"]) == (5, 3) and sum(r["kept"] for r in got if r["doc_id"] == 5) == 2
    assert by[10]["text_sha256"] == hashlib.sha256("é ünïcödé \U0001f600 x".encode()).hexdigest()
    kept = exact.exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9, 10]
    assert {r["text"] for r in exact.exact_dedup(odd_docs.where("doc_id = 1")).collect()} == {None}
    assert exact.exact_groups(no_docs).count() == exact.exact_dedup(no_docs).count() == 0


def test_exact_of_one_hot_text(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(16)
    r = exact.exact_groups(df).where("text_sha256 = sha2('hot', 256)").agg(F.count(F.lit(1)), F.max("group_size"), F.sum(F.col("kept").cast("int")), F.max("keep_id")).first()
    assert tuple(r) == (6667, 6667, 1, 19_998)


def test_exact_of_unordered_columns(spark):
    """Maps have no order; the largest id still decides."""
    df = spark.createDataFrame([(1, "a", {"k": 1}, 5), (2, "a", {"k": 2}, 4), (None, "b", None, 1), (None, "b", None, 2)], "doc_id bigint, text string, extra map<string, int>, n int")
    assert sorted((r["doc_id"] or 0, r["text"], r["extra"], r["n"]) for r in exact.exact_dedup(df).collect()) == [(0, "b", None, 2), (2, "a", {"k": 2}, 4)]
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact.exact_groups(df).collect()) == [(0, 0, 2, True), (0, 0, 2, True), (1, 2, 2, False), (2, 2, 2, True)]


def filled(sizes, weights, repeats=3.0):
    """Targets by repeated sharing: the plain form of the closed one."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if share * weights[i] > repeats * sizes[i]}
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = repeats * sizes[i]
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 50, 1000], [0, 10, 5, 7000, 3], [5], [1, 1, 1, 1, 100_000, 2, 9], [0, 0]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size bigint")
    got = [r["target"] for r in mixing.source_targets(df).orderBy("source").collect()]
    assert got == pytest.approx(filled(sizes, [1 + i % 3 for i in range(len(sizes))]))


@pytest.mark.parametrize(("votes", "seats"), [([5300, 2400, 2300], 10), ([1, 1, 1, 1], 2), ([7, 0, 3], 5), ([100, 80, 30, 20], 8), ([340, 280, 160, 60, 15], 67)])
def test_apportionment(spark, votes, seats):
    want = [0] * len(votes)
    for _ in range(seats):
        want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    df = spark.createDataFrame([(1, i, v, seats) for i, v in enumerate(votes)], "g int, p int, v bigint, s bigint")
    assert [r["quota"] for r in mixing.sainte_lague(df, ["g"], ["p"], "v", "s").orderBy("p").collect()] == want


def test_mix(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = mixing.op4_mixing(spark, sf)
    assert m.columns == ["doc_id", "size", "source_size", "target", "taken"] and m.count() == docs.count() and m.where("taken > 3 * size or taken < 0").count() == 0
    for r in m.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("k"), F.max("target").alias("t")).collect():
        assert abs(r["k"] - r["t"]) <= max(64, 0.03 * r["t"])
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, mixing.op4_mixing(spark, sf).collect()))
    odd = mixing.mix(odd_docs)
    assert odd.count() == odd_docs.count() and odd.columns[:-4] == odd_docs.columns
    assert {r["doc_id"]: r["__size"] for r in odd.collect()} == {1: 0, 2: 0, 3: 0, 4: 60, 5: 60, 6: 61, 7: 40_000, 8: 2, 9: 2, 10: 4}
    assert mixing.mix(no_docs).count() == mixing.mixed_rows(no_docs).count() == 0
    assert mixing.mixed_rows(odd_docs).columns == odd_docs.columns
    blank = odd_docs.where("doc_id < 4")
    assert {r["__taken"] for r in mixing.mix(blank).collect()} == {0}


def test_mix_deals_rows_without_an_id(spark):
    """Null ids go to shards by their texts; rows that repeat an id and a size stand in the order of their texts."""
    rows = [(None, f"w{i} x y", "a") for i in range(300)] + [(7, f"{i % 10} words", "a") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = [sorted((r["text"], r["__taken"]) for r in mixing.mix(d, shard_words=100).collect()) for d in (df, df.orderBy(F.desc("text")).repartition(7))]
    assert taken[0] == taken[1] and sum(t for _, t in taken[0]) == pytest.approx(1100, abs=64)


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (5, 5)] + [(100 + i, 101 + i) for i in range(200)] + [(1000, 2000 + i) for i in range(500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert [got[i] for i in (1, 2, 3, 10, 11, 12)] == [1, 1, 1, 10, 10, 10] and 5 not in got
    assert {got[100 + i] for i in range(201)} == {100} and {got[2000 + i] for i in range(500)} == {1000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
