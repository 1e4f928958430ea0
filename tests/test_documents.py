"""Exports of a document store: projection, pushed filters, ranges of bytes, and a stream that goes on where it stopped."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from modeflow.sources import documents as docs

SCHEMA = "`_id` string, userId string, ms long, `a.mode` string, `a.speed` double, at timestamp, more string"


def made(n=500):
    out = []
    for i in range(n):
        d = {"_id": {"$oid": f"{i:024x}"}, "userId": f"u{i % 5}", "ms": {"$numberLong": str(1000 * i)}, "a": {"mode": ["car", "walk"][i % 2], "speed": i / 2, "x": [1]}, "at": {"$date": 1_700_000_000_000 + i}, "more": {"k": [i]}}
        if i % 50 == 0:
            del d["a"]
        if i % 70 == 0:
            d["ms"] = "broken"
        out.append(d)
    return out


def put(folder, name, rows, mode="w", end="\n"):
    folder.mkdir(exist_ok=True)
    with open(folder / name, mode, encoding="utf-8") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + end)


def expected(d):
    a = d.get("a", {})
    ms = d["ms"]
    return (d["_id"]["$oid"], d["userId"], int(ms["$numberLong"]) if isinstance(ms, dict) else None, a.get("mode"), a.get("speed"), json.dumps(d["more"]))


@pytest.mark.parametrize("size", [100, 1000, 1 << 20])
def test_all_documents_once(spark, tmp_path, size):
    """Ranges cut lines anywhere; malformed and empty lines are left out; the last line may lack its end."""
    rows = made()
    put(tmp_path / "d", "one.json", [*rows[:300], "", "{not json", "[1]", '"text"'])
    put(tmp_path / "d", "two.json", [rows[300] | {"userId": "ü" * 3000}, *rows[301:]], end="")
    put(tmp_path / "d", "_hidden.json", rows[:3])
    got = docs.documents(spark, str(tmp_path / "d"), SCHEMA, size)
    assert got.rdd.getNumPartitions() > (10 if size < 1 << 20 else 1)
    rows[300] = rows[300] | {"userId": "ü" * 3000}
    assert sorted(tuple(r)[:5] + (r["more"],) for r in got.collect()) == sorted(map(expected, rows))
    first = got.where(F.col("_id") == f"{7:024x}").first()
    assert first["at"].astimezone(timezone.utc) == datetime.fromtimestamp(1_700_000_000.007, timezone.utc)


def test_filters_reach_the_reader(spark, tmp_path):
    rows = made()
    put(tmp_path / "d", "one.json", rows)
    got = docs.documents(spark, str(tmp_path / "d"), SCHEMA).where("userId = 'u1' and ms >= 100000 and ms < 300000 and `a.mode` in ('car', 'bus') and userId like 'u%'")
    want = [r for r in map(expected, rows) if r[1] == "u1" and r[2] is not None and 100_000 <= r[2] < 300_000 and r[3] == "car"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(w[:5] for w in want) != []
    reader = docs.DocumentReader({"path": str(tmp_path / "d")}, got.schema)
    left = list(reader.pushFilters([docs.D.EqualTo(("userId",), "u1"), docs.D.GreaterThan(("ms",), 5000), docs.D.IsNull(("ms",)), docs.D.EqualTo(("unknown",), 1)]))
    assert [type(f) for f in left] == [docs.D.IsNull, docs.D.EqualTo]
    read = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert read == sum(r[1] == "u1" and r[2] is not None and r[2] > 5000 for r in map(expected, rows))  # rows that leave the reader


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Cursors by file: what was read before a restart is not read again; a line without its end waits."""
    rows = made(60)
    src, out = tmp_path / "d", str(tmp_path / "out")

    def run():
        stream = docs.document_stream(spark, str(src), "`_id` string, userId string")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["_id"] for r in spark.read.parquet(out).collect())

    ids = [d["_id"]["$oid"] for d in rows]
    whole = json.dumps(rows[20])
    put(src, "u0.json", [*rows[:20], whole[:30]], end="")
    assert run() == ids[:20]
    put(src, "u0.json", [whole[30:], *rows[21:30]], "a")
    put(src, "u1.json", rows[30:50])
    assert run() == ids[:50]
    assert run() == ids[:50]
    put(src, "u1.json", rows[50:], "a")
    assert run() == ids


def test_empty_folders(spark, tmp_path):
    (tmp_path / "d").mkdir()
    assert docs.documents(spark, str(tmp_path / "d"), "a string").count() == 0
    (tmp_path / "d" / "none.json").touch()
    assert docs.documents(spark, str(tmp_path / "d"), "a string").count() == 0
    with pytest.raises(Exception, match="name the fields"):
        spark.read.format("documents").option("path", str(tmp_path / "d")).load()
