"""Every query with SQL of its own gives the same rows as another engine on the same tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from modeflow.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(str(plain(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    df, other = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(other.columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_whole_jobs(spark, sf, monkeypatch):
    """The whole archive, the replicates of the survey and its forest."""
    from modeflow.operators import metrics, models

    assert QUERIES["archive_readers"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    seen = []
    monkeypatch.setattr(metrics, "bootstrap_f1", lambda rows, cluster, true, pred, replicates=200, seed=7: seen.append(replicates) or spark.createDataFrame([(1, 0.5)], "replicate int, macro_f1 double"))
    QUERIES["bootstrap_ci"](spark, sf)
    assert seen == [3000]

    def fit(self, rows, label, **options):
        seen.append(models.FOREST | options)
        raise InterruptedError

    monkeypatch.setattr(models.Hierarchical, "fit", fit)
    with pytest.raises(InterruptedError):
        QUERIES["hier_rf"](spark, sf)
    assert (seen[1]["numTrees"], seen[1]["maxDepth"]) == (400, 30)


@pytest.mark.parametrize("name", ["imu_spectrum", "imu_gravity"])
def test_spectra_are_of_windows(spark, sf, name):
    """One row of each window that holds samples, so no group is longer than a window."""
    from modeflow.plans import trajectory
    from modeflow.plans.timeline import KEYS, View

    windows = View(spark, sf).assigned(trajectory.samples(spark, sf)).select(*KEYS).distinct()
    got = QUERIES[name](spark, sf)
    assert sorted(map(tuple, got.select(*KEYS).collect())) == sorted(map(tuple, windows.collect())) != []


def test_entry(spark):
    import __spark_entry__

    assert {r["mode"] for r in __spark_entry__.entry(spark).collect()} == {"Walk", "Bus", "Car", "Train"}


def test_entry_without_the_training_data_operators(tmp_path):
    """The entry point and the other queries work where those folders are gone, and only then are they left out."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/modeflow", tmp_path / "modeflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    count = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"]
    alone = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run(count, cwd=tmp_path, env=alone, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
    broken = tmp_path / "modeflow" / "llm"
    broken.mkdir()
    (broken / "__init__.py").write_text("import modeflow.not_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("import modeflow.llm\n")
    assert subprocess.run(count, cwd=tmp_path, env=alone, capture_output=True).returncode != 0
