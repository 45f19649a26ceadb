"""Every registered query on the smallest tables against its SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry
from tools.check import close, rows

SF = "/root/testdata/sf0.001"
SLOW = {"ml_grid_search", "ml_random_forest_tuned", "ml_anomaly_tuning", "ml_sequence_classifier"}
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert "attack_chain" in df.columns and df.count() > 0


#: Trained at full size by the driver only; tests/test_training.py runs them with small forests.
TRAINED = {"detect_trained_scores", "detect_trained_alerts"}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - TRAINED))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = rows(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want))


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0
