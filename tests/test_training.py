"""The registered model queries train at the size of the reference."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.operators import models
from tidewatch.plans import reports
from tools.check import close, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_training_sizes(spark, monkeypatch):
    """What is asked for is noted; small forests are grown in their stead."""
    asked, forest = [], models.train_forest

    def noted(train, features, trees=200, leaf=2, depth=None, scheme="balanced", label="label", seed=42):
        asked.append((trees, leaf, depth, scheme, train.count()))
        return forest(train, features, 2, leaf, 2, scheme, label, seed)

    monkeypatch.setattr(models, "train_forest", noted)
    entry.queries()["ml_random_forest"](spark, SF)
    assert [a[:4] for a in asked] == [(200, 2, None, "balanced")]
    rows = asked.pop()[4]
    seen, search = [], models.grid_search
    monkeypatch.setattr(models, "grid_search", lambda *a, **b: seen.append(search(*a, **b)) or seen[-1])
    entry.queries()["ml_random_forest_tuned"](spark, SF)
    *candidates, final = asked
    best = seen[0].filter("chosen").first()
    assert len(candidates) == len(models.GRID) and {a[:4] for a in candidates} == {(100, leaf, d, w) for d, leaf, w in models.GRID}
    assert final[:4] == (200, best["leaf"], best["depth"], best["weights"])
    assert final[4] == rows  # all training rows, not the candidates' fifth


@pytest.mark.parametrize("name", ["ml_random_forest_tuned", "ml_grid_search"])
def test_candidates_read_rows_that_are_split_once(spark, monkeypatch, name):
    """What a candidate reads again and again is a stored table, not a split of all training rows."""

    class Asked(Exception):
        pass

    def noted(train, valid, features, **sizes):
        raise Asked(train._jdf.queryExecution().executedPlan().toString(), train.count())

    monkeypatch.setattr(models, "grid_search", noted)
    with pytest.raises(Asked) as asked:
        entry.queries()[name](spark, SF)
    plan, rows = asked.value.args
    assert rows and "FileScan parquet" in plan and "Window" not in plan and "Exchange" not in plan


def test_sequence_rounds(spark, monkeypatch):
    class Asked(Exception):
        pass

    def noted(windows, width, label="label", hidden=64, rounds=50, seed=42):
        raise Asked(rounds)

    monkeypatch.setattr(models, "train_sequence_classifier", noted)
    with pytest.raises(Asked) as asked:
        entry.queries()["ml_sequence_classifier"](spark, SF)
    assert asked.value.args == (50,)


@pytest.mark.parametrize("name", ["detect_trained_scores", "detect_trained_alerts"])
def test_trained_flow_by_properties(spark, name):
    """The whole way with small models: what the SQL says must hold whatever they have learned."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF, trees=8, rounds=3, tree_count=10)
    res = con.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in res.description], res.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want))


def test_severity_without_rows(spark):
    """A severity that no alert has is there with 0."""
    df = spark.createDataFrame([("a", "LOW"), ("b", "LOW")], "alert_id string, severity string")
    got = {r["severity"]: r["n"] for r in reports.analytics_by_severity(df).collect()}
    assert got == {"CRITICAL": 0, "HIGH": 0, "MEDIUM": 0, "LOW": 2}
