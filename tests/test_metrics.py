import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomspark.operators import metrics as M


def brute(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)) if p and n else None


def brute_ap(rows):
    out, total = 0.0, sum(y for _, y in rows)
    for s in {s for s, _ in rows}:
        above = [y for t, y in rows if t >= s]
        out += sum(y for t, y in rows if t == s) * sum(above) / len(above)
    return out / total if total else None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([-2.0, -0.5, 0.0, 0.1, 0.10001, 3.0, 1e6]), st.integers(0, 1)), min_size=1, max_size=40))
def test_ranking_metrics(spark, rows):
    df = spark.createDataFrame([(float(s), y) for s, y in rows], "s double, y int")
    a, p = M.auroc(df, "s", "y").first()["auroc"], M.average_precision(df, "s", "y").first()["ap"]
    assert (a is None and brute(rows) is None) or math.isclose(a, brute(rows), abs_tol=1e-12)
    assert (p is None and brute_ap(rows) is None) or math.isclose(p, brute_ap(rows), abs_tol=1e-12)


def test_groups_and_nulls(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.9, 1), ("b", 0.9, 0), ("b", 0.1, 1), ("c", 0.5, 1), ("a", None, 1), ("a", 0.2, None)], "g string, s double, y int")
    assert {r.g: r.auroc for r in M.auroc(df, "s", "y", ["g"]).collect()} == {"a": 1.0, "b": 0.0, "c": None}


def test_roc_and_regression(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    got = {r.threshold: (r.fpr, r.tpr) for r in M.roc_points(df, "s", "y").collect()}
    assert got == {0.9: (0.0, 0.5), 0.8: (0.5, 1.0), 0.1: (1.0, 1.0)}
    r = M.regression(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 5.0)], "t double, g double"), "t", "g").first()
    assert r.spearman == pytest.approx(1.0) and r.mae == pytest.approx(2 / 3) and r.r2 == pytest.approx(-1.0)


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.49,)], "p1 double")
    assert [r.prediction for r in M.threshold(df).collect()] == [1, 0]
