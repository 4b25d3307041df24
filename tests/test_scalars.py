import itertools

import pytest
from pyspark.sql import functions as F

from loomspark.functions import scalars as S


@pytest.mark.parametrize(
    ("args", "kw", "want"),
    [
        ((20, 5000), {}, (20, 2000)),
        ((900, 1000), {"force": True}, (100, 200)),
        ((900, 1000), {}, (900, 1000)),
        ((50, 1000), {"least": 0.1}, (50, 500)),
        ((4933, 15000), {}, (4933, 10000)),
        ((9000, 15000), {}, (5000, 10000)),
        ((14500, 15000), {}, (500, 1000)),
        ((50, 100000), {"max_samples": 10000}, (50, 5000)),
        ((60000, 200000), {}, (3000, 10000)),
        ((15, 200000), {"max_samples": 500, "least": 0.00001}, (15, 500)),
        ((25, 1000), {"max_samples": 100, "least": 0.02}, (25, 100)),
        ((10, 400), {"max_samples": 100, "least": 0.03}, (10, 100)),
    ],
)
def test_quota(args, kw, want):
    assert S.quota(*args, **kw) == want


def test_quota_errors():
    with pytest.raises(ValueError, match="positive"):
        S.quota(9, 100)
    with pytest.raises(ValueError, match="total"):
        S.quota(10, 29)


def test_quota_columns_agree(spark):
    grid = [(p, n, lo, hi, s, mp, f) for p, n, lo, hi, s, mp, f in itertools.product([10, 25, 400, 900], [100, 1000, 12000], [0.01, 0.25], [0.3, 0.5], [100, 5000], [10], [True, False]) if p < n]
    df = spark.createDataFrame([tuple(map(float, g[:6])) + (g[6],) for g in grid], "p double, n double, lo double, hi double, s double, mp double, f boolean")
    a, b = S.quota_columns(*[F.col(c) for c in ("p", "n", "lo", "hi", "s", "mp", "f")])
    for r in df.withColumns({"a": a, "b": b}).collect():
        want = S.quota(int(r.p), int(r.n), least=r.lo, most=r.hi, max_samples=int(r.s), min_positives=int(r.mp), force=r.f)
        assert (r.a, r.b) == want, r


def test_half_even_and_grid():
    assert [S.half_even(x) for x in (0.5, 1.5, 2.5, 2.6)] == [0, 2, 2, 3]
    assert S.step_grid() == [10000, 32500, 55000, 77500, 100000]
    assert S.min_partitions(15000, 10000) == 22 and S.min_seen(15000, 10000) == 3
    assert S.min_seen(10, 10) == 1 and S.min_rounds(10, 10) == 1
