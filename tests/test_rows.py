import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from loomspark.models import meta
from loomspark.models.ensemble import BinaryClassifier
from loomspark.models.progress import Progress
from loomspark.sources.rows import MatrixReader, gather_rows, matrix_rows, ranges_of, write_matrix


def saved(folder, n=1000, width=5, parts=3, kind=np.float32):
    x = np.arange(n * width, dtype=kind).reshape(n, width)
    folder.mkdir()
    for i, p in enumerate(np.array_split(x, parts)):
        np.save(folder / f"part-{i}.npy", p)
    return x


def test_filters_become_ranges():
    at = ("row_id",)
    assert ranges_of([In(at, (5, 3, 900)), LessThanOrEqual(at, 100)], 500) == ([(3, 4), (5, 6)], [])
    assert ranges_of([GreaterThan(at, 9), LessThanOrEqual(at, 20)], 500) == ([(10, 21)], [])
    assert ranges_of([EqualTo(at, 7), EqualTo(at, 8)], 500)[0] == [] and ranges_of([], 0)[0] == []
    other = EqualTo(("features",), 1)
    assert ranges_of([other], 10) == ([(0, 10)], [other])


def test_only_named_rows_are_planned(tmp_path):
    saved(tmp_path / "m")
    r = MatrixReader({"path": str(tmp_path / "m"), "rows": "100"})
    assert sum(b - a for p in r.partitions() for a, b in p.ranges) == 1000 and len(r.partitions()) == 12
    assert list(r.pushFilters([In(("row_id",), (3, 700, 701, 5000))])) == []
    assert [p.ranges for p in r.partitions()] == [[(3, 4)], [(700, 701), (701, 702)]]
    got = [(i, f[0]) for p in r.partitions() for b in r.read(p) for i, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert got == [(3, 15.0), (700, 3500.0), (701, 3505.0)]


def test_matrix_source_and_gather(spark, tmp_path):
    x = saved(tmp_path / "m", kind=np.int16)
    df = matrix_rows(spark, str(tmp_path / "m"), rows=64)
    assert [r.features for r in df.orderBy("row_id").collect()] == x.astype(float).tolist()
    assert df.filter("row_id > 990 AND features[0] > 0").count() == 9
    index = spark.createDataFrame([(0, 999), (1, 3), (2, 3), (3, 4000)], "pos long, row_id long")
    for most in (100, 1):
        assert sorted((r.pos, r.features[0]) for r in gather_rows(spark, str(tmp_path / "m"), index, most=most).collect()) == [(0, 4995.0), (1, 15.0), (2, 15.0)]
    np.save(tmp_path / "one.npy", np.ones((2, 2)))
    assert matrix_rows(spark, str(tmp_path / "one.npy")).count() == 2
    with pytest.raises(Exception, match="nothing at"):
        matrix_rows(spark, str(tmp_path / "none")).count()


def test_matrix_round_trip(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 3).alias("key"), F.array(F.col("id") / 2, F.lit(1.0)).alias("v")).repartition(7)
    for _ in range(2):  # the second takes the place of the first
        write_matrix(df, str(tmp_path / "w"), key="key", features="v", rows=64)
        assert [(r.row_id, r.features[0]) for r in matrix_rows(spark, str(tmp_path / "w")).orderBy("row_id").collect()] == [(i, i / 2) for i in range(500)]
    write_matrix(df.limit(0), str(tmp_path / "empty"), key="key", features="v")
    assert matrix_rows(spark, str(tmp_path / "empty")).count() == 0


def test_portfolio_gives_the_nearest(spark, tmp_path):
    path = str(tmp_path / "p")
    small = spark.createDataFrame([(i % 2, [float(i), 0.0]) for i in range(20)], "y int, features array<double>")
    large = spark.createDataFrame([(int(i % 50 == 0), [1.0] * 8) for i in range(2000)], "y int, features array<double>")
    of = lambda df: meta.meta_features(df, "y", "features")
    assert meta.nearest(spark, path, of(small)) is None
    meta.remember(spark, path, of(small), {"trees": 20})
    meta.remember(spark, path, of(large), {"trees": 300})
    assert meta.nearest(spark, path, of(small.limit(15))) == {"trees": 20} and meta.nearest(spark, path, of(large.limit(1500))) == {"trees": 300}
    r = of(small).first()
    assert (r.n_rows, r.n_features, r.positive_share) == (20, 2, 0.5) and abs(r.zero_share - 21 / 40) < 1e-12


def test_a_fit_reports_its_partitions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, int(i % 3 == 0), [float(v) for v in rng.normal(size=3) + (i % 3 == 0)]) for i in range(300)], "row_id long, y int, features array<double>")
    told = []
    m = BinaryClassifier("logistic_regression", "quick", pca=False, max_samples=90).fit(df, lambda *x: told.append(x))
    assert [x[:3] for x in told] == [("partitions", 0, 1), ("partitions", 1, 1), ("models", 0, len(m.models)), ("models", len(m.models), len(m.models))]
    assert len(m.models) >= 3 and m.progress.jobs("models") > 0 and m.progress.frame().count() == 4
    p = Progress(spark, "x")
    with pytest.raises(ZeroDivisionError), p.stage("s"):
        1 / 0
    assert [r[:3] for r in p.rows] == [("s", 0, 1)]
