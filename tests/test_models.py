import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.models import base, descriptors, forest, linear
from loomspark.models.base import Options, fit_forests, forest_rows, forest_space, logistic, weighted, with_vector
from loomspark.models.benchmark import against_leaderboard, scores
from loomspark.models.descriptors import circular, descriptor, molecule
from loomspark.models.ensemble import BinaryClassifier, Regressor
from loomspark.models.ridge import fit_ridge
from loomspark.models.search import Range, Search
from loomspark.operators.features import is_integer_matrix
from loomspark.operators.gram import Gram, centre, covariances, grams, spaces
from loomspark.operators.metrics import auroc
from loomspark.operators.quick import fold_scores, quick_auroc, quick_score
from loomspark.plans import wider
from loomspark.sources.tables import check_input, labelled_csv, write_predictions
from loomspark.streaming.score import score_stream


def table(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, 6)) + y[:, None] * [2, 1, 0, 0, 0, 0]
    x[:, 5] = 1.0
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "row_id long, y int, features array<double>")


def test_logistic_is_at_its_optimum(spark):
    df = with_vector(table(spark), "features").select("row_id", "y", "x")
    m = logistic(df, "x", "y", 0.5)
    rows = weighted(df, "y").collect()
    x, y, w = np.array([r.x.toArray() for r in rows]), np.array([r.y for r in rows]), np.array([r.weight for r in rows])
    p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
    gradient = m.coefficients.toArray() + 0.5 * (x * (w * (p - y))[:, None]).sum(0)
    assert np.abs(gradient).max() < 1e-2 and abs((w * (p - y)).sum()) < 1e-2


def pooled(df, splits, parts=None):
    parts = df.select(F.lit(0).alias("partition_id"), "row_id", "y") if parts is None else parts
    return linear.pool(df, parts, "row_id", "y", "features", splits)


def test_batched_fits_equal_sparks_own(spark):
    df = table(spark, 240)
    parts = spark.range(3).select(F.col("id").cast("int").alias("partition_id")).crossJoin(df.select("row_id", "y")).filter("(row_id + partition_id) % 4 > 0")
    p = pooled(df, [(3, 7)], parts)
    linear.find_spaces(p, p.parts, [0])
    made = [linear.Problem(part, 0, f, c, ("plain", part, 0, linear.ALL), 5) for part in p.parts for f in (linear.ALL, 0, 2) for c in (0.01, 1.0, 1000.0)]
    got = linear.solve(p, made)
    folds = linear.stratified_folds(parts, "row_id", "y", 3, 7, ["partition_id"]).join(with_vector(df, "features").select("row_id", "x"), "row_id").persist()
    for q, b in list(zip(made, got, strict=True))[::5]:
        rows = folds.filter((F.col("partition_id") == q.part) & (F.col("fold") != q.left))
        m = logistic(rows, "x", "y", q.c)
        w, intercept = p.spaces[q.space].back(b[1:], float(b[0]))
        assert np.abs(m.coefficients.toArray() - w).max() < 1e-6 * (1 + np.abs(w).max()) and abs(m.intercept - intercept) < 1e-5 * (1 + abs(intercept))


def test_jobs_do_not_grow_with_partitions(spark):
    df = table(spark, 200)

    def jobs(n):
        parts = spark.range(n).select(F.col("id").cast("int").alias("partition_id")).crossJoin(df.select("row_id", "y")).filter("(row_id + partition_id) % 3 > 0")
        p = pooled(df, [(4, 42)], parts)
        spark.sparkContext.setJobGroup(f"fit-{n}", "")
        linear.fit_all(p, dict.fromkeys(range(n)), [0.01, 1.0])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{n}"))

    one, five = jobs(1), jobs(5)
    assert one > 0 and five <= one + 12  # a problem that needs a step or two more; each is a few jobs


def test_spaces_drop_constants_and_keep_variance(spark):
    df = table(spark)
    about = centre(df, "features")
    rows = grams(df, [], "features", about).collect()
    g = Gram.of([r["i"] for r in rows], [r["v"] for r in rows])
    plain, components = spaces(g, about)
    assert plain.width() == 5 and components.width(0.5) < 5 and components.width(0.9999) == 5
    x = np.array([r.features for r in df.collect()])
    z = components.apply(x)
    assert np.abs(np.cov(z.T, bias=True) - np.eye(5)).max() < 1e-9 and np.abs(z.mean(0)).max() < 1e-9
    w, b = components.back(np.arange(1.0, 4), 0.5)
    assert np.abs(x @ w + b - (z[:, :3] @ np.arange(1.0, 4) + 0.5)).max() < 1e-9


def test_sums_keep_digits_beside_large_means(spark):
    df = table(spark).withColumn("features", F.transform("features", lambda v: v + 1e8))
    x = np.array([r.features for r in df.collect()]) - 1e8
    got = {(r.i, r.j): r.cov for r in covariances(df.repartition(5), "features").collect()}
    want = np.cov(x.T, bias=True)
    assert max(abs(got[i, j] - want[i, j]) for i, j in got) < 1e-6 and len(got) == 21


def test_quick_scores_keep_all_rows_beside_large_means(spark):
    df = table(spark, 400)
    far = df.withColumn("features", F.transform("features", lambda v: v + 1e8))
    near = {r.fold: r.auroc for r in quick_auroc(df, "row_id", "y", "features").collect()}
    moved = {r.fold: r.auroc for r in quick_auroc(far, "row_id", "y", "features").collect()}
    assert len(moved) == 5 and fold_scores(far, "row_id", "y", "features").filter("score IS NOT NULL").count() == 400
    assert max(abs(near[f] - moved[f]) for f in near) < 1e-3
    with pytest.raises(Exception, match="no score"):
        quick_auroc(df.withColumn("features", F.when(F.col("row_id") == 3, F.array(*[F.lit(float("nan"))] * 6)).otherwise(F.col("features"))), "row_id", "y", "features").collect()
    same = df.withColumn("features", F.array(F.lit(1.0), F.lit(2.0)))
    assert {r.auroc for r in quick_auroc(same, "row_id", "y", "features").collect()} == {0.5}


def test_search_starts_with_the_default_and_ends_early():
    s, seen = Search({"share": Range(0.8, 0.99)}, {"share": 0.99}, 20), []
    while not s.over:
        x = s.ask()
        seen.append(x["share"])
        s.tell(x, 0.5)
    assert s.best == {"share": 0.99} and seen[0] == 0.99 and len(seen) <= 6 and all(0.8 <= x <= 0.99 for x in seen)


def test_slow_steady_gains_go_on():
    s = Search({"i": Range(0, 100)}, {"i": 0}, 40)
    while not s.over:
        s.tell(s.ask(), 0.5 + 0.004 * len(s.seen))
    assert len(s.seen) == 40  # each gains 0.004 over the one before, and 0.01 over the mark every third time


def test_guided_search_beats_random_trials():
    space = {"a": Range(0, 1), "b": Range(16, 1024, whole=True, log=True), "c": Range(10, 200, whole=True)}
    value = lambda x: -((x["a"] - 0.7) ** 2) - (np.log2(x["b"] / 64) / 6) ** 2 - ((x["c"] - 150) / 190) ** 2
    first = {"a": 0.2, "b": 500, "c": 20}

    def run(startup, seed):
        s = Search(space, first, 40, seed, gain=-1e9, startup=startup)
        while not s.over:
            x = s.ask()
            s.tell(x, value(x))
        assert all(16 <= x["b"] <= 1024 and isinstance(x["c"], int) for _, x in s.seen)
        return value(s.best)

    guided, blind = ([run(n, seed) for seed in range(20)] for n in (4, 1000))
    assert np.mean(guided) > np.mean(blind) and sum(g > b for g, b in zip(guided, blind, strict=True)) >= 13


def test_forest_space_has_log_spaced_leaves():
    space, first = forest_space(Options(trees=150, leaves=64, max_features=0.3), 50, 400)
    assert first == {"trees": 150, "max_features": 0.3, "leaves": 64}
    assert (space["trees"].low, space["trees"].high) == (50, 250) and space["leaves"].log and (space["leaves"].low, space["leaves"].high) == (32, 300)
    assert space["leaves"].at(0.5) == round((32 * 300) ** 0.5) and set(forest_space(Options(), 50, 400)[0]) == {"trees"}


def test_reduction_is_voted_on(spark, monkeypatch):
    asked = []

    def helps(p, parts, *_):
        asked.append(list(parts))
        return {part: part != 2 for part in parts}

    monkeypatch.setattr(base, "reduction_helps", helps)
    n = 700
    df = spark.createDataFrame([(i, int(i % 10 == 0), [float(i % 7), float(i % 3), 0.5]) for i in range(n)], "row_id long, y int, features array<double>")
    m = BinaryClassifier("logistic_regression", "default", max_samples=100, min_seen=1, num_trials=0).fit(df)
    assert len(m.models) > 5 and asked == [[0, 1, 2, 3]] and m.seconds > 0
    assert [x.recorded["pca"] for x in m.models] == [0.9, 0.9, None, *[0.9] * (len(m.models) - 3)]


def grown(p, **settings):
    d = forest_rows(p, dict.fromkeys(p.parts))
    trees = forest.grow(d, [forest.Grow(0, linear.ALL, linear.ALL, **settings)])[0]
    return d, trees


def test_trees_have_exactly_their_leaves_and_do_not_depend_on_layout(spark):
    df = table(spark, 300)
    before = None
    for n in (1, 3, 7):
        _, trees = grown(pooled(df.repartition(n), [(3, 1)]), trees=5, leaves=9)
        assert all((t[0] == -1).sum() == 9 for t in trees)
        now = [[v.tolist() for v in t] for t in trees]
        assert before is None or before == now
        before = now
    _, whole = grown(pooled(df, [(3, 1)]), trees=3)
    assert all(set(t[3][t[0] == -1]) <= {0.0, 1.0} for t in whole)  # without a bound leaves are pure
    _, shallow = grown(pooled(df, [(3, 1)]), trees=3, depth=2)
    assert all((t[0] == -1).sum() <= 4 for t in shallow)


def brute_tree(bins, y, leaves):
    """(feature, bin) of the splits of one tree over all rows, best first."""
    scale = np.array([len(y) / (2 * (y == c).sum()) for c in (0, 1)])
    mass = lambda rows: np.array([(y[rows] == c).sum() for c in (0, 1)]) * scale
    purity = lambda w: (w**2).sum() / w.sum()

    def best(rows):
        found = None
        for f in range(bins.shape[1]):
            for b in np.unique(bins[rows, f])[:-1]:
                left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                gain = purity(mass(left)) + purity(mass(right)) - purity(mass(rows))
                if found is None or gain > found[0] + 1e-12:
                    found = (gain, f, int(b), left, right)
        return found

    open_, out = [best(np.arange(len(y)))], []
    while open_ and len(out) < leaves - 1:
        at = max(range(len(open_)), key=lambda i: open_[i][0])
        gain, f, b, left, right = open_.pop(at)
        out.append((f, b))
        open_ += [found for side in (left, right) if 0 < y[side].sum() < len(side) and (found := best(side))]
    return sorted(out)


def test_a_tree_grows_best_first(spark):
    df = table(spark, 80, 5)
    p = pooled(df, [(3, 1)])
    d, trees = grown(p, trees=1, leaves=7, max_features=1.0, seed=forest.EVERY_ROW)
    rows = d.rows.collect()
    bins, y = np.array([list(r.bins) for r in rows]), np.array([r.y for r in rows])
    feature, cut, _, value = trees[0]
    assert sorted(zip(feature[feature >= 0].tolist(), cut[feature >= 0].tolist(), strict=True)) == brute_tree(bins, y, 7)
    assert auroc(forest.held_scores(d, [forest.Grow(0, linear.ALL, linear.ALL)], [trees]), "p1", "y").first()["auroc"] > 0.9


def test_ridge_takes_the_penalty_of_least_left_out_error(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 8)) * [1, 5, 1, 1, 0.1, 1, 1, 0] + 3
    y = x @ rng.normal(size=8) + rng.normal(size=40) * 3
    df = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(40)], "features array<double>, y double")
    found = [fit_ridge(df.repartition(n), "features", "y")[0] for n in (1, 3, 7)]
    for f in found[1:]:
        assert np.abs(f.weights - found[0].weights).max() < 1e-9 and f.recorded["penalty"] == found[0].recorded["penalty"]
    scale = x[:, :7].std(0)

    def fit(rows, penalty):
        z = x[rows][:, :7]
        u, t = (z - z.mean(0)) / scale, y[rows] - y[rows].mean()
        w = np.linalg.solve(u.T @ u + penalty * 40 * np.eye(7), u.T @ t) / scale
        return w, y[rows].mean() - z.mean(0) @ w

    for penalty, got in found[0].recorded["loo_mse"].items():
        errors = []
        for i in range(40):
            rows = np.arange(40) != i
            # the same scale as with all rows, and the same weight of the penalty
            w, b = fit(rows, float(penalty))
            errors.append((y[i] - x[i, :7] @ w - b) ** 2)
        assert abs(np.mean(errors) - got) < 1e-8 * np.mean(errors)
    w, b = fit(np.arange(40) >= 0, found[0].recorded["penalty"])
    assert np.abs(found[0].weights[:7] - w).max() < 1e-9 and abs(found[0].intercept - b) < 1e-8


def test_quick_score_picks_the_model_by_the_matrix(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    x = (rng.random((200, 5)) < 0.2 + 0.5 * y[:, None]).astype(float) * 3
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(200)], "row_id long, y int, features array<double>")
    want = [r.auroc for r in quick_auroc(df, "row_id", "y", "features", kind="bernoulli").collect()]
    assert abs(quick_score(df, "row_id", "y", "features") - sum(want) / 5) < 1e-12 > 0 and 0.8 < sum(want) / 5
    half = df.withColumn("features", F.transform("features", lambda v: v + 0.5))
    want = [r.auroc for r in quick_auroc(half, "row_id", "y", "features", kind="gaussian").collect()]
    assert abs(quick_score(half, "row_id", "y", "features") - sum(want) / 5) < 1e-12


def test_ensemble_round_trip_and_stream(spark, tmp_path):
    df = table(spark)
    m = BinaryClassifier("logistic_regression", "quick", pca=False).fit(df)
    got = m.predict(df)
    assert got.count() == 160 and auroc(got, "p1", "y").first()["auroc"] > 0.85
    m.save(spark, str(tmp_path / "m"))
    again = BinaryClassifier.load(spark, str(tmp_path / "m"))
    a, b = ({r.row_id: r.p1 for r in x.predict_proba(df).collect()} for x in (m, again))
    assert a == b
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = score_stream(again, source).select("row_id", "p1").writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.row_id: r.p1 for r in spark.table("scored").collect()} == a


def test_forests_are_calibrated_and_found_by_trials(spark):
    df = table(spark)
    o = Options(num_trials=2, num_splits=2, pca=False, trees=12, leaves=8, max_features=0.5, shape="random_forest")
    m = fit_forests(pooled(df, base.splits(o)), o)[0]
    x = np.array([r.features for r in df.collect()])
    p, raw = m.score(x), m.raw(x)
    assert ((0 <= p) & (p <= 1)).all() and m.slope > 0 and (np.diff(p[np.argsort(raw)]) >= 0).all()
    assert len(m.recorded["held_out"]) == 2 and min(m.recorded["held_out"]) > 0.7 and m.recorded["trials"] == 2 and m.recorded["c"] in base.C_GRID
    reduced = fit_forests(pooled(df, base.splits(o)), Options(num_trials=0, num_splits=1, pca=True, trees=5, max_depth=4, shape="random_forest"))[0]
    assert reduced.recorded["pca"] == 0.9 and reduced.recorded["c"] == 1.0 and reduced.space.basis.ndim == 2


def test_forest_round_trip(spark, tmp_path):
    df = table(spark)
    m = BinaryClassifier("random_forest", "quick", pca=False, trees=8).fit(df)
    m.save(spark, str(tmp_path / "m"))
    again = BinaryClassifier.load(spark, str(tmp_path / "m"))
    a, b = ({r.row_id: r.p1 for r in x.predict_proba(df).collect()} for x in (m, again))
    assert a == b and auroc(m.predict(df), "p1", "y").first()["auroc"] > 0.9
    m.save(spark, str(tmp_path / "m"))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(ValueError, match="something else"):
        m.save(spark, str(tmp_path / "other"))


def test_best_c_records_both_scores(spark):
    p = pooled(table(spark, 80), [(3, 42)])
    m = linear.fit_all(p, {0: None}, [0.01, 1.0])[0]
    assert m.recorded["c"] in (0.01, 1.0) and m.recorded["mean_score_all_c"] <= m.recorded["best_c_score"] + 1e-9


def test_reduction_and_share_are_found_together(spark):
    df = table(spark, 200)
    parts = spark.range(2).select(F.col("id").cast("int").alias("partition_id")).crossJoin(df.select("row_id", "y"))
    o = Options(num_trials=4, pca=None)
    p = pooled(df, base.splits(o), parts)
    found = base.decide(p, o)
    assert set(found) == {0, 1} and found[0] == found[1] and (found[0] is None or 0.8 <= found[0] <= 0.99)
    with pytest.raises(ValueError, match="both classes"):
        pooled(df, [(3, 1)], parts.filter("partition_id = 0 OR y = 1"))


def test_regressor(spark, tmp_path):
    df = table(spark).withColumn("y", F.element_at("features", 1) * 3 + F.element_at("features", 2))
    m = Regressor().fit(df)
    m.save(spark, str(tmp_path / "r"))
    got = Regressor.load(spark, str(tmp_path / "r")).predict(df).select(F.corr("y", "prediction").alias("r")).first()
    assert got.r > 0.99


def test_registry_errors():
    for make in (lambda: BinaryClassifier("transformer"), lambda: BinaryClassifier(mode="slow"), lambda: descriptor("pretrained"), lambda: descriptor("x")):
        with pytest.raises(ValueError):
            make()


def test_input_checks(spark):
    df = table(spark, 10)
    with pytest.raises(ValueError, match="not both"):
        check_input(df, path="x.parquet", label="y")
    with pytest.raises(ValueError, match="labels are 0 or 1"):
        check_input(df.withColumn("y", F.lit(2)), label="y")
    with pytest.raises(ValueError, match="unique"):
        check_input(df.union(df), label="y")
    with pytest.raises(ValueError, match="needed"):
        check_input(df, label=None)


def test_circular_does_not_depend_on_atom_order():
    assert circular("CCO") == circular("OCC") and circular("c1ccccc1O") == circular("Oc1ccccc1")
    assert circular("C(C)(C)N") == circular("NC(C)C") and circular("CCO") != circular("CCN")
    assert len(circular("C")) == 2048 and sum(circular("C" * 400, radius=0)) <= 3 * 255


def test_smiles_edges():
    for bad in ("", "C(", "C)", "C1CC", "X", "[", "[Q", "C11"):
        assert circular(bad) is None, bad
    assert len(molecule("[Na+].[Cl-]")[0]) == 2
    assert molecule("C%10CCCCC%10") is not None and molecule("[13CH3][C@@H](N)C(=O)[O-]") is not None


def test_descriptors_in_spark(spark):
    df = spark.createDataFrame([(0, "CCO"), (1, "C("), (2, None)], "row_id long, drug string")
    got = {r.row_id: r.features for r in descriptor("circular").transform(df, "drug").collect()}
    assert sum(got[0]) > 0 and got[1] is None and got[2] is None
    words = {r.row_id: r.features for r in descriptor("text").transform(df, "drug").collect()}
    assert sum(words[0]) == 1 and words[2] is None


def test_each_different_string_is_described_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(descriptors, "circular", lambda s, radius, width: seen.append(s) or circular(s, radius, width))
    strings = pa.array(["CCO", "C(", None, "CCN"] * 500)
    which, counts, known = descriptors._described(strings, 3, 2048)
    made = descriptors._lists(counts[which], known[which])
    assert sorted(seen) == ["C(", "CCN", "CCO"]
    assert made.to_pylist() == [circular("CCO"), None, None, circular("CCN")] * 500
    df = spark.range(1500, numPartitions=1).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("C"), F.repeat(F.lit("O"), (F.col("id") % 3).cast("int")))).alias("drug"))
    got = {r.id: r.features for r in descriptor("circular").transform(df, "drug").collect()}
    assert len(got) == 1500 and all(v == (None, circular("CO"), circular("COO"))[i % 3] for i, v in got.items())


def test_a_query_describes_different_molecules_only(spark, monkeypatch, tmp_path):
    """Parts by the thousand, four molecules: fingerprints are those of four rows; each part has its result."""
    given, plain = [], wider.Descriptor.transform
    monkeypatch.setattr(wider.Descriptor, "transform", lambda self, df, *names: given.append(df.count()) or plain(self, df, *names))
    spark.range(3000).select(F.col("id").alias("p_partkey"), (F.col("id") % 4).cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    got = wider.q_fingerprint_atoms(spark, str(tmp_path)).collect()
    assert given == [4, 4, 4]
    assert sorted(map(tuple, got)) == [(i, i % 4 + 2, i % 4 > 0) for i in range(3000)]


def test_integer_matrix(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0 if i < 10 else 0.5]) for i in range(12)], "row_id long, features array<double>")
    assert is_integer_matrix(df, "row_id", "features").first()["integral"]
    assert not is_integer_matrix(df, "row_id", "features", 11).first()["integral"]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Drug,Y\nC/C=C\\C,1.0\n"[O-][N+](=O)c1ccccc1",0\n')
    df = labelled_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.drug, r.y) for r in df.orderBy("row_id").collect()] == [("C/C=C\\C", 1), ("[O-][N+](=O)c1ccccc1", 0)]
    write_predictions(df.withColumn("pred", F.lit(0.25)), str(tmp_path / "p"))
    assert {r.pred for r in labelled_csv(spark, str(tmp_path / "p"), predicted=True).collect()} == {0.25}


def test_benchmark_scores(spark):
    p = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.2), ("b", 0, 0.4)], "task string, y int, pred double")
    tasks = spark.createDataFrame([("a", "roc-auc"), ("b", "pr-auc")], "task string, metric string")
    got = scores(p, tasks)
    assert {r.task: r.score for r in got.collect()} == {"a": 1.0, "b": 0.5}
    board = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.8, 0.1)], "task string, mean double, std double")
    rows = against_leaderboard(got, got.filter("task = 'a'"), board).collect()
    assert [(r.task, r.left_score, r.right_score) for r in rows] == [("a", 1.0, 1.0), ("b", 0.5, None)]
