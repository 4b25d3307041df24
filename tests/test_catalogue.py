import duckdb
import pytest

from loomspark.plans import wider
from loomspark.plans.catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["q_quota_table", "q_gnb_cv_auroc", "q_bnb_cv_auroc", "q_second_draw", "q_jaccard_pairs", "q_roc_points", "q_chunks", "q_candidates", "q_candidate_scores", "q_majority_vote", "q_count_fingerprint", "q_task_table_outer", "q_min_rounds", "q_min_seen", "q_covariance", "q_pca_spectrum", "q_scaled_length", "q_logreg_optimum", "q_best_split", "q_platt", "q_ridge_loo", "q_moments", "q_standardize"])
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.sql(SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, want.select(*order).fetchall()))


@pytest.mark.parametrize("name", [n for n in dir(wider) if n.startswith("q_")])
def test_wider_catalogue_equals_sql(spark, duck, name):
    test_equals_sql(spark, duck, name)


def test_covariance_takes_the_whole_width(spark, duck):
    got = {(r.i, r.j): r.cov for r in QUERIES["q_covariance_full"](spark, FOLDER).collect()}
    want = {(i, j): cov for i, j, cov in duck.sql(SQL["q_covariance_full"]).select("i", "j", "cov").fetchall()}
    assert len(want) == 64 * 65 // 2 and got == want


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["q_logreg_scores", "q_forest_scores", "q_platt", "q_ensemble_scores"])
def test_fitted_scores(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert len({r.vec_id for r in rows}) == len(rows) == spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    assert all(0 <= r.p1 <= 1 for r in rows) and len({r.p1 for r in rows}) > 10
