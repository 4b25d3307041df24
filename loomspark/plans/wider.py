"""More queries of the catalogue: sources and sinks, whole covers and partitions, descriptors, portfolios, benchmark tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import scalars as S
from loomspark.models import benchmark as B
from loomspark.models import meta
from loomspark.models.descriptors import Descriptor
from loomspark.models.ensemble import BinaryClassifier, mean_score
from loomspark.models.linear import Linear
from loomspark.operators import features as X
from loomspark.operators import folds as K
from loomspark.operators import metrics as M
from loomspark.operators import sampling as P
from loomspark.plans.catalogue import SQL, _CAND, _DRAW2, _SEEN, EMB, ORD, _candidates, _draws, _seen, emb, orders, query
from loomspark.sources.rows import gather_rows, write_matrix
from loomspark.sources.stored import new_folder
from loomspark.sources.tables import labelled_csv, read_json, table, write_json, write_predictions


# ---- sources and sinks


@query("SELECT o_orderpriority || ', \"' || o_orderstatus || '\"' AS drug, CAST(o_orderstatus = 'F' AS DOUBLE) AS y, round(o_totalprice, 2) AS pred FROM orders")
def q_csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Predictions written as CSV, quotes and commas in their strings, and read back with the fixed schema."""
    path = new_folder(s, "csv")
    rows = table(s, d, "orders").select(F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"')).alias("drug"), (F.col("o_orderstatus") == "F").cast("double").alias("y"), F.round(F.col("o_totalprice").cast("double"), 2).alias("pred"))
    write_predictions(rows, path)
    return labelled_csv(s, path, predicted=True).select("drug", "y", "pred")


@query("SELECT o_orderstatus AS key, count(*) AS n FROM orders GROUP BY ALL")
def q_json_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Results written as one JSON object and read back."""
    path = new_folder(s, "json")
    write_json(s, {r["o_orderstatus"]: r["n"] for r in table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()}, path)  # a row a status
    return s.createDataFrame(sorted(read_json(s, path).items()), "key string, n long")


@query("WITH m AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, embedding FROM embeddings) SELECT i AS pos, row_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM range(200) AS r(i) JOIN m ON row_id = i * 7 % 97")
def q_matrix_gather(s: SparkSession, d: str) -> DataFrame:
    """Rows of a matrix of ``.npy`` parts by their numbers, some of them twice; only their ranges are read."""
    path = new_folder(s, "matrix")
    write_matrix(table(s, d, "embeddings"), path, key="vec_id", features="embedding", rows=10_000)
    wanted = s.range(200).select(F.col("id").alias("pos"), (F.col("id") * 7 % 97).alias("row_id"))
    return gather_rows(s, path, wanted).select("pos", "row_id", F.round(F.element_at("features", 1), 6).alias("first"), F.round(F.element_at("features", 64), 6).alias("last"))


@query("WITH e AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS y, 1 / (1 + exp(-4 * CAST(embedding[1] AS DOUBLE))) AS p FROM embeddings) SELECT vec_id, y, round(1 - p, 8) AS p0, round(p, 8) AS p1, CAST(p >= 0.5 AS INTEGER) AS prediction FROM e")
def q_append_predictions(s: SparkSession, d: str) -> DataFrame:
    """A table with its probabilities and predictions appended."""
    rows = emb(s, d).withColumn("p1", S.logistic(4 * F.element_at("embedding", 1).cast("double"))).drop("embedding")
    out = M.threshold(M.complement(rows))
    return out.select("vec_id", "y", F.round("p0", 8).alias("p0"), F.round("p1", 8).alias("p1"), "prediction")


# ---- draws, covers, partitions


@query(f"WITH {_SEEN} SELECT n.seen, y, count(*) AS n FROM n JOIN o USING (o_orderkey) GROUP BY ALL")
def q_seen_groups(s: SparkSession, d: str) -> DataFrame:
    return _seen(s, d).join(orders(s, d), "o_orderkey").groupBy("seen", "y").agg(F.count("*").alias("n"))


@query(f"WITH {_SEEN} SELECT CAST(k AS INTEGER) AS least, (SELECT min(seen) FROM n) >= 3 * k AS done FROM range(3) AS t(k)")
def q_cover_done(s: SparkSession, d: str) -> DataFrame:
    """Whether every row has been seen three times as often as asked for."""
    seen = _seen(s, d).agg(F.min("seen").alias("m"))
    return seen.crossJoin(F.broadcast(s.range(3))).select(F.col("id").cast("int").alias("least"), P.enough("m", F.col("id")).alias("done"))  # three rows


@query(f"WITH {_DRAW2}, t AS (SELECT o_orderkey, y, 0 AS d FROM d1 UNION ALL SELECT o_orderkey, y, 1 FROM d2) SELECT d AS draw, y, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM t GROUP BY ALL")
def q_draws(s: SparkSession, d: str) -> DataFrame:
    _, a, b = _draws(s, d)
    both = a.select("o_orderkey", "y", F.lit(0).alias("draw")).unionByName(b.select("o_orderkey", "y", F.lit(1).alias("draw")))
    return both.groupBy("draw", "y").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


_COVER = """g AS (SELECT 0 AS i, CAST([] AS INTEGER[]) AS acc
  UNION ALL
  SELECT i + 1, list_append(acc, arg_max(p, c * 10000 + {tie})) FROM (
    SELECT i, acc, k.partition_id AS p, count(*) AS c FROM g JOIN k ON NOT list_contains(acc, k.partition_id)
    WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.{key} = k.{key} AND list_contains(g.acc, x.partition_id)) GROUP BY i, acc, k.partition_id)
  WHERE i < 100 GROUP BY i, acc)"""


@query(f"WITH RECURSIVE {_CAND}, {_COVER.format(key='vec_id', tie='-p')}, b AS (SELECT acc FROM g ORDER BY i DESC LIMIT 1) SELECT CAST(unnest(range(len(acc))) AS INTEGER) AS pick, unnest(acc) AS partition_id FROM b")
def q_greedy_cover(s: SparkSession, d: str) -> DataFrame:
    """The whole greedy cover, pick by pick; ties go to the smaller number."""
    chosen = P.greedy_cover(_candidates(s, d), "vec_id", lambda tied: {p: (p,) for p in tied}, 1)
    return s.createDataFrame(list(enumerate(chosen)), "pick int, partition_id int")


@query(f"""
WITH RECURSIVE {ORD}, q AS (SELECT count(*) AS n, sum(y) AS p FROM o), z AS (SELECT *, round_even(5000 * (p / n), 0) AS s1 FROM q),
w AS (SELECT *, 5000 - s1 AS s0, greatest(ceil(p * 3 / s1), ceil((n - p) * 3 / (5000 - s1))) AS rounds FROM z),
c AS (SELECT y, CAST(count(*) AS BIGINT) AS n, CAST(max(CASE WHEN y = 1 THEN s1 ELSE s0 END) AS BIGINT) AS size, CAST(max(rounds) AS BIGINT) AS rounds FROM o, w GROUP BY y),
r AS (SELECT o.y, o_orderkey, u.i AS c, c.n, c.size, c.rounds, row_number() OVER (PARTITION BY o.y, u.i ORDER BY md5(concat(o_orderkey, '|42:', o.y, ':', u.i)), o_orderkey) - 1 AS rn
      FROM o JOIN c USING (y), LATERAL (SELECT unnest(range(CAST(ceil(c.rounds * c.size / c.n) AS BIGINT))) AS i) u WHERE (SELECT n FROM q) > 5000),
k AS (SELECT DISTINCT CAST((rn + c * n) // size AS INTEGER) AS partition_id, o_orderkey, y FROM r WHERE (rn + c * n) // size < rounds),
{_COVER.format(key="o_orderkey", tie="p")},
b AS (SELECT unnest(acc) AS partition_id FROM (SELECT acc FROM g ORDER BY i DESC LIMIT 1)),
m AS (SELECT partition_id, CAST(row_number() OVER (ORDER BY md5(concat(partition_id, '|42'))) - 1 AS INTEGER) AS new FROM b)
SELECT new AS partition_id, o_orderkey, y FROM k JOIN m USING (partition_id)
UNION ALL SELECT 0, o_orderkey, y FROM o WHERE (SELECT n FROM q) <= 5000
""")
def q_partitions(s: SparkSession, d: str) -> DataFrame:
    return P.partitions(orders(s, d), "o_orderkey", "y", max_samples=5000)


# ---- metrics and tables of results


@query("SELECT vec_id, round((CAST('0x' || substr(md5(concat(vec_id, '|42')), 1, 8) AS BIGINT) / 4294967296 - 0.5) * 0.4, 10) AS jitter FROM embeddings")
def q_jitter(s: SparkSession, d: str) -> DataFrame:
    return M.jittered(table(s, d, "embeddings").select("vec_id"), "vec_id").select("vec_id", F.round("jitter", 10).alias("jitter"))


_LANGS = """e AS (SELECT lang AS task, toxic AS y, CAST(n_chars AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id)),
a AS (SELECT task, s, sum(y) AS tp, sum(1 - y) AS fp FROM e GROUP BY ALL), w AS (SELECT *, coalesce(sum(fp) OVER (PARTITION BY task ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a),
auc AS (SELECT task, sum(tp * (below + fp / 2)) / (sum(tp) * sum(fp)) AS score FROM w GROUP BY task HAVING sum(tp) * sum(fp) > 0),
h AS (SELECT task, s, sum(tp) OVER o AS ctp, sum(tp + fp) OVER o AS cn, tp FROM a WINDOW o AS (PARTITION BY task ORDER BY s DESC)), ap AS (SELECT task, sum(tp * (ctp / cn)) / sum(tp) AS score FROM h GROUP BY task HAVING sum(tp) > 0)"""


def _by_language(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "labels").select("doc_id", F.col("toxic").alias("y"))
    return table(s, d, "documents").select("doc_id", F.col("lang").alias("task"), F.col("n_chars").cast("double").alias("pred")).join(labels, "doc_id").drop("doc_id")


@query(f"WITH {_LANGS} SELECT task, 'roc-auc' AS metric, round(score, 8) AS score FROM auc WHERE task < 'es' UNION ALL SELECT task, 'pr-auc', round(score, 8) FROM ap WHERE task >= 'es'")
def q_benchmark_scores(s: SparkSession, d: str) -> DataFrame:
    """Each task by its own metric, all in one job; languages are the tasks."""
    rows = _by_language(s, d)
    tasks = rows.filter("task IS NOT NULL").select("task").distinct().withColumn("metric", F.when(F.col("task") < "es", "roc-auc").otherwise("pr-auc"))
    return B.scores(rows, tasks).filter("score IS NOT NULL").select("task", "metric", F.round("score", 8).alias("score"))


@query(f"""
WITH {_LANGS}, l AS (SELECT * FROM auc WHERE task <> 'en'), r AS (SELECT * FROM ap WHERE task <> 'fr'), c AS (SELECT task, avg(s) AS mean, stddev_samp(s) AS std FROM e GROUP BY task)
SELECT task, round(l.score, 8) AS left_score, round(r.score, 8) AS right_score, round(mean, 6) AS mean, round(std, 6) AS std FROM l FULL JOIN r USING (task) JOIN c USING (task)
""")
def q_task_table_outer(s: SparkSession, d: str) -> DataFrame:
    """Two models' scores of the tasks beside the board's, each model with one task missing."""
    rows = _by_language(s, d).filter("task IS NOT NULL")
    names = rows.select("task").distinct()
    of = lambda metric, gone: B.scores(rows, names.filter(F.col("task") != gone).withColumn("metric", F.lit(metric))).filter("score IS NOT NULL")
    board = rows.groupBy("task").agg(F.avg("pred").alias("mean"), F.stddev_samp("pred").alias("std"))
    made = B.against_leaderboard(of("roc-auc", "en"), of("pr-auc", "fr"), board)
    return made.select("task", *[F.round(c, 8).alias(c) for c in ("left_score", "right_score")], *[F.round(c, 6).alias(c) for c in ("mean", "std")])


@query(f"WITH {_LANGS} SELECT task, round(score, 8) AS score FROM auc ORDER BY score DESC, task LIMIT 1")
def q_best_task(s: SparkSession, d: str) -> DataFrame:
    rows = M.auroc(_by_language(s, d).filter("task IS NOT NULL"), "pred", "y", ["task"]).filter("auroc IS NOT NULL")
    return M.best(rows, "auroc", "task").select("task", F.round("auroc", 8).alias("score"))


@query("WITH n AS (SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events) SELECT source, CAST(10000 + 22500 * i AS BIGINT) AS size FROM n, range(5) AS t(i) WHERE 10000 + 22500 * i <= n")
def q_step_grid(s: SparkSession, d: str) -> DataFrame:
    """The sample sizes that a search over a table looks at."""
    sizes = [(t, x) for t in ("orders", "lineitem", "events") for n in [table(s, d, t).count()] for x in S.step_grid() if x <= n]
    return s.createDataFrame(sizes, "source string, size long")


# ---- descriptors, models


@query("""
WITH w AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 64 AS INTEGER) AS j FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents)),
c AS (SELECT doc_id, j, least(count(*), 255) AS v FROM w GROUP BY ALL), g AS (SELECT doc_id, unnest(range(64)) AS j FROM documents)
SELECT doc_id, string_agg(coalesce(v, 0), ',' ORDER BY j) AS counts FROM g LEFT JOIN c USING (doc_id, j) GROUP BY doc_id
""")
def q_dense_fingerprint(s: SparkSession, d: str) -> DataFrame:
    """Counts of hashed words in all 64 slots, the empty ones too."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    slot = lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % 64).cast("int")
    made = X.dense_counts(table(s, d, "documents"), words, slot, "doc_id", 64)
    return made.select("doc_id", F.array_join("counts", ",").alias("counts"))


@query("SELECT p_partkey, CAST(least(p_size % 40 + 2, 255) AS BIGINT) AS atoms, CAST(p_size % 40 + 2 > 2 AS BOOLEAN) AS longer FROM part")
def q_fingerprint_atoms(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints of alcohols whose chains have p_size % 40 + 1 carbons: at radius 0 one count an atom, and chains of the
    same atoms written the other way round are the same. A molecule is described once, however many parts are made of it."""
    chain = F.repeat(F.lit("C"), (F.col("p_size") % 40 + 1).cast("int"))
    rows = table(s, d, "part").select("p_partkey", F.concat(chain, F.lit("O")).alias("a"), F.concat(F.lit("O"), chain).alias("b"))
    each = rows.select("a", "b").distinct().repartition(s.sparkContext.defaultParallelism)  # few bytes, long work
    total = F.aggregate("fa", F.lit(0).cast("long"), lambda x, v: x + v)
    at = Descriptor("circular", radius=0).transform(each, "a", "fa").select("a", "b", total.alias("atoms"))  # the counts go no further
    both = Descriptor("circular").transform(Descriptor("circular").transform(at, "a", "ra"), "b", "rb")
    same = both.filter("ra = rb").select("a", "atoms", (F.col("atoms") > 2).alias("longer"))
    return rows.join(same, "a").select("p_partkey", "atoms", "longer")


@query(f"WITH {EMB.format(5)} SELECT count(*) AS n_rows, max(len(embedding)) AS n_features, round(avg(y), 8) AS positive_share, round(sum(len(list_filter(embedding, lambda x: x = 0))) / sum(len(embedding)), 8) AS zero_share, round(avg(list_stddev_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 6) AS mean_spread FROM e")
def q_meta_features(s: SparkSession, d: str) -> DataFrame:
    m = meta.meta_features(emb(s, d), "y", "embedding")
    return m.select("n_rows", F.col("n_features").cast("long").alias("n_features"), F.round("positive_share", 8).alias("positive_share"), F.round("zero_share", 8).alias("zero_share"), F.round("mean_spread", 6).alias("mean_spread"))


@query("""
WITH w AS (SELECT CAST(m AS INTEGER) AS m, j, ((j * 7 + m) % 5 - 2) / 2 AS weight FROM range(3) AS a(m), range(64) AS b(j)),
l AS (SELECT vec_id, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
p AS (SELECT vec_id, m, sum(weight * v) AS z FROM l JOIN w USING (j) GROUP BY vec_id, m)
SELECT vec_id, round(avg(1 / (1 + exp(-(z + 0.25 * m)))), 8) AS p1 FROM p GROUP BY vec_id
""")
def q_linear_ensemble(s: SparkSession, d: str) -> DataFrame:
    """The mean probability of three logistic regressions with given weights, in one scan."""
    return table(s, d, "embeddings").select("vec_id", F.round(mean_score(_linear_models(), "embedding"), 8).alias("p1"))


def _linear_models() -> list[Linear]:
    return [Linear(np.array([((j * 7 + m) % 5 - 2) / 2 for j in range(64)]), 0.25 * m, {}) for m in range(3)]


@query(f"WITH {EMB.format(8)}, n AS (SELECT count(*) AS n FROM e WHERE y IS NOT NULL) SELECT stage, CAST(done AS INTEGER) AS done, CAST(total AS INTEGER) AS total FROM n, (VALUES ('partitions', 0, 1), ('partitions', 1, 1), ('models', 0, 1), ('models', 1, 1)) AS t(stage, done, total) WHERE n > 0")
def q_fit_progress(s: SparkSession, d: str) -> DataFrame:
    """The stages that a fit of one partition reports."""
    rows = emb(s, d, 8)
    model = BinaryClassifier("logistic_regression", "quick", key="vec_id", features="embedding", pca=False, force=False, max_positive_proportion=0.9, max_samples=10**9).fit(rows)
    return model.progress.frame().select("stage", "done", "total")


@query(f"""
WITH {EMB.format(5)}, k AS (SELECT CAST(p AS INTEGER) AS partition_id, vec_id, y FROM e, range(3) AS r(p) WHERE (vec_id + p) % 4 > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY partition_id, y ORDER BY md5(concat(vec_id, '|7')), vec_id) - 1 AS rn, round_even(count(*) OVER (PARTITION BY partition_id, y) * 0.25::DOUBLE, 0) AS size FROM k)
SELECT partition_id, vec_id, y, rn < size AS held_out FROM r
""")
def q_partition_holdout(s: SparkSession, d: str) -> DataFrame:
    """A hold-out part of each label of each partition, all partitions at once."""
    p = F.col("id").cast("int")
    rows = emb(s, d).select("vec_id", "y").crossJoin(F.broadcast(s.range(3)))  # three rows
    parts = rows.filter((F.col("vec_id") + F.col("id")) % 4 > 0).select(p.alias("partition_id"), "vec_id", "y")
    return K.holdout(parts, "vec_id", "y", seed=7, groups=["partition_id"]).select("partition_id", "vec_id", "y", "held_out")


@query(SQL["q_linear_ensemble"])
def q_saved_ensemble(s: SparkSession, d: str) -> DataFrame:
    """The ensemble of ``q_linear_ensemble`` saved, loaded, and asked for its probabilities."""
    path = new_folder(s, "ensemble")
    made = BinaryClassifier("logistic_regression", "quick", key="vec_id", features="embedding")
    made.models = _linear_models()
    made.save(s, path)
    scored = BinaryClassifier.load(s, path).predict_proba(table(s, d, "embeddings").select("vec_id", "embedding"))
    return scored.select("vec_id", F.round("p1", 8).alias("p1"))


@query("SELECT lang, round(sum(strlen(text)) / 1073741824, 12) AS gigabytes, count(*) AS n FROM documents GROUP BY ALL")
def q_gigabytes(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    return docs.select("lang", F.round(S.gigabytes(F.col("bytes")), 12).alias("gigabytes"), "n")
