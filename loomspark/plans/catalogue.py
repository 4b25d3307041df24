"""Queries over the standard tables and the SQL that they equal.

Row keys and labels: embeddings by label rules, orders by status F, events by type error, documents by their toxic label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import scalars as S
from loomspark.models import forest as T
from loomspark.models import linear as L
from loomspark.models.base import forest_rows
from loomspark.models.ensemble import BinaryClassifier, mean_score
from loomspark.models.ridge import fit_ridge
from loomspark.operators import features as X
from loomspark.operators import folds as K
from loomspark.operators import gram as G
from loomspark.operators import metrics as M
from loomspark.operators import quick as Q
from loomspark.operators import sampling as P
from loomspark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def emb(s: SparkSession, d: str, below: int = 5, least: int = 0) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", ((F.col("label") < below) & (F.col("label") >= least)).cast("int").alias("y"), "embedding")


def orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))


EMB = "e AS (SELECT vec_id, CAST(label < {} AS INTEGER) AS y, embedding FROM embeddings)"
ORD = "o AS (SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders)"
FOLDS = "f AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat(vec_id, '|42')), vec_id) - 1) % 5 AS INTEGER) AS fold FROM e)"
CELLS = "c AS (SELECT vec_id, fold, y, CAST(unnest(range(len(embedding))) AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM f)"


# ---- counts and quotas


@query("""
SELECT 'orders' AS source, CAST(o_orderstatus = 'F' AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT 'events', CAST(event_type = 'error' AS INTEGER), count(*) FROM events GROUP BY ALL
UNION ALL SELECT 'embeddings', CAST(label < 5 AS INTEGER), count(*) FROM embeddings GROUP BY ALL
UNION ALL SELECT 'labels', toxic, count(*) FROM labels GROUP BY ALL
""")
def q_class_balance(s: SparkSession, d: str) -> DataFrame:
    parts = [
        orders(s, d).select(F.lit("orders").alias("source"), "y"),
        table(s, d, "events").select(F.lit("events").alias("source"), (F.col("event_type") == "error").cast("int").alias("y")),
        emb(s, d).select(F.lit("embeddings").alias("source"), "y"),
        table(s, d, "labels").select(F.lit("labels").alias("source"), F.col("toxic").alias("y")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("source", "y").agg(F.count("*").alias("n"))


#: least share, largest share, most samples, fewest positives, force
_GRID = [(a, b, c, m, f) for a in (0.01, 0.2) for b in (0.3, 0.5, 0.9) for c in (100, 1000, 5000, 10000, 100000) for m in (10, 700) for f in (0, 1)]


@query(f"""
WITH g AS (SELECT * FROM (VALUES {", ".join(map(str, _GRID))}) AS t(lo, hi, s, mp, force)),
b AS (SELECT 'orders' AS source, sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS p, count(*) AS n FROM orders
      UNION ALL SELECT 'labels', sum(toxic), count(*) FROM labels
      UNION ALL SELECT 'embeddings', sum(CAST(label < 8 AS INTEGER)), count(*) FROM embeddings),
i AS (SELECT source, CAST(p AS DOUBLE) AS p, CAST(n AS DOUBLE) AS n, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(s AS DOUBLE) AS s, CAST(mp AS DOUBLE) AS mp, force FROM b, g WHERE p >= mp AND n >= 30),
j AS (SELECT *, p / n AS share, least(round_even(round_even((n - p) / (1 - hi), 0) * hi, 0), p) AS forced, least(greatest(round_even(s * lo, 0), mp), p) AS rare,
      s - round_even(s * hi, 0) > n - p AS short, round_even((n - p) * hi / (1 - hi), 0) AS capped,
      CASE WHEN round_even(s * p / n, 0) < mp THEN greatest(round_even(s * lo, 0), mp) ELSE round_even(s * (p / n), 0) END AS middle FROM i)
SELECT source, lo, hi, CAST(s AS BIGINT) AS s, CAST(mp AS BIGINT) AS mp, CAST(force AS INTEGER) AS force,
  CAST(CASE WHEN n <= s THEN CASE WHEN share < lo THEN p WHEN share > hi AND force = 1 THEN forced ELSE p END
       WHEN share < lo THEN CASE WHEN rare / s < lo THEN rare WHEN p / s < hi THEN p ELSE rare END
       WHEN share > hi THEN CASE WHEN short THEN capped ELSE round_even(s * hi, 0) END
       WHEN p / s < hi THEN p ELSE middle END AS BIGINT) AS n_pos,
  CAST(CASE WHEN n <= s THEN CASE WHEN share < lo THEN round_even(p / lo, 0) WHEN share > hi AND force = 1 THEN round_even(forced / hi, 0) ELSE n END
       WHEN share < lo AND rare / s < lo THEN round_even(rare / lo, 0)
       WHEN share > hi AND share >= lo AND short THEN capped + n - p ELSE s END AS BIGINT) AS n_tot
FROM j
""")
def q_quota_table(s: SparkSession, d: str) -> DataFrame:
    grid = s.createDataFrame([(float(a), float(b), c, m, f) for a, b, c, m, f in _GRID], "lo double, hi double, s long, mp long, force int")
    balance = lambda df, name, y: df.agg(F.lit(name).alias("source"), F.sum(y).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    counts = balance(orders(s, d), "orders", F.col("y")).unionByName(balance(table(s, d, "labels"), "labels", F.col("toxic"))).unionByName(balance(emb(s, d, 8), "embeddings", F.col("y")))
    rows = counts.crossJoin(F.broadcast(grid)).filter("p >= mp AND n >= 30")  # three rows by the grid
    n_pos, n_tot = S.quota_columns(F.col("p"), F.col("n"), F.col("lo"), F.col("hi"), F.col("s").cast("double"), F.col("mp").cast("double"), F.col("force") == 1)
    return rows.select("source", "lo", "hi", "s", "mp", "force", n_pos.alias("n_pos"), n_tot.alias("n_tot"))


_SIZES = (100, 1000, 5000, 10000)
_SIZE_ROWS = f"(SELECT unnest({list(_SIZES)}) AS m)"


def _by_size(s: SparkSession, d: str, columns: str, row: Callable[[int, int], tuple]) -> DataFrame:
    n = table(s, d, "orders").count()
    return s.createDataFrame([(n, m, *row(n, m)) for m in _SIZES], f"n long, m long, {columns}")


@query(f"SELECT CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(CASE WHEN m >= n THEN 1 ELSE ceil(ln(1 - 0.99::DOUBLE) / ln(1 - m / n::DOUBLE)) END AS BIGINT) AS rounds FROM (SELECT count(*) AS n FROM orders), {_SIZE_ROWS}")
def q_min_rounds(s: SparkSession, d: str) -> DataFrame:
    return _by_size(s, d, "rounds long", lambda n, m: (S.min_rounds(n, m),))


@query(f"SELECT n, m, p AS partitions, least(greatest(p, 1), 3) AS seen FROM (SELECT CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, CAST(CASE WHEN m >= n THEN 1 ELSE greatest(1, ceil(ln(1e-6 / n) / ln(1 - m / n::DOUBLE))) END AS BIGINT) AS p FROM (SELECT count(*) AS n FROM orders), {_SIZE_ROWS})")
def q_min_seen(s: SparkSession, d: str) -> DataFrame:
    return _by_size(s, d, "partitions long, seen long", lambda n, m: (S.min_partitions(n, m), S.min_seen(n, m)))


@query("SELECT 'partition_' || lpad(CAST(label AS VARCHAR), 3, '0') AS name, count(*) AS n FROM embeddings GROUP BY ALL")
def q_partition_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").groupBy(S.partition_name(F.col("label")).alias("name")).agg(F.count("*").alias("n"))


# ---- folds


@query(f"WITH {EMB.format(5)}, {FOLDS} SELECT vec_id, y, fold FROM f")
def q_stratified_folds(s: SparkSession, d: str) -> DataFrame:
    return K.stratified_folds(emb(s, d).drop("embedding"), "vec_id", "y").select("vec_id", "y", "fold")


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY md5(concat(event_id, '|42')), event_id) - 1) % 5 AS INTEGER) AS fold FROM events")
def q_kfold(s: SparkSession, d: str) -> DataFrame:
    return K.folds(table(s, d, "events").select("event_id"), "event_id")


_EVT = "e AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y FROM events)"


@query(f"WITH {_EVT} SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(concat(event_id, '|42')), event_id) - 1 < round_even(count(*) OVER (PARTITION BY y) * 0.25::DOUBLE, 0) AS held_out FROM e")
def q_holdout(s: SparkSession, d: str) -> DataFrame:
    return K.holdout(table(s, d, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("y")), "event_id", "y")


@query(f"WITH {EMB.format(8)}, {FOLDS} SELECT fold, y, count(*) AS n FROM f GROUP BY ALL")
def q_fold_balance(s: SparkSession, d: str) -> DataFrame:
    return K.stratified_folds(emb(s, d, 8).drop("embedding"), "vec_id", "y").groupBy("fold", "y").agg(F.count("*").alias("n"))


@query(f"""
WITH {EMB.format(8)}, f AS (SELECT vec_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(concat(vec_id, '|42')), vec_id) - 1) % 4 AS INTEGER) AS fold FROM e),
s AS (SELECT CAST(g.i AS INTEGER) AS fold, CASE WHEN f.fold = g.i THEN 'test' ELSE 'train' END AS part, vec_id, y FROM f, range(4) AS g(i)),
t AS (SELECT *, count(*) OVER w AS n, sum(1 - y) OVER w AS neg, row_number() OVER (PARTITION BY fold, y ORDER BY md5(concat(vec_id, '|42:more')), vec_id) - 1 AS rn FROM s WHERE part = 'train' WINDOW w AS (PARTITION BY fold)),
m AS (SELECT *, CAST(CASE WHEN (n - neg) / n > 0.5 THEN greatest(floor(n * 0.5 - neg), 0) ELSE 0 END AS BIGINT) AS more FROM t)
SELECT fold, part, vec_id, y, CAST(CASE WHEN y = 0 AND more > 0 THEN 1 + more // neg + CAST(rn < more % neg AS INTEGER) ELSE 1 END AS BIGINT) AS mult FROM m
UNION ALL SELECT fold, part, vec_id, y, 1 FROM s WHERE part = 'test'
""")
def q_fold_oversample(s: SparkSession, d: str) -> DataFrame:
    return K.oversampled(emb(s, d, 8).drop("embedding"), "vec_id", "y")


# ---- draws, coverage, candidates

_DRAW1 = f"""{ORD}, a AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat(o_orderkey, '|42:0')), o_orderkey) - 1 AS rn FROM o),
d1 AS (SELECT o_orderkey, y FROM a WHERE rn < CASE WHEN y = 1 THEN 200 ELSE 300 END)"""
_DRAW2 = f"""{_DRAW1}, b AS (SELECT o.o_orderkey, o.y, CASE WHEN d1.y IS NULL THEN 0 ELSE 1 END AS seen FROM o LEFT JOIN d1 ON o.o_orderkey = d1.o_orderkey),
c AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY seen, md5(concat(o_orderkey, '|42:1')), o_orderkey) - 1 AS rn FROM b),
d2 AS (SELECT o_orderkey, y, seen FROM c WHERE rn < CASE WHEN y = 1 THEN 200 ELSE 300 END)"""
_WANT = {1: 200, 0: 300}


def _draws(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = orders(s, d)
    first = P.draw(o.withColumn("seen", F.lit(0)), "o_orderkey", "y", _WANT, 0)
    counts = o.join(P.seen_counts(first, o, "o_orderkey"), "o_orderkey")
    return o, first, P.draw(counts, "o_orderkey", "y", _WANT, 1)


@query(f"WITH {_DRAW1} SELECT o_orderkey, y FROM d1")
def q_first_draw(s: SparkSession, d: str) -> DataFrame:
    return _draws(s, d)[1].select("o_orderkey", "y")


@query(f"WITH {_DRAW2} SELECT o_orderkey, y, CAST(seen AS BIGINT) AS seen FROM d2")
def q_second_draw(s: SparkSession, d: str) -> DataFrame:
    return _draws(s, d)[2].select("o_orderkey", "y", F.col("seen").cast("long"))


_SEEN = f"{_DRAW2}, u AS (SELECT o_orderkey FROM d1 UNION ALL SELECT o_orderkey FROM d2), n AS (SELECT o.o_orderkey, count(u.o_orderkey) AS seen FROM o LEFT JOIN u ON o.o_orderkey = u.o_orderkey GROUP BY ALL)"


def _seen(s: SparkSession, d: str) -> DataFrame:
    o, a, b = _draws(s, d)
    return P.seen_counts(a.select("o_orderkey").unionByName(b.select("o_orderkey")), o, "o_orderkey")


@query(f"WITH {_SEEN} SELECT seen, count(*) AS n FROM n GROUP BY ALL")
def q_seen_counts(s: SparkSession, d: str) -> DataFrame:
    return _seen(s, d).groupBy("seen").agg(F.count("*").alias("n"))


@query(f"WITH {_SEEN} SELECT o_orderkey, seen FROM n WHERE seen < 1")
def q_under_seen(s: SparkSession, d: str) -> DataFrame:
    return P.under_seen(_seen(s, d), 1)


_CAND = "k AS (SELECT CAST(p AS INTEGER) AS partition_id, vec_id FROM embeddings, range(8) AS r(p) WHERE substr(md5(concat(vec_id, '|', CASE WHEN p = 7 THEN 0 WHEN p = 6 AND vec_id > 20 THEN 1 ELSE p END)), 1, 1) < '8')"


def _candidates(s: SparkSession, d: str) -> DataFrame:
    p = F.col("id").cast("int")
    seed = F.when(p == 7, 0).when((p == 6) & (F.col("vec_id") > 20), 1).otherwise(p)
    rows = table(s, d, "embeddings").select("vec_id").crossJoin(F.broadcast(s.range(8)))  # eight rows
    return rows.filter(F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("|"), seed.cast("string"))), 1, 1) < "8").select(p.alias("partition_id"), "vec_id")


@query(f"""WITH {_CAND}, w AS (SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM k WHERE partition_id = 2)),
c AS (SELECT k.partition_id, count(w.vec_id) AS covered FROM k LEFT JOIN w ON k.vec_id = w.vec_id WHERE k.partition_id <> 2 GROUP BY ALL)
SELECT partition_id, covered FROM c ORDER BY covered DESC, partition_id LIMIT 1""")
def q_cover_pick(s: SparkSession, d: str) -> DataFrame:
    k = _candidates(s, d)
    wanting = table(s, d, "embeddings").select("vec_id").join(k.filter("partition_id = 2"), "vec_id", "left_anti")
    rest = k.filter("partition_id <> 2")
    order = rest.select("partition_id", F.col("partition_id").alias("rank")).distinct()
    return P.pick(rest, wanting, "vec_id", order).select("partition_id", "covered")


_JAC = f"{_CAND}, j AS (SELECT a.partition_id AS a, b.partition_id AS b, count(*) AS i FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.partition_id < b.partition_id GROUP BY ALL), z AS (SELECT partition_id, count(*) AS n FROM k GROUP BY ALL), v AS (SELECT a, b, i / (x.n + y.n - i) AS jaccard FROM j JOIN z x ON a = x.partition_id JOIN z y ON b = y.partition_id)"


@query(f"WITH {_JAC} SELECT a, b, round(jaccard, 6) AS jaccard FROM v")
def q_jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
    return P.jaccard_pairs(_candidates(s, d), "vec_id").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {_JAC} SELECT DISTINCT b AS partition_id FROM v WHERE jaccard >= 0.9")
def q_redundant(s: SparkSession, d: str) -> DataFrame:
    return P.redundant(P.jaccard_pairs(_candidates(s, d), "vec_id"), 0.9)


@query(f"WITH {_CAND}, l AS (SELECT partition_id, list(vec_id ORDER BY vec_id) AS v FROM k GROUP BY ALL) SELECT min(partition_id) AS partition_id FROM l GROUP BY v")
def q_distinct_candidates(s: SparkSession, d: str) -> DataFrame:
    return P.distinct_partitions(_candidates(s, d), "vec_id")


@query(f"WITH {_CAND}, t AS (SELECT k.*, CAST(e.label < 5 AS INTEGER) AS y FROM k JOIN embeddings e USING (vec_id)), g AS (SELECT partition_id, sum(y) AS p, sum(1 - y) AS n FROM t GROUP BY ALL) SELECT count(*) AS n_partitions, round(avg(p), 6) AS avg_positives, round(avg(n), 6) AS avg_negatives FROM g")
def q_partition_report(s: SparkSession, d: str) -> DataFrame:
    r = P.report(_candidates(s, d).join(emb(s, d).drop("embedding"), "vec_id"), "y")
    return r.select("n_partitions", F.round("avg_positives", 6).alias("avg_positives"), F.round("avg_negatives", 6).alias("avg_negatives"))


_DEALT = """k AS (SELECT DISTINCT CAST((rn + c * n) // size AS INTEGER) AS partition_id, o_orderkey, y FROM (
  SELECT o_orderkey, y, c, row_number() OVER (PARTITION BY y, c ORDER BY md5(concat(o_orderkey, '|42:', y, ':', c)), o_orderkey) - 1 AS rn, n, size
  FROM (SELECT *, count(*) OVER (PARTITION BY y) AS n, CASE WHEN y = 1 THEN 700 ELSE 1100 END AS size FROM o), range(40) AS r(c)) WHERE (rn + c * n) // size < 12)"""


@query(f"WITH {ORD}, {_DEALT} SELECT partition_id, o_orderkey, y FROM k")
def q_candidates(s: SparkSession, d: str) -> DataFrame:
    return P.candidates(orders(s, d), "o_orderkey", "y", {1: 700, 0: 1100}, 12)


@query(f"""
WITH {EMB.format(5)}, t AS (SELECT CAST(p AS INTEGER) AS g, vec_id, y, embedding FROM e, range(3) AS r(p) WHERE substr(md5(concat(vec_id, '|', p)), 1, 1) < 'c'),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY g, y ORDER BY md5(concat(vec_id, '|42')), vec_id) - 1) % 5 AS INTEGER) AS fold FROM t),
c AS (SELECT g, vec_id, fold, y, CAST(unnest(range(len(embedding))) AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM f),
t2 AS (SELECT g, y, j, count(*) AS tn, sum(v) AS ts, sum(v * v) AS tq FROM c GROUP BY ALL),
h AS (SELECT g, fold, y, j, tn - count(*) AS n, ts - sum(v) AS s, tq - sum(v * v) AS q FROM c JOIN t2 USING (g, y, j) GROUP BY g, fold, y, j, tn, ts, tq),
x AS (SELECT g, fold, 1e-9 * max(q / n - (s / n) ** 2) AS eps FROM (SELECT g, fold, j, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM h GROUP BY ALL) GROUP BY ALL),
m AS (SELECT h.g, h.fold, y, j, n, s / n AS m, q / n - (s / n) ** 2 + eps AS w FROM h JOIN x USING (g, fold)),
p AS (SELECT vec_id, c.g, c.fold, c.y, round(sum(-0.5 * ln(2 * pi() * b.w) - (v - b.m) ** 2 / (2 * b.w) + 0.5 * ln(2 * pi() * a.w) + (v - a.m) ** 2 / (2 * a.w)) + ln(max(b.n) / max(a.n)), 8) AS s
      FROM c JOIN m a ON a.g = c.g AND a.fold = c.fold AND a.j = c.j AND a.y = 0 JOIN m b ON b.g = c.g AND b.fold = c.fold AND b.j = c.j AND b.y = 1 GROUP BY ALL),
r AS (SELECT g, fold, s, sum(y) AS tp, sum(1 - y) AS fp FROM p GROUP BY ALL),
w AS (SELECT *, coalesce(sum(fp) OVER (PARTITION BY g, fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r),
z AS (SELECT g, fold, sum(tp * (below + fp / 2)) / (sum(tp) * sum(fp)) AS auroc FROM w GROUP BY ALL)
SELECT g AS partition_id, round(avg(auroc), 6) AS auroc FROM z GROUP BY g
""")
def q_candidate_scores(s: SparkSession, d: str) -> DataFrame:
    rows = emb(s, d)
    p = F.col("id").cast("int")
    three = rows.select("vec_id", "y").crossJoin(F.broadcast(s.range(3)))  # three rows
    made = three.filter(F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit("|"), p.cast("string"))), 1, 1) < "c").select(p.alias("partition_id"), "vec_id", "y")
    return Q.candidate_scores(made, rows, "vec_id", "y", "embedding").select("partition_id", F.round("auroc", 6).alias("auroc"))


# ---- gathers


def _index(s: SparkSession, d: str) -> DataFrame:
    return s.range(200).select(F.col("id").alias("pos"), (F.col("id") * 7 % 97).alias("vec_id"))


@query("SELECT i AS pos, vec_id, label FROM range(200) AS r(i) JOIN embeddings ON vec_id = i * 7 % 97")
def q_row_gather(s: SparkSession, d: str) -> DataFrame:
    return P.gather(table(s, d, "embeddings").select("vec_id", "label"), F.broadcast(_index(s, d)), "vec_id").select("pos", "vec_id", "label")


@query("WITH t AS (SELECT i, i * 3 AS vec_id FROM range(97) AS r(i)) SELECT p AS pos, t.i AS i, e.vec_id AS vec_id, label FROM range(200) AS q(p) JOIN t ON t.i = p * 7 % 97 JOIN embeddings e ON e.vec_id = t.vec_id")
def q_two_hop_gather(s: SparkSession, d: str) -> DataFrame:
    through = s.range(97).select(F.col("id").alias("i"), (F.col("id") * 3).alias("vec_id"))
    index = _index(s, d).withColumnRenamed("vec_id", "i")
    return P.gather_indirect(table(s, d, "embeddings").select("vec_id", "label"), index, through, "vec_id").select("pos", "i", "vec_id", "label")


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT i * 7 % 97 FROM range(200) AS r(i))")
def q_membership(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id").join(F.broadcast(_index(s, d)), "vec_id", "left_semi")


@query("WITH c AS (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 128 AS BIGINT) AS chunk FROM documents) SELECT chunk, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM c GROUP BY ALL")
def q_chunks(s: SparkSession, d: str) -> DataFrame:
    c = M.chunk_ids(table(s, d, "documents").select("doc_id"), [], "doc_id", 128)
    return c.groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


# ---- features

_LONG = "l AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
_MOM = f"{_LONG}, m AS (SELECT j, count(v) AS n, avg(v) AS mean, var_pop(v) AS variance FROM l GROUP BY ALL)"


@query(f"WITH {_MOM} SELECT j, n, round(mean, 6) AS mean, round(variance, 6) AS variance FROM m")
def q_moments(s: SparkSession, d: str) -> DataFrame:
    return X.moments(table(s, d, "embeddings"), "vec_id", "embedding").select("j", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query(f"WITH {_MOM} SELECT j FROM m WHERE variance > 0.015")
def q_variance_threshold(s: SparkSession, d: str) -> DataFrame:
    return X.varying(table(s, d, "embeddings"), "vec_id", "embedding", 0.015)


@query(f"WITH {_MOM} SELECT vec_id, j, round((v - mean) / sqrt(variance), 5) + 0.0 AS z FROM l JOIN m USING (j)")
def q_standardize(s: SparkSession, d: str) -> DataFrame:
    return X.standardised(table(s, d, "embeddings"), "vec_id", "embedding").select("vec_id", "j", (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query("WITH l AS (SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT CAST(label AS BIGINT) AS label, i, j, round(covar_pop(x, y), 8) + 0.0 AS cov FROM (SELECT a.label AS label, a.j AS i, b.j AS j, a.v AS x, b.v AS y FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.j <= b.j) GROUP BY ALL")
def q_covariance(s: SparkSession, d: str) -> DataFrame:
    """Covariances within each label, over the whole width."""
    return G.covariances(table(s, d, "embeddings"), "embedding", ["label"]).select("label", "i", "j", (F.round("cov", 8) + F.lit(0.0)).alias("cov"))


@query(f"WITH {_LONG} SELECT i, j, round(covar_pop(x, y), 8) + 0.0 AS cov FROM (SELECT a.j AS i, b.j AS j, a.v AS x, b.v AS y FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.j <= b.j) GROUP BY ALL")
def q_covariance_full(s: SparkSession, d: str) -> DataFrame:
    return G.covariances(table(s, d, "embeddings"), "embedding").select("i", "j", (F.round("cov", 8) + F.lit(0.0)).alias("cov"))


@query("SELECT bool_and(list_bool_and(list_transform(embedding, lambda v: v = floor(v)))) AS integral FROM (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 10)")
def q_integer_matrix(s: SparkSession, d: str) -> DataFrame:
    return X.is_integer_matrix(table(s, d, "embeddings"), "vec_id", "embedding")


@query("SELECT label, y, n, round(t / (2 * n), 8) AS weight FROM (SELECT 'emb80' AS label, CAST(label < 8 AS INTEGER) AS y, count(*) AS n, sum(count(*)) OVER () AS t FROM embeddings GROUP BY ALL UNION ALL SELECT 'orders', CAST(o_orderstatus = 'F' AS INTEGER), count(*), sum(count(*)) OVER () FROM orders GROUP BY ALL)")
def q_balanced_weights(s: SparkSession, d: str) -> DataFrame:
    one = lambda df, name: X.balanced_weights(df, "y").select(F.lit(name).alias("label"), "y", "n", F.round("weight", 8).alias("weight"))
    return one(emb(s, d, 8), "emb80").unionByName(one(orders(s, d), "orders"))


@query()
def q_pca_k(s: SparkSession, d: str) -> DataFrame:
    space = _space(s, d)[1]
    return s.createDataFrame([(share, space.width(share)) for share in (0.8, 0.9, 0.99)], "share double, k int")


def _space(s: SparkSession, d: str) -> tuple[G.Space, G.Space]:
    rows = table(s, d, "embeddings").select("embedding")
    about = G.centre(rows, "embedding")
    sums = G.grams(rows, [], "embedding", about).collect()  # a row for each feature
    return G.spaces(G.Gram.of([r["i"] for r in sums], [r["v"] for r in sums]), about)


@query(f"""
WITH {_LONG}, c AS (SELECT a.j AS i, b.j AS j, corr(a.v, b.v) AS r FROM l a JOIN l b USING (vec_id) GROUP BY ALL)
SELECT round(sum(CASE WHEN i = j THEN r END), 6) AS trace, round(sum(r * r), 6) AS squares FROM c
""")
def q_pca_spectrum(s: SparkSession, d: str) -> DataFrame:
    """Sums of the components' variances and of their squares: trace and squared norm of the correlations."""
    plain, space = _space(s, d)
    size = len(plain.basis)
    variances = [size * (b - a) for a, b in zip([0.0, *space.shares[:-1]], space.shares, strict=True)]
    return s.createDataFrame([(round(float(sum(variances)), 6), round(float(sum(v * v for v in variances)), 6))], "trace double, squares double")


@query(f"WITH {EMB.format(5)}, {_LONG}, m AS (SELECT j, avg(v) AS m, stddev_pop(v) AS sd FROM l GROUP BY j) SELECT l.vec_id, round(sum((v - m) / sd * ((v - m) / sd)), 4) AS length FROM l JOIN m USING (j) GROUP BY ALL")
def q_scaled_length(s: SparkSession, d: str) -> DataFrame:
    """Squared length of each scaled row, from its components: a rotation keeps it."""
    space = _space(s, d)[1]
    size = len(space.about)
    variances = [float(size * (b - a)) for a, b in zip([0.0, *space.shares[:-1]], space.shares, strict=True)]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            z = space.apply(G.doubles(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((z * z * variances).sum(1).round(4))], ["vec_id", "length"])

    return table(s, d, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, length double")


# ---- metrics


@query("WITH e AS (SELECT CAST(label < 5 AS INTEGER) AS y, round(CAST(embedding[1] AS DOUBLE), 2) AS s FROM embeddings), g AS (SELECT s, sum(y) AS tp, sum(1 - y) AS fp FROM e GROUP BY s), w AS (SELECT *, coalesce(sum(fp) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(tp * (below + fp / 2)) / (sum(tp) * sum(fp)), 8) AS auroc FROM w")
def q_auroc(s: SparkSession, d: str) -> DataFrame:
    rows = emb(s, d).select("y", F.round(F.element_at("embedding", 1).cast("double"), 2).alias("s"))
    return M.auroc(rows, "s", "y").select(F.round("auroc", 8).alias("auroc"))


_TOX = "e AS (SELECT toxic AS y, CAST(n_chars AS DOUBLE) AS s, lang FROM documents JOIN labels USING (doc_id))"


def _toxic(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("s")).join(table(s, d, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")


@query(f"WITH {_TOX}, g AS (SELECT lang, s, sum(y) AS tp, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT *, sum(tp) OVER o AS ctp, sum(n) OVER o AS cn FROM g WINDOW o AS (PARTITION BY lang ORDER BY s DESC)) SELECT lang, round(CASE WHEN sum(tp) > 0 THEN sum(tp * (ctp / cn)) / sum(tp) END, 8) AS ap FROM w GROUP BY lang")
def q_avg_precision(s: SparkSession, d: str) -> DataFrame:
    return M.average_precision(_toxic(s, d), "s", "y", ["lang"]).select("lang", F.round("ap", 8).alias("ap"))


@query(f"WITH {_TOX}, g AS (SELECT s, sum(y) AS tp, sum(1 - y) AS fp FROM e GROUP BY ALL) SELECT s AS threshold, round(sum(fp) OVER o / (SELECT sum(fp) FROM g), 8) AS fpr, round(sum(tp) OVER o / (SELECT sum(tp) FROM g), 8) AS tpr FROM g WINDOW o AS (ORDER BY s DESC)")
def q_roc_points(s: SparkSession, d: str) -> DataFrame:
    return M.roc_points(_toxic(s, d), "s", "y").select("threshold", F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"))


_NB = """t AS (SELECT y, j, count(*) AS tn, sum(v) AS ts, sum(v * v) AS tq FROM c GROUP BY ALL),
h AS (SELECT fold, y, j, tn - count(*) AS n, ts - sum(v) AS s, tq - sum(v * v) AS q FROM c JOIN t USING (y, j) GROUP BY fold, y, j, tn, ts, tq)"""
_RANKED = """g AS (SELECT fold, s, sum(y) AS tp, sum(1 - y) AS fp FROM p GROUP BY ALL),
w AS (SELECT *, coalesce(sum(fp) OVER (PARTITION BY fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT fold, round(sum(tp * (below + fp / 2)) / (sum(tp) * sum(fp)), 6) AS auroc FROM w GROUP BY fold"""


@query(f"""
WITH {EMB.format(5)}, {FOLDS}, {CELLS}, {_NB},
x AS (SELECT fold, 1e-9 * max(q / n - (s / n) ** 2) AS eps FROM (SELECT fold, j, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM h GROUP BY ALL) GROUP BY fold),
m AS (SELECT h.fold, y, j, n, s / n AS m, q / n - (s / n) ** 2 + eps AS w FROM h JOIN x USING (fold)),
p AS (SELECT vec_id, c.fold, c.y, round(sum(-0.5 * ln(2 * pi() * b.w) - (v - b.m) ** 2 / (2 * b.w) + 0.5 * ln(2 * pi() * a.w) + (v - a.m) ** 2 / (2 * a.w)) + ln(max(b.n) / max(a.n)), 8) AS s
      FROM c JOIN m a ON a.fold = c.fold AND a.j = c.j AND a.y = 0 JOIN m b ON b.fold = c.fold AND b.j = c.j AND b.y = 1 GROUP BY ALL),
{_RANKED}
""")
def q_gnb_cv_auroc(s: SparkSession, d: str) -> DataFrame:
    return Q.quick_auroc(emb(s, d), "vec_id", "y", "embedding").select("fold", F.round("auroc", 6).alias("auroc"))


@query(f"""
WITH {EMB.format(1)}, {FOLDS}, {CELLS.replace("CAST(unnest(embedding) AS DOUBLE) AS v", "CAST(unnest(list_transform(embedding, lambda z: z > 0)) AS DOUBLE) AS v")}, {_NB},
m AS (SELECT fold, y, j, n, (s + 1) / (n + 2) AS m FROM h),
p AS (SELECT vec_id, c.fold, c.y, round(sum(CASE WHEN v > 0 THEN ln(b.m) - ln(a.m) ELSE ln(1 - b.m) - ln(1 - a.m) END) + ln(max(b.n) / max(a.n)), 8) AS s
      FROM c JOIN m a ON a.fold = c.fold AND a.j = c.j AND a.y = 0 JOIN m b ON b.fold = c.fold AND b.j = c.j AND b.y = 1 GROUP BY ALL),
{_RANKED}
""")
def q_bnb_cv_auroc(s: SparkSession, d: str) -> DataFrame:
    return Q.quick_auroc(emb(s, d, 1), "vec_id", "y", "embedding", kind="bernoulli").select("fold", F.round("auroc", 6).alias("auroc"))


# ---- scores of ensembles

_SCORES = "s AS (SELECT CAST(m AS INTEGER) AS m, vec_id, 1 / (1 + exp(-4 * CAST(embedding[m + 1] AS DOUBLE))) AS p1 FROM embeddings, range(5) AS r(m))"


def _model_scores(s: SparkSession, d: str) -> DataFrame:
    at = F.transform(F.slice("embedding", 1, 5), lambda v: S.logistic(4 * v.cast("double")))
    return table(s, d, "embeddings").select("vec_id", F.posexplode(at).alias("m", "p1"))


@query(f"WITH {_SCORES} SELECT vec_id, round(avg(p1), 8) AS p1, count(*) AS n_models FROM s GROUP BY ALL")
def q_ensemble_mean(s: SparkSession, d: str) -> DataFrame:
    return M.ensemble_mean(_model_scores(s, d), "vec_id").select("vec_id", F.round("p1", 8).alias("p1"), "n_models")


@query(f"WITH {_SCORES} SELECT vec_id, CAST(p1 >= 0.5 AS INTEGER) AS prediction FROM s WHERE m = 0")
def q_threshold(s: SparkSession, d: str) -> DataFrame:
    return M.threshold(_model_scores(s, d).filter("m = 0")).select("vec_id", "prediction")


@query(f"WITH {_SCORES} SELECT vec_id, round(1 - p1, 8) AS p0, round(p1, 8) AS p1 FROM s WHERE m = 0")
def q_complement(s: SparkSession, d: str) -> DataFrame:
    return M.complement(_model_scores(s, d).filter("m = 0")).select("vec_id", F.round("p0", 8).alias("p0"), F.round("p1", 8).alias("p1"))


@query(f"WITH {_SCORES} SELECT vec_id, sum(CAST(p1 >= 0.5 AS INTEGER)) > 2 AS vote FROM s GROUP BY ALL")
def q_majority_vote(s: SparkSession, d: str) -> DataFrame:
    return M.majority_vote(_model_scores(s, d), "vec_id")


@query("WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM documents) SELECT doc_id, CAST(CAST('0x' || substr(md5(w), 1, 6) AS BIGINT) % 2048 AS INTEGER) AS j, CAST(least(count(*), 255) AS INTEGER) AS v FROM w GROUP BY ALL")
def q_count_fingerprint(s: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    return X.slot_counts(table(s, d, "documents"), words, lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % 2048).cast("int"), ["doc_id"])


@query("""
WITH o AS (SELECT o_totalprice AS t, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS g FROM orders),
a AS (SELECT t, round(g, 4) AS g FROM o), r AS (SELECT *, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS rt, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2 AS rg FROM a)
SELECT round(1 - sum((t - g) ** 2) / (var_pop(t) * count(*)), 6) AS r2, round(avg(abs(t - g)), 4) AS mae, round(corr(rt, rg), 6) AS spearman FROM r
""")
def q_r2_mae_spearman(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_orderpriority", F.col("o_totalprice").alias("t"))
    mean = o.groupBy("o_orderpriority").agg(F.round(F.avg("t"), 4).alias("g"))
    r = M.regression(o.join(F.broadcast(mean), "o_orderpriority"), "t", "g")  # a row for each priority
    return r.select(F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("spearman", 6).alias("spearman"))


# ---- fitted models


def _pool(s: SparkSession, d: str, splits: list[tuple], below: int = 5) -> L.Pool:
    rows = emb(s, d, below)
    return L.pool(rows, rows.select(F.lit(0).alias("partition_id"), "vec_id", "y"), "vec_id", "y", "embedding", splits)


def _fitted(s: SparkSession, d: str, c: float = 1.0) -> L.Linear:
    p = _pool(s, d, [(4, 42)])
    L.find_spaces(p, [0], [0])
    key = ("plain", 0, 0, L.ALL)
    b = L.solve(p, [L.Problem(0, L.ALL, L.ALL, c, key, p.spaces[key].width())])[0]
    p.rows.unpersist()
    return L.Linear(*p.spaces[key].back(b[1:], float(b[0])), {})


@query()
def q_logreg_scores(s: SparkSession, d: str) -> DataFrame:
    return emb(s, d).withColumn("p1", F.round(mean_score([_fitted(s, d)], "embedding"), 6)).select("vec_id", "y", "p1")


@query("SELECT CAST(i AS INTEGER) AS j, 0.0::DOUBLE AS gradient FROM range((SELECT max(len(embedding)) + 1 FROM embeddings)) AS r(i)")
def q_logreg_optimum(s: SparkSession, d: str) -> DataFrame:
    """Gradient of the balanced loss plus penalty at the fitted coefficients, for the intercept (0) and each feature: the
    objective is convex, so it is fitted exactly where all are 0."""
    model, rows = _fitted(s, d), emb(s, d)
    weights = F.broadcast(X.balanced_weights(rows, "y").select("y", "weight"))  # two rows
    scored = rows.join(weights, "y").withColumn("r", F.col("weight") * (mean_score([model], "embedding") - F.col("y")))
    each = scored.select(F.posexplode(F.concat(F.array(F.lit(1.0)), F.transform("embedding", lambda v: v.cast("double")))).alias("j", "v"), "r")
    beta = F.element_at(F.array(F.lit(0.0), *[F.lit(float(w)) for w in model.weights]), F.col("j") + 1)
    return each.groupBy("j").agg(F.sum(F.col("v") * F.col("r")).alias("g")).select("j", (F.round(F.col("g") + beta, 5) + F.lit(0.0)).alias("gradient"))


@query()
def q_forest_scores(s: SparkSession, d: str) -> DataFrame:
    p = _pool(s, d, [(4, 42)])
    b = forest_rows(p, {0: None})
    trees = T.grow(b, [T.Grow(0, L.ALL, L.ALL, depth=8)])[0]
    b.rows.unpersist()
    p.rows.unpersist()
    model = T.Forest(b.space[0], b.width[0], b.edges[0], trees, 1.0, 0.0, {})
    return emb(s, d).withColumn("p1", F.round(mean_score([Raw(model)], "embedding"), 6)).select("vec_id", "y", "p1")


class Raw:
    """A forest whose score is not calibrated."""

    def __init__(self, model: T.Forest) -> None:
        self.score = model.raw


#: One tree over one feature and all rows, two leaves: the split that lowers the impurity most, by SQL over all values.
@query(f"""
WITH {EMB.format(5)}, v AS (SELECT y, round(CAST(embedding[1] AS DOUBLE), 1) AS x FROM e), b AS (SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) AS n FROM v),
w AS (SELECT x, sum(1 - y) AS c0, sum(y) AS c1 FROM v GROUP BY x), u AS (SELECT x, sum(c0) OVER (ORDER BY x) AS l0, sum(c1) OVER (ORDER BY x) AS l1, lead(x) OVER (ORDER BY x) AS nx FROM w),
g AS (SELECT *, l0 * n / (2 * n0) AS a0, l1 * n / (2 * n1) AS a1, n / 2 AS h FROM u, b WHERE nx IS NOT NULL),
k AS (SELECT *, (a0 * a0 + a1 * a1) / (a0 + a1) + ((h - a0) * (h - a0) + (h - a1) * (h - a1)) / (2 * h - a0 - a1) AS gain FROM g)
SELECT round((x + nx) / 2, 6) AS threshold, CAST(l0 AS BIGINT) AS n0, CAST(l1 AS BIGINT) AS n1, round(gain - h, 6) AS gain FROM k ORDER BY round(gain, 9) DESC, x LIMIT 1
""")
def q_best_split(s: SparkSession, d: str) -> DataFrame:
    rows = emb(s, d).select("vec_id", "y", F.array(F.round(F.element_at("embedding", 1).cast("double"), 1)).alias("x"))
    p = L.pool(rows, rows.select(F.lit(0).alias("partition_id"), "vec_id", "y"), "vec_id", "y", "x", [(4, 42)])
    b = forest_rows(p, {0: None})
    gain, _, at, left, _ = T.best_split(b, T.Grow(0, L.ALL, L.ALL))
    b.rows.unpersist()
    p.rows.unpersist()
    return s.createDataFrame([(round(float(b.edges[0][0][at]), 6), left[0], left[1], round(gain, 6))], "threshold double, n0 long, n1 long, gain double")


@query("""
WITH RECURSIVE e AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS y, 1 / (1 + exp(-4 * CAST(embedding[1] AS DOUBLE))) AS p FROM embeddings),
n AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
      UNION ALL
      SELECT i + 1, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (SELECT i, a, b, sum(q - y) AS g0, sum((q - y) * p) + b AS g1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * p) AS h01, sum(q * (1 - q) * p * p) + 1 AS h11
            FROM (SELECT i, a, b, y, p, 1 / (1 + exp(-(a + b * p))) AS q FROM n, e WHERE i < 12) GROUP BY i, a, b))
SELECT vec_id, round(p, 8) AS p, round(1 / (1 + exp(-(a + b * p))), 6) AS p1 FROM e, (SELECT a, b FROM n WHERE i = 12)
""")
def q_platt(s: SparkSession, d: str) -> DataFrame:
    raw = emb(s, d).select("vec_id", "y", S.logistic(4 * F.element_at("embedding", 1).cast("double")).alias("p"))
    slope, intercept, _ = L.calibrations(raw.select(F.lit(0).alias("j"), "y", F.col("p").alias("p1")), [1.0])[0]
    return raw.select("vec_id", F.round("p", 8).alias("p"), F.round(S.logistic(F.lit(intercept) + F.lit(slope) * F.col("p")), 6).alias("p1"))


@query()
def q_ensemble_scores(s: SparkSession, d: str) -> DataFrame:
    rows = emb(s, d)
    model = BinaryClassifier("random_forest", "quick", key="vec_id", features="embedding", pca=False, max_depth=8).fit(rows)
    # not rounded: the quick preset calibrates in sample with a strong penalty, so probabilities lie close together
    return model.predict(rows).select("vec_id", "y", "p1", "prediction")


_RIDGE = "e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) + 3 * CAST(embedding[1] AS DOUBLE) AS y FROM embeddings)"


@query(f"""
WITH {_RIDGE}, m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS v, covar_pop(x, y) AS c, count(*) AS n FROM e), g AS (SELECT unnest([0.001, 0.01, 0.1, 1.0, 10.0])::DOUBLE AS penalty),
r AS (SELECT penalty, (y - my - (x - mx) * c / (v * (1 + penalty))) / (1 - 1 / n - (x - mx) ** 2 / (v * (1 + penalty)) / n) AS loo FROM e, m, g)
SELECT penalty, round(avg(loo * loo), 8) AS mse FROM r GROUP BY penalty
""")
def q_ridge_loo(s: SparkSession, d: str) -> DataFrame:
    """Leave-one-out mean squared error of each penalty, of a ridge regression on one feature."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    rows = table(s, d, "embeddings").select(F.array(at(1)).alias("x"), (at(2) + 3 * at(1)).alias("t"))
    found = fit_ridge(rows, "x", "t")[0].recorded["loo_mse"]
    return s.createDataFrame([(float(a), round(e, 8)) for a, e in found.items()], "penalty double, mse double")
