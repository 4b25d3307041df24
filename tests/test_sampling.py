import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import folds as K
from loomspark.operators import sampling as P


def frame(spark, n=300, every=5):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % every == 0).cast("int").alias("y"))


def test_folds_partition_rows(spark):
    got = K.stratified_folds(frame(spark, 103), "k", "y", 4).collect()
    assert len({r.k for r in got}) == 103
    for y in (0, 1):
        sizes = [sum(r.fold == f and r.y == y for r in got) for f in range(4)]
        assert max(sizes) - min(sizes) <= 1


def test_folds_do_not_depend_on_layout(spark):
    a = {(r.k, r.fold) for r in K.stratified_folds(frame(spark), "k", "y").collect()}
    b = {(r.k, r.fold) for r in K.stratified_folds(frame(spark).repartition(7).orderBy(F.desc("k")), "k", "y").collect()}
    assert a == b


def test_holdout_share(spark):
    got = K.holdout(frame(spark, 100), "k", "y").groupBy("y").agg(F.sum(F.col("held_out").cast("int")).alias("n")).collect()
    assert {r.y: r.n for r in got} == {0: 20, 1: 5}


def test_oversampling_multiplies_negatives(spark):
    got = K.oversampled(frame(spark, 100, 1).withColumn("y", (F.col("k") < 80).cast("int")), "k", "y").collect()
    train = [r for r in got if r.fold == 0 and r.part == "train"]
    n, neg = len(train), sum(r.y == 0 for r in train)
    assert sum(r.mult for r in train if r.y == 0) == neg + int(n * 0.5 - neg)
    assert all(r.mult == 1 for r in got if r.y == 1 or r.part == "test")


def test_least_seen_first(spark):
    rows = frame(spark)
    first = P.draw(rows.withColumn("seen", F.lit(0)), "k", "y", {1: 20, 0: 30}, 0)
    counts = rows.join(P.seen_counts(first, rows, "k"), "k")
    second = P.draw(counts, "k", "y", {1: 20, 0: 30}, 1).collect()
    assert sum(r.y for r in second) == 20 and len(second) == 50 and all(r.seen == 0 for r in second)


def test_candidates_cover_evenly(spark):
    made = P.candidates(frame(spark, 90), "k", "y", {1: 7, 0: 25}, 10)
    seen = P.seen_counts(made, frame(spark, 90), "k").join(frame(spark, 90), "k").collect()
    for y in (0, 1):
        counts = [r.seen for r in seen if r.y == y]
        assert max(counts) - min(counts) <= 2


def test_plan_of_candidates_does_not_grow(spark):
    rows = frame(spark, 400, 40)  # ten positives, taken whole by every draw
    plans = [P.candidates(rows, "k", "y", {1: 10, 0: 50}, n)._jdf.queryExecution().optimizedPlan().toString() for n in (10, 1000)]
    assert plans[0].count("Window") == plans[1].count("Window") <= 2 and plans[0].count("\n") == plans[1].count("\n")
    made = P.candidates(rows, "k", "y", {1: 10, 0: 50}, 12).groupBy("partition_id", "y").count().collect()
    assert len(made) == 24 and all(r["count"] == 10 if r.y else 48 <= r["count"] <= 50 for r in made)


@pytest.mark.parametrize("seed", range(3))
def test_greedy_cover_equals_plain_picks(spark, seed):
    r = random.Random(seed)
    held = {p: {k for k in range(60) if r.random() < 0.3} for p in range(12)}
    parts = spark.createDataFrame([(p, k) for p, ks in held.items() for k in ks], "partition_id int, k long")
    asked = []

    def rank(tied):
        asked.append(tied)
        return {p: ((p * 5 + seed) % 12,) for p in tied}

    for least in (1, 2):
        want, seen = [], dict.fromkeys(range(60), 0)
        while len(want) < 100:
            gain = {p: sum(seen[k] < least for k in ks) for p, ks in held.items() if p not in want}
            best = min(gain, key=lambda p: (-gain[p], (p * 5 + seed) % 12), default=None)
            if best is None or not gain[best]:
                break
            want.append(best)
            for k in held[best]:
                seen[k] += 1
        for look in (1, 3, 64):
            asked.clear()
            assert P.greedy_cover(parts, "k", rank, least, look=look) == want
            assert all(len(tied) > 1 for tied in asked)


def test_only_ties_are_scored(spark):
    scored = []

    def score(made):
        ids = sorted(r.partition_id for r in made.select("partition_id").distinct().collect())
        scored.append(ids)
        return spark.createDataFrame([(i, 0.5 + i / 1000) for i in ids], "partition_id int, auroc double")

    rows = frame(spark, 400, 4).persist()
    got = P.partitions(rows, "k", "y", max_samples=120, min_positives=10, score=score)
    assert {r.k for r in got.collect()} == set(range(400))
    flat = [i for ids in scored for i in ids]
    assert flat and len(flat) == len(set(flat))


def test_jaccard_and_redundancy(spark):
    parts = spark.createDataFrame([(0, k) for k in range(100)] + [(1, k) for k in range(99)] + [(2, k) for k in range(50, 150)] + [(3, k) for k in range(100)], "partition_id int, k long")
    pairs = P.jaccard_pairs(parts, "k")
    got = {(r.a, r.b): round(r.jaccard, 4) for r in pairs.collect()}
    assert got[0, 1] == 0.99 and got[0, 2] == round(50 / 150, 4) and got[0, 3] == 1.0
    assert sorted(r.partition_id for r in P.redundant(pairs).collect()) == [1, 3]
    assert sorted(r.partition_id for r in P.distinct_partitions(parts, "k").collect()) == [0, 1, 2]


def test_partitions_cover_and_keep_the_quota(spark):
    rows = frame(spark, 400, 4).persist()
    got = P.partitions(rows, "k", "y", max_samples=120, min_positives=10).collect()
    assert {r.k for r in got} == set(range(400))
    by = {}
    for r in got:
        by.setdefault(r.partition_id, []).append(r.y)
    assert sorted(by) == list(range(len(by)))
    whole = P.partitions(rows, "k", "y", max_samples=1000).collect()
    assert {r.partition_id for r in whole} == {0} and len(whole) == 400


def test_gather_repeats_rows(spark):
    index = spark.createDataFrame([(0, 3), (1, 3), (2, 1)], "pos long, k long")
    assert sorted((r.pos, r.k) for r in P.gather(frame(spark), index, "k").collect()) == [(0, 3), (1, 3), (2, 1)]
