"""Benchmark runs: the registry of tasks and leaderboard scores, fit and predict for each task, and scores of all tasks in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.metrics import auroc, average_precision
from loomspark.sources.tables import exists, labelled_csv, write_json, write_predictions


@dataclass(frozen=True)
class Task:
    name: str
    metric: str  # roc-auc or pr-auc


# The tasks, their metrics, and the mean and deviation that the public leaderboard gives for each.
TASKS = (
    Task("bioavailability_ma", "roc-auc"),
    Task("hia_hou", "roc-auc"),
    Task("pgp_broccatelli", "roc-auc"),
    Task("bbb_martins", "roc-auc"),
    Task("cyp2c9_veith", "pr-auc"),
    Task("cyp2d6_veith", "pr-auc"),
    Task("cyp3a4_veith", "pr-auc"),
    Task("cyp2c9_substrate_carbonmangels", "pr-auc"),
    Task("cyp2d6_substrate_carbonmangels", "pr-auc"),
    Task("cyp3a4_substrate_carbonmangels", "roc-auc"),
    Task("herg", "roc-auc"),
    Task("ames", "roc-auc"),
    Task("dili", "roc-auc"),
)
LEADERBOARD = {
    "bioavailability_ma": (0.748, 0.033),
    "hia_hou": (0.989, 0.001),
    "pgp_broccatelli": (0.938, 0.002),
    "bbb_martins": (0.916, 0.001),
    "cyp2c9_veith": (0.859, 0.001),
    "cyp2d6_veith": (0.790, 0.001),
    "cyp3a4_veith": (0.916, 0.000),
    "cyp2c9_substrate_carbonmangels": (0.441, 0.033),
    "cyp2d6_substrate_carbonmangels": (0.736, 0.024),
    "cyp3a4_substrate_carbonmangels": (0.662, 0.031),
    "herg": (0.880, 0.002),
    "ames": (0.871, 0.002),
    "dili": (0.925, 0.005),
}


def leaderboard(spark: SparkSession) -> DataFrame:
    """(task, metric, mean, std) of each task."""
    return spark.createDataFrame([(t.name, t.metric, *LEADERBOARD[t.name]) for t in TASKS], "task string, metric string, mean double, std double")


def scores(predictions: DataFrame, tasks: DataFrame, score: str = "pred", label: str = "y") -> DataFrame:
    """(task, metric, score): each task's own metric, from (task, y, pred) and (task, metric)."""
    a = auroc(predictions, score, label, ["task"]).withColumnRenamed("auroc", "score").withColumn("metric", F.lit("roc-auc"))
    p = average_precision(predictions, score, label, ["task"]).withColumnRenamed("ap", "score").withColumn("metric", F.lit("pr-auc"))
    return tasks.join(a.unionByName(p), ["task", "metric"]).select("task", "metric", "score")


def against_leaderboard(left: DataFrame, right: DataFrame, board: DataFrame) -> DataFrame:
    """(task, left_score, right_score, mean, std) by task: either side may lack a task, the leaderboard may not."""
    l, r = (x.select("task", F.col("score").alias(n)) for x, n in ((left, "left_score"), (right, "right_score")))
    return l.join(r, "task", "full").join(board.select("task", "mean", "std"), "task").orderBy("task")


def run(spark: SparkSession, folder: str, out: str, tasks: list[Task], make: Callable[[], object]) -> DataFrame:
    """Fit and score each task that has a train and a test file; predictions and scores are written under ``out``."""
    got = None
    for t in tasks:
        train, test = f"{folder}/{t.name}_train.csv", f"{folder}/{t.name}_test.csv"
        if not (exists(spark, train) and exists(spark, test)):
            continue
        model = make().fit(labelled_csv(spark, train))
        model.save(spark, f"{out}/models/{t.name}")
        path = f"{out}/{t.name}_test_pred"
        write_predictions(model.predict_proba(labelled_csv(spark, test)).withColumnRenamed("p1", "pred"), path)
        own = labelled_csv(spark, path, predicted=True).withColumn("task", F.lit(t.name))
        got = own if got is None else got.unionByName(own)
    registry = spark.createDataFrame([(t.name, t.metric) for t in tasks], "task string, metric string")
    if got is None:
        return spark.createDataFrame([], "task string, metric string, score double")
    made = scores(got, registry)
    write_json(spark, {r["task"]: r["score"] for r in made.collect()}, f"{out}/results.json")  # one row a task
    return made


def run_matrix(spark: SparkSession, folder: str, out: str, makers: dict[tuple[str, str], Callable[[], object]], tasks: tuple[Task, ...] = TASKS) -> DataFrame:
    """(model, descriptor, task, metric, score) of every combination, each written under ``out``/model_descriptor."""
    got = None
    for (model, kind), make in makers.items():
        own = run(spark, folder, f"{out}/{model}_{kind}", list(tasks), make).select(F.lit(model).alias("model"), F.lit(kind).alias("descriptor"), "task", "metric", "score")
        got = own if got is None else got.unionByName(own)
    if got is None:
        raise ValueError("no combinations")
    return got
