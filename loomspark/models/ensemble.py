"""Ensembles over partitions: fit, predict in one scan, save and load; facades over tables and over text."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.scalars import min_seen, step_grid
from loomspark.models.base import Options, fit_forests, fit_linear, splits
from loomspark.models.descriptors import descriptor
from loomspark.models.forest import Forest
from loomspark.models.linear import Linear, pool
from loomspark.models.meta import meta_features, nearest, remember
from loomspark.models.progress import Progress
from loomspark.models.ridge import Ridge, fit_ridge
from loomspark.operators.features import is_integer_matrix
from loomspark.operators.folds import folds
from loomspark.operators.gram import Space
from loomspark.operators.metrics import complement, threshold
from loomspark.operators.quick import candidate_scores, quick_score
from loomspark.operators.sampling import partitions
from loomspark.sources.stored import drop
from loomspark.sources.tables import check_input, exists, is_empty, read_json, write_json

PRESETS = {
    "quick": {"num_trials": 0, "num_splits": 0, "max_samples": 10_000, "min_seen": 1},
    "default": {"num_trials": 10, "num_splits": 3, "max_samples": None, "min_seen": None},
}
#: Partitions that decide on the reduction for themselves; the majority then holds for the others.
VOTES = 4
MODELS = {"logistic_regression": fit_linear, "random_forest": fit_forests}


def mean_score(models: list, features: str) -> Column:
    """The mean score of the models for an array of features; rows are scored in Arrow batches, null features give null."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            there = x.notna().to_numpy()
            out = np.full(len(x), np.nan)
            if there.any():
                rows = np.stack(x[there].to_numpy()).astype(np.float64)
                out[there] = sum(m.score(rows) for m in models) / len(models)
            yield pd.Series(out).where(there)

    return score(F.transform(features, lambda v: v.cast("double")))


def to_json(m: Linear | Forest | Ridge) -> dict:
    """A model as JSON."""
    if not isinstance(m, Forest):
        return {"weights": m.weights.tolist(), "intercept": m.intercept, "recorded": m.recorded}
    s = m.space
    space = {"about": s.about.tolist(), "basis": s.basis.tolist(), "shares": None if s.shares is None else s.shares.tolist()}
    return {"space": space, "width": m.width, "edges": [e.tolist() for e in m.edges], "trees": [[v.tolist() for v in t] for t in m.trees], "slope": m.slope, "intercept": m.intercept, "recorded": m.recorded}


def from_json(kind: str, d: dict) -> Linear | Forest | Ridge:
    if kind != "random_forest":
        return (Ridge if kind == "ridge" else Linear)(np.array(d["weights"]), d["intercept"], d["recorded"])
    s = d["space"]
    basis = np.array(s["basis"])
    space = Space(np.array(s["about"]), basis if basis.ndim == 2 else basis.astype(np.int64), None if s["shares"] is None else np.array(s["shares"]))
    trees = [(np.array(f, np.int32), np.array(c, np.int32), np.array(left, np.int32), np.array(v)) for f, c, left, v in d["trees"]]
    return Forest(space, d["width"], [np.array(e, float) for e in d["edges"]], trees, d["slope"], d["intercept"], d["recorded"])


def save_models(spark: SparkSession, folder: str, models: list, meta: dict) -> None:
    """partition_000 and so on, and metadata.json. What an ensemble has left there is deleted first; any other folder raises."""
    if exists(spark, folder):
        if not exists(spark, f"{folder}/metadata.json") and not is_empty(spark, folder):
            raise ValueError(f"{folder} holds something else than an ensemble")
        drop(spark, folder)
    for i, m in enumerate(models):
        write_json(spark, to_json(m), f"{folder}/partition_{i:03d}/model.json")
    write_json(spark, meta | {"partitions": len(models)}, f"{folder}/metadata.json")


def load_models(spark: SparkSession, folder: str, kind: str, n: int) -> list:
    return [from_json(kind, read_json(spark, f"{folder}/partition_{i:03d}/model.json")) for i in range(n)]


def choose_max_samples(df: DataFrame, key: str, label: str, features: str, seed: int = 42) -> int:
    """10 000 for smaller tables; else the first size of the step grid with the best mean quick AUROC of three partitions."""
    n = df.count()
    if n < 10_000:
        return 10_000
    best, value = 10_000, -1.0
    for size in [x for x in step_grid() if x <= n] or [10_000]:
        parts = partitions(df, key, label, max_samples=size, max_partitions=3, seed=seed).persist()
        ids = [r[0] for r in parts.select("partition_id").distinct().collect()]  # three at most
        mean = sum(quick_score(df.join(parts.filter(F.col("partition_id") == i).select(key), key, "left_semi"), key, label, features) for i in ids) / len(ids)
        parts.unpersist()
        if mean > value:
            best, value = size, mean
    return best


class BinaryClassifier:
    """A partitioned ensemble over a table (key, features array, label)."""

    def __init__(self, model_type: str = "random_forest", mode: str = "default", *, key: str = "row_id", features: str = "features", label: str = "y", **options) -> None:
        if mode not in PRESETS:
            raise ValueError(f"unsupported mode: {mode}")
        if model_type not in MODELS:
            raise ValueError(f"unsupported model: {model_type}")
        self.settings = {"model_type": model_type, "mode": mode, "key": key, "features": features, "label": label, "min_positive_proportion": 0.01, "max_positive_proportion": 0.5, "min_samples": 30, "min_positive_samples": 10, "max_num_partitions": 100, "random_state": 42, "pca": None, "portfolio": None, "force": model_type == "logistic_regression"} | PRESETS[mode] | options
        self.models: list[Linear | Forest] = []
        self.seconds: float | None = None  # of the last fit

    def options(self) -> Options:
        s = self.settings
        own = {k: s[k] for k in ("trees", "max_features", "leaves", "max_depth", "test_size") if k in s}
        return replace(Options(num_trials=s["num_trials"], num_splits=s["num_splits"], pca=s["pca"], seed=s["random_state"], shape=s["model_type"]), **own)

    def fit(self, df: DataFrame, tell: Callable[[str, int, int, float], None] | None = None) -> BinaryClassifier:
        """Fit all partitions; ``tell`` gets (stage, done, total, seconds) as stages go, and ``progress`` keeps them."""
        s = self.settings
        self.progress = Progress(df.sparkSession, f"fit-{uuid.uuid4().hex[:8]}", tell)
        key, label, features, began = s["key"], s["label"], s["features"], time.perf_counter()
        check_input(df, label=label, key=key)
        rows = df.select(key, label, features).persist()
        try:
            def score(made: DataFrame) -> DataFrame:
                kind = "bernoulli" if is_integer_matrix(rows, key, features).first()["integral"] else "gaussian"
                return candidate_scores(made, rows, key, label, features, kind=kind, seed=s["random_state"])

            with self.progress.stage("partitions"):
                size = s["max_samples"] or choose_max_samples(rows, key, label, features, s["random_state"])
                seen = s["min_seen"] or min_seen(rows.count(), size)
                parts = partitions(rows, key, label, least=s["min_positive_proportion"], most=s["max_positive_proportion"], max_samples=size, min_samples=s["min_samples"], min_positives=s["min_positive_samples"], max_partitions=s["max_num_partitions"], least_seen=seen, force=s["force"], seed=s["random_state"], score=score).persist()
                options = self._first(rows)
                pooled = pool(rows, parts, key, label, features, splits(options))
            with self.progress.stage("models", len(pooled.parts)):
                made = MODELS[s["model_type"]](pooled, options, VOTES)
            self.models = [made[part] for part in sorted(made)]
            if s["portfolio"] and s["model_type"] == "random_forest" and options.num_trials:
                found = max((m.recorded for m in self.models), key=lambda r: np.mean(r["held_out"]))
                remember(df.sparkSession, s["portfolio"], meta_features(rows, label, features), {k: found[k] for k in ("trees", "max_features", "leaves")})
            pooled.rows.unpersist()
            parts.unpersist()
            self.seconds = time.perf_counter() - began
            return self
        finally:
            rows.unpersist()

    def _first(self, rows: DataFrame) -> Options:
        """The options, for a forest with the first parameters of the nearest table of the portfolio, if one is named."""
        s, options = self.settings, self.options()
        if not s["portfolio"] or s["model_type"] != "random_forest":
            return options
        found = nearest(rows.sparkSession, s["portfolio"], meta_features(rows, s["label"], s["features"]))
        return replace(options, **found) if found else options

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """``df`` with p0 and p1; one scan, all models row by row, so it serves streams as well."""
        if not self.models:
            raise ValueError("not fitted")
        return complement(df.withColumn("p1", mean_score(self.models, self.settings["features"])))

    def predict(self, df: DataFrame, t: float = 0.5) -> DataFrame:
        """``predict_proba`` with prediction, 1 where p1 >= t."""
        return threshold(self.predict_proba(df), "p1", t)

    def save(self, spark: SparkSession, folder: str) -> None:
        """partition_000 and so on with the models, and metadata.json; an ensemble that was there is deleted first."""
        save_models(spark, folder, self.models, {"settings": self.settings})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> BinaryClassifier:
        meta = read_json(spark, f"{folder}/metadata.json")
        s = meta["settings"]
        out = cls(s["model_type"], s["mode"], **{k: v for k, v in s.items() if k not in ("model_type", "mode")})
        out.models = load_models(spark, folder, s["model_type"], meta["partitions"])
        return out


class TextClassifier:
    """A ``BinaryClassifier`` over strings, through a descriptor."""

    def __init__(self, descriptor_type: str = "circular", model_type: str = "random_forest", mode: str = "default", *, text: str = "drug", **options) -> None:
        self.descriptor = descriptor(descriptor_type)
        self.text = text
        self.model = BinaryClassifier(model_type, mode, **options)

    def _features(self, df: DataFrame) -> DataFrame:
        return self.descriptor.transform(df, self.text, self.model.settings["features"])

    def fit(self, df: DataFrame) -> TextClassifier:
        described = self._features(df)
        self.model.fit(described.filter(F.col(self.model.settings["features"]).isNotNull()))
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.model.predict_proba(self._features(df))

    def predict(self, df: DataFrame, t: float = 0.5) -> DataFrame:
        return threshold(self.predict_proba(df), "p1", t)

    def save(self, spark: SparkSession, folder: str) -> None:
        self.model.save(spark, folder)
        write_json(spark, {"descriptor": json.loads(self.descriptor.to_json()), "text": self.text}, f"{folder}/config.json")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TextClassifier:
        config = read_json(spark, f"{folder}/config.json")
        out = cls.__new__(cls)
        out.descriptor = descriptor(config["descriptor"]["kind"]).check(config["descriptor"])
        out.text = config["text"]
        out.model = BinaryClassifier.load(spark, folder)
        return out


class Regressor:
    """Ridge regressions over equal random partitions, their mean the prediction."""

    def __init__(self, *, key: str = "row_id", features: str = "features", target: str = "y", n_partitions: int = 3, pca: float | None = None, seed: int = 42) -> None:
        self.settings = {"key": key, "features": features, "target": target, "n_partitions": n_partitions, "pca": pca, "seed": seed}
        self.models: list[Ridge] = []

    def fit(self, df: DataFrame) -> Regressor:
        s = self.settings
        check_input(df, label=s["target"], key=s["key"], fit=False)
        n = s["n_partitions"]
        dealt = folds(df.select(s["key"], s["target"], s["features"]), s["key"], n, s["seed"])
        # a partition has all rows but those of its fold
        parts = F.array(F.lit(0)) if n == 1 else F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i != F.col("fold"))
        rows = dealt.withColumn("_part", F.explode(parts)).persist()
        made = fit_ridge(rows, s["features"], s["target"], "_part", share=s["pca"])
        rows.unpersist()
        self.models = [made[i] for i in sorted(made)]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", mean_score(self.models, self.settings["features"]))

    def save(self, spark: SparkSession, folder: str) -> None:
        save_models(spark, folder, self.models, self.settings)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Regressor:
        meta = read_json(spark, f"{folder}/metadata.json")
        out = cls(**{k: v for k, v in meta.items() if k != "partitions"})
        out.models = load_models(spark, folder, "ridge", meta["partitions"])
        return out
