"""Match classifiers on Spark ML: fit, choose, score, explain, save."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import vocab
from corvane.operators import boosting, metrics

#: Settings of each model; trees are Spark's level-wise ones.
LOGISTIC, FOREST, BOOSTED, BOOSTED_COMBINED, BOOSTED_ENHANCED, HISTOGRAM = "logistic", "forest", "boosted", "boosted_combined", "boosted_enhanced", "histogram"
SEED = 42


def estimator(kind: str, small: bool = False):
    """The unfitted classifier; ``small`` keeps its form with few trees, for tests."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    trees = lambda n: 5 if small else n
    if kind == LOGISTIC:
        return LogisticRegression(maxIter=30 if small else 1000, **common)
    if kind == FOREST:
        return RandomForestClassifier(numTrees=trees(100), maxDepth=5 if small else 12, seed=SEED, **common)
    settings = {HISTOGRAM: (150, 0.08, 10, 20, 1.0), BOOSTED: (200, 0.08, 8, 20, 1.0), BOOSTED_COMBINED: (300, 0.06, 9, 25, 0.85), BOOSTED_ENHANCED: (300, 0.06, 10, 20, 0.85)}
    n, rate, depth, least, share = settings[kind]
    return GBTClassifier(maxIter=trees(n), stepSize=rate, maxDepth=3 if small else depth, minInstancesPerNode=least, featureSubsetStrategy=str(share) if share < 1 else "all", seed=SEED, **common)


def balance(rows: DataFrame) -> tuple[float, float]:
    """Weights of a row of label 0 and of label 1 that balance the classes."""
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return n / (2 * max(1, n - pos)), n / (2 * max(1, pos))


def weighted(rows: DataFrame) -> DataFrame:
    """Adds a weight that balances the classes."""
    down, up = balance(rows)
    return rows.withColumn("weight", F.when(F.col("label") == 1, up).otherwise(down))


def fit(rows: DataFrame, names: list[str], kind: str = BOOSTED_COMBINED, small: bool = False) -> PipelineModel:
    """A fitted pipeline over the named feature columns and ``label``."""
    if kind == LOGISTIC:
        stages = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    else:
        stages = [VectorAssembler(inputCols=names, outputCol="features")]
    made = estimator(kind, small)
    # a barrier stage needs its tasks all at once, which Spark doesn't promise where executors come and go
    if isinstance(made, GBTClassifier) and rows.sparkSession.conf.get("spark.dynamicAllocation.enabled", "false") != "true":
        return PipelineModel(stages=[*stages, boosting.fit(rows, names, balance(rows), made)])
    return Pipeline(stages=[*stages, made]).fit(weighted(rows))


def score(model: PipelineModel, rows: DataFrame, t: float | None = None, digits: int | None = None) -> DataFrame:
    """Adds probability and, with a threshold, predicted_match (from the unrounded value) and match_probability."""
    made = model.transform(rows.withColumn("weight", F.lit(1.0)))
    out = made.withColumn("probability", vector_to_array("probability")[1]).select(*rows.columns, "probability")
    if t is not None:
        out = out.withColumn("predicted_match", (F.col("probability") >= t).cast("int"))
    return out if digits is None else out.withColumn("match_probability", F.round("probability", digits))


def choose(train: DataFrame, held: DataFrame, names: list[str], kinds: list[str], small: bool = False) -> tuple[str, PipelineModel, float, DataFrame]:
    """The kind of best F0.5 at its own best threshold, its model and threshold, and the comparison."""
    results = []
    for kind in kinds:
        model = fit(train, names, kind, small)
        top = metrics.best(metrics.sweep_pairs(score(model, held)), "f05", ["threshold"]).first()
        results.append((kind, float(top["threshold"]), float(top["f05"]), float(top["precision"]), float(top["recall"]), model))
    results.sort(key=lambda r: -r[2])
    compared = train.sparkSession.createDataFrame([r[:5] for r in results], "model string, threshold double, f05 double, precision double, recall double")
    return results[0][0], results[0][5], results[0][1], compared


def ablation(train: DataFrame, held: DataFrame, groups: dict[str, list[str]], kind: str = BOOSTED, small: bool = False) -> DataFrame:
    """F0.5 by feature group."""
    rows = []
    for group, names in groups.items():
        top = metrics.best(metrics.sweep_pairs(score(fit(train, names, kind, small), held)), "f05", ["threshold"]).first()
        rows.append((group, len(names), float(top["threshold"]), float(top["f05"])))
    return train.sparkSession.createDataFrame(rows, "features string, n int, threshold double, f05 double")


def importances(spark: SparkSession, model: PipelineModel, names: list[str], top: int = 15) -> DataFrame:
    """(feature, importance) of the strongest features."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    rows = sorted(zip(names, map(float, values), strict=True), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def save(spark: SparkSession, model: PipelineModel, path: str, names: list[str], threshold: float | None = None) -> None:
    """The fitted pipeline and its feature names and threshold, in one folder."""
    model.write().overwrite().save(f"{path}/model")
    note = json.dumps({"feature_names": names, "optimal_threshold": threshold})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str, threshold: float | None = None) -> tuple[PipelineModel, list[str], float]:
    """The saved pipeline, its features and the threshold: the given one, else the saved, else 0.75."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    chosen = threshold if threshold is not None else about["optimal_threshold"]
    return PipelineModel.load(f"{path}/model"), about["feature_names"], vocab.BASE_OTHER if chosen is None else chosen
