import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corvane.operators import boosting, model
from corvane.plans import queries

NAMES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def rows(spark):
    few = spark.range(1500).selectExpr("id", *[f"cast(pmod(hash(id, {i}), {n}) as double) {c}" for i, (c, n) in enumerate(zip(NAMES, (29, 23, 5), strict=True))])
    return few.withColumn("label", F.expr("cast(x * x + y * y + z * 20 + pmod(hash(id, 9), 150) > 700 as int)")).cache()


def _jobs(spark, made):
    """How many jobs ``made`` takes."""
    group = f"jobs-{id(made)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        made()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("trees, depth, least", [(1, 1, 1), (4, 3, 25), (6, 6, 5)])
def test_trees_equal_those_of_spark_where_the_bins_do(spark, rows, trees, depth, least):
    made = GBTClassifier(maxIter=trees, maxDepth=depth, minInstancesPerNode=least, weightCol="weight", seed=1)
    table = VectorAssembler(inputCols=NAMES, outputCol="features").transform(model.weighted(rows))
    own, other = boosting.fit(rows, NAMES, model.balance(rows), made), made.fit(table)
    of = lambda m: np.array([r[0] for r in m.transform(table).orderBy("id").select(vector_to_array("probability")[1]).collect()])
    assert abs(of(own) - of(other)).max() < 1e-9
    assert own.totalNumNodes == other.totalNumNodes and own.treeWeights == other.treeWeights
    assert abs(own.featureImportances.toArray() - other.featureImportances.toArray()).max() < 1e-9


def test_jobs_of_a_boosted_fit_dont_grow_with_its_trees(spark, rows, monkeypatch):
    whole = model.estimator
    counts = []
    for n in (2, 8):
        monkeypatch.setattr(model, "estimator", lambda kind, small=False, n=n: whole(kind, small).setMaxIter(n).setMaxDepth(n))
        counts.append(_jobs(spark, lambda: model.fit(rows, NAMES, model.BOOSTED_COMBINED)))
    assert counts[0] == counts[1]


def test_odd_rows_of_a_boosted_fit(spark, rows, tmp_path):
    one = model.fit(rows.where("id = 3"), NAMES, model.BOOSTED, small=True)  # fewer rows than tasks
    assert one.stages[-1].totalNumNodes == 5
    same = model.fit(rows.where("label = 0"), NAMES, model.BOOSTED, small=True)
    assert model.score(same, rows).agg(F.max("probability")).first()[0] < 0.5
    with pytest.raises(Exception, match="no rows"):
        model.fit(rows.where("id < 0"), NAMES, model.BOOSTED, small=True)
    for odd in ("null", "double('NaN')"):
        with pytest.raises(Exception, match="null or NaN"):
            model.fit(rows.withColumn("y", F.expr(f"if(id = 7, {odd}, y)")), NAMES, model.BOOSTED, small=True)
    fitted = model.fit(rows, NAMES, model.BOOSTED_COMBINED, small=True)
    model.save(spark, fitted, str(tmp_path / "m"), NAMES, 0.5)
    again = model.load(spark, str(tmp_path / "m"))[0]
    sums = [model.score(m, rows).agg(F.sum(F.round("probability", 9))).first()[0] for m in (fitted, again)]
    assert sums[0] == pytest.approx(sums[1], abs=1e-6) and model.importances(spark, again, NAMES).count() == 3


def test_points_keep_the_weight_of_all_values():
    random = np.random.default_rng(0)
    values, weights = random.integers(0, 900, 5000).astype(float), random.random(5000)
    exact = boosting._squeeze(values, weights)
    assert len(exact[0]) == len(np.unique(values)) and exact[1].sum() == pytest.approx(weights.sum())
    few = boosting._squeeze(values, weights, most=100)
    assert len(few[0]) <= 100 and few[0][-1] == values.max() and few[1].sum() == pytest.approx(weights.sum())
    below = [weights[values <= v].sum() for v in few[0]]
    assert np.cumsum(few[1]) == pytest.approx(below)
    ends = boosting.edges(*exact, 32)
    shares = np.diff([0.0, *[weights[values <= e].sum() / weights.sum() for e in ends], 1.0])
    assert len(ends) == 31 and shares.max() < 1.2 / 32
    assert boosting.edges(np.array([1.0, 2.0, 4.0]), np.ones(3), 32) == [1.5, 3.0] and boosting.edges(np.ones(1), np.ones(1), 32) == []


def test_gbt_scores_learns_its_300_trees_in_a_few_jobs_and_scores_every_pair(spark, sf_dir, monkeypatch):
    made, whole = [], model.fit
    monkeypatch.setattr(model, "fit", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    rows = []
    assert _jobs(spark, lambda: rows.extend(queries.QUERIES["gbt_scores"](spark, sf_dir).collect())) < 150
    last = made[0].stages[-1]
    assert last.getNumTrees == 300 and last.treeWeights[:2] == [1.0, 0.06]
    pairs = {(r["source1_id"], r["candidate_id"]) for r in queries._split(spark, sf_dir)[1].select("source1_id", "candidate_id").collect()}
    assert pairs and pairs == {(r["source1_id"], r["candidate_id"]) for r in rows} and len(rows) == len(pairs)
    right = sum(r["label"] == r["predicted_match"] for r in rows)
    assert right > 0.9 * len(rows)


def test_model_selection_compares_every_kind(spark, sf_dir, monkeypatch):
    whole, fit, seen = model.estimator, model.fit, []
    monkeypatch.setattr(model, "estimator", lambda kind, small=False: whole(kind, True))  # few trees
    monkeypatch.setattr(model, "fit", lambda rows, names, kind, small=False: seen.append((kind, small)) or fit(rows, names, kind, small))
    made = queries.QUERIES["model_selection"](spark, sf_dir).collect()
    assert [r["model"] for r in sorted(made, key=lambda r: -r["f05"])] == [r["model"] for r in made]
    assert sorted(r["model"] for r in made) == sorted({model.LOGISTIC, model.FOREST, model.HISTOGRAM, model.BOOSTED})
    assert len(seen) == 4 and not any(small for _, small in seen)
