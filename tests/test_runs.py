import pytest
from pyspark.sql import functions as F

from corvane.__main__ import main
from corvane.operators import blocking, features, metrics, model
from corvane.plans import pipeline, views
from corvane.sources import readers
from corvane.streaming.queries import candidates_of_stream


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return views.entities(spark, sf_dir).cache(), readers.true_pairs(views.truth(spark, sf_dir)).cache()


@pytest.mark.parametrize("name", sorted(pipeline.VARIANTS))
def test_variants_end_to_end(spark, data, name, tmp_path):
    entities, truth = data
    variant = pipeline.VARIANTS[name]
    kind, fitted, t, _ = pipeline.train(entities, truth, variant, [model.FOREST], small=True)
    made = pipeline.run(entities, fitted, variant).cache()
    assert made.count() == entities.where("source = 1").count()
    assert made.where(F.size(F.array_except("matches", "candidates")) > 0).count() == 0
    found = made.select("source1_id", F.explode("matches").alias("candidate_id"))
    required = made.select("source1_id")
    assert metrics.evaluate(found, truth, required).first()["micro_precision"] > 0.6


def test_files_and_command_line(spark, data, tmp_path):
    entities, truth = data
    paths = []
    for n in (1, 2, 3):
        path = str(tmp_path / f"s{n}")
        entities.where(F.col("source") == n).select("entity_id", "business_name", "business_address", "country").write.csv(path, sep="\t", header=True)
        paths.append(path)
    variant = pipeline.VARIANTS["combined"]
    _, fitted, t, _ = pipeline.train(entities, truth, variant, [model.FOREST], small=True)
    model.save(spark, fitted, str(tmp_path / "model"), features.COMBINED_FEATURES, t)
    sources = [x for n, p in enumerate(paths, 1) for x in (f"--source{n}", p)]
    out = str(tmp_path / "out")
    assert main(["run", *sources, "--model", str(tmp_path / "model"), "--out", out]) == 0
    assert main(["validate", "--matching", f"{out}/matching_results", "--candidates", f"{out}/candidate_pairs", "--source1", paths[0], "--check-ids", paths[1], paths[2]]) == 0
    assert main(["validate", "--matching", f"{out}/matching_results", "--source1", paths[1]]) == 1
    assert main(["candidates", *sources, "--out", str(tmp_path / "cand")]) == 0
    assert main(["predict", *sources, "--model", str(tmp_path / "model"), "--out", str(tmp_path / "pred")]) == 0
    assert spark.read.csv(str(tmp_path / "pred"), sep="\t", header=True).columns[-2:] == ["match_probability", "predicted_match"]


def test_a_stream_of_queries_gives_the_batch_result(spark, data, tmp_path):
    entities, _ = data
    entities.where("source = 1").repartition(3).write.parquet(str(tmp_path / "s1"))
    blocking.keys(blocking.normalized(entities.where("source <> 1"))).write.parquet(str(tmp_path / "keys"))
    stream = spark.readStream.schema(entities.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s1"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    started = candidates_of_stream(stream, keys, lambda df, n: df.write.parquet(str(tmp_path / f"out/{n}")), str(tmp_path / "cp"))
    assert started.awaitTermination(120)
    rows = lambda df: sorted((r["source1_id"], r["candidate_id"], r["blocking_rank"]) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out/*"))) == rows(blocking.candidates(blocking.normalized(entities)))
