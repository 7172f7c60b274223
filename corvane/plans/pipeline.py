"""Whole runs: candidates, features, probabilities, decisions, files.

Three variants differ in normaliser, keys, score, number of candidates,
features and decision rules; ``VARIANTS`` has their settings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import normalize as base
from corvane.functions import vocab
from corvane.operators import blocking, decide, features, metrics, model, stage, validate
from corvane.sources import readers, writers


@dataclass(frozen=True)
class Variant:
    """Settings of one kind of run."""

    normalize: Callable[[DataFrame], DataFrame]
    keys: Callable[[], Column]
    score: str
    k: int
    features: list[str]
    lookup: str = "base"
    idf: bool = False
    max_block: int = blocking.MAX_BLOCK
    threshold: float = vocab.BASE_OTHER
    by_rank: bool = False
    by_country: dict[str, float] | None = None
    vetoes: bool = False
    gate: float | None = None
    weights: dict[str, float] | None = field(default=None)


VARIANTS = {
    "weighted": Variant(blocking.normalized, blocking.key_array, blocking.WEIGHTED, blocking.TOP_K, features.BASE_FEATURES, by_rank=True, vetoes=True),
    "combined": Variant(blocking.normalized, blocking.key_array, blocking.COUNTED, blocking.TOP_K_COUNT, features.COMBINED_FEATURES, by_country=vocab.COUNTRY_THRESHOLDS, threshold=vocab.OTHER_THRESHOLD),
    "enhanced": Variant(blocking.normalized_enhanced, blocking.key_array_enhanced, blocking.COUNTED, blocking.TOP_K_COUNT, features.ENHANCED_FEATURES, "enhanced", idf=True),
}


def candidates(entities: DataFrame, variant: Variant) -> tuple[DataFrame, DataFrame]:
    """Normalised rows and ranked candidate pairs of ``entities`` (with a source column)."""
    rows = stage.written(variant.normalize(entities), "rows")
    return rows, blocking.candidates(rows, variant.score, variant.max_block, variant.k, variant.keys(), variant.weights)


def feature_rows(entities: DataFrame, variant: Variant) -> tuple[DataFrame, DataFrame]:
    """Normalised rows and candidate pairs with features and blocking columns."""
    rows, pairs = candidates(entities, variant)
    idf = features.token_idf(rows.where("source = 1")) if variant.idf else None
    made = features.matrix(pairs, features.lookup(rows, variant.lookup, variant.features), variant.features, idf)
    return rows, made


def train(entities: DataFrame, truth: DataFrame, variant: Variant, kinds: list[str], share: float = 0.2, small: bool = False) -> tuple[str, object, float, DataFrame]:
    """The best model of ``kinds`` on entities that it has not learned from, with its threshold and the comparison."""
    made = features.labelled(feature_rows(entities, variant)[1], truth)
    split = made.join(metrics.group_split(made, share), "source1_id").persist()
    try:
        return model.choose(split.where("not held_out"), split.where("held_out"), variant.features, kinds, small)
    finally:
        split.unpersist()


def decided(scored: DataFrame, rows: DataFrame, variant: Variant) -> DataFrame:
    """The scored pairs that pass the variant's thresholds and vetoes."""
    about = rows.select("entity_id", F.struct("norm_name", "core_name", "norm_country", base.building_no(F.col("norm_addr")).alias("building")).alias("e"))
    sided = features.attach(scored, about)
    country = F.col("a.norm_country")
    limit = F.lit(variant.threshold)
    if variant.by_rank:
        limit = decide.rank_threshold(decide.base_threshold(variant.threshold, country), F.col("blocking_rank"))
    elif variant.by_country:
        limit = decide.country_threshold(country, variant.by_country, variant.threshold)
    kept = decide.threshold(sided, limit)
    if variant.vetoes:
        kept = kept.where(~decide.branch_conflict(F.col("a.norm_name"), F.col("b.norm_name")))
        kept = kept.where(~decide.building_clash(F.col("a.building"), F.col("b.building"), F.col("a.core_name"), F.col("b.core_name")))
        kept = decide.consistent(kept.withColumn("building_b", F.coalesce(F.col("b.building"), F.lit(""))))
    if variant.gate is not None:
        kept = decide.gated(kept, 0.0, variant.gate)
    return kept.select("source1_id", "candidate_id", "candidate_source", "probability")


def run(entities: DataFrame, fitted, variant: Variant, most: int | None = None, predictions: DataFrame | None = None) -> DataFrame:
    """(source1_id, matches, candidates) of every source-1 entity.

    ``predictions`` (with probability) may be given instead of being made.
    """
    if predictions is None:
        rows, made = feature_rows(entities, variant)
        scored = model.score(fitted, made)
    else:
        rows, scored = variant.normalize(entities), predictions
        if "blocking_rank" not in scored.columns:
            scored = scored.withColumn("blocking_rank", F.lit(1.0))
    required = entities.where("source = 1")
    scored = scored.select("source1_id", "candidate_id", "candidate_source", "blocking_rank", "probability")
    matches = decide.match_lists(decided(scored, rows, variant), required, most)
    return decide.submission(matches, decide.candidate_lists(scored, required))


#: How missing cells are read in a run: by the loader's tokens in source 1; in the targets only
#: empty cells are missing, so that a business called "Null" keeps its name.
RUN_POLICIES = (readers.NA_LOADER, readers.NA_NONE, readers.NA_NONE)


def read_entities(spark: SparkSession, paths: list[str], policies: tuple[str, ...] = RUN_POLICIES) -> DataFrame:
    """The entity tables of sources 1, 2, 3 as one, with a source column."""
    out = None
    for number, (path, policy) in enumerate(zip(paths, policies, strict=True), 1):
        own = readers.load_source(spark, path, policy=policy).withColumn("source", F.lit(number))
        out = own if out is None else out.unionByName(own)
    return out


def run_files(spark: SparkSession, paths: list[str], model_path: str, out: str, variant: str = "combined", threshold: float | None = None) -> dict[str, int]:
    """Reads three sources and a saved model, writes both submission files and checks them."""
    fitted, names, t = model.load(spark, model_path, threshold)
    chosen = VARIANTS[variant]
    if names != chosen.features:
        raise ValueError("the model was fitted on other features")
    if not chosen.by_country:
        chosen = Variant(**{**chosen.__dict__, "threshold": t})
    entities = read_entities(spark, paths).persist()
    made = run(entities, fitted, chosen).persist()
    rows, links = writers.submission(made, out, "source1_id")
    required = entities.where("source = 1").select(F.col("entity_id").alias("source1_id"))
    bad = validate.validate(spark, f"{out}/matching_results", required, f"{out}/candidate_pairs", entities.where("source <> 1").select("entity_id")).where(F.col("severity") == validate.ERROR).count()
    return {"rows": rows, "links": links, "violations": bad}
