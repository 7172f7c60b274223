"""Registered queries of the entity-resolution engine, one for each operator.

They run over whole tables.  Where an operator needs scored pairs, a
deterministic score (half name, half address edit similarity) stands in for a
trained model, so that SQL can compute the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import normalize as base
from corvane.functions import normalize_enhanced as enhanced
from corvane.functions import similarity as sim
from corvane.functions import vocab
from corvane.functions.text import ascii_fold, ngrams
from corvane.functions.text import is_indic as text_is_indic
from corvane.operators import blocking, decide, diagnose, features, metrics, model, stage, validate
from corvane.plans import pipeline, views
from corvane.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.normalized(views.entities(spark, sf_dir))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised rows, written once for queries that read them more than once."""
    return stage.written(_rows(spark, sf_dir), "rows")


def _rows_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.normalized_enhanced(views.entities(spark, sf_dir))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.true_pairs(views.truth(spark, sf_dir))


def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.entities(spark, sf_dir).where("source = 1").select(F.col("entity_id").alias("source1_id"))


def _joined(column: str | Column) -> Column:
    return F.array_join(F.array_sort(column), ",")


def _scored(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Ranked candidates with the deterministic probability and both sides' fields."""
    rows = _staged(spark, sf_dir) if rows is None else rows
    pairs = blocking.candidates(rows)
    fields = rows.select("entity_id", "source", F.struct("business_name", "norm_name", "core_name", "norm_addr", "norm_country", base.building_no(F.col("norm_addr")).alias("building")).alias("e"))
    out = features.attach(pairs, fields)
    a, b = F.col("a"), F.col("b")
    out = out.withColumns({"name_levenshtein": sim.levenshtein(a["norm_name"], b["norm_name"]), "address_levenshtein": sim.levenshtein(a["norm_addr"], b["norm_addr"])})
    return out.select(
        "source1_id", "candidate_id", "candidate_source", "blocking_rank", "name_levenshtein", (0.5 * F.col("name_levenshtein") + 0.5 * F.col("address_levenshtein")).alias("probability"),
        a["norm_name"].alias("norm_a"), b["norm_name"].alias("norm_b"), a["core_name"].alias("core_a"), b["core_name"].alias("core_b"),
        a["building"].alias("building_a"), b["building"].alias("building_b"), a["norm_country"].alias("norm_country"),
    )


# --- sources ---------------------------------------------------------------


@query
def true_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir)


@query
def na_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity cells under the loader's missing-value tokens, counted by column."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    token = F.element_at(F.array(*[F.lit(t) for t in vocab.NA_TOKENS]), (F.pmod(F.col("p_partkey"), F.lit(len(vocab.NA_TOKENS))) + 1).cast("int"))
    raw = part.select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(token).alias("business_name"))
    return readers.filled(raw).select("k", "business_name")


@query
def na_policies_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as tab-separated files and read as a run reads them: literal "null" stays in the targets."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    token = F.element_at(F.array(*[F.lit(t) for t in vocab.NA_TOKENS]), (F.pmod(F.col("p_partkey"), F.lit(len(vocab.NA_TOKENS))) + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(token)
    paths = []
    for n in (1, 2, 3):
        rows = part.select(F.concat(F.lit(f"S{n}-"), F.col("p_partkey").cast("string")).alias("entity_id"), name.alias("business_name"), F.col("p_brand").alias("business_address"), F.lit("US").alias("country"))
        paths.append(f"{stage.place(spark, 'source')}")
        rows.write.csv(paths[-1], sep="\t", header=True, emptyValue="", quote="")
    return pipeline.read_entities(spark, paths).select("entity_id", "business_name", "source")


@query
def truth_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth written as a file and read again."""
    path = stage.place(spark, "truth")
    views.truth(spark, sf_dir).write.csv(path, sep="\t", header=True, emptyValue="", quote="")
    return readers.true_pairs(readers.load_ground_truth(spark, path))


@query
def id_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the ids of a written entity table."""
    path = stage.place(spark, "source")
    views.entities(spark, sf_dir).select("entity_id", "business_name", "business_address", "country").write.csv(path, sep="\t", header=True, emptyValue="", quote="")
    return readers.ids(spark, path).distinct()


@query
def submission_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of both submission files, headers included once."""
    required = views.entities(spark, sf_dir).where("source = 1")
    scored = stage.written(_scored(spark, sf_dir).select("source1_id", "candidate_id", "candidate_source", "blocking_rank", "probability"), "pairs")
    made = decide.submission(decide.match_lists(decide.threshold(scored, 0.6), required), decide.candidate_lists(scored, required))
    folder = stage.place(spark, "submission")
    writers.submission(made, folder)
    lines = [spark.read.text(f"{folder}/{name}").select(F.lit(name).alias("file"), F.col("value").alias("line")).distinct() for name in ("matching_results", "candidate_pairs")]
    return lines[0].unionByName(lines[1])


@query
def semi_scan_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one country that some true pair names."""
    wanted = _truth(spark, sf_dir).select(F.col("candidate_id").alias("entity_id"))
    return readers.only(views.entities(spark, sf_dir), wanted, "USA").select("entity_id", "business_name")


@query
def semi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that some true pair names."""
    wanted = _truth(spark, sf_dir).select(F.col("candidate_id").alias("entity_id"))
    return readers.only(views.entities(spark, sf_dir), wanted).select("entity_id", "business_name")


@query
def benchmark_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matched and the first unmatched entities, by part number."""
    rows = views.truth(spark, sf_dir).withColumn("row", F.substring("source1_entity_id", 4, 12).cast("long"))
    return readers.benchmark_set(rows).select("source1_entity_id", "row")


# --- normalisers -----------------------------------------------------------


@query
def norm_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.entities(spark, sf_dir).select("entity_id", base.country(F.col("country")).alias("norm_country"))


@query
def norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("entity_id", "norm_name")


@query
def clean_core_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("entity_id", "core_name")


@query
def norm_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("entity_id", "norm_addr")


@query
def address_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("entity_id", base.address_key(F.col("norm_addr")).alias("address_key"))


@query
def norm_country_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.entities(spark, sf_dir).select("entity_id", enhanced.country(F.col("country")).alias("norm_country"))


@query
def norm_name_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_c(spark, sf_dir).select("entity_id", "norm_name", "core_name")


@query
def expand_abbrev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_c(spark, sf_dir).select("entity_id", "norm_addr")


@query
def postal_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_c(spark, sf_dir).select("entity_id", enhanced.postal_code(F.col("norm_addr"), F.col("norm_country")).alias("postal_code"))


@query
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("entity_id", _joined(base.numeric_tokens(F.col("norm_addr"))).alias("numbers"))


@query
def building_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("entity_id", base.building_no(F.col("norm_addr")).alias("building_no"))


@query
def building_no_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_c(spark, sf_dir).select("entity_id", enhanced.building_no(F.col("norm_addr")).alias("building_no"))


@query
def locality_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("entity_id", _joined(base.locality_tokens(F.col("norm_addr"))).alias("localities"))


@query
def locality_tokens_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_c(spark, sf_dir).select("entity_id", _joined(enhanced.localities(F.col("norm_addr"))).alias("localities"))


@query
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("entity_id", _joined(ngrams(F.col("norm_name"), 3)).alias("grams_3"), _joined(ngrams(F.col("norm_name"), 4)).alias("grams_4"))


@query
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    idf = features.token_idf(_rows(spark, sf_dir).where("source = 1"))
    return idf.select("token", F.round("idf", 9).alias("idf"))


# --- blocking --------------------------------------------------------------


def _keys_of(kind: str, variant: str = "base") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if variant == "base":
            return blocking.keys(_rows(spark, sf_dir), blocking.key_array(types=[kind]))
        return blocking.keys(_rows_c(spark, sf_dir), blocking.key_array_enhanced(types=[kind]))

    return run


KEYS_BASE = ["NP4", "NP6", "NCOMP", "TOK", "TOK3", "NSORT", "ADDR", "UNIT", "PLOT", "POSTAL", "ADDR_LOC"]
KEYS_ENHANCED = ["NPAIR", "ZIP_TOK", "NP4_ZIP"]
QUERIES |= {f"keys_{k.lower()}": _keys_of(k) for k in KEYS_BASE}
KEYS_SHARED = ["NP4", "NP6", "NCOMP", "TOK", "TOK3", "NSORT", "UNIT", "PLOT", "ADDR_LOC"]
QUERIES |= {f"keys_{k.lower()}": _keys_of(k, "enhanced") for k in KEYS_ENHANCED}
QUERIES |= {f"keys_enhanced_{k.lower()}": _keys_of(k, "enhanced") for k in KEYS_SHARED}


@query
def keys_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the keys of two strategies."""
    return blocking.keys(_rows(spark, sf_dir), blocking.key_array({"name_sorted", "address_key"}))


@query
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_sizes(blocking.keys(_rows(spark, sf_dir)).where("source <> 1"))


@query
def pruned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left of each key type when blocks over 100 rows go."""
    targets = stage.written(blocking.keys(_rows(spark, sf_dir).where("source <> 1")), "keys")
    kept = blocking.prune(targets, 100)
    return kept.groupBy("type").agg(F.count("*").alias("n"))


# --- candidates ------------------------------------------------------------


@query
def cand_count_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidates(_rows(spark, sf_dir), blocking.COUNTED, k=blocking.TOP_K_COUNT).select("source1_id", "candidate_id", "candidate_source", "blocking_score")


@query
def cand_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best candidates by weight."""
    return blocking.candidates(_rows(spark, sf_dir)).select("source1_id", "candidate_id", "candidate_source", "blocking_score", "blocking_rank")


@query
def cand_rank_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.candidates(_rows(spark, sf_dir), blocking.COUNTED, k=10).select("source1_id", "candidate_id", "blocking_rank", "blocking_score_ratio")


@query
def cand_compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compactness(blocking.candidates(_rows(spark, sf_dir), blocking.COUNTED, k=blocking.TOP_K_COUNT), _required(spark, sf_dir))


@query
def search_space_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = views.entities(spark, sf_dir)
    pairs = blocking.candidates(_rows(spark, sf_dir), blocking.COUNTED, k=blocking.TOP_K_COUNT)
    return metrics.search_space(pairs, every.where("source = 1"), every.where("source <> 1"))


# --- features --------------------------------------------------------------


def _features(names: list[str], variant: str = "base") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if variant == "base":
            rows = _staged(spark, sf_dir)
            pairs = blocking.candidates(rows)
            idf = None
        else:
            rows = stage.written(_rows_c(spark, sf_dir), "rows")
            pairs = blocking.candidates(rows, blocking.COUNTED, k=blocking.TOP_K, column=blocking.key_array_enhanced())
            idf = features.token_idf(rows.where("source = 1")) if "name_idf_weighted_jaccard" in names else None
        made = features.matrix(pairs, features.lookup(rows, variant, names), names, idf)
        return made.select("source1_id", "candidate_id", *[F.round(n, 9).alias(n) for n in names])

    return run


FEATURE_QUERIES = {
    "feat_exact": (["name_exact", "name_normalized_exact", "address_exact", "address_normalized_exact", "name_core_exact"], "base"),
    "feat_levenshtein": (["name_levenshtein", "address_levenshtein"], "base"),
    "feat_token_jaccard": (["name_jaccard", "address_jaccard"], "base"),
    "feat_overlap": (["name_token_overlap", "address_token_overlap", "common_name_tokens", "common_address_tokens"], "base"),
    "feat_3gram": (["name_char_3gram_jaccard", "address_char_3gram_jaccard"], "base"),
    "feat_4gram": (["name_char_4gram_jaccard"], "base"),
    "feat_lengths": (["name_length_difference", "address_length_difference", "name_token_count_difference", "address_token_count_difference"], "base"),
    "feat_contains": (["name_contains_other", "address_contains_other"], "base"),
    "feat_building": (["building_number_match"], "base"),
    "feat_locality": (["locality_match"], "base"),
    "feat_structured": (["country_match", "candidate_source_is_s2", "has_both_addresses", "either_address_empty"], "base"),
    "feat_numeric": (["numeric_token_overlap", "numeric_token_conflict"], "base"),
    "feat_first_token": (["name_first_token_match"], "base"),
    "feat_blocking": (["blocking_score", "blocking_rank", "blocking_score_ratio"], "base"),
    "feat_token_sort": (["name_token_sort_ratio"], "base"),
    "feat_token_set": (["name_token_set_ratio", "address_token_set_ratio"], "base"),
    "feat_matrix_base": (features.BASE_FEATURES, "base"),
    "feat_matrix_combined": (features.COMBINED_FEATURES, "base"),
    "feat_prefix": (["name_prefix_similarity", "name_rare_token_overlap", "postal_code_match"], "enhanced"),
    "feat_idf_jaccard": (["name_idf_weighted_jaccard", "name_prefix_similarity"], "enhanced"),
    "feat_matrix_enhanced": (features.ENHANCED_FEATURES, "enhanced"),
}
QUERIES |= {name: _features(*spec) for name, spec in FEATURE_QUERIES.items()}


@query
def feat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.labelled(blocking.candidates(_rows(spark, sf_dir)), _truth(spark, sf_dir)).select("source1_id", "candidate_id", "label")


# --- decisions -------------------------------------------------------------

T = 0.75


@query
def match_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.threshold(_scored(spark, sf_dir), T).select("source1_id", "candidate_id", "probability")


@query
def match_country_rank_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of variant A, by country and rank."""
    limit = decide.rank_threshold(decide.base_threshold(T, F.col("norm_country")), F.col("blocking_rank"))
    return decide.threshold(_scored(spark, sf_dir), limit).select("source1_id", "candidate_id")


@query
def match_country_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of variant B, by country."""
    return decide.threshold(_scored(spark, sf_dir), decide.country_threshold(F.col("norm_country"))).select("source1_id", "candidate_id")


@query
def veto_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(decide.branch_conflict(F.col("norm_a"), F.col("norm_b"))).select("source1_id", "candidate_id")


@query
def veto_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(decide.building_clash(F.col("building_a"), F.col("building_b"), F.col("core_a"), F.col("core_b"))).select("source1_id", "candidate_id")


@query
def cross_source_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.consistent(decide.threshold(_scored(spark, sf_dir), 0.5)).select("source1_id", "candidate_id")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = views.entities(spark, sf_dir).where("source = 1")
    return decide.match_lists(decide.threshold(_scored(spark, sf_dir), 0.6), required)


@query
def match_lists_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered match lists of every source-1 entity, empty ones included."""
    return _lists(spark, sf_dir).select("source1_id", F.array_join("matches", ",").alias("matches"))


@query
def candidate_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lists (of five) with matches that aren't among them appended."""
    required = views.entities(spark, sf_dir).where("source = 1")
    scored = stage.written(_scored(spark, sf_dir).select("source1_id", "candidate_id", "candidate_source", "blocking_rank", "probability"), "pairs")
    # five places, so that some matches lie outside the list and have to be appended
    narrow = scored.where("blocking_rank <= 5")
    made = decide.submission(decide.match_lists(decide.threshold(scored, 0.6), required), decide.candidate_lists(narrow, required))
    return made.select("source1_id", F.array_join("matches", ",").alias("matches"), F.array_join("candidates", ",").alias("candidates"))


@query
def max_prob_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.gated(_scored(spark, sf_dir), 0.5, 0.7).select("source1_id", "candidate_id")


@query
def weak_name_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.weak_name_guard(decide.threshold(_scored(spark, sf_dir), 0.5), 0.7).select("source1_id", "candidate_id")


# --- metrics ---------------------------------------------------------------


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entity_counts(decide.threshold(_scored(spark, sf_dir), 0.6), _truth(spark, sf_dir), _required(spark, sf_dir))


@query
def entity_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.entity_prf(_counts(spark, sf_dir))
    return made.select("source1_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f")])


MACRO = ["macro_f05", "macro_precision", "macro_recall", "singleton_accuracy", "non_singleton_macro_f05", "total_evaluated_s1", "true_singletons", "correct_singletons", "false_merges_on_singletons"]
MICRO = ["micro_precision", "micro_recall", "micro_f05", "total_tp_pairs", "total_fp_pairs", "total_fn_pairs"]


@query
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_counts(spark, sf_dir)).select(*MACRO)


@query
def micro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_counts(spark, sf_dir)).select(*MICRO)


@query
def metrics_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    land = _rows(spark, sf_dir).select(F.col("entity_id").alias("source1_id"), "norm_country")
    return metrics.summary(_counts(spark, sf_dir).join(land, "source1_id"), ["norm_country"]).select("norm_country", "macro_f05", "micro_f05", "total_evaluated_s1")


@query
def metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    passing = decide.threshold(_scored(spark, sf_dir), 0.6)
    return metrics.by_source(passing, _truth(spark, sf_dir), _required(spark, sf_dir)).select("candidate_source", *MACRO, *MICRO)


def _labelled(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    return features.labelled(_scored(spark, sf_dir, rows), _truth(spark, sf_dir))


@query
def pair_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pair_metrics(_labelled(spark, sf_dir), T)


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(_labelled(spark, sf_dir))


@query
def threshold_sweep_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep_pairs(_labelled(spark, sf_dir)).drop("accuracy")


@query
def threshold_sweep_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sweep_macro(_scored(spark, sf_dir), _truth(spark, sf_dir), _required(spark, sf_dir)).select("threshold", "macro_f05", "macro_precision", "macro_recall", "total_tp_pairs", "total_fp_pairs", "total_fn_pairs")


@query
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = metrics.sweep_macro(_scored(spark, sf_dir), _truth(spark, sf_dir), _required(spark, sf_dir))
    return metrics.best(swept, "macro_f05", ["threshold"]).select("threshold", "macro_f05")


@query
def country_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80]
    return metrics.country_grid(_scored(spark, sf_dir), _truth(spark, sf_dir), _required(spark, sf_dir), grid).select("t_us", "t_other", "macro_f05", "macro_precision", "macro_recall")


@query
def gate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.gate_grid(_scored(spark, sf_dir), _truth(spark, sf_dir), _required(spark, sf_dir), [0.50, 0.55, 0.60, 0.65, 0.70, 0.75], [0.0, 0.05, 0.10, 0.15, 0.20])
    return made.select("t_base", "gap", "macro_f05", "singleton_accuracy", "non_singleton_macro_f05")


@query
def blocking_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.blocking_recall(blocking.candidates(_rows(spark, sf_dir)), _truth(spark, sf_dir), _required(spark, sf_dir))


@query
def recall_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_decomposition(_scored(spark, sf_dir), _truth(spark, sf_dir), T)


# --- diagnostics -----------------------------------------------------------


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates under a tight block cap and few places: with the production ones no true pair of these tables is missed."""
    return blocking.candidates(_rows(spark, sf_dir), max_block=3, k=2)


@query
def missed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.missed(_truth(spark, sf_dir), _narrow(spark, sf_dir))


@query
def miss_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _staged(spark, sf_dir)
    return diagnose.miss_reasons(_truth(spark, sf_dir), blocking.candidates(rows, max_block=3, k=2), rows, 3).groupBy("category").agg(F.count("*").alias("n"))


@query
def miss_reasons_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs lost for every reason that can occur, with their names and addresses."""
    rows = stage.written(blocking.normalized(views.lost(spark, sf_dir)), "rows")
    truth = rows.where("source = 1").select(F.col("entity_id").alias("source1_id"), F.concat(F.lit("S2-"), F.col("number").cast("string")).alias("candidate_id"))
    found = diagnose.miss_reasons(truth, truth.limit(0), rows, 3)
    sided = diagnose.sided(found, rows)
    return sided.select("source1_id", "candidate_id", "category", F.col("a.business_name").alias("source1_name"), F.col("b.business_name").alias("candidate_name"), F.col("a.business_address").alias("source1_address"), F.col("b.business_address").alias("candidate_address"))


@query
def error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _staged(spark, sf_dir)
    made = diagnose.errors(stage.written(_labelled(spark, sf_dir, rows).select("source1_id", "candidate_id", "probability", "label"), "pairs"), rows, T, None)
    return made.groupBy("kind", "pattern").agg(F.count("*").alias("n"))


@query
def error_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _staged(spark, sf_dir)
    pairs = stage.written(_scored(spark, sf_dir, rows).select("source1_id", "candidate_id", "probability"), "pairs")
    return diagnose.error_buckets(pairs, _truth(spark, sf_dir), rows, 0.7, 0.5)


@query
def difficulty_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.difficulty(_truth(spark, sf_dir), _staged(spark, sf_dir)).groupBy("difficulty").agg(F.count("*").alias("n"))


@query
def strategy_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.strategies(spark, _rows(spark, sf_dir), _truth(spark, sf_dir))


@query
def validator_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules broken by lines made from orders: repeats, self-matches, bad prefixes and missing rows occur among them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s1 = F.concat(F.lit("S1-"), F.col("o_custkey").cast("string"))
    ids = F.concat(F.lit("S2-"), (F.col("o_orderkey") % 50).cast("string"), F.lit(",S"), (F.col("o_orderkey") % 4).cast("string"), F.lit("-"), (F.col("o_orderkey") % 30).cast("string"))
    lines = orders.select(F.when(F.col("o_orderkey") % 97 == 0, s1).otherwise(F.concat(s1, F.lit("\t"), ids)).alias("value"))
    required = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("source1_id"))
    made = validate.list_violations(validate.parse(lines), required)
    return made.groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query
def validator_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that whole files break, each over files of its own: header, emptiness, absence, candidates."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    required = customers.select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("source1_id"))
    key = F.col("c_custkey").cast("string")
    lines = {
        "good": F.concat(F.lit("S1-"), key, F.lit("\tS2-"), key, F.when(F.col("c_custkey") % 5 == 0, ",S2-7").otherwise("")),
        "given": F.concat(F.lit("S1-"), key, F.lit("\tS2-"), key),
    }
    tab, comma = "source1_entity_id\t{}", "source1_entity_id,matched_entity_ids"
    files = {
        "good": (tab.format("matched_entity_ids"), lines["good"]),
        "given": (tab.format("candidate_entity_ids"), lines["given"]),
        "commas": (comma, lines["good"]),
        "header": (tab.format("ids"), lines["good"]),
        "empty": (None, None),
    }
    paths = {"absent": stage.place(spark, "absent")}
    for name, (head, body) in files.items():
        paths[name] = stage.place(spark, name)
        rows = spark.createDataFrame([], "value string") if body is None else spark.createDataFrame([(head,)], "value string").unionByName(customers.select(body.alias("value")))
        rows.coalesce(1).write.text(paths[name])  # one file, its header first
    known = required.select(F.concat(F.lit("S2-"), F.substring("source1_id", 4, 20)).alias("entity_id"))
    cases = [("good", "given", known), ("good", None, None), ("commas", "header", known), ("empty", "absent", known)]
    out = None
    for n, (matching, candidates, ids) in enumerate(cases):
        made = validate.validate(spark, paths[matching], required, None if candidates is None else paths[candidates], ids)
        made = made.groupBy("rule", "severity").agg(F.count("*").alias("n")).select(F.lit(n).alias("case"), "rule", "severity", "n")
        out = made if out is None else out.unionByName(made)
    return out


# --- a second view: heads of prose documents -------------------------------


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.normalized(views.documents(spark, sf_dir))


@query
def prose_norm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose(spark, sf_dir).select("entity_id", ascii_fold(F.col("norm_name")).alias("norm_name"), ascii_fold(F.col("core_name")).alias("core_name"))


@query
def prose_norm_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose(spark, sf_dir).select("entity_id", ascii_fold(F.col("norm_addr")).alias("norm_addr"))


@query
def prose_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of repeated heads: the cap of 20 rows drops the largest."""
    return blocking.candidates(_prose(spark, sf_dir), blocking.COUNTED, max_block=20, k=10, column=blocking.key_array({"name_prefix_4", "name_prefix_6", "name_compressed", "name_tokens"})).select("source1_id", "candidate_id", "blocking_score", "blocking_rank")


@query
def is_indic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names beside the same names with a word of an Indic script after every third."""
    scripts = F.array(*[F.lit(w) for w in ("टेक", "বাংলা", "ਪੰਜਾਬ", "ગુજ", "தமிழ்", "తెలుగు", "ಕನ್ನಡ", "മലയാളം")])
    name = F.when(F.col("number") % 3 == 0, F.concat("business_name", F.lit(" "), F.element_at(scripts, (F.col("number") % 8 + 1).cast("int")))).otherwise(F.col("business_name"))
    return views.entities(spark, sf_dir).select("entity_id", text_is_indic(name).alias("is_indic"))


# --- models ----------------------------------------------------------------


@query
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.group_split(_required(spark, sf_dir), 0.2)


def _labelled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the combined features and labels, written once: every fit reads them many times."""
    rows, names = _staged(spark, sf_dir), features.COMBINED_FEATURES
    # labels are joined to the narrow pairs: the features never move for them
    pairs = features.labelled(blocking.candidates(rows), _truth(spark, sf_dir))
    return stage.written(features.matrix(pairs, features.lookup(rows, names=names), names), "matrix")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made, held = _labelled_matrix(spark, sf_dir), metrics.held_out(0.2)  # a filter: each of a fit's many reads is one scan
    return made.where(~held), made.where(held)


def _model(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, held = _split(spark, sf_dir)
        fitted = model.fit(train, features.COMBINED_FEATURES, kind)
        return model.score(fitted, held, 0.5, 6).select("source1_id", "candidate_id", "label", "match_probability", "predicted_match")

    return run


QUERIES |= {"logreg_scores": _model(model.LOGISTIC), "forest_scores": _model(model.FOREST), "gbt_scores": _model(model.BOOSTED_COMBINED)}


@query
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds of model at their best thresholds on held-out entities."""
    train, held = _split(spark, sf_dir)
    return model.choose(train, held, features.COMBINED_FEATURES, [model.LOGISTIC, model.FOREST, model.HISTOGRAM, model.BOOSTED])[3]


@query
def feature_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each group of features is worth to a forest."""
    train, held = _split(spark, sf_dir)
    groups = {"name": features.NAME_FEATURES, "address": features.ADDRESS_FEATURES, "base": features.BASE_FEATURES, "combined": features.COMBINED_FEATURES}
    return model.ablation(train, held, groups, model.FOREST)


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, names = _labelled_matrix(spark, sf_dir), features.COMBINED_FEATURES
    return model.importances(spark, model.fit(made, names, model.BOOSTED_COMBINED), names)
