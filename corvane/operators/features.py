"""Pairwise features: 26 base ones, 37 combined and 41 enhanced.

Token, n-gram and number arrays are made once for each entity; pairs look them
up by two joins.  A pair with an unknown side has 0 in every feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import normalize as base
from corvane.functions import normalize_enhanced as enhanced
from corvane.functions import similarity as sim
from corvane.functions import vocab
from corvane.functions.text import among, first, ngrams, text, tokens, trigram_codes

NAME_FEATURES = [
    "name_exact", "name_normalized_exact", "name_levenshtein", "name_jaccard", "name_token_overlap", "name_token_set_ratio",
    "name_char_3gram_jaccard", "name_length_difference", "name_token_count_difference", "common_name_tokens", "name_contains_other",
]
ADDRESS_FEATURES = [
    "address_exact", "address_normalized_exact", "address_levenshtein", "address_jaccard", "address_token_overlap", "address_token_set_ratio",
    "address_char_3gram_jaccard", "address_length_difference", "address_token_count_difference", "common_address_tokens", "address_contains_other",
    "building_number_match", "locality_match",
]
OTHER_FEATURES = ["country_match", "candidate_source_is_s2"]
BASE_FEATURES = NAME_FEATURES + ADDRESS_FEATURES + OTHER_FEATURES
BLOCKING_FEATURES = ["blocking_score", "blocking_rank", "blocking_score_ratio"]
COMBINED_FEATURES = [
    *BASE_FEATURES, "name_core_exact", "name_token_sort_ratio", "name_char_4gram_jaccard", "name_first_token_match",
    "numeric_token_overlap", "numeric_token_conflict", "has_both_addresses", "either_address_empty", *BLOCKING_FEATURES,
]
ENHANCED_FEATURES = [
    *NAME_FEATURES, "name_core_exact", "name_token_sort_ratio", "name_char_4gram_jaccard", "name_prefix_similarity", "name_first_token_match",
    "name_rare_token_overlap", "name_idf_weighted_jaccard", *ADDRESS_FEATURES, "postal_code_match", "numeric_token_overlap",
    "numeric_token_conflict", "has_both_addresses", "either_address_empty", *OTHER_FEATURES, *BLOCKING_FEATURES,
]


class Side:
    """One side of a pair; notes which of an entity's fields the features use."""

    def __init__(self, name: str) -> None:
        self.name, self.used = name, set()

    def __getitem__(self, field: str) -> Column:
        self.used.add(field)
        return F.col(f"{self.name}.{field}")


def _fields(variant: str) -> dict[str, Callable[[], Column]]:
    c = enhanced if variant == "enhanced" else base
    name, core, addr = text("norm_name"), text("core_name"), text("norm_addr")
    return {
        "raw_name": lambda: text("business_name"),
        "raw_addr": lambda: text("business_address"),
        "norm_name": lambda: name,
        "core_name": lambda: core,
        "norm_addr": lambda: addr,
        "country": lambda: text("norm_country"),
        "name_count": lambda: F.size(tokens(name)),
        "name_first": lambda: first(tokens(name)),
        "name_sorted": lambda: F.array_join(F.array_sort(tokens(name)), " "),
        "name_words": lambda: F.array_sort(F.array_distinct(tokens(name))),
        "core_first": lambda: first(tokens(core)),
        "core_words": lambda: F.array_distinct(tokens(core)),
        "addr_count": lambda: F.size(tokens(addr)),
        "addr_words": lambda: F.array_sort(F.array_distinct(tokens(addr))),
        "name_3": lambda: trigram_codes(name),
        "name_4": lambda: ngrams(name, 4),
        "addr_3": lambda: trigram_codes(addr),
        "building": lambda: c.building_no(addr),
        "localities": lambda: enhanced.localities(addr) if variant == "enhanced" else base.locality_tokens(addr),
        "numbers": lambda: base.numeric_tokens(addr),
        "postal": lambda: enhanced.postal_code(addr, F.col("norm_country")),
    }


def _is_enhanced(names: list[str]) -> bool:
    return bool(set(names) & {"name_prefix_similarity", "postal_code_match", "name_rare_token_overlap", "name_idf_weighted_jaccard"})


def _made(a: Side, b: Side, names: list[str], weights: Column | None = None) -> dict[str, Column]:
    """The named features alone, in order; blocking features are left out."""
    every = name_features(a, b) | address_features(a, b) | other_features(a, b)
    if _is_enhanced(names):
        every |= enhanced_features(a, b, weights)
    return {n: every[n]() for n in names if n in every}


def lookup(rows: DataFrame, variant: str = "base", names: list[str] | None = None) -> DataFrame:
    """(entity_id, e, and source if given): the fields of each normalised row that the named features (all of them by default) use."""
    a, b = Side("a"), Side("b")
    _made(a, b, names or (ENHANCED_FEATURES if variant == "enhanced" else COMBINED_FEATURES))
    known = _fields(variant)
    fields = [known[k]().alias(k) for k in known if k in a.used | b.used]
    known_source = ["source"] if "source" in rows.columns else []
    return rows.select("entity_id", *known_source, F.struct(*fields or [F.lit(True).alias("known")]).alias("e"))


def document_frequency(rows: DataFrame) -> DataFrame:
    """(token, df): in how many core names each word is."""
    return rows.select(F.explode(F.array_distinct(tokens(text("core_name")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def token_idf(rows: DataFrame) -> DataFrame:
    """(token, idf): ln((N + 1) / (df + 1)) + 1 over the rows' core names."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return document_frequency(rows).crossJoin(F.broadcast(total)).select("token", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def attach(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Adds the two sides a and b (null where an id is unknown).

    Where ``fields`` have a source column, each side makes the fields of its own sources alone.
    """
    own, others = (fields.where("source = 1"), fields.where("source <> 1")) if "source" in fields.columns else (fields, fields)
    left = own.select(F.col("entity_id").alias("source1_id"), F.col("e").alias("a"))
    right = others.select(F.col("entity_id").alias("candidate_id"), F.col("e").alias("b"))
    return pairs.join(left, "source1_id", "left").join(right, "candidate_id", "left")


def name_features(a: Side, b: Side) -> dict[str, Callable[[], Column]]:
    def same(field: str) -> Column:
        return sim.flag((a[field] == b[field]) & (a[field] != ""))

    return {
        "name_exact": lambda: same("raw_name"),
        "name_normalized_exact": lambda: same("norm_name"),
        "name_levenshtein": lambda: sim.levenshtein(a["norm_name"], b["norm_name"]),
        "name_jaccard": lambda: sim.jaccard(a["core_words"], b["core_words"]),
        "name_token_overlap": lambda: sim.overlap(a["core_words"], b["core_words"]),
        "name_token_set_ratio": lambda: sim.token_set_ratio(a["name_words"], b["name_words"]),
        "name_char_3gram_jaccard": lambda: sim.jaccard(a["name_3"], b["name_3"]),
        "name_length_difference": lambda: F.abs(F.char_length(a["norm_name"]) - F.char_length(b["norm_name"])).cast("double"),
        "name_token_count_difference": lambda: F.abs(a["name_count"] - b["name_count"]).cast("double"),
        "common_name_tokens": lambda: F.size(F.array_intersect(a["core_words"], b["core_words"])).cast("double"),
        "name_contains_other": lambda: sim.contains_other(a["norm_name"], b["norm_name"]),
        "name_core_exact": lambda: same("core_name"),
        "name_token_sort_ratio": lambda: sim.token_sort_ratio(a["name_sorted"], b["name_sorted"]),
        "name_char_4gram_jaccard": lambda: sim.jaccard(a["name_4"], b["name_4"]),
        "name_first_token_match": lambda: same("name_first"),
    }


def address_features(a: Side, b: Side) -> dict[str, Callable[[], Column]]:
    def common(field: str) -> Column:
        return F.size(F.array_intersect(a[field], b[field]))

    def both(field: str) -> Column:
        return (F.size(a[field]) > 0) & (F.size(b[field]) > 0)

    def locality() -> Column:
        return sim.bind(common("localities"), lambda n: F.when(~both("localities"), 0.5).when(n >= 2, 1.0).when(n == 1, 0.75).otherwise(0.0))

    return {
        "address_exact": lambda: sim.flag((a["raw_addr"] == b["raw_addr"]) & (a["raw_addr"] != "")),
        "address_normalized_exact": lambda: sim.flag((a["norm_addr"] == b["norm_addr"]) & (a["norm_addr"] != "")),
        "address_levenshtein": lambda: sim.levenshtein(a["norm_addr"], b["norm_addr"]),
        "address_jaccard": lambda: sim.jaccard(a["addr_words"], b["addr_words"]),
        "address_token_overlap": lambda: sim.overlap(a["addr_words"], b["addr_words"]),
        "address_token_set_ratio": lambda: sim.token_set_ratio(a["addr_words"], b["addr_words"]),
        "address_char_3gram_jaccard": lambda: sim.jaccard(a["addr_3"], b["addr_3"]),
        "address_length_difference": lambda: F.abs(F.char_length(a["norm_addr"]) - F.char_length(b["norm_addr"])).cast("double"),
        "address_token_count_difference": lambda: F.abs(a["addr_count"] - b["addr_count"]).cast("double"),
        "common_address_tokens": lambda: common("addr_words").cast("double"),
        "address_contains_other": lambda: sim.contains_other(a["norm_addr"], b["norm_addr"]),
        "building_number_match": lambda: sim.unless_missing(a["building"], b["building"]),
        "locality_match": locality,
        "numeric_token_overlap": lambda: F.when(both("numbers"), common("numbers").cast("double")).otherwise(0.0),
        "numeric_token_conflict": lambda: sim.flag(both("numbers") & ~F.arrays_overlap(a["numbers"], b["numbers"])),
        "has_both_addresses": lambda: sim.flag((a["norm_addr"] != "") & (b["norm_addr"] != "")),
        "either_address_empty": lambda: sim.flag((a["norm_addr"] == "") | (b["norm_addr"] == "")),
    }


def other_features(a: Side, b: Side) -> dict[str, Callable[[], Column]]:
    return {
        "country_match": lambda: sim.flag((a["country"] == b["country"]) & (a["country"] != "")),
        "candidate_source_is_s2": lambda: sim.flag(F.col("candidate_source") == "source2"),
    }


def enhanced_features(a: Side, b: Side, idf: Column | None) -> dict[str, Callable[[], Column]]:
    def prefix() -> Column:
        p, q = (F.replace(x["core_name"], F.lit(" "), F.lit("")) for x in (a, b))

        def same(n: int) -> Column:
            return (F.char_length(p) >= n) & (F.char_length(q) >= n) & (F.substring(p, 1, n) == F.substring(q, 1, n))

        return F.when(same(4), 1.0).when(same(3), 0.5).otherwise(0.0)

    def rare() -> Column:
        return F.size(F.filter(F.array_intersect(a["core_words"], b["core_words"]), lambda t: (F.char_length(t) >= 4) & ~among(t, vocab.GENERIC_TERMS_ENHANCED))).cast("double")

    def weighted() -> Column:
        x, y = a["core_words"], b["core_words"]
        if idf is None:
            return sim.jaccard(x, y)
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at(idf, t), F.lit(1.0)))
        both, every = total(F.array_sort(F.array_intersect(x, y))), total(F.array_sort(F.array_union(x, y)))
        return F.when((F.size(x) == 0) | (F.size(y) == 0) | (every <= 0), 0.0).otherwise(both / every)

    return {
        "name_prefix_similarity": prefix,
        "name_first_token_match": lambda: sim.flag((a["core_first"] == b["core_first"]) & (a["core_first"] != "")),
        "name_rare_token_overlap": rare,
        "postal_code_match": lambda: sim.unless_missing(a["postal"], b["postal"]),
        "name_idf_weighted_jaccard": weighted,
    }


def matrix(pairs: DataFrame, fields: DataFrame, names: list[str], idf: DataFrame | None = None) -> DataFrame:
    """``pairs`` with the named features.

    ``idf`` (token, idf) is only read for the enhanced features; each entity's
    own weights are joined to it beforehand, so no table that grows with the
    corpus is broadcast.
    """
    if idf is not None:
        own = fields.select("entity_id", F.explode("e.core_words").alias("token")).join(idf, "token")
        weights = own.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("w"))
        fields = fields.join(weights, "entity_id", "left").withColumn("e", F.col("e").withField("w", F.coalesce("w", F.create_map().cast("map<string,double>")))).drop("w")
    sided = attach(pairs, fields)
    a, b = F.col("a"), F.col("b")
    known = a.isNotNull() & b.isNotNull()
    weights = None if idf is None else F.map_concat(a["w"], F.map_filter(b["w"], lambda k, _: ~F.map_contains_key(a["w"], k)))
    made = _made(Side("a"), Side("b"), names, weights)
    for kept in BLOCKING_FEATURES:
        made[kept] = F.coalesce(F.col(kept), F.lit(1.0)) if kept in pairs.columns else F.lit(1.0)
    ids = [c for c in pairs.columns if c not in names]
    return sided.select(*ids, *[F.when(known, made[n]).otherwise(0.0).alias(n) for n in names])


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: 1 for the pairs (source1_id, candidate_id) of ``truth``."""
    marked = truth.select("source1_id", "candidate_id").distinct().withColumn("_true", F.lit(1))
    return pairs.join(marked, ["source1_id", "candidate_id"], "left").withColumn("label", F.coalesce("_true", F.lit(0))).drop("_true")
