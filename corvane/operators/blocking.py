"""Blocking keys, block sizes and ranked candidate pairs.

A key has three columns (country, type, value) instead of one joined text, so
that country stays a plain join and partition column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import normalize as base
from corvane.functions import normalize_enhanced as enhanced
from corvane.functions import vocab
from corvane.functions.text import among, first, text, tokens
from corvane.operators import stage

#: Strategy names and the key types that they switch.
STRATEGIES = {
    "name_prefix_4": ["NP4"],
    "name_prefix_6": ["NP6"],
    "name_tokens": ["TOK"],
    "name_tokens_3": ["TOK3"],
    "name_sorted": ["NSORT"],
    "name_compressed": ["NCOMP"],
    "address_key": ["ADDR", "UNIT", "PLOT", "POSTAL"],
    "address_locality": ["ADDR_LOC"],
}
STRATEGIES_ENHANCED = {
    "name_prefix_4": ["NP4"],
    "name_prefix_6": ["NP6"],
    "name_tokens": ["TOK", "TOK3"],
    "name_sorted": ["NSORT"],
    "name_compressed": ["NCOMP"],
    "name_pairs": ["NPAIR"],
    "postal_code": ["ZIP_TOK"],
    "name_postal": ["NP4_ZIP"],
    "address_unit": ["UNIT", "PLOT"],
    "address_locality": ["ADDR_LOC"],
}
MAX_BLOCK, MAX_BLOCK_CLASS = 1000, 500
TOP_K, TOP_K_COUNT = 20, 300

_NONE = "array<struct<type:string,value:string>>"


def normalized(entities: DataFrame, guards: str = base.GUARDED) -> DataFrame:
    """Adds norm_name, core_name, norm_addr and norm_country (variants A and B)."""
    out = entities.withColumns({"norm_name": base.name(F.col("business_name"), guards), "norm_addr": base.address(F.col("business_address"), guards), "norm_country": base.country(F.col("country"))})
    return out.withColumn("core_name", base.core_name(F.col("norm_name")))


def normalized_enhanced(entities: DataFrame) -> DataFrame:
    """Adds the same columns as variant C has them."""
    out = entities.withColumns({"norm_name": enhanced.name(F.col("business_name")), "norm_addr": enhanced.address(F.col("business_address")), "norm_country": enhanced.country(F.col("country"))})
    return out.withColumn("core_name", enhanced.core_name(F.col("norm_name")))


def _key(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"))


def _one(kind: str, value: Column, condition: Column) -> Column:
    return F.when(condition, F.array(_key(kind, value))).otherwise(F.array().cast(_NONE))


def _each(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: _key(kind, v))


def _compressed(core: Column) -> Column:
    return F.replace(core, F.lit(" "), F.lit(""))


def _sorted_key(significant: Column) -> Column:
    return F.array_join(F.array_sort(F.slice(significant, 1, 4)), "_")


def _plain(t: Column) -> Column:
    return F.translate(t, "-/", "")


def _is_unit(t: Column) -> Column:
    plain = _plain(t)
    return F.char_length(plain).between(3, 8) & plain.rlike(r"\p{N}") & plain.rlike(r"\p{L}")


def _is_plot(t: Column) -> Column:
    return F.contains(t, F.lit("/")) & t.rlike(r"\p{N}") & (F.char_length(t) <= 8)


def _coded(addr: Column) -> Column:
    """Address tokens less ordinals such as 22nd."""
    return F.filter(tokens(addr), lambda t: ~_plain(t).rlike(rf"^\p{{N}}+(?:{'|'.join(vocab.ORDINALS)})$"))


def _locality_key(addr: Column, stop: list[str]) -> tuple[Column, Column]:
    words = F.filter(tokens(addr), lambda w: (F.char_length(w) >= 4) & w.rlike(r"^\p{L}+$") & ~among(w, stop))
    return F.array_join(F.slice(words, 1, 2), "_"), F.size(words) >= 2


def _chosen(parts: dict[str, Column], strategies: set[str] | None, table: dict[str, list[str]], wanted: list[str] | None) -> Column:
    """The distinct keys of the chosen strategies (none or an empty set means all), of the wanted types only."""
    types = {t for s, own in table.items() if not strategies or s in strategies for t in own if wanted is None or t in wanted}
    return F.array_distinct(F.concat(*[c for t, c in parts.items() if t in types] or [F.array().cast(_NONE)]))


def key_array(strategies: set[str] | None = None, types: list[str] | None = None) -> Column:
    """Distinct (type, value) keys of a normalised row, variant A."""
    core, addr = text("core_name"), text("norm_addr")
    compact, words = _compressed(core), tokens(core)
    size = F.char_length(compact)
    significant = F.filter(words, lambda t: (F.char_length(t) >= 3) & ~among(t, vocab.GENERIC_TERMS))
    long_words = F.filter(words, lambda t: (F.char_length(t) >= 4) & ~among(t, vocab.GENERIC_TERMS))
    short_words = F.filter(words, lambda t: t.rlike(r"^\p{L}{3}$") & ~among(t, vocab.GENERIC_TERMS) & ~among(t, vocab.ACRONYM_STOP))
    place = base.address_key(addr)
    coded = _coded(addr)
    postal = F.filter(coded, lambda t: ~_is_unit(t) & ~_is_plot(t) & t.rlike(r"^\p{N}{5,6}$"))
    locality, has_locality = _locality_key(addr, vocab.LOCALITY_KEY_STOP)
    parts = {
        "NP4": _one("NP4", F.substring(compact, 1, 4), size >= 4),
        "NP6": _one("NP6", F.substring(compact, 1, 6), size >= 6),
        "NCOMP": _one("NCOMP", compact, size >= 5),
        "TOK": _each("TOK", long_words),
        "TOK3": _each("TOK3", short_words),
        "NSORT": _one("NSORT", _sorted_key(significant), F.size(significant) >= 2),
        "ADDR": _one("ADDR", place, F.char_length(place) >= 3),
        "UNIT": F.transform(F.filter(coded, _is_unit), lambda t: _key("UNIT", _plain(t))),
        "PLOT": _each("PLOT", F.filter(coded, lambda t: ~_is_unit(t) & _is_plot(t))),
        "POSTAL": F.when(size >= 3, F.transform(postal, lambda t: _key("POSTAL", F.concat(t, F.lit("_"), F.substring(compact, 1, 3))))).otherwise(F.array().cast(_NONE)),
        "ADDR_LOC": _one("ADDR_LOC", locality, has_locality),
    }
    return _chosen(parts, strategies, STRATEGIES, types)


def key_array_enhanced(strategies: set[str] | None = None, types: list[str] | None = None) -> Column:
    """Distinct (type, value) keys of a normalised row, variant C."""
    core, addr = text("core_name"), text("norm_addr")
    compact = _compressed(core)
    size = F.char_length(compact)
    significant = F.filter(tokens(core), lambda t: (F.char_length(t) >= 3) & ~among(t, vocab.GENERIC_TERMS_ENHANCED))
    pairs = F.flatten(
        F.transform(
            F.slice(significant, 1, 3),
            lambda a, i: F.transform(F.filter(F.slice(significant, 1, 4), lambda b, j: j > i), lambda b: F.array_join(F.array_sort(F.array(a, b)), "_")),
        )
    )
    postal = enhanced.postal_code(addr, F.col("norm_country"))
    coded = _coded(addr)
    locality, has_locality = _locality_key(addr, vocab.LOCALITY_KEY_STOP_ENHANCED)
    parts = {
        "NP4": _one("NP4", F.substring(compact, 1, 4), size >= 4),
        "NP6": _one("NP6", F.substring(compact, 1, 6), size >= 6),
        "NCOMP": _one("NCOMP", compact, size >= 5),
        "TOK": _each("TOK", F.filter(significant, lambda t: F.char_length(t) >= 4)),
        "TOK3": _each("TOK3", F.filter(significant, lambda t: t.rlike(r"^\p{L}{3}$"))),
        "NSORT": _one("NSORT", _sorted_key(significant), F.size(significant) >= 2),
        "NPAIR": _each("NPAIR", pairs),
        "ZIP_TOK": _one("ZIP_TOK", F.concat(postal, F.lit("_"), first(significant)), (postal != "") & (F.size(significant) >= 1)),
        "NP4_ZIP": _one("NP4_ZIP", F.concat(F.substring(compact, 1, 4), F.lit("_"), postal), (postal != "") & (size >= 4)),
        "UNIT": F.transform(F.filter(coded, _is_unit), lambda t: _key("UNIT", _plain(t))),
        "PLOT": _each("PLOT", F.filter(coded, lambda t: ~_is_unit(t) & _is_plot(t))),
        "ADDR_LOC": _one("ADDR_LOC", locality, has_locality),
    }
    return _chosen(parts, strategies, STRATEGIES_ENHANCED, types)


def keys(rows: DataFrame, column: Column | None = None) -> DataFrame:
    """(country, type, value, entity_id, source): one row for each key of each normalised row."""
    found = rows.select("entity_id", "source", F.when(F.coalesce("norm_country", F.lit("")) == "", "UNKNOWN").otherwise(F.col("norm_country")).alias("country"), F.explode(key_array() if column is None else column).alias("k"))
    return found.select("country", "k.type", "k.value", "entity_id", "source")


def block_sizes(target_keys: DataFrame) -> DataFrame:
    """Rows of each block, both target sources pooled."""
    return target_keys.groupBy("country", "type", "value").agg(F.count("*").alias("size"))


def prune(target_keys: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """Target keys of blocks of at most ``max_block`` rows.

    Sizes come from a pre-aggregated count, not a window: an oversized block is
    dropped by the join without ever being gathered in one task.
    """
    small = block_sizes(target_keys).where(F.col("size") <= max_block).drop("size")
    return target_keys.join(small, ["country", "type", "value"], "left_semi")


WEIGHTED, COUNTED = "weighted", "count"


def weight(weights: dict[str, float] | None = None) -> Column:
    """The weight of a key's type; 1 for types without one."""
    known = F.create_map(*[F.lit(x) for pair in (weights or vocab.KEY_WEIGHTS).items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.col("type")), F.lit(1.0))


def points(query_keys: DataFrame, target_keys: DataFrame, score: str = WEIGHTED, max_block: int = MAX_BLOCK, weights: dict[str, float] | None = None) -> DataFrame:
    """(source1_id, candidate_id, source, blocking_score) of all pairs that share a kept key."""
    small = prune(target_keys, max_block).select("country", "type", "value", F.col("entity_id").alias("candidate_id"), "source")
    pairs = query_keys.select("country", "type", "value", F.col("entity_id").alias("source1_id")).join(small, ["country", "type", "value"])
    total = F.sum("weight") if score == WEIGHTED else F.count("*").cast("double")
    # dealt by query alone: sums, ranks and the query's fields need no other exchange, and a block's targets lie together, which packs well
    pairs = pairs.select("source1_id", "candidate_id", "source", *[weight(weights).alias("weight")] * (score == WEIGHTED)).repartition("source1_id")
    return pairs.groupBy("source1_id", "candidate_id", "source").agg(total.alias("blocking_score"))


def named(pairs: DataFrame) -> DataFrame:
    """``pairs`` with candidate_source, the source's name, in the place of its number."""
    return pairs.select("source1_id", "candidate_id", F.concat(F.lit("source"), F.col("source")).alias("candidate_source"), *[c for c in pairs.columns if c not in ("source1_id", "candidate_id", "source")])


def scored(query_keys: DataFrame, target_keys: DataFrame, score: str = WEIGHTED, max_block: int = MAX_BLOCK, weights: dict[str, float] | None = None) -> DataFrame:
    """(source1_id, candidate_id, candidate_source, blocking_score) of all pairs that share a kept key."""
    return named(points(query_keys, target_keys, score, max_block, weights))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each query with their rank and score over the best one's."""
    order = Window.partitionBy("source1_id").orderBy(F.desc("blocking_score"), "candidate_id")
    best = F.max("blocking_score").over(Window.partitionBy("source1_id"))
    ranked = pairs.withColumn("blocking_rank", F.row_number().over(order)).where(F.col("blocking_rank") <= k)
    return ranked.withColumns({"blocking_rank": F.col("blocking_rank").cast("double"), "blocking_score_ratio": F.col("blocking_score") / best})


def candidates(rows: DataFrame, score: str = WEIGHTED, max_block: int = MAX_BLOCK, k: int = TOP_K, column: Column | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Ranked candidates of every source-1 row among the rows of sources 2 and 3.

    The keys are written once: block sizes, targets and queries read them.
    """
    found = stage.written(keys(rows, column), "keys")
    # the number of the source travels through the exchange and the sort, its name is put in afterwards
    return named(top_k(points(found.where("source = 1"), found.where("source <> 1"), score, max_block, weights), k))
