"""Where matches are lost or wrongly made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import normalize as base
from corvane.functions import vocab
from corvane.functions.text import is_indic, text, tokens, words_of
from corvane.operators import blocking, stage

#: Key types, block cap and candidates of each configuration that is compared (fixed values).
_NAME, _ADDRESS = ["NP4", "NP6", "TOK", "NSORT", "NCOMP"], ["ADDR", "UNIT", "PLOT"]
STRATEGY_SETS = [
    ("baseline", _NAME + _ADDRESS, 500, 200),
    ("acronyms", ["TOK3"], 1000, 200),
    ("locality", ["ADDR_LOC"], 1000, 200),
    ("address", _ADDRESS, 1000, 200),
    ("name", _NAME, 1000, 200),
    ("block_1000", _NAME + _ADDRESS, 1000, 200),
    ("block_1000_top_300", _NAME + _ADDRESS, 1000, 300),
    ("with_acronyms", _NAME + _ADDRESS + ["TOK3"], 1000, 300),
    ("with_locality", _NAME + _ADDRESS + ["TOK3", "ADDR_LOC"], 1000, 300),
    ("high_recall", _NAME + _ADDRESS + ["TOK3", "ADDR_LOC"], 1200, 350),
]


def missed(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """True pairs that are not candidates."""
    return truth.select("source1_id", "candidate_id").distinct().join(pairs.select("source1_id", "candidate_id"), ["source1_id", "candidate_id"], "left_anti")


def sided(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` with the normalised rows of both ids as structs a and b."""
    fields = F.struct("business_name", "business_address", "norm_name", "core_name", "norm_addr", "norm_country")
    left = rows.select(F.col("entity_id").alias("source1_id"), fields.alias("a"))
    right = rows.select(F.col("entity_id").alias("candidate_id"), fields.alias("b"))
    return pairs.join(left, "source1_id", "left").join(right, "candidate_id", "left")


def _missing(column: Column) -> Column:
    return base.is_null_like(column)


def miss_category(a: Column, b: Column, shared: Column, kept: Column) -> Column:
    """Why a true pair is no candidate: the first of the reasons that holds.

    ``shared`` and ``kept`` count the keys that both sides have, and those of
    them whose blocks were not pruned.
    """
    letters = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    start = lambda c: F.substring(F.regexp_replace(c, "[^a-z]", ""), 1, 3)
    size = lambda c: F.char_length(F.replace(c, F.lit(" "), F.lit("")))
    addresses = F.array_except(F.array_intersect(tokens(a["norm_addr"]), tokens(b["norm_addr"])), words_of(vocab.MISS_ADDRESS_STOP))
    x, y = F.array_distinct(tokens(a["core_name"])), F.array_distinct(tokens(b["core_name"]))
    lower = F.lower(text(b["business_name"]))
    inside = F.exists(F.filter(x, lambda t: F.char_length(t) >= 3), lambda t: F.contains(lower, t))
    named = (F.size(x) > 0) & (F.size(y) > 0)
    return (
        F.when((shared > 0) & (kept == 0), "key pruned")
        .when(shared > 0, "truncated by top-k")
        .when(is_indic(b["business_name"]) & ~is_indic(a["business_name"]), "indic script vs latin name")
        .when(_missing(b["business_address"]), "candidate address missing")
        .when(_missing(b["business_name"]), "candidate name missing")
        .when((size(a["core_name"]) <= 4) | (size(b["core_name"]) <= 4), "short business name")
        .when(letters(a["core_name"]) == letters(b["core_name"]), "exact name without punctuation")
        .when((F.size(addresses) >= 2) & (F.size(F.array_intersect(x, y)) == 0), "address similar, name alias")
        .when(named & (start(a["core_name"]) == start(b["core_name"])), "prefix-3 match")
        .when(named & inside, "token variation")
        .when(named, "severe variation")
        .otherwise("other variation")
    )


def miss_reasons(truth: DataFrame, pairs: DataFrame, rows: DataFrame, max_block: int, column: Column | None = None) -> DataFrame:
    """(source1_id, candidate_id, category) of every true pair that is no candidate.

    The missed pairs alone are compared; their keys join the block sizes.
    """
    lost = stage.written(missed(truth, pairs), "missed")
    found = stage.written(blocking.keys(rows, column), "keys")
    sizes = blocking.block_sizes(found.where("source <> 1"))
    key = ["country", "type", "value"]
    left = lost.join(found.select(F.col("entity_id").alias("source1_id"), *key), "source1_id")
    shared = left.join(found.select(F.col("entity_id").alias("candidate_id"), *key), ["candidate_id", *key]).join(sizes, key)
    counted = shared.groupBy("source1_id", "candidate_id").agg(F.count("*").alias("shared"), F.count_if(F.col("size") <= max_block).alias("kept"))
    out = sided(lost, rows).join(counted, ["source1_id", "candidate_id"], "left").na.fill(0, ["shared", "kept"])
    return out.select("source1_id", "candidate_id", miss_category(F.col("a"), F.col("b"), F.col("shared"), F.col("kept")).alias("category"))


def fp_pattern(a: Column, b: Column, number_a: Column, number_b: Column) -> Column:
    same_name = F.lower(F.trim(text(a["business_name"]))) == F.lower(F.trim(text(b["business_name"])))
    return F.when(same_name, "identical name, different location").when((a["norm_country"] == b["norm_country"]) & (number_a != number_b), "similar name, different building").otherwise("common name collision")


def fn_pattern(b: Column, number_a: Column, number_b: Column) -> Column:
    no_ascii = ~text(b["business_name"]).rlike(r"[\x00-\x7F]")
    return (
        F.when(text(b["business_address"]) == "", "candidate address missing")
        .when(no_ascii, "multilingual name mismatch")
        .when((number_a != "") & (number_b != "") & (number_a != number_b), "building number discrepancy")
        .otherwise("spelling or alias variation")
    )


def errors(pairs: DataFrame, rows: DataFrame, t: float, top: int | None = 10) -> DataFrame:
    """The worst false positives and negatives of labelled pairs with their patterns."""
    kinds = []
    for kind, condition, order in (
        ("fp", (F.col("label") == 0) & (F.col("probability") >= t), F.desc("probability")),
        ("fn", (F.col("label") == 1) & (F.col("probability") < t), F.asc("probability")),
    ):
        own = pairs.where(condition)
        kinds.append((own if top is None else own.orderBy(order, "source1_id", "candidate_id").limit(top)).withColumn("kind", F.lit(kind)))
    both = sided(kinds[0].unionByName(kinds[1]), rows)
    a, b = F.col("a"), F.col("b")
    x, y = base.building_no(a["norm_addr"]), base.building_no(b["norm_addr"])
    pattern = F.when(F.col("kind") == "fp", fp_pattern(a, b, x, y)).otherwise(fn_pattern(b, x, y))
    return both.select("kind", "source1_id", "candidate_id", F.round("probability", 4).alias("match_probability"), pattern.alias("pattern"))


def error_buckets(pairs: DataFrame, truth: DataFrame, rows: DataFrame, high: float = 0.80, low: float = 0.50) -> DataFrame:
    """(bucket, n): how many true pairs are lost where, and what kinds of false ones pass."""
    true = truth.select("source1_id", "candidate_id").distinct()
    hits = true.join(pairs.select("source1_id", "candidate_id", "probability"), ["source1_id", "candidate_id"], "left")
    p = F.col("probability")
    lost = hits.agg(F.count_if(p.isNull()).alias("blocking_miss"), F.count_if((p >= low) & (p < high)).alias("borderline"), F.count_if(p < low).alias("hard"))
    wrong = pairs.where(p >= high).join(true, ["source1_id", "candidate_id"], "left_anti")
    matched = true.select("source1_id").distinct().withColumn("matched", F.lit(True))
    x, y = F.array_distinct(tokens(F.col("a.core_name"))), F.array_distinct(tokens(F.col("b.core_name")))
    differing = F.array_union(F.array_except(x, y), F.array_except(y, x))
    told = sided(wrong.select("source1_id", "candidate_id"), rows).join(matched, "source1_id", "left")
    made = told.agg(F.count_if(F.col("matched").isNull()).alias("singleton_fp"), F.count("matched").alias("non_singleton_fp"), F.count_if(F.arrays_overlap(differing, words_of(vocab.COLLISION_WORDS))).alias("branch_collision"))
    names = ["blocking_miss", "borderline", "hard", "singleton_fp", "non_singleton_fp", "branch_collision"]
    return lost.crossJoin(made).select(F.explode(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")  # one row each


def difficulty(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """(source1_id, difficulty): whether true matches equal the entity in name and in address (perhaps not the same one), in one of them, or in neither."""
    a, b = F.col("a"), F.col("b")
    same = lambda c: F.coalesce(F.max((a[c] == b[c]) & (a[c] != "")).cast("int"), F.lit(0))
    best = sided(truth.select("source1_id", "candidate_id").distinct(), rows).groupBy("source1_id").agg((same("norm_name") + same("norm_addr")).alias("level"))
    return best.select("source1_id", F.when(F.col("level") == 2, "easy").when(F.col("level") == 1, "medium").otherwise("hard").alias("difficulty"))


def strategies(spark: SparkSession, rows: DataFrame, truth: DataFrame, sets: list[tuple[str, list[str], int, int]] | None = None) -> DataFrame:
    """(strategy, candidate_pairs, found, gained): each configuration's recall, and the pairs that it adds to the first one's.

    A configuration without candidates has a row of zeros.
    """
    sets = sets or STRATEGY_SETS
    found = stage.written(blocking.keys(rows), "keys")
    true = truth.select("source1_id", "candidate_id").distinct()
    sizes = blocking.block_sizes(found.where("source <> 1"))
    key = ["country", "type", "value"]
    targets = found.where("source <> 1").select(*key, F.col("entity_id").alias("candidate_id"), F.concat(F.lit("source"), F.col("source")).alias("candidate_source")).join(sizes, key)
    queries = found.where("source = 1").select(*key, F.col("entity_id").alias("source1_id"))
    shared = queries.join(targets.where(F.col("size") <= max(c for _, _, c, _ in sets)), key)
    # one pass counts the keys of all configurations for each pair
    counts = [F.count_if(F.col("type").isin(types) & (F.col("size") <= cap)).cast("double").alias(f"s{i}") for i, (_, types, cap, _) in enumerate(sets)]
    scored = stage.written(shared.groupBy("source1_id", "candidate_id", "candidate_source").agg(*counts), "scored")
    kept = None
    for i, (name, _, _, k) in enumerate(sets):
        own = scored.where(F.col(f"s{i}") > 0).select("source1_id", "candidate_id", "candidate_source", F.col(f"s{i}").alias("blocking_score"))
        best = blocking.top_k(own, k).select(F.lit(name).alias("strategy"), "source1_id", "candidate_id")
        kept = best if kept is None else kept.unionByName(best)
    # only true pairs are looked at one by one; the rest is counted
    hits = kept.join(true, ["source1_id", "candidate_id"], "left_semi")
    hits = stage.written(hits, "hits")
    first = hits.where(F.col("strategy") == sets[0][0]).select("source1_id", "candidate_id", F.lit(1).alias("before"))
    gains = hits.join(first, ["source1_id", "candidate_id"], "left").groupBy("strategy").agg(F.count("*").alias("found"), F.count_if(F.col("before").isNull()).alias("gained"))
    pairs = kept.groupBy("strategy").agg(F.count("*").alias("candidate_pairs"))
    every = spark.createDataFrame([(name,) for name, *_ in sets], "strategy string")
    return every.join(pairs, "strategy", "left").join(gains, "strategy", "left").na.fill(0).select("strategy", "candidate_pairs", "found", "gained")
