"""From scored pairs to match lists: thresholds, vetoes, ordering, completion.

Scored pairs have source1_id, candidate_id, candidate_source, probability and,
where a rule needs them, norm_country, blocking_rank, names and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import vocab
from corvane.functions.text import tokens, words_of

_TARGETS = "^S[23]-"


def threshold(pairs: DataFrame, t: float | Column) -> DataFrame:
    return pairs.where(F.col("probability") >= t)


def base_threshold(t: float, country: Column) -> Column:
    """At least the country's floor (variant A)."""
    out = F.lit(max(t, vocab.BASE_OTHER))
    for name, floor in vocab.BASE_THRESHOLDS.items():
        out = F.when(country == name, max(t, floor)).otherwise(out)
    return out


def rank_threshold(t: Column, rank: Column) -> Column:
    """More is asked of candidates further down; sums in doubles."""
    out = t + F.lit(vocab.RANK_BEYOND)
    for last, more in reversed(vocab.RANK_STEPS):
        out = F.when(rank <= last, t + F.lit(more)).otherwise(out)
    return out


def country_threshold(country: Column, table: dict[str, float] | None = None, other: float = vocab.OTHER_THRESHOLD) -> Column:
    """Threshold by country (variant B)."""
    out = F.lit(other)
    for name, t in (table or vocab.COUNTRY_THRESHOLDS).items():
        out = F.when(country == name, t).otherwise(out)
    return out


def _differ(a: Column, b: Column, kind: list[str]) -> Column:
    x, y = (F.array_sort(F.array_intersect(tokens(F.lower(F.coalesce(c, F.lit("")))), words_of(kind))) for c in (a, b))
    return (F.size(x) > 0) & (F.size(y) > 0) & (x != y)


def branch_conflict(a: Column, b: Column) -> Column:
    """Whether both names carry direction words, or division words, that differ."""
    return _differ(a, b, vocab.BRANCH_DIRECTIONS) | _differ(a, b, vocab.BRANCH_DIVISIONS)


def building_clash(number_a: Column, number_b: Column, core_a: Column, core_b: Column) -> Column:
    """Whether both have building numbers that differ, and other core names."""
    return (number_a != "") & (number_b != "") & (number_a != number_b) & (core_a != core_b)


def consistent(passing: DataFrame) -> DataFrame:
    """Drops one of the best S2 and the best S3 match of an entity if their building numbers differ.

    ``passing`` has building_b.  The lower probability goes, on a tie S3.  Only
    the two best are compared: two window columns and no self-join.
    """
    per = Window.partitionBy("source1_id", "candidate_source").orderBy(F.desc("probability"), "candidate_id")
    entity = Window.partitionBy("source1_id")
    out = passing.withColumn("_top", F.row_number().over(per) == 1)
    for source in ("2", "3"):
        mine = F.when(F.col("_top") & (F.col("candidate_source") == f"source{source}"), F.struct("probability", "building_b"))
        out = out.withColumn(f"_s{source}", F.max(mine).over(entity))
    clash = (F.col("_s2.building_b") != "") & (F.col("_s3.building_b") != "") & (F.col("_s2.building_b") != F.col("_s3.building_b"))
    loser = F.when(F.col("_s2.probability") >= F.col("_s3.probability"), "source3").otherwise("source2")
    drop = F.coalesce(clash, F.lit(False)) & F.col("_top") & (F.col("candidate_source") == loser)
    return out.where(~drop).drop("_top", "_s2", "_s3")


def gated(pairs: DataFrame, base: float, gate: float) -> DataFrame:
    """Pairs from ``base`` on, of entities whose best pair reaches ``gate``."""
    passing = threshold(pairs, base)
    return passing.withColumn("_best", F.max("probability").over(Window.partitionBy("source1_id"))).where(F.col("_best") >= gate).drop("_best")


def weak_name_guard(pairs: DataFrame, gate: float, least: float = 0.55) -> DataFrame:
    """A pair of unlike names needs a probability of ``gate``."""
    return pairs.where((F.col("name_levenshtein") >= least) | (F.col("probability") >= gate))


def match_lists(passing: DataFrame, required: DataFrame, most: int | None = None) -> DataFrame:
    """(source1_id, matches) of every required id: best first, ties by id, targets only, empty where none."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("probability")).alias("p"), F.col("candidate_id").alias("id"))))
    ids = F.array_distinct(F.transform(ordered, lambda x: x["id"]))
    lists = passing.where(F.col("candidate_id").rlike(_TARGETS)).groupBy("source1_id").agg((ids if most is None else F.slice(ids, 1, most)).alias("matches"))
    return required.select(F.col("entity_id").alias("source1_id")).join(lists, "source1_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<string>")))


def candidate_lists(pairs: DataFrame, required: DataFrame) -> DataFrame:
    """(source1_id, candidates) of every required id, by blocking rank."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("blocking_rank").alias("r"), F.col("candidate_id").alias("id"))))
    lists = pairs.groupBy("source1_id").agg(F.array_distinct(F.transform(ordered, lambda x: x["id"])).alias("candidates"))
    return required.select(F.col("entity_id").alias("source1_id")).join(lists, "source1_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def submission(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(source1_id, matches, candidates): matches that aren't candidates are appended to them."""
    both = matches.join(candidates, "source1_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return both.withColumn("candidates", F.concat("candidates", F.array_except("matches", "candidates")))
