"""Entity-level and pair-level metrics, threshold sweeps and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import vocab

BETA = 0.5


def f_beta(p: Column, r: Column, beta: float = BETA) -> Column:
    b = beta * beta
    return F.when((p <= 0) | (r <= 0), 0.0).otherwise((1 + b) * p * r / (b * p + r))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, empty).otherwise(a / b)


def mean(values: Column) -> Column:
    """An average that does not depend on the order of rows: sums are made in fixed point."""
    return F.avg(values.cast("decimal(20,14)")).cast("double")


def truth_lists(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source1_id").agg(F.collect_set("candidate_id").alias("truth"))


def entity_counts(predicted: DataFrame, truth: DataFrame, required: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(source1_id, n_true, n_pred, tp) of every required id, and for each value of ``by``.

    Three pre-aggregated counts; no list of an entity's pairs is built.
    """
    by = by or []
    wanted = required.select("source1_id", *by)
    marked = truth.select("source1_id", "candidate_id").distinct().withColumn("hit", F.lit(1))
    made = predicted.select("source1_id", "candidate_id", *by).distinct().join(marked, ["source1_id", "candidate_id"], "left")
    made = made.groupBy("source1_id", *by).agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    real = marked.groupBy("source1_id").agg(F.count("*").alias("n_true"))
    out = wanted.join(real, "source1_id", "left").join(made, ["source1_id", *by], "left")
    return out.na.fill(0, ["n_true", "n_pred", "tp"])


def entity_prf(counts: DataFrame, beta: float = BETA) -> DataFrame:
    """Adds precision, recall and f of each entity.

    Nothing true and nothing predicted is 1, 1, 1; a false merge on an entity
    without matches has recall 1 and f 0.
    """
    t, p, hit = F.col("n_true"), F.col("n_pred"), F.col("tp")
    precision = F.when((t == 0) & (p == 0), 1.0).when((t == 0) | (p == 0), 0.0).otherwise(hit / p)
    recall = F.when(t == 0, 1.0).when(p == 0, 0.0).otherwise(hit / t)
    out = counts.withColumns({"precision": precision, "recall": recall})
    return out.withColumn("f", F.when((t == 0) & (p == 0), 1.0).when((t == 0) | (p == 0), 0.0).otherwise(f_beta(F.col("precision"), F.col("recall"), beta)))


def summary(counts: DataFrame, by: list[str] | None = None, beta: float = BETA) -> DataFrame:
    """Macro and micro metrics, singleton accuracy and counts, one row for each value of ``by``; rounded to 4."""
    single, t, p, hit = F.col("n_true") == 0, F.col("n_true"), F.col("n_pred"), F.col("tp")
    made = entity_prf(counts, beta).groupBy(*(by or [])).agg(
        mean(F.col("f")).alias("f"),
        mean(F.col("precision")).alias("p"),
        mean(F.col("recall")).alias("r"),
        mean(F.when(~single, F.col("f"))).alias("nf"),
        F.count("*").alias("total_evaluated_s1"),
        F.count_if(single).alias("true_singletons"),
        F.count_if(single & (p == 0)).alias("correct_singletons"),
        F.coalesce(F.sum(hit), F.lit(0)).alias("total_tp_pairs"),
        F.coalesce(F.sum(p - hit), F.lit(0)).alias("total_fp_pairs"),
        F.coalesce(F.sum(t - hit), F.lit(0)).alias("total_fn_pairs"),
    )
    micro_p = ratio(F.col("total_tp_pairs"), F.col("total_tp_pairs") + F.col("total_fp_pairs"))
    micro_r = ratio(F.col("total_tp_pairs"), F.col("total_tp_pairs") + F.col("total_fn_pairs"))
    r4 = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return made.select(
        *(by or []),
        r4(F.col("f")).alias("macro_f05"),
        r4(F.col("p")).alias("macro_precision"),
        r4(F.col("r")).alias("macro_recall"),
        F.round(ratio(F.col("correct_singletons"), F.col("true_singletons"), 1.0), 4).alias("singleton_accuracy"),
        r4(F.col("nf")).alias("non_singleton_macro_f05"),
        r4(micro_p).alias("micro_precision"),
        r4(micro_r).alias("micro_recall"),
        r4(f_beta(micro_p, micro_r, beta)).alias("micro_f05"),
        "total_evaluated_s1",
        "true_singletons",
        "correct_singletons",
        (F.col("true_singletons") - F.col("correct_singletons")).alias("false_merges_on_singletons"),
        "total_tp_pairs",
        "total_fp_pairs",
        "total_fn_pairs",
    )


def evaluate(predicted: DataFrame, truth: DataFrame, required: DataFrame, beta: float = BETA) -> DataFrame:
    return summary(entity_counts(predicted, truth, required), beta=beta)


def grid(spark: SparkSession, **values: list[float]) -> DataFrame:
    """All combinations of the given parameters: a few dozen rows."""
    out = None
    for name, column in values.items():
        own = spark.createDataFrame([(float(v),) for v in column], f"{name} double")
        out = own if out is None else out.crossJoin(own)
    return out


def _over(pairs: DataFrame, parameters: DataFrame, condition: Column) -> DataFrame:
    """Each pair beside each parameter row (a bounded grid) for which it passes."""
    return pairs.join(F.broadcast(parameters), condition)


def sweep_macro(pairs: DataFrame, truth: DataFrame, required: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Macro metrics by threshold, in one job."""
    t = grid(pairs.sparkSession, threshold=thresholds or vocab.MACRO_THRESHOLDS)
    passing = _over(pairs, t, F.col("probability") >= F.col("threshold"))
    return summary(entity_counts(passing, truth, required.crossJoin(F.broadcast(t)), ["threshold"]), ["threshold"])


def best(swept: DataFrame, score: str, ties: list[str]) -> DataFrame:
    """The row of the highest score, the lowest parameters among equals."""
    return swept.orderBy(F.desc(score), *ties).limit(1)


def country_grid(pairs: DataFrame, truth: DataFrame, required: DataFrame, thresholds: list[float]) -> DataFrame:
    """Macro metrics by (t_us, t_other); ``pairs`` have norm_country."""
    t = grid(pairs.sparkSession, t_us=thresholds, t_other=thresholds)
    limit = F.when(F.col("norm_country") == "US", F.col("t_us")).otherwise(F.col("t_other"))
    passing = _over(pairs, t, F.col("probability") >= limit)
    by = ["t_us", "t_other"]
    return summary(entity_counts(passing, truth, required.crossJoin(F.broadcast(t)), by), by)


def gate_grid(pairs: DataFrame, truth: DataFrame, required: DataFrame, bases: list[float], gaps: list[float]) -> DataFrame:
    """Macro metrics by (t_base, gap) under the gate and the weak-name guard."""
    t = grid(pairs.sparkSession, t_base=bases, gap=gaps)
    by = ["t_base", "gap"]
    gate = F.col("t_base") + F.col("gap")
    passing = _over(pairs, t, F.col("probability") >= F.col("t_base"))
    passing = passing.withColumn("_best", F.max("probability").over(Window.partitionBy("source1_id", *by)))
    passing = passing.where((F.col("_best") >= gate) & ((F.col("name_levenshtein") >= 0.55) | (F.col("probability") >= gate)))
    return summary(entity_counts(passing, truth, required.crossJoin(F.broadcast(t)), by), by)


def _confusion(y: Column, p: Column) -> list[Column]:
    return [F.count_if((y == 1) & p).alias("tp"), F.count_if((y == 0) & p).alias("fp"), F.count_if((y == 1) & ~p).alias("fn"), F.count_if((y == 0) & ~p).alias("tn")]


def _pair_metrics(counted: DataFrame, by: list[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    r6 = lambda c: F.round(c, 6)
    return counted.select(*by, r6(p).alias("precision"), r6(r).alias("recall"), r6(f_beta(p, r)).alias("f05"), r6(f_beta(p, r, 1.0)).alias("f1"), r6(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"), "tp", "fp", "fn", "tn")


def pair_metrics(pairs: DataFrame, t: float) -> DataFrame:
    """Precision, recall, F, accuracy and confusion counts of labelled pairs at one threshold."""
    return _pair_metrics(pairs.agg(*_confusion(F.col("label"), F.col("probability") >= t)), [])


def sweep_pairs(pairs: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Pair metrics by threshold: counts by label and distinct score first, then the grid."""
    t = grid(pairs.sparkSession, threshold=thresholds or vocab.PAIR_THRESHOLDS)
    counted = pairs.crossJoin(F.broadcast(t)).groupBy("threshold").agg(*_confusion(F.col("label"), F.col("probability") >= F.col("threshold")))
    return _pair_metrics(counted, ["threshold"])


def roc_auc(pairs: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks; 0.5 without both classes.

    Scores are counted first; running counts come from ranges of the score, so
    no task sees all of them: each range's total is added to the ranks within.
    """
    scores = pairs.groupBy("probability").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).withColumn("part", F.floor(F.col("probability") * 1000))
    parts = scores.groupBy("part").agg(F.sum("n").alias("total"))
    before = parts.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 1001 rows at most
    inside = Window.partitionBy("part").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    ranked = scores.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("all"))
    n = F.col("all") - F.col("p")
    return sums.select(F.round(F.when((F.col("p") > 0) & (n > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * n)).otherwise(0.5), 6).alias("roc_auc"))


def blocking_recall(pairs: DataFrame, truth: DataFrame, required: DataFrame) -> DataFrame:
    """Share of true pairs among the candidates, their number and how many for each entity."""
    true = truth.select("source1_id", "candidate_id").distinct()
    found = true.join(pairs.select("source1_id", "candidate_id"), ["source1_id", "candidate_id"], "left_semi").agg(F.count("*").alias("found"))
    totals = true.agg(F.count("*").alias("true_pairs")).crossJoin(found).crossJoin(pairs.agg(F.count("*").alias("candidate_pairs"))).crossJoin(required.agg(F.count("*").alias("entities")))  # one row each
    return totals.select("true_pairs", "found", F.round(ratio(F.col("found"), F.col("true_pairs")), 6).alias("recall"), "candidate_pairs", F.round(ratio(F.col("candidate_pairs"), F.col("entities")), 6).alias("per_entity"))


def compactness(pairs: DataFrame, required: DataFrame) -> DataFrame:
    """Distribution of candidates for each entity, entities without any included."""
    n = pairs.groupBy("source1_id").agg(F.count("*").alias("n"))
    every = required.select("source1_id").join(n, "source1_id", "left").na.fill(0, ["n"])
    # sizes are counted first: the percentiles merge a few hundred rows and not one for each entity
    sizes = every.groupBy("n").agg(F.count("*").alias("w"))
    q = lambda p: F.round(F.expr(f"percentile(n, {p}, w)"), 6)
    return sizes.select(F.round(F.sum(F.col("n") * F.col("w")) / F.sum("w"), 6).alias("mean"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.95).alias("p95"), q(0.99).alias("p99"), F.max("n").alias("most"), F.sum("w").alias("entities"))


def search_space(pairs: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """1 less the candidate pairs over all possible ones."""
    counts = pairs.agg(F.count("*").alias("c")).crossJoin(queries.agg(F.count("*").alias("q"))).crossJoin(targets.agg(F.count("*").alias("t")))  # one row each
    return counts.select(F.col("c").alias("candidate_pairs"), (F.col("q") * F.col("t")).alias("possible_pairs"), F.round(1 - ratio(F.col("c"), F.col("q") * F.col("t")), 8).alias("reduction"))


def recall_decomposition(pairs: DataFrame, truth: DataFrame, t: float) -> DataFrame:
    """Blocking recall times classification recall is the recall of the system."""
    true = truth.select("source1_id", "candidate_id").distinct()
    hits = true.join(pairs.select("source1_id", "candidate_id", "probability"), ["source1_id", "candidate_id"], "left")
    made = hits.agg(F.count("*").alias("true_pairs"), F.count("probability").alias("in_candidates"), F.count_if(F.col("probability") >= t).alias("matched"))
    r6 = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 6)
    return made.select("true_pairs", "in_candidates", "matched", r6("in_candidates", "true_pairs").alias("blocking_recall"), r6("matched", "in_candidates").alias("classification_recall"), r6("matched", "true_pairs").alias("system_recall"))


def by_source(predicted: DataFrame, truth: DataFrame, required: DataFrame) -> DataFrame:
    """Metrics of the pairs with each target source alone, over all required entities."""
    source = F.concat(F.lit("source"), F.substring("candidate_id", 2, 1))
    kinds = required.sparkSession.createDataFrame([("source2",), ("source3",)], "candidate_source string")
    marked = truth.select("source1_id", "candidate_id").distinct().withColumn("candidate_source", source)
    made = predicted.select("source1_id", "candidate_id").distinct().withColumn("candidate_source", source).join(marked.withColumn("hit", F.lit(1)), ["source1_id", "candidate_id", "candidate_source"], "left")
    by = ["source1_id", "candidate_source"]
    counted = required.select("source1_id").crossJoin(F.broadcast(kinds))  # two rows
    counted = counted.join(marked.groupBy(*by).agg(F.count("*").alias("n_true")), by, "left").join(made.groupBy(*by).agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp")), by, "left")
    return summary(counted.na.fill(0, ["n_true", "n_pred", "tp"]), ["candidate_source"])


def held_out(share: float, seed: int = 42) -> Column:
    """Whether the seeded digest of source1_id lies in the first ``share`` of its range: all rows of an id fall on one side."""
    digest = F.conv(F.substring(F.md5(F.concat(F.col("source1_id"), F.lit(f":{seed}"))), 1, 10), 16, 10).cast("long")
    return digest < F.lit(int(share * (1 << 40)))


def group_split(ids: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Each id once with held_out; no task sees all ids."""
    return ids.select("source1_id").distinct().withColumn("held_out", held_out(share, seed))
