"""Checks of submission files as one table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHING_HEADER = ["source1_entity_id", "matched_entity_ids"]
CANDIDATE_HEADER = ["source1_entity_id", "candidate_entity_ids"]
ERROR, WARNING = "error", "warning"


def _found(rows: DataFrame, rule: str, key: Column, severity: str = ERROR) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.cast("string").alias("id")).distinct()


def parse(lines: DataFrame) -> DataFrame:
    """(s1, ids, tab, raw) of data lines given as ``value``; blank lines without a tab fall away."""
    at = F.instr("value", "\t")
    rest = F.when(at > 0, F.expr("substring(value, instr(value, '\t') + 1)")).otherwise("")
    out = lines.select(F.col("value").alias("raw"), (at > 0).alias("tab"), F.when(at > 0, F.substring_index("value", "\t", 1)).otherwise(F.col("value")).alias("s1"), rest.alias("rest"))
    out = out.withColumn("ids", F.when(F.trim("rest") == "", F.array().cast("array<string>")).otherwise(F.split("rest", ",")))
    return out.where(F.col("tab") | (F.trim("s1") != "")).drop("rest")


def list_violations(rows: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, severity, id) over parsed rows; ``required`` has source1_id, ``known`` entity_id of the targets."""
    good = rows.where("tab")
    each = good.select("s1", F.explode("ids").alias("id"))
    target = F.col("id").startswith("S2-") | F.col("id").startswith("S3-")
    parts = [
        _found(rows.where("not tab"), "malformed_row", F.col("raw")),
        _found(good.groupBy("s1").count().where("count > 1"), "duplicate_row", F.col("s1")),
        _found(good.where(F.size("ids") != F.size(F.array_distinct("ids"))), "duplicate_id", F.col("s1")),
        _found(each.where(F.col("id").startswith("S1-")), "self_match", F.col("id")),
        _found(each.where(~F.col("id").startswith("S1-") & ~target), "bad_prefix", F.col("id")),
        _found(required.join(good, required["source1_id"] == good["s1"], "left_anti"), "missing_s1", F.col("source1_id")),
        _found(good.join(required, good["s1"] == required["source1_id"], "left_anti"), "extra_s1", F.col("s1")),
    ]
    if known is not None:
        parts.append(_found(each.where(target).join(known, F.col("id") == known["entity_id"], "left_anti"), "unknown_id", F.col("id")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def outside_candidates(matching: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warnings for matches that are not among the row's candidates."""
    made = matching.where("tab").select("s1", F.explode("ids").alias("id")).distinct()
    given = candidates.where("tab").select("s1", F.explode("ids").alias("id")).distinct()
    return _found(made.join(given, ["s1", "id"], "left_anti"), "match_not_candidate", F.col("s1"), WARNING)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=False)


def header_violation(header: str | None, expected: list[str]) -> str | None:
    """The rule that a header line breaks."""
    if header is None:
        return "empty_file"
    if "\t" not in header and "," in header:
        return "comma_separated"
    return None if [c.strip().lower() for c in header.split("\t")] == expected else "wrong_header"


def validate(spark: SparkSession, matching: str, required: DataFrame, candidates: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """All violations of a matching file and, if given, a candidate file."""
    from pyspark.errors import AnalysisException

    made, parsed = [], []
    for path, expected in ((matching, MATCHING_HEADER), (candidates, CANDIDATE_HEADER)):
        if path is None:
            made.append(spark.createDataFrame([("no_candidate_file", WARNING, None)], "rule string, severity string, id string"))
            continue
        try:
            lines = _lines(spark, path)
        except AnalysisException:
            made.append(spark.createDataFrame([("file_not_found", ERROR, path)], "rule string, severity string, id string"))
            continue
        first = lines.first()
        broken = header_violation(None if first is None else first[0], expected)
        if broken:
            made.append(spark.createDataFrame([(broken, ERROR, path)], "rule string, severity string, id string"))
            continue
        header = F.array_join(F.transform(F.split(F.lower("value"), "\t"), lambda c: F.trim(c)), "\t")
        rows = parse(lines.where(header != "\t".join(expected)))
        parsed.append(rows)
        made.append(list_violations(rows, required, known))
    if known is None:
        made.append(spark.createDataFrame([("ids_not_checked", WARNING, None)], "rule string, severity string, id string"))
    if len(parsed) == 2:
        made.append(outside_candidates(*parsed))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out
