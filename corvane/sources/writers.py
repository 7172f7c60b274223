"""Writing candidates, predictions, submissions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="")


def candidate_pairs(pairs: DataFrame, path: str) -> None:
    """source1_id, candidate_id, candidate_source with a header, in as many parts as there are."""
    _tsv(pairs.select("source1_id", "candidate_id", "candidate_source"), path)


def predictions(scored: DataFrame, path: str) -> None:
    """Predictions with the probability rounded to 6."""
    _tsv(scored.select("source1_id", "candidate_id", "candidate_source", F.round("probability", 6).alias("match_probability"), "predicted_match"), path)


def id_lists(lists: DataFrame, path: str, header: list[str], order: str | None = None) -> None:
    """One line for each row: the id, a tab, the comma-joined list (empty where none).

    With ``order`` the lines are sorted by range over all parts, so that the
    parts in name order are the file; nothing is gathered in one task.
    """
    id_name, list_name = lists.columns[:2]
    rows = lists if order is None else lists.orderBy(order)
    _tsv(rows.select(F.col(id_name).alias(header[0]), F.array_join(list_name, ",").alias(header[1])), path)


def submission(made: DataFrame, folder: str, order: str | None = None) -> tuple[int, int]:
    """The matching and the candidate file of (source1_id, matches, candidates); rows and links written."""
    extra = [order] if order else []
    id_lists(made.select("source1_id", "matches", *extra), f"{folder}/matching_results", ["source1_entity_id", "matched_entity_ids"], order)
    id_lists(made.select("source1_id", "candidates", *extra), f"{folder}/candidate_pairs", ["source1_entity_id", "candidate_entity_ids"], order)
    rows, links = made.agg(F.count("*"), F.coalesce(F.sum(F.size("matches")), F.lit(0))).first()
    return rows, links


def report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A small result table as JSON lines or CSV, in one part."""
    out = rows.coalesce(1).write.mode("overwrite")
    out.csv(path, header=True) if kind == "csv" else out.json(path)
