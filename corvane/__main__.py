"""Command line: candidates, predict, run and validate."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corvane.operators import model, validate
from corvane.plans import pipeline
from corvane.sources import readers, writers


def _sources(parser: argparse.ArgumentParser) -> None:
    for n in (1, 2, 3):
        parser.add_argument(f"--source{n}", required=True)
    parser.add_argument("--variant", choices=sorted(pipeline.VARIANTS), default="combined")
    parser.add_argument("--out", required=True)


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="corvane")
    commands = parser.add_subparsers(dest="command", required=True)
    _sources(commands.add_parser("candidates"))
    for name in ("predict", "run"):
        own = commands.add_parser(name)
        _sources(own)
        own.add_argument("--model", required=True)
        own.add_argument("--threshold", type=float)
    check = commands.add_parser("validate")
    check.add_argument("--matching", required=True)
    check.add_argument("--candidates")
    check.add_argument("--source1", required=True)
    check.add_argument("--check-ids", nargs="*", default=[], help="files of sources 2 and 3")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> int:
    a = arguments(given)
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    if a.command == "validate":
        required = readers.ids(spark, a.source1).select(F.col("entity_id").alias("source1_id"))
        known = None
        for path in a.check_ids:
            known = readers.ids(spark, path) if known is None else known.unionByName(readers.ids(spark, path))
        found = validate.validate(spark, a.matching, required, a.candidates, known)
        bad = found.groupBy("rule", "severity").count().collect()  # one row for each rule
        for r in bad:
            print(r["severity"], r["rule"], r["count"])
        return int(any(r["severity"] == validate.ERROR for r in bad))
    paths = [a.source1, a.source2, a.source3]
    variant = pipeline.VARIANTS[a.variant]
    if a.command == "candidates":
        writers.candidate_pairs(pipeline.candidates(pipeline.read_entities(spark, paths), variant)[1], a.out)
    elif a.command == "predict":
        fitted, _, t = model.load(spark, a.model, a.threshold)
        made = pipeline.feature_rows(pipeline.read_entities(spark, paths), variant)[1]
        writers.predictions(model.score(fitted, made, t), a.out)
    else:
        print(json.dumps(pipeline.run_files(spark, paths, a.model, a.out, a.variant, a.threshold)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
