"""A corpus pipeline of five stages over ``documents``.

Each stage gets what its predecessor kept, read again from Parquet.  All but
the last return the columns of ``documents``:

1. quality classifier: documents that it rejects go;
2. toxicity: documents that it rejects go;
3. n-gram Jaccard join: one document of each group stays;
4. benchmark decontamination: hit spans are cut out of the texts, and documents
   that are mostly hit go;
5. SentencePiece encoding and decoding: the digests of every text.

Each stage's table is written under the session's checkpoint folder and deleted
once the next one is written; the last is deleted when the program ends.

Cases, beside those of the operators: a null, empty or blank text is scored by
the first two stages like any other, is no copy of anything, is never hit and
has no tokens.  Very long texts are handled whole.  Of rows that share a doc_id
one stays, the least by text; rows without a doc_id all stay in that stage.  An
empty table gives an empty one.  Extra columns are carried along by all stages
but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, jaccard, pieces, quality, toxicity
from corvane.llm.runtime import drop, place


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # learned from the labelled documents of the whole table, not only from those that came this far
    return quality.accepted(docs, _table(spark, sf_dir, "labels"), source=_table(spark, sf_dir, "documents"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, _table(spark, sf_dir, "labels"), source=_table(spark, sf_dir, "documents"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: Learned models, a suffix automaton and byte-pair merges are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = place(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop(spark, before)
        before = path
    return docs
