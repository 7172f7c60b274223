"""Reading entity tables, truth lists and id files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import vocab

ENTITY = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])
#: What counts as missing: the loader's tokens, only empty cells, or nothing.
NA_LOADER, NA_EMPTY, NA_NONE = "loader", "empty", "none"


def _tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', nullValue="\u0000", emptyValue="", enforceSchema=True)


def filled(rows: DataFrame, policy: str = NA_LOADER) -> DataFrame:
    """Missing name, address and country cells as empty texts, by the given policy."""
    tokens = {NA_LOADER: vocab.NA_TOKENS, NA_EMPTY: [""], NA_NONE: []}[policy]
    names = [c for c in ("business_name", "business_address", "country") if c in rows.columns]
    return rows.withColumns({c: F.when(F.col(c).isNull() | F.col(c).isin(tokens), "").otherwise(F.col(c)) if tokens else F.coalesce(c, F.lit("")) for c in names})


def load_source(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None, policy: str = NA_LOADER) -> DataFrame:
    """An entity table; the path must exist.  Columns are pruned in the scan."""
    rows = _tsv(spark, path, ENTITY)
    rows = rows if columns is None else rows.select(*columns)
    return filled(rows if limit is None else rows.limit(limit), policy)


def load_ground_truth(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(source1_entity_id, matched_entity_ids); missing lists are null."""
    rows = _tsv(spark, path, TRUTH).withColumn("matched_entity_ids", F.when(~F.col("matched_entity_ids").isin(vocab.NA_TOKENS), F.col("matched_entity_ids")))
    return rows if limit is None else rows.limit(limit)


def true_pairs(truth: DataFrame) -> DataFrame:
    """Distinct (source1_id, candidate_id) of comma-joined lists; blanks fall away."""
    each = truth.where("matched_entity_ids is not null").select(F.col("source1_entity_id").alias("source1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("candidate_id"))
    return each.withColumn("candidate_id", F.trim("candidate_id")).where("candidate_id <> ''").distinct()


def only(rows: DataFrame, ids: DataFrame, country: str | None = None) -> DataFrame:
    """The rows of the wanted ids, and of one country if given."""
    kept = rows.join(ids.select("entity_id").distinct(), "entity_id", "left_semi")
    return kept if country is None else kept.where(F.col("country") == country)


def ids(spark: SparkSession, path: str) -> DataFrame:
    """First field of each line but the header and blank lines."""
    lines = spark.read.text(path).select(F.trim(F.substring_index("value", "\t", 1)).alias("entity_id"))
    return lines.where("entity_id <> '' and entity_id <> 'entity_id'")


def benchmark_set(truth: DataFrame, matched: int = 4720, singletons: int = 280, first: int = 20_000) -> DataFrame:
    """The first matched and the first unmatched entities of the first rows, in order of ``row``."""
    head = truth.orderBy("row").limit(first)
    empty = F.coalesce(F.trim("matched_entity_ids"), F.lit("")) == ""
    return head.where(~empty).orderBy("row").limit(matched).unionByName(head.where(empty).orderBy("row").limit(singletons))
