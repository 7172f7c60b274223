"""Entity tables derived from ``part``: three sources that describe the same businesses in their own ways.

Every part is a business in each source.  Source 1 states it plainly; sources 2
and 3 vary spelling, legal form, address and country code, and some of their
rows describe another business under the same number, so that some source-1
rows have no match.  The SQL is valid in Spark and DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import stage

ENTITY_SQL = """
WITH p AS (
  SELECT p_partkey AS k, p_name AS n, translate(CAST(p_partkey AS STRING), '0123456789', 'aeioubdmnt') AS c,
         CAST(p_size AS STRING) || '/' || CAST(p_partkey % 7 AS STRING) AS num, p_brand AS b, CAST(10000 + p_partkey % 50 AS STRING) AS z
  FROM part
)
SELECT 'S1-' || CAST(k AS STRING) AS entity_id, 1 AS source, k AS number,
       n || ' ' || c || CASE k % 7 WHEN 0 THEN ' North Retail' ELSE '' END || CASE k % 4 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' Ltd.' WHEN 2 THEN ' LLC' ELSE ' Inc' END AS business_name,
       CASE WHEN k % 17 = 0 THEN '' ELSE num || ' ' || b || ' Road ' || z END AS business_address,
       CASE k % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
FROM p
UNION ALL
SELECT 'S2-' || CAST(k AS STRING), 2, k,
       CASE k % 5 WHEN 0 THEN upper(n || ' ' || c) || ' PVT. LTD.' WHEN 1 THEN '>> ' || n || ' ' || c || ' Limited' WHEN 2 THEN 'The ' || n || ' & ' || c || ' Co.'
                  WHEN 3 THEN n || ' ' || c || 'x Corporation' ELSE 'Étoile ' || reverse(c) || ' North Services' END,
       CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN num || ' ' || b || ' Rd. ' || z WHEN 2 THEN 'Shop No. ' || num || ', ' || b || ' Road, ' || z
                  WHEN 3 THEN '#0' || num || ' ' || b || ' Saint Avenue ' || z ELSE num || ' ' || b || ' Road ' || z END,
       CASE k % 3 WHEN 0 THEN 'USA' WHEN 1 THEN 'IND' ELSE 'fr' END
FROM p
UNION ALL
SELECT 'S3-' || CAST(k AS STRING), 3, k,
       CASE k % 4 WHEN 0 THEN 'Old Works formerly ' || n || ' ' || c || ' Inc.' WHEN 1 THEN n || ' ' || c || ' south express' WHEN 2 THEN 'www.' || n || ' ' || c || '.com'
                  ELSE 'Café ' || reverse(c) || ' Holdings Inc' END,
       CASE k % 5 WHEN 0 THEN num || ' ' || b || ' Road Uttar Pradesh ' || z WHEN 1 THEN CAST(k % 90 + 1 AS STRING) || ' ' || b || ' Lane ' || z
                  WHEN 2 THEN '' ELSE 'near Central Market, ' || num || ' ' || b || ' Road ' || z END,
       CASE k % 3 WHEN 0 THEN 'United States' WHEN 1 THEN 'india' ELSE 'France' END
FROM p
"""

#: Prose as entities (one letter written out, which engines take differently at word edges): accented names, the same name at other addresses, missing addresses, most of them without a match.
DOCUMENT_SQL = """
SELECT 'S' || CAST(doc_id % 3 + 1 AS STRING) || '-' || CAST(doc_id AS STRING) AS entity_id, CAST(doc_id % 3 + 1 AS INT) AS source, doc_id AS number,
       trim(substr(replace(text, 'ß', 'ss'), 1, 40)) AS business_name, trim(substr(replace(text, 'ß', 'ss'), 41, 80)) AS business_address, lang AS country
FROM documents
"""

TRUTH_SQL = """
SELECT 'S1-' || CAST(p_partkey AS STRING) AS source1_entity_id,
       CASE WHEN p_partkey % 5 <> 4 THEN ' S2-' || CAST(p_partkey AS STRING) || ',' ELSE '' END || CASE WHEN p_partkey % 4 <> 3 THEN 'S3-' || CAST(p_partkey AS STRING) ELSE '' END AS matched_entity_ids
FROM part
"""


#: For each part one true pair that is lost for a known reason: (reason, name, address, target name, target address, target country);
#: a colon stands for letters of the part's own.
LOST = [
    ("key pruned", "Common Works", "1 Alpha", "Common Works", "", "US"),
    ("truncated by top-k", "zw: plaza", "1 Alpha", "zw: plaza", "", "US"),
    ("indic script vs latin name", "kappa: mills", "1 elm", "टेक कंपनी", "2 oak", "France"),
    ("candidate address missing", "north: mills", "1 elm", "other: house", "", "France"),
    ("candidate name missing", "north: mills", "1 elm", "null", "2 oak", "France"),
    ("short business name", "ab", "1 elm", "longer: name", "2 oak", "France"),
    ("exact name without punctuation", "same: town", "1 elm", "same:-town", "2 oak", "France"),
    ("address similar, name alias", "alpha: house", "maple garden 5", "omega: mills", "maple garden 7", "France"),
    ("prefix-3 match", "strand:", "1 elm", "strong:", "2 oak", "France"),
    ("token variation", "river: view", "1 elm", "theriver:house", "2 oak", "France"),
    ("severe variation", "kappa:", "1 elm", "sigma:xx", "2 oak", "France"),
]


def lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of sources 1 and 2 whose pairs of equal numbers are lost for the reasons of ``LOST``, by number modulo their count."""
    part = stage.spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select(F.col("p_partkey").alias("k"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "aeioubdmnt").alias("own"))
    at = (F.col("k") % len(LOST) + 1).cast("int")
    cell = lambda i: F.replace(F.element_at(F.array(*[F.lit(x[i]) for x in LOST]), at), F.lit(":"), F.col("own"))
    sides = [
        part.select(F.concat(F.lit(f"S{n}-"), F.col("k").cast("string")).alias("entity_id"), F.lit(n).alias("source"), F.col("k").alias("number"), cell(i).alias("business_name"), cell(i + 1).alias("business_address"), (F.lit("US") if n == 1 else cell(5)).alias("country"))
        for n, i in ((1, 1), (2, 3))
    ]
    return sides[0].unionByName(sides[1])


def _run(spark: SparkSession, sf_dir: str, sql: str, table: str = "part") -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {rows}"), rows=stage.spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, source, number, business_name, business_address, country."""
    return _run(spark, sf_dir, ENTITY_SQL)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source1_entity_id and its comma-joined matches, empty for singletons."""
    return _run(spark, sf_dir, TRUTH_SQL)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns as ``entities`` from the heads of prose documents."""
    return _run(spark, sf_dir, DOCUMENT_SQL, "documents")
