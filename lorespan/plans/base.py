"""The given tables as the library's data model: the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions.text import first_line

KINDS = ("learning", "decision", "finding", "convention")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where a row of placed() stands in its table: SQL that leaves ties open, or adds up floats, goes by it.
PLACE = ("_file", "_row")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """table() with the place of each row."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as dated entries: source is the project, lang the family."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("source").alias("project_id"), F.col("lang").alias("family"), first_line(F.col("text")).alias("title"), F.col("text").alias("body"), "text",
        F.when(i % 7 != 0, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")), "yyyy-MM-dd")).alias("date"),
        F.array(F.col("lang"), F.concat(F.lit("band"), F.least(F.floor(F.col("n_chars") / 1000), F.lit(5)).cast("string")), F.concat(F.lit("k"), (i % 5).cast("string"))).alias("tags"),
        F.element_at(F.array(*(F.lit(k) for k in KINDS)), (i % 4 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("projects/"), F.col("source"), F.lit("/"), F.element_at(F.array(*(F.lit(k) for k in KINDS)), (i % 4 + 1).cast("int")), F.lit(".md")).alias("path"),
        F.when(i % 10 == 3, "tombstone").otherwise("active").alias("status"),
    )


ENTRIES = """
entries AS (
  SELECT doc_id AS id, source AS project_id, lang AS family, split_part(text, chr(10), 1) AS title, text AS body, text,
    CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') END AS date,
    [lang, 'band' || CAST(least(n_chars // 1000, 5) AS VARCHAR), 'k' || CAST(doc_id % 5 AS VARCHAR)] AS tags,
    ['learning', 'decision', 'finding', 'convention'][CAST(doc_id % 4 + 1 AS INTEGER)] AS kind,
    'projects/' || source || '/' || ['learning', 'decision', 'finding', 'convention'][CAST(doc_id % 4 + 1 AS INTEGER)] || '.md' AS path,
    CASE WHEN doc_id % 10 = 3 THEN 'tombstone' ELSE 'active' END AS status
  FROM documents)"""

CONCEPTS_SCHEMA = "slug string, status string, aliases array<string>, positive_keywords array<string>, negative_keywords array<string>, required_any array<string>, project_scope array<string>, match_mode string"
CONCEPT_ROWS = [
    ("licensing", "confirmed", ["license", "licensed"], ["apache"], [], [], None, "hybrid"),
    ("versions", "candidate", [], ["apache", "license"], ["example"], ["version"], None, "keyword"),
    ("public-licence", "candidate", ["general public license"], [], [], [], None, "alias"),
    ("ther", "confirmed", ["ther"], ["thre"], [], [], ["src0", "src1", "src2", "src3"], "hybrid"),
    ("thre", "curated_singleton", ["thre"], [], [], [], None, "alias"),
    ("nowhere", "confirmed", ["zyxnowhere"], [], [], [], None, "alias"),
]


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONCEPT_ROWS, CONCEPTS_SCHEMA)


def _sql_list(x: list[str] | None) -> str:
    return "NULL" if x is None else "CAST([" + ", ".join(f"'{v}'" for v in x) + "] AS VARCHAR[])"


CONCEPTS = "concepts(slug, status, aliases, positive_keywords, negative_keywords, required_any, project_scope, match_mode) AS (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', {', '.join(_sql_list(x) for x in r[2:7])}, '{r[7]}')" for r in CONCEPT_ROWS) + ")"

EDGES = """
normal AS (SELECT id, project_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM entries),
terms AS (
  SELECT slug, 'alias' AS level, unnest(aliases) AS term FROM concepts UNION ALL SELECT slug, 'positive', unnest(positive_keywords) FROM concepts
  UNION ALL SELECT slug, 'negative', unnest(negative_keywords) FROM concepts UNION ALL SELECT slug, 'required_any', unnest(required_any) FROM concepts),
hits AS (SELECT id AS entry, project_id, slug, level, term FROM normal JOIN terms ON contains(t, term) AND regexp_matches(t, '(^|[^\\p{L}\\p{N}_])' || term || '([^\\p{L}\\p{N}_]|$)')),
seen AS (
  SELECT entry, project_id, slug, min(term) FILTER (level = 'alias') AS a, min(term) FILTER (level = 'positive') AS p,
    min(term) FILTER (level = 'required_any') AS r, bool_or(level = 'negative') AS vetoed FROM hits GROUP BY ALL),
edges AS (
  SELECT * FROM (
    SELECT entry, slug, coalesce(CASE WHEN match_mode IN ('alias', 'hybrid') THEN a END, r, CASE WHEN match_mode IN ('keyword', 'hybrid') THEN p END) AS trigger,
      CASE WHEN match_mode IN ('alias', 'hybrid') AND a IS NOT NULL THEN '1.00' WHEN r IS NOT NULL THEN '0.80' ELSE '0.50' END AS confidence, 'auto' AS provenance
    FROM seen JOIN concepts USING (slug)
    WHERE NOT vetoed AND (len(required_any) = 0 OR r IS NOT NULL) AND (project_scope IS NULL OR list_contains(project_scope, project_id)))
  WHERE trigger IS NOT NULL)"""
GRAPH = f"WITH {ENTRIES}, {CONCEPTS}, {EDGES}"
STATUS = """
status AS (
  SELECT slug, status, coalesce(n_entries, 0) AS n_entries, coalesce(n_families, 0) AS n_families,
    CASE WHEN status = 'curated_singleton' THEN status WHEN n_entries >= 2 AND n_families >= 2 THEN 'confirmed' ELSE 'candidate' END AS effective
  FROM concepts LEFT JOIN (SELECT slug, count(DISTINCT entry) AS n_entries, count(DISTINCT family) AS n_families FROM edges JOIN entries ON entry = id GROUP BY slug) USING (slug))"""
