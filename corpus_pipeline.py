"""Five stages from raw documents to token files, each an operator of lorespan.llm on all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.decontaminate import contamination
from lorespan.llm.mixture import mix_sources
from lorespan.llm.ngram_join import ngram_join
from lorespan.llm.quality import quality
from lorespan.llm.shared import new_dir, small, stored
from lorespan.llm.token_file import token_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id (null too) and text are in judged(doc_id, text_digest). No text is shuffled while these are few enough to broadcast."""
    gone = small(stored(judged.select(F.col("doc_id").alias("_id"), F.col("text_digest").alias("_d")), "dropped"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (_digest() == F.col("_d")), "left_anti").select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rows that it rejects (predicted 0) go. Each row is judged by its own text, whatever rows share its doc_id or have none."""
    judged = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), digests=True)
    return _without(docs, judged.filter("predicted = 0"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group that links join, the document with the smallest doc_id stays.

    Rows without doc_id come after all others: each different text of theirs is a document. Texts that share a doc_id are
    one document and stay or go together. Of rows that repeat a document's text, one stays. Texts without words are
    linked with nothing and stay.
    """
    nameless = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 61))
    rows = docs.select(*COLUMNS, F.coalesce(F.col("doc_id"), nameless).alias("_key"), _digest().alias("_d"))
    joined = ngram_join(rows.select(F.col("_key").alias("doc_id"), "text"))
    gone = small(stored(joined.filter("doc_id <> component_id").select(F.col("doc_id").alias("_key")), "dropped"))
    kept = rows.join(gone, "_key", "left_anti")
    again = stored(rows.select("_key", "_d").groupBy("_key", "_d").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    if again.limit(1).count():
        once = kept.join(small(again), ["_key", "_d"], "left_semi").dropDuplicates(["_key", "_d"])
        kept = kept.join(small(again), ["_key", "_d"], "left_anti").unionByName(once)
    return kept.select(*COLUMNS)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated rows go. Each row is judged by its own text."""
    return _without(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents repeated to the sources' target weights and shuffled globally."""
    return mix_sources(docs).select(*COLUMNS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files: a row for each document written, as read back from the files."""
    import public_tokenizers

    return token_file(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("ngram_join", keep_one_of_each),
    ("decontaminate", keep_clean),
    ("mixture", mix),
    ("token_file", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of sf_dir, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = new_dir(spark, f"stage{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Classifier and tokenizer can't be written in SQL: tests/llm holds each stage, and run(), against brute force.
ORACLE_SQL = None
