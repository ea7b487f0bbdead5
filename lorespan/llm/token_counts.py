"""Token counts by a digest cache: every distinct text is encoded once, ever, for each tokenizer version."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import batches, encoder
from .shared import arrow_rows, first_copies, new_dir, small, stored

CACHE_SCHEMA = "digest string, version string, n_tokens long"
#: Session setting with the folder of a cache that outlives the call; where it is unset, each call has a cache of its own.
CACHE_SETTING = "lorespan.tokenCounts.cache"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: a changed file never meets counts of the old one."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(tokenizer: str):
    def run(rows):
        enc = encoder(tokenizer)
        for batch in rows:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            n = [len(x) // 4 for part in batches(texts) for x in enc.encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def _cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The counts kept at path for this version; none if nothing has been appended. Repeated appends of a digest count once."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs(doc_id, text).

    cache is a folder of counts by content digest and tokenizer version; digests that it lacks are encoded, one text for
    each, and appended. Without cache the session's CACHE_SETTING names it, and without that a new one is made in the
    shared folder. Counts are of the exact text, so null as empty is the only normalisation.

    Null and empty text: 0 bytes, 0 tokens. Repeated rows and rows without doc_id each give a row of their own. An empty
    table gives an empty result. Other columns, whatever their names, are left out. Texts are never cut.
    """
    spark = docs.sparkSession
    cache = cache or spark.conf.get(CACHE_SETTING, None) or new_dir(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("_text"), F.sha2(text, 256).alias("digest"))
    slim = stored(docs.select("doc_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "digests")
    known = stored(_cache(spark, cache, version).join(slim.select("digest").distinct(), "digest", "left_semi"), "known")
    missing = first_copies(docs, slim.drop("n_bytes"), "digest").join(small(known.select("digest")), "digest", "left_anti")
    with arrow_rows(spark, 1_000):
        new = stored(missing.select("digest", "_text").mapInArrow(_count(tokenizer), "digest string, n_tokens long"), "counts")
    new.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    # rows that repeat a doc_id and a text are counted twice above, and once here; stored, so that a join by a hot digest can be split
    counts = small(stored(known.unionByName(new).dropDuplicates(["digest"]), "classes"))
    return slim.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
