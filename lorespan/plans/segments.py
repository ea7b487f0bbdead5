"""Segmentation of the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import segment as G
from lorespan.operators import stats as S

from .base import ENTRIES, entries, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_L = "l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), m AS (SELECT id, pos, CASE WHEN length(line) % 3 = 0 THEN '## D-' || CAST(pos AS VARCHAR) || ' ' || line WHEN length(line) % 3 = 1 THEN '### ' || line ELSE '- ' || line END AS line, length(line) % 3 AS c FROM l)"


def _docs(s, d):
    """documents with headings by a fixed rule on the lines' lengths."""
    lines = F.split("text", "\n")
    mark = lambda x, i: F.when(F.length(x) % 3 == 0, F.concat(F.lit("## D-"), i.cast("string"), F.lit(" "), x)).when(F.length(x) % 3 == 1, F.concat(F.lit("### "), x)).otherwise(F.concat(F.lit("- "), x))
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.transform(lines, mark), "\n").alias("text"))


def _sql(start: str) -> str:
    return f"WITH {_L}, k AS (SELECT *, sum(CASE WHEN {start} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS k FROM m) SELECT id, CAST(k AS BIGINT) AS k, min(pos) AS line_start, max(pos) AS line_end, md5(string_agg(line, chr(10) ORDER BY pos)) AS body FROM k WHERE k > 0 GROUP BY id, k"


def _hashed(df):
    return df.select("id", "k", "line_start", "line_end", F.md5("body").alias("body"))


@query(_sql("c = 0"))
def split_by_signature(s, d):
    return _hashed(G.split_by_signature(_docs(s, d)))


@query(_sql("c = 1"))
def split_by_prefix(s, d):
    return _hashed(G.split_by_prefix(_docs(s, d), "### "))


@query(f"WITH {_L}, h AS (SELECT *, max(CASE WHEN c = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS two, max(CASE WHEN c = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS three FROM m), k AS (SELECT *, sum(CASE WHEN CASE WHEN two = 1 THEN c = 0 WHEN three = 1 THEN c = 1 ELSE pos = 0 END THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS k FROM h) SELECT id, CAST(k AS BIGINT) AS k, min(pos) AS line_start, max(pos) AS line_end, md5(string_agg(line, chr(10) ORDER BY pos)) AS body FROM k WHERE k > 0 GROUP BY id, k")
def split_with_fallback(s, d):
    return _hashed(G.split_with_fallback(_docs(s, d)))


@query(f"WITH {_L}, k AS (SELECT *, last_value(CASE WHEN c < 2 THEN c END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS h FROM m) SELECT id, pos, substr(line, 3) AS question FROM k WHERE h = 1 AND c = 2 AND regexp_matches(line, '^- +\\S')")
def open_questions(s, d):
    docs = _docs(s, d)
    return G.open_questions(docs.select("id", F.regexp_replace("text", r"(?m)^### .*$", "### Open Questions").alias("text")))


@query(f"WITH {ENTRIES}, r AS (SELECT id, row_number() OVER (ORDER BY date DESC NULLS LAST, id) AS rank, count(*) OVER () AS t FROM entries) SELECT id, rank FROM r WHERE rank <= 250 OR (rank - 251) % greatest(1, (t - 250) // 250) = 0")
def sample_newest(s, d):
    return G.sample_newest(entries(s, d).select("id", "date")).select("id", "rank")


@query(
    "WITH f AS (SELECT source AS category, lang AS severity, count(*) AS counted FROM documents GROUP BY ALL), t AS (SELECT category, severity, counted + CASE WHEN severity = 'de' THEN 1 ELSE 0 END AS declared, 1 AS n FROM f WHERE category <> 'src3' UNION ALL SELECT 'src0', 'en', 0, 1), u AS (SELECT category, severity, CAST(sum(declared) AS BIGINT) AS declared, count(*) AS n FROM t GROUP BY ALL), "
    "c AS (SELECT category, severity, counted, declared, n FROM f FULL JOIN u USING (category, severity)), a AS (SELECT * FROM c UNION ALL SELECT category, NULL, coalesce(sum(counted), 0), coalesce(sum(declared), 0), 1 FROM c GROUP BY ROLLUP (category)) "
    "SELECT category, severity, CAST(coalesce(counted, 0) AS BIGINT) AS counted, CAST(coalesce(declared, 0) AS BIGINT) AS declared, CASE WHEN n > 1 THEN 'duplicate' WHEN declared IS NULL THEN 'missing' WHEN counted IS NULL THEN 'unexpected' ELSE 'count' END AS problem FROM a WHERE n > 1 OR declared IS NULL OR counted IS NULL OR counted <> declared"
)
def validate_tally(s, d):
    f = table(s, d, "documents").select(F.col("source").alias("category"), F.col("lang").alias("severity"))
    tally = f.filter("category <> 'src3'").groupBy("category", "severity").agg((F.count("*") + F.when(F.col("severity") == "de", 1).otherwise(0)).alias("n"))
    again = s.range(1).select(F.lit("src0").alias("category"), F.lit("en").alias("severity"), F.lit(0).cast("long").alias("n"))
    return G.validate_tally(f, tally.unionByName(again))


@query("SELECT report, id, expected FROM (SELECT source AS report, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS expected FROM documents) WHERE id <> expected")
def sequence_gaps(s, d):
    return G.sequence_gaps(table(s, d, "documents").select(F.col("source").alias("report"), F.col("doc_id").alias("id")))


@query("WITH c AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT round(avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus <> 'F'), 4) AS mean_diff, (SELECT count(*) FROM orders, c WHERE abs(o_totalprice - m) > 1.5 * s) AS n_removed FROM orders, c WHERE abs(o_totalprice - m) <= 1.5 * s")
def outlier_removed_rerun(s, d):
    o = table(s, d, "orders")
    return S.outlier_removed_rerun(o, F.col("o_orderstatus") == "F", "o_totalprice", 1.5).select(F.round("mean_diff", 4).alias("mean_diff"), "n_removed")
