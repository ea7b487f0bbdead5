"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OP8_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY source
), target AS (
  SELECT source, bytes, pow(CAST(bytes AS DOUBLE), 0.5) AS weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN weight / (SELECT sum(weight) FROM target WHERE bytes > 0) * (SELECT CAST(sum(bytes) AS DOUBLE) FROM target) / bytes ELSE 1.0 END AS rate FROM target
), starts AS (
  SELECT source, rate, k, CASE WHEN rate <= 500 THEN exp(-rate) ELSE exp(k * ln(rate / k) - (rate - k) - ln(2 * pi() * k) / 2 - 1 / (12.0 * k) + 1 / (360.0 * k * k * k)) END AS p
  FROM (SELECT source, rate, CASE WHEN rate <= 500 THEN 0 ELSE CAST(floor(rate - 12 * sqrt(rate) - 20) AS INTEGER) END AS k FROM rates)
), cdf AS (
  SELECT source, rate, k, p, p AS c FROM starts
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
), drawn AS (
  SELECT d.*, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents AS d
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT min(k) + count(*) FILTER (cdf.c <= d.u) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source) AS n FROM drawn AS d
)
SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS mix_copy,
  md5('mix:order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || i) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM counted WHERE n > 0)
"""


#: Lines of each text, the two cuts by the hash of doc_id, and what stands where.
OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), hashed AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM cut
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM hashed
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""

_PII_KINDS = (
    # name, pattern, which matches count (m: match, d: its digits, b: text before), score, words that raise it, base kind
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 60, "e-?mail|mail|contact|correo|courriel|adresse", True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(TRY_CAST(right(x, 3) AS INT), 0) <= 255)) = 4", 50, "ip|host|server|address|adresse|addr", True),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND luhn(d)", 65, "card|credit|visa|mastercard|karte|carte|tarjeta", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15", 50, "phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|call|fax|mobile", True),
    ("iban", r"\b[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)\b", "mod97(replace(m, ' ', ''))", 60, "iban|account|konto|compte|cuenta|bank", False),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "NOT regexp_matches(m, '^(000|666|9..)-|-00-|-0000$')", 40, "ssn|social security", False),
    ("short_card", r"[0-9]([\x20-]?[0-9])+", "length(d) BETWEEN 13 AND 15 AND luhn(d)", 30, "card|credit|visa|amex|american express|karte|carte|tarjeta", False),
    ("local_phone", r"\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b", r"NOT regexp_matches(right(b, 40), '\+[0-9][\x20().0-9-]*$')", 30, "phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|call|fax|mobile", False),
    ("birth_date", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "regexp_matches(m, '^(19|20)..-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$')", 20, "born|birth|birthday|dob|geboren|nacid[oa]|naissance", False),
)


def _pii_sql() -> str:
    luhn = "list_sum([CASE WHEN (length(d) - k) % 2 = 0 THEN CAST(d[k] AS INT) ELSE 2 * CAST(d[k] AS INT) - CASE WHEN CAST(d[k] AS INT) > 4 THEN 9 ELSE 0 END END for k in range(1, length(d) + 1)]) % 10 = 0"
    letters = "array_to_string([CASE WHEN c < 'A' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END for c in string_split(m[5:] || m[1:4], '')], '')"
    mod97 = f"list_reduce(list_prepend(0, [CAST(c AS INT) for c in string_split({letters}, '')]), lambda s, c: (s * 10 + c) % 97) = 1"
    each = []
    for k, (name, pattern, counts, score, words, base) in enumerate(_PII_KINDS):
        near = f"(?i)(?:^|[^A-Za-z])(?:{words})(?:$|[^A-Za-z])"
        counts = counts.replace("luhn(d)", luhn).replace("mod97(replace(m, ' ', ''))", mod97.replace("m[", "replace(m, ' ', '')["))
        each.append(
            f"SELECT doc_id, {k} AS k, '{name}' AS kind, {base} AS base, s AS \"start\", s + length(m) AS \"end\", {score} + CASE WHEN regexp_matches(right(b, 40), '{near}') OR regexp_matches(left(a, 20), '{near}') THEN 35 ELSE 0 END AS score "
            f"FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, m[i] AS m, g[i] AS b, g[i + 1] AS a, list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS s FROM ("
            f"SELECT doc_id, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m FROM documents WHERE regexp_matches(text, '{pattern}'))))) WHERE {counts}"
        )
    spans = "SELECT * FROM (" + " UNION ALL ".join(each) + ") WHERE base OR score >= 50"
    listed = lambda more, of="true": f"coalesce(string_agg(kind || ':' || \"start\" || ':' || \"end\"{more}, ',' ORDER BY k, \"start\") FILTER (kind IS NOT NULL AND {of}), '')"
    scored = listed(" || ':' || score")
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{x[0]}') AS BIGINT) AS n_{x[0]}" for x in _PII_KINDS if x[-1])
    return (
        f"WITH rows AS (SELECT row_number() OVER () AS r, * FROM documents), spans AS (WITH documents AS (SELECT r AS doc_id, text FROM rows) {spans}) "
        f"SELECT any_value(rows.doc_id) AS doc_id, {counts}, sha256({listed('', 'base')}) AS base_sha256, {listed('')} AS spans, {scored} AS scored, CAST(count(kind) AS BIGINT) AS n_spans FROM rows LEFT JOIN spans ON spans.doc_id = r GROUP BY r"
    )


OP12_SQL = _pii_sql()

#: Whole numbers, all products of anchors with rows, the five best of the anchor's label, and the rows of others in their range.
OP13_SQL = """
WITH whole AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, a.label AS own, r.id, r.label, CAST(list_sum([a.v[k] * r.v[k] for k in range(1, len(a.v) + 1)]) AS BIGINT) AS score FROM whole a JOIN whole r ON a.id % 100 = 0
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE own = label AND anchor_id <> id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE own <> label AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents")).drop("text_digest")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_file import token_file

    return token_file(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_digest")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixture import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_fingerprints

    return media_fingerprints(_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_middle

    return fill_middle(_table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_report

    return pii_report(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    rows = _table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_join, op2_token_counts, op3_token_file, op4_decontaminate, op5_toxicity, op6_warc, op7_suffix_dedup, op8_mixture, op9_quality, op10_media, op11_fill_middle, op12_pii, op13_hard_negatives)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixture": OP8_SQL, "op11_fill_middle": OP11_SQL, "op12_pii": OP12_SQL, "op13_hard_negatives": OP13_SQL}
