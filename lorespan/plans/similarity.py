"""Recurrence and vector grouping over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import similarity as S

from .base import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


#: Whole documents as entry bodies. Two tags tell entries apart, and two are common (source, lang).
_REC = """rec AS (SELECT doc_id AS id, text, ['a' || CAST(doc_id // 6 AS VARCHAR), 'b' || CAST(n_chars % 1009 AS VARCHAR), source, lang] AS tags FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(regexp_replace(text, '\\*+|`+|_{1,2}|#+', ' ', 'g')), '[a-z][a-z0-9\\-]+')) AS term FROM rec) WHERE length(term) > 2 GROUP BY ALL),
w AS (SELECT id, term, tf, df, tf * (ln((1 + (SELECT count(*) FROM rec)) / (1 + df)) + 1) AS weight FROM tf JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)),
u AS (SELECT id, term, weight / sqrt(sum(weight ** 2) OVER (PARTITION BY id)) AS u FROM w),
cs AS (SELECT x.id AS a, y.id AS b, sum(x.u * y.u) AS cosine FROM u x JOIN u y ON x.term = y.term AND x.id < y.id GROUP BY ALL),
tg AS (SELECT id, unnest(tags) AS tag FROM rec),
tj AS (SELECT a, b, k / (8 - k) AS jaccard FROM (SELECT x.id AS a, y.id AS b, count(*) AS k FROM tg x JOIN tg y ON x.tag = y.tag AND x.id < y.id GROUP BY ALL)),
sp AS (SELECT a, b, coalesce(jaccard, 0) AS jaccard, coalesce(cosine, 0) AS cosine, (coalesce(jaccard, 0) + coalesce(cosine, 0)) / 2 AS similarity FROM cs FULL JOIN tj USING (a, b))"""


def _rec(s, d):
    i, n = F.col("doc_id"), F.col("n_chars")
    tags = F.array(F.concat(F.lit("a"), F.floor(i / 6).cast("string")), F.concat(F.lit("b"), (n % 1009).cast("string")), F.col("source"), F.col("lang"))
    return table(s, d, "documents").select(i.alias("id"), "text", tags.alias("tags"), F.col("source").alias("project_id"), F.col("lang").alias("family"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")), "yyyy-MM-dd").alias("date"))


@query(f"WITH {_REC} SELECT id, term, tf, df, round(weight, 6) AS weight FROM w")
def tfidf(s, d):
    return S.tfidf(_rec(s, d)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_REC} SELECT a, b, round(cosine, 6) AS cosine FROM cs WHERE cosine >= 0.8")
def cosine_pairs(s, d):
    return S.cosine_pairs(S.tfidf(_rec(s, d)), 0.8).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_REC} SELECT a, b, round(jaccard, 6) AS jaccard FROM tj WHERE jaccard > 0.5")
def tag_jaccard_pairs(s, d):
    return S.tag_jaccard_pairs(_rec(s, d), 0.5).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {_REC} SELECT a, b, round(jaccard, 6) AS jaccard, round(cosine, 6) AS cosine, round(similarity, 6) AS similarity FROM sp WHERE similarity >= 0.45")
def similar_pairs(s, d):
    return S.similar_pairs(_rec(s, d)).select("a", "b", *(F.round(c, 6).alias(c) for c in ("jaccard", "cosine", "similarity")))


_CC = """lk AS (SELECT a, b, similarity FROM sp WHERE similarity >= 0.45), ways AS (SELECT a, b FROM lk UNION SELECT b, a FROM lk),
walk(id, r) AS (SELECT DISTINCT a, a FROM ways UNION SELECT ways.b, walk.r FROM walk JOIN ways ON ways.a = walk.id), roots AS (SELECT id, min(r) AS root FROM walk GROUP BY id)"""
#: Cohesion from the similarity of every pair within a cluster, linked or not.
_RC = f"""WITH RECURSIVE {_REC}, {_CC}, sz AS (SELECT root, count(*) AS size FROM roots GROUP BY root), sm AS (SELECT root, sum(similarity) AS s FROM sp JOIN roots x ON x.id = a JOIN roots y ON y.id = b AND y.root = x.root GROUP BY root)""".replace("SELECT root, sum(similarity)", "SELECT x.root AS root, sum(similarity)").replace("y.root = x.root GROUP BY root)", "y.root = x.root GROUP BY x.root)") + """,
mx AS (SELECT root, max(similarity) FILTER (a = root) AS m, max(similarity) AS p FROM lk JOIN roots ON roots.id = a GROUP BY root),
kept AS (SELECT root, size, s / (size * (size - 1) / 2) AS cohesion, m, p, CASE WHEN m >= 0.65 THEN 'strong' WHEN m >= 0.45 THEN 'review' ELSE 'suppressed' END AS band FROM sz JOIN sm USING (root) JOIN mx USING (root) WHERE s / (size * (size - 1) / 2) >= 0.4)"""


@query(f"{_RC} SELECT root AS cluster, size, round(cohesion, 6) AS cohesion, round(m, 6) AS max_sim_rep, round(p, 6) AS max_sim_pair, band FROM kept")
def recurrence_clusters(s, d):
    rec = _rec(s, d)
    return S.recurrence_clusters(S.similar_links(rec), entries=rec)


@query(f"{_RC} SELECT rec.id, CASE WHEN band IS NOT NULL THEN root END AS cluster, coalesce(band, 'standalone') AS band FROM rec LEFT JOIN roots USING (id) LEFT JOIN kept USING (root)")
def band_clusters(s, d):
    return S.band_clusters(_rec(s, d))


@query(f"WITH RECURSIVE {_REC}, {_CC} SELECT id, root FROM roots")
def connected_components(s, d):
    return S.connected_components(S.similar_links(_rec(s, d)).select("a", "b"))


@query(
    f"WITH {_REC}, r AS (SELECT doc_id AS id, source AS p, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS dt FROM documents), bo AS (SELECT a, b, similarity FROM sp WHERE similarity >= 0.3 UNION ALL SELECT b, a, similarity FROM sp WHERE similarity >= 0.3), "
    "me AS (SELECT x.id AS entry, y.p AS target, b, similarity, y.dt >= '2024-03-01' AS fresh FROM bo JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE x.p <> y.p AND x.dt >= '2024-03-01' AND x.id % 13 <> 0) "
    "SELECT entry, target, round(max(similarity), 6) AS similarity, arg_max(b, (round(similarity, 9), -b)) AS like FROM me GROUP BY entry, target HAVING coalesce(max(similarity) FILTER (fresh), 0) < 0.65".replace(" AS like", ' AS "like"')
)
def transfer_candidates(s, d):
    rec = _rec(s, d)
    return S.similar_transfers(rec, 0.3, rec.filter("id % 13 = 0"), "2024-03-01")


@query(
    f"WITH {_REC}, mb AS (SELECT id, id % 7 AS cluster FROM rec), tc AS (SELECT cluster, t, count(*) AS w FROM (SELECT cluster, unnest(tags) AS t FROM mb JOIN rec USING (id) WHERE cluster > 1) GROUP BY ALL), wt AS (SELECT cluster, term AS t, round(sum(weight), 6) AS w FROM mb JOIN w USING (id) WHERE cluster <= 1 GROUP BY ALL), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, t) AS k FROM (SELECT cluster, lower(t) AS t, CAST(w AS DOUBLE) AS w FROM tc UNION ALL SELECT * FROM wt)) SELECT cluster, string_agg(t, ' / ' ORDER BY k) AS theme FROM k WHERE k <= 3 GROUP BY cluster"
)
def cluster_theme(s, d):
    rec = _rec(s, d)
    members = rec.select("id", (F.col("id") % 7).alias("cluster"))
    return S.cluster_theme(members, rec.withColumn("tags", F.when(F.col("id") % 7 > 1, F.col("tags"))), S.tfidf(rec))


@query(
    "WITH m AS (SELECT doc_id // 3 AS cluster, ['structural', 'convention', 'ambient-awareness', 'unknown', 'structural', 'convention', 'ambient-awareness'][CAST(doc_id * 5 % 7 + 1 AS INT)] AS m FROM documents), g AS (SELECT cluster, count(*) AS n, list(DISTINCT m) AS s, count(*) FILTER (m = 'ambient-awareness') AS n_ambient FROM m GROUP BY 1) "
    "SELECT cluster, n, n_ambient, CASE WHEN s = ['structural'] THEN 'all_structural' WHEN s = ['convention'] THEN 'all_convention' WHEN n_ambient > 0 AND NOT list_contains(s, 'structural') THEN 'promote_ambient' WHEN n_ambient > 0 THEN 'check_cover' ELSE 'review' END AS action FROM g"
)
def suggest_action(s, d):
    i = F.col("doc_id")
    kinds = F.array(*(F.lit(x) for x in ("structural", "convention", "ambient-awareness", "unknown", "structural", "convention", "ambient-awareness")))
    return S.suggest_action(table(s, d, "documents").select(F.floor(i / 3).alias("cluster"), F.element_at(kinds, (i * 5 % 7 + 1).cast("int")).alias("mitigation")))


_CT = """wo AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda x: x NOT IN ('the', 'and')) AS w FROM documents),
te AS (SELECT id, unnest(list_concat(w, [w[k] || ' ' || w[k + 1] for k in range(1, len(w))])) AS term FROM wo), tf AS (SELECT id, term, count(*) AS tf FROM te GROUP BY ALL),
ke AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 5000),
we AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN ke USING (term)), un AS (SELECT id, term, w / sqrt(sum(w ** 2) OVER (PARTITION BY id)) AS u FROM we),
sz AS (SELECT doc_id % 4 AS cluster, count(*) AS size FROM documents GROUP BY 1), me AS (SELECT id % 4 AS cluster, term, round(sum(u) / any_value(size), 6) AS score FROM un JOIN sz ON cluster = id % 4 GROUP BY ALL),
ct AS (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS INT) AS k, term, score FROM me QUALIFY k <= 10)"""


def _terms(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.cluster_terms(docs, docs.select("id", (F.col("id") % 4).alias("cluster")), ("the", "and"))


@query(f"WITH {_CT} SELECT cluster, k, term, score FROM ct")
def cluster_terms(s, d):
    return _terms(s, d)


_SC = """em AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS v, vec_id % 6 AS p, vec_id % 3 AS f FROM embeddings), uv AS (SELECT id, cluster, p, f, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM em),
ce AS (SELECT cluster, list(x ORDER BY k) AS c FROM (SELECT cluster, k, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM uv) GROUP BY ALL) GROUP BY cluster),
ne AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY round(list_dot_product(v, c), 9) DESC, id) AS k FROM uv JOIN ce USING (cluster)), tp AS (SELECT cluster, string_agg(id, ',' ORDER BY k) AS examples FROM ne WHERE k <= 8 GROUP BY 1),
fa AS (SELECT cluster, count(*) AS size, string_agg(DISTINCT 'f' || f, ',' ORDER BY 'f' || f) AS families, string_agg(DISTINCT 'p' || p, ',' ORDER BY 'p' || p) AS projects, count(DISTINCT f) AS nf FROM uv GROUP BY 1)"""


def _summary(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster"), F.concat(F.lit("p"), (F.col("vec_id") % 6).cast("string")).alias("project_id"), F.concat(F.lit("f"), (F.col("vec_id") % 3).cast("string")).alias("family"))
    return S.summarize_clusters(e.select("id", "cluster"), e, e)


@query(f"WITH {_SC} SELECT cluster, size, families, projects, examples, CAST(row_number() OVER (ORDER BY nf DESC, size DESC, cluster) AS INT) AS rank FROM fa JOIN tp USING (cluster)")
def summarize_clusters(s, d):
    return _summary(s, d).select("cluster", "size", F.array_join("families", ",").alias("families"), F.array_join("projects", ",").alias("projects"), F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"), "rank")


@query(
    f"WITH {_CT}, la AS (SELECT cluster, regexp_replace(regexp_replace(lower(string_agg(term, '-' ORDER BY k) FILTER (k <= 2)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s, string_agg(term, ' ' ORDER BY k) FILTER (k <= 2) AS l, string_agg(term, ',' ORDER BY k) FILTER (k <= 6) AS keywords FROM ct GROUP BY 1) "
    "SELECT cluster, coalesce(nullif(s, ''), 'untitled') AS slug, lower(l) AS label, keywords FROM la"
)
def label_clusters(s, d):
    terms = _terms(s, d)
    summaries = terms.select("cluster").distinct().withColumn("size", F.lit(1)).withColumn("examples", F.array(F.lit(1)))
    return S.label_clusters(terms, summaries).select("cluster", "slug", F.lower("label").alias("label"), F.array_join("keywords", ",").alias("keywords"))


def _emb(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_COS = "list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))"


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round(1 - {_COS}, 6) AS distance FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE 1 - {_COS} < 0.7")
def vector_pairs(s, d):
    return S.vector_pairs(_emb(s, d), 0.7).withColumn("distance", F.round("distance", 6))


@query()
def cluster_vectors(s, d):
    return S.cluster_vectors(_emb(s, d), 0.7, 3)


@query(
    f"WITH n AS (SELECT y.vec_id AS id, x.label, row_number() OVER (PARTITION BY y.vec_id ORDER BY round({_COS}, 9) DESC, x.vec_id) AS r FROM embeddings x JOIN embeddings y ON x.vec_id % 5 <> 0 AND y.vec_id % 5 = 0), v AS (SELECT id, label, count(*) AS n FROM n WHERE r <= 15 GROUP BY ALL) "
    "SELECT id, CAST(label AS BIGINT) AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM v) WHERE k = 1"
)
def knn_predict(s, d):
    e = _emb(s, d)
    return S.knn_predict(e.filter("id % 5 <> 0"), e.filter("id % 5 = 0"))
