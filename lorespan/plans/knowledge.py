"""Knowledge map: linking, validation, roll-ups and views over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import link as L
from lorespan.operators import rollup as R

from .base import ENTRIES, GRAPH, STATUS, concepts, entries, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _graph(s, d):
    e, c = entries(s, d), concepts(s)
    return e, c, L.link_entries(e.select("id", "project_id", "text"), c)


@query(f"{GRAPH} SELECT * FROM edges")
def link_entries(s, d):
    return _graph(s, d)[2]


@query(f"{GRAPH}, {STATUS} SELECT slug, status, n_entries, n_families, effective FROM status")
def concept_status(s, d):
    e, c, x = _graph(s, d)
    return R.effective_status(c, x, e)


@query(f"{GRAPH} SELECT trigger, count(*) AS n_edges FROM edges GROUP BY trigger HAVING count(*) > 5")
def mass_link_guard(s, d):
    return L.mass_link_guard(_graph(s, d)[2], 5)


_OVER = """overrides AS (
  SELECT DISTINCT doc_id AS entry, CASE WHEN doc_id % 2 = 0 THEN 'licensing' ELSE 'ther' END AS slug, CASE WHEN doc_id % 3 = 0 THEN 'block' ELSE 'force' END AS action FROM documents WHERE doc_id % 20 < 2)"""


def _overrides(s, d):
    i = F.col("doc_id")
    return table(s, d, "documents").filter(i % 20 < 2).select(i.alias("entry"), F.when(i % 2 == 0, "licensing").otherwise("ther").alias("slug"), F.when(i % 3 == 0, "block").otherwise("force").alias("action"))


@query(
    f"{GRAPH}, {_OVER}, remaining AS (SELECT * FROM edges WHERE NOT EXISTS (SELECT 1 FROM overrides o WHERE o.action = 'block' AND o.entry = edges.entry AND o.slug = edges.slug)) "
    "SELECT * FROM remaining UNION ALL SELECT entry, slug, NULL, '1.00', 'manual' FROM overrides o WHERE action = 'force' AND NOT EXISTS (SELECT 1 FROM remaining r WHERE r.entry = o.entry AND r.slug = o.slug)"
)
def apply_overrides(s, d):
    return L.apply_overrides(_graph(s, d)[2], _overrides(s, d))[0]


@query(f"{GRAPH}, {_OVER} SELECT o.entry, o.slug, o.action FROM overrides o WHERE (action = 'force') = EXISTS (SELECT 1 FROM edges e WHERE e.entry = o.entry AND e.slug = o.slug)")
def stale_overrides(s, d):
    return L.apply_overrides(_graph(s, d)[2], _overrides(s, d))[1]


@query(f"{GRAPH} SELECT edges.* FROM edges JOIN entries ON entry = id WHERE entries.status = 'active'")
def live_edges(s, d):
    e, c, x = _graph(s, d)
    return L.live_edges(x, e, c)


@query(f"WITH {ENTRIES} SELECT DISTINCT project_id, CASE WHEN length(project_id) = 4 THEN upper(project_id) ELSE project_id END AS name, CASE WHEN length(project_id) = 4 THEN 'short' ELSE 'unknown' END AS family, length(project_id) = 4 AS known FROM entries WHERE status = 'active'")
def project_hubs(s, d):
    e = entries(s, d)
    known = e.select("project_id").distinct().filter(F.length("project_id") == 4).select("project_id", F.upper("project_id").alias("name"), F.lit("short").alias("family"))
    return L.project_hubs(e, known)


_LOGS = "logs AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS project, CASE WHEN turn % 5 <> 4 THEN strftime(DATE '2024-01-01' + CAST(turn % 3 AS INTEGER), '%Y-%m-%d') END AS date, turn AS seq, role AS path FROM conversations)"


def _logs(s, d):
    t = F.col("turn")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (t % 3).cast("int")), "yyyy-MM-dd")
    return table(s, d, "conversations").select((F.col("conv_id") * 1000 + t).alias("id"), F.col("conv_id").cast("string").alias("project"), F.when(t % 5 != 4, day).alias("date"), t.alias("seq"), F.col("role").alias("path"))


@query(f"WITH {_LOGS} SELECT * FROM (SELECT id AS from_id, lag(id) OVER (PARTITION BY project ORDER BY date ASC NULLS LAST, seq ASC NULLS LAST, path) AS to_id FROM logs) WHERE to_id IS NOT NULL")
def follows_edges(s, d):
    return L.follows_edges(_logs(s, d))


@query(f"{GRAPH} SELECT id, project_id, family FROM entries WHERE id NOT IN (SELECT entry FROM edges)")
def orphans(s, d):
    e, _, x = _graph(s, d)
    return L.orphans(e.select("id", "project_id", "family"), x)


@query(
    f"{GRAPH}, {_LOGS}, bad AS (SELECT entry + CASE WHEN entry % 9 = 0 THEN 10000000 ELSE 0 END AS entry, CASE WHEN entry % 11 = 0 THEN 'gone' ELSE slug END AS slug FROM edges), "
    "fol AS (SELECT from_id, to_id FROM (SELECT id AS from_id, lag(id) OVER (ORDER BY id) AS to_id FROM logs) WHERE to_id IS NOT NULL) "
    "SELECT 'duplicate_entry' AS violation, CAST(id AS VARCHAR) AS subject FROM entries GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'dangling_entry', CAST(entry AS VARCHAR) FROM bad WHERE entry NOT IN (SELECT id FROM entries) "
    "UNION ALL SELECT DISTINCT 'dangling_concept', slug FROM bad WHERE slug NOT IN (SELECT slug FROM concepts) "
    "UNION ALL SELECT 'confirmed_without_evidence', slug FROM concepts WHERE status = 'confirmed' AND slug NOT IN (SELECT slug FROM bad) UNION ALL SELECT 'follows_across_projects', CAST(from_id AS VARCHAR) FROM fol WHERE from_id // 1000 <> to_id // 1000"
)
def validate_graph(s, d):
    e, c, x = _graph(s, d)
    i = F.col("entry")
    bad = x.select((i + F.when(i % 9 == 0, 10_000_000).otherwise(0)).alias("entry"), F.when(i % 11 == 0, "gone").otherwise(F.col("slug")).alias("slug"))
    logs = _logs(s, d)
    follows = L.follows_edges(logs.select("id", F.lit("all").alias("project"), F.lit(None).cast("string").alias("date"), F.col("id").alias("seq"), "path"))
    return L.validate_graph(e, c, bad, follows, logs)


@query(f"WITH {ENTRIES} SELECT DISTINCT project_id FROM entries WHERE project_id NOT IN ('src0', 'src1', 'src2')")
def unmapped(s, d):
    e = entries(s, d)
    known = e.select("project_id").distinct().filter(F.col("project_id").isin("src0", "src1", "src2"))
    return L.unmapped(e.select(F.concat("project_id", F.lit("/"), "kind").alias("path")), known)


@query(f"{GRAPH} SELECT id, CAST(coalesce(string_agg(DISTINCT slug, ',' ORDER BY slug), '') AS VARCHAR) AS mentions FROM entries LEFT JOIN edges ON entry = id WHERE kind = 'learning' GROUP BY id")
def collect_mentions(s, d):
    e, _, x = _graph(s, d)
    return L.collect_mentions(e.filter("kind = 'learning'"), x).select("id", F.array_join("mentions", ",").alias("mentions"))


@query(f"{GRAPH} SELECT project_id, count(DISTINCT slug) AS n_concepts FROM edges JOIN entries ON entry = id GROUP BY project_id")
def concepts_touched(s, d):
    e, _, x = _graph(s, d)
    return L.concepts_touched(e, x)


@query(
    f"{GRAPH}, {STATUS}, r AS (SELECT DISTINCT slug, entry, family, project_id, title FROM edges JOIN entries ON entry = id WHERE slug IN (SELECT slug FROM status WHERE effective = 'confirmed')), "
    "top AS (SELECT slug, string_agg(CAST(entry AS VARCHAR), ',' ORDER BY k) AS example_ids, string_agg(title, ' | ' ORDER BY k) AS titles FROM (SELECT slug, entry, title, row_number() OVER (PARTITION BY slug ORDER BY project_id, title, entry) AS k FROM r) WHERE k <= 3 GROUP BY slug), "
    "pr AS (SELECT slug, string_agg(project_id || ': ' || n, ', ' ORDER BY project_id || ': ' || n) AS projects FROM (SELECT slug, project_id, count(*) AS n FROM r GROUP BY ALL) GROUP BY slug) "
    "SELECT slug, count(DISTINCT family) AS span, count(DISTINCT entry) AS n_entries, string_agg(DISTINCT family, ',' ORDER BY family) AS families, any_value(projects) AS projects, any_value(example_ids) AS example_ids, md5(any_value(titles)) AS titles FROM r JOIN top USING (slug) JOIN pr USING (slug) GROUP BY slug"
)
def cross_family_concepts(s, d):
    e, c, x = _graph(s, d)
    return R.cross_family_concepts(R.effective_status(c, x, e), x, e).withColumn("titles", F.md5("titles"))


_NAMES = T.STAGES[:-1]
_STAGED = "staged AS (SELECT project_id, ['planning', 'figure_generation', 'evaluation', 'analysis', 'unassigned'][CAST(id % 5 + 1 AS INT)] AS stage FROM entries)"


@query(f"WITH {ENTRIES}, {_STAGED} SELECT project_id, " + ", ".join(f"count(*) FILTER (stage = '{x}') AS {x}" for x in _NAMES) + " FROM staged GROUP BY project_id")
def lifecycle_matrix(s, d):
    i = F.col("id")
    pick = lambda *x: F.element_at(F.array(*(F.lit(v) for v in x)), (i % 5 + 1).cast("int"))
    stage = T.infer_stage(pick("docs/plans/a.md", "b/figures/c.md", "n.md", "n.md", "n.md"), pick("", "", "Kappa", "a prompt", "else"), F.array())
    return R.lifecycle_matrix(entries(s, d).withColumn("stage", stage), _NAMES)


@query(f"{GRAPH}, {STATUS} SELECT slug, effective, (SELECT count(*) FROM edges WHERE edges.slug = status.slug) AS n_edges FROM status")
def elevation_ladder(s, d):
    e, c, x = _graph(s, d)
    return R.elevation_ladder(R.effective_status(c, x, e), x)


@query(f"{GRAPH}, {STATUS} SELECT * FROM status WHERE status = 'confirmed' AND effective = 'candidate'")
def stale_concepts(s, d):
    e, c, x = _graph(s, d)
    return R.stale_concepts(R.effective_status(c, x, e))


@query(
    f"{GRAPH} SELECT 'concept' AS kind, slug AS name, count(DISTINCT entry) AS n_entries, count(DISTINCT family) AS n_families FROM edges JOIN entries ON entry = id GROUP BY slug HAVING count(DISTINCT entry) >= 3 AND count(DISTINCT family) >= 2 "
    "UNION ALL SELECT 'tag', tag, count(DISTINCT id), count(DISTINCT family) FROM (SELECT id, family, unnest(tags) AS tag FROM entries WHERE kind = 'learning') GROUP BY tag HAVING count(DISTINCT id) >= 3"
)
def crystallization_candidates(s, d):
    e, _, x = _graph(s, d)
    return R.crystallization_candidates(x, e)


@query(f"{GRAPH} SELECT count(*) AS total, count(x.entry) AS connected, round(100.0 * count(x.entry) / count(*), 1) AS pct FROM entries LEFT JOIN (SELECT DISTINCT entry FROM edges) x ON entry = id")
def projected_coverage(s, d):
    e, _, x = _graph(s, d)
    return R.projected_coverage(e, x)


@query(
    f"WITH {ENTRIES}, r AS (SELECT DISTINCT id, unnest(tags) AS tag FROM entries), top AS (SELECT tag, count(*) AS n_entries FROM r GROUP BY tag HAVING count(*) >= 2 ORDER BY n_entries DESC, tag LIMIT 6) "
    "SELECT tag, n_entries, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS last_ids FROM (SELECT tag, n_entries, id, row_number() OVER (PARTITION BY tag ORDER BY id DESC) AS k FROM r JOIN top USING (tag)) WHERE k <= 5 GROUP BY tag, n_entries"
)
def tag_clusters(s, d):
    return R.tag_clusters(entries(s, d))


@query(f"WITH {ENTRIES} SELECT DISTINCT unnest(tags) AS tag, id FROM entries")
def inverted_index(s, d):
    return R.inverted_index(entries(s, d))


@query(
    f"WITH {ENTRIES}, t AS (SELECT path, md5(string_agg(t, ' | ' ORDER BY id)) AS topics FROM (SELECT path, id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\\[\\d{{4}}-\\d{{2}}-\\d{{2}}\\]', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\[[^\\]]+\\]', '', 'g'), '^#+\\s*', ''), ' :-–—'), '') AS t, row_number() OVER (PARTITION BY path ORDER BY id) AS k FROM entries) WHERE k <= 5 GROUP BY path), "
    "lg AS (SELECT 'src' || CAST(conv_id % 20 AS VARCHAR) AS p, count(*) AS n FROM conversations GROUP BY 1) "
    "SELECT path, count(*) AS n_entries, CAST(sum(len(string_split(body, chr(10)))) AS BIGINT) AS n_lines, sum(len(string_split(body, chr(10)))) > 500 AS is_large, max(date) AS updated, coalesce(any_value(topics), md5('')) AS topics, coalesce(any_value(n), 0) AS n_logs FROM entries JOIN t USING (path) LEFT JOIN lg ON p = project_id GROUP BY path"
)
def quick_reference(s, d):
    logs = table(s, d, "conversations").select(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("project_id"))
    return R.quick_reference(entries(s, d), logs).withColumn("topics", F.md5("topics"))


@query(f"WITH {ENTRIES} SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("learning", "decision", "finding", "convention")) + ", max(date) AS newest, count(*) AS n_entries, (SELECT count(DISTINCT conv_id) FROM conversations) AS n_sessions, (SELECT arg_max('s' || conv_id, (conv_id % 97, 's' || conv_id)) FROM conversations) AS last_session, (SELECT max(conv_id % 97) FROM conversations) AS last_date FROM entries")
def corpus_summary(s, d):
    c = F.col("conv_id")
    return R.corpus_summary(entries(s, d), table(s, d, "conversations").select(F.concat(F.lit("s"), c.cast("string")).alias("name"), (c % 97).alias("date")).distinct())


@query(
    "WITH f AS (SELECT source AS project, lang || (doc_id % 9) AS topic, max(doc_id) AS m, sum(1 + doc_id % 3) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY DATE '2024-01-01' + CAST(m % 365 AS INT) DESC, topic) AS k, count(*) OVER (PARTITION BY project) AS t FROM f) "
    "SELECT project, CAST(sum(n) AS BIGINT) AS n_findings, count(*) AS n_topics, strftime(max(DATE '2024-01-01' + CAST(m % 365 AS INT)), '%Y-%m-%d') AS updated, string_agg(topic, ', ' ORDER BY k) FILTER (k <= 5) || CASE WHEN any_value(t) > 5 THEN ', +' || (any_value(t) - 5) || ' more' ELSE '' END AS topics FROM r GROUP BY project"
)
def findings_summary(s, d):
    i = F.col("doc_id")
    line = F.concat(F.repeat(F.concat(F.lit("## F-"), i.cast("string"), F.lit("\nbody ## F-no\n")), (1 + i % 3).cast("int")), F.lit("### F-9\n"))
    docs = table(s, d, "documents").select(F.col("source").alias("project"), F.concat("lang", (i % 9).cast("string")).alias("topic"), i, line.alias("line"))
    topics = docs.groupBy("project", "topic").agg(F.concat_ws("", F.collect_list("line")).alias("text"), F.date_add(F.lit("2024-01-01").cast("date"), (F.max("doc_id") % 365).cast("int")).alias("changed"))
    return R.findings_summary(topics)


@query(f"WITH {ENTRIES} SELECT id, path, date FROM entries ORDER BY date DESC NULLS LAST, path, id LIMIT 10")
def recent(s, d):
    return R.recent(entries(s, d)).select("id", "path", "date")


@query(f"WITH {ENTRIES} SELECT id, path, date FROM entries WHERE list_has_any(tags, ['k1', 'band2']) AND date >= '2024-06-01' ORDER BY date DESC NULLS LAST, path, id LIMIT 20")
def recall(s, d):
    return R.recall(entries(s, d), tags=("K1", "band2"), since="2024-06-01").select("id", "path", "date")


@query(f"WITH {ENTRIES} SELECT id, project_id, rank FROM (SELECT id, project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY date DESC NULLS LAST, id) AS INTEGER) AS rank FROM entries) WHERE rank <= 5")
def last_n_per_group(s, d):
    return R.last_n_per_group(entries(s, d), ["project_id"], [F.col("date").desc_nulls_last(), F.col("id")], 5).select("id", "project_id", "rank")


_FIND = "findings AS (SELECT 't' || CAST(length(title) % 17 AS VARCHAR) AS topic, project_id AS project, ['robust', 'supported', 'preliminary', 'contradicted', 'other'][CAST(id % 5 + 1 AS INTEGER)] AS status, id % 4 AS n_findings, id % 3 AS n_open, CASE WHEN id % 4 = 1 THEN 'about ' || id WHEN id % 4 = 2 THEN ' ' END AS description, date FROM entries)"


def _findings(s, d):
    e = entries(s, d)
    names = F.array(*(F.lit(x) for x in ("robust", "supported", "preliminary", "contradicted", "other")))
    return e.select(F.concat(F.lit("t"), (F.length("title") % 17).cast("string")).alias("topic"), F.col("project_id").alias("project"), F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("status"), (F.col("id") % 4).alias("n_findings"), (F.col("id") % 3).alias("n_open"), F.when(F.col("id") % 4 == 1, F.concat(F.lit("about "), F.col("id").cast("string"))).when(F.col("id") % 4 == 2, " ").alias("description"), "date")


@query(
    f"WITH {ENTRIES}, {_FIND} SELECT topic, count(DISTINCT project) AS n_projects, CAST(sum(n_findings) AS BIGINT) AS n_findings, CAST(sum(n_open) AS BIGINT) AS n_open, "
    "['contradicted', 'robust', 'supported', 'preliminary', 'other'][min(CASE status WHEN 'contradicted' THEN 1 WHEN 'robust' THEN 2 WHEN 'supported' THEN 3 WHEN 'preliminary' THEN 4 ELSE 5 END)] AS strongest, arg_min(nullif(trim(description), ''), (project, description)) FILTER (trim(description) <> '') AS description FROM findings GROUP BY topic"
)
def topic_rollup(s, d):
    return R.topic_rollup(_findings(s, d))


@query(f"WITH {ENTRIES}, {_FIND} SELECT topic, max(CAST(date AS DATE)) AS newest FROM findings GROUP BY topic HAVING date_diff('day', max(CAST(date AS DATE)), DATE '2025-03-25') >= 90")
def stale_topics(s, d):
    return R.stale_topics(_findings(s, d).select("topic", F.col("date").cast("date").alias("mtime")), F.lit("2025-03-25").cast("date"))


@query(
    "WITH f AS (SELECT 'f' || CAST(doc_id % 50 AS VARCHAR) AS file, doc_id % 3 AS line, lang AS category, source AS agent, CASE WHEN doc_id % 2 = 0 THEN 'major' ELSE 'minor' END AS severity, (doc_id * 37 % 100) / 100.0 AS confidence, doc_id FROM documents), "
    "g AS (SELECT file, line, category, count(DISTINCT agent) AS n_agents FROM f GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY file, line, category ORDER BY confidence DESC, agent) AS k FROM f), "
    "o AS (SELECT file, line, category, agent, CASE WHEN severity = 'major' AND confidence < 0.5 THEN 'minor' ELSE severity END AS severity, n_agents FROM b JOIN g USING (file, line, category) WHERE k = 1) SELECT *, severity = 'minor' AND n_agents > 1 AS promote FROM o"
)
def synthesize_findings(s, d):
    i = F.col("doc_id")
    f = table(s, d, "documents").select(F.concat(F.lit("f"), (i % 50).cast("string")).alias("file"), (i % 3).alias("line"), F.col("lang").alias("category"), F.col("source").alias("agent"), F.when(i % 2 == 0, "major").otherwise("minor").alias("severity"), ((i * 37 % 100) / 100.0).alias("confidence"))
    return R.synthesize_findings(f).drop("confidence")


_TEXT = f"WITH {ENTRIES} SELECT id, "


@query(
    _TEXT + "trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS normal, coalesce(nullif(CASE WHEN length(s) <= 40 OR substr(s, 41, 1) = '-' THEN regexp_replace(substr(s, 1, 40), '-+$', '') WHEN contains(substr(s, 1, 40), '-') THEN regexp_replace(regexp_replace(substr(s, 1, 40), '-[^-]*$', ''), '-+$', '') ELSE substr(s, 1, 40) END, ''), 'untitled') AS slug, "
    "'sha256:' || sha256(body) AS content_hash, project_id || '|' || path || '|' || coalesce(date, 'None') AS fingerprint FROM (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM entries)"
)
def entry_text_fields(s, d):
    e = entries(s, d)
    return e.select("id", T.normalize(F.col("title")).alias("normal"), T.slugify(F.col("title")).alias("slug"), T.content_hash(F.col("body")).alias("content_hash"), T.fingerprint_key(F.col("project_id"), F.col("path"), F.col("date")).alias("fingerprint"))


@query("SELECT doc_id AS id, t AS token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]+')) AS t FROM (SELECT doc_id, regexp_replace(text, '\\*+|`+|_{1,2}|#+', ' ', 'g') AS text FROM documents)) WHERE length(t) > 2 AND t NOT IN ('the', 'and', 'for') GROUP BY ALL")
def tokenize(s, d):
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.explode_outer(T.tokens(F.col("text"), ("the", "and", "for"))).alias("token"))
    return rows.filter("token is not null").groupBy("id", "token").agg(F.count("*").alias("tf"))


@query(
    f"{GRAPH}, cl AS (SELECT doc_id % 6 AS c, count(*) AS size, count(DISTINCT lang) AS f FROM documents WHERE doc_id % 6 < 3 AND (doc_id % 6 < 2 OR lang = 'en') GROUP BY 1), a AS (SELECT count(*) AS total, count(x.entry) AS connected FROM entries LEFT JOIN (SELECT DISTINCT entry FROM edges) x ON entry = id), b AS (SELECT count(*) AS n_clusters, count(*) FILTER (f >= 2) AS n_across, CAST(sum(size) AS BIGINT) AS absorbed, CAST(coalesce(sum(size) FILTER (f >= 2), 0) AS BIGINT) AS absorbed_across FROM cl) "
    "SELECT total, connected, round(100.0 * connected / total, 1) AS pct, n_clusters, n_across, absorbed, absorbed_across, round(100.0 * (connected + absorbed) / total, 1) AS pct_all, round(100.0 * (connected + absorbed_across) / total, 1) AS pct_across FROM a, b"
)
def projected_gain(s, d):
    e, _, x = _graph(s, d)
    c = F.col("doc_id") % 6
    clusters = table(s, d, "documents").filter((c < 3) & ((c < 2) | (F.col("lang") == "en"))).groupBy(c.alias("c")).agg(F.count("*").alias("size"), F.collect_set("lang").alias("families"))
    return R.projected_gain(e, x, clusters)
