"""Corpus: entries, findings, file trees, registries and pages over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import pages as P
from lorespan.operators import rollup as R
from lorespan.operators import segment as G
from lorespan.sources import trees as A
from lorespan.sources.folders import work_dir

from .base import CONCEPTS, EDGES, ENTRIES, STATUS, concepts, entries, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _lines_sql(rule: str, n: int) -> str:
    """The lines of documents, each marked by its length modulo n (c) and its place (pos)."""
    return f"l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), m AS (SELECT id, pos, length(x) % {n} AS c, CASE length(x) % {n} {rule} END AS line FROM l)"


def _marked(s, d, rule: list, n: int):
    """documents with lines marked by the same rule."""

    def mark(x, i):
        out = F
        for k, f in enumerate(rule):
            out = out.when(F.length(x) % n == k, f(x, i))
        return out

    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


_FIND = _lines_sql(
    "WHEN 0 THEN '## F-' || pos || ' ' || x WHEN 1 THEN '**Claim:** ' || x WHEN 2 THEN '**Status:** ' || ['Robust', 'supported', 'Contradicted'][CAST(pos % 3 + 1 AS INT)] WHEN 3 THEN '### Evidence Ledger' "
    "WHEN 4 THEN '| 2024-0' || (pos % 9 + 1) || '-1' || (pos % 10) || ' | ' || x || ' |' WHEN 5 THEN '**Tags:** ' || x WHEN 6 THEN '### Open Questions' WHEN 7 THEN '- ' || x WHEN 8 THEN '**Implications:** ' || x",
    9,
)


def _findings(s, d):
    states = F.array(F.lit("Robust"), F.lit("supported"), F.lit("Contradicted"))
    rule = [
        lambda x, i: _cat("## F-", i, " ", x), lambda x, i: _cat("**Claim:** ", x), lambda x, i: _cat("**Status:** ", F.element_at(states, i % 3 + 1)), lambda x, i: F.lit("### Evidence Ledger"),
        lambda x, i: _cat("| 2024-0", i % 9 + 1, "-1", i % 10, " | ", x, " |"), lambda x, i: _cat("**Tags:** ", x), lambda x, i: F.lit("### Open Questions"), lambda x, i: _cat("- ", x), lambda x, i: _cat("**Implications:** ", x),
    ]
    return _marked(s, d, rule, 9)


@query(
    f"WITH {_FIND}, k AS (SELECT *, sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) OVER w AS k, last_value(CASE WHEN c IN (0, 3, 6) THEN c = 3 END IGNORE NULLS) OVER w AS led FROM m WINDOW w AS (PARTITION BY id ORDER BY pos)), "
    "f AS (SELECT id, k, arg_min(regexp_extract(line, '^## (F-[0-9]+)', 1), pos) AS finding, arg_max(trim(substr(line, 12)), pos) FILTER (c = 1) AS claim, arg_max(lower(substr(line, 13)), pos) FILTER (c = 2) AS status, arg_max(trim(substr(line, 19)), pos) FILTER (c = 8) AS implications, arg_max(trim(substr(line, 11)), pos) FILTER (c = 5) AS tags, "
    "arg_max(substr(line, 3, 10), pos) FILTER (c = 4 AND led) AS last_evidence, max(substr(line, 3, 10)) FILTER (c = 4 AND led) AS newest_evidence FROM k WHERE k > 0 GROUP BY id, k) "
    "SELECT finding, CAST(substr(finding, 3) AS BIGINT) AS number, id, coalesce(nullif(claim, ''), '(no claim)') AS claim, coalesce(status, 'preliminary') AS status, coalesce(implications, '') AS implications, coalesce(tags, '') AS tags, last_evidence, newest_evidence FROM f"
)
def findings_registry(s, d):
    return G.findings_registry(_findings(s, d))


@query(
    f"WITH {_FIND}, a AS (SELECT *, coalesce(last_value(CASE WHEN c = 6 THEN true WHEN c IN (0, 3) OR starts_with(line, '---') THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos), false) AS asked FROM m) "
    "SELECT id, count(*) FILTER (c = 0) AS n_findings, count(*) FILTER (asked AND c = 7) AS n_open, ['contradicted', 'robust', 'supported', 'preliminary'][least(coalesce(min(CASE WHEN c = 2 THEN CASE pos % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END END), 4), 4)] AS strongest FROM a GROUP BY id"
)
def finding_counts(s, d):
    return G.finding_counts(_findings(s, d))


_REG = _lines_sql(
    "WHEN 0 THEN '### [2024-01-1' || (pos % 10) || '] ' || x WHEN 1 THEN '## [2024-02-1' || (pos % 10) || '] ' || x WHEN 2 THEN '**Tags**: [a' || pos || ', b, c d]' WHEN 3 THEN '**mitigation_type**: ' || ['Structural', 'ambient', 'conv', 'struct', 'other'][CAST(pos % 5 + 1 AS INT)] WHEN 4 THEN '- ' || x",
    5,
)


def _registers(s, d):
    kinds = F.array(*(F.lit(x) for x in ("Structural", "ambient", "conv", "struct", "other")))
    rule = [lambda x, i: _cat("### [2024-01-1", i % 10, "] ", x), lambda x, i: _cat("## [2024-02-1", i % 10, "] ", x), lambda x, i: _cat("**Tags**: [a", i, ", b, c d]"), lambda x, i: _cat("**mitigation_type**: ", F.element_at(kinds, i % 5 + 1)), lambda x, i: _cat("- ", x)]
    return _marked(s, d, rule, 5)


def _entries_sql(c: int, name: str, tags: str) -> str:
    """Sections that start at lines of kind c; heads are what follows the signs, titles what follows the date."""
    cut = 5 if c == 0 else 4
    return f"""{name}k AS (SELECT *, sum(CASE WHEN c = {c} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS k FROM m),
{name} AS (SELECT id, k, arg_min(trim(substr(line, {cut})), pos) AS head, min(pos) + 1 AS line_no, {tags} AS tags, arg_min(substr(line, {cut + 1}, 10), pos) AS date, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\\s+$', '') AS body,
  coalesce(arg_min(['structural', 'ambient-awareness', 'convention', 'structural', 'other'][CAST(pos % 5 + 1 AS INT)], pos) FILTER (c = 3), 'unknown') AS mitigation FROM {name}k WHERE k > 0 GROUP BY id, k)"""


_TITLE = "coalesce(nullif(regexp_replace(substr(head, 13), '^[ :\\-–—]+|[ :\\-–—]+$', '', 'g'), ''), head)"
_OWN_TAGS = "coalesce(arg_min('a' || pos || ',b,c d', pos) FILTER (c = 2), '')"


def _flat(df):
    return df.withColumn("tags", F.array_join("tags", ",")).withColumn("body", F.md5("body"))


@query(f"WITH {_REG}, {_entries_sql(0, 'e', _OWN_TAGS)} SELECT id, 'L-' || k AS entry, {_TITLE} AS title, date, tags, line_no, md5(body) AS body FROM e")
def register_entries(s, d):
    return _flat(G.register_entries(_registers(s, d)))


@query(
    f"WITH {_REG}, {_entries_sql(0, 'e', _OWN_TAGS)}, {_entries_sql(1, 'g', chr(39) * 2)} SELECT id, 'L-' || k AS entry, {_TITLE} AS title, date, tags, line_no, md5(body) AS body, mitigation FROM e "
    f"UNION ALL SELECT id, 'L-legacy-' || line_no, {_TITLE}, date, tags, line_no, md5(body), mitigation FROM g"
)
def collect_with_legacy(s, d):
    return _flat(G.collect_with_legacy(_registers(s, d)))


@query(f"WITH {_REG}, h AS (SELECT id, pos, trim(regexp_replace(regexp_replace(substr(line, CASE c WHEN 0 THEN 18 ELSE 17 END), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\[[^\\]]+\\]', '', 'g'), ' :-–—') AS t, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM m WHERE c < 2) SELECT id, count(*) AS n_headers, coalesce(string_agg(t, '|' ORDER BY pos) FILTER (k <= 5 AND t <> ''), '') AS topics FROM h GROUP BY id")
def header_topics(s, d):
    return G.header_topics(_registers(s, d)).withColumn("topics", F.array_join("topics", "|"))


@query(
    "WITH w AS (SELECT doc_id AS id, doc_id % 3 AS r, 'p/' || source || '/note-' || doc_id || '.md' AS path, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) || 'date: 2024-03-0' || (doc_id % 9 + 1) || chr(10) || '---' || chr(10) || '# [2024-01-02] L-7: Plan <' || doc_id || '>' || chr(10) WHEN 1 THEN '**Tags**: x; *y*, ' || lang || chr(10) || '## 2024-05-06 — TEMPLATE of D1' || chr(10) ELSE '' END || text AS text FROM documents) "
    "SELECT id, path, CASE r WHEN 0 THEN 'Plan <' || id || '>' WHEN 1 THEN 'TEMPLATE of' ELSE 'note-' || id END AS title, CASE r WHEN 0 THEN '2024-03-0' || (id % 9 + 1) WHEN 1 THEN '2024-05-06' END AS date, CASE r WHEN 1 THEN 'x,y,' || split_part(substr(text, 19), chr(10), 1) ELSE '' END AS tags, 1 AS line_start, "
    "CAST(len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) AS INT) AS line_end, md5(substr(trim(text, ' ' || chr(10) || chr(9) || chr(13)), 1, 500)) AS excerpt, 'sha256:' || sha256(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS content_hash, r = 1 OR contains(upper(text), 'TEMPLATE') AS template FROM w"
)
def whole_file_entries(s, d):
    i, nl = F.col("doc_id"), F.lit("\n")
    head = F.when(i % 3 == 0, F.concat(F.lit("---\ndate: 2024-03-0"), (i % 9 + 1).cast("string"), F.lit("\n---\n# [2024-01-02] L-7: Plan <"), i.cast("string"), F.lit(">\n"))).when(i % 3 == 1, F.concat(F.lit("**Tags**: x; *y*, "), "lang", nl, F.lit("## 2024-05-06 — TEMPLATE of D1\n"))).otherwise("")
    docs = table(s, d, "documents").select(i.alias("id"), F.concat(F.lit("p/"), "source", F.lit("/note-"), i.cast("string"), F.lit(".md")).alias("path"), F.concat(head, "text").alias("text"))
    return G.whole_file_entries(docs).withColumn("tags", F.array_join("tags", ",")).withColumn("excerpt", F.md5("excerpt"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'one,two,' || lang ELSE 'k' || (doc_id % 5) || ',x-y' END AS tags, '2024-02-1' || (doc_id % 10) AS date, 'Result of ' || source AS title FROM documents")
def entry_titles(s, d):
    i = F.col("doc_id")
    lines = F.when(i % 2 == 0, F.array(F.lit("body #no"), F.concat(F.lit("Tags: *one*, two;"), F.col("lang")))).otherwise(F.array(_cat("see #k", i % 5, " and a#b"), F.lit("#x-y #1")))
    head = F.concat(F.lit(" [2024-02-1"), (i % 10).cast("string"), F.lit("] — L-12: Result of "), "source", F.lit(" – "))
    return table(s, d, "documents").select(i.alias("id"), F.array_join(T.log_tags(lines), ",").alias("tags"), T.extract_date(head).alias("date"), T.heading_title(head).alias("title"))


@query("SELECT doc_id AS id, doc_id % 4 < 3 AS template FROM documents")
def template_entries(s, d):
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, "Sample [YYYY-MM-DD]").when(i % 4 == 1, "My Template here").otherwise("Entry")
    return table(s, d, "documents").select(i.alias("id"), T.is_template(head, F.when(i % 4 == 2, "say <placeholder> now").otherwise("say <placeholders> YYYY-MM")).alias("template"))


@query(
    "WITH p AS (SELECT doc_id AS id, ['docs/Plans/x.md', 'my/figures/y.md', 'DATA/z.md', 'src/Evaluate.md', 'tests/t.md', 'notes/n.md', 'notes/n.md', 'notes/n.md', 'notes/n.md'][CAST(doc_id % 9 + 1 AS INT)] AS path, ['', '', '', '', '', 'Pilot run', 'A κ of', 'LLMs', 'plain'][CAST(doc_id % 9 + 1 AS INT)] AS title, doc_id % 11 = 0 AS curated FROM documents) "
    "SELECT id, CASE WHEN curated THEN 'writing' ELSE ['planning', 'figure_generation', 'data_registry', 'evaluation', 'infrastructure', 'planning', 'evaluation', 'analysis', 'unassigned'][CAST(id % 9 + 1 AS INT)] END AS stage, CASE WHEN curated THEN 'curated' WHEN id % 9 < 5 THEN 'path' WHEN id % 9 < 8 THEN 'keyword' ELSE 'default' END AS stage_source FROM p"
)
def stages(s, d):
    i = F.col("doc_id")
    pick = lambda *x: F.element_at(F.array(*(F.lit(v) for v in x)), (i % 9 + 1).cast("int"))
    docs = table(s, d, "documents")
    e = docs.select(i.alias("id"), pick("docs/Plans/x.md", "my/figures/y.md", "DATA/z.md", "src/Evaluate.md", "tests/t.md", *["notes/n.md"] * 4).alias("path"), pick("", "", "", "", "", "Pilot run", "A κ of", "LLMs", "plain").alias("title"), F.array().cast("array<string>").alias("tags"))
    return R.with_stage(e, docs.filter(i % 11 == 0).select(i.alias("id"), F.lit("writing").alias("stage"))).select("id", "stage", "stage_source")


@query("SELECT doc_id AS id, format('{:.1f}', (doc_id % 100) / 64.0 * 100 + 1e-9) || '%' AS percent, CASE WHEN doc_id % 2 = 0 THEN '3 × more' ELSE CAST(doc_id AS VARCHAR) END AS shown, CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END AS flag, 'N' || translate(CAST(doc_id % 10 AS VARCHAR), '0123456789', '0123456789') AS kept, ['Zero', 'One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine'][CAST(doc_id % 10 + 1 AS INT)] || 'ACCTestabTwo' AS macro FROM documents")
def format_values(s, d):
    i = F.col("doc_id")
    v = (i % 100) / 64.0
    ident = F.concat(F.lit("ns:x/"), (i % 10).cast("string"), F.lit("_acc_TESTaB2_"))
    return table(s, d, "documents").select(i.alias("id"), T.format_value(v, F.lit("percent")).alias("percent"), T.format_value(i, None, None, F.when(i % 2 == 0, "3 × more")).alias("shown"), T.format_value(i % 3 == 0).alias("flag"), F.concat(F.lit("N"), (i % 10).cast("string")).alias("kept"), T.macro_name(ident).alias("macro"))


@query("SELECT 'ACCOne' || upper(lang) AS macro, count(*) AS n_ids, min('s:' || 'acc_1_' || lang) AS first_id FROM (SELECT DISTINCT lang, prefix FROM documents, (VALUES ('s:'), ('t/')) p(prefix)) GROUP BY lang HAVING count(*) > 1")
def macro_collisions(s, d):
    ids = table(s, d, "documents").select("lang").distinct().select(F.explode(F.array(F.concat(F.lit("s:acc_1_"), "lang"), F.concat(F.lit("t/acc_1_"), "lang"))).alias("id"))
    return G.macro_collisions(ids)


_PATHS = ("learnings.md", "learnings/a.md", "learnings/INDEX.md", "decisions/b.md", "findings/F.md", "findings/FINDINGS_REGISTRY.md", "log/2024.md", "generated-conventions/c.md", "other.md", "x/conventions.md", "x/y.md", "learnings/.living/z.md", "graph/g.md", "T_MANIFEST.md", "decisions.md")
_CLASS = ("learning", "learning", None, "decision", "finding", None, None, None, None, "convention", None, None, None, None, "decision")
_SHAPE = ("aggregate_section", "per_entry_file", None, "per_entry_file", "standalone_finding_file", None, None, None, None, "aggregate_section", None, None, None, None, "aggregate_section")


def _sql_array(x):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in x) + "]"


@query(
    f"WITH p AS (SELECT item_id, item_id % 15 AS r, item_id // 15 % 3 AS p FROM benchmark) SELECT item_id, 'root/p' || p || '/.living/' || {_sql_array(_PATHS)}[CAST(r + 1 AS INT)] AS path, 'root/p' || p AS project, {_sql_array(_PATHS)}[CAST(r + 1 AS INT)] AS rel, {_sql_array(_CLASS)}[CAST(r + 1 AS INT)] AS kind, {_sql_array(_SHAPE)}[CAST(r + 1 AS INT)] AS shape, coalesce({_sql_array(_CLASS)}[CAST(r + 1 AS INT)] IN ('learning', 'decision'), false) AND p < 2 AS included FROM p"
)
def inclusion_flags(s, d):
    i = F.col("item_id")
    rel = F.element_at(F.array(*(F.lit(x) for x in _PATHS)), (i % 15 + 1).cast("int"))
    project = F.concat(F.lit("root/p"), (F.floor(i / 15) % 3).cast("string"))
    files = table(s, d, "benchmark").select("item_id", F.concat(project, F.lit("/.living/"), rel).alias("path"))
    projects = s.range(3).select(F.concat(F.lit("root/p"), F.col("id").cast("string")).alias("project"), (F.col("id") < 2).alias("has_living"))
    return A.inclusion_flags(files, projects, ("learning", "decision"))


@query(
    f"WITH p AS (SELECT item_id, text, {_sql_array(_PATHS)}[CAST(item_id % 15 + 1 AS INT)] AS rel, {_sql_array(_CLASS)}[CAST(item_id % 15 + 1 AS INT)] AS kind, {_sql_array(_SHAPE)}[CAST(item_id % 15 + 1 AS INT)] AS shape FROM benchmark) SELECT 'fam/p' || item_id AS project, rel, kind, shape, md5(text) AS text FROM p WHERE kind IS NOT NULL"
)
def scan_entries(s, d):
    root = work_dir(s, "tree")
    rel = F.element_at(F.array(*(F.lit(x) for x in _PATHS)), (F.col("item_id") % 15 + 1).cast("int"))
    A.write_tree(table(s, d, "benchmark").select(F.concat(F.lit("fam/p"), F.col("item_id").cast("string"), F.lit("/.living/"), rel).alias("path"), "text"), root)
    return A.scan_entries(s, root).select("project", "rel", "kind", "shape", F.md5("text").alias("text"))


@query("SELECT CASE WHEN item_id % 3 < 2 THEN '2024-01-0' || (item_id % 9 + 1) END AS date, CASE WHEN item_id % 3 = 0 THEN CAST(item_id AS INT) END AS seq, md5(text) AS text FROM benchmark WHERE length(trim(text)) >= 150")
def scan_logs(s, d):
    root, i = work_dir(s, "logs"), F.col("item_id")
    day = F.concat(F.lit("2024-01-0"), (i % 9 + 1).cast("string"))
    name = F.when(i % 3 == 0, F.concat(day, F.lit("-"), i.cast("string"), F.lit("-x.md"))).when(i % 3 == 1, F.concat(day, F.lit("-note"), i.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("plain"), i.cast("string"), F.lit(".md")))
    A.write_tree(table(s, d, "benchmark").select(name.alias("path"), "text"), root)
    return A.scan_logs(s, root).select("date", "seq", F.md5("text").alias("text"))


_EV = "SELECT *, event_id % 5 AS r FROM events"


def _event_log(s, d):
    """events as a log of JSON lines: some without ts, some that are no objects, some blank."""
    out, i = work_dir(s, "event-log"), F.col("event_id")
    rest = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.when(i % 2 == 0, F.col("user_id").cast("string")).alias("agent_id"), F.when(i % 7 == 0, F.array(F.struct(F.lit("f").alias("path"), F.col("event_id").alias("size_bytes")))).alias("inputs")))
    line = F.when(i % 5 == 1, F.to_json(F.struct(F.col("event_type").alias("script")))).when(i % 5 == 2, F.concat(F.lit("not json "), i.cast("string"))).when(i % 5 == 3, "  ").otherwise(rest)
    table(s, d, "events").select(line.alias("value")).write.text(out)
    return A.read_lineage_events(s, out)


@query(f"SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'main' END AS agent_id, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS n_inputs, CASE WHEN event_id % 7 = 0 THEN event_id END AS size_bytes, CASE WHEN event_id % 7 = 0 THEN 'detected' ELSE 'none' END AS io_detection FROM ({_EV}) WHERE r IN (0, 4)")
def read_lineage_events(s, d):
    return _event_log(s, d)[0].select("ts", "agent_id", F.size("inputs").alias("n_inputs"), F.get("inputs", F.lit(0))["size_bytes"].alias("size_bytes"), "io_detection")


@query(f"SELECT CASE r WHEN 1 THEN 'no ts' ELSE 'not a JSON object' END AS warning, count(*) AS n FROM ({_EV}) WHERE r IN (1, 2) GROUP BY 1")
def lineage_warnings(s, d):
    return _event_log(s, d)[1].groupBy("warning").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS doc, CAST(2 AS BIGINT) AS pos, CAST(s_suppkey AS VARCHAR) || '~' || s_name AS cells FROM supplier UNION ALL SELECT s_suppkey, 4, 'x~' FROM supplier")
def parse_pipe_table(s, d):
    rows = F.array(F.lit("| Key | Name |"), F.lit("|:---|---:|"), _cat("| ", F.col("s_suppkey"), " |  ", F.col("s_name"), " |"), F.lit("| ragged |"), F.lit("| x | |"), F.lit("text | more"))
    lines = table(s, d, "supplier").select(F.col("s_suppkey").alias("doc"), F.posexplode(rows).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    return A.parse_pipe_table(lines).withColumn("cells", F.array_join("cells", "~"))


@query("SELECT CAST(item_id AS VARCHAR) AS item, CASE WHEN item_id % 10 = 0 THEN NULL ELSE CAST(strlen(text) AS BIGINT) END AS size_bytes, CASE WHEN item_id % 10 = 0 THEN '_missing' WHEN strlen(text) <= 400 THEN sha256(text) END AS sha256 FROM benchmark")
def fingerprint_files(s, d):
    root = work_dir(s, "files")
    b = table(s, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), "text", "item_id")
    A.write_tree(b.filter("item_id % 10 <> 0"), root)
    at = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    declared = b.select(F.concat(F.lit(A.file_prefix(root)), F.lit("/"), "path").alias("path"))
    return A.fingerprint_files(s, root, declared, 400).select(at.alias("item"), "size_bytes", "sha256")


_TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def row_counts(s, d):
    rows = None
    for t in _TABLES:  # as many reads as tables: their schemas differ
        one = A.row_counts(s, f"{d}/{t}.parquet", "parquet").agg(F.sum("n_rows").alias("n_rows")).select(F.lit(t).alias("name"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || ',"none":null}' AS json FROM nation""".replace('{"n_nationkey":\' || n_nationkey || \',"n_name":"\' || n_name || \'"', '{"n_name":"\' || n_name || \'","n_nationkey":\' || n_nationkey || \''))
def canonical_json(s, d):
    return A.canonical_json(table(s, d, "nation").select("n_regionkey", "n_name", "n_nationkey", F.lit(None).cast("string").alias("none")))


@query("""SELECT '' AS part, '{"parts":["nation","region"],"schema_version":1}' AS json UNION ALL SELECT 'nation', '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' FROM nation UNION ALL SELECT 'region', '{"r_name":"' || r_name || '"}' FROM region""")
def graph_lines(s, d):
    return A.graph_lines({"region": table(s, d, "region").select("r_name"), "nation": table(s, d, "nation").select("n_nationkey", "n_name")})


@query("SELECT 'doc-' || doc_id AS path FROM documents WHERE doc_id % 6 IN (0, 1)")
def declared_but_missing(s, d):
    i = F.col("doc_id")
    docs = table(s, d, "documents").select(_cat("doc-", i).alias("path"), i.alias("i"))
    files = docs.filter("i % 6 <> 0").select("path", F.when(F.col("i") % 6 == 1, 0).otherwise(5).alias("size"))
    return A.declared_but_missing(docs.select("path"), files)


@query(
    "WITH c AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'Bad ' || doc_id WHEN doc_id % 5 = 0 THEN 'twice-' || (doc_id // 10) ELSE 's' || doc_id END AS slug, doc_id % 4 = 0 AS bare, doc_id % 6 = 0 AS odd FROM documents) "
    "SELECT 'bad_slug' AS error, slug AS subject FROM c WHERE slug LIKE 'Bad%' UNION ALL SELECT 'no_definition', slug FROM c WHERE bare UNION ALL SELECT 'bad_status', slug FROM c WHERE odd UNION ALL SELECT 'bad_mode', slug FROM c WHERE odd UNION ALL SELECT 'duplicate_slug', slug FROM c GROUP BY slug HAVING count(*) > 1 "
    "UNION ALL SELECT 'no_family', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'duplicate_path', 'p/x' || (n_nationkey // 2) FROM nation GROUP BY n_nationkey // 2 HAVING count(*) > 1 UNION ALL SELECT 'schema_version', 'projects'"
)
def load_registry(s, d):
    i, k = F.col("doc_id"), F.col("n_nationkey")
    slug = F.when(i % 7 == 0, _cat("Bad ", i)).when(i % 5 == 0, _cat("twice-", F.floor(i / 10))).otherwise(_cat("s", i))
    c = table(s, d, "documents").select(slug.alias("slug"), F.lit("Label").alias("label"), F.when(i % 4 == 0, " ").otherwise("what it is").alias("definition"), F.when(i % 6 == 0, "fresh").otherwise("candidate").alias("status"), F.when(i % 6 == 0, None).otherwise("alias").alias("match_mode"), F.lit(1).alias("schema_version"))
    path = _cat(F.when(k % 2 == 0, "p/./x").otherwise("p/q/../x"), F.floor(k / 2))
    p = table(s, d, "nation").select(k.alias("id"), F.lit("n").alias("name"), path.alias("path"), F.when(k % 4 != 1, "f").alias("family"), F.lit(True).alias("has_living"), F.when(k == 3, 2).otherwise(1).alias("schema_version"))
    return A.load_registry(c, p)


@query("SELECT doc_id AS id, source AS k, ' a: b ' || lang AS v, 'body' || chr(10) || 'end' AS visible FROM documents".replace("' a: b '", "'a: b '"))
def text_blocks(s, d):
    m = T.frontmatter(F.concat(F.lit("---\nkey: "), "source", F.lit("\nother: a: b "), "lang", F.lit("\n---\nbody: no")))
    lines = F.array(F.lit("body"), F.lit("~~~"), F.lit("```"), F.col("source"), F.lit("~~~~"), F.lit("end"))
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.element_at(m, "key").alias("k"), F.element_at(m, "other").alias("v"), F.array_join(T.visible_lines(lines), "\n").alias("visible"))


_IO = "p AS (SELECT doc_id AS id, doc_id % 4 AS r, source, lang FROM documents)"


@query(
    f"WITH {_IO} SELECT id, CASE WHEN r = 3 THEN '' ELSE source || '.parquet|' || lang || '.npy' END AS inputs, CASE r WHEN 0 THEN 'out/' || lang || '.csv' WHEN 1 THEN 'f.png' ELSE '' END AS outputs, CASE WHEN r = 1 THEN '.query(\"a > 1\")|.loc[rows, 1]' ELSE '' END AS filters, CASE r WHEN 2 THEN '7,42' ELSE '' END AS seeds FROM p"
)
def scan_source_io(s, d):
    r = F.col("doc_id") % 4
    read = F.concat(F.lit('df = pd.read_parquet( "'), "source", F.lit(".parquet\", columns=c)\nx = np.load('"), "lang", F.lit(".npy')\ny = np.load('"), "lang", F.lit(".npy')\nz = pd.read_csv(name)\n"))
    more = F.when(r == 0, F.concat(F.lit("df.to_csv('out/"), "lang", F.lit(".csv')\n"))).when(r == 1, 'plt.savefig("f.png", dpi=300)\nb = df.query("a > 1").loc[rows, 1]\n').when(r == 2, "np.random.seed(42)\nrng = np.random.default_rng( 7 )\nrandom.seed(42)\n").otherwise("")
    scripts = table(s, d, "documents").select(F.col("doc_id").alias("script"), F.concat(F.when(r == 3, "print('x')\n").otherwise(read), more).alias("source"))
    out = G.scan_source_io(scripts)
    return out.select(F.col("script").alias("id"), *(F.array_join(c, "|").alias(c) for c in ("inputs", "outputs", "filters")), F.array_join("seeds", ",").alias("seeds"))


#: Command lines ({} is a document's source) and the programs that they start.
_COMMANDS = (
    ("FOO=1 python -u a/{}.py arg", "python_script=a/{}.py"), ("python -m pkg.run --x 1", "python_module=pkg.run"), ("python3 -m pytest -q", ""), ("python3.11 -c 'import {}'", "python_inline"), ("cd x && Rscript --vanilla fit.R 3", "r_script=fit.R"),
    ("R -e 'print(1)'", "r_inline"), ("jupyter nbconvert --to html n.ipynb", "notebook=n.ipynb"), ("ls -la {}", ""), ("python skills/core/scripts/{}.py", ""), ("echo 'python {}.py'", ""), ("python '{} 1.py' | tee x; Rscript {}.R # python no.py", "python_script={} 1.py|r_script={}.R"),
    ('python -c "a = \'x; python no.py\'" && python "{}".py', "python_inline|python_script={}.py"), ("python {}.py 'open", ""), ("for x in *; do python {}.py; done", ""), ("# python no.py\n(env A=1 python {}.py) > out", "python_script={}.py"),
)


@query(
    f"WITH t AS (SELECT doc_id AS id, replace({_sql_array(tuple(p for _, p in _COMMANDS))}[CAST(doc_id % {len(_COMMANDS)} + 1 AS INT)], '{{}}', source) AS programs FROM documents) "
    "SELECT id, programs, nullif(regexp_extract(programs, '^([^=|]*)', 1), '') AS kind, nullif(regexp_extract(programs, '^[^=|]*=([^|]*)', 1), '') AS target FROM t"
)
def classify_invocation(s, d):
    c = F.element_at(F.array(*(F.lit(x) for x, _ in _COMMANDS)), (F.col("doc_id") % len(_COMMANDS) + 1).cast("int"))
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.replace(c, F.lit("{}"), F.col("source")).alias("command"))
    programs = F.array_join(F.transform("programs", lambda p: F.concat_ws("=", p["kind"], p["target"])), "|")
    return G.classify_invocation(rows, managed="skills/core/scripts/").select("id", programs.alias("programs"), "kind", "target")


_PAGES = f"WITH {ENTRIES}, {CONCEPTS}, {EDGES}, {STATUS}, staged AS (SELECT *, ['planning', 'analysis', 'figure_generation', 'unassigned'][CAST(id % 4 + 1 AS INT)] AS stage FROM entries)"


def _graph(s, d):
    from lorespan.operators import link as L

    e, c = entries(s, d), concepts(s)
    x = L.link_entries(e.select("id", "project_id", "text"), c)
    stage = F.element_at(F.array(*(F.lit(v) for v in ("planning", "analysis", "figure_generation", "unassigned"))), (F.col("id") % 4 + 1).cast("int"))
    return e.withColumn("stage", stage).withColumn("excerpt", F.substring("body", 1, 40)), c, x, R.effective_status(c, x, e)


@query(
    f"{_PAGES}, lv AS (SELECT * FROM staged WHERE status = 'active'), st AS (SELECT project_id, stage, string_agg('- [[' || id || ']] — ' || title, chr(10) ORDER BY id) AS lines FROM lv GROUP BY ALL), "
    "se AS (SELECT project_id, string_agg('## ' || CASE stage WHEN 'figure_generation' THEN 'Figure Generation' ELSE upper(stage[1]) || stage[2:] END || chr(10) || lines || chr(10), chr(10) ORDER BY list_position(['planning', 'analysis', 'figure_generation', 'unassigned'], stage)) AS stages FROM st GROUP BY 1), "
    "tc AS (SELECT project_id, string_agg('- [[' || slug || ']]', chr(10) ORDER BY slug) AS touched FROM (SELECT DISTINCT project_id, slug FROM edges JOIN lv ON lv.id = edges.entry) GROUP BY 1) "
    "SELECT 'projects/' || h.project_id || '.md' AS path, md5('---' || chr(10) || 'type: project' || chr(10) || 'family: fam' || chr(10) || '---' || chr(10) || chr(10) || '# ' || upper(h.project_id) || chr(10) || coalesce(chr(10) || stages, '') || coalesce(chr(10) || '## Concepts touched' || chr(10) || touched || chr(10), '')) AS text FROM (SELECT DISTINCT project_id FROM entries) h LEFT JOIN se USING (project_id) LEFT JOIN tc USING (project_id)"
)
def project_pages(s, d):
    e, _, x, _ = _graph(s, d)
    hubs = e.select("project_id").distinct().select("project_id", F.upper("project_id").alias("name"), F.lit("fam").alias("family"))
    return P.project_pages(e, x, hubs).select("path", F.md5("text").alias("text"))


@query(
    f"{_PAGES}, he AS (SELECT DISTINCT slug, entry, project_id, family, title FROM edges JOIN entries ON id = entry), pr AS (SELECT slug, project_id, string_agg('- [[' || entry || ']] — ' || title, chr(10) ORDER BY entry) AS lines FROM he GROUP BY ALL), ps AS (SELECT slug, string_agg('## ' || project_id || chr(10) || lines || chr(10), chr(10) ORDER BY project_id) AS projects FROM pr GROUP BY 1), n AS (SELECT slug, count(DISTINCT family) AS f FROM he GROUP BY 1) "
    "SELECT 'concepts/' || CASE WHEN coalesce(f, 0) >= 2 THEN 'bridge' WHEN effective = 'candidate' THEN 'candidate' ELSE 'confirmed' END || '/' || slug || '.md' AS path, md5('---' || chr(10) || 'type: concept' || chr(10) || 'status: ' || status || chr(10) || 'effective_status: ' || effective || chr(10) || 'families: ' || coalesce(f, 0) || chr(10) || '---' || chr(10) || chr(10) || '# ' || slug || chr(10) || chr(10) || 'about ' || slug || chr(10) || CASE WHEN coalesce(f, 0) >= 2 THEN chr(10) || '**cross-project** — spans ' || f || ' families' || chr(10) ELSE '' END || coalesce(chr(10) || projects, '')) AS text FROM status LEFT JOIN n USING (slug) LEFT JOIN ps USING (slug)"
)
def concept_pages(s, d):
    e, _, x, st = _graph(s, d)
    return P.concept_pages(e, x, st.select("slug", F.col("slug").alias("label"), F.concat(F.lit("about "), "slug").alias("definition"), "status", "effective")).select("path", F.md5("text").alias("text"))


@query(
    f"{_PAGES}, ab AS (SELECT entry, string_agg('- [[' || slug || ']]', chr(10) ORDER BY slug) AS about FROM (SELECT DISTINCT entry, slug FROM edges) GROUP BY 1) SELECT 'entries/' || project_id || '/' || id || '.md' AS path, md5('---' || chr(10) || 'type: entry' || chr(10) || 'project: ' || project_id || chr(10) || 'stage: ' || stage || chr(10) || 'date: ' || coalesce(date, 'undated') || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || substr(body, 1, 40) || chr(10) || coalesce(chr(10) || '## Concepts' || chr(10) || about || chr(10), '')) AS text FROM staged LEFT JOIN ab ON entry = id WHERE status = 'active'"
)
def entry_pages(s, d):
    e, _, x, _ = _graph(s, d)
    return P.entry_pages(e, x).select("path", F.md5("text").alias("text"))


@query(
    "WITH g AS (SELECT conv_id * 1000 + turn AS id, conv_id AS project, turn, lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p, role FROM conversations) SELECT 'logs/' || project || '/' || id || '.md' AS path, md5('---' || chr(10) || 'type: log' || chr(10) || 'date: undated' || chr(10) || '---' || chr(10) || chr(10) || '# t' || turn || chr(10) || coalesce(chr(10) || 'Follows [[' || p || ']]' || chr(10), '') || chr(10) || '## Mentions' || chr(10) || '- [[' || role || ']]' || chr(10) || '- [[x]]' || chr(10)) AS text FROM g".replace("'- [[' || role || ']]' || chr(10) || '- [[x]]'", "'- [[' || role || ']]' || chr(10) || '- [[zz]]'")
)
def log_pages(s, d):
    from lorespan.operators import link as L

    t = F.col("turn")
    logs = table(s, d, "conversations").select((F.col("conv_id") * 1000 + t).alias("id"), F.col("conv_id").cast("string").alias("project"), F.lit(None).cast("string").alias("date"), t.alias("seq"), F.col("role").alias("path"), F.concat(F.lit("t"), t.cast("string")).alias("title"), "role")
    mentions = logs.select("id", F.explode(F.array("role", F.lit("zz"))).alias("slug"))
    return P.log_pages(logs, L.follows_edges(logs), mentions).select("path", F.md5("text").alias("text"))
