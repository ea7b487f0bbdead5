"""Identity, diffs and validation checks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import checks as C
from lorespan.operators import identity as I
from lorespan.operators import stats as S

from .base import ENTRIES, PLACE, entries, placed, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def sel(check: str, column: str, group: str, observed: str, expected: str, bad: str, n: str, severity: str = "error") -> str:
    """The select list of a check's row."""
    return (
        f"'{check}' AS \"check\", CAST({column} AS VARCHAR) AS \"column\", CAST({group} AS VARCHAR) AS \"group\", CAST({observed} AS DOUBLE) AS observed, "
        f"CAST({expected} AS DOUBLE) AS expected, CASE WHEN {bad} THEN '{severity}' ELSE 'ok' END AS severity, CAST({n} AS BIGINT) AS n"
    )


_REC = """rec AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'e-' || lpad(CAST(doc_id AS VARCHAR), 5, '0') END AS explicit_id, source || '|' || CAST(doc_id // 2 AS VARCHAR) AS fp, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 9),
num AS (SELECT *, CASE WHEN k > 1 THEN fp || '#' || k ELSE fp END AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY h) AS k FROM rec)),
led AS (SELECT 'e-' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS id, source || '|' || CAST(doc_id // 2 AS VARCHAR) AS fingerprint FROM documents WHERE doc_id % 3 = 0),
hit AS (SELECT n.fingerprint, n.h, coalesce(a.id, b.id) AS id FROM num n LEFT JOIN (SELECT DISTINCT id FROM led) a ON a.id = n.explicit_id LEFT JOIN (SELECT fingerprint, min(id) AS id FROM led GROUP BY 1) b ON b.fingerprint = n.fingerprint),
ids AS (SELECT fingerprint, h, id FROM hit WHERE id IS NOT NULL UNION ALL SELECT fingerprint, h, 'e-' || CASE WHEN length(CAST(r AS VARCHAR)) < 5 THEN lpad(CAST(r AS VARCHAR), 5, '0') ELSE CAST(r AS VARCHAR) END
  FROM (SELECT *, row_number() OVER (ORDER BY fingerprint) + (SELECT max(CAST(substr(id, 3) AS BIGINT)) FROM led) AS r FROM hit WHERE id IS NULL))"""


def _identity(s, d):
    docs, i = table(s, d, "documents"), F.col("doc_id")
    ident = F.concat(F.lit("e-"), F.lpad(i.cast("string"), 5, "0"))
    fp = F.concat_ws("|", "source", F.floor(i / 2).cast("string"))
    rec = docs.filter(i % 10 != 9).select(F.when(i % 17 == 0, ident).alias("explicit_id"), fp.alias("fingerprint"), F.sha2("text", 256).alias("content_hash"))
    led = docs.filter(i % 3 == 0).select(ident.alias("id"), F.array(fp).alias("fingerprints"), F.lit("").alias("content_hash"), F.lit("active").alias("status"))
    return I.resolve_ids(rec, led)


@query(f"WITH {_REC} SELECT fingerprint, id FROM ids")
def resolve_ids(s, d):
    return _identity(s, d)[0].select("fingerprint", "id")


@query(f"WITH {_REC} SELECT id, CASE WHEN id IN (SELECT id FROM ids) THEN 'active' ELSE 'tombstone' END AS status FROM (SELECT id FROM ids UNION SELECT id FROM led)")
def tombstone(s, d):
    return _identity(s, d)[1].select("id", "status")


@query(
    "WITH b AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS note FROM orders WHERE o_orderkey % 5 <> 0), "
    "u AS (SELECT CAST(l_orderkey AS VARCHAR) AS k, l_linestatus AS status, l_returnflag AS note FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS r FROM lineitem WHERE l_orderkey % 4 = 0) WHERE r = 1) "
    "SELECT k, CASE WHEN u.k IS NOT NULL THEN u.status ELSE b.status END AS status, coalesce(nullif(b.note, ''), u.note) AS note FROM b FULL JOIN u USING (k)"
)
def upsert(s, d):
    o, i = table(s, d, "orders"), F.col("o_orderkey")
    base = o.filter(i % 5 != 0).select(i.cast("string").alias("k"), F.col("o_orderstatus").alias("status"), F.when(i % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("note"))
    upd = placed(s, d, "lineitem").filter(F.col("l_orderkey") % 4 == 0).select(F.col("l_orderkey").cast("string").alias("k"), F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("note"), "l_linenumber", *PLACE)
    return I.upsert(base, upd, "k", preserve=("note",), order="l_linenumber", ties=PLACE)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name), 'NEW' FROM customer WHERE c_custkey % 3 = 0")
def insert_only_merge(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return I.insert_only_merge(c.filter("c_custkey % 3 <> 0"), c.select("c_custkey", F.upper("c_name").alias("c_name"), F.lit("NEW").alias("c_mktsegment")), "c_custkey")


_VALS = "vals AS (SELECT source AS namespace, lang AS key, CAST(n_chars // 2000 AS VARCHAR) AS value FROM documents), one AS (SELECT namespace, key, count(DISTINCT value) AS n_values, min(value) AS value FROM vals GROUP BY ALL), base AS (SELECT DISTINCT source AS namespace, 'old-' || lang AS key, 'x' AS value FROM documents UNION SELECT DISTINCT source, lang, 'old' FROM documents)"


def _values(s, d):
    docs = table(s, d, "documents")
    batch = docs.select(F.col("source").alias("namespace"), F.col("lang").alias("key"), F.floor(F.col("n_chars") / 2000).cast("string").alias("value"))
    base = docs.select(F.col("source").alias("namespace"), F.concat(F.lit("old-"), "lang").alias("key"), F.lit("x").alias("value")).distinct().unionByName(docs.select(F.col("source").alias("namespace"), F.col("lang").alias("key"), F.lit("old").alias("value")).distinct())
    return I.register_values(base, batch)


@query(f"WITH {_VALS} SELECT b.* FROM base b LEFT JOIN one o ON b.namespace = o.namespace AND b.key = o.key AND n_values = 1 WHERE o.key IS NULL UNION ALL SELECT namespace, key, value FROM one WHERE n_values = 1")
def register_values(s, d):
    return _values(s, d)[0]


@query(f"WITH {_VALS} SELECT namespace, key, n_values FROM one WHERE n_values > 1")
def value_collisions(s, d):
    return _values(s, d)[1]


@query(
    "WITH a AS (SELECT doc_id AS path, n_chars AS size, lang FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id AS path, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 10 <> 4) "
    "SELECT path, CASE WHEN b.size IS NULL THEN 'removed' WHEN a.size IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.size IS DISTINCT FROM b.size OR a.lang IS DISTINCT FROM b.lang"
)
def snapshot_diff(s, d):
    docs, i = table(s, d, "documents"), F.col("doc_id")
    a = docs.filter(i % 10 != 3).select(i.alias("path"), F.col("n_chars").alias("size"), "lang")
    b = docs.filter(i % 10 != 4).select(i.alias("path"), (F.col("n_chars") + F.when(i % 7 == 0, 1).otherwise(0)).alias("size"), F.when(i % 11 != 0, F.col("lang")).alias("lang"))
    return I.snapshot_diff(a, b)


@query("SELECT DISTINCT 'u' || user_id AS path FROM events WHERE ts >= TIMESTAMP '2024-01-20' INTERSECT SELECT 'u' || user_id FROM events WHERE event_type = 'error'")
def committed_paths(s, d):
    e = table(s, d, "events")
    path = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")
    return I.committed_paths(e.select(path, "ts"), F.lit("2024-01-20").cast(e.schema["ts"].dataType), e.filter("event_type = 'error'").select(path))


@query("WITH e AS (SELECT DISTINCT doc_id AS entry, source AS slug FROM documents) SELECT entry, slug, 'added' AS change FROM e WHERE entry % 9 = 0 AND entry % 4 <> 0 UNION ALL SELECT entry, slug, 'removed' FROM e WHERE entry % 4 = 0 AND entry % 9 <> 0")
def edge_diff(s, d):
    e = table(s, d, "documents").select(F.col("doc_id").alias("entry"), F.col("source").alias("slug")).distinct()
    both = (F.col("entry") % 9 == 0) & (F.col("entry") % 4 == 0)
    rest = (F.col("entry") % 9 != 0) & (F.col("entry") % 4 != 0)
    return I.edge_diff(e.filter((F.col("entry") % 9 == 0) | rest), e.filter((F.col("entry") % 4 == 0) | rest | both))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def dedupe(s, d):
    return I.dedupe(table(s, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH a AS (SELECT DISTINCT source || '/' || lang || '.csv' AS path FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT source || '/' || lang || '.csv' AS path FROM documents WHERE doc_id % 3 = 0) SELECT path, 'static' AS origin FROM a UNION ALL SELECT path, 'recovered' FROM b WHERE path NOT IN (SELECT path FROM a)")
def union_recovered(s, d):
    docs = table(s, d, "documents")
    p = F.concat("source", F.lit("/"), "lang", F.lit(".csv"))
    return I.union_recovered(docs.filter("doc_id % 2 = 0").select(p.alias("path")), docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("./"), F.regexp_replace(p, "/", "//")).alias("path")))


_BASE = "p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN page_id % 3 = 0 THEN 'all' ELSE 'p' || page_id END AS name FROM pages)"


@query(f"WITH {_BASE}, u AS (SELECT name, min(host || '/' || name) AS path FROM (SELECT DISTINCT host, name FROM p) GROUP BY name HAVING count(*) = 1) SELECT 'x/' || name AS ref, path FROM p JOIN u USING (name)")
def recover_unique_basename(s, d):
    i = F.col("page_id")
    p = table(s, d, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.when(i % 3 == 0, "all").otherwise(F.concat(F.lit("p"), i.cast("string"))).alias("name"))
    return I.recover_unique_basename(p.select(F.concat(F.lit("x/"), "name").alias("ref")), p.select(F.concat("host", F.lit("/"), "name").alias("path")).distinct())


@query(
    "WITH a AS (SELECT doc_id, 'd' || doc_id % 3 || '/' || doc_id AS path, n_chars AS size FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT 'd' || doc_id % 3 || '/' || doc_id AS path, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM documents), c AS (SELECT path, CASE WHEN a.size IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.size IS DISTINCT FROM b.size) "
    "SELECT * FROM (SELECT path, change FROM c UNION ALL SELECT DISTINCT path, 'touched' FROM a WHERE doc_id % 5 = 0 AND path NOT IN (SELECT path FROM c)) WHERE NOT starts_with(path, 'd2/')"
)
def activity_diff(s, d):
    i = F.col("doc_id")
    docs = table(s, d, "documents").select(i, F.concat(F.lit("d"), (i % 3).cast("string"), F.lit("/"), i.cast("string")).alias("path"), F.col("n_chars").alias("size"))
    a = docs.filter(i % 10 != 3)
    return I.snapshot_diff(a.select("path", "size"), docs.select("path", (F.col("size") + F.when(i % 7 == 0, 1).otherwise(0)).alias("size")), activity=a.filter(i % 5 == 0).select("path"), excluded=("d2/",))


@query("SELECT 't' || (doc_id % 7) AS trigger, count(*) AS n_entries FROM documents WHERE doc_id % 2 = 1 GROUP BY 1 HAVING count(*) > 10")
def mass_new_links(s, d):
    e = table(s, d, "documents").select(F.col("doc_id").alias("entry"), F.col("source").alias("slug"), F.concat(F.lit("t"), (F.col("doc_id") % 7).cast("string")).alias("trigger"))
    return I.mass_new_links(e, e.filter("entry % 2 = 0"), 10)


_LOGS = "lg AS (SELECT conv_id, turn, 'sha256:' || sha256(CAST(conv_id AS VARCHAR) || chr(0) || turn) AS fp FROM conversations), ol AS (SELECT fp, 'l-' || lpad(CAST(row_number() OVER (ORDER BY fp) AS VARCHAR), 5, '0') AS id FROM lg WHERE turn = 0)"


@query(f"WITH {_LOGS}, nw AS (SELECT fp, (SELECT count(*) FROM ol) + row_number() OVER (ORDER BY fp) AS n FROM lg WHERE turn > 0 AND turn < 3) SELECT fp AS fingerprint, id FROM ol UNION ALL SELECT fp, 'l-' || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END FROM nw")
def log_ids(s, d):
    c = table(s, d, "conversations")
    logs = c.filter("turn < 3").select(F.col("conv_id").cast("string").alias("project"), F.col("turn").cast("string").alias("path"), F.md5("text").alias("content_hash"))
    old = logs.filter("path = '0'").select(F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x00", "project", "path"), 256)).alias("fp"))
    old = I.global_rank(old, [F.col("fp")], "k").select(F.concat(F.lit("l-"), F.lpad(F.col("k").cast("string"), 5, "0")).alias("id"), F.array("fp").alias("fingerprints"), F.lit("").alias("content_hash"), F.lit("active").alias("status"))
    return I.log_ids(logs, old)[0].select("fingerprint", "id")


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(t), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(
    f"WITH w AS (SELECT doc_id AS id, {_WORDS} AS o, {_WORDS.replace('(t)', chr(40) + 'n' + chr(41))} AS n FROM (SELECT doc_id, text AS t, text || ' newword' || CASE WHEN doc_id % 3 = 0 THEN ' and more words than that here' ELSE '' END AS n FROM documents WHERE doc_id % 4 <> 1)), j AS (SELECT id, len(list_intersect(o, n)) / len(list_distinct(list_concat(o, n))) AS j FROM w) "
    "SELECT -id AS new_id, id AS old_id, round(j, 6) AS jaccard, j < 0.85 AS unsure FROM j WHERE j >= 0.8"
)
def rename_match(s, d):
    i = F.col("doc_id")
    docs = table(s, d, "documents")
    old = docs.select(i.alias("id"), i.alias("path"), "text", F.when(i % 4 == 1, "tombstone").otherwise("active").alias("status"))
    new = docs.select((-i).alias("id"), i.alias("path"), F.concat("text", F.lit(" newword"), F.when(i % 3 == 0, " and more words than that here").otherwise("")).alias("text"))
    return I.rename_match(new, old, ["path"]).withColumn("jaccard", F.round("jaccard", 6))


def _line(s, d):
    return table(s, d, "lineitem")


@query("SELECT " + sel("row_delta", "NULL", "NULL", "b - a", "0", "b <> a", "b") + " FROM (SELECT count(*) AS a, count(*) FILTER (l_quantity > 10) AS b FROM lineitem)")
def row_delta(s, d):
    return C.row_delta(_line(s, d), _line(s, d).filter("l_quantity > 10"))


@query("SELECT " + sel("filter_loss", "NULL", "NULL", "round(100.0 * (a - b) / a, 6)", "50", "100.0 * (a - b) / a > 50", "b") + " FROM (SELECT count(*) AS a, count(*) FILTER (l_quantity > 40) AS b FROM lineitem)")
def filter_loss(s, d):
    return C.filter_loss(_line(s, d), _line(s, d).filter("l_quantity > 40"))


@query("SELECT " + sel("join_guard", "'k'", "NULL", "x", "greatest(a, b)", "x > greatest(a, b)", "x") + " FROM (SELECT (SELECT count(*) FROM lineitem l JOIN (SELECT l_partkey AS p FROM lineitem) r ON l.l_partkey = r.p) AS x, (SELECT count(*) FROM lineitem) AS a, (SELECT count(*) FROM lineitem) AS b)")
def join_guard(s, d):
    k = _line(s, d).select(F.col("l_partkey").alias("k"))
    return C.join_guard(k, k, "k")


@query("SELECT " + sel("duplicate_keys", "'l_orderkey,l_suppkey'", "NULL", "count(*) FILTER (n > 1)", "0", "count(*) FILTER (n > 1) > 0", "coalesce(sum(n) FILTER (n > 1), 0)") + " FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey)")
def duplicate_keys(s, d):
    return C.duplicate_keys(_line(s, d), ["l_orderkey", "l_suppkey"])


@query(
    " UNION ALL ".join(
        "SELECT " + sel("type_contract", f"'{c}'", f"'{g}'" if g else "NULL", f"CASE WHEN typeof(any_value({x})) = '{t}' THEN {k} ELSE 0 END", "1", f"NOT {bool(k)}", f"count({x})") + " FROM lineitem"
        for c, x, g, t, k in (("l_orderkey", "l_orderkey", "bigint", "BIGINT", 1), ("l_tax", "l_tax", "double", "DOUBLE", 1), ("l_shipdate", "l_shipdate", "timestamp_ntz", "VARCHAR", 0), ("absent", "NULL", None, "INTEGER", 0))
    )
)
def type_contract(s, d):
    return C.type_contract(_line(s, d), {"l_orderkey": "bigint", "l_tax": "double", "l_shipdate": "string", "absent": "int"})


@query(" UNION ALL ".join("SELECT " + sel("null_audit", f"'{c}'", "lang", f"round(count(*) FILTER ({c} IS NULL) / count(*), 6)", "0", f"count(*) FILTER ({c} IS NULL) > 0", "count(*)", "warning") + " FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang" for c in ("quality", "toxic", "text")))
def null_audit(s, d):
    return C.null_audit(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), ["quality", "toxic", "text"], "lang")


@query("SELECT " + sel("non_castable", "'x'", "'int'", "count(*) FILTER (x IS NOT NULL AND try_cast(x AS INTEGER) IS NULL)", "0", "count(*) FILTER (x IS NOT NULL AND try_cast(x AS INTEGER) IS NULL) > 0", "count(*)") + " FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN lang ELSE CAST(n_chars AS VARCHAR) END AS x FROM documents)")
def non_castable(s, d):
    return C.non_castable(table(s, d, "documents").select(F.when(F.col("doc_id") % 5 == 0, F.col("lang")).otherwise(F.col("n_chars").cast("string")).alias("x")), "x", "int")


_PH = "SELECT CASE WHEN doc_id % 13 = 0 THEN 'NaN ' WHEN doc_id % 17 = 0 THEN lang || ' ' ELSE lang END AS level FROM documents"


@query(
    f"SELECT " + sel("phantom_levels", "'level'", "'missing'", "k", "0", "k > 0", "n") + f" FROM (SELECT count(*) FILTER (lower(trim(level)) IN ('nan','na','n/a','none','null','','-','?')) AS k, count(*) AS n FROM ({_PH})) UNION ALL SELECT "
    + sel("phantom_levels", "'level'", "'white_space'", "k", "0", "k > 0", "n") + f" FROM (SELECT count(DISTINCT level) - count(DISTINCT trim(level)) AS k, count(*) AS n FROM ({_PH}))"
)
def phantom_levels(s, d):
    i = F.col("doc_id")
    return C.phantom_levels(table(s, d, "documents").select(F.when(i % 13 == 0, "NaN ").when(i % 17 == 0, F.concat("lang", F.lit(" "))).otherwise(F.col("lang")).alias("level")), ["level"])


@query("SELECT " + sel("range_check", "'l_discount'", "NULL", "count(*) FILTER (l_discount < 0.01 OR l_discount > 0.09)", "0", "count(*) FILTER (l_discount < 0.01 OR l_discount > 0.09) > 0", "count(l_discount)") + " FROM lineitem")
def range_check(s, d):
    return C.range_check(_line(s, d), "l_discount", 0.01, 0.09)


@query(" UNION ALL ".join("SELECT " + sel("double_transform", "'z'", f"'{k}'", f"CASE WHEN {b} THEN 1 ELSE 0 END", "0", b, "n", "warning") + " FROM (SELECT avg(z) AS m, stddev_samp(z) AS s, min(z) AS lo, count(z) AS n FROM (SELECT (value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) AS z FROM events))" for k, b in (("standardised", "abs(m) < 0.01 AND abs(s - 1) < 0.01"), ("logged", "lo < -10 AND s < 2"))))
def double_transform(s, d):
    e = table(s, d, "events")
    a = e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return C.double_transform(e.crossJoin(F.broadcast(a)).select(((F.col("value") - F.col("m")) / F.col("s")).alias("z")), "z")


@query("SELECT " + sel("split_overlap", "'text'", "NULL", "count(*)", "0", "count(*) > 0", "count(*)") + " FROM (SELECT text FROM documents WHERE doc_id % 4 <> 0 INTERSECT SELECT text FROM documents WHERE doc_id % 4 = 0)")
def split_overlap(s, d):
    docs = table(s, d, "documents")
    return C.split_overlap(docs.filter("doc_id % 4 <> 0"), docs.filter("doc_id % 4 = 0"), "text")


@query(" UNION ALL ".join("SELECT " + sel("normalization_leak", f"'{c}'", "NULL", "round(b, 6)", "round(a, 6)", "a = b OR abs(b) < 1e-9", "n") + f" FROM (SELECT avg({c}) FILTER (l_orderkey % 4 <> 0) AS a, avg({c}) FILTER (l_orderkey % 4 = 0) AS b, count(*) FILTER (l_orderkey % 4 = 0) AS n FROM lineitem)" for c in ("l_quantity", "l_tax")))
def normalization_leak(s, d):
    x = _line(s, d)
    return C.normalization_leak(x.filter("l_orderkey % 4 <> 0"), x.filter("l_orderkey % 4 = 0"), ["l_quantity", "l_tax"])


@query("SELECT " + sel("temporal_split", "'ts'", "user_id", "a", "b", "a >= b", "n") + " FROM (SELECT user_id, max(epoch_us(ts)) AS a FROM events WHERE ts < TIMESTAMP '2024-01-20' OR event_id % 50 = 0 GROUP BY 1) JOIN (SELECT user_id, min(epoch_us(ts)) AS b, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_id % 50 <> 0 GROUP BY 1) USING (user_id)")
def temporal_split_check(s, d):
    e = table(s, d, "events")
    cut = F.col("ts") < F.lit("2024-01-20").cast(e.schema["ts"].dataType)
    return C.temporal_split_check(e.filter(cut | (F.col("event_id") % 50 == 0)), e.filter(~cut & (F.col("event_id") % 50 != 0)), "ts", "user_id")


@query("SELECT " + sel("simpson", "'l_quantity~l_extendedprice'", "l_suppkey", "round(own, 6)", "round(al, 6)", "sign(own) * sign(al) < 0", "n", "warning") + " FROM (SELECT l_suppkey, corr(l_quantity, l_extendedprice) AS own, count(*) AS n FROM lineitem GROUP BY 1), (SELECT corr(l_quantity, l_extendedprice) AS al FROM lineitem)")
def simpson_check(s, d):
    return C.simpson_check(_line(s, d), "l_quantity", "l_extendedprice", "l_suppkey")


@query("SELECT " + sel("output_consistency", "'n'", "k", "coalesce(said, 0)", "coalesce(n, 0)", "coalesce(said, 0) <> coalesce(n, 0)", "coalesce(n, 0)") + " FROM (SELECT o_orderpriority AS k, count(*) - CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS said FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1) FULL JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) USING (k)")
def output_consistency(s, d):
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("k"))
    summary = o.filter("k not like '5%'").groupBy("k").agg(F.count("*").alias("n")).select("k", (F.col("n") - F.when(F.col("k").like("1%"), 1).otherwise(0)).alias("n"))
    return C.output_consistency(summary, o, "k", "n")


@query(" UNION ALL ".join("SELECT " + sel("n_drift", "'doc_id'", f"'{k}'", f"count(*) FILTER ({b})", "0", f"count(*) FILTER ({b}) > 0", "count(*)") + " FROM documents WHERE doc_id % 5 = 0" for k, b in (("unexplained", "doc_id % 3 = 0"), ("forbidden", "doc_id % 3 <> 0 AND doc_id % 2 = 0"))))
def n_drift(s, d):
    docs = table(s, d, "documents").select("doc_id")
    return C.n_drift(docs, docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 3 <> 0").withColumn("allowed", F.col("doc_id") % 2 != 0), "doc_id")


@query("WITH x AS (SELECT count(*) FILTER (b.doc_id IS NULL) AS data_only, count(*) FILTER (a.doc_id IS NULL) AS metadata_only, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id) " + " UNION ALL ".join("SELECT " + sel("reconcile", "'doc_id'", f"'{k}'", k, "0", f"{k} > 0", "n") + " FROM x" for k in ("data_only", "metadata_only")))
def reconcile(s, d):
    return C.reconcile(table(s, d, "documents").filter("doc_id % 3 <> 0"), table(s, d, "labels"), "doc_id")


@query("SELECT " + sel("comparability", "'v'", "v", "count(DISTINCT i)", "2", "count(DISTINCT i) < 2", "count(DISTINCT i)", "warning") + " FROM (SELECT 'a' AS i, source AS v FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'b', source FROM documents WHERE NOT coalesce(doc_id % 7 = 0, false)) GROUP BY v")
def comparability(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("v"))
    return C.comparability({"a": docs.filter("doc_id % 7 = 0"), "b": docs.filter("not (doc_id % 7 <=> 0)")}, "v")


@query("SELECT " + sel("weighted_vs_mean", "'l_extendedprice/l_quantity'", "l_returnflag", "round(avg(l_extendedprice / l_quantity), 6)", "round(sum(l_extendedprice) / sum(l_quantity), 6)", "abs(avg(l_extendedprice / l_quantity) - sum(l_extendedprice) / sum(l_quantity)) > 0.01", "count(*)", "warning") + " FROM lineitem GROUP BY l_returnflag")
def weighted_vs_mean_rate(s, d):
    return C.weighted_vs_mean_rate(_line(s, d), "l_returnflag", "l_extendedprice", "l_quantity")


@query("SELECT " + sel("null_group_keys", "'quality'", "NULL", "count(*) FILTER (quality IS NULL)", "0", "count(*) FILTER (quality IS NULL) > 0", "count(*)") + " FROM documents LEFT JOIN labels USING (doc_id)")
def null_group_keys(s, d):
    return C.null_group_keys(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), "quality")


@query(
    "WITH x AS (SELECT user_id, value, avg(value) OVER w0 AS feature, avg(value) OVER w1 AS own FROM events WINDOW w0 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w1 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT "
    + sel("lookahead", "'feature'", "user_id", "count(*) FILTER (own IS NULL OR abs(feature - own) > 1e-6)", "0", "count(*) FILTER (own IS NULL OR abs(feature - own) > 1e-6) > 0", "count(*)") + " FROM x GROUP BY user_id"
)
def lookahead_check(s, d):
    from pyspark.sql import Window as W

    e = table(s, d, "events")
    e = e.withColumn("feature", F.avg("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)))
    return C.lookahead_check(e, "user_id", ["ts", "event_id"], "value", "feature", 3)


@query("SELECT " + sel("value_freshness", "'value'", "k", "round(a, 6)", "round(b, 6)", "b IS NULL OR abs(a - b) > 1e-9", "1") + " FROM (SELECT l_suppkey AS k, round(sum(l_quantity), 2) + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS a FROM lineitem GROUP BY 1) LEFT JOIN (SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS b FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1) USING (k)")
def value_freshness(s, d):
    v = _line(s, d).groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    return C.value_freshness(v.withColumn("value", F.col("value") + F.when(F.col("k") % 5 == 0, 1).otherwise(0)), v.filter("k % 7 <> 0"), "k")


@query("SELECT " + sel("grim", "'mean'", "k", "round(off, 6)", "0", "off > 0.0001", "n") + " FROM (SELECT *, abs(round(round(mean * n) / n, 2) - round(mean, 2)) AS off FROM (SELECT o_custkey AS k, count(*) AS n, round(avg(o_totalprice) / 1000, 2) AS mean FROM orders GROUP BY 1))")
def grim_check(s, d):
    o = S.means_in_order(placed(s, d, "orders").withColumnRenamed("o_custkey", "k"), "k", {"mean": "o_totalprice"}, PLACE)
    o = o.withColumn("mean", C.half_away(F.col("mean") / 1000, 2))
    return C.grim_check(o, "k", "mean", "n")


@query("WITH x AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN CAST(p_size AS VARCHAR) || '-Mar' WHEN p_partkey % 11 = 0 THEN '2.3E+05' ELSE p_brand END AS gene FROM part) " + " UNION ALL ".join("SELECT " + sel("excel_damage", "'gene'", f"'{k}'", f"count(*) FILTER (regexp_matches(gene, '{r}'))", "0", f"count(*) FILTER (regexp_matches(gene, '{r}')) > 0", "count(*)") + " FROM x" for k, r in (("date", "^\\d{1,2}-(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)$"), ("exponent", "^\\d(\\.\\d+)?E\\+?\\d+$"))))
def excel_damage(s, d):
    k = F.col("p_partkey")
    return C.excel_damage(table(s, d, "part").select(F.when(k % 9 == 0, F.concat(F.col("p_size").cast("string"), F.lit("-Mar"))).when(k % 11 == 0, "2.3E+05").otherwise(F.col("p_brand")).alias("gene")), "gene")


@query("WITH x AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'Sept' || (p_size % 20) WHEN p_partkey % 11 = 0 THEN 'MARCH' || (p_size % 13) WHEN p_partkey % 13 = 0 THEN 'DEC1' ELSE p_brand END AS g FROM part), y AS (SELECT upper(g) AS symbol, count(*) AS n FROM x GROUP BY 1) SELECT symbol, CASE WHEN symbol = 'DEC1' THEN 'DELEC1' WHEN symbol LIKE 'SEPT%' THEN 'SEPTIN' || substr(symbol, 5) ELSE 'MARCHF' || substr(symbol, 6) END AS current, n FROM y WHERE symbol = 'DEC1' OR regexp_matches(symbol, '^(SEPT([1-9]|1[0-4])|MARCH([1-9]|1[01]))$')")
def renamed_symbols(s, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    g = F.when(k % 7 == 0, F.concat(F.lit("Sept"), (n % 20).cast("string"))).when(k % 11 == 0, F.concat(F.lit("MARCH"), (n % 13).cast("string"))).when(k % 13 == 0, "DEC1").otherwise(F.col("p_brand"))
    return C.renamed_symbols(table(s, d, "part").select(g.alias("g")), "g")


@query("WITH a AS (SELECT count(*) + 1 AS n, 20000 AS w FROM lineitem) " + " UNION ALL ".join("SELECT " + sel("sheet_limits", "NULL", f"'{k}'", v, e, b, "n") + " FROM a" for k, v, e, b in (("rows", "n", "1048576", "n >= 1048576"), ("columns", "w", "16384", "w >= 16384"), ("either way", "greatest(n, w)", "1048576", "(n >= 1048576 OR w >= 16384) AND (w >= 1048576 OR n >= 16384)"))))
def sheet_limits(s, d):
    return C.sheet_limits(_line(s, d), 20_000)


_P = ("l_quantity", "l_discount", "l_suppkey")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std, (SELECT count(*) FROM lineitem WHERE abs({c} - (SELECT avg({c}) FROM lineitem)) > 3 * (SELECT stddev_samp({c}) FROM lineitem)) AS n_outside FROM lineitem" for c in _P))
def profile(s, d):
    return C.profile(_line(s, d), list(_P))


@query(f"WITH {ENTRIES} SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY title, id) AS rank FROM entries)")
def global_rank(s, d):
    e = entries(s, d).select("id", "title")
    return I.global_rank(e, [F.col("title"), F.col("id")]).select("id", "rank")
