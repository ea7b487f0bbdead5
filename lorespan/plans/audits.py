"""Audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import audits as U
from lorespan.operators import checks as C

from .base import table
from .checks import sel

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _union(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT {x}" for x in parts)


@query("SELECT " + sel("duplicate_rows", "NULL", "NULL", "count(*) FILTER (k > 1)", "0", "count(*) FILTER (k > 1) > 0", "coalesce(sum(k) FILTER (k > 1), 0)") + " FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_suppkey, l_quantity, l_returnflag)")
def duplicate_rows(s, d):
    return U.duplicate_rows(table(s, d, "lineitem").select("l_suppkey", "l_quantity", "l_returnflag"))


_TYPE = "(SELECT CASE typeof(any_value({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' END FROM {t})"


def _fits(t: str, c: str, kind: str) -> str:
    return f"CASE WHEN {_TYPE.format(t=t, c=c)} = '{kind}' THEN 1 ELSE 0 END"


@query(
    "WITH l AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) "
    + _union(
        *(sel("schema_contract", f"'{c}'", "'type'", _fits("l", c, k), "1", f"{_fits('l', c, k)} <> 1", "(SELECT count(*) FROM l)") for c, k in (("doc_id", "bigint"), ("lang", "string"), ("quality", "bigint"))),
        sel("schema_contract", "'gone'", "'type'", "0", "1", "true", "(SELECT count(*) FROM l)"),
        *(sel("schema_contract", f"'{c}'", "'null'", f"count(*) FILTER ({c} IS NULL)", "0", f"count(*) FILTER ({c} IS NULL) > 0", "count(*)") + " FROM l" for c in ("doc_id", "quality")),
        sel("schema_contract", "'lang'", "'level'", "count(*) FILTER (lang NOT IN ('en', 'de'))", "0", "count(*) FILTER (lang NOT IN ('en', 'de')) > 0", "count(*)") + " FROM l",
    )
)
def schema_contract(s, d):
    df = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return U.schema_contract(df, {"doc_id": ("bigint", False, None), "lang": ("string", True, ("en", "de")), "quality": ("bigint", False, None), "gone": ("string", True, None)})


@query(
    _union(
        sel("schema_comparability", "'key'", "'bigint'", "3", "3", "false", "(SELECT count(o_orderkey) FROM orders) + (SELECT count(c_custkey) FROM customer) + (SELECT count(p_partkey) FROM part)", "warning"),
        sel("schema_comparability", "'v'", "'double'", "2", "3", "true", "(SELECT count(o_totalprice) FROM orders) + (SELECT count(c_acctbal) FROM customer)", "warning"),
        sel("schema_comparability", "'v'", "'string'", "1", "3", "true", "(SELECT count(p_brand) FROM part)", "warning"),
    )
)
def schema_comparability(s, d):
    three = (("orders", "o_orderkey", "o_totalprice"), ("customer", "c_custkey", "c_acctbal"), ("part", "p_partkey", "p_brand"))
    return U.schema_comparability({t: table(s, d, t).select(F.col(k).alias("key"), F.col(v).alias("v")) for t, k, v in three})


@query("SELECT 'd' || doc_id AS path, ['missing', 'algorithm', 'stale'][CAST(doc_id % 5 + 1 AS INT)] AS problem FROM documents WHERE doc_id % 5 < 3")
def fingerprint_freshness(s, d):
    i, h = F.col("doc_id"), F.sha2("text", 256)
    docs = table(s, d, "documents").withColumn("path", F.concat(F.lit("d"), i.cast("string")))
    now = F.when(i % 5 == 1, F.concat(F.lit("md5:"), F.md5("text"))).when(i % 5 == 2, F.concat(F.lit("sha256:x"), h)).otherwise(F.concat(F.lit("sha256:"), h))
    return U.fingerprint_freshness(docs.select("path", F.concat(F.lit("sha256:"), h).alias("fingerprint")), docs.filter(i % 5 != 0).select("path", now.alias("fingerprint")))


@query(
    "WITH t AS (SELECT doc_id AS doc, CASE WHEN doc_id % 4 = 0 THEN 'accuracy' ELSE 'F1' END AS label, CASE doc_id % 3 WHEN 0 THEN '0.5' WHEN 1 THEN '7' ELSE CAST(doc_id + 100000 AS VARCHAR) END AS num FROM documents) "
    "SELECT doc, CAST(1 AS INT) AS pos, num AS number, CASE num WHEN '0.5' THEN 'half' WHEN '7' THEN 'seven' END AS id, CASE WHEN num IN ('0.5', '7') THEN 'label' ELSE 'unsourced' END AS problem FROM t WHERE num NOT IN ('0.5', '7') OR (num = '0.5' AND label = 'accuracy')"
)
def verify_numbers(s, d):
    i = F.col("doc_id")
    line = F.concat(F.lit("First line v1x\nThe Score of "), F.when(i % 4 == 0, "Accuracy").otherwise("F1"), F.lit(" was "), F.when(i % 3 == 0, "0.50").when(i % 3 == 1, "7").otherwise((i + 100000).cast("string")), F.lit("."))
    line = F.replace(line, F.lit("0.50"), F.lit("0.5"))
    registry = s.createDataFrame([("half", 0.5, ["accuracy"]), ("seven", 7.0, [])], "id string, value double, forbidden array<string>")
    return U.verify_numbers(table(s, d, "documents").select(i.alias("doc"), line.alias("text")), registry)


@query(
    "WITH r AS (SELECT l_orderkey AS subject, count(*) AS n, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY 1) SELECT CAST(subject AS VARCHAR) AS subject, CASE WHEN subject % 6 = 0 THEN 'rows' ELSE 'aggregate' END AS problem FROM r WHERE subject % 6 = 0 OR subject % 5 = 0 UNION ALL SELECT DISTINCT 'no-' || subject, 'unsourced' FROM r WHERE subject % 7 = 0"
)
def worked_examples(s, d):
    k = F.col("l_orderkey")
    line = table(s, d, "lineitem")
    own = line.groupBy(k).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
    declared = own.select(k.cast("string").alias("subject"), (F.col("n") + F.when(k % 6 == 0, 1).otherwise(0)).alias("n"), (F.col("total") + F.when(k % 5 == 0, 0.5).otherwise(0.0)).alias("total"))
    more = own.filter(k % 7 == 0).select(F.concat(F.lit("no-"), k.cast("string")).alias("subject"), "n", "total")
    return U.worked_examples(line.select(k.cast("string").alias("subject"), F.col("l_quantity").alias("value")), declared.unionByName(more), 1e-6)


@query("SELECT doc_id AS doc, 'acc_' || lang AS id, CAST(doc_id % 3 + 0.5 AS DOUBLE) AS quoted, 1.5 AS registered FROM documents WHERE doc_id % 3 <> 1")
def cross_document_drift(s, d):
    docs = table(s, d, "documents")
    text = F.concat(F.lit("see acc_"), "lang", F.lit(" = "), (F.col("doc_id") % 3 + F.lit(0.5)).cast("string"), F.lit(", other: 3 and acc_"), "lang", F.lit(": 1.50"))
    return U.cross_document_drift(docs.select(F.col("doc_id").alias("doc"), text.alias("text")), docs.select(F.concat(F.lit("acc_"), "lang").alias("id")).distinct().withColumn("value", F.lit(1.5)))


def _blind(df):
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))


def _seeing(df):
    return df.groupBy("o_orderpriority").agg(F.sum(F.col("o_orderkey")).alias("total"))


@query("SELECT " + sel("label_permutation", "'o_orderpriority'", "NULL", "0", "0", "false", "count(DISTINCT o_orderstatus)") + " FROM orders")
def label_permutation_invariance(s, d):
    return U.label_permutation_invariance(_blind, table(s, d, "orders"), "o_orderpriority", "o_orderkey")


@query(
    "WITH h AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY md5(o_orderkey || ':labels'), o_orderkey) AS r FROM orders), o AS (SELECT o_orderkey AS k, o_orderpriority AS p, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders), "
    "a AS (SELECT p, sum(k) AS t FROM o GROUP BY 1), b AS (SELECT h.p, sum(k) AS t FROM o JOIN h USING (r) GROUP BY 1) SELECT " + sel("label_permutation", "'o_orderpriority'", "NULL", "(SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))", "0", "(SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) > 0", "(SELECT count(*) FROM a)")
)
def label_permutation_seen(s, d):
    return U.label_permutation_invariance(_seeing, table(s, d, "orders"), "o_orderpriority", "o_orderkey")


@query("SELECT " + sel("row_order", "'o_orderkey'", "NULL", "0", "0", "false", "count(DISTINCT o_orderstatus)") + " FROM orders")
def row_order_invariance(s, d):
    return U.row_order_invariance(_blind, table(s, d, "orders"), "o_orderkey")


@query(
    "WITH k AS (SELECT count(*) FILTER (r = 1) AS x, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem)) SELECT * FROM ("
    + _union(*(sel("fault_injection", "'o_orderkey'", f"'{g}'", k, "1", f"{k} < 1", "2") for g, k in (("empty", "1"), ("dropped", "1"), ("doubled", "1")))) + ") WHERE (SELECT x FROM k) > 0"
)
def fault_injection(s, d):
    o = table(s, d, "orders")
    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))

    def checks(df):
        gone = line.select("o_orderkey").distinct().unionByName(o.select("o_orderkey")).distinct().join(df.select("o_orderkey"), "o_orderkey", "left_anti").agg(F.count("*").alias("k"))
        there = gone.select(*C._row("orders_there", "o_orderkey", None, F.col("k"), F.lit(0), F.col("k") > 0, F.col("k")))
        return there.unionByName(C.duplicate_keys(df, ["o_orderkey"]))

    return U.fault_injection(checks, o, "o_orderkey")


@query("SELECT " + sel("known_answer", "'effect'", "l_returnflag", "round(avg(l_quantity) - 25, 6)", "1.0", "coalesce(sign(avg(l_quantity) - 25) <> 1, true)", "1") + " FROM lineitem GROUP BY l_returnflag")
def known_answer(s, d):
    line = table(s, d, "lineitem")
    expected = line.select("l_returnflag").distinct().withColumn("effect", F.lit(1.0))
    return U.known_answer(lambda df: df.groupBy("l_returnflag").agg((F.avg("l_quantity") - 25).alias("effect")), line, expected, "l_returnflag", "effect", "sign")


_Z = "(CAST(o_orderkey % 400 AS DOUBLE) / 100)"
_X = f"({_Z} / sqrt(2.0))"
_T = f"(1 / (1 + 0.3275911 * {_X}))"
_TAIL = f"({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-{_X} * {_X}))"


@query(f"WITH o AS (SELECT o_orderkey, {_TAIL} AS own, round({_TAIL}, 3) + CASE WHEN o_orderkey % 9 = 0 THEN 0.01 ELSE 0 END AS p FROM orders) SELECT " + sel("statcheck", "'p'", "o_orderkey", "round(p, 6)", "round(own, 6)", "abs(p - own) > 0.00051", "1") + " FROM o")
def statcheck(s, d):
    z = (F.col("o_orderkey") % 400).cast("double") / 100
    o = table(s, d, "orders").select("o_orderkey", z.alias("z"), (F.round(U.normal_tail(z), 3) + F.when(F.col("o_orderkey") % 9 == 0, 0.01).otherwise(0.0)).alias("p"))
    return U.statcheck(o, "o_orderkey", "z", "p", 0.00051)


#: Statistics whose p has a closed form: t with 1 and 2 degrees of freedom, chi-squared with 2 and 4, F with 2 and any, r of 4 pairs.
_CLOSED = {
    "t1": ("t", "v", 1, 0, "1 - 2 / pi() * atan(v)"), "t2": ("t", "v", 2, 0, "1 - v / sqrt(2 + v * v)"), "c2": ("chi2", "v * 4", 2, 0, "exp(-v * 2)"), "c4": ("chi2", "v * 4", 4, 0, "exp(-v * 2) * (1 + v * 2)"),
    "f": ("F", "v", 2, 9, "pow(1 + 2 * v / 9, -4.5)"), "r": ("r", "v / 4", 2, 0, "1 - v / 4"),
}


@query(
    "WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 400 AS DOUBLE) / 100 AS v FROM orders), s AS (" + " UNION ALL ".join(f"SELECT '{n}-' || k AS id, k, {p} AS own FROM o" for n, (_, _, _, _, p) in _CLOSED.items()) + ") SELECT "
    + sel("statcheck", "'p'", "id", "round(round(own, 4) + CASE WHEN k % 9 = 0 THEN 0.01 ELSE 0 END, 6)", "round(own, 6)", "k % 9 = 0", "1") + " FROM s"
)
def statistic_check(s, d):
    from lorespan.operators import tails

    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 400).cast("double") / 100).alias("v"))
    kinds = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(kind).alias("kind"), F.expr(f"CAST({stat} AS DOUBLE)").alias("stat"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.expr(p).alias("own")) for n, (kind, stat, a, b, p) in _CLOSED.items()))
    rows = o.withColumn("x", F.explode(kinds)).select(F.concat_ws("-", "x.name", F.col("k").cast("string")).alias("id"), "x.kind", "x.stat", "x.a", "x.b", (F.round("x.own", 4) + F.when(F.col("k") % 9 == 0, 0.01).otherwise(0.0)).alias("p"))
    return tails.statistic_check(rows, "id", "kind", "stat", "a", "b", "p")


@query("WITH x AS (SELECT p_partkey % 10 AS a, p_size % 10 AS b FROM part) " + _union(*(sel("intervals", "'a,b'", f"'{k}'", f"count(*) FILTER ({c})", "0", f"count(*) FILTER ({c}) > 0", "count(*)", v) + " FROM x" for k, c, v in (("reversed", "a > b", "error"), ("empty", "a = b", "warning"), ("zero_based", "a = 0", "warning")))))
def interval_check(s, d):
    return U.interval_check(table(s, d, "part").select((F.col("p_partkey") % 10).alias("a"), (F.col("p_size") % 10).alias("b")), "a", "b")


@query("SELECT p_partkey AS k, ['1', 'X', 'MT', 'MT', '22'][CAST(p_partkey % 5 + 1 AS INT)] AS chrom, p_partkey - CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS \"start\", p_partkey + p_size AS \"end\" FROM part")
def intervals_to_half_open(s, d):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*(F.lit(x) for x in ("chr1", "Chrx", "chrM", "mt", " 22"))), (k % 5 + 1).cast("int"))
    return table(s, d, "part").select(k.alias("k"), U.chromosome(name).alias("chrom"), U.to_half_open(k, k + F.col("p_size"), k % 2 == 0).alias("i")).select("k", "chrom", "i.*")


_PL = (("lang", "string"), ("source", "string"), ("quality", "int"))


@query(
    "WITH l AS (SELECT d.lang, d.source, quality FROM documents d LEFT JOIN labels USING (doc_id)), g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, '{t}' AS t, CAST({c} AS VARCHAR) AS v, count(*) AS k FROM l GROUP BY {c}" for c, t in _PL) + "), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k DESC, v) AS r FROM g WHERE v IS NOT NULL), tp AS (SELECT c, string_agg(v || '=' || k, '; ' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY c), "
    "x AS (SELECT c, t, CAST(sum(k) AS BIGINT) AS n, round(100.0 * coalesce(sum(k) FILTER (v IS NULL), 0) / sum(k), 4) AS m, count(v) AS u FROM g GROUP BY ALL) SELECT c AS \"column\", t AS type, n, m AS pct_missing, u AS n_unique, top, CASE WHEN u = 0 THEN 'all_missing' WHEN m > 50 THEN 'many_missing' WHEN u = 1 THEN 'constant' ELSE 'none' END AS flag FROM x JOIN tp USING (c)"
)
def profile_levels(s, d):
    return U.profile_levels(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), [c for c, _ in _PL])
