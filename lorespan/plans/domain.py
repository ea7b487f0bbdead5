"""Domain operators over the given tables: suppliers as samples, parts as genes, quantities as counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import domain as D
from lorespan.operators import stats as S

from .base import PLACE, placed, table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _line(s, d):
    return table(s, d, "lineitem")


def _changes(s, d):
    x = S.means_in_order(placed(s, d, "lineitem"), "l_partkey", {"p": "l_discount", "fc": "l_quantity"}, PLACE)
    return x.withColumn("fc", F.log2(F.col("fc") / 25))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 800)")
def low_count_filter(s, d):
    return D.low_count_filter(_line(s, d), "l_partkey", "l_quantity", 800).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, n_features, round(m, 6) AS mito_share, CASE WHEN n_features < 2 THEN 'few_features' WHEN n_features > 5 THEN 'many_features' WHEN m > 0.3 THEN 'mitochondrial' END AS reason FROM (SELECT l_orderkey, count(DISTINCT l_partkey) AS n_features, sum(CASE WHEN l_partkey % 10 = 0 THEN l_quantity ELSE 0 END) / sum(l_quantity) AS m FROM lineitem WHERE l_quantity > 0 GROUP BY 1)")
def cell_qc(s, d):
    return D.cell_qc(_line(s, d), "l_orderkey", "l_partkey", "l_quantity", F.col("l_partkey") % 10 == 0, 2, 5, 0.3)


@query("SELECT l_suppkey, l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY ALL")
def pseudobulk(s, d):
    return D.pseudobulk(_line(s, d), ["l_suppkey", "l_returnflag"], "l_quantity")


@query(
    "WITH x AS (SELECT l_partkey, avg(l_discount) AS p, log2(avg(l_quantity) / 25) AS fc FROM lineitem GROUP BY 1), c AS (SELECT *, CASE WHEN fc > 0 THEN 'up' ELSE 'down' END AS class FROM x WHERE p < 0.05 AND abs(fc) >= 0.1) SELECT class, CAST(k AS INT) AS k, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY p, abs(fc) DESC, l_partkey) AS k FROM c) WHERE k <= 10"
)
def volcano_labels(s, d):
    x = _changes(s, d)
    return D.volcano_labels(x, "l_partkey", "fc", "p", 10, 0.1)


@query("SELECT l_partkey, CASE WHEN p < 0.05 AND fc >= 0.2 THEN 'up' WHEN p < 0.05 AND fc <= -0.2 THEN 'down' ELSE 'none' END AS class FROM (SELECT l_partkey, avg(l_discount) AS p, log2(avg(l_quantity) / 25) AS fc FROM lineitem GROUP BY 1)")
def volcano_classes(s, d):
    x = _changes(s, d)
    return D.volcano_classes(x, "fc", "p", 0.2).select("l_partkey", "class")


@query(
    "WITH src AS (SELECT l_linenumber, l_returnflag, CASE WHEN l_quantity > 10 THEN l_quantity ELSE 0 END AS l_quantity FROM lineitem), r AS (SELECT l_linenumber, l_quantity AS q, l_returnflag = 'R' AS l, rank() OVER (PARTITION BY l_linenumber ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linenumber, l_quantity) - 1) / 2.0 AS rk FROM src), t AS (SELECT l_linenumber, sum(n ** 3 - n) AS t FROM (SELECT l_linenumber, l_quantity, count(*) AS n FROM src GROUP BY ALL) GROUP BY 1), "
    "x AS (SELECT l_linenumber, count(*) FILTER (l) AS n1, count(*) FILTER (NOT l) AS n2, sum(rk) FILTER (l) AS r, count(*) AS n, avg(q) FILTER (l) AS m1, avg(q) FILTER (NOT l) AS m2, avg(CASE WHEN q > 0 THEN 1.0 ELSE 0.0 END) FILTER (l) AS p1, avg(CASE WHEN q > 0 THEN 1.0 ELSE 0.0 END) FILTER (NOT l) AS p2 FROM r GROUP BY 1), y AS (SELECT *, r - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12.0 * ((n + 1) - t / (n * (n - 1.0))) AS v FROM x JOIN t USING (l_linenumber)) SELECT l_linenumber, n1, n2, round(u, 6) AS u, round((u - n1 * n2 / 2) / sqrt(v), 6) AS z, round(log2((m1 + 1) / (m2 + 1)), 6) AS log2_fc, round(p1, 6) AS pct1, round(p2, 6) AS pct2 FROM y"
)
def rank_sum_markers(s, d):
    line = _line(s, d).withColumn("l_quantity", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).otherwise(0.0))
    return D.rank_sum_markers(line, "l_linenumber", "l_quantity", F.col("l_returnflag") == "R")


@query(
    "WITH b AS (SELECT p_partkey AS g, p_brand AS st FROM part), h AS (SELECT p_partkey AS g FROM part WHERE p_size > 40), t AS (SELECT (SELECT count(*) FROM b) AS n_all, (SELECT count(*) FROM h) AS n), c AS (SELECT st, count(*) FILTER (g IN (SELECT g FROM h)) AS k, count(*) AS m FROM b GROUP BY 1), "
    "i AS (SELECT c.*, t.*, unnest(range(k, greatest(k, least(m, n)) + 1)) AS i FROM c, t), p AS (SELECT st, k, m, n, n_all, sum(CASE WHEN n - i <= n_all - m AND i <= n THEN exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n_all - m + 1) - lgamma(n - i + 1) - lgamma(greatest(0, n_all - m - n + i) + 1) - lgamma(n_all + 1) + lgamma(n + 1) + lgamma(n_all - n + 1)) ELSE 0 END) AS p FROM i GROUP BY ALL) "
    "SELECT st AS \"set\", k, m, round((k / n) / (m / n_all), 6) AS fold, round(least(1.0, p), 6) AS p FROM p"
)
def over_representation(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("g"), F.col("p_brand").alias("set"), "p_size")
    return D.over_representation(p, p.filter("p_size > 40"), p, "g")


@query(
    "WITH r AS (SELECT p_partkey AS g, p_brand AS st, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER () AS n FROM part), c AS (SELECT a.st, b.rank, CASE WHEN a.st = b.st THEN 1 ELSE 0 END AS hit, b.n, (SELECT count(*) FROM r x WHERE x.st = a.st) AS m FROM (SELECT DISTINCT st FROM r) a, r b), "
    "w AS (SELECT st, rank, sum(CASE WHEN hit = 1 THEN 1.0 / m ELSE -1.0 / (n - m) END) OVER (PARTITION BY st ORDER BY rank) AS s FROM c UNION ALL SELECT DISTINCT st, 0, 0.0 FROM c) SELECT st AS \"set\", round(s, 6) AS score, rank AS at FROM (SELECT *, row_number() OVER (PARTITION BY st ORDER BY round(abs(s), 9) DESC, rank) AS k FROM w) WHERE k = 1"
)
def running_enrichment(s, d):
    ranked, sets = _ranked(s, d)
    return D.running_enrichment(ranked, sets, "g")


def _ranked(s, d):
    from lorespan.operators.identity import global_rank

    p = table(s, d, "part").select(F.col("p_partkey").alias("g"), F.col("p_brand").alias("set"), "p_retailprice")
    return global_rank(p, [F.desc("p_retailprice"), F.col("g")]).select("g", "rank"), p.select("g", "set")


_ES = "es AS (" + SQL["running_enrichment"] + ")"


@query(f"WITH {_ES}, k AS (SELECT p_partkey AS g, p_brand AS st, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) SELECT st AS \"set\", g, rank FROM k JOIN es ON es.set = st WHERE CASE WHEN score >= 0 THEN rank <= es.\"at\" ELSE rank > es.\"at\" END")
def leading_edge(s, d):
    ranked, sets = _ranked(s, d)
    return D.leading_edge(ranked, sets, "g", D.running_enrichment(ranked, sets, "g"))


def _order_sql() -> str:
    """x of r(st, rep, n, x, c), through the rounds of an order's bijection: c holds four numbers for each."""
    sql = "r"
    for k in range(D.ROUNDS):
        y = f"((c[{4 * k + 1}] % n + n - x) % n)"
        sql = f"(SELECT st, rep, n, c, CASE WHEN ((c[{4 * k + 2}] * greatest(x, {y}) + c[{4 * k + 3}]) % 2147483647 * greatest(x, {y}) + c[{4 * k + 4}]) % 2147483647 % 2 = 1 THEN {y} ELSE x END AS x FROM {sql})"
    return sql


@query(
    f"WITH {_ES}, co AS (SELECT rep, [CAST('0x' || substr(md5('order:' || (rep * {D.ROUNDS} + j // 4)), CAST(8 * (j % 4) + 1 AS INT), 8) AS BIGINT) % 2147483647 for j in range({4 * D.ROUNDS})] AS c FROM range(1000) t(rep)), "
    "r AS (SELECT p_brand AS st, rep, count(*) OVER (PARTITION BY rep) AS n, row_number() OVER (PARTITION BY rep ORDER BY p_retailprice DESC, p_partkey) - 1 AS x, c FROM part, co), "
    f"i AS (SELECT st, rep, n, x + 1 AS rank, row_number() OVER (PARTITION BY rep, st ORDER BY x) AS i, count(*) OVER (PARTITION BY rep, st) AS m FROM {_order_sql()}), v AS (SELECT rep, st, i / m - (rank - i) / (n - m) AS s, rank AS ra FROM i UNION ALL SELECT rep, st, (i - 1) / m - (rank - i) / (n - m), rank - 1 FROM i), "
    "b AS (SELECT rep, st, round(arg_max(s, (round(abs(s), 9), -ra)), 6) AS s FROM v GROUP BY ALL) SELECT es.set AS \"set\", score, round(avg(CASE WHEN abs(s) >= abs(score) THEN 1.0 ELSE 0.0 END), 6) AS p FROM es JOIN b ON st = es.set GROUP BY ALL"
)
def enrichment_pvalues(s, d):
    ranked, sets = _ranked(s, d)
    return D.enrichment_pvalues(ranked, sets, "g", D.running_enrichment(ranked, sets, "g"), 1_000)


@query("SELECT l_partkey, n_cells, CASE WHEN n_cells < 25 THEN 'few_cells' END AS reason FROM (SELECT l_partkey, count(DISTINCT l_orderkey) FILTER (l_quantity > 0) AS n_cells FROM lineitem GROUP BY 1)")
def gene_qc(s, d):
    return D.gene_qc(_line(s, d), "l_orderkey", "l_partkey", "l_quantity", 25)


@query(
    "WITH px AS (SELECT l_suppkey AS image, l_partkey % 5 AS t, CASE WHEN l_partkey % 5 = 1 THEN 1 + l_orderkey % 2 WHEN l_partkey % 5 IN (2, 3) THEN 5 WHEN l_partkey % 5 = 0 AND l_orderkey % 3 = 0 THEN 7 ELSE 0 END AS p FROM lineitem), o AS (SELECT image, t, p, count(*) AS o FROM px GROUP BY ALL), ta AS (SELECT image, t, sum(o) AS ta FROM o WHERE t <> 0 GROUP BY ALL), pa AS (SELECT image, p, sum(o) AS pa FROM o WHERE p <> 0 GROUP BY ALL), "
    "m AS (SELECT * FROM o JOIN ta USING (image, t) JOIN pa USING (image, p)), sp AS (SELECT image, count(*) AS k FROM (SELECT image, t FROM m WHERE o / pa > 0.5 GROUP BY ALL HAVING count(*) > 1) GROUP BY 1), me AS (SELECT image, count(*) AS k FROM (SELECT image, p FROM m WHERE o / ta > 0.5 GROUP BY ALL HAVING count(*) > 1) GROUP BY 1), "
    "fp AS (SELECT image, count(*) AS k FROM pa WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image = pa.image AND m.p = pa.p) GROUP BY 1), mi AS (SELECT image, count(*) AS k FROM ta WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image = ta.image AND m.t = ta.t) GROUP BY 1) "
    "SELECT i.image, coalesce(sp.k, 0) AS split, coalesce(me.k, 0) AS merged, coalesce(fp.k, 0) AS false_positives, coalesce(mi.k, 0) AS missed FROM (SELECT DISTINCT image FROM px) i LEFT JOIN sp USING (image) LEFT JOIN me USING (image) LEFT JOIN fp USING (image) LEFT JOIN mi USING (image)"
)
def segmentation_errors(s, d):
    t, o = F.col("l_partkey") % 5, F.col("l_orderkey")
    p = F.when(t == 1, 1 + o % 2).when(t.isin(2, 3), 5).when((t == 0) & (o % 3 == 0), 7).otherwise(0)
    return D.segmentation_errors(_line(s, d).select(F.col("l_suppkey").alias("image"), t.alias("t"), p.alias("p")))


@query(
    "WITH q AS (SELECT p_brand AS image, p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 10 AS y FROM part), d AS (SELECT a.image, a.id, b.id AS o, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM q a JOIN q b ON a.image = b.image AND a.id <> b.id) SELECT image, id, o AS neighbor, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY d, o) AS k FROM d) WHERE k = 1"
)
def nearest_neighbor(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("image"), F.col("p_partkey").alias("id"), "p_size", (F.col("p_retailprice") / 10).alias("y"))
    return D.nearest_neighbor(p, "image", "id", "p_size", "y", 8)


@query("SELECT image, round(c, 6) AS contrast, c < 14.4 AS blurred FROM (SELECT l_suppkey AS image, sqrt(sum(l_quantity * l_quantity) / count(*) - avg(l_quantity) * avg(l_quantity)) AS c FROM lineitem GROUP BY 1)")
def focus_flags(s, d):
    return D.focus_flags(_line(s, d).groupBy(F.col("l_suppkey").alias("image"), F.col("l_quantity").alias("level")).agg(F.count("*").alias("n")), 14.4)


@query("SELECT l_suppkey AS sample, metric, passed FROM (SELECT l_suppkey, 'quantity' AS metric, avg(l_quantity) BETWEEN 25 AND 26 AS passed FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'discount', avg(l_discount) BETWEEN 0.045 AND 0.05 FROM lineitem GROUP BY 1)")
def sample_qc_summary(s, d):
    x = S.means_in_order(placed(s, d, "lineitem").withColumnRenamed("l_suppkey", "sample"), "sample", {"quantity": "l_quantity", "discount": "l_discount"}, PLACE).unpivot("sample", ["quantity", "discount"], "metric", "value")
    return D.sample_qc_summary(x, s.createDataFrame([("quantity", 25.0, 26.0), ("discount", 0.045, 0.05)], "metric string, low double, high double"))


@query(
    "WITH px AS (SELECT l_suppkey AS image, l_partkey % 4 AS t, CASE WHEN l_orderkey % 6 = 0 THEN (l_partkey + 1) % 4 ELSE l_partkey % 4 END AS p FROM lineitem), o AS (SELECT image, t, p, count(*) AS o FROM px GROUP BY ALL), ta AS (SELECT image, t, sum(o) AS ta FROM o WHERE t <> 0 GROUP BY ALL), pa AS (SELECT image, p, sum(o) AS pa FROM o WHERE p <> 0 GROUP BY ALL), "
    "i AS (SELECT image, o / (ta + pa - o) AS iou FROM o JOIN ta USING (image, t) JOIN pa USING (image, p) WHERE o / (ta + pa - o) > 0.5), n AS (SELECT image, coalesce(a, 0) AS n_true, coalesce(b, 0) AS n_pred FROM (SELECT image, count(*) AS a FROM ta GROUP BY 1) FULL JOIN (SELECT image, count(*) AS b FROM pa GROUP BY 1) USING (image)), m AS (SELECT image, count(*) AS matched, round(avg(iou), 6) AS mean_iou FROM i GROUP BY 1) "
    "SELECT image, n_true, n_pred, coalesce(matched, 0) AS matched, round(2 * coalesce(matched, 0) / (n_true + n_pred), 6) AS f1, mean_iou FROM n LEFT JOIN m USING (image)"
)
def match_objects(s, d):
    k = F.col("l_partkey")
    return D.match_objects(_line(s, d).select(F.col("l_suppkey").alias("image"), (k % 4).alias("t"), F.when(F.col("l_orderkey") % 6 == 0, (k + 1) % 4).otherwise(k % 4).alias("p")))


@query("SELECT o_orderkey, round(o_totalprice / m, 6) AS normalized FROM orders LEFT JOIN (SELECT o_orderpriority, median(o_totalprice) AS m FROM orders WHERE o_custkey % 4 = 0 GROUP BY 1) USING (o_orderpriority)")
def normalize_to_control(s, d):
    return D.normalize_to_control(table(s, d, "orders"), "o_orderpriority", "o_totalprice", F.col("o_custkey") % 4 == 0).select("o_orderkey", "normalized")


@query("SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linenumber IN (1, 7)) - avg(l_quantity) FILTER (l_linenumber NOT IN (1, 7)), 6) AS edge_diff, round(regr_slope(l_quantity, l_linenumber), 6) AS gradient FROM lineitem GROUP BY 1")
def plate_effects(s, d):
    return D.plate_effects(_line(s, d), "l_returnflag", F.col("l_linenumber").isin(1, 7), "l_quantity", "l_linenumber")


@query("SELECT o_custkey, count(*) AS length, CAST(coalesce(sum(greatest(g, 0)), 0) AS BIGINT) AS gaps FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS g FROM orders) GROUP BY 1")
def track_stats(s, d):
    return D.track_stats(table(s, d, "orders"), "o_custkey", "o_orderkey")


@query("SELECT image, round(s, 6) AS share, s >= 0.02 AS saturated FROM (SELECT l_suppkey AS image, sum(CASE WHEN l_quantity >= 50 THEN 1 ELSE 0 END) / count(*) AS s FROM lineitem GROUP BY 1)")
def saturation_flags(s, d):
    return D.saturation_flags(_line(s, d).groupBy(F.col("l_suppkey").alias("image"), F.col("l_quantity").alias("level")).agg(F.count("*").alias("n")), 50, 0.02)


@query("SELECT count(*) FILTER (x LIKE 'chr%') AS prefixed, count(*) FILTER (x NOT LIKE 'chr%') AS bare, count(*) FILTER (x IN ('chrm', 'm')) AS mitochondrial_m, count(*) FILTER (x IN ('chrmt', 'mt')) AS mitochondrial_mt, count(*) FILTER (x LIKE 'chr%') > 0 AND count(*) FILTER (x NOT LIKE 'chr%') > 0 OR count(*) FILTER (x IN ('chrm', 'm')) > 0 AND count(*) FILTER (x IN ('chrmt', 'mt')) > 0 AS mixed FROM (SELECT CASE WHEN p_size = 50 THEN 'chrm' WHEN p_size = 49 THEN 'mt' WHEN p_partkey % 2 = 0 THEN 'chr' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) END AS x FROM part)")
def id_namespace_check(s, d):
    n = F.col("p_size")
    return D.id_namespace_check(table(s, d, "part").select(F.when(n == 50, "chrM").when(n == 49, "MT").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("chr"), n.cast("string"))).otherwise(n.cast("string")).alias("c")), "c")


@query("SELECT l_partkey, round(sum(l_quantity), 6) AS l_quantity, round(sum(l_tax), 6) AS l_tax, count(*) AS n_rows FROM lineitem GROUP BY 1")
def aggregate_duplicates(s, d):
    return D.aggregate_duplicates(_line(s, d), "l_partkey", ["l_quantity", "l_tax"])
