"""Sensitivity, resampling and statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespan.operators import stats as S

from .base import table

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


def _returned():
    return F.col("l_returnflag") == "R"


_T = (5.0, 10.0, 25.0, 40.0)


@query(" UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, count(*) AS n, round(avg(l_tax), 6) AS mean, {str(t == 10.0).lower()} AS chosen, abs(avg(l_tax) - (SELECT avg(l_tax) FROM lineitem WHERE l_quantity >= 10)) <= 0.1 * (SELECT avg(l_tax) FROM lineitem WHERE l_quantity >= 10) AS stable FROM lineitem WHERE l_quantity >= {t}" for t in _T))
def threshold_sweep(s, d):
    return S.threshold_sweep(_line(s, d), "l_quantity", list(_T), "l_tax", 10.0)


@query(
    "WITH c AS (SELECT label AS a, CAST(floor(embedding[1] * 4) AS INTEGER) AS b, count(*) AS n FROM embeddings GROUP BY ALL), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb) "
    "SELECT CAST(t AS BIGINT) AS n, round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(s / (sa + sb - s), 6) AS jaccard FROM x"
)
def method_agreement(s, d):
    e = table(s, d, "embeddings").select(F.col("label").alias("a"), F.floor(F.get("embedding", F.lit(0)).cast("double") * 4).cast("int").alias("b"))
    return S.method_agreement(e, "a", "b")


@query(" UNION ALL ".join(f"SELECT '{k}' AS variant, count(*) AS n, round(avg(l_extendedprice), 6) AS mean FROM lineitem WHERE {c}" for k, c in (("strict", "l_quantity > 30 AND l_discount < 0.05"), ("moderate", "l_quantity > 15"), ("lenient", "l_quantity > 0"))))
def preprocessing_sweep(s, d):
    v = {"strict": (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05), "moderate": F.col("l_quantity") > 15, "lenient": F.col("l_quantity") > 0}
    return S.preprocessing_sweep(_line(s, d), v, "l_extendedprice")


_U = "CAST('0x' || substr(md5(CAST({i} AS VARCHAR) || ':' || CAST({r} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"


@query(" UNION ALL ".join(f"SELECT {k} AS replica, round(avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R'), 6) AS diff FROM lineitem WHERE {_U.format(i='l_orderkey', r=k)} < 0.8" for k in range(5)))
def subsample_stability(s, d):
    return S.subsample_stability(_line(s, d), "l_orderkey", "l_quantity", _returned())


#: A cubic polynomial, modulo a prime, of a number from a unit's MD5; its four coefficients come from the MD5 of the replica.
_PLACE = "CAST('0x' || substr(md5(CAST({i} AS VARCHAR)), 1, 13) AS BIGINT) % 2147483647"
_COEF = "SELECT r AS rep, " + ", ".join(f"CAST('0x' || substr(md5('{{seed}}:' || r), {8 * k + 1}, 8) AS BIGINT) % 2147483647 AS k{k}" for k in range(4)) + " FROM range({n}) t(r)"
_POLY = "(((k0 * x + k1) % 2147483647 * x + k2) % 2147483647 * x + k3) % 2147483647"


@query(
    f"WITH u AS (SELECT l_suppkey AS unit, {_PLACE.format(i='l_suppkey')} AS x, sum(l_quantity) AS s, count(*) AS c, l_suppkey % 2 = 0 AS l FROM lineitem GROUP BY ALL), k AS (SELECT count(*) FILTER (l) AS k FROM u), co AS ({_COEF.format(seed='perm', n=1000)}), "
    f"r AS (SELECT u.*, rep, row_number() OVER (PARTITION BY rep ORDER BY {_POLY}, unit) AS o FROM u, co), "
    "n AS (SELECT rep, sum(s) FILTER (o <= k) / sum(c) FILTER (o <= k) - sum(s) FILTER (o > k) / sum(c) FILTER (o > k) AS d FROM r, k GROUP BY rep), b AS (SELECT sum(s) FILTER (l) / sum(c) FILTER (l) - sum(s) FILTER (NOT l) / sum(c) FILTER (NOT l) AS obs FROM u) "
    "SELECT round(obs, 6) AS observed, round(avg(CASE WHEN abs(d) >= abs(obs) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_value, count(*) AS n FROM n, b GROUP BY obs"
)
def permutation_test(s, d):
    return S.permutation_test(_line(s, d), "l_suppkey", "l_quantity", F.col("l_suppkey") % 2 == 0, 1_000)


_BOOT = "SELECT replica, round(sum(w * s) / sum(w * c), 6) AS mean FROM (SELECT replica, s, c, " + " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in S.POISSON) + " AS w FROM (SELECT replica, s, c, " + _U.format(i="o_custkey", r="replica") + " AS u FROM (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS c FROM orders GROUP BY 1), range(2000) t(replica))) GROUP BY replica"


@query(f"SELECT CAST(replica AS INTEGER) AS replica, mean FROM ({_BOOT})")
def poisson_bootstrap(s, d):
    return S.poisson_bootstrap(table(s, d, "orders"), "o_custkey", "o_totalprice", 2_000)


@query(f"SELECT min(mean) FILTER (r >= ceil(2000 * 0.025)) AS lo, min(mean) FILTER (r >= ceil(2000 * 0.975)) AS hi FROM (SELECT mean, row_number() OVER (ORDER BY mean, replica) AS r FROM ({_BOOT}))")
def bootstrap_ci(s, d):
    return S.bootstrap_ci(poisson_bootstrap(s, d))


@query(
    "WITH x AS (SELECT avg(v) FILTER (l) AS ma, avg(v) FILTER (NOT l) AS mb, var_samp(v) FILTER (l) AS va, var_samp(v) FILTER (NOT l) AS vb, count(v) FILTER (l) AS na, count(v) FILTER (NOT l) AS nb FROM (SELECT l_returnflag = 'R' AS l, l_extendedprice AS v FROM lineitem)), "
    "y AS (SELECT *, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM x) SELECT round(ma - mb, 6) AS mean_diff, round(d, 6) AS cohens_d, round(d * (1 - 3.0 / (4 * (na + nb - 2) - 1)), 6) AS hedges_g, round(log2(ma / mb), 6) AS log2_fc FROM y"
)
def effect_size(s, d):
    return S.effect_size(_line(s, d), _returned(), "l_extendedprice")


@query(
    "WITH t AS (SELECT event_id, (CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) + 1) / 4294967297.0 * CASE WHEN event_id % 10 = 0 THEN 0.0001 ELSE 1 END AS p FROM events), r AS (SELECT *, row_number() OVER (ORDER BY p, event_id) AS k, count(*) OVER () AS m FROM t) "
    "SELECT event_id, p, round(least(1.0, p * m), 9) AS bonferroni, round(least(1.0, min(p * m / k) OVER (ORDER BY k DESC)), 9) AS bh FROM r"
)
def adjust_pvalues(s, d):
    h = (F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967297.0)
    return S.adjust_pvalues(table(s, d, "events").select("event_id", (h * F.when(F.col("event_id") % 10 == 0, 0.0001).otherwise(1.0)).alias("p")), "event_id", "p")


@query("SELECT l_returnflag, round(m, 6) AS mean, round(m - 1.959963984540054 * e, 6) AS lo, round(m + 1.959963984540054 * e, 6) AS hi FROM (SELECT l_returnflag, avg(l_quantity) AS m, stddev_samp(l_quantity) / sqrt(count(l_quantity)) AS e FROM lineitem GROUP BY 1)")
def confidence_interval(s, d):
    return S.confidence_interval(_line(s, d), "l_returnflag", "l_quantity")


@query("(SELECT o_orderkey, o_totalprice, 'bottom' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey, o_totalprice, 'top' FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)")
def outliers(s, d):
    return S.outliers(table(s, d, "orders"), "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice, round(abs(o_totalprice - (SELECT median(o_totalprice) FROM orders)), 6) AS distance FROM orders ORDER BY distance, o_orderkey LIMIT 5")
def near_median(s, d):
    return S.near_median(table(s, d, "orders"), "o_orderkey", "o_totalprice")


@query("SELECT o_orderpriority, extreme, median, round(s / n, 6) AS mean, round(CASE WHEN n > 1 THEN (s - v) / (n - 1) END, 6) AS mean_without FROM (SELECT o_orderpriority, (SELECT p.o_orderkey FROM orders p WHERE p.o_orderpriority = o.o_orderpriority ORDER BY p.o_totalprice DESC, p.o_orderkey LIMIT 1) AS extreme, (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER () AS n FROM orders p WHERE p.o_orderpriority = o.o_orderpriority) WHERE k = ceil(n / 2)) AS median, max(o_totalprice) AS v, sum(o_totalprice) AS s, count(*) AS n FROM orders o GROUP BY o_orderpriority)")
def group_spotcheck(s, d):
    return S.group_spotcheck(table(s, d, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice")


@query(
    "WITH f AS (SELECT *, l_discount > 0.08 AS f FROM lineitem) SELECT 'l_quantity' AS feature, CAST(NULL AS VARCHAR) AS level, round(avg(l_quantity) FILTER (f), 6) AS failing, round(avg(l_quantity) FILTER (NOT f), 6) AS passing FROM f UNION ALL SELECT 'l_tax', NULL, round(avg(l_tax) FILTER (f), 6), round(avg(l_tax) FILTER (NOT f), 6) FROM f "
    "UNION ALL SELECT 'l_returnflag', l_returnflag, round(count(*) FILTER (f) / (SELECT count(*) FROM f WHERE f), 6), round(count(*) FILTER (NOT f) / (SELECT count(*) FROM f WHERE NOT f), 6) FROM f GROUP BY l_returnflag"
)
def characterize_failures(s, d):
    return S.characterize_failures(_line(s, d), F.col("l_discount") > 0.08, ["l_quantity", "l_tax"], "l_returnflag")


@query("SELECT l_linestatus, round(avg(CASE WHEN l_discount > 0.08 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(l_extendedprice), 6) AS with_failures, round(avg(l_extendedprice) FILTER (l_discount <= 0.08), 6) AS without FROM lineitem GROUP BY 1")
def failure_impact(s, d):
    return S.failure_impact(_line(s, d), F.col("l_discount") > 0.08, "l_extendedprice", "l_linestatus")


@query(
    "WITH m AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R') AS main FROM lineitem), "
    "g AS (SELECT 'l_linenumber' AS covariate, CAST(l_linenumber AS VARCHAR) AS level, avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R') AS e FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R') FROM lineitem GROUP BY 2) "
    "SELECT covariate, level, round(e, 6) AS effect, CASE WHEN abs(e) < 0.1 * abs(main) THEN 'vanishes' WHEN sign(e) * sign(main) < 0 THEN 'reverses' ELSE 'holds' END AS verdict FROM g, m WHERE e IS NOT NULL"
)
def breaking_subset(s, d):
    return S.breaking_subset(_line(s, d), ["l_linenumber", "l_linestatus"], "l_quantity", _returned())


@query("SELECT l_linenumber, round(x, 6) AS direct, CASE WHEN l_linenumber % 2 = 0 THEN 1.0 ELSE -1.0 END AS reported, sign(x) = CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS agrees FROM (SELECT l_linenumber, log2(avg(l_extendedprice) FILTER (l_returnflag = 'R') / avg(l_extendedprice) FILTER (l_returnflag <> 'R')) AS x FROM lineitem GROUP BY 1)")
def direction_check(s, d):
    rep = _line(s, d).select("l_linenumber").distinct().withColumn("effect", F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(-1.0))
    return S.direction_check(_line(s, d), "l_linenumber", "l_extendedprice", _returned(), rep)


@query("SELECT p_brand, count(*) AS n, round(stddev_samp(p_retailprice) / avg(p_retailprice), 6) AS cv, stddev_samp(p_retailprice) / avg(p_retailprice) < 0.05 AS steady FROM part GROUP BY 1")
def control_check(s, d):
    return S.control_check(table(s, d, "part"), "p_brand", "p_retailprice")


@query(
    "SELECT event_type, round(sqrt(count(*)) * sum((value - m) ** 3) / sum((value - m) ** 2) ** 1.5, 5) AS skewness, round(count(*) * sum((value - m) ** 4) / sum((value - m) ** 2) ** 2 - 3, 5) AS excess_kurtosis, round(corr(value, l), 5) AS lag1 "
    "FROM (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS l FROM events) GROUP BY event_type"
)
def assumption_diagnostics(s, d):
    return S.assumption_diagnostics(table(s, d, "events"), "event_type", "value", ["ts", "event_id"])


@query("WITH u AS (SELECT l_suppkey, l_suppkey % 2 = 0 AS l, avg(l_quantity) AS m, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY ALL) SELECT round(sum(n) / count(*), 6) AS rows_per_unit, round(sum(s) FILTER (l) / sum(n) FILTER (l) - sum(s) FILTER (NOT l) / sum(n) FILTER (NOT l), 6) AS effect_rows, round(avg(m) FILTER (l) - avg(m) FILTER (NOT l), 6) AS effect_units FROM u")
def pseudoreplication_check(s, d):
    return S.pseudoreplication_check(_line(s, d), "l_suppkey", "l_quantity", F.col("l_suppkey") % 2 == 0)


@query("SELECT user_id, round(avg(abs(value - m)), 6) AS mae_mean, round(avg(abs(value - p)), 6) AS mae_previous FROM (SELECT user_id, value, avg(value) OVER (PARTITION BY user_id) AS m, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def baseline_model_check(s, d):
    return S.baseline_model_check(table(s, d, "events"), "user_id", ["ts", "event_id"], "value")


_SUB = "sub AS (" + SQL["subsample_stability"] + ")"


@query(f"WITH {_SUB}, o AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R') AS d FROM lineitem) SELECT count(*) AS n, round(avg(CASE WHEN sign(diff) = sign(d) THEN 1.0 ELSE 0.0 END), 6) AS holds, avg(CASE WHEN sign(diff) = sign(d) THEN 1.0 ELSE 0.0 END) < 0.8 AS fragile FROM sub, o")
def stability_verdict(s, d):
    return S.stability_verdict(subsample_stability(s, d), S.effect_size(_line(s, d), _returned(), "l_quantity").select(F.col("mean_diff").alias("diff")))


@query("SELECT count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(min(d), 6) AS low, round(max(d), 6) AS high FROM (" + " UNION ALL ".join(f"SELECT avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R') AS d FROM lineitem WHERE {_U.format(i='l_orderkey', r=k)} < 0.5" for k in (42, 123, 456, 789, 2024)) + ")")
def seed_stability(s, d):
    return S.seed_stability(_line(s, d), "l_orderkey", "l_quantity", _returned())


@query("SELECT o_orderkey, o_totalprice, round(z, 6) AS z FROM (SELECT o_orderkey, o_totalprice, (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders) AS z FROM orders) WHERE abs(z) > 1.7")
def beyond_sd(s, d):
    return S.beyond_sd(table(s, d, "orders"), "o_orderkey", "o_totalprice", 1.7)


@query(
    "WITH x AS (SELECT CAST(count(*) FILTER (l AND o) AS DOUBLE) AS a, CAST(count(*) FILTER (l AND NOT o) AS DOUBLE) AS b, CAST(count(*) FILTER (NOT l AND o) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT l AND NOT o) AS DOUBLE) AS d, corr(CASE WHEN l THEN 1.0 ELSE 0.0 END, q) AS r FROM (SELECT l_returnflag = 'R' AS l, l_discount > 0.05 AS o, l_quantity AS q FROM lineitem)) "
    "SELECT round(a * d / (b * c), 6) AS odds_ratio, round((a / (a + b)) / (c / (c + d)), 6) AS risk_ratio, round((a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)), 6) AS phi, round(r, 6) AS r FROM x"
)
def association(s, d):
    return S.association(_line(s, d), _returned(), F.col("l_discount") > 0.05, "l_quantity")


@query("SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER ({c} < 0.{k}) AS {c}_{k}" for c in ("p", "bonferroni", "bh") for k in ("05", "01")) + " FROM (" + SQL["adjust_pvalues"] + ")")
def significance_counts(s, d):
    return S.significance_counts(adjust_pvalues(s, d))


@query("SELECT l_returnflag, n, round(p, 6) AS share, round(greatest(0.0, p - e), 6) AS lo, round(least(1.0, p + e), 6) AS hi FROM (SELECT *, 1.959963984540054 * sqrt(p * (1 - p) / n) AS e FROM (SELECT l_returnflag, count(*) AS n, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS p FROM lineitem GROUP BY 1))")
def proportion_interval(s, d):
    return S.proportion_interval(_line(s, d), "l_returnflag", F.col("l_discount") > 0.05)


@query("SELECT l_returnflag, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS lo, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS hi FROM (SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1)")
def correlation_interval(s, d):
    return S.correlation_interval(_line(s, d), "l_returnflag", "l_quantity", "l_extendedprice")


@query("SELECT p_brand, count(*) AS n, round(avg(p_size), 6) AS mean, abs(avg(p_size) - 25) <= 3 AS near FROM part GROUP BY 1")
def negative_controls(s, d):
    return S.negative_controls(table(s, d, "part"), "p_brand", "p_size", 25.0, 3.0)


@query("SELECT round(max(v) / min(v), 6) AS ratio, max(v) / min(v) > 4 AS unequal FROM (SELECT var_samp(p_retailprice) AS v FROM part GROUP BY p_brand HAVING count(*) > 1)")
def variance_ratio(s, d):
    return S.variance_ratio(table(s, d, "part"), "p_brand", "p_retailprice")


@query("SELECT (SELECT count(*) FROM g) AS n_strata, (SELECT round(avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R'), 6) FROM lineitem) AS crude, (SELECT round(sum(e * n) / sum(n), 6) FROM g) AS stratified FROM (SELECT 1)".replace("SELECT (SELECT count(*) FROM g)", "WITH g AS (SELECT avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R') AS e, count(*) AS n FROM lineitem GROUP BY l_linenumber, l_linestatus HAVING count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag <> 'R') > 0) SELECT (SELECT count(*) FROM g)"))
def stratified_effect(s, d):
    return S.stratified_effect(_line(s, d), ["l_linenumber", "l_linestatus"], _returned(), "l_quantity")


@query("SELECT count(*) AS n_folds, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS sd FROM (SELECT avg(abs(l_extendedprice - 1500 * l_quantity)) AS e FROM lineitem GROUP BY l_orderkey % 5)")
def fold_scores(s, d):
    return S.fold_scores(_line(s, d).withColumn("guess", 1500 * F.col("l_quantity")), F.col("l_orderkey") % 5, "l_extendedprice", "guess")


@query("SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM (SELECT l_quantity / 50 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem) GROUP BY 1")
def calibration_bins(s, d):
    return S.calibration_bins(_line(s, d).select((F.col("l_quantity") / 50).alias("p"), _returned().cast("int").alias("y")), "p", "y")
