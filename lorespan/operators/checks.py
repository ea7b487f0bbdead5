"""Validation of tables. Every check returns rows (check, column, group, observed, expected, severity, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Strings that stand for a missing value.
PHANTOMS = ("nan", "na", "n/a", "none", "null", "", "-", "?")


class CheckFailed(Exception):
    """A check of at least the asked severity found something."""


def raise_on(checks: DataFrame, severity: str = "error") -> DataFrame:
    """checks, or CheckFailed with the first few rows of that severity."""
    bad = checks.filter(F.col("severity") == severity).limit(5).collect()
    if bad:
        raise CheckFailed("; ".join(str(r.asDict()) for r in bad))
    return checks


def _row(check: str, column, group, observed: Column, expected: Column, bad: Column, n: Column, severity: str = "error") -> list[Column]:
    text = lambda x: F.lit(x).cast("string") if not isinstance(x, Column) else x.cast("string")
    return [F.lit(check).alias("check"), text(column).alias("column"), text(group).alias("group"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected"), F.when(bad, severity).otherwise("ok").alias("severity"), n.cast("long").alias("n")]


def row_delta(before: DataFrame, after: DataFrame, expected: int = 0) -> DataFrame:
    a, b = before.agg(F.count("*").alias("a")), after.agg(F.count("*").alias("b"))
    d = F.col("b") - F.col("a")
    return a.crossJoin(b).select(*_row("row_delta", None, None, d, F.lit(expected), d != expected, F.col("b")))


def filter_loss(before: DataFrame, after: DataFrame, max_pct: float = 50.0) -> DataFrame:
    a, b = before.agg(F.count("*").alias("a")), after.agg(F.count("*").alias("b"))
    pct = F.when(F.col("a") > 0, F.round(100 * (F.col("a") - F.col("b")) / F.col("a"), 6)).otherwise(0.0)
    return a.crossJoin(b).select(*_row("filter_loss", None, None, pct, F.lit(max_pct), pct > max_pct, F.col("b")))


def join_guard(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The size that an inner join would have, from the keys' counts alone; an error if it exceeds the larger side."""
    l, r = (df.groupBy(key).agg(F.count("*").alias(c)) for df, c in ((left, "nl"), (right, "nr")))  # noqa: E741
    size = F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0))
    sides = F.greatest(F.coalesce(F.sum("nl"), F.lit(0)), F.coalesce(F.sum("nr"), F.lit(0)))
    return l.join(r, key, "full").agg(size.alias("size"), sides.alias("larger")).select(*_row("join_guard", key, None, F.col("size"), F.col("larger"), F.col("size") > F.col("larger"), F.col("size")))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    n = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("dup"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows"))
    return n.select(*_row("duplicate_keys", ",".join(key), None, F.col("dup"), F.lit(0), F.col("dup") > 0, F.col("rows")))


def type_contract(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """A row for each column of expected: whether it is there with that type, and how many values it has."""
    have = dict(df.dtypes)
    one = df.agg(*(F.count(c).alias(f"n{k}") if c in have else F.lit(0).alias(f"n{k}") for k, c in enumerate(expected)))
    rows = [F.struct(*_row("type_contract", c, have.get(c), F.lit(int(have.get(c) == t)), F.lit(1), F.lit(have.get(c) != t), F.col(f"n{k}"))) for k, (c, t) in enumerate(expected.items())]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def null_audit(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """Share of nulls of each column, one pass."""
    g = [F.col(group).alias("_g")] if group else [F.lit(None).cast("string").alias("_g")]
    counts = df.select(*g, *columns).groupBy("_g").agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = counts.select("_g", "n", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("k")) for c in columns))).alias("x"))
    share = F.round(F.col("x.k") / F.col("n"), 6)
    return long.select(*_row("null_audit", F.col("x.c"), F.col("_g"), share, F.lit(0.0), share > 0, F.col("n"), "warning"))


def non_castable(df: DataFrame, column: str, kind: str) -> DataFrame:
    """How many values a cast would turn to null."""
    lost = F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()
    return df.agg(F.count_if(lost).alias("k"), F.count("*").alias("n")).select(*_row("non_castable", column, kind, F.col("k"), F.lit(0), F.col("k") > 0, F.col("n")))


def _exploded(one: DataFrame, rows: list[list[Column]]) -> DataFrame:
    """Check rows from one row of aggregates, which is computed once."""
    return one.select(F.explode(F.array(*(F.struct(*r) for r in rows))).alias("r")).select("r.*")


def phantom_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each column that hold a string for a missing value, or differ from another level by white space at the ends. One pass for all columns."""
    aggs, rows = [F.count("*").alias("n")], []
    for k, c in enumerate(columns):
        x = F.col(c)
        aggs += [F.count_if(F.lower(F.trim(x)).isin(*PHANTOMS)).alias(f"k{k}"), (F.countDistinct(x) - F.countDistinct(F.trim(x))).alias(f"v{k}")]
        rows += [_row("phantom_levels", c, "missing", F.col(f"k{k}"), F.lit(0), F.col(f"k{k}") > 0, F.col("n")), _row("phantom_levels", c, "white_space", F.col(f"v{k}"), F.lit(0), F.col(f"v{k}") > 0, F.col("n"))]
    return _exploded(df.agg(*aggs), rows)


def range_check(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    out = F.count_if((F.col(column) < low) | (F.col(column) > high))
    return df.agg(out.alias("k"), F.count(column).alias("n")).select(*_row("range_check", column, None, F.col("k"), F.lit(0), F.col("k") > 0, F.col("n")))


def double_transform(df: DataFrame, column: str) -> DataFrame:
    """Whether values look standardised already, or logged twice."""
    a = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.min(column).alias("lo"), F.count(column).alias("n"))
    std = (F.abs("m") < 0.01) & (F.abs(F.col("s") - 1) < 0.01)
    log = (F.col("lo") < -10) & (F.col("s") < 2)
    return _exploded(a, [_row("double_transform", column, k, F.when(b, 1).otherwise(0), F.lit(0), b, F.col("n"), "warning") for k, b in (("standardised", std), ("logged", log))])


def split_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    both = train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("k"))
    return both.select(*_row("split_overlap", key, None, F.col("k"), F.lit(0), F.col("k") > 0, F.col("k")))


def normalization_leak(train: DataFrame, test: DataFrame, columns: list[str]) -> DataFrame:
    """Columns whose means are equal in both parts, or 0 in the test part."""
    a = train.agg(*(F.avg(c).alias(f"a_{c}") for c in columns)).crossJoin(test.agg(*(F.avg(c).alias(f"b_{c}") for c in columns), F.count("*").alias("n")))
    parts = []
    for c in columns:
        bad = F.coalesce((F.col(f"a_{c}") == F.col(f"b_{c}")) | (F.abs(f"b_{c}") < 1e-9), F.lit(False))
        parts.append(_row("normalization_leak", c, None, F.round(f"b_{c}", 6), F.round(f"a_{c}", 6), bad, F.col("n")))
    return _exploded(a, parts)


def temporal_split_check(train: DataFrame, test: DataFrame, ts: str, group: str) -> DataFrame:
    """Groups whose last training time is not before their first test time."""
    a = train.groupBy(group).agg(F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("a"))
    b = test.groupBy(group).agg(F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("b"), F.count("*").alias("n"))
    return a.join(b, group).select(*_row("temporal_split", ts, F.col(group), F.col("a"), F.col("b"), F.col("a") >= F.col("b"), F.col("n")))


def simpson_check(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Groups whose correlation has the other sign than the whole."""
    whole = df.agg(F.corr(x, y).alias("all"))
    per = df.groupBy(group).agg(F.corr(x, y).alias("own"), F.count("*").alias("n")).crossJoin(F.broadcast(whole))
    return per.select(*_row("simpson", f"{x}~{y}", F.col(group), F.round("own", 6), F.round("all", 6), F.signum("own") * F.signum("all") < 0, F.col("n"), "warning"))


def output_consistency(summary: DataFrame, detail: DataFrame, key: str, count: str) -> DataFrame:
    """Keys whose count in summary is not what detail gives."""
    own = detail.groupBy(key).agg(F.count("*").alias("_n"))
    rows = summary.select(key, F.col(count).alias("_said")).join(own, key, "full")
    said, got = F.coalesce("_said", F.lit(0)), F.coalesce("_n", F.lit(0))
    return rows.select(*_row("output_consistency", count, F.col(key), said, got, said != got, got))


def n_drift(before: DataFrame, after: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Ids lost between two stages without a reason in ledger(key, allowed), and those whose reason is not allowed."""
    lost = before.select(key).join(after.select(key), key, "left_anti").join(ledger.select(key, "allowed"), key, "left")
    a = lost.agg(F.count_if(F.col("allowed").isNull()).alias("unexplained"), F.count_if(~F.col("allowed")).alias("forbidden"), F.count("*").alias("n"))
    return _exploded(a, [_row("n_drift", key, k, F.col(k), F.lit(0), F.col(k) > 0, F.col("n")) for k in ("unexplained", "forbidden")])


def reconcile(data: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    a = data.select(key).distinct().withColumn("_a", F.lit(1))
    b = metadata.select(key).distinct().withColumn("_b", F.lit(1))
    n = a.join(b, key, "full").agg(F.count_if(F.col("_b").isNull()).alias("data_only"), F.count_if(F.col("_a").isNull()).alias("metadata_only"), F.count("*").alias("n"))
    return _exploded(n, [_row("reconcile", key, k, F.col(k), F.lit(0), F.col(k) > 0, F.col("n")) for k in ("data_only", "metadata_only")])


def comparability(inputs: dict[str, DataFrame], column: str) -> DataFrame:
    """Levels of column and in how many of the inputs each stands."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(k).alias("_i"), F.col(column).cast("string").alias("_v")).distinct() for k, df in inputs.items()])
    n = F.countDistinct("_i")
    return rows.groupBy("_v").agg(n.alias("k")).select(*_row("comparability", column, F.col("_v"), F.col("k"), F.lit(len(inputs)), F.col("k") < len(inputs), F.col("k"), "warning"))


def weighted_vs_mean_rate(df: DataFrame, group: str, num: str, den: str, tolerance: float = 0.01) -> DataFrame:
    """Mean of rates against the pooled rate of each group."""
    rate = F.when(F.col(den) != 0, F.col(num) / F.col(den))
    a = df.groupBy(group).agg(F.avg(rate).alias("m"), (F.sum(num) / F.sum(den)).alias("p"), F.count("*").alias("n"))
    return a.select(*_row("weighted_vs_mean", f"{num}/{den}", F.col(group), F.round("m", 6), F.round("p", 6), F.abs(F.col("m") - F.col("p")) > tolerance, F.col("n"), "warning"))


def null_group_keys(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_if(F.col(key).isNull()).alias("k"), F.count("*").alias("n")).select(*_row("null_group_keys", key, None, F.col("k"), F.lit(0), F.col("k") > 0, F.col("n")))


def lookahead_check(df: DataFrame, group: str, order: list[str], value: str, feature: str, window: int, tolerance: float = 1e-6) -> DataFrame:
    """Rows of each group whose rolling feature is not the mean of the window rows before."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(-window, -1)
    own = F.avg(value).over(w)
    bad = ~F.coalesce(F.abs(F.col(feature) - F.col("_own")) <= tolerance, F.col(feature).isNull() & F.col("_own").isNull())
    a = df.withColumn("_own", own).groupBy(group).agg(F.count_if(bad).alias("k"), F.count("*").alias("n"))
    return a.select(*_row("lookahead", feature, F.col(group), F.col("k"), F.lit(0), F.col("k") > 0, F.col("n")))


def value_freshness(registry: DataFrame, recomputed: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """Registered values that differ from recomputed ones, or lack them."""
    rows = registry.select(key, F.col("value").alias("_a")).join(recomputed.select(key, F.col("value").alias("_b")), key, "left")
    bad = ~F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False))
    return rows.select(*_row("value_freshness", "value", F.col(key), F.round("_a", 6), F.round("_b", 6), bad, F.lit(1)))


def half_away(x: Column, digits: int) -> Column:
    """x rounded as a float: of x times a power of ten, halves go away from 0. F.round goes by the decimal digits that print, where 1.005 is a half."""
    return F.round(x * 10.0**digits) / 10.0**digits


def grim_check(df: DataFrame, key: str, mean: str, n: str, digits: int = 2) -> DataFrame:
    """Means of n whole numbers that cannot be: no total rounds to them."""
    total = F.round(F.col(mean) * F.col(n))
    off = F.abs(half_away(total / F.col(n), digits) - half_away(F.col(mean), digits))
    return df.select(*_row("grim", mean, F.col(key), F.round(off, 6), F.lit(0.0), off > 10.0 ** -(digits + 2), F.col(n)))


def excel_damage(df: DataFrame, column: str) -> DataFrame:
    """Names that a spreadsheet has turned to dates or exponents."""
    x = F.col(column)
    date, exp = F.regexp_like(x, F.lit(r"^\d{1,2}-(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)$")), F.regexp_like(x, F.lit(r"^\d(\.\d+)?E\+?\d+$"))
    a = df.agg(F.count_if(date).alias("date"), F.count_if(exp).alias("exponent"), F.count("*").alias("n"))
    return _exploded(a, [_row("excel_damage", column, k, F.col(k), F.lit(0), F.col(k) > 0, F.col("n")) for k in ("date", "exponent")])


#: Gene symbols that spreadsheets take for dates, by family, and the families' names since.
RENAMED_FAMILIES = {"MARCH": ("MARCHF", 11), "SEPT": ("SEPTIN", 14)}
RENAMED_SINGLE = {"DEC1": "DELEC1"}
#: Rows and columns of a worksheet.
SHEET_ROWS, SHEET_COLUMNS = 1_048_576, 16_384


def renamed_symbols(df: DataFrame, column: str) -> DataFrame:
    """symbol, current, n: old symbols in the column, whatever their case, with the names they have now."""
    names = [(f"{old}{k}", f"{new}{k}") for old, (new, most) in RENAMED_FAMILIES.items() for k in range(1, most + 1)] + list(RENAMED_SINGLE.items())
    table = df.sparkSession.createDataFrame(names, "symbol string, current string")  # a few rows
    found = df.groupBy(F.upper(F.trim(column)).alias("symbol")).agg(F.count("*").alias("n"))
    return found.join(F.broadcast(table), "symbol").select("symbol", "current", "n")


def sheet_limits(df: DataFrame, n_columns: int | None = None) -> DataFrame:
    """Whether a table of so many rows (with its heading) and columns fits a worksheet, as it stands and turned on its side. A table that just fills one may have been cut there."""
    width = len(df.columns) if n_columns is None else n_columns
    a = df.agg((F.count("*") + 1).alias("n")).withColumn("w", F.lit(width).cast("long"))
    over = lambda rows, columns: (rows >= SHEET_ROWS) | (columns >= SHEET_COLUMNS)
    n, w = F.col("n"), F.col("w")
    return _exploded(a, [_row("sheet_limits", None, "rows", n, F.lit(SHEET_ROWS), n >= SHEET_ROWS, n), _row("sheet_limits", None, "columns", w, F.lit(SHEET_COLUMNS), w >= SHEET_COLUMNS, n), _row("sheet_limits", None, "either way", F.greatest(n, w), F.lit(SHEET_ROWS), over(n, w) & over(w, n), n)])


def profile(df: DataFrame, columns: list[str], sketch: bool = False) -> DataFrame:
    """column, n, n_null, n_unique, min, max, mean, std, n_outside (beyond 3 SD) of numeric columns; two passes over all of them at once.

    n_unique is exact, from a pass over each column alone, so no row is multiplied by the columns; with sketch it comes
    from the first pass, by a mergeable sketch of bounded size (within some 5 %).
    """
    unique = F.approx_count_distinct if sketch else lambda c: F.lit(None).cast("long")
    stats = df.agg(*(f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("u", unique), ("lo", F.min), ("hi", F.max), ("m", F.avg), ("s", F.stddev_samp))), F.count("*").alias("_all"))
    if not sketch:
        one = lambda c: df.select(F.col(c).cast("double").alias("_v")).filter("_v is not null").groupBy("_v").agg(F.lit(1)).agg(F.count("*").alias("n")).select(F.lit(c).alias("c"), "n")
        counts = reduce(DataFrame.unionByName, map(one, columns)).groupBy().pivot("c", columns).agg(F.first("n"))  # a row
        stats = stats.drop(*(f"u_{c}" for c in columns)).crossJoin(counts.select(*(F.col(f"`{c}`").alias(f"u_{c}") for c in columns)))
    far = df.crossJoin(F.broadcast(stats)).agg(*(F.count_if(F.abs(F.col(c).cast("double") - F.col(f"m_{c}")) > 3 * F.col(f"s_{c}")).alias(f"far_{c}") for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), (F.col("_all") - F.col(f"n_{c}")).alias("n_null"), F.col(f"u_{c}").alias("n_unique"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"), F.round(f"m_{c}", 5).alias("mean"), F.round(f"s_{c}", 5).alias("std"), F.col(f"far_{c}").alias("n_outside")) for c in columns))
    return stats.crossJoin(far).select(F.explode(rows).alias("r")).select("r.*")
