"""Audits of tables, reports and pipelines. Checks of tables return the rows of lorespan.operators.checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.operators.checks import _row
from lorespan.operators.identity import global_rank


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many different rows stand there more than once (nulls are equal), and how many rows these are."""
    n = df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("k"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n"))
    return n.select(*_row("duplicate_rows", None, None, F.col("k"), F.lit(0), F.col("k") > 0, F.col("n")))


def schema_contract(df: DataFrame, contract: dict[str, tuple[str, bool, tuple | None]]) -> DataFrame:
    """Rows for each column of contract (type, may be null, values that it may have or None): whether the type fits, how many nulls where none may be, how many other values. One pass over the table."""
    have = dict(df.dtypes)
    aggs, kinds = [F.count("*").alias("_n")], []
    for k, (c, (kind, nullable, levels)) in enumerate(contract.items()):
        there = c in have
        aggs.append(F.lit(int(have.get(c) == kind)).alias(f"t{k}"))
        kinds.append((c, "type", F.col(f"t{k}"), 1, F.col(f"t{k}") != 1))
        if there and not nullable:
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"z{k}"))
            kinds.append((c, "null", F.col(f"z{k}"), 0, F.col(f"z{k}") > 0))
        if there and levels is not None:
            aggs.append(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*levels)).alias(f"v{k}"))
            kinds.append((c, "level", F.col(f"v{k}"), 0, F.col(f"v{k}") > 0))
    one = df.agg(*aggs)
    rows = [F.struct(*_row("schema_contract", c, what, got, F.lit(want), bad, F.col("_n"))) for c, what, got, want, bad in kinds]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def schema_comparability(inputs: dict[str, DataFrame]) -> DataFrame:
    """Columns with their types and in how many of the inputs each stands; n counts the values there."""
    parts = []
    for df in inputs.values():
        one = df.agg(*(F.count(c).alias(c) for c in df.columns))
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(t).alias("t"), F.col(c).alias("n")) for c, t in df.dtypes))).alias("r")).select("r.*"))
    x = _all(parts).groupBy("c", "t").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    return x.select(*_row("schema_comparability", F.col("c"), F.col("t"), F.col("k"), F.lit(len(inputs)), F.col("k") < len(inputs), F.col("n"), "warning"))


def fingerprint_freshness(declared: DataFrame, current: DataFrame) -> DataFrame:
    """path, problem of declared(path, fingerprint) that current(path, fingerprint) lacks (missing), has by another algorithm (the part before ':'), or has otherwise (stale)."""
    rows = declared.select("path", F.col("fingerprint").alias("a")).join(current.select("path", F.col("fingerprint").alias("b")), "path", "left")
    kind = lambda c: F.substring_index(c, ":", 1)
    problem = F.when(F.col("b").isNull(), "missing").when(kind("a") != kind("b"), "algorithm").when(~F.col("a").eqNullSafe(F.col("b")), "stale")
    return rows.select("path", problem.alias("problem")).filter("problem is not null")


NUMBER = r"(?<![\p{L}\p{N}_.])(\d+(?:\.\d+)?)(?![\p{L}\p{N}_]|\.\d)"


def verify_numbers(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """doc, pos (of the line), number, id, problem: numbers in the lines of texts(doc, text) that registry(id, value, forbidden) lacks (unsourced), or that stand with a label which it forbids (label)."""
    lines = texts.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    numbers = lines.select("doc", "pos", F.lower("line").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(NUMBER), 1))).alias("number"))
    rows = numbers.withColumn("value", F.col("number").try_cast("double")).join(registry.select("id", F.col("value").cast("double").alias("value"), "forbidden"), "value", "left")
    wrong = F.exists(F.coalesce("forbidden", F.array().cast("array<string>")), lambda x: F.contains(F.col("line"), F.lower(x)))
    problem = F.when(F.col("id").isNull(), "unsourced").when(wrong, "label")
    return rows.withColumn("problem", problem).filter("problem is not null").select("doc", "pos", "number", "id", "problem")


def worked_examples(rows: DataFrame, declared: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """subject, problem of declared(subject, n, total) against rows(subject, value): unsourced (no rows), rows (their number), aggregate (their sum)."""
    own = rows.groupBy("subject").agg(F.count("*").alias("_n"), F.sum("value").alias("_t"))
    x = declared.join(own, "subject", "left")
    problem = F.when(F.col("_n").isNull(), "unsourced").when(F.col("_n") != F.col("n"), "rows").when(F.abs(F.col("_t") - F.col("total")) > tolerance, "aggregate")
    return x.select("subject", problem.alias("problem")).filter("problem is not null")


def cross_document_drift(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """doc, id, quoted, registered: places 'id = number' or 'id: number' in docs(doc, text) whose number isn't the one of registry(id, value)."""
    pattern = F.lit(r"([A-Za-z][A-Za-z0-9_]*)\s*[=:]\s*(-?\d+(?:\.\d+)?)")
    both = F.arrays_zip(F.regexp_extract_all("text", pattern, 1).alias("id"), F.regexp_extract_all("text", pattern, 2).alias("quoted"))
    said = docs.select("doc", F.explode(F.array_distinct(both)).alias("s")).select("doc", "s.id", F.col("s.quoted").cast("double").alias("quoted"))
    rows = said.join(registry.select("id", F.col("value").cast("double").alias("registered")), "id")
    return rows.filter(F.col("quoted") != F.col("registered")).select("doc", "id", "quoted", "registered")


Pipeline = Callable[[DataFrame], DataFrame]


def _difference(a: DataFrame, b: DataFrame, digits: int) -> DataFrame:
    """One row with the number of rows that only one side has, numbers rounded, and the rows of a."""
    rounded = lambda df: df.select(*(F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
    x, y = rounded(a), rounded(b)
    n = x.exceptAll(y).unionByName(y.exceptAll(x)).agg(F.count("*").alias("k"))
    return n.crossJoin(a.agg(F.count("*").alias("n")))  # a row each


def label_permutation_invariance(pipeline: Pipeline, df: DataFrame, label: str, ident: str, digits: int = 6) -> DataFrame:
    """Whether the pipeline's result stays when the labels are dealt anew, by the order of a hash of ident: what is blind to labels does not see it."""
    order = F.md5(F.concat(F.col(ident).cast("string"), F.lit(":labels")))
    here = global_rank(df, [F.col(ident)], "_here")
    there = global_rank(df.select(ident, label), [order, F.col(ident)], "_here").select("_here", F.col(label).alias("_other"))
    other = here.join(there, "_here").withColumn(label, F.col("_other")).select(*df.columns)
    return _difference(pipeline(df), pipeline(other), digits).select(*_row("label_permutation", label, None, F.col("k"), F.lit(0), F.col("k") > 0, F.col("n")))


def row_order_invariance(pipeline: Pipeline, df: DataFrame, ident: str, digits: int = 6) -> DataFrame:
    """Whether the pipeline's result stays when the rows come in another order and dealt to other tasks."""
    other = df.repartitionByRange(F.md5(F.col(ident).cast("string"))).sortWithinPartitions(F.md5(F.col(ident).cast("string")))
    return _difference(pipeline(df), pipeline(other), digits).select(*_row("row_order", ident, None, F.col("k"), F.lit(0), F.col("k") > 0, F.col("n")))


def fault_injection(checks: Pipeline, df: DataFrame, key: str) -> DataFrame:
    """For each fault (no rows, the least key's rows dropped, the least key doubled): how many checks other than ok the caller's checks find. None is an error: the fault would pass unseen."""
    least = df.agg(F.min(key).alias("_k"))
    first = df.join(least, F.col(key) == F.col("_k"), "left_semi")
    rest = df.join(least, F.col(key) == F.col("_k"), "left_anti")
    parts = []
    for name, broken in (("empty", df.limit(0)), ("dropped", rest), ("doubled", df.unionByName(first))):
        found = checks(broken).agg(F.count_if(F.col("severity") != "ok").alias("k"), F.count("*").alias("n"))
        parts.append(found.select(*_row("fault_injection", key, name, F.col("k"), F.lit(1), F.col("k") < 1, F.col("n"))))
    return _all(parts)


def known_answer(pipeline: Pipeline, toy: DataFrame, expected: DataFrame, key: str, value: str, rule: str = "equal", tolerance: float = 1e-9) -> DataFrame:
    """The pipeline's value of each key of expected(key, value) on a toy table: equal, or (rule 'sign') of the same sign."""
    rows = expected.select(key, F.col(value).cast("double").alias("_e")).join(pipeline(toy).select(key, F.col(value).cast("double").alias("_g")), key, "left")
    good = F.abs(F.col("_e") - F.col("_g")) <= tolerance if rule == "equal" else F.signum("_e") == F.signum("_g")
    return rows.select(*_row("known_answer", value, F.col(key), F.round("_g", 6), F.round("_e", 6), ~F.coalesce(good, F.lit(False)), F.lit(1)))


def normal_tail(z: Column) -> Column:
    """The two-sided p of a normal z, by a rational approximation that is exact to 1e-6 (7.1.26 of Abramowitz and Stegun)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def statcheck(df: DataFrame, key: str, z: str, p: str, tolerance: float = 0.0005) -> DataFrame:
    """Reported two-sided p against the one that the normal statistic gives. Other statistics need functions that are not at hand."""
    own = normal_tail(F.col(z))
    return df.select(*_row("statcheck", p, F.col(key), F.round(p, 6), F.round(own, 6), F.abs(F.col(p) - own) > tolerance, F.lit(1)))


def interval_check(df: DataFrame, start: str, end: str) -> DataFrame:
    """How many intervals are reversed, are empty (as they may be if half open), and start at 0 (as no 1-based one does)."""
    a = df.agg(F.count_if(F.col(start) > F.col(end)).alias("reversed"), F.count_if(F.col(start) == F.col(end)).alias("empty"), F.count_if(F.col(start) == 0).alias("zero_based"), F.count("*").alias("n"))
    rows = [F.struct(*_row("intervals", f"{start},{end}", k, F.col(k), F.lit(0), F.col(k) > 0, F.col("n"), "error" if k == "reversed" else "warning")) for k in ("reversed", "empty", "zero_based")]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def chromosome(name: Column) -> Column:
    """A chromosome's name without 'chr', and the mitochondrial one as MT."""
    bare = F.regexp_replace(F.trim(name), "(?i)^chr", "")
    return F.when(F.upper(bare).isin("M", "MT"), "MT").otherwise(F.upper(bare))


def to_half_open(start: Column, end: Column, one_based: Column) -> Column:
    """start and end counted from 0, the end excluded, of intervals that are so already or (one_based) count from 1 with both ends."""
    return F.struct((start - one_based.cast("int")).alias("start"), end.alias("end"))


def profile_levels(df: DataFrame, columns: list[str], top: int = 3) -> DataFrame:
    """column, type, n, pct_missing, n_unique, top (the commonest values with their counts), flag (constant, all_missing, many_missing above a half, or none) of columns of any type."""
    kinds = dict(df.dtypes)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).cast("string").alias("value")) for c in columns))).alias("r")).select("r.*")
    counts = long.groupBy("column", "type", "value").agg(F.count("*").alias("k"))
    rank = F.struct((-F.col("k")).alias("o"), F.col("value").alias("v"), F.col("k").alias("k"))
    x = counts.groupBy("column", "type").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("miss"), F.count("value").alias("n_unique"))
    from pyspark.sql import Window as W

    best = counts.filter("value is not null").withColumn("r", F.row_number().over(W.partitionBy("column").orderBy(F.desc("k"), "value"))).filter(F.col("r") <= top)
    best = best.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(rank)), lambda s: F.concat(s["v"], F.lit("="), s["k"].cast("string"))), "; ").alias("top"))
    share = F.round(100 * F.col("miss") / F.col("n"), 4)
    flag = F.when(F.col("n_unique") == 0, "all_missing").when(share > 50, "many_missing").when(F.col("n_unique") == 1, "constant").otherwise("none")
    return x.join(best, "column", "left").select("column", "type", "n", share.alias("pct_missing"), "n_unique", F.coalesce("top", F.lit("")).alias("top"), flag.alias("flag"))
