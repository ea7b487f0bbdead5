"""Tails against closed forms and known values, and rules of small tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from lorespan.operators import checks, rollup, tails


def p(kind, v, one=0, two=0):
    v = np.asarray(v, float)
    full = lambda x: np.full(len(v), x, float)
    return tails.tail_values(np.full(len(v), kind, object), v, full(one), full(two))


def test_tails_against_closed_forms():
    v = np.array([0.0, 1e-6, 0.5, 1, 2, 3.9, 10, 60])
    for got, want in (
        (p("t", v, 1), 1 - 2 / math.pi * np.arctan(v)), (p("t", v, 2), 1 - v / np.sqrt(2 + v * v)), (p("t", -v, 2), 1 - v / np.sqrt(2 + v * v)), (p("chi2", v, 2), np.exp(-v / 2)),
        (p("chi2", v, 4), np.exp(-v / 2) * (1 + v / 2)), (p("F", v, 2, 9), (1 + 2 * v / 9) ** -4.5), (p("r", v[:4], 2), 1 - v[:4]), (p("z", v, 0), np.array([math.erfc(x / math.sqrt(2)) for x in v])),
        (p("F", v * v, 1, 7), p("t", v, 7)), (p("chi2", v * v, 1), p("z", v)),
    ):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_tails_of_many_degrees_of_freedom():
    assert np.allclose(p("t", [1.96], 1e6), p("z", [1.96]), atol=1e-5)
    known = ((p("t", [2.228], 10), 0.05), (p("chi2", [124.342], 100), 0.05), (p("F", [3.4928], 2, 20), 0.05), (p("chi2", [18.307], 10), 0.05), (p("r", [0.576], 10), 0.05))
    assert all(abs(a[0] - b) < 1e-4 for a, b in known)


def test_statistics_that_cannot_be(spark):
    rows = [("a", "t", 2.0, 0.0, None, 0.5), ("b", "F", -1.0, 2.0, 3.0, 0.5), ("c", "r", 1.5, 3.0, None, 0.5), ("d", "odd", 1.0, 1.0, 1.0, 0.5), ("e", "t", None, 2.0, None, 0.5), ("f", "t", float("nan"), 2.0, None, 0.5), ("g", None, 1.0, 1.0, 1.0, 0.5), ("h", "t", 0.0, 3.0, None, 1.0), ("i", "z", 1.96, None, None, None)]
    df = spark.createDataFrame(rows, "id string, kind string, v double, one double, two double, p double")
    got = {r.group: (r.expected, r.severity) for r in tails.statistic_check(df, "id", "kind", "v", "one", "two", "p").collect()}
    assert got.pop("h") == (1.0, "ok") and got.pop("i") == (0.049996, "error")
    assert got == {k: (None, "error") for k in "abcdefg"}
    assert tails.statistic_check(df.limit(0), "id", "kind", "v", "one", "two", "p").count() == 0


def test_profile_counts_exactly_and_by_sketch(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("a"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("b"))
    exact = {r.column: r.n_unique for r in checks.profile(df, ["a", "b"]).collect()}
    assert exact == {"a": 700, "b": 1000}
    assert all(abs(r.n_unique - exact[r.column]) < 0.15 * exact[r.column] for r in checks.profile(df, ["a", "b"], sketch=True).collect())
    assert {r.column: (r.n, r.n_unique) for r in checks.profile(df.limit(0), ["a", "b"]).collect()} == {"a": (0, 0), "b": (0, 0)}


def test_manifest_names_inline_scripts_and_keeps_first_places(spark):
    t = "2024-01-01 00:00:0"
    rows = [("s", t + "2", 1, "a", 0, 1.0, None, ["y", "x"], [], "ab" * 20), ("s", t + "1", 2, None, 1, None, "run.py", ["x"], ["o"], None), ("s", t + "3", 3, "a", None, 2.0, None, None, ["o", "p"], "ab" * 20), ("q", t + "1", 1, "a", 0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "session string, ts string, seq int, agent string, exit_code int, wall_s double, script string, inputs array<string>, outputs array<string>, script_sha256 string")
    got = {r.session: r for r in rollup.lineage_manifest(df).collect()}
    assert got["s"].scripts == ["run.py", "(inline abababababab)"] and got["s"].inputs == ["x", "y"] and got["s"].outputs == ["o", "p"]
    assert (got["s"].n_inputs, got["q"].n_inputs, got["q"].scripts) == (2, 0, [])
