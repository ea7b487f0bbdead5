"""Small cases with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import checks, identity, link, rollup, stats


def one(df):
    return df.collect()[0]


def test_text_functions(spark):
    df = spark.createDataFrame([("# 2024-05-06 D12: A  Title!", "[a, b; c]", "---\nk: v\nx: y: z\n---\nbody", "use #tag-a and #b")], "t string, g string, m string, h string")
    r = one(df.select(T.clean_title(F.col("t")).alias("c"), T.extract_date(F.col("t")).alias("d"), T.parse_tags(F.col("g")).alias("g"), T.frontmatter(F.col("m")).alias("m"), T.hashtags(F.col("h")).alias("h")))
    assert (r.c, r.d, r.g, r.m, r.h) == ("A  Title", "2024-05-06", ["a", "b", "c"], {"k": "v", "x": "y: z"}, ["tag-a", "b"])


def test_term_edges(spark):
    df = spark.createDataFrame([("xété", "t"), ("a t b", "t"), ("rate-limit.", "rate-limit"), ("tt", "t")], "x string, t string")
    assert [r[0] for r in df.select(T.has_term(F.col("x"), F.col("t"))).collect()] == [False, True, True, False]


def test_visible_lines(spark):
    lines = ["a", "```", "b", "~~~", "````", "c", "~~~~", "d", "~~~", "e", "~~~~"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert one(df.select(T.visible_lines(F.col("l")).alias("v"))).v == ["a", "c"]


@pytest.fixture(scope="module")
def registry(spark):
    e = spark.createDataFrame([(1, "p", "alpha and beta"), (2, "q", "alphabet gamma ray"), (3, "p", "beta delta"), (4, "p", None)], "id long, project_id string, text string")
    c = spark.createDataFrame(
        [("one", ["alpha"], ["beta"], [], [], None, "hybrid"), ("two", [], ["beta"], ["delta"], [], None, "keyword"), ("three", ["gamma ray"], [], [], [], ["q"], "alias"), ("four", ["x"], ["beta"], [], ["alpha"], ["p"], "alias")],
        "slug string, aliases array<string>, positive_keywords array<string>, negative_keywords array<string>, required_any array<string>, project_scope array<string>, match_mode string",
    )
    return e, c


def test_link_rules(spark, registry):
    got = {(r.entry, r.slug): (r.trigger, r.confidence) for r in link.link_entries(*registry).collect()}
    assert got == {(1, "one"): ("alpha", "1.00"), (3, "one"): ("beta", "0.50"), (1, "two"): ("beta", "0.50"), (2, "three"): ("gamma ray", "1.00"), (1, "four"): ("alpha", "0.80")}


def test_link_empty(spark, registry):
    e, c = registry
    assert link.link_entries(e.limit(0), c).count() == 0
    assert link.link_entries(e, c.limit(0)).count() == 0


def test_upstream(spark):
    ev = spark.createDataFrame([("s1", ["a"], ["b"]), ("s2", ["b", "c"], ["d"]), ("s3", ["d"], ["a2"]), ("s4", ["z"], ["y"])], "script string, inputs array<string>, outputs array<string>")
    assert {r.path for r in link.upstream(link.lineage_edges(ev), "d").collect()} == {"a", "b", "c"}


def test_upstream_of_any_depth(spark):
    ev = spark.createDataFrame([(f"s{k}", [f"p{k}"], [f"p{k + 1}"]) for k in range(54)], "script string, inputs array<string>, outputs array<string>")
    assert {r.path for r in link.upstream(link.lineage_edges(ev), "p54").collect()} == {f"p{k}" for k in range(54)}


def test_comparability_takes_all_documents(spark, tmp_path):
    from lorespan.plans.checks import comparability

    spark.createDataFrame([(0, "x"), (1, "x"), (3, "only3"), (None, "none")], "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = comparability(spark, str(tmp_path)).collect()
    assert len(got) == 3 and sum("only3" in r.asDict().values() for r in got) == 1


def test_resolve_ids(spark):
    rec = spark.createDataFrame([("f1", None, "h1"), ("f2", None, "h2"), ("f2", None, "h3"), ("f9", "e-00007", "h4")], "fingerprint string, explicit_id string, content_hash string")
    led = spark.createDataFrame([("e-00003", ["f0", "f1"], "h", "active"), ("e-00007", ["f7"], "h", "active"), ("e-00005", ["gone"], "h", "active")], "id string, fingerprints array<string>, content_hash string, status string")
    out, after = identity.resolve_ids(rec, led)
    assert {(r.fingerprint, r.id) for r in out.collect()} == {("f1", "e-00003"), ("f2", "e-00008"), ("f2#2", "e-00009"), ("f9", "e-00007")}
    assert {r.id: r.status for r in after.collect()} == {"e-00003": "active", "e-00007": "active", "e-00005": "tombstone", "e-00008": "active", "e-00009": "active"}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("k1", "a", "mine"), ("k2", "b", "")], "k string, v string, note string")
    upd = spark.createDataFrame([("k1", "z", "theirs"), ("k3", "c", "n")], "k string, v string, note string")
    once = identity.upsert(base, upd, "k", preserve=("note",))
    want = {("k1", "z", "mine"), ("k2", "b", None), ("k3", "c", "n")}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in identity.upsert(once, upd, "k", preserve=("note",)).collect()} == want


def test_namespace(spark):
    df = spark.createDataFrame([("a/analysis/x/analysis/y/f.py",), ("a/b/c.py",)], "p string")
    assert [r[0] for r in df.select(identity.namespace_of(F.col("p"))).collect()] == ["y", None]


def test_global_rank_any_partitioning(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 100).alias("x"))
    for n in (1, 7, 64):
        assert all(r.rank == r.x + 1 for r in identity.global_rank(df.repartition(n), [F.col("x")]).collect())


def test_raise_on(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(checks.CheckFailed):
        checks.raise_on(checks.duplicate_keys(df, ["k"]))
    assert checks.raise_on(checks.duplicate_keys(df.distinct(), ["k"])).count() == 1


def test_manifest_nulls(spark):
    ev = spark.createDataFrame([("s", 2, 1, None, None, None, "b", ["x"], ["o"]), ("s", 1, 0, "abc", 0, None, "a", ["x", "y"], [])], "session string, ts long, seq long, agent string, exit_code int, wall_s double, script string, inputs array<string>, outputs array<string>")
    r = one(rollup.lineage_manifest(ev))
    assert (r.agents, r.total_wall, r.n_unknown, r.n_passed, r.n_inputs, r.n_outputs, r.first_script) == ("abc,main", None, 1, 1, 2, 1, "a")


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.04, 0.03, 0.005, 0.5])], "i long, p double")
    got = [r.bh for r in stats.adjust_pvalues(df, "i", "p").orderBy("i").collect()]
    assert got == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.5])


def test_vector_clusters_need_only_components(spark):
    import numpy as np

    from lorespan.operators import vectors as S

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    m = np.concatenate([c + 0.35 * rng.normal(size=(12, 16)) for c in centres])
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>").repartition(5)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    label = S._average_linkage(unit, 0.3)
    want = {}
    for i, k in enumerate(label.tolist()):
        want.setdefault(k, set()).add(i)
    got = {}
    for r in S.cluster_vectors(df, 0.3, 1).collect():
        got.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_vector_clusters_in_rounds(spark, monkeypatch):
    import numpy as np

    from lorespan.operators import vectors as S

    monkeypatch.setattr(S, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    m = np.concatenate([c + 0.9 * rng.normal(size=(9, 6)) for c in rng.normal(size=(7, 6))])
    m = np.concatenate([m, m[:4], m[:2]])  # equal vectors
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>").repartition(3)
    label = S._average_linkage(m / np.linalg.norm(m, axis=1, keepdims=True), 0.4)
    sizes = np.bincount(label)
    order = sorted(np.flatnonzero(sizes > 1).tolist(), key=lambda k: (-sizes[k], k))  # numbered by size
    assert {(r.id, r.cluster, r.size) for r in S.cluster_vectors(df, 0.4, 2).collect()} == {(i, order.index(k), sizes[k]) for i, k in enumerate(label.tolist()) if sizes[k] > 1}


def test_vector_clusters_of_any_size(spark):
    from lorespan.operators import similarity as S

    df = spark.range(6000).select("id", F.when(F.col("id") < 5500, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    assert {(r.cluster, r.size) for r in S.cluster_vectors(df).select("cluster", "size").distinct().collect()} == {(0, 5500), (1, 500)}


def test_similar_pairs_prefix_is_exact(spark):
    from lorespan.operators import similarity as S

    df = spark.createDataFrame([(1, "alpha beta gamma delta", ["x"]), (2, "alpha beta gamma delta", ["y"]), (3, "alpha beta other words", ["x"]), (4, "", []), (5, None, None)], "id long, text string, tags array<string>")
    got = {(r.a, r.b): round(r.similarity, 4) for r in S.similar_pairs(df).collect()}
    assert got[(1, 2)] == 0.5 and (1, 3) in got and all(4 not in k and 5 not in k for k in got)


def test_cohesion_counts_weak_pairs(spark):
    import itertools

    from lorespan.operators import similarity as S

    rows = [(1, "alpha beta gamma delta", ["x", "y", "z"]), (2, "alpha beta gamma omega", ["X", "y", "z"]), (3, "beta gamma omega sigma", ["y", "z", "w"]), (4, "omega sigma kappa beta", ["z", "w", "v"]), (5, "far other things", ["q"]), (6, "far other things", ["q"]), (7, None, [])]
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>")
    real = {(r.a, r.b): r.similarity for r in S.similar_pairs(df, 1e-9).collect()}
    links = S.similar_pairs(df)
    linked = {(r.a, r.b) for r in links.collect()}
    inside = list(itertools.combinations([1, 2, 3, 4], 2))
    assert {(1, 2), (2, 3), (3, 4)} <= linked and not set(inside) <= linked  # a weak pair lies within
    got = {r.cluster: r for r in S.recurrence_clusters(links, 0.0, df).collect()}
    assert set(got) == {1, 5} and got[1].size == 4 and got[5].cohesion == 1
    assert got[1].cohesion == pytest.approx(sum(real.get(p, 0.0) for p in inside) / 6, abs=1e-6)
    assert got[1].cohesion > sum(real[p] for p in inside if p in linked) / 6 + 0.01


def test_sources(spark, tmp_path):
    from lorespan.sources import trees

    (tmp_path / "p/findings").mkdir(parents=True)
    (tmp_path / "p/.hidden").mkdir()
    (tmp_path / "p/learnings.md").write_text("# L-1\nbody")
    (tmp_path / "p/findings/f.md").write_text("# F\n")
    (tmp_path / "p/_MANIFEST.md").write_text("x")
    (tmp_path / "p/.hidden/a.md").write_text("x")
    (tmp_path / "p/2024-01-02-3-log.md").write_text("y" * 200)
    (tmp_path / "p/2024-01-03-log.md").write_text("short")
    got = {r.name: (r.kind, r["shape"]) for r in trees.scan_entries(spark, str(tmp_path)).collect()}
    assert got["learnings.md"] == ("learning", "register") and got["f.md"] == ("finding", "whole_file")
    assert "_MANIFEST.md" not in got and "a.md" not in got
    assert [(r.date, r.seq) for r in trees.scan_logs(spark, str(tmp_path)).collect()] == [("2024-01-02", 3)]
    log = tmp_path / "e.jsonl"
    log.write_text('{"ts": "t1", "inputs": [{"path": "a"}]}\n\nnot json\n[1]\n{"agent_id": "x"}\n{"ts": "t2"}\n')
    events, warnings = trees.read_lineage_events(spark, str(log))
    assert [(r.ts, r.agent_id, len(r.inputs), r.io_detection) for r in events.orderBy("ts").collect()] == [("t1", "main", 1, "detected"), ("t2", "main", 0, "none")]
    assert sorted(r.warning for r in warnings.collect()) == ["no ts", "not a JSON object", "not a JSON object"]
    declared = spark.createDataFrame([("file:/none",)], "path string")
    files = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256) for r in trees.fingerprint_files(spark, str(tmp_path / "p"), declared, limit=100).collect()}
    assert files["2024-01-02-3-log.md"] == (200, None) and files["none"] == (None, "_missing") and len(files["f.md"][1]) == 64
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.csv").write_text("h,i\n1,2\n3,4\n")
    assert [r.n_rows for r in trees.row_counts(spark, str(tmp_path / "c"), "csv").collect()] == [2]
    lines = spark.createDataFrame([("d", k, x) for k, x in enumerate(["| A | B |", "|---|---|", "| 1 | 2 |", "| ragged |", "text", "| 3 | 4 |"])], "doc string, pos long, line string")
    assert [r.cells for r in trees.parse_pipe_table(lines).orderBy("pos").collect()] == [["1", "2"], ["3", "4"]]
    assert [r.json for r in trees.canonical_json(spark.createDataFrame([(2, None), (1, "x")], "b int, a string")).collect()] == ['{"a":"x","b":1}', '{"a":null,"b":2}']


def test_beyond_sd_judges_before_rounding(spark):
    from lorespan.operators.stats import beyond_sd

    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate((-1, 0, 0, 0, 1))], "id int, v double")
    sd = 0.5**0.5
    assert {r.id for r in beyond_sd(df, "id", "v", 1 / sd - 2e-7).collect()} == {0, 4}  # the bound rounds up to the rounded z
    assert not beyond_sd(df, "id", "v", 1 / sd + 2e-7).collect()


def test_resolve_ids_with_an_id_twice_in_the_ledger(spark):
    ledger = spark.createDataFrame([("e-00001", ["p|1"], "h1", "active"), ("e-00001", ["p|2"], "h2", "active"), ("e-00002", ["p|3"], "h3", "active"), ("e-00002", ["p|4"], "h4", "active")], "id string, fingerprints array<string>, content_hash string, status string")
    records = spark.createDataFrame([("p|9", "e-00001", "h9"), ("p|2", None, "h2")], "fingerprint string, explicit_id string, content_hash string")
    out, after = identity.resolve_ids(records, ledger)
    assert sorted((r.fingerprint, r.id) for r in out.collect()) == [("p|2", "e-00001"), ("p|9", "e-00001")]
    assert sorted((r.id, r.status, sorted(r.fingerprints)) for r in after.collect()) == [("e-00001", "active", ["p|1", "p|2"]), ("e-00002", "tombstone", ["p|3", "p|4"])]


def test_rename_match_at_the_bound_of_unsure(spark):
    old = " ".join(f"w{i}" for i in range(17))
    rows = lambda x: spark.createDataFrame(x, "id int, path string, text string, status string")
    new = rows([(1, "p", old + " a b c", "active"), (2, "q", old + " a b c d", "active")])  # 17 of 20, 17 of 21
    got = identity.rename_match(new, rows([(11, "p", old, "active"), (12, "q", old, "active")]), ["path"]).collect()
    assert sorted((r.new_id, r.old_id, r.unsure) for r in got) == [(1, 11, False), (2, 12, True)]


@pytest.mark.parametrize("few", [0, 2, 16])
def test_rename_match_in_blocks_of_few_rows(spark, monkeypatch, few):
    """Words are counted and stored only for blocks with many rows on both sides; matches are the same by either way, and only the result stays."""
    import os
    import random

    from lorespan.sources import folders

    monkeypatch.setattr(identity, "FEW", few, raising=False)
    names, paths, real = [], [], folders.work_dir
    monkeypatch.setattr(folders, "work_dir", lambda s, name: names.append(name) or paths.append(real(s, name)) or paths[-1])
    rng = random.Random(7)
    texts = [[f"w{rng.randint(0, 60)}" for _ in range(30)] for _ in range(9)]
    text = lambda k: " ".join(w for w in texts[k % 9] if rng.random() < 0.95)
    old = [(k, "many" if k % 4 else f"p{k}", text(k), "active") for k in range(60)] + [(80, "none", " ", "active"), (81, "few", text(1), "gone")]
    new = [(-k, "many" if k % 4 else f"p{k}", text(k)) for k in range(60)] + [(-80, "none", ""), (-81, "few", text(1))]
    got = {(r.new_id, r.old_id): r.jaccard for r in identity.rename_match(spark.createDataFrame(new, "id int, path string, text string"), spark.createDataFrame(old, "id int, path string, text string, status string"), ["path"]).collect()}
    pairs = []
    for a, p, x in new:
        for b, q, y, active in old:
            x_, y_ = {*x.split()}, {*y.split()}
            if p == q and active == "active" and x_ and len(x_ & y_) / len(x_ | y_) >= 0.8:
                pairs.append((-len(x_ & y_) / len(x_ | y_), a, b))
    want = {}
    for j, a, b in sorted(pairs):
        if a not in {k for k, _ in want} and b not in {k for _, k in want}:
            want[a, b] = -j
    assert got == want and len(got) > 20
    assert [p for p in paths if "renames" not in p and os.path.exists(p.removeprefix("file://"))] == []


def test_rename_match_of_single_rows_moves_texts_once(spark, monkeypatch):
    names, real = [], identity.stored
    monkeypatch.setattr(identity, "stored", lambda df, name: names.append(name) or real(df, name))
    old = spark.range(30).selectExpr("id", "id AS path", "concat('a b c d e ', id) AS text", "'active' AS status")
    assert identity.rename_match(old.drop("status").withColumn("id", -F.col("id")), old, ["path"]).count() == 30
    assert not {"renames", "word-counts", "new-words"} & {*names}


def test_upsert_takes_the_first_of_updates_alike(spark):
    base = spark.createDataFrame([("a", "old")], "k string, v string")
    new = spark.createDataFrame([("a", "late", 7, i) for i in range(9, 1, -1)] + [("a", "first", 7, 1), ("a", "early", 6, 0)], "k string, v string, o int, place int")
    assert one(identity.upsert(base, new, "k", order="o", ties=("place",))).v == "first"


def test_means_in_order_and_rounding_as_floats(spark):
    values = [0.1, 0.7, 0.3, 0.2, 0.6, 0.05, 1e16, 1.0, -1e16]
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate(values)] + [("h", None, 0)], "g string, v double, i int").repartition(5)
    total = 0.0
    for v in values:
        total += v
    got = {r.g: (r.n, r.m) for r in stats.means_in_order(df, "g", {"m": "v"}, ("i",)).collect()}
    assert got == {"g": (9, total / 9), "h": (1, None)}
    halves = spark.createDataFrame([(1.005,), (0.125,), (-0.125,), (2.0,)], "x double")
    assert [r[0] for r in halves.select(checks.half_away(F.col("x"), 2)).collect()] == [1.0, 0.13, -0.13, 2.0]
    wrong = spark.createDataFrame([("a", 1.0, 200), ("b", 1.01, 200)], "k string, m double, n int")
    assert [r.severity for r in checks.grim_check(wrong, "k", "m", "n").collect()] == ["ok", "ok"]


def test_poisson_bootstrap_draws_for_each_unit_and_replica(spark):
    import hashlib

    rows = [(u, float(v)) for u in range(40) for v in range(u % 3 + 1)] + [(99, None)]
    want = {}
    for rep in range(20):
        s = c = 0.0
        for u in range(40):
            share = int(hashlib.md5(f"{u}:{rep}".encode()).hexdigest()[:8], 16) / 2**32
            w = sum(share >= x for x in stats.POISSON)
            s, c = s + w * sum(range(u % 3 + 1)), c + w * (u % 3 + 1)
        want[rep] = round(s / c, 6)
    got = {r.replica: r["mean"] for r in stats.poisson_bootstrap(spark.createDataFrame(rows, "u int, v double"), "u", "v", 20).collect()}
    assert got == pytest.approx(want, abs=1.1e-6)


def test_enrichment_pvalues_by_arrays_and_by_rows(spark, monkeypatch):
    from lorespan.operators import domain as D

    ranked = spark.createDataFrame([(i, i + 1) for i in range(60)], "g int, rank long")
    sets = spark.createDataFrame([("low", g) for g in range(0, 24, 3)] + [("all over", g) for g in range(0, 60, 7)], "`set` string, g int")
    scores = D.running_enrichment(ranked, sets, "g")
    got = {r["set"]: r.p for r in D.enrichment_pvalues(ranked, sets, "g", scores, 60).collect()}
    monkeypatch.setattr(D, "SET_ROWS", 8)  # "all over" has 9 members and goes through the window
    assert got == {r["set"]: r.p for r in D.enrichment_pvalues(ranked, sets, "g", scores, 60).collect()}
    assert 0 <= got["low"] < got["all over"] <= 1


def test_tfidf_deals_by_the_length_of_texts(spark, monkeypatch):
    from lorespan.operators import similarity as SIM

    entries = spark.createDataFrame([(i, f"alpha beta w{i} w{i}") for i in range(40)], "id int, text string")
    few = {(r.id, r.term, r.tf, r.df) for r in SIM.tfidf(entries).collect()}
    monkeypatch.setattr(SIM, "PART_CHARS", 40)
    many = SIM.tfidf(entries)
    assert few == {(r.id, r.term, r.tf, r.df) for r in many.collect()}
    length = sum(len(f"alpha beta w{i} w{i}") for i in range(40))
    assert "hashpartitioning(id#" in many._jdf.queryExecution().toString() and f", {-(-length // 40)})" in many._jdf.queryExecution().toString()
