"""Corpus, audits and others: small cases with answers worked out by hand, and brute force where SQL has no say."""

import itertools

import pytest
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import audits, checks, identity, rollup, segment, similarity, stats


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_living_folders(spark, tmp_path):
    from lorespan.sources import trees

    def put(path, text="x"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    for p in ("learnings.md", "decisions.md", "other.md", "INDEX.md", "log/2024-01-01-1-a.md", "learnings/one.md", "findings/F.md", "findings/FINDINGS_REGISTRY.md", "generated-conventions/c.md", "deep/conventions.md", "X_MANIFEST.md", "learnings/.living/inner.md"):
        put(f"fam/p1/.living/{p}")
    put("p2/.living/findings.md")
    put("p2/readme.md")
    put(".cache/deep/p3/.living/decisions.md")
    put(".cache/readme.md")
    put("p2/.living/.draft/learnings/x.md")
    (tmp_path / "p2/loop").symlink_to(tmp_path)
    (tmp_path / "empty").mkdir()
    (tmp_path / "p2/.living/learnings").mkdir()
    (tmp_path / "p2/.living/learnings/odd.md").write_bytes(b"a\xff")
    got = {(r.project, r.rel): (r.kind, r["shape"]) for r in trees.scan_entries(spark, str(tmp_path)).collect() if r.project}
    assert got == {
        ("fam/p1", "learnings.md"): ("learning", "aggregate_section"), ("fam/p1", "decisions.md"): ("decision", "aggregate_section"), ("fam/p1", "learnings/one.md"): ("learning", "per_entry_file"),
        ("fam/p1", "findings/F.md"): ("finding", "standalone_finding_file"), ("fam/p1", "deep/conventions.md"): ("convention", "aggregate_section"), ("p2", "findings.md"): ("finding", "aggregate_section"),
        (".cache/deep/p3", "decisions.md"): ("decision", "aggregate_section"), ("p2", "learnings/odd.md"): ("learning", "per_entry_file"),
    }
    plain = {(r.rel, r.path, r.text) for r in trees.scan_entries(spark, f"file://{tmp_path}", str(tmp_path / "empty")).collect() if not r.project}
    assert plain == {("p2/readme.md", f"file://{tmp_path}/p2/readme.md", "x")}
    assert trees.tree_files(spark, str(tmp_path / "empty")).count() == 0 and trees.scan_entries(spark, str(tmp_path / "empty")).count() == 0


def test_registers(spark):
    text = "# Top\n### [2024-01-02] First: a\nbody\n**Tags**: [x, y]\n**Tags**: z\n\n## [2023-05-06] Old one\n<!-- mitigation_type: structural -->\n> mitigation_type: *Ambient*\n### Second\n## No date\ntail\n"
    df = spark.createDataFrame([("r", text)], "id string, text string")
    got = {r.entry: (r.title, r.date, r.tags, r.line_no, r.mitigation) for r in segment.collect_with_legacy(df).collect()}
    assert got == {"L-1": ("First: a", "2024-01-02", ["x", "y"], 2, "ambient-awareness"), "L-2": ("Second", None, [], 10, "unknown"), "L-legacy-7": ("Old one", "2023-05-06", [], 7, "ambient-awareness")}


def test_whole_files(spark):
    docs = [(1, "p/a.md", "---\ntitle: x\nDate: 2024-02-03\n---\ntext\n## [2024-01-01] L-9 — The Title:\nTags: a; **b**\n"), (2, "p/plain-name.md", "no heading"), (3, "p/e.md", "")]
    got = {r.id: (r.title, r.date, r.tags, r.line_end) for r in segment.whole_file_entries(spark.createDataFrame(docs, "id int, path string, text string")).collect()}
    assert got == {1: ("The Title", "2024-02-03", ["a", "b"], 7), 2: ("plain-name", None, [], 1), 3: ("e", None, [], 0)}


def test_findings(spark):
    text = "| 2020-01-01 | before |\n## F-002: x\n**Claim:** first\n**Claim:**  second \n**Status:** Robust (n=3)\n| 2024-09-09 | not in a ledger |\n### Evidence Ledger\n| 2024-03-01 | a |\n| 2024-02-01 | b |\n### Open Questions\n- one\n  - two\n---\n- three\n## F-10\n"
    df = spark.createDataFrame([("t", text)], "id string, text string")
    got = {r.finding: (r.number, r.claim, r.status, r.last_evidence, r.newest_evidence) for r in segment.findings_registry(df).collect()}
    assert got == {"F-002": (2, "second", "robust", "2024-02-01", "2024-03-01"), "F-10": (10, "(no claim)", "preliminary", None, None)}
    r = segment.finding_counts(df).collect()[0]
    assert (r.n_findings, r.n_open, r.strongest) == (2, 2, "robust")


def test_stages_and_templates(spark):
    df = spark.createDataFrame([("a/Docs/Plans/x.md", "figure", []), ("n.md", "about kappa", []), ("n.md", "t", ["LLM"]), ("n.md", "t", [])], "p string, t string, g array<string>")
    got = [(r[0], r[1]) for r in df.select(T.stage_of(F.col("p"), F.col("t"), F.col("g")).alias("s")).select("s.*").collect()]
    assert got == [("planning", "path"), ("evaluation", "keyword"), ("analysis", "keyword"), ("unassigned", "default")]
    df = spark.createDataFrame([("My template", ""), ("x", "on YYYY-MM-DD"), ("x", "a <placeholder>"), ("x", "a placeholder")], "h string, b string")
    assert [r[0] for r in df.select(T.is_template(F.col("h"), F.col("b"))).collect()] == [True, True, True, False]


def test_values_and_macros(spark):
    df = spark.createDataFrame([("ns.a_rate_12", 0.978), ("x:F1w2_CI", 0.5)], "i string, v double")
    got = df.select(T.macro_name(F.col("i")), T.format_value(F.col("v"), F.lit("percent")), T.format_value(F.col("v"), F.lit("percent"), F.lit(0)), T.format_value(F.col("v")), T.format_value(F.col("v"), F.lit("kg")), T.format_value(F.col("v"), None, None, F.lit("~1"))).collect()
    assert [tuple(r) for r in got] == [("ARateOneTwo", "97.8%", "98%", "0.978", None, "~1"), ("FOnewTwoCI", "50.0%", "50%", "0.5", None, "~1")]


def test_nfc_fold(spark):
    df = spark.createDataFrame([("École  STRASSE ß ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.nfc_fold(F.col("t"))).collect()] == ["école strasse ss", None]


def test_script_scan_and_commands(spark):
    src = "a = pd.read_csv('x.csv')\nb = pd.read_csv('x.csv', sep=';')\nc = pd.read_csv(f)\na.to_parquet( \"o.parquet\" )\nnp.random.seed(3)\nd = df[df.q > 1]"
    r = segment.scan_source_io(spark.createDataFrame([("s", src)], "script string, source string")).collect()[0]
    assert (r.inputs, r.outputs, r.filters, r.seeds) == (["x.csv"], ["o.parquet"], ["df[df.q > 1]"], [3])
    cmds = {"python a.py": ("python_script", "a.py"), "python -m pip install x": (None, None), "./venv/bin/python3 -u run/b.py": ("python_script", "run/b.py"), "mypython c.py": (None, None), "Rscript x/fit.R": ("r_script", "x/fit.R"), 'python -c "print(1)"': ("python_inline", None), "echo hi": (None, None)}
    got = {r.command: (r.kind, r.target) for r in segment.classify_invocation(spark.createDataFrame([(c,) for c in cmds], "command string")).collect()}
    assert got == cmds


def test_commands_with_quotes_comments_and_several_programs(spark):
    long = 'python -c "' + 'x=\\"1\\"\n' * 20_000 + '"; python ok.py'
    cmds = {
        "echo 'python a.py'": [], "# python a.py\npython b.py": ["b.py"], "python 'my dir/a b.py' && Rscript f.R": ["my dir/a b.py", "f.R"], "python a.py 'open": [], 'python a.py "open': [], "python a.py \\": [],
        "for f in *; do python a.py; done": [], "cat <<EOF\npython a.py\nEOF": [], "FOO=1 env B=2 time python -u a.py": ["a.py"], "python run.py#1.py x # python z.py": ["run.py#1.py"], "echo a#b; python c.py": ["c.py"],
        "R --no-save -e 'x; python y.py'": [None], 'python -c "a=\'x; python b.py\' # \\" " && python d.py': [None, "d.py"], "(python e.py)": ["e.py"], "python a.py > o 2>&1": ["a.py"], "pyth\\on z.py": ["z.py"],
        "python \\\n  a.py": ["a.py"], "env": [], "python": [], "": [], None: [], long: [None, "ok.py"], "'" * 99_999: [],
    }
    got = {r.command: [p.target for p in r.programs] for r in segment.classify_invocation(spark.createDataFrame([(c,) for c in cmds], "command string")).collect()}
    assert got == cmds


def test_rename_match_is_greedy_and_one_to_one(spark):
    base = [f"w{k}" for k in range(40)]
    change = lambda *at: " ".join("new" + w if k in at else w for k, w in enumerate(base))
    old = [(1, "p", change(), "active"), (2, "p", change(0), "active"), (3, "p", change(), "tombstone"), (4, "q", change(), "active"), (5, None, change(), "active")]
    new = [(11, "p", change()), (12, "p", change()), (13, "p", change(1, 2, 3, 4)), (14, "r", change()), (15, None, change(7))]
    o = spark.createDataFrame(old, "id long, path string, text string, status string")
    n = spark.createDataFrame(new, "id long, path string, text string")
    got = identity.rename_match(n, o, ["path"])

    def jac(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b)

    pairs = sorted((-jac(x[2], y[2]), x[0], y[0]) for x in new for y in old if y[3] == "active" and x[1] == y[1] and jac(x[2], y[2]) >= 0.8)
    want, used = [], set()
    for j, x, y in pairs:
        if x not in used and -y not in used:
            want.append((x, y))
            used |= {x, -y}
    assert rows(got, "new_id", "old_id") == sorted(want) and len(want) == 3


def test_attach_commits_by_place(spark):
    from lorespan.operators import link

    commits = [(k, f"2024-01-{1 + k // 4:02d} {k % 4:02d}:00:00", "Fix it" if k % 3 else "other") for k in range(60)]
    clusters = [("a", "2024-01-02 01:00:00", "2024-01-03 00:00:00"), ("b", "2024-01-14 00:00:00", "2024-02-01 00:00:00"), ("c", "2024-01-02 01:00:00", "2024-01-02 01:30:00"), ("d", "2025-01-01 00:00:00", "2025-01-02 00:00:00")]
    c = spark.createDataFrame(commits, "commit long, ts string, message string").withColumn("ts", F.to_timestamp("ts"))
    k = spark.createDataFrame(clusters, "cluster string, first string, last string").withColumn("first", F.to_timestamp("first")).withColumn("last", F.to_timestamp("last"))
    want = []
    for name, a, b in clusters:
        hits = [i for i, t, m in commits if m == "Fix it" and a <= t <= b][:5]
        want += [(name, i, r) for r, i in enumerate(hits, 1)]
    assert rows(link.attach_commits(k, c), "cluster", "commit", "rank") == sorted(want)


def test_permutation_takes_the_k_least_hashes(spark):
    import hashlib

    vals = {u: (u * 37 % 11) + (3 if u % 4 == 0 else 0) for u in range(30)}
    df = spark.createDataFrame([(u, float(v)) for u, v in vals.items() for _ in range(2)], "u long, v double")
    r = stats.permutation_test(df, "u", "v", F.col("u") % 4 == 0, 50).collect()[0]
    k = sum(u % 4 == 0 for u in vals)
    mean = lambda us: sum(vals[u] for u in us) / len(us)
    diff = lambda us: mean(us) - mean([u for u in vals if u not in us])
    obs = diff([u for u in vals if u % 4 == 0])
    place = {u: int(hashlib.md5(str(u).encode()).hexdigest()[:13], 16) % stats.PRIME for u in vals}

    def order(u, rep):
        a, b, c, d = stats.coefficients("perm", rep)
        return (((a * place[u] + b) * place[u] + c) * place[u] + d) % stats.PRIME, u

    null = [diff(sorted(vals, key=lambda u: order(u, rep))[:k]) for rep in range(50)]  # noqa: B023
    assert (r.observed, r.p_value, r.n) == (pytest.approx(obs, abs=1e-6), pytest.approx(sum(abs(d) >= abs(obs) - 1e-12 for d in null) / 50), 50)


def test_medians(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 1.0), (None, 7.0), ("c", None)], "g string, v double")
    assert {r.g: (r["median"], r.n) for r in stats.medians(df, ["g"], "v").collect()} == {"a": (2.0, 3), "b": (2.5, 2), None: (7.0, 1)}


def test_similar_pairs_with_hot_tags(spark):
    """A tag and a term that all entries have make no pairs by themselves; what is similar is found all the same."""
    texts = ["common alpha beta", "common alpha beta gamma", "common delta", "common omega psi", "common omega psi", "common"]
    tags = [["hot", "t1"], ["HOT", "t1"], ["hot", "t2"], ["hot"], ["hot", "t3", "t4"], []]
    df = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(zip(texts, tags, strict=True))], "id long, text string, tags array<string>")
    every = similarity.similar_pairs(df, 1e-9).collect()
    want = {(r.a, r.b): round(r.similarity, 9) for r in every if r.similarity >= 0.45}
    assert {(r.a, r.b): round(r.similarity, 9) for r in similarity.similar_pairs(df).collect()} == want and want
    for a, b in itertools.combinations(range(6), 2):
        x, y = ({t.lower() for t in tags[k]} for k in (a, b))
        got = [r.jaccard for r in every if (r.a, r.b) == (a, b)]
        assert not got or got[0] == pytest.approx(len(x & y) / len(x | y) if x | y else 0)


def test_label_invariance_sees_labels(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], float(k)) for k in range(40)], "id long, l string, v double")
    blind = audits.label_permutation_invariance(lambda d: d.agg(F.avg("v").alias("m")), df, "l", "id")
    seen = audits.label_permutation_invariance(lambda d: d.groupBy("l").agg(F.avg("v").alias("m")), df, "l", "id")
    assert blind.collect()[0].severity == "ok" and seen.collect()[0].severity == "error"
    assert audits.row_order_invariance(lambda d: d.groupBy("l").agg(F.sum("v").alias("s")), df, "id").collect()[0].severity == "ok"


def test_faults_that_pass_unseen(spark):
    df = spark.range(5).withColumnRenamed("id", "k")
    got = {r.group: r.severity for r in audits.fault_injection(lambda d: checks.duplicate_keys(d, ["k"]), df, "k").collect()}
    assert got == {"empty": "error", "dropped": "error", "doubled": "ok"}


def test_actions_and_manifest_order(spark):
    m = spark.createDataFrame([(1, "structural"), (1, "structural"), (2, "convention"), (2, "ambient-awareness"), (3, "structural"), (3, "ambient-awareness"), (4, "unknown")], "cluster int, mitigation string")
    assert {r.cluster: r.action for r in similarity.suggest_action(m).collect()} == {1: "all_structural", 2: "promote_ambient", 3: "check_cover", 4: "review"}
    ev = spark.createDataFrame([("s", 2, 1, None, 0, 1.0, "b", ["x", "z"], ["o"]), ("s", 1, 0, None, 0, 1.0, "a", ["y", "x", "y"], None)], "session string, ts long, seq long, agent string, exit_code int, wall_s double, script string, inputs array<string>, outputs array<string>")
    r = rollup.lineage_manifest(ev).collect()[0]
    assert (r.inputs, r.outputs, r.scripts) == (["y", "x", "z"], ["o"], ["a", "b"])


def test_debounce_keeps_its_state(spark, tmp_path):
    """Two runs over two files: the second one knows how the first one ended."""
    from lorespan.streaming import jobs as J

    def put(rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put([(1, "2024-01-01 00:00:00", 1, "view", 1.0, ""), (2, "2024-01-01 00:01:00", 1, "purchase", 1.0, ""), (3, "2024-01-01 00:02:00", 2, "view", 1.0, "")])
    J.stream_debounce(J.stream_events(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out").awaitTermination()
    put([(4, "2024-01-01 01:00:00", 1, "view", 1.0, ""), (5, "2024-01-01 01:01:00", 1, "view", 1.0, ""), (6, "2024-01-01 01:02:00", 2, "view", 1.0, ""), (7, "2024-01-01 01:02:00", 3, "view", 1.0, "")])
    J.stream_debounce(J.stream_events(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out/rows"), "event_id") == [(1,), (3,), (4,), (7,)]
    # a third run, eight days on: user 2's cycle is over by quiet, user 3's new event is too early to open one; nulls and ties
    put([(10, "2024-01-09 02:00:00", 2, "view", 1.0, ""), (9, "2024-01-09 02:00:00", 2, "purchase", 1.0, ""), (11, "2024-01-08 01:02:00", 3, None, 1.0, ""), (12, "2024-01-09 03:00:00", None, "view", 1.0, "")])
    J.stream_debounce(J.stream_events(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out/rows"), "event_id") == [(1,), (3,), (4,), (7,), (9,), (10,)]
    # by now user 1 has been quiet for longer than a cycle lasts, and the watermark says so: only open cycles have state
    state = spark.read.format("statestore").option("operatorId", "0").option("stateVarName", "last").load(f"{tmp_path}/out/_checkpoint-rows")
    assert {r["key"][0] for r in state.collect()} == {2, 3}


def test_activity_once_in_a_session(spark, tmp_path):
    """Across runs a kind of event counts once for a user and day; a day that the watermark has passed has no state left."""
    from lorespan.streaming import jobs as J

    def run(rows):
        df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        J.stream_activity_distinct(J.stream_events(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out").awaitTermination()

    run([(1, "2024-01-01 10:00:00", 1, "view", 1.0, ""), (2, "2024-01-01 11:00:00", 1, "view", 1.0, ""), (3, "2024-01-01 11:00:00", 1, None, 1.0, "")])
    run([(4, "2024-01-01 12:00:00", 1, "view", 1.0, ""), (5, "2024-01-02 12:00:00", 1, "view", 1.0, "")])
    run([(6, "2024-01-05 12:00:00", 2, "click", 1.0, "")])
    got = sorted((r.user_id, str(r.day), str(r.event_type)) for r in spark.read.parquet(f"{tmp_path}/out/rows").collect())
    assert got == [(1, "2024-01-01", "None"), (1, "2024-01-01", "view"), (1, "2024-01-02", "view"), (2, "2024-01-05", "click")]
    state = spark.read.format("statestore").load(f"{tmp_path}/out/_checkpoint-rows")
    assert state.count() == 1
