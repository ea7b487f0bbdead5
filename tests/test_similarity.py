"""Similar pairs, vectors and neighbours against brute force, on odd numbers, ties, long lists and crowded places."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespan.operators import blocks, cosine, domain, similarity, vectors
from lorespan.sources import folders


def entries(spark, seed, n, sizes):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(60)]
    out = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))
        if out and rng.random() < 0.3:
            text = rng.choice(out)[1] + " " + rng.choice(words)
        out.append((i * 3, text, rng.sample(["a", "B", "c", "d", "e", "f", "g"], rng.choice(sizes)) if rng.random() < 0.9 else None))
    return spark.createDataFrame(out, "id long, text string, tags array<string>"), out


def brute_pairs(rows, threshold):
    tf = {i: Counter(w for w in t.split()) for i, t, _ in rows}
    df = Counter(w for c in tf.values() for w in c)
    n = len(rows)
    vec = {i: {w: k * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items()} for i, c in tf.items()}
    tags = {i: {t.lower() for t in g or []} for i, _, g in rows}
    out = {}
    for a in vec:
        for b in vec:
            if a < b:
                na, nb = (math.sqrt(sum(x * x for x in vec[i].values())) for i in (a, b))
                cos = sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) / (na * nb) if na and nb else 0.0
                all_ = len(tags[a] | tags[b])
                sim = ((len(tags[a] & tags[b]) / all_ if all_ else 0.0) + cos) / 2
                if sim >= threshold:
                    out[a, b] = round(sim, 7)
    return out


@pytest.mark.parametrize(("threshold", "sizes", "rows"), [(0.45, [4], 2_000), (0.3, [0, 1, 3], 7), (0.65, [2, 5], 3)])
def test_similar_pairs(spark, monkeypatch, threshold, sizes, rows):
    monkeypatch.setattr(cosine, "LIST_ROWS", rows)
    monkeypatch.setattr(cosine, "BLOCK_TERMS", 300)
    df, given = entries(spark, rows, 90, sizes)
    got = {(r.a, r.b): round(r.similarity, 7) for r in similarity.similar_pairs(df, threshold).collect()}
    assert got == brute_pairs(given, threshold) and got
    assert similarity.similar_pairs(df.limit(0), threshold).count() == 0


def test_cosine_pairs_with_a_term_that_all_have(spark, monkeypatch):
    monkeypatch.setattr(cosine, "LIST_ROWS", 4)
    rng = np.random.default_rng(2)
    m = rng.random((40, 12)) * (rng.random((40, 12)) < 0.5)
    m[:, 0] = 1
    m[7] = m[8]
    df = (m > 0).sum(axis=0)
    rows = [(f"n{i:02d}", f"t{k}", int(df[k]), float(m[i, k])) for i in range(40) for k in range(12) if m[i, k]]
    w = spark.createDataFrame(rows, "id string, term string, df long, weight double")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for least in (0.5, 0.8, 0.999):
        got = {(r.a, r.b): round(r.cosine, 9) for r in cosine.cosine_pairs(w, least).collect()}
        assert got == {(f"n{a:02d}", f"n{b:02d}"): round(float(u[a] @ u[b]), 9) for a in range(40) for b in range(a + 1, 40) if u[a] @ u[b] >= least}


def test_a_tag_and_terms_of_all_entries_make_no_candidates(spark):
    """Entries that share common tags and common terms only are hardly ever candidates."""
    rng = random.Random(4)
    rows = [(i, "the and of " + " ".join(f"own{i}word{chr(97 + k)}" for k in range(20)), ["all", f"t{i}", f"s{rng.randint(0, 5)}"]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>")
    own = cosine.unit_vectors(similarity.tfidf(df)).select(F.col("h").alias("key"), F.col("id").alias("num"), "u", "after", F.array().cast("array<long>").alias("tags"))
    assert cosine.candidates(own, 0.7).count() == 0
    assert similarity.similar_pairs(df).count() == 0


def test_stored_tables_go(spark, tmp_path, monkeypatch):
    """After a query only its result is left, and with a scope around it nothing; a scope that fails leaves nothing either."""
    monkeypatch.setattr(folders, "work_dir", lambda s, name, n=iter(range(10**6)): f"file://{tmp_path}/{name}-{next(n)}")
    df, _ = entries(spark, 1, 30, [3])
    out = similarity.similar_pairs(df)
    assert [x.split("-")[0] for x in os.listdir(tmp_path)] == ["similar"] and out.count() >= 0
    with folders.tables(spark):
        similarity.band_clusters(df).count()
    with pytest.raises(ZeroDivisionError), folders.tables(spark):
        folders.stored(df, "x")
        _ = 1 / 0
    assert len(os.listdir(tmp_path)) == 1


ODD = [None, [], [1.0, None], [1.0, float("nan")], [float("inf"), 0.0]]


def test_vectors_with_odd_numbers(spark):
    """Null, NaN and infinite vectors take no part and change nothing for others; zeros are far from all."""
    rows = [(k, [math.cos(k / 10), math.sin(k / 10)]) for k in range(12)] + [(50, [0.0, 0.0])]
    good = spark.createDataFrame(rows, "id long, embedding array<double>")
    bad = good.unionByName(spark.createDataFrame([(100 + k, v) for k, v in enumerate(ODD) if v != []], "id long, embedding array<double>"))
    for call in (lambda d: vectors.vector_pairs(d, 0.2), lambda d: vectors.cluster_vectors(d, 0.3, 2), lambda d: vectors.knn_predict(d.withColumn("label", F.col("id") % 2), d, 3)):
        want, got = (Counter(map(tuple, call(d).collect())) for d in (good, bad))
        assert got == want and want
        assert call(good.limit(0)).count() == 0
    assert vectors.vector_pairs(bad, 0.5).filter("a = 50 or b = 50").count() == 0


def _vectors(seed, n, dim=5, spread=0.4):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(6, dim))[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    m[1], m[2] = m[0], 2 * m[0]
    return m


def test_vector_pairs_and_votes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 15)
    monkeypatch.setattr(vectors, "pivots_of", lambda v: [list(r[0]) for r in v.orderBy("id").limit(6).select("embedding").collect()])
    m = _vectors(3, 160)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(m)], "id long, embedding array<double>, label int")
    d = 1 - u @ u.T
    got = {(r.a, r.b): round(r.distance, 9) for r in vectors.vector_pairs(df, 0.1).collect()}
    assert got == {(a, b): round(float(d[a, b]), 9) for a in range(160) for b in range(a + 1, 160) if d[a, b] < 0.1}
    x = vectors.skipped(df, 0.1).collect()[0]
    assert x.blocks > 6 and x.met < x.pairs
    train, test = df.filter("id % 4 <> 0"), df.filter("id % 4 = 0")
    want = {}
    for t in range(0, 160, 4):
        near = sorted((-round(float(u[t] @ u[j]), 9), j) for j in range(160) if j % 4)[:7]
        votes = Counter(j % 3 for _, j in near)
        want[t] = min(votes, key=lambda c: (-votes[c], c))
    assert {r.id: r.predicted for r in vectors.knn_predict(train, test, 7).collect()} == want


def test_vector_clusters_keep_neighbours(spark, monkeypatch):
    """Rounds that seek only lost neighbours give the clusters of merging the closest pair first, numbered by size."""
    m = _vectors(8, 120, 6, 0.5)
    df = spark.createDataFrame([(5 * i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    label = vectors._average_linkage(m / np.linalg.norm(m, axis=1, keepdims=True), 0.35)
    size = Counter(label.tolist())
    order = sorted((k for k in size if size[k] > 1), key=lambda k: (-size[k], k))
    want = {(5 * i, order.index(k), size[k]) for i, k in enumerate(label.tolist()) if size[k] > 1}
    assert {(r.id, r.cluster, r.size) for r in vectors.cluster_vectors(df, 0.35, 2).collect()} == want
    sought, real = [], vectors.nearest_clusters
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "nearest_clusters", lambda a, b, t: sought.append((a.count(), b.count())) or real(a, b, t))
    assert {(r.id, r.cluster, r.size) for r in vectors.cluster_vectors(df, 0.35, 2).collect()} == want
    assert all(a < b for a, b in sought[1:]) and sought[-1][1] < sought[0][1]


def test_the_last_clusters_link_in_one_task(spark, monkeypatch):
    """Some 10,000 clusters are no matter of many jobs: one task links them in rounds, as merging the closest pair first does."""
    m = _vectors(9, 900, 6, 0.5)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    u = u[np.sort(np.unique(u, axis=0, return_index=True)[1])]
    want = vectors._average_linkage(u, 0.3)
    assert len(set(want)) < 300
    assert (vectors._in_rounds(u, np.ones(len(u)), 0.3, 40) == want).all()
    grid = np.array([[math.cos(k), math.sin(k)] for k in np.arange(24) * math.pi / 12])  # ties all around
    assert len(set(vectors._in_rounds(grid, np.ones(24), 0.2, 3).tolist())) < 24
    monkeypatch.setattr(vectors, "nearest_clusters", lambda *_: 1 / 0)
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(_vectors(2, 2_500, 4, 0.3))], "id long, embedding array<double>")
    assert vectors.cluster_vectors(df, 0.2, 2).count() > 2_000


def brute_neighbors(points):
    best = {}
    for i, p, x, y in points:
        near = [(math.sqrt((x - u) ** 2 + (y - v) ** 2), q) for j, q, u, v in points if j == i and q != p]
        if near:
            d, q = min(near)
            best[i, p] = (q, round(d, 6))
    return best


def test_nearest_neighbor_on_odd_points(spark):
    rng = random.Random(3)
    points = [(f"i{k % 3}", k, rng.random() * 10 ** rng.randint(-2, 2), rng.random()) for k in range(150)]
    points += [("i0", 500 + k, 3.0, 3.0) for k in range(40)] + [("line", k, float(k * k), 5.0) for k in range(30)] + [("one", 1, 0.0, 0.0), ("two", 1, 0.0, 0.0), ("two", 2, 0.0, 0.0)]
    points += [("grid", 10 * a + b, float(a), float(b)) for a in range(10) for b in range(10)]
    odd = [("i0", 900, None, 1.0), ("i0", 901, float("nan"), 1.0), ("i0", 902, 1.0, float("inf")), ("nan", 1, float("nan"), 0.0), ("nan", 2, 0.0, 0.0), (None, 3, 0.0, 0.0), ("i0", None, 3.0, 3.0)]
    df = spark.createDataFrame(points + odd + points[:5], "image string, id long, x double, y double")
    got = {(r.image, r.id): (r.neighbor, r.distance) for r in domain.nearest_neighbor(df, "image", "id", "x", "y", 16).collect()}
    assert got == brute_neighbors(points)
    assert domain.nearest_neighbor(df.limit(0), "image", "id", "x", "y").count() == 0


def test_nearest_neighbor_of_a_crowd(spark):
    """20,000 points in a millionth of the image's side: no square meets itself whole."""
    rng = np.random.default_rng(1)
    xy = np.r_[rng.random((20_000, 2)) * 1e-6, rng.random((50, 2))]
    df = spark.createDataFrame([("a", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "image string, id long, x double, y double")
    got = {r.id: r.neighbor for r in domain.nearest_neighbor(df, "image", "id", "x", "y").collect()}
    assert len(got) == len(xy)
    for i in list(range(0, 20_000, 997)) + list(range(20_000, 20_050)):
        d = np.sqrt(((xy - xy[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert got[i] == int(d.argmin())


def test_nearest_clusters_by_parts(spark, monkeypatch):
    """GRID parts of each side meet, and no more where rows grow; shorter vectors end in zeros, ties go to the smallest id, nothing is stored."""
    monkeypatch.setattr(vectors, "GRID", 3)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 10)
    monkeypatch.setattr(vectors, "stored", lambda *_: 1 / 0)
    m = _vectors(5, 150, 5, 0.5)
    m[40:45, 4] = 0
    rows = [(3 * i, (v[:4] if 40 <= i < 45 else v).tolist()) for i, v in enumerate(m)]
    state = spark.createDataFrame(rows, "id long, c array<double>").withColumn("n", F.lit(1))
    asked = state.filter("id % 2 = 0")
    d = np.round(1 - m @ m.T, 12)
    np.fill_diagonal(d, np.inf)
    want = {3 * i: (3 * int(d[i].argmin()), float(d[i].min())) for i in range(0, 150, 2) if d[i].min() < 0.3}
    assert {r.id: (r.other, r.distance) for r in vectors.nearest_clusters(asked, state, 0.3).collect()} == want and want


def test_blocks_grow_with_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 4)
    monkeypatch.setattr(vectors, "BLOCKS", 8)
    m = _vectors(4, 400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    assert vectors.skipped(df, 0.1).collect()[0].blocks <= 8 + vectors.PIVOTS
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - u @ u.T
    assert {(r.a, r.b) for r in vectors.vector_pairs(df, 0.1).collect()} == {(a, b) for a in range(400) for b in range(a + 1, 400) if d[a, b] < 0.1}


def test_tag_pairs_meet_at_several_tags(spark, monkeypatch):
    """Sets that share common tags only never meet where three are needed; all sizes, thresholds and null tags against brute force; pairs are not stored."""
    written, real = [], folders.stored
    monkeypatch.setattr(folders, "stored", lambda df, name: written.append(name) or real(df, name))
    monkeypatch.setattr(similarity, "stored", folders.stored)
    rng = random.Random(2)
    for sizes in ([4], [3, 4, 5], [1, 2, 7], [0, 4, 9]):
        rows = [(i, [rng.choice(["A", "a"]) if t == "a" else t for t in rng.sample([*"abcdefghij"], rng.choice(sizes))]) for i in range(80)]
        df = spark.createDataFrame(rows, "id long, tags array<string>")
        sets = {i: {t.lower() for t in g} for i, g in rows}
        for above in (0.0, 0.3, 0.5):
            got = Counter((r.a, r.b, round(r.jaccard, 9)) for r in similarity.tag_jaccard_pairs(df, above).collect())
            want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
            assert got == Counter((a, b, round(j, 9)) for (a, b), j in want.items() if j > above) and got
    assert "tag-pairs" not in written
    keys = similarity.tag_jaccard_pairs(spark.createDataFrame([(i, ["x", "y", f"p{i}", f"q{i}"]) for i in range(50)], "id long, tags array<string>"), 0.5)
    assert keys.count() == 0
    assert similarity.tag_jaccard_pairs(df.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("features", [3, 12, 500])
def test_cluster_terms_of_common_words(spark, monkeypatch, features):
    """Pairs are sought among common words only, and give the features of counting all; terms of texts are not stored."""
    written, real = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: written.append(name) or real(df, name))
    rng = random.Random(features)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(20)], weights=[1 / (k + 1) ** 1.5 for k in range(20)], k=rng.randint(0, 25)))) for i in range(40)] + [(7, "w1 w2 w1 w2"), (90, None)]
    tf, df, total = Counter(), Counter(), Counter()
    for i, text in rows:
        w = (text or "").split()
        tf.update((i, t) for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    for (_, t), k in tf.items():
        df[t] += 1
        total[t] += k
    kept = sorted((t for t in df if df[t] > 1), key=lambda t: (-total[t], t))[:features]
    weight = {(i, t): k * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for (i, t), k in tf.items() if t in kept}
    norm = {i: math.sqrt(sum(x * x for (j, _), x in weight.items() if j == i)) for i, _ in weight}
    want = Counter()
    for (i, t), x in weight.items():
        want[i % 2, t] += x / norm[i]
    texts = spark.createDataFrame(rows, "id long, text string")
    members = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(90, 0)], "id long, cluster int")
    got = {(r.cluster, r.term): r.score for r in similarity.cluster_terms(texts, members, features=features, n=10_000).collect()}
    size = {0: 21, 1: 20}
    assert set(got) == set(want) and all(abs(got[k] - want[k] / size[k[0]]) < 2e-6 for k in want)
    assert "tf" not in written


def test_long_lists_by_blocks(spark, monkeypatch):
    """A row of a long list goes to LIST_PARTS tasks at most, and keys of more than DENSE_ROWS rows are paired by blocks."""
    for name, value in (("LIST_ROWS", 4), ("LIST_PARTS", 3), ("DENSE_ROWS", 2)):
        monkeypatch.setattr(cosine, name, value)
    df, given = entries(spark, 11, 60, [3])
    got = {(r.a, r.b): round(r.similarity, 7) for r in similarity.similar_pairs(df, 0.45).collect()}
    assert got == brute_pairs(given, 0.45) and got


def test_similar_pairs_leave_tasks_once(spark, monkeypatch):
    """Candidates and pairs are neither stored nor shuffled, whatever blocks they meet in, and every pair comes."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    monkeypatch.setattr(blocks, "BLOCK_SIZE", 90)
    names, new = [], folders.work_dir
    monkeypatch.setattr(folders, "work_dir", lambda s, name: names.append(name) or new(s, name))
    df, given = entries(spark, 5, 80, [0, 2, 4])
    out = similarity.similar_pairs(df, 0.4)
    assert {(r.a, r.b): round(r.similarity, 7) for r in out.collect()} == brute_pairs(given, 0.4)
    assert names == ["tag-sets", "places", "similar-vectors"]
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_cosine_pairs_leave_tasks_once(spark, monkeypatch):
    """Only vectors are stored, whatever blocks they meet in; neither candidates nor pairs are, and every pair comes once."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    names, new = [], folders.work_dir
    monkeypatch.setattr(folders, "work_dir", lambda s, name: names.append(name) or new(s, name))
    df, given = entries(spark, 12, 80, [0])
    out = cosine.cosine_pairs(similarity.tfidf(df), 0.6)
    want = brute_pairs([(i, t, []) for i, t, _ in given], 0.3)
    assert Counter((r.a, r.b, round(r.cosine / 2, 7)) for r in out.collect()) == Counter((*k, v) for k, v in want.items()) and want
    assert names == ["vectors", "cosine-vectors"]
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert cosine.cosine_pairs(similarity.tfidf(df.limit(0)), 0.6).count() == 0


def test_transfers_with_projects_carried(spark, monkeypatch):
    """Pairs that carry their projects and dates give what pairs joined with them give, and what brute force gives."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 9)
    df, given = entries(spark, 21, 90, [2, 3])
    df = df.withColumn("project_id", F.when(F.col("id") % 21 != 0, F.concat(F.lit("p"), F.col("id") % 4))).withColumn("date", F.when(F.col("id") % 33 != 0, F.concat(F.lit("2024-0"), 1 + F.col("id") % 6)))
    base = df.filter("id % 15 = 0")
    out = similarity.similar_transfers(df, 0.3, base, "2024-03", 0.6)
    want = Counter(map(tuple, similarity.transfer_candidates(df, similarity.similar_pairs(df, 0.3), base, "2024-03", 0.6).collect()))
    assert Counter(map(tuple, out.collect())) == want and want
    pairs = brute_pairs(given, 0.3)
    p, d = (lambda i: f"p{i % 4}" if i % 21 else None), (lambda i: f"2024-0{1 + i % 6}" if i % 33 else "")
    best = {}
    for (a, b), sim in [*pairs.items(), *(((b, a), v) for (a, b), v in pairs.items())]:
        if p(a) and p(b) and p(a) != p(b) and d(a) >= "2024-03":
            best.setdefault((a, p(b)), []).append((sim, -b, d(b) >= "2024-03"))
    kept = {k: max(v)[0] for k, v in best.items() if k[0] % 15 and not any(s >= 0.6 and x for s, _, x in v)}
    assert {(e, t): s for e, t, s, _ in want} == pytest.approx(kept, abs=2e-6)


def packed(vectors, tags, rows):
    """Blocks of dense vectors in this process."""
    lists = [[int(k) for k in np.flatnonzero(v)] for v in vectors]
    weights = [[float(v[k]) for k in own] for v, own in zip(vectors, lists, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(vectors))), pa.array(lists, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64())), pa.array(tags, pa.list_(pa.int64()))], names=["id", "h", "w", "tags"])
    out = list(blocks._packed([batch], rows, 10**6))
    return [(b.column(0)[0].as_py(), blocks.Block(*(np.frombuffer(b.column(c)[0].as_buffer(), k) for c, k in zip(blocks.Block._fields, blocks._KINDS, strict=True)))) for b in out]


@pytest.mark.parametrize(("slots", "own", "strip", "at_once"), [(1_024, 256, 512, 10**6), (8, 3, 5, 7), (2, 1, 1, 1)])
def test_two_blocks_by_any_sketch(monkeypatch, slots, own, strip, at_once):
    """However coarse the sketch, no pair is lost and none comes twice."""
    for name, value in (("SLOTS", slots), ("OWN", own), ("STRIP", strip), ("AT_ONCE", at_once)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(3)
    m = rng.random((40, 30)) ** 3 * (rng.random((40, 30)) < 0.3)
    m[7], m[9] = m[8], 0
    tags = [sorted(rng.choice(9, rng.integers(0, 5), False).tolist()) for _ in m]
    tags[9] = tags[11] = [1, 2]
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    want = {}
    for a in range(40):
        for b in range(a + 1, 40):
            both, all_ = len({*tags[a]} & {*tags[b]}), len({*tags[a]} | {*tags[b]})
            want[a, b] = (both / all_ if all_ else 0.0, float(u[a] @ u[b]))
    made = packed(m, tags, 13)
    assert len(made) == 4
    for tagged, need, score in ((True, 0.35, lambda j, c: (j + c) / 2), (False, 0.4, lambda j, c: c)):
        got = []
        for p, (ids, x) in enumerate(made):
            for other, y in made[p:]:
                for i, j, jac, cos in blocks._met(x, y, x is y, need, tagged):
                    got += [((ids[s], other[t]), round(float(g if tagged else 0.0), 9), round(float(c), 9)) for s, t, g, c in zip(i, j, jac, cos, strict=True)]
        assert len(got) == len({k for k, _, _ in got})
        assert sorted(got) == sorted((k, round(j if tagged else 0.0, 9), round(c, 9)) for k, (j, c) in want.items() if score(j, c) >= need)


@pytest.mark.parametrize("column", [1, 1_000])
def test_terms_of_many_pairs_are_multiplied_at_once(monkeypatch, column):
    """Whatever terms are columns, no pair is lost; and pairs that are alike aren't weighed term by term, one after the other."""
    monkeypatch.setattr(blocks, "COLUMN", column)
    monkeypatch.setattr(blocks, "OWN", 4)
    rng = np.random.default_rng(6)
    m = np.c_[1 + rng.random((120, 300)) / 10, (rng.random((120, 80)) < 0.02) * 3.0]  # all alike, and some rare terms
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    (_, x), (_, y) = packed(m, [[1, 2, k + 9] for k in range(120)], 60)
    made, real = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda v, *a, **b: made.append(len(v)) or real(v, *a, **b))
    got = {(i, 60 + j): round(c, 9) for found in blocks._met(x, y, False, 0.5, True) for i, j, c in zip(found[0], found[1], found[3], strict=True)}
    assert got == {(i, j): round(float(u[i] @ u[j]), 9) for i in range(60) for j in range(60, 120)}
    assert column == 1 or sum(made) < 60 * 60 * 300 / 5


def test_links_join_what_pairs_join(spark):
    """Links are few where all is alike; components, each entry's greatest similarity and clusters are those of all pairs."""
    df, _ = entries(spark, 8, 60, [2, 3])
    copies = spark.range(1_000, 1_060).selectExpr("id", "'one and the same text' AS text", "array('x') AS tags")
    df = df.unionByName(copies).localCheckpoint()
    pairs, links = (x.select("a", "b", F.round("similarity", 9).alias("similarity")).localCheckpoint() for x in (similarity.similar_pairs(df, 0.4), similarity.similar_links(df, 0.4)))
    assert pairs.filter("a >= 1000").count() == 60 * 59 / 2 and pairs.exceptAll(links).count() > 0 and links.exceptAll(pairs).count() == 0
    many = blocks.parts(120, 0, 1)
    assert links.count() < (many + 1) * 120
    found = lambda p: {tuple(r) for r in similarity.connected_components(p.select("a", "b")).collect()}
    assert found(links) == found(pairs)
    best = lambda p: {tuple(r) for r in p.selectExpr("explode(array(a, b)) AS id", "similarity").groupBy("id").agg(F.max("similarity")).collect()}
    assert best(links) == best(pairs)
    clusters = lambda p: {tuple(r) for r in similarity.recurrence_clusters(p, 0.2, df).collect()}
    assert clusters(links) == clusters(pairs) and clusters(links)


@pytest.mark.parametrize("most", [4, 11])
def test_jaccards_of_clusters_without_pairs(spark, monkeypatch, most):
    """Sums over all pairs are right for sets of any sizes, and sets of few tags never meet."""
    if most <= similarity.MEET_SIZE:
        monkeypatch.setattr(similarity, "_jaccard_sums_by_pairs", lambda sets: sets.filter("false").select("root", F.lit(0.0).alias("s")))
    rng = random.Random(most)
    rows = [(i, None, None if i == 3 else [f"T{t}" for t in rng.sample(range(12), rng.randint(0, most if i % 3 == 1 else 4))] + (["t1"] if i % 5 == 0 else [])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>")
    roots = df.select("id", (F.col("id") % 3).alias("root"))
    want = Counter()
    for a, _, x in rows:
        for b, _, y in rows:
            x_, y_ = ({t.lower() for t in z or []} for z in (x, y))
            if a < b and a % 3 == b % 3 and x_ | y_:
                want[a % 3] += len(x_ & y_) / len(x_ | y_) / 2
    got = {r.root: r.s for r in similarity._pair_sums(df, roots, ()).collect()}
    assert got == pytest.approx(dict(want), abs=1e-9)
