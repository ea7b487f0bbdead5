"""Fill-in-middle, personal data and hard negatives against brute force, with odd rows and empty tables."""

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from compare import SF, duck, duck_rows, spark_rows  # noqa: E402


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_pii", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    from lorespan.llm import queries as Q

    assert spark_rows(Q.queries()[name](spark, SF)) == duck_rows(duck(), Q.oracle_sql()[name])


# 11
def fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    return doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


ODD = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "é\n日本\n𝒳\n", "has <S> inside\nand more", "<P>", "line\n" * 5000, "x" * 100_000 + "\ntail", "\r\n\r\n", "nul\x00\nbyte"]


def test_fill_middle(spark, texts):
    from lorespan.llm.fill_middle import fill_middle, restore

    rows = [(k, t, "c", "clash") for k, t in enumerate(ODD + texts)]
    rows += [(None, "no id\nat all\n", "c", "x"), (5, "another\ntext\n", "c", "x")] + [(3, "\n\n\n", "c", "x")] * 40 + [(7, "é\n日本\n𝒳\n", "c", "x")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string").repartition(3)
    got = fill_middle(docs, texts=True).collect()
    want = Counter((*(x := fim(i, t)), sha(x[-1]), sha(t or ""), t or "") for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256, r.restored) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    back = restore(spark.createDataFrame([(r.doc_id, r.form, r.output) for r in got], "doc_id long, form string, output string"))
    assert Counter((r.doc_id, r.restored_sha256, r.text) for r in back.collect()) == Counter((i, sha(t or ""), t or "") for i, t, *_ in rows)
    assert fill_middle(docs.limit(0)).count() == 0 and restore(back.select("doc_id", F.lit("psm").alias("form"), "text").toDF("doc_id", "form", "output").limit(0)).count() == 0


def test_fill_middle_pieces_are_bounded(monkeypatch):
    from lorespan.llm import fill_middle as M

    monkeypatch.setattr(M, "PIECE", 7)
    for text in ["", "abc", "ab\ncd\nef\ngh\n", "x" * 30 + "\n" + "y" * 3]:
        for start in range(len(text) + 1):
            parts = list(M.cut(text, M.unit_ends(text), start, len(text)))
            assert "".join(parts) == text[start:] and all(0 < len(p) <= 7 for p in parts)


def test_fill_middle_sorts_move_once(spark, docs):
    """The second order has the partitioner of the first, so it adds no shuffle; counts of copies are sent in turns."""
    from lorespan.llm import fill_middle as M

    first = spark.sparkContext.parallelize([((b"a" * 16, 0), 1)]).repartitionAndSortWithinPartitions(4, M._home).mapPartitions(lambda x: x, preservesPartitioning=True)
    assert first.partitionBy(4, M._home) is first


def test_restore_refuses_broken_outputs(spark):
    from lorespan.llm.fill_middle import restore

    bad = spark.createDataFrame([(1, "psm", "<P>a<S>b"), (2, "spm", "<P>a<S>b<M>c"), (3, "psm", "<P>a<S>c<M>b"), (4, "plain", "<P>x")], "doc_id long, form string, output string")
    assert {r.doc_id: r.text for r in restore(bad).collect()} == {1: None, 2: None, 3: "abc", 4: "<P>x"}


# 12
def luhn(d):
    return sum(v if k % 2 == 0 else 2 * v - (9 if v > 4 else 0) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def base_spans(text):
    return [(kind, m.start(), m.end()) for kind, pattern, ok in BASE for m in re.finditer(pattern, text or "") if ok(m[0])]


PRIVATE = [
    None, "", "   ", "write to a.b+c@mail.example.co.uk, or x@y and @z.com a@b.c_d@e.f", "1.2.3.4.5.6.7.8 and 256.1.1.1 then 0.0.0.0, 000255.1.2.3 or 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111222",
    "tel +1 (988) 555-2485, +12, +123, +49 (0) 30 1234567 +1(((((( ++44 20 7946 0958.", "é𝒳 mail: ü@x.de q@日本.jp ok@ok.ok 日 10.0.0.1", "my ssn is 123-45-6789 but 123-45-6789 alone", "iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 or GB82WEST12345698765433",
    "amex 378282246310005, or 378282246310005 far away from any word", "call 555-123-4567 now; +1 555-123-4567", "born 1999-12-31, on 1999-12-31 in June. DOB: 2001-13-01", "a@b.c" * 3000, "1 " * 4000, "-".join(["x@y.z"] * 2500), "a" * 100_000 + "@", "x@" + "b." * 60_000, "9." * 40_000, "+1" + " (" * 40_000,
]


def test_pii_base_spans(spark, texts):
    from lorespan.llm.pii import pii_report

    rows = [(k, t, "c", "clash", 1) for k, t in enumerate(PRIVATE + texts)] + [(None, PRIVATE[3], "c", "x", 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, m string, `end` int").repartition(3)
    got = pii_report(docs)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    want = []
    for i, t, *_ in rows:
        spans = base_spans(t)
        n = Counter(k for k, *_ in spans)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    rows_ = got.collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows_) == Counter(want)
    assert pii_report(docs.limit(0)).count() == 0


def test_pii_context_and_checksums(spark):
    from lorespan.llm.pii import find_pii

    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, PRIVATE[r.doc_id][s.start : s.end], s.score) for s in r.spans] for r in find_pii(docs).collect()}
    assert spans[8] == [("ssn", "123-45-6789", 75)]  # words count up to the match before, so the second has none
    assert spans[9] == [("iban", "DE89 3704 0044 0532 0130 00", 95), ("iban", "GB82WEST12345698765432", 60)]
    assert spans[10] == [("short_card", "378282246310005", 65)]
    assert spans[11] == [("phone", "+1 555-123-4567", 85), ("local_phone", "555-123-4567", 65)]
    assert spans[12] == [("birth_date", "1999-12-31", 55)] * 2  # the second by the word after it; the third has no such month


def test_redaction(spark):
    from lorespan.llm.pii import redact

    docs = spark.createDataFrame([(1, "mail a@b.co, card 4111 1111 1111 1111.", "t"), (2, None, None), (3, "", "x"), (4, "none é", "y")], "doc_id long, text string, spans string")
    assert [tuple(r) for r in redact(docs).orderBy("doc_id").collect()] == [(1, "mail [EMAIL], card [CARD].", "t"), (2, None, None), (3, "", "x"), (4, "none é", "y")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+-_ ()%é𝒳9", max_size=60), min_size=40, max_size=40))
def test_pii_patterns_find_what_plain_ones_find(spark, found):
    from lorespan.llm.pii import find_pii

    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").coalesce(1)
    base = {k for k, *_ in BASE}
    for r in find_pii(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in base] == base_spans(found[r.doc_id]), found[r.doc_id]


# 13
def brute_negatives(rows, positives=5, negatives=5):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scored = sorted((-dot(v, w), i, own) for i, (own, w) in kept.items() if i != a)
        for p, i, own in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:negatives]
            out += [(a, i, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def vectors(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    out = []
    for i in range(n):
        label = int(rng.integers(labels))
        scale = float(rng.choice([0.2, 1, 3]))
        out.append((i * 5, [float(x) for x in scale * (centres[label] + rng.normal(size=dim)).astype(np.float32)], label))
    return out


@pytest.mark.parametrize("bucket", [512 << 10, 1_500])
def test_hard_negatives(spark, monkeypatch, bucket):
    from lorespan.llm import hard_negatives as H

    monkeypatch.setattr(H, "BUCKET", bucket)
    monkeypatch.setattr(H, "CHUNK", 7)
    monkeypatch.setattr(H, "WAITING", 50)
    rows = vectors(320, 6, 3)
    rows += [(2000 + k, rows[0][1], k % 3) for k in range(60)]  # ties
    rows += [(3000, None, 1), (3100, [1.0, float("nan")], 1), (3200, [1.0, None], 1), (3300, [float("inf")], 0), (3400, [0.5], None), (None, [0.5], 1), (3500, [], 1), (3600, [0.5, 0.25], 2), (3700, [0.0] * 6, 1), (0, [9.0] * 6, 3), rows[1], rows[1]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, part string").repartition(3)
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in H.hard_negatives(df).collect())
    assert got == brute_negatives(rows) and len(got) > 100
    assert H.hard_negatives(df.limit(0)).count() == 0


def test_feasible_ranges_lose_nothing():
    """Every vector whose product reaches the bound lies in all ranges of it."""
    from lorespan.llm.hard_negatives import feasible

    rng = np.random.default_rng(5)
    q, p = rng.integers(-50, 50, (40, 5)).astype(float), rng.integers(-50, 50, (300, 5)).astype(float)
    longest = float(np.sqrt((p**2).sum(axis=1).max()))
    products = q @ p.T
    focus = np.argsort(-np.abs(q), axis=1)[:, :3]
    pruned = 0
    for share in (0.3, 0.6, 0.9):
        least = share * products.max(axis=1)
        low, high = feasible(q, least, longest, focus)
        for a in range(len(q)):
            x = p[:, focus[a]]
            inside = ((x >= low[a]) & (x <= high[a])).all(axis=1)
            assert inside[products[a] >= least[a]].all()
            pruned += (~inside).sum()
    assert pruned > 0


def test_search_prunes_and_keeps_ties():
    from lorespan.llm import hard_negatives as H

    rng = np.random.default_rng(9)
    ids, labels = np.arange(500), rng.integers(0, 2, 500)
    values = [rng.normal(size=8).round(2).clip(-3, 3) * 100 for _ in range(500)]
    raw = [v.astype("<i4").tobytes() for v in values]
    buckets = []
    for s in range(0, 500, 100):
        b = H._bucket(ids[s : s + 100], labels[s : s + 100], raw[s : s + 100])
        buckets.append({"longest": b["longest"], "ids": np.frombuffer(b["ids"], "<i8"), "labels": np.frombuffer(b["labels"], "<i8"), "m": np.frombuffer(b["rows"], "<i4").reshape(100, 8).astype(float), "lists": np.frombuffer(b["lists"], "<u2").reshape(8, 100)})
    q = H.matrix(raw[:20])
    ask = {"q": q, "ids": ids[:20], "labels": labels[:20], "least": np.full((20, 1), -np.inf), "most": np.full((20, 1), np.inf)}
    query, score, found = H.search(ask, buckets, 4, True)
    by = defaultdict(list)
    for a, s, i in zip(query, score, found, strict=True):
        by[a].append((-s, i))
    every = H.matrix(raw)
    for a in range(20):
        assert by[a] == sorted((-float(q[a] @ every[i]), i) for i in range(500) if i != a and labels[i] == labels[a])[:4]
