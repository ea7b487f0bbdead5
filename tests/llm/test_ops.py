"""The ten operators against brute force, on texts with every odd case and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

TOKENIZERS = pytest.importorskip("public_tokenizers")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# 1
def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def components_of(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_ngram_join(docs, texts, empty):
    from lorespan.llm.ngram_join import ngram_join

    sets = {3 * k: shingle_set(t) for k, t in enumerate(texts)}
    want = components_of(sets)
    got = by_id(ngram_join(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert ngram_join(empty).count() == 0


def test_ngram_join_many_blocks(spark, monkeypatch):
    """A cluster of several blocks, with links that only later blocks show."""
    from lorespan.llm import ngram_join as N

    monkeypatch.setattr(N, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 9)):
            w[j] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    got = by_id(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == components_of(sets)


def test_ngram_join_hot_shingles(spark, monkeypatch):
    """Shingles that many documents hold go to their homes at once; what links is the same."""
    from lorespan.llm import ngram_join as N

    monkeypatch.setattr(N, "HOT_HERE", 3)
    monkeypatch.setattr(N, "HELD", 700)
    rng = np.random.default_rng(6)
    common = " ".join(f"c{k}" for k in range(40))
    base = [" ".join(f"w{rng.integers(0, 90)}" for _ in range(60)) for _ in range(9)]
    rows = [(i, common + " " + " ".join(w if rng.random() > 0.01 else "edit" for w in base[i % 9].split())) for i in range(60)] + [(100, common), (101, common.upper()), (102, "alone")]
    sets = {i: shingle_set(t) for i, t in rows}
    got = by_id(N.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), k) for i, k in components_of(sets).items()}


def test_components_of_a_chain(spark):
    from lorespan.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (102, 101)], "a long, b long")
    assert {r.id: r.root for r in components(edges).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 101, 102: 101}


# 2
def test_token_counts_and_cache(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    from lorespan.llm.token_counts import token_counts

    path = TOKENIZERS.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {3 * k: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)}
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time, every count comes from the cache
        got = by_id(token_counts(docs, path, cache))
        assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got.values())
    assert spark.read.parquet(cache).count() == len(set(t or "" for t in texts))
    assert token_counts(empty, path).count() == 0


def test_token_counts_query_meets_the_cache(spark, tmp_path):
    """The registered query, run twice with a named cache: the second run counts nothing anew, and gives the same rows."""
    from lorespan.llm import token_counts as C
    from lorespan.llm.queries import op2_token_counts

    rows = [(k, f"text {k % 5} of this table") for k in range(20)] + [(30, None), (None, "text 1 of this table")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.conf.set(C.CACHE_SETTING, f"file://{tmp_path}/cache")
    try:
        first = sorted(map(tuple, op2_token_counts(spark, f"{tmp_path}/in").collect()), key=str)
        assert len(first) == 22 and spark.read.parquet(f"{tmp_path}/cache").count() == 6
        spark.read.parquet(f"{tmp_path}/cache").select("digest", "version", (F.col("n_tokens") + 1000).alias("n_tokens")).write.parquet(f"{tmp_path}/marked")
        spark.conf.set(C.CACHE_SETTING, f"file://{tmp_path}/marked")
        second = sorted(map(tuple, op2_token_counts(spark, f"{tmp_path}/in").collect()), key=str)
        assert spark.read.parquet(f"{tmp_path}/marked").count() == 6
        assert [(i, b, n + 1000, True) for i, b, n, _ in first] == second
    finally:
        spark.conf.unset(C.CACHE_SETTING)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name, texts):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    from lorespan.llm.encoder import Encoder

    path = TOKENIZERS.path(name)
    e, library = Encoder(path), Tokenizer.from_file(path)
    odd = ["it's á\n\nab  c \n d<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ ß ½ 123abc", " a 　b", "d'accord D’accord", " 's 't'll", "é École."]
    same = lambda t: np.frombuffer(e.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert all(same(t or "") for t in [*texts, *odd])
    alphabet = st.sampled_from(list("abEÉéßİıſ'’.,!*#|<>_-0 7\n\t 　日Σς́ǅ") + ["'ll", "<|endoftext|>"])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(alphabet, max_size=30).map("".join))
    def check(t):
        assert same(t)

    check()


# 3
def test_token_file(docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    from lorespan.llm.token_file import ShardReader, token_file

    path = TOKENIZERS.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    start, want, all_ids = 0, {}, []
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[3 * k] = (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
        all_ids += ids
    folder = f"file://{tmp_path}/tokens"
    got = by_id(token_file(docs, path, 1, folder))
    assert {i: (r.start, r.n_tokens, r.ids_crc32) for i, r in got.items()} == want
    r = ShardReader((tmp_path / "tokens/shard-0000000-000000.tkb").read_bytes())
    assert r.ids(70, 900).tolist() == all_ids[70:970]
    assert token_file(empty, path).count() == 0


def test_token_shards_of_nameless_rows(spark, tmp_path):
    """Several shards; rows without doc_id have shards of their own, before the others; a shard that is there already stays."""
    from lorespan.llm import token_file as T

    path = TOKENIZERS.path("word_bpe_49k.json")
    rows = [(None if k % 3 == 0 else k % 40, f"some words {k} and more") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = f"file://{tmp_path}/tokens"
    shards = T.write_token_shards(df, path, folder, 1, shard_text=400)
    got = T.read_token_shards(spark, folder, shards).orderBy("start").collect()
    assert len(got) == 120 and shards.count() > 4
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(120)]
    ids = [r.doc_id for r in got]
    assert ids[:40] == [None] * 40 and ids[40:] == sorted(k % 40 for k in range(120) if k % 3)
    T.write_token_shards(df.select("doc_id", F.lit("other").alias("text")), path, folder, 1, shard_text=30)  # other content in the same folder
    again = T.write_token_shards(df, path, folder, 1, shard_text=400)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, shards.collect()))
    assert sorted(map(tuple, T.read_token_shards(spark, folder, again).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_token_shards_go_on_in_other_files(spark, tmp_path):
    """A shard beyond file_bytes is several files, also within the rows of one doc_id; what is read is the same."""
    from lorespan.llm import token_file as T

    rows = [(k // 3 if k < 60 else 7, f"some words of row {k} " * (1 + k % 5)) for k in range(150)] + [(None, "x y z")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = TOKENIZERS.path("word_bpe_49k.json")
    one = T.write_token_shards(df, path, str(tmp_path / "one"), 1)
    many = T.write_token_shards(df, path, str(tmp_path / "many"), 1, file_bytes=300)
    assert many.count() > 5 * one.count() and many.agg(F.max("part")).first()[0] > 3
    read = lambda f, s: sorted(map(tuple, T.read_token_shards(spark, str(tmp_path / f), s).collect()), key=str)
    assert read("many", many) == read("one", one)
    sizes = [p.stat().st_size for p in (tmp_path / "many").glob("*.tkb")]
    assert max(sizes) < 300 + 2 * 200 + 24 * 40


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 32])
def test_bit_packing(bits):
    from lorespan.llm.token_file import pack, unpack

    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001).astype("<u4")
    data = pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (unpack(data, 1001, bits) == ids).all()


# 4
def test_decontaminate(spark, docs, texts, empty):
    from lorespan.llm.decontaminate import contamination

    w = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    long = w(texts[40] or "") or w(texts[12])
    items = [(1, " ".join(long[5:45])), (2, " ".join(w(texts[12])[3:16])), (3, "two WORDS"), (4, "one"), (5, ""), (6, None), (7, "nothing like this stands in any of these texts at all my friend, none"), (11, " ".join(w(texts[-1])[:20])), (None, "byte here")]
    windows = {}
    for i, t in items:
        x = w(t)
        m = min(13, len(x))
        for k in range(len(x) - m + 1 if x else 0):
            windows.setdefault(tuple(x[k : k + m]), set()).add(i)
    want = {}
    for k, t in enumerate(texts):
        x, hit, found = w(t), set(), set()
        for m in {len(v) for v in windows}:
            for a in range(len(x) - m + 1):
                if own := windows.get(tuple(x[a : a + m])):
                    hit.update(range(a, a + m))
                    found |= own
        found -= {None}
        want[3 * k] = (len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(x))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(contamination(docs, bench))
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want
    assert any(v[1] for v in want.values())
    assert contamination(empty, bench).count() == 0
    assert contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_decontaminate_repetitive_texts(spark):
    """One stretch all over a long text and item: work grows with the words, not with their product."""
    from lorespan.llm.decontaminate import contamination

    df = spark.createDataFrame([(1, "ab " * 20_000), (2, "cd ab " + "ab " * 11), (3, "ab " * 13 + "xy " * 300), (None, "ab " * 20_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "ab " * 20_000), (8, "ab " * 14), (9, "xy xy xy xy")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in contamination(df, bench).collect()}
    assert got == {1: (20_000, 20_000, 2, True), 2: (13, 0, 0, False), 3: (313, 313, 3, True), None: (20_000, 20_000, 2, True)}


# 5
def test_toxicity_learns(spark):
    from lorespan.llm.toxicity import toxicity

    rng = np.random.default_rng(5)
    voc = [f"w{k:03d}" for k in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = rng.choice(voc, 60).tolist()
        toxic = int(i % 8 == 0)
        if toxic:
            w[rng.integers(60)] = "vilestuff"
            w[rng.integers(60)] = "Awfulword!"
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    rows.append((600, None))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = by_id(toxicity(df, lab))
    truth = dict(labels)
    held = [i for i, r in got.items() if r.held_out and i in truth]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert 0 <= got[600].score < 0.3
    assert toxicity(df.limit(0), lab).count() == 0
    assert {r.score for r in toxicity(df, lab.limit(0)).collect()} == {0.0}


def test_nnpu_keeps_the_prior():
    from lorespan.llm.toxicity import train_nnpu

    rng = np.random.default_rng(0)
    make = lambda bad: np.unique(np.r_[rng.integers(10, 500, 20), [3, 4]] if bad else rng.integers(10, 500, 20))
    m = train_nnpu([make(True) for _ in range(200)], [make(k % 10 == 0) for k in range(2000)], 0.1)
    assert set(m.features.tolist()) >= {3, 4}
    assert (m.weights >= 0).all()


def test_nnpu_risk_and_step():
    """The risk against its formula, text by text; the step against finite differences, on both sides of the bound."""
    from lorespan.llm.toxicity import nnpu_step

    rng = np.random.default_rng(2)
    texts = [[np.unique(rng.integers(0, 6, 4)) for _ in range(n)] for n in (9, 14)]
    sets = [(len(x), np.repeat(np.arange(len(x)), [len(t) for t in x]), np.concatenate(x)) for x in texts]
    owns = [rng.random(n) < 0.8 for n, _, _ in sets]
    log_loss = lambda z: math.log1p(math.exp(-z))

    def parts(w, b, prior):
        pos, unl = ([w[t].sum() + b for t, own in zip(x, o, strict=True) if own] for x, o in zip(texts, owns, strict=True))
        mean = lambda v: sum(v) / len(v)
        return prior * mean([log_loss(g) for g in pos]), mean([log_loss(-g) for g in unl]) - prior * mean([log_loss(-g) for g in pos])

    seen = set()
    for prior, b in ((0.1, -1.0), (0.9, 2.0), (0.95, 0.1), *[(0.99, 0.5)] * 8):
        w = rng.normal(size=6)
        risk, step = nnpu_step(sets, owns, w, b, prior)
        as_positive, negatives = parts(w, b, prior)
        assert risk == pytest.approx(as_positive + max(0.0, negatives))
        seen.add(negatives >= 0)
        value = (lambda w, b: sum(parts(w, b, prior))) if negatives >= 0 else (lambda w, b: -parts(w, b, prior)[1])  # noqa: B023
        for k in range(7):
            d = np.eye(7)[k] * 1e-6
            assert step[k] == pytest.approx((value(w + d[:6], b + d[6]) - value(w - d[:6], b - d[6])) / 2e-6, abs=1e-6)
    assert seen == {True, False}


# 6
def test_warc_leaves_lost_attempts_out(spark, tmp_path):
    """An archive that no index lists, left by a lost attempt, is not read."""
    from lorespan.llm.warc import merge_runs, read_archives, write_archives

    df = spark.createDataFrame([(k, f"http://h{k % 3}.example/{k}", "x" * 50) for k in range(30)], "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    runs = write_archives(df, folder)
    whole = next((tmp_path / "warc").glob("*.warc.gz"))
    (tmp_path / "warc" / "captures-000000-ffff-0000.warc.gz").write_bytes(whole.read_bytes())
    assert sorted(r.page_id for r in read_archives(spark, folder).collect()) == list(range(30))
    merged = merge_runs(runs.union(runs.limit(0))).orderBy("position").collect()
    assert [(r.urlkey, r.ts) for r in merged] == sorted((r.urlkey, r.ts) for r in runs.collect())


def test_warc_round_trip(spark, tmp_path):
    from lorespan.llm.warc import read_archives, warc_round_trip

    big = "é" * 700
    pages = [(1, "http://www.b.example.com/x", big), (5, "http://a.example.org/y?z=1", big), (9, "http://b.example.com/x", big), (2, None, None), (3, "", ""), (4, "http://b.example.com/x", "small"), (6, "https://b.example.com:8080/", "small"), (7, "http://c.example.com/\r\nbad", "\r\n\r\n" * 300), (8, "http://b.example.com/x", big + "!")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    folder = f"file://{tmp_path}/warc"
    got = {r.page_id: r for r in warc_round_trip(df, folder).collect()}
    last = {}
    for i, _, h in pages:
        d = (h or "").encode()
        if len(d) >= 1000:
            last[d] = max(i, last.get(d, 0))
    for i, _, h in pages:
        d = (h or "").encode()
        refers = last.get(d, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(d), hashlib.sha1(d).hexdigest(), "response" if refers == i else "revisit", None if refers == i else refers)
    order = sorted(got.values(), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(pages)))
    assert [(r.urlkey, r.ts) for r in order] == sorted((r.urlkey, r.ts) for r in order)
    stored = {r.page_id: r.payload for r in read_archives(spark, folder).collect()}
    assert stored[9].decode() == big and stored[1] is None and stored[7] == b"\r\n\r\n" * 300
    assert warc_round_trip(df.limit(0)).count() == 0


def test_loser_tree():
    from hypothesis import given
    from hypothesis import strategies as st

    from lorespan.llm.warc import LoserTree

    @given(st.lists(st.lists(st.tuples(st.integers(0, 9)), max_size=6).map(sorted), max_size=9))
    def check(runs):
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)

    check()


def test_runs_merge_in_passes(spark):
    """More runs than a range has rows, more than one merge takes: the passes give the order of all, ties and rows without page_id too."""
    from lorespan.llm.warc import RUN_SCHEMA, merge_runs

    rng = random.Random(5)
    rows = []
    for k in range(150):
        name = f"run-{k % 7}-{k:03d}"
        own = [(f"k{rng.randrange(5)}" if k % 3 else "hot", f"2024-01-0{rng.randrange(1, 4)}", rng.choice([None, 3, 4]), at) for at in range(rng.choice([1, 2, 9]))]
        rows += [(name, key, ts, page, at, 10) for key, ts, page, at in sorted(own, key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2], x[3]))]
    runs = spark.createDataFrame(rows, RUN_SCHEMA).coalesce(2)
    want = sorted((key, ts, -1 if page is None else page, name, at) for name, key, ts, page, at, _ in rows)
    for fan_in, range_rows in ((3, 20), (64, 50), (2, 1_000)):
        got = merge_runs(runs, fan_in, range_rows).orderBy("position").collect()
        assert [r.position for r in got] == list(range(len(rows)))
        assert [(r.urlkey, r.ts, r.run, r.offset) for r in got] == [(w[0], w[1], w[3], w[4]) for w in want]


def test_no_merge_takes_more_runs_than_it_may():
    from lorespan.llm.warc import merge_tree

    runs = [[(k,), (k + 100,)] for k in range(50)]
    tree = merge_tree(runs, 4)
    assert list(tree) == sorted(x for r in runs for x in r)
    assert tree.k <= 4 and merge_tree([], 4).k == 1 and list(merge_tree([], 4)) == []


# 7
def removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        d = (t or "").encode()
        g = np.zeros(len(d) + 1, int)
        for p in range(len(d) - 99):
            if d[p : p + 100] in seen:
                g[p] += 1
                g[p + 100] -= 1
            seen.add(d[p : p + 100])
        gone = np.cumsum(g[:-1]) > 0
        out[i] = (len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~gone]))
    return out


def test_suffix_dedup(docs, texts, empty):
    from lorespan.llm.suffix_dedup import suffix_dedup

    want = removal([(3 * k, t) for k, t in enumerate(texts)])
    got = by_id(suffix_dedup(docs))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in want.items()}
    assert suffix_dedup(empty).count() == 0


def test_suffix_levels_merge(spark, monkeypatch):
    """Tiny batches and pieces, so that levels merge and later batches bring earlier places."""
    from lorespan.llm import suffix_dedup as S

    monkeypatch.setattr(S, "BATCH", 50)
    rng = np.random.default_rng(1)
    pool = ["".join(rng.choice(list("abcdef "), 150)) for _ in range(12)]
    rows = [(int(i), "".join(pool[k][rng.integers(0, 40) :] for k in rng.integers(0, 12, 3))) for i in rng.permutation(60)]
    want = removal(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = by_id(S.suffix_dedup(df, with_text=True))
    assert {i: (r.n_removed, r.n_spans) for i, r in got.items()} == {i: v[1:3] for i, v in want.items()}


def test_suffix_dedup_shared_ids(spark):
    from lorespan.llm.suffix_dedup import suffix_dedup

    rng = np.random.default_rng(2)
    t = "".join(rng.choice(list("abcdefgh"), 300))
    rows = [(None, t), (1, t + "x"), (1, "y" + t), (2, t), (2, t)]
    order = sorted({(-1 if i is None else i, hashlib.sha256(x.encode()).hexdigest(), x) for i, x in rows})
    want = removal([(k, x) for k, (_, _, x) in enumerate(order)])
    want = sorted((-1 if o[0] is None else o[0], *want[k][:3]) for k, o in enumerate(order))
    want.append(want[-1])  # the repeated row
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == want


def test_suffix_family_meets_earlier_batches(spark, tmp_path, monkeypatch):
    """Batches one after the other lose the same bytes as their union, with hot grams, copies, and grams that only a later batch repeats."""
    from lorespan.llm import suffix_dedup as S

    monkeypatch.setattr(S, "BATCH", 60)
    rng = np.random.default_rng(8)
    pool = ["".join(rng.choice(list("abcdef \x00é"), 170)) for _ in range(14)]
    rows = [(i, "".join(pool[k][rng.integers(0, 40) :] for k in rng.integers(0, 4 + i // 8, 3))) for i in range(80)]
    rows[45] = (45, rows[3][1])
    want = removal(rows)
    folder, got = f"file://{tmp_path}/family", {}
    for a, b in ((0, 20), (20, 32), (32, 33), (33, 80)):
        df = spark.createDataFrame(rows[a:b], "doc_id long, text string").repartition(3)
        got |= by_id(S.suffix_dedup(df, with_text=True, family=folder))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans) for i, r in got.items()} == {i: v[:3] for i, v in want.items()}
    family = S.StoredFamily(spark, folder)
    assert family.number == 4 and len(family.levels) <= 3
    with pytest.raises(ValueError):
        S.suffix_dedup(spark.createDataFrame([(5, "x")], "doc_id long, text string"), family=folder)


def test_suffix_family_grows_its_groups(spark, tmp_path, monkeypatch):
    """A first batch of three texts, a much larger second one, and a small third: the same as their union, in groups that the texts of all ask for."""
    from lorespan.llm import shared
    from lorespan.llm import suffix_dedup as S

    monkeypatch.setattr(shared, "GROUP_TEXT", 1_500)
    rng = np.random.default_rng(9)
    pool = ["".join(rng.choice(list("abcdef \x00é"), 170)) for _ in range(14)]
    rows = [(i, "".join(pool[k][rng.integers(0, 40) :] for k in rng.integers(0, 4 + i // 8, 3))) for i in range(80)]
    rows[45], rows[70] = (45, rows[1][1]), (70, None)
    want, folder, got, seen = removal(rows), f"file://{tmp_path}/family", {}, []
    for a, b in ((0, 3), (3, 60), (60, 80)):
        got |= by_id(S.suffix_dedup(spark.createDataFrame(rows[a:b], "doc_id long, text string").repartition(3), family=folder))
        family = S.StoredFamily(spark, folder)
        seen.append((family.n_homes, family.since))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: (*v[:3], hashlib.sha256(v[3]).hexdigest()) for i, v in want.items()}
    assert seen[0][1] == 1 and seen[1][0] > 2 * seen[0][0] and seen[1][1] == 2 and seen[2] == seen[1]
    level = spark.read.parquet(*(path for path, _ in family.levels))
    assert level.filter(f"bucket >= {family.n_homes - 1}").count() == 0
    total = sum(len((t or "").encode()) for _, t in rows)
    assert total / family.n_homes <= 1_500 and family.bytes == total


def test_suffix_arrays_are_in_byte_order():
    from lorespan.llm import suffix_dedup as S

    rng = np.random.default_rng(3)
    text = rng.integers(0, 3, 3_000).astype(np.uint8)
    text[1_000:1_400] = text[200:600]
    notes = S.Notes()
    x = S.suffix_array(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([2_900]), text, notes)
    own = [text[a : a + 100].tobytes() for a in x.at]
    assert own == sorted(set(own)) and set(own) == {text[k : k + 100].tobytes() for k in range(2_901)}
    a, b = x.keep(np.arange(0, len(x), 2)), x.keep(np.arange(1, len(x), 2))
    both = S.merged(a, b)
    assert [both.text[k : k + 100].tobytes() for k in both.at] == own
    at, same = x.find(a)
    assert same.all() and (at == np.arange(0, len(x), 2)).all() and not b.find(a)[1].any()


# 8
def test_mixture(spark, docs, empty):
    from lorespan.llm.mixture import mix_sources, source_rates

    out = mix_sources(docs)
    assert {"doc_id", "text", "mix_copy", "mix_key"} <= set(out.columns) and len(out.columns) == len(docs.columns) + 1
    rates = {r.source: r.rate for r in source_rates(docs).collect()}
    copies = Counter(r.doc_id for r in out.collect())
    for r in docs.collect():
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        lam, k = rates[r.source], 0
        p = c = np.exp(-lam)
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        assert copies.get(r.doc_id, 0) == k
    assert mix_sources(empty).count() == 0
    only = spark.createDataFrame([("s1", 1.0)], "source string, weight double")
    assert {r.source for r in mix_sources(docs, only).collect()} <= {"s1"}
    # weights that a caller gives may ask for any mean too
    many = docs.select(F.col("doc_id"), F.when(F.col("doc_id") == 9, "x").otherwise(F.repeat(F.lit("y"), 900)).alias("text"), F.when(F.col("doc_id") == 9, "a").otherwise("b").alias("source"))
    mean = many.agg(F.sum(F.octet_length("text"))).first()[0]
    copies = mix_sources(many, spark.createDataFrame([("a", 1.0)], "source string, weight double")).count()
    u = int(hashlib.md5(b"mix:9").hexdigest()[:13], 16) / 2**52
    below = lambda n: sum(math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(n))
    assert mean > 10_000 and below(copies) <= u + 1e-6 and below(copies + 1) > u - 1e-6


def test_mixture_names_do_not_clash(spark):
    from lorespan.llm.mixture import mix_sources

    names = ["_u", "_n", "_s", "_cdf", "_low", "u", "n", "id", "doc", "low", "cdf", "rate", "a b"]
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") % 2 == 0, "s").alias("source"), *(F.lit(k).alias(c) for k, c in enumerate(names)), F.lit("old").alias("Mix_Key"))
    out = mix_sources(docs)
    assert out.columns == [*docs.columns[:-1], "mix_copy", "mix_key"]
    plain = mix_sources(docs.select("doc_id", "text", "source"))
    assert sorted((r.doc_id, r.mix_copy, r.mix_key) for r in out.collect()) == sorted((r.doc_id, r.mix_copy, r.mix_key) for r in plain.collect())


def test_mixture_takes_any_mean(spark):
    from lorespan.llm.mixture import mix_sources, poisson_cdf, poisson_start, source_rates

    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "x").otherwise(F.repeat(F.lit("y"), 600_000)).alias("text"), F.when(F.col("id") < 20, "tiny").otherwise("big").alias("source"))
    rates = {r.source: r.rate for r in source_rates(docs).collect()}
    assert rates["tiny"] > 1000  # exp(-rate) is 0 in a double
    copies = Counter(r.doc_id for r in mix_sources(docs).select("doc_id").collect())

    def inverse(lam, u):
        c, k = math.exp(-lam), 0
        while c <= u:
            k += 1
            c += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
        return k

    for i in range(60):
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        assert copies.get(i, 0) == inverse(rates["tiny" if i < 20 else "big"], u)
    means = [0.0, 500.0, 500.001, 745.2, 5e4, 3e5]
    for r in spark.createDataFrame([(m,) for m in means], "m double").select("m", poisson_start(F.col("m")).alias("low"), poisson_cdf(F.col("m")).alias("c")).collect():
        assert abs(r.c[-1] - 1) < 1e-8 and r.c[0] >= 0 and (r.m <= 500 or r.low > 0)
        for u in (1e-6, 0.3, 0.9, 0.99999):
            assert r.low + sum(c <= u for c in r.c) == inverse(r.m, u)


def test_mixture_sql(spark):
    import sys

    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from compare import SF, duck, duck_rows, spark_rows

    from lorespan.llm.queries import OP8_SQL, op8_mixture

    assert spark_rows(op8_mixture(spark, SF)) == duck_rows(duck(), OP8_SQL)


# 9
def test_quality_learns(spark):
    from lorespan.llm.quality import quality

    rng = np.random.default_rng(9)
    voc = [f"{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}word" for k in range(200)]
    rows, labels = [], []
    for i in range(300):
        w = rng.choice(voc, 50).tolist()
        good = int(i % 4 != 0)
        if not good:
            w = [x + "!!" for x in w] if i % 8 else [x for x in w[:5] for _ in range(10)]
        rows.append((i, " ".join(w)))
        labels.append((i, good))
    rows += [(300, None), (301, "  ")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = by_id(quality(df, lab))
    truth = dict(labels)
    held = [i for i, r in got.items() if r.held_out and i in truth]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.95
    assert got[300].score == got[301].score
    assert quality(df.limit(0), lab).count() == 0
    assert {r.score for r in quality(df, lab.limit(0)).collect()} == {0.0}


def test_votes_row_by_row():
    """Cosines, ties and weights of the vote against plain loops; the axes against a whole decomposition."""
    from lorespan.llm.flat import flat
    from lorespan.llm.quality import NEIGHBOURS, LatentVotes, main_axes, terms

    import pyarrow as pa

    rng = np.random.default_rng(1)
    text = lambda: " ".join(rng.choice(["good", "fine", "Word", "x1", "!!", "long", "tail"], rng.integers(1, 30)))
    known, asked = [text() for _ in range(60)], [text() for _ in range(40)]
    known += known[:30]  # equal voters, with other labels
    y = rng.integers(0, 2, 90)
    model = LatentVotes(terms(*flat(pa.array(known))), y)
    x = terms(*flat(pa.array([*asked, None, "  "])))
    got = model.score(x)
    z = model.latent(x).astype(np.float64)
    for i in range(40):
        cos = [round(float(np.dot(z[i], v)), 6) for v in model.known.astype(np.float64)]
        near = sorted(range(90), key=lambda j: (-cos[j], j))[:NEIGHBOURS]
        vote = [max(cos[j], 0) + 1e-6 for j in near]
        assert got[i] == pytest.approx(sum(v * y[j] for v, j in zip(vote, near, strict=True)) / sum(vote), abs=0.02)
    assert got[40] == got[41] == pytest.approx(y.mean())
    v = rng.normal(size=(50, 30)).astype(np.float32) * np.r_[[9, 5, 3], np.ones(27)].astype(np.float32)
    _, _, axes = np.linalg.svd(v)
    assert np.abs(np.linalg.svd(main_axes(v, 3).T @ axes[:3].T)[1] - 1).max() < 1e-3


# 10
def test_peaks_by_direct_transform():
    """Peaks and pairs of a short sound against a transform written out as sums."""
    from lorespan.llm.media import FAN, FRAME, HOP, PEAKS, REACH, peak_pairs, spectral_peaks

    x = np.random.default_rng(4).integers(32, 127, FRAME * 4).astype(np.uint8)
    found = []
    for f in range((len(x) - FRAME) // HOP + 1):
        part = [(float(v) - 128) * (0.5 - 0.5 * math.cos(2 * math.pi * k / (FRAME - 1))) for k, v in enumerate(x[f * HOP : f * HOP + FRAME])]
        power = [abs(sum(v * complex(math.cos(2 * math.pi * b * k / FRAME), -math.sin(2 * math.pi * b * k / FRAME)) for k, v in enumerate(part))) ** 2 for b in range(FRAME // 2 + 1)]
        tops = [b for b in range(1, FRAME // 2) if power[b] > power[b - 1] and power[b] >= power[b + 1] and power[b] > 1]
        found += [(f, b) for b in sorted(tops, key=lambda b: -power[b])[:PEAKS]]  # noqa: B023
    times, bins = spectral_peaks(x.tobytes())
    assert list(zip(times.tolist(), bins.tolist(), strict=True)) == found
    want = sorted((t, (b << 16) | (c << 8) | (u - t)) for i, (t, b) in enumerate(found) for u, c in found[i + 1 : i + PEAKS + FAN] if 0 < u - t <= REACH)
    assert list(zip(*(v.tolist() for v in peak_pairs(times, bins)), strict=True)) == want


def test_media(docs, texts, empty):
    from lorespan.llm.media import media_fingerprints, peak_pairs, spectral_peaks, to_wav

    got = by_id(media_fingerprints(docs))
    for k, t in enumerate(texts):
        d = (t or "").encode()
        p = d.ljust(max(192, -(-len(d) // 192) * 192))
        m = to_wav(p)
        r = got[3 * k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(d), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest())
        at, code = peak_pairs(*spectral_peaks(p))
        assert (r.peak_time, r.peak_code, r.n_pairs) == (at.tolist(), code.tolist(), len(at))
        assert r.feature == hashlib.sha256((",".join(map(str, at)) + ";" + ",".join(map(str, code))).encode()).hexdigest()
    assert len({got[3 * k].feature for k in (10, 30, 31, 32, 33)}) == 1
    assert media_fingerprints(empty).count() == 0


def test_tone_is_found():
    from lorespan.llm.media import FRAME, spectral_peaks

    x = (128 + 100 * np.sin(2 * np.pi * 12 * np.arange(FRAME * 8) / FRAME)).astype(np.uint8).tobytes()
    _, bins = spectral_peaks(x)
    assert Counter(bins.tolist()).most_common(1)[0][0] == 12


# pipeline
def contaminated(t, windows):
    x, hit = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t)), set()
    for m in {len(v) for v in windows}:
        for a in range(len(x) - m + 1):
            if tuple(x[a : a + m]) in windows:
                hit.update(range(a, a + m))
    return bool(hit) and 20 * len(hit) >= len(x)


def windows_of(spark, sf):
    out = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        x = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r.text))
        m = min(13, len(x))
        out |= {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if x else set()
    return out


def copies_of(rows):
    """Rows (doc_id, text, source) and how often each is repeated."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode())
    whole = sum(b**0.5 for b in sizes.values())
    out = Counter()
    for i, t, s in rows:
        lam = sizes[s] ** 0.5 / whole * sum(sizes.values()) / sizes[s]
        u, k = int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52, 0
        p = c = math.exp(-lam)
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        out[(i, t, s)] += k
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on the whole table that the one before kept, and run(), against plain loops (the classifier: its own scores of the same rows)."""
    import corpus_pipeline as P
    from compare import SF
    from tokenizers import Tokenizer

    from lorespan.llm.quality import quality

    assert [n for n, _ in P.STAGES] == ["quality", "ngram_join", "decontaminate", "mixture", "token_file"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    scores = {r.doc_id: r.predicted for r in quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    first = [r for r in rows if scores[r[0]]]
    root = components_of({i: shingle_set(t) for i, t, _ in first})
    second = [r for r in first if root[r[0]] == r[0]]
    windows = windows_of(spark, SF)
    third = [r for r in second if not contaminated(r[1], windows)]
    fourth = copies_of(third)
    assert len(rows) > len(first) > len(second) > len(third) > 0
    steps, now = [], docs
    for name, stage in P.STAGES[:4]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(Counter((r.doc_id, r.text, r.source) for r in now.collect()))
    assert steps == [Counter(first), Counter(second), Counter(third), +fourth]
    library = Tokenizer.from_file(TOKENIZERS.path("word_bpe_49k.json"))
    start, want = 0, []
    for (i, t, _), n in sorted(fourth.items()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for _ in range(n):
            want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, SF).collect())
    assert got == want


def test_pipeline_odd_rows(spark):
    """Rows without doc_id, with one doc_id for two texts, and repeated rows: each text is judged by itself."""
    import corpus_pipeline as P
    from compare import SF

    words = [f"w{k}" for k in range(40)]
    t, near, other = " ".join(words), " ".join(words[:-1]), " ".join(reversed(words))
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(5, t), (9, near), (None, t), (None, other), (None, other), (7, passage), (7, "clean words stay here " + other), (8, passage), (3, None), (None, None), (None, ""), (4, "  "), (6, other), (6, other)]
    df = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r.doc_id, r.text) for r in P.keep_one_of_each(spark, df, SF).collect())
    assert (9, near) not in kept and (None, t) not in kept and (None, other) not in kept and kept[(6, other)] == 1 and kept[(5, t)] == 1
    assert kept[(3, None)] == 1 and kept[(4, "  ")] == 1 and kept[(None, None)] + kept[(None, "")] == 1
    clean = Counter((r.doc_id, r.text) for r in P.keep_clean(spark, df, SF).collect())
    assert clean == Counter(r for r in rows if r[1] != passage)
    for stage in (P.keep_good, P.keep_one_of_each, P.keep_clean, P.mix):
        assert stage(spark, df.limit(0), SF).count() == 0


def test_odd_columns_and_ids(spark):
    """Columns that clash with inner names, and null ids, change nothing and break nothing."""
    from lorespan.llm.decontaminate import contamination
    from lorespan.llm.media import media_fingerprints
    from lorespan.llm.ngram_join import ngram_join
    from lorespan.llm.quality import quality
    from lorespan.llm.suffix_dedup import suffix_dedup
    from lorespan.llm.token_counts import token_counts
    from lorespan.llm.toxicity import toxicity

    names = ["_u", "_h", "_g", "_m", "_p", "_f", "_id", "_d", "_key", "_first", "_text", "words", "digest", "text_digest", "home", "bucket", "fp", "pos", "size", "y", "kind", "own_id", "n_bytes"]
    plain = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (2, None), (None, None)], "doc_id long, text string")
    odd = plain.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    path = TOKENIZERS.path("byte_bpe_50k.json")
    for f in (lambda d: contamination(d, bench), media_fingerprints, ngram_join, lambda d: quality(d, labels), suffix_dedup, lambda d: token_counts(d, path), lambda d: toxicity(d, labels)):
        assert sorted(map(str, f(odd).collect())) == sorted(map(str, f(plain).collect()))
