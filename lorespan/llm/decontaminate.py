"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides keep the least hash of GRAM consecutive words in every stretch of SPAN words, so any shared stretch of SPAN
words shares a fingerprint at the same place. Only texts with a gram among the benchmark's fingerprints are winnowed.
Fingerprints are joined, and each hit is extended: the stretches of SPAN words around it are held, word for word, against
the items' stretches. Places alone travel; a text's words stay in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lower_ascii, small, stored

SPAN = 13
GRAM = 5
#: Fixed value: what separates words, after A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lower-cased: what counts words needs no other case.
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a whole text in order; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def _gram(hashes: Column, at: Column, size: int) -> Column:
    """A hash of size words from a place on; null where the text ends before."""
    return F.when(at + size <= F.size(hashes), F.xxhash64(F.lit(size), *(F.get(hashes, at + F.lit(j)) for j in range(size))))


def _grams(hashes: Column, size: int) -> Column:
    """A hash of each run of size consecutive words."""
    n = F.size(hashes)
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: _gram(hashes, i, size))).otherwise(F.array().cast("array<bigint>"))


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """df, whose column words is known, with a row (pos, size, fp) for each fingerprint; short: lengths below SPAN to be kept whole."""
    window = SPAN - GRAM + 1
    df = df.withColumn("_h", _hashes("words")).withColumn("_g", _grams(F.col("_h"), GRAM))
    g = F.col("_g")
    least = F.transform(F.sequence(F.lit(1), F.size(g) - window + 1), lambda i: F.array_min(F.slice(g, i, window)))
    df = df.withColumn("_m", F.when(F.size(g) >= window, least).otherwise(F.array().cast("array<bigint>")))
    m = F.col("_m")
    near = lambda i: F.slice(m, F.greatest(F.lit(1), i - window + 2), F.least(F.lit(window), i + 1))
    print_ = lambda i, size, x: F.struct(i.alias("pos"), F.lit(size).alias("size"), x.alias("fp"))
    chosen = F.filter(F.transform("_g", lambda x, i: F.when((F.size(m) > 0) & F.array_contains(near(i), x), print_(i, SPAN, x))), lambda s: s.isNotNull())
    for size in short:
        chosen = F.concat(chosen, F.transform(_grams(F.col("_h"), size), lambda x, i: print_(i, size, x)))  # noqa: B023
    df = df.withColumn("_f", chosen).drop("_h", "_g", "_m", "words")
    # the outer form: else the optimizer adds a filter on the array's size, and computes the array twice, within lambdas more often
    return df.select(*(c for c in df.columns if c != "_f"), F.inline_outer("_f")).filter("fp is not null")


def _stretch(at: Column, size: Column) -> Column:
    """A digest of the size words of the column words from a place on. Words hold no space, so different stretches are different texts."""
    return F.md5(F.array_join(F.slice("words", at + 1, size), " "))


def _suspects(docs: DataFrame, items: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """text_digest of the texts that have a gram among the benchmark's fingerprints, or among the first grams of shorter items."""
    sizes = sorted({min(n, GRAM) for n in lengths} | {GRAM})
    first = items.filter(F.size("words") < SPAN).withColumn("_h", _hashes("words"))
    wanted = prints.filter(F.col("size") == SPAN).select("fp")
    for n in sizes:
        own = F.size("_h") >= GRAM if n == GRAM else F.size("_h") == n
        wanted = wanted.unionByName(first.filter(own).select(_gram(F.col("_h"), F.lit(0), n).alias("fp")))
    wanted = small(stored(wanted.distinct(), "wanted"))
    hashed = docs.select("text_digest", _hashes("words").alias("_h"))
    placed = hashed.select("text_digest", "_h", F.explode_outer(F.when(F.size("_h") > 0, F.sequence(F.lit(0), F.size("_h") - 1))).alias("_p"))
    grams = [_gram(F.col("_h"), F.col("_p"), n) for n in sizes]
    rows = placed.select("text_digest", grams[0].alias("fp")) if len(grams) == 1 else placed.select("text_digest", F.explode_outer(F.array(*grams)).alias("fp"))
    return rows.filter("fp is not null").join(wanted, "fp", "left_semi").select("text_digest").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Of each row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and text_digest.

    A window is SPAN consecutive words of an item of benchmark(item_id, text), or a shorter item whole. A document's word
    is hit if any occurrence of a window covers it; contaminated means at least one word, and a twentieth of all, are hit.

    Null and empty texts have no words: nothing is hit, by either side. Equal texts are judged once, so repeated rows,
    rows without doc_id and texts that share a doc_id each get their own text's result. Items that share an id count once,
    items without id hit but are not listed. Empty tables give no rows, or no hits. Other columns are left out. Work grows
    with the words, also where a text or an item repeats one stretch all over.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = stored(items.withColumn("item", F.xxhash64("item_id", "words")), "items")
    lengths = sorted(r[0] for r in items.filter(F.size("words") < SPAN).select(F.size("words")).distinct().collect())  # at most SPAN - 1 numbers
    own = F.least(F.size("words"), F.lit(SPAN))
    prints = _fingerprints(items.filter(F.size("words") >= SPAN).select("item", "words"), []).select("size", "fp")
    for n in lengths:
        prints = prints.unionByName(items.filter(F.size("words") == n).select(F.lit(n).alias("size"), _gram(_hashes("words"), F.lit(0), n).alias("fp")))
    prints = stored(prints.distinct(), "prints")
    windows = items.select("item_id", "words", own.alias("_n")).select("item_id", F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("_n")), lambda i: _stretch(i, F.col("_n")))).alias("window"))
    windows = stored(windows.distinct(), "windows")

    docs = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_digest"))
    suspects = stored(_suspects(docs.select("text_digest", words(F.col("text")).alias("words")), items, prints, lengths), "suspects")
    texts = docs.join(small(suspects), "text_digest", "left_semi").groupBy("text_digest").agg(F.first("text").alias("text"))
    texts = stored(texts.select("text_digest", words(F.col("text")).alias("words")), "suspect-texts")
    hits = _fingerprints(texts, lengths).join(small(prints), ["size", "fp"], "left_semi")
    # a stretch of SPAN words that holds the gram starts so far before it at most
    back = F.when(F.col("size") == SPAN, F.greatest(F.lit(0), F.col("pos") - F.lit(SPAN - GRAM))).otherwise(F.col("pos"))
    starts = hits.select("text_digest", "size", F.explode(F.sequence(back, F.col("pos"))).alias("a"))
    starts = starts.groupBy("text_digest").agg(F.collect_set(F.struct("a", "size")).alias("_s"))
    stretch = lambda s: F.when(s["a"] + s["size"] <= F.size("words"), F.struct(s["a"].alias("a"), (s["a"] + s["size"]).alias("b"), _stretch(s["a"], s["size"]).alias("window")))
    tried = starts.join(texts, "text_digest").select("text_digest", F.explode_outer(F.transform("_s", stretch)).alias("t")).filter("t is not null").select("text_digest", "t.*")
    found = stored(tried.join(small(stored(windows.select("window").distinct(), "stretches")), "window", "left_semi"), "found")

    before = F.max("b").over(W.partitionBy("text_digest").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(before, F.lit(0))))
    n_hit = found.select("text_digest", new.alias("new")).groupBy("text_digest").agg(F.sum("new").cast("long").alias("n_hit"))
    listed = found.select("text_digest", "window").distinct().join(small(windows.filter("item_id is not null")), "window").select("text_digest", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = listed.groupBy("text_digest").agg(F.count("*").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    judged = stored(n_hit.join(listed, "text_digest", "left"), "judged")
    # only a text's ends can leave empty parts
    parts = F.split(F.coalesce("text", F.lit("")), BETWEEN_ANY_CASE)
    n_words = F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    out = docs.select("doc_id", "text_digest", n_words.cast("long").alias("n_words")).join(small(judged), "text_digest", "left").fillna(0, ["n_hit", "n_items"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "text_digest")
