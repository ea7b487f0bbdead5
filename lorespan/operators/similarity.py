"""Recurrence of entries by tags and weighted terms, and grouping of vectors."""

from __future__ import annotations

from fractions import Fraction
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions.text import slugify, tokens
from lorespan.operators.blocks import block_pairs, blocks, parts, term_vectors
from lorespan.operators.cosine import cosine_pairs  # noqa: F401
from lorespan.operators.vectors import cluster_vectors, knn_predict, vector_pairs  # noqa: F401
from lorespan.sources.folders import stored, tables

PAIR, STRONG, COHESION = 0.45, 0.65, 0.4
#: Characters of text that tfidf() gives to a task.
PART_CHARS = 16_000_000
#: How many tags sets meet at together, where none has more tags than the second says.
MEET_TAGS, MEET_SIZE = 3, 8


def _parts(texts: DataFrame) -> int:
    length = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-length // PART_CHARS))


def tfidf(entries: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """id, term, tf, df, weight = tf * (ln((1 + N) / (1 + df)) + 1) of entries(id, text).

    Texts, not terms, are dealt by id: counts by text, and what is asked by id later, need no further exchange. The parts
    follow from the length of all texts, so that a task's terms do not grow with them.
    """
    found = F.explode_outer(tokens(F.col("text"), stop_words)).alias("term")  # the outer form computes the tokens once
    tf = entries.select("id", "text").repartition(_parts(entries), "id").select("id", found).filter("term is not null").groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = entries.agg(F.count("*").alias("_n"))
    w = F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1)
    return tf.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", "tf", "df", w.alias("weight"))


def tag_jaccard_pairs(entries: DataFrame, above: float = 0.0) -> DataFrame:
    """a < b and Jaccard of the lower-cased tag sets of all pairs with more than above. At 0 all pairs that share a tag come out, so a common tag makes many.

    Where every set needs m tags in common with any other (three at most count here), sets meet at m tags together, so
    pairs that share one common tag only never meet. Pairs go as soon as they meet: they are neither shuffled nor stored.
    """
    with tables(entries.sparkSession) as scope:
        sets = stored(_tag_sets(entries).filter(F.size("tags") > 0).withColumn("n", F.size("tags")), "tag-sets")
        least = sets.agg(F.min("n")).first()[0] or 1
        # as many tags as a set needs in common with even the smallest set there is; null: more than it has
        k = F.try_element_at(F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: k / (F.col("n") + F.greatest(F.lit(least), k) - k) > above), F.lit(1))
        sets = sets.withColumn("k", k).filter("k is not null")
        few, most, longest = sets.agg(F.min("k"), F.max("k"), F.max("n")).first()
        together = min(few or 1, MEET_TAGS if (longest or 1) <= MEET_SIZE else 1)
        if (most or 1) > together:  # the n - k + m rarest of each hold m that any two have in common
            counts = sets.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("df"))
            ranked = _by_rarity(sets, counts)
            sets = sets.join(ranked, "id").withColumn("p", F.slice("r", 1, F.col("n") - F.col("k") + together)).drop("r")
        else:
            sets = sets.withColumn("p", F.col("tags"))
        keyed = scope.keep(sets.select("id", "tags", F.array_distinct(_together("p", together)).alias("keys")), "tag-keys")
        side = lambda x: keyed.select(F.col("id").alias(x), F.col("tags").alias(f"t{x}"), F.col("keys").alias(f"k{x}"), F.explode("keys").alias("key"))
        met = side("a").join(side("b"), "key").filter("a < b").filter(F.array_min(F.array_intersect("ka", "kb")) == F.col("key"))  # where they meet first
        both = F.array_intersect("ta", "tb")
        alike = F.size(both) / F.size(F.array_union("ta", "tb"))
        return met.filter(F.size(F.array_compact(both)) > 0).select("a", "b", alike.alias("jaccard")).filter(F.col("jaccard") > above)


def _by_rarity(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """id, r: the tags of sets(id, tags), the rarest of counts(tag, df) first."""
    rows = sets.select("id", F.explode("tags").alias("tag")).join(counts.withColumnRenamed("tag", "_tag"), F.col("tag").eqNullSafe(F.col("_tag")))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "tag"))).alias("r")).select("id", F.transform("r", lambda x: x["tag"]).alias("r"))


def _together(tags: str, m: int) -> Column:
    """A hash of each m (3 at most) of an array's tags together, in their order."""

    def more(rest: Column, m: int, held: tuple) -> Column:
        part = lambda x: F.xxhash64(*held, x.isNull(), x)
        if m == 1:
            return F.transform(rest, part)
        return F.flatten(F.transform(rest, lambda x, i: more(F.slice(rest, i + 2, F.size(rest)), m - 1, (*held, x.isNull(), x))))

    return more(F.col(tags), m, ())


def _tag_sets(entries: DataFrame, *others: str) -> DataFrame:
    return entries.select("id", *others, F.array_sort(F.array_distinct(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t)))).alias("tags"))


def similar_pairs(entries: DataFrame, threshold: float = PAIR, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """a < b, jaccard, cosine, similarity = (jaccard + cosine) / 2 of all pairs of entries(id, text, tags) with at least threshold, exactly.

    Every two blocks of vectors meet in a task (blocks.block_pairs), which multiplies them, common terms as matrices and the
    others one by one. Pairs go as they are found: they are neither shuffled nor stored, so asking twice finds them twice. Entries
    without terms or without tags have 0 there.
    """
    return _similar(entries, threshold, stop_words, False)


def similar_links(entries: DataFrame, threshold: float = PAIR, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Those of similar_pairs() that join all that they join: of each two blocks' pairs a spanning forest of greatest similarity.

    So components are those of all pairs, and each entry keeps its most similar one. Links grow with the entries of the
    blocks that meet, not with the pairs among them.
    """
    with tables(entries.sparkSession) as scope:
        return scope.keep(_similar(entries, threshold, stop_words, True), "similar-links")


def _similar(entries, threshold, stop_words, forest, carried: tuple[str, ...] = ()) -> DataFrame:
    """With carried columns, a and b are structs of the id and these."""
    with tables(entries.sparkSession) as scope:
        sets = stored(_tag_sets(entries, *carried).filter("id is not null"), "tag-sets")
        n, chars = entries.agg(F.count("*"), F.sum(F.length("text").cast("long"))).first()
        many = parts(n, chars or 0, PART_CHARS)
        counts = sets.select(F.explode("tags").alias("tag")).groupBy("tag").agg((-F.count("*")).alias("df"))
        alike = sets.join(_by_rarity(sets, counts), "id", "left")  # the commonest tag first: blocks of the same have fewest terms in common with others
        placed = alike.repartitionByRange(many, "r", "id").sortWithinPartitions("r", "id").select("id", *carried, F.transform("tags", lambda t: F.xxhash64(t)).alias("tags"), F.monotonically_increasing_id().alias("num"))
        placed = stored(placed, "places")
        vectors = placed.join(term_vectors(tfidf(entries, stop_words)), "id", "left")
        if carried:
            vectors = vectors.withColumn("id", F.struct("id", *carried))
        packed = scope.keep(blocks(vectors, many, F.shiftright("num", 33), "num"), "similar-vectors")
        return block_pairs(packed, threshold, forest=forest).withColumn("similarity", (F.col("jaccard") + F.col("cosine")) / 2)


def connected_components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id reached) of every end of edges(a, b): each round maps all vertices to their smallest neighbour and the edges with them."""
    with tables(edges.sparkSession) as scope:
        left = everyone = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        rounds = []
        left = left.filter("a <> b")
        while left.limit(1).count():
            ends = left.select(F.col("a").alias("id"), F.col("a").alias("to")).unionAll(left.select(F.col("b"), F.col("a")))
            rounds.append(stored(ends.groupBy("id").agg(F.min("to").alias("to")), "labels"))
            to = rounds[-1]
            moved = left.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b")
            left = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "edges")
        out = everyone.select(F.col("a").alias("id")).unionAll(everyone.select("b")).distinct().withColumn("root", F.col("id"))
        for to in rounds:
            out = out.join(to.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        return scope.keep(out, "components")


def _pair_sums(entries: DataFrame, roots: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """root and s: the sum of the similarities of all pairs in each cluster of roots(id, root), without making the pairs.

    Cosines come from the sums of normalised vectors by term. For Jaccard, entries with equal tags in one cluster are one
    counted set; only in clusters with a set of more than MEET_SIZE tags do sets meet.
    """
    weights = tfidf(entries, stop_words)
    norm = F.sqrt(F.sum(F.col("weight") ** 2).over(W.partitionBy("id")))
    unit = weights.select("id", "term", (F.col("weight") / norm).alias("u")).join(roots, "id")
    terms = unit.groupBy("root", "term").agg(F.sum("u").alias("t"), F.sum(F.col("u") ** 2).alias("q"))
    cosines = terms.groupBy("root").agg((F.sum(F.col("t") ** 2 - F.col("q")) / 2).alias("s"))
    sets = _tag_sets(entries).join(roots, "id").filter(F.size("tags") > 0).groupBy("root", F.transform("tags", lambda t: F.xxhash64(t)).alias("tags")).agg(F.count("*").alias("n"))
    longest = sets.groupBy("root").agg(F.max(F.size("tags")).alias("longest"))
    sets = stored(sets.join(longest, "root"), "cluster-sets")
    jaccards = _jaccard_sums(sets.filter(F.col("longest") <= MEET_SIZE)).unionByName(_jaccard_sums_by_pairs(sets.filter(F.col("longest") > MEET_SIZE)))
    return cosines.unionByName(jaccards).groupBy("root").agg((F.sum("s") / 2).alias("s"))


def _jaccard_sums(sets: DataFrame) -> DataFrame:
    """root, s: the sum of the Jaccards of all pairs in each cluster of sets(root, tags, n), n copies of one set of MEET_SIZE tags at most, without making the pairs.

    Each set is counted at every part of it. A pair with k tags in common is counted at C(k, j) parts of j tags, so how
    many pairs of two sizes have k in common follows from the counts for each j, and so do their Jaccards.
    """
    every = F.aggregate("tags", F.array(F.array().cast("array<bigint>")), lambda held, t: F.concat(held, F.transform(held, lambda x: F.concat(x, F.array(t)))))
    rows = sets.select("root", F.size("tags").alias("p"), "n", F.explode(every).alias("part")).filter(F.size("part") > 0)
    counts = rows.groupBy("root", F.xxhash64("part").alias("part"), F.size("part").alias("j"), "p").agg(F.sum("n").alias("n"))
    sizes = counts.groupBy("root", "part", "j").agg(F.collect_list(F.struct("p", "n")).alias("x")).filter((F.size("x") > 1) | (F.col("x")[0]["n"] > 1))
    two = sizes.select("root", "j", "x", F.explode("x").alias("y")).select("root", "j", "y", F.explode("x").alias("x")).filter("x.p <= y.p")
    met = two.groupBy("root", "j", F.col("x.p").alias("p"), F.col("y.p").alias("q")).agg(F.sum(F.expr("CASE WHEN x.p < y.p THEN x.n * y.n ELSE x.n * (x.n - 1) DIV 2 END")).alias("c"))
    top = range(1, MEET_SIZE + 1)
    share = [(j, p, q, float(sum((-1) ** (j - k) * comb(j, k) * Fraction(k, p + q - k) for k in range(1, j + 1)))) for p in top for q in range(p, MEET_SIZE + 1) for j in range(1, p + 1)]
    shares = sets.sparkSession.createDataFrame(share, "j int, p int, q int, w double")
    return met.join(F.broadcast(shares), ["j", "p", "q"]).groupBy("root").agg(F.sum(F.col("c") * F.col("w")).alias("s"))


def _jaccard_sums_by_pairs(sets: DataFrame) -> DataFrame:
    """The same for sets of any size: those that share a tag meet."""
    equal = sets.select("root", (F.col("n") * (F.col("n") - 1) / 2).alias("s"))
    rows = sets.select("root", "tags", "n", F.explode("tags").alias("tag"))
    side = lambda x: rows.select("root", "tag", F.col("tags").alias(f"{x}s"), F.col("n").alias(f"{x}n"))
    met = side("a").join(side("b"), ["root", "tag"]).filter(F.col("as") < F.col("bs")).groupBy("root", "as", "bs", "an", "bn").agg(F.count("*").alias("k"))
    other = met.select("root", (F.col("an") * F.col("bn") * F.col("k") / (F.size("as") + F.size("bs") - F.col("k"))).alias("s"))
    return equal.unionByName(other)


def recurrence_clusters(pairs: DataFrame, cohesion: float = COHESION, entries: DataFrame | None = None, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """cluster (its smallest id), size, cohesion (mean similarity over all its pairs), max_sim_rep, max_sim_pair, band.

    pairs(a, b, similarity) link the clusters. With entries(id, text, tags), every pair in a cluster counts with its real
    similarity, also those that pairs lacks; without them, these count 0. Clusters below cohesion are dropped. The band
    goes by the greatest similarity to the smallest id, which may be 1.
    """
    with tables(pairs.sparkSession) as scope:
        return scope.keep(_clusters(pairs, connected_components(pairs.select("a", "b")), cohesion, entries, stop_words), "clusters")


def _clusters(pairs, roots, cohesion, entries, stop_words) -> DataFrame:
    sizes = stored(roots.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    inner = pairs.join(roots.select(F.col("id").alias("a"), "root"), "a")
    sums = inner.groupBy("root").agg(F.sum("similarity").alias("s"), F.max(F.when(F.col("a") == F.col("root"), F.col("similarity"))).alias("m"), F.max("similarity").alias("p"))
    if entries is not None:
        sums = sums.drop("s").join(_pair_sums(entries, roots, stop_words), "root")
    n = F.col("size") * (F.col("size") - 1) / 2
    out = sizes.join(sums, "root").withColumn("cohesion", F.col("s") / n).filter(F.col("cohesion") >= cohesion)
    band = F.when(F.col("m") >= STRONG, "strong").when(F.col("m") >= PAIR, "review").otherwise("suppressed")
    return out.select(F.col("root").alias("cluster"), "size", F.round("cohesion", 6).alias("cohesion"), F.round("m", 6).alias("max_sim_rep"), F.round("p", 6).alias("max_sim_pair"), band.alias("band"))


def band_clusters(entries: DataFrame, cohesion: float = COHESION, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """id, cluster, band of each of entries(id, text, tags): those in no kept cluster stand alone (cluster null, band standalone)."""
    with tables(entries.sparkSession) as scope:
        pairs = similar_links(entries, PAIR, stop_words)
        roots = connected_components(pairs.select("a", "b"))
        kept = _clusters(pairs, roots, cohesion, entries, stop_words).select(F.col("cluster").alias("root"), "band")
        held = roots.join(kept, "root").select("id", F.col("root").alias("cluster"), "band")
        return scope.keep(entries.select("id").join(held, "id", "left").select("id", "cluster", F.coalesce("band", F.lit("standalone")).alias("band")), "bands")


def cluster_theme(members: DataFrame, entries: DataFrame, weights: DataFrame, n: int = 3) -> DataFrame:
    """cluster, theme of members(id, cluster): the n commonest tags of entries(id, tags), case ignored; without tags the n terms of most weight; else unclassified. Ties by name."""
    top = lambda rows: rows.withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("w"), "t"))).filter(F.col("k") <= n).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), " / ").alias("theme"))
    tags = members.join(entries.select("id", F.explode("tags").alias("t")), "id").groupBy("cluster", F.lower("t").alias("t")).agg(F.count("*").cast("double").alias("w"))
    terms = members.join(weights.select("id", F.col("term").alias("t"), "weight"), "id").groupBy("cluster", "t").agg(F.round(F.sum("weight"), 6).alias("w"))
    named = members.select("cluster").distinct().join(top(tags).withColumnRenamed("theme", "a"), "cluster", "left").join(top(terms).withColumnRenamed("theme", "b"), "cluster", "left")
    return named.select("cluster", F.coalesce("a", "b", F.lit("unclassified")).alias("theme"))


def suggest_action(members: DataFrame) -> DataFrame:
    """cluster, n, n_ambient, action of members(cluster, mitigation): what the kinds of mitigation in a cluster call for.

    all_structural: consolidate what covers one invariant; all_convention: one convention, perhaps a structural one;
    promote_ambient: ambient awareness, but nothing structural; check_cover: both; review: all else.
    """
    x = members.groupBy("cluster").agg(F.count("*").alias("n"), F.collect_set("mitigation").alias("s"), F.count_if(F.col("mitigation") == "ambient-awareness").alias("n_ambient"))
    only = lambda v: (F.size("s") == 1) & F.array_contains("s", v)
    has = lambda v: F.array_contains("s", v)
    action = F.when(only("structural"), "all_structural").when(only("convention"), "all_convention").when(has("ambient-awareness") & ~has("structural"), "promote_ambient").when(has("ambient-awareness"), "check_cover").otherwise("review")
    return x.select("cluster", "n", "n_ambient", action.alias("action"))


def transfer_candidates(entries: DataFrame, pairs: DataFrame, baseline: DataFrame, since: str, near: float = STRONG) -> DataFrame:
    """entry, target (a project), similarity, like: recent entries(id, project_id, date) that resemble another project's entry, once for each such project.

    pairs(a, b, similarity) are similar_pairs(). Left out are entries of baseline(id), and those to which a recent entry of
    the target is nearly the same (near). Likeness stands in for a reader's judgement of what is worth passing on.
    """
    side = lambda x: entries.select(F.col("id").alias(x), F.struct("id", "project_id", "date").alias(f"e{x}"))
    return _transfers(pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("ea").alias("a"), F.col("eb").alias("b"), "similarity"), baseline, since, near)


def similar_transfers(entries: DataFrame, threshold: float, baseline: DataFrame, since: str, near: float = STRONG, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """transfer_candidates() of similar_pairs() of entries(id, text, tags, project_id, date) with at least threshold. Projects and dates go along
    with the vectors, so no pair is shuffled: of a task's pairs the best for each entry and project leave it."""
    return _transfers(_similar(entries, threshold, stop_words, False, ("project_id", "date")), baseline, since, near)


def _transfers(pairs: DataFrame, baseline: DataFrame, since: str, near: float) -> DataFrame:
    """transfer_candidates() of pairs(a, b, similarity) whose ends are structs of id, project_id and date."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # one reading of the pairs, which may be found anew at each
    both = pairs.select(F.explode(ends).alias("e"), "similarity").select("e.a", "e.b", "similarity")
    met = both.filter((F.col("a.project_id") != F.col("b.project_id")) & (F.col("a.date") >= since))
    like = F.max_by("b.id", F.struct(F.round("similarity", 9), -F.col("b.id")))
    best = met.groupBy(F.col("a.id").alias("entry"), F.col("b.project_id").alias("target")).agg(F.max("similarity").alias("similarity"), like.alias("like"), F.max(F.when(F.col("b.date") >= since, F.col("similarity"))).alias("_near"))
    best = best.filter(~F.coalesce(F.col("_near") >= near, F.lit(False))).join(baseline.select(F.col("id").alias("entry")), "entry", "left_anti")
    return best.select("entry", "target", F.round("similarity", 6).alias("similarity"), "like")


def cluster_terms(texts: DataFrame, members: DataFrame, stop_words: tuple[str, ...] = (), min_df: int = 2, features: int = 5_000, n: int = 10) -> DataFrame:
    """cluster, k, term, score: the n terms (words and pairs of neighbours) of greatest mean TF-IDF among members(id, cluster) of texts(id, text).

    Words have two letters or digits and more, and are no stop words. Terms of min_df texts and more count, the features
    commonest of them (ties by name); weights are count * (ln((1 + N) / (1 + df)) + 1), each text scaled to length 1.
    """
    with tables(texts.sparkSession) as scope:
        word = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1), lambda t: ~t.isin(*stop_words) if stop_words else F.lit(True))
        # texts are dealt, not terms: what is counted by id needs no further exchange
        words = texts.select("id", "text").repartition(_parts(texts), "id").select("id", word.alias("w"))
        pair = lambda f, kind: F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), f)).otherwise(F.array().cast(kind))
        top = lambda x: x.orderBy(F.desc("total"), "term").limit(features)

        def counted(rows: DataFrame) -> DataFrame:
            tf = rows.groupBy("id", "term").agg(F.count("*").alias("tf"))
            return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)

        single = stored(counted(words.select("id", F.explode_outer("w").alias("term")).filter("term is not null")), "words")
        n_top, least = top(single).agg(F.count("*"), F.min("total")).first()
        single = stored(single.filter(F.col("total") >= (least if n_top == features else 0)), "common-words")
        # a pair is no commoner than its words, so features are made of words as common as the last word that could be one
        two = words.select("id", F.explode_outer(pair(lambda a, b: F.struct(a.alias("a"), b.alias("b")), "array<struct<a:string,b:string>>")).alias("p")).select("id", "p.a", "p.b")
        two = two.join(single.select(F.col("term").alias("a")), "a").join(single.select(F.col("term").alias("b")), "b")
        kept = stored(top(single.unionByName(counted(two.select("id", F.concat("a", F.lit(" "), "b").alias("term"))))), "features").drop("total")
        many = texts.agg(F.count("*").alias("_n"))
        every = words.select("id", F.explode_outer(F.concat("w", pair(lambda a, b: F.concat(a, F.lit(" "), b), "array<string>"))).alias("term"))
        tf = every.join(F.broadcast(kept), "term").groupBy("id", "term", "df").agg(F.count("*").alias("tf"))  # features rows at most
        w = tf.crossJoin(F.broadcast(many)).select("id", "term", (F.col("tf") * (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1)).alias("w"))
        unit = w.withColumn("u", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(W.partitionBy("id"))))
        sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
        mean = members.join(unit, "id").groupBy("cluster", "term").agg(F.sum("u").alias("s")).join(sizes, "cluster").select("cluster", "term", F.round(F.col("s") / F.col("size"), 6).alias("score"))
        best = mean.withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("score"), "term"))).filter(F.col("k") <= n)
        return scope.keep(best.select("cluster", "k", "term", "score"), "cluster-terms")


def summarize_clusters(members: DataFrame, entries: DataFrame, vectors: DataFrame, shown: int = 8) -> DataFrame:
    """cluster, size, families, projects, examples of members(id, cluster): entries(id, project_id, family), and the members whose vectors(id, embedding) are nearest to the cluster's mean.

    rank orders clusters by families, then size (both descending), then cluster.
    """
    own = members.join(vectors.select("id", F.col("embedding").cast("array<double>").alias("v")), "id")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = own.withColumn("_n", F.greatest(norm, F.lit(1e-300))).select("id", "cluster", F.transform("v", lambda x: x / F.col("_n")).alias("v"))
    centre = unit.select("cluster", F.posexplode("v").alias("k", "x")).groupBy("cluster", "k").agg(F.avg("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"))
    near = unit.join(centre, "cluster").withColumn("near", F.round(F.aggregate(F.zip_with("v", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 9))
    top = near.withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("near"), "id"))).filter(F.col("k") <= shown)
    top = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("examples"))
    facts = members.join(entries.select("id", "project_id", "family"), "id").groupBy("cluster").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set("project_id")).alias("projects"))
    order = F.row_number().over(W.orderBy(F.desc(F.size("families")), F.desc("size"), "cluster"))  # a row for each cluster
    return facts.join(top, "cluster").withColumn("rank", order)


def label_clusters(terms: DataFrame, summaries: DataFrame, keywords: int = 6) -> DataFrame:
    """cluster, slug, label, keywords, size, examples: names from the first two of cluster_terms(), with summarize_clusters()."""
    own = terms.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]).alias("t"))
    rows = summaries.join(own, "cluster", "left")
    two = F.when(F.size("t") > 0, F.slice("t", 1, 2)).otherwise(F.array(F.lit("concept")))
    return rows.select("cluster", slugify(F.array_join(two, "-")).alias("slug"), F.array_join(F.transform(two, lambda x: F.initcap(x)), " ").alias("label"), F.coalesce(F.slice("t", 1, keywords), F.array().cast("array<string>")).alias("keywords"), "size", "examples")
