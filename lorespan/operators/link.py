"""Entries, concepts and the edges between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions.text import has_term, normalize, words
from lorespan.operators.identity import global_rank
from lorespan.sources.folders import stored

#: Edges of one trigger beyond which it is reported.
MASS_LINK = 50
#: Rows, and bytes of their text, that are broadcast at most.
CONCEPT_ROWS, CONCEPT_BYTES = 100_000, 16_000_000


def _few(df: DataFrame) -> bool:
    """Whether df's rows and bytes, counted, are few enough to broadcast."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).head()
    return rows <= CONCEPT_ROWS and size <= CONCEPT_BYTES


def _bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small; joins shuffle beyond that."""
    return F.broadcast(df) if _few(df) else df


def concept_terms(concepts: DataFrame) -> DataFrame:
    """slug, level, term (normalized), n_words, head (its first word) of every term of every concept."""
    kinds = (("alias", "aliases"), ("positive", "positive_keywords"), ("negative", "negative_keywords"), ("required_any", "required_any"))

    def levelled(level: str, column: str):
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda t: F.struct(F.lit(level).alias("level"), t.alias("term")))

    rows = concepts.select("slug", F.explode(F.flatten(F.array(*(levelled(k, c) for k, c in kinds)))).alias("t"))
    rows = rows.select("slug", "t.level", normalize(F.col("t.term")).alias("term")).filter("term <> ''").distinct()
    parts = words(F.col("term"))
    return rows.withColumn("n_words", F.size(parts)).withColumn("head", parts[0])


def term_hits(entries: DataFrame, terms: DataFrame) -> DataFrame:
    """entry, slug, level, term of each term that an entry of entries(id, text) holds between word edges.

    Terms meet the entries' distinct words by an equi join on the word that they begin with; longer terms are then held
    against the text, so the regular expression never sees all pairs. While the terms are few enough to broadcast, that
    happens in the scan, and no text is shuffled; else only words are, and the texts of longer hits.
    """
    found = F.explode_outer(F.array_distinct(words(F.col("text")))).alias("head")  # the outer form computes the words once
    if _few(terms):
        met = entries.select(F.col("id").alias("entry"), "text", found).join(F.broadcast(terms), "head")
        return met.filter((F.col("term") == F.col("head")) | ((F.col("term") != F.col("head")) & has_term(F.col("text"), F.col("term")))).select("entry", "slug", "level", "term")
    met = entries.select(F.col("id").alias("entry"), found).join(terms, "head")
    single = met.filter(F.col("term") == F.col("head")).select("entry", "slug", "level", "term")
    several = met.filter(F.col("term") != F.col("head")).select("entry", "slug", "level", "term")
    texts = entries.select(F.col("id").alias("entry"), "text")
    return single.unionByName(texts.join(several, "entry").filter(has_term(F.col("text"), F.col("term"))).select("entry", "slug", "level", "term"))


def link_entries(entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """about edges entry, slug, trigger, confidence, provenance.

    entries(id, project_id, text), concepts(slug, aliases, positive_keywords, negative_keywords, required_any,
    project_scope, match_mode). Scope null means everywhere. A negative term vetoes; if required_any is given, one of its
    terms must be there, and it alone links in any mode. The best of alias (1.00), required_any (0.80) and positive (0.50)
    gives the trigger, its smallest term.
    """
    hits = term_hits(entries, concept_terms(concepts))
    least = lambda level: F.min(F.when(F.col("level") == level, F.col("term")))
    seen = hits.groupBy("entry", "slug").agg(least("alias").alias("a"), least("positive").alias("p"), least("required_any").alias("r"), F.max(F.col("level") == "negative").alias("vetoed"))
    gates = concepts.select("slug", "project_scope", "match_mode", (F.size(F.coalesce("required_any", F.array().cast("array<string>"))) > 0).alias("gated"))
    rows = seen.join(_bounded(gates), "slug").join(entries.select(F.col("id").alias("entry"), "project_id"), "entry")
    rows = rows.filter(~F.col("vetoed") & (~F.col("gated") | F.col("r").isNotNull()) & (F.col("project_scope").isNull() | F.array_contains("project_scope", F.col("project_id"))))
    a = F.when(F.col("match_mode").isin("alias", "hybrid"), F.col("a"))
    p = F.when(F.col("match_mode").isin("keyword", "hybrid"), F.col("p"))
    trigger = F.coalesce(a, "r", p)
    confidence = F.when(a.isNotNull(), "1.00").when(F.col("r").isNotNull(), "0.80").otherwise("0.50")
    return rows.select("entry", "slug", trigger.alias("trigger"), confidence.alias("confidence"), F.lit("auto").alias("provenance")).filter("trigger is not null")


def mass_link_guard(edges: DataFrame, limit: int = MASS_LINK) -> DataFrame:
    """Triggers with more than limit edges."""
    return edges.groupBy("trigger").agg(F.count("*").alias("n_edges")).filter(F.col("n_edges") > limit)


def apply_overrides(edges: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stale): overrides(entry, slug, action) remove automatic edges ('block') or add manual ones ('force'); those without effect are stale."""
    block = overrides.filter("action = 'block'").select("entry", "slug").distinct()
    force = overrides.filter("action = 'force'").select("entry", "slug").distinct()
    left = edges.join(block, ["entry", "slug"], "left_anti")
    added = force.join(left.select("entry", "slug"), ["entry", "slug"], "left_anti")
    out = left.unionByName(added.select("entry", "slug", F.lit(None).cast("string").alias("trigger"), F.lit("1.00").alias("confidence"), F.lit("manual").alias("provenance")))
    there = edges.select("entry", "slug").distinct()
    stale = block.join(there, ["entry", "slug"], "left_anti").withColumn("action", F.lit("block")).unionByName(force.join(there, ["entry", "slug"], "left_semi").withColumn("action", F.lit("force")))
    return out, stale


def live_edges(edges: DataFrame, entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges whose two ends are there and active."""
    alive = entries.filter("status = 'active'").select(F.col("id").alias("entry"))
    return edges.join(alive, "entry", "left_semi").join(concepts.select("slug"), "slug", "left_semi")


def project_hubs(entries: DataFrame, projects: DataFrame) -> DataFrame:
    """project_id, name, family, known of each project with an active entry; unknown projects get their id as name."""
    own = entries.filter("status = 'active'").select("project_id").distinct()
    return own.join(projects.select("project_id", "name", "family"), "project_id", "left").select("project_id", F.coalesce("name", "project_id").alias("name"), F.coalesce("family", F.lit("unknown")).alias("family"), F.col("name").isNotNull().alias("known"))


def follows_edges(logs: DataFrame) -> DataFrame:
    """from_id, to_id: each log of logs(id, project, date, seq, path) and the one before it in its project; dates and numbers missing come last."""
    w = W.partitionBy("project").orderBy(F.col("date").asc_nulls_last(), F.col("seq").asc_nulls_last(), "path")
    return logs.select(F.col("id").alias("from_id"), F.lag("id").over(w).alias("to_id")).filter("to_id is not null")


def orphans(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries from which no edge leads to a concept."""
    return entries.join(edges.select(F.col("entry").alias("id")), "id", "left_anti")


def validate_graph(entries: DataFrame, concepts: DataFrame, edges: DataFrame, follows: DataFrame, logs: DataFrame) -> DataFrame:
    """violation, subject: duplicate ids and slugs, edges without an end, follows edges across projects, and concepts called confirmed without any edge."""
    twice = lambda df, c, name: df.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("violation"), F.col(c).cast("string").alias("subject"))
    gone = lambda df, other, c, k, name: df.join(other.select(F.col(k).alias(c)), c, "left_anti").select(F.lit(name).alias("violation"), F.col(c).cast("string").alias("subject")).distinct()
    p = logs.select("id", "project")
    across = follows.join(p.toDF("from_id", "p1"), "from_id").join(p.toDF("to_id", "p2"), "to_id").filter("p1 <> p2").select(F.lit("follows_across_projects").alias("violation"), F.col("from_id").cast("string").alias("subject"))
    bare = [concepts.filter("status = 'confirmed'").join(edges.select("slug"), "slug", "left_anti").select(F.lit("confirmed_without_evidence").alias("violation"), F.col("slug").alias("subject"))] if "status" in concepts.columns else []
    parts = (*bare, twice(entries, "id", "duplicate_entry"), twice(concepts, "slug", "duplicate_concept"), gone(edges, entries, "entry", "id", "dangling_entry"), gone(edges, concepts, "slug", "slug", "dangling_concept"), across)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def unmapped(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """Top-level names of paths(path) that projects(project_id) lacks, without dot names."""
    top = paths.select(F.split("path", "/")[0].alias("project_id")).filter("project_id not like '.%'").distinct()
    return top.join(projects.select("project_id"), "project_id", "left_anti")


def collect_mentions(logs: DataFrame, edges: DataFrame) -> DataFrame:
    """id and mentions: the sorted distinct concepts of each log; none: an empty list."""
    found = edges.groupBy("entry").agg(F.sort_array(F.collect_set("slug")).alias("mentions"))
    return logs.select("id").join(found.withColumnRenamed("entry", "id"), "id", "left").select("id", F.coalesce("mentions", F.array().cast("array<string>")).alias("mentions"))


def concepts_touched(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """project_id and how many distinct concepts its entries link to."""
    return edges.join(entries.select(F.col("id").alias("entry"), "project_id"), "entry").groupBy("project_id").agg(F.countDistinct("slug").alias("n_concepts"))


def attach_commits(clusters: DataFrame, commits: DataFrame, n: int = 5) -> DataFrame:
    """cluster, commit, ts, rank: the first n commits(commit, ts, message) of a repair from first to last of clusters(cluster, first, last).

    Repairs are numbered in the order of time, and a cluster's first repair follows from its place among them, so each
    cluster meets n numbers by an equi join, whatever its span holds.
    """
    repairs = stored(commits.filter(F.regexp_like(F.lower("message"), F.lit(r"\b(fix|revert|again|broke|regress)"))).select("commit", "ts"), "repairs")
    starts = stored(clusters.select("cluster", "first", "last"), "clusters")
    numbered = global_rank(repairs, [F.col("ts"), F.col("commit")], "_number")
    mixed = starts.select(F.col("first").alias("_ts"), F.lit(0).alias("_kind"), F.col("cluster").cast("string").alias("_id")).unionByName(repairs.select(F.col("ts").alias("_ts"), F.lit(1).alias("_kind"), F.col("commit").cast("string").alias("_id")))
    place = global_rank(mixed, [F.col("_ts"), F.col("_kind"), F.col("_id")], "_all").filter("_kind = 0").select("_id", "_all")
    own = global_rank(starts.select(F.col("first").alias("_ts"), F.col("cluster").cast("string").alias("_id")), [F.col("_ts"), F.col("_id")], "_own").select("_id", "_own")
    before = place.join(own, "_id").select("_id", (F.col("_all") - F.col("_own")).alias("_before"))
    asked = starts.join(before, F.col("cluster").cast("string") == F.col("_id")).select("cluster", "last", "_before", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
    met = asked.withColumn("_number", F.col("_before") + F.col("rank")).join(numbered, "_number").filter(F.col("ts") <= F.col("last"))
    return met.select("cluster", "commit", "ts", "rank")


def lineage_edges(events: DataFrame) -> DataFrame:
    """script, path, kind (read or write) of events(script, inputs, outputs), each once."""
    one = lambda c, kind: events.select("script", F.explode(c).alias("path"), F.lit(kind).alias("kind"))
    return one("inputs", "read").unionByName(one("outputs", "write")).distinct()


def upstream(edges: DataFrame, target: str) -> DataFrame:
    """path: everything that target's making has read, directly or by others, however deep.

    Rounds of two joins, each stored: what wrote the new paths, and what those scripts, if new, have read. A script that
    reads and writes much is met once. Stops when nothing new comes.
    """
    spark = edges.sparkSession
    reads, writes = (stored(edges.filter(F.col("kind") == k).select("script", "path").distinct(), k) for k in ("read", "write"))
    new = found = stored(spark.createDataFrame([(target,)], "path string"), "found")
    met = spark.createDataFrame([], "script string")
    rounds = 0
    while True:
        scripts = stored(writes.join(new, "path").select("script").distinct().join(met, "script", "left_anti"), "scripts")
        new = stored(reads.join(scripts, "script").select("path").distinct().join(found, "path", "left_anti"), "new")
        if not new.limit(1).count():
            return found.filter(F.col("path") != target)
        rounds += 1
        met, found = met.unionByName(scripts), found.unionByName(new)
        if rounds % 20 == 0:  # one table again, so that plans stay short in deep lineage
            met, found = stored(met, "met"), stored(found, "found")
