"""Stable ids, keyed upserts, diffs and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions.text import token_set
from lorespan.sources.folders import stored, tables

#: Rows of the smaller side of a block up to which all its pairs meet.
FEW = 16


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with 1, 2, ... in order, without a window over all rows: rows are dealt to ranges, numbered within their range,
    and moved on by the sizes of the ranges before. order must be total, or ties fall in any order."""
    # the ranges are stored, so that sizes and rows come from one and the same dealing out, and a lost executor changes nothing
    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_base"))
    inner = dealt.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return inner.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_k")).drop("_part", "_k", "_base")


def resolve_ids(records: DataFrame, ledger: DataFrame, prefix: str = "e-") -> tuple[DataFrame, DataFrame]:
    """(records with id, ledger after). records(fingerprint, explicit_id, content_hash), ledger(id, fingerprints, content_hash, status).

    An explicit id that the ledger has wins, then any present or former fingerprint; others get new ids, prefix and 00001 onward
    above the ledger's largest, in the order of their fingerprints. Records that share a fingerprint are told apart by
    their content hash: the first keeps it, others get '#2', '#3'. Ledger ids not seen become tombstones, seen ones active.
    Ledger rows of one id are one entry with the fingerprints of all.
    """
    prior = F.array_sort(F.collect_list(F.struct("fingerprints", "content_hash")))
    ledger = ledger.groupBy("id").agg(prior.alias("_rows")).select("id", F.array_distinct(F.flatten(F.filter("_rows.fingerprints", lambda x: x.isNotNull()))).alias("fingerprints"), F.col("_rows")[0]["content_hash"].alias("content_hash"))
    w = W.partitionBy("fingerprint").orderBy("content_hash")
    k = F.row_number().over(w)
    rows = records.withColumn("fingerprint", F.when(k > 1, F.concat("fingerprint", F.lit("#"), k)).otherwise(F.col("fingerprint")))
    known = ledger.select(F.col("id").alias("_by_id"))
    prints = ledger.select(F.explode("fingerprints").alias("fingerprint"), F.col("id").alias("_by_print")).groupBy("fingerprint").agg(F.min("_by_print").alias("_by_print"))
    rows = rows.join(known, rows.explicit_id == F.col("_by_id"), "left").join(prints, "fingerprint", "left").withColumn("id", F.coalesce("_by_id", "_by_print")).drop("_by_id", "_by_print")
    top = ledger.agg(F.coalesce(F.max(F.when(F.startswith("id", F.lit(prefix)), F.substring("id", len(prefix) + 1, 20).try_cast("long"))), F.lit(0)).alias("_top"))
    minted = global_rank(rows.filter("id is null"), [F.col("fingerprint")], "_rank").crossJoin(F.broadcast(top))
    number = (F.col("_rank") + F.col("_top")).cast("string")
    minted = minted.withColumn("id", F.concat(F.lit(prefix), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number))).drop("_rank", "_top")
    out = rows.filter("id is not null").unionByName(minted)
    seen = out.groupBy("id").agg(F.min("fingerprint").alias("_now"), F.min("content_hash").alias("_hash"))
    after = ledger.join(seen, "id", "full")
    after = after.select(
        "id",
        F.when(F.col("_now").isNull(), F.col("fingerprints")).otherwise(F.array_distinct(F.concat(F.array("_now"), F.coalesce("fingerprints", F.array().cast("array<string>"))))).alias("fingerprints"),
        F.coalesce("_hash", "content_hash").alias("content_hash"),
        F.when(F.col("_now").isNull(), "tombstone").otherwise("active").alias("status"),
    )
    return out, after


def upsert(base: DataFrame, updates: DataFrame, key: str, preserve: tuple[str, ...] = (), order: str | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """base with updates by key: the latest update of a key (by order, then the first by ties) replaces or is appended; preserve columns keep what base has, if not empty."""
    if order:
        updates = updates.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order), *ties))).filter("_k = 1").drop("_k", order, *ties)
    cols = [c for c in base.columns if c != key]
    new = updates.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in cols))
    pick = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")) if c in preserve else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))
    return base.join(new, key, "full").select(key, *(pick(c).alias(c) for c in cols))


def insert_only_merge(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target and the rows of source whose key it lacks."""
    return target.unionByName(source.join(target.select(key), key, "left_anti").select(*target.columns))


def register_values(base: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, collisions): batch(namespace, key, value) over base; two values for one key within the batch collide and change nothing."""
    one = batch.groupBy("namespace", "key").agg(F.countDistinct("value").alias("n_values"), F.min("value").alias("value"))
    good = one.filter("n_values = 1").drop("n_values")
    left = base.join(good.select("namespace", "key"), ["namespace", "key"], "left_anti")
    return left.unionByName(good), one.filter("n_values > 1").select("namespace", "key", "n_values")


def namespace_of(path: Column) -> Column:
    """The folder after the nearest 'analysis' folder of a path."""
    return F.nullif(F.regexp_extract(path, r"^.*/analysis/([^/]+)/", 1), F.lit(""))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", activity: DataFrame | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """key and change (added, removed, changed): any column that differs, null-safe. Keys of activity(key) that both snapshots hold alike are 'touched'; keys that begin with one of excluded are left out."""
    cols = [c for c in before.columns if c != key]
    a = before.select(key, F.struct(*cols).alias("_a"))
    b = after.select(key, F.struct(*cols).alias("_b"))
    rows = a.join(b, key, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    rows = rows.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))
    if activity is not None:
        rows = rows.unionByName(activity.select(key).distinct().join(rows.select(key), key, "left_anti").withColumn("change", F.lit("touched")))
    for prefix in excluded:
        rows = rows.filter(~F.startswith(F.col(key), F.lit(prefix)))
    return rows


def log_ids(logs: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """resolve_ids() for logs(project, path, content_hash): a log is known by its project and path; new ids are l-00001 onward in their order."""
    rows = logs.withColumn("fingerprint", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x00", "project", "path"), 256))).withColumn("explicit_id", F.lit(None).cast("string"))
    return resolve_ids(rows, ledger, "l-")


def rename_match(new: DataFrame, old: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """new_id, old_id, jaccard, unsure of new(id, keys, text) that are old(id, keys, text, status) under another title.

    Both have the same keys (null-safe), old is active, and the sets of their normalized words have a Jaccard of at least
    `least`. Pairs are taken one to one, the most alike first, ties by the smaller ids: in rounds, every pair that is the
    best for both of its sides, until none is left. unsure marks those within 0.05 of the bound. Where a side of a block has
    at most FEW rows, all pairs of the block meet, and the sets move once. In larger blocks the rarest words of each set
    meet, so many that one of a similar set must be among them: a block of any size makes no pairs beyond these.
    """
    with tables(new.sparkSession) as scope:
        block = F.concat_ws("\x00", *(F.coalesce(F.col(k).cast("string"), F.lit("\x01")) for k in keys))
        sides = {"new": new.withColumn("_block", block), "old": old.filter("status = 'active'").withColumn("_block", block)}
        counts = reduce(DataFrame.unionByName, [df.select(F.col("_block").alias("block"), F.lit(name).alias("side")) for name, df in sides.items()]).groupBy("block").agg(*(F.count_if(F.col("side") == name).alias(name) for name in sides))
        large = stored(counts.filter(F.least(*sides) > FEW).select("block"), "large-blocks")
        some_large = large.limit(1).count() > 0
        # as one string: an array of them takes three times the room
        words = lambda name: sides[name].select(F.col("_block").alias("block"), F.col("id").alias(f"{name}_id"), F.array_join(token_set(F.col("text")), " ").alias(f"{name}_words"))
        rest = lambda df: df.join(large, "block", "left_anti") if some_large else df
        split = lambda c: F.split(c, " ").alias(c)
        pairs = rest(words("new")).join(rest(words("old")), "block").filter("new_words <> '' and old_words <> ''").select("new_id", "old_id", split("new_words"), split("old_words"))
        if some_large:
            pairs = pairs.unionByName(_pairs_by_words({name: words(name).join(large, "block", "left_semi") for name in sides}, least))
        both = F.size(F.array_intersect("new_words", "old_words"))
        jaccard = both / (F.size("new_words") + F.size("old_words") - both)
        left = stored(pairs.select("new_id", "old_id", jaccard.alias("jaccard")).filter((F.col("jaccard") >= least) & (F.col("jaccard") > 0)), "rename-pairs")
        taken = left.limit(0)
        while left.limit(1).count():
            best = lambda side, other: F.row_number().over(W.partitionBy(side).orderBy(F.desc("jaccard"), other))
            won = stored(left.withColumn("a", best("new_id", "old_id")).withColumn("b", best("old_id", "new_id")).filter("a = 1 and b = 1").drop("a", "b"), "renamed")
            if not won.limit(1).count():  # only ties in a ring: the smallest ids break it
                won = stored(left.orderBy(F.desc("jaccard"), "new_id", "old_id").limit(1), "renamed")
            taken = taken.unionByName(won)
            left = stored(left.join(won.select("new_id"), "new_id", "left_anti").join(won.select("old_id"), "old_id", "left_anti"), "rename-pairs")
        return scope.keep(taken.withColumn("unsure", F.col("jaccard") < round(least + 0.05, 12)), "renames")  # 0.8 + 0.05 is above 0.85


def _pairs_by_words(sides: dict[str, DataFrame], least: float) -> DataFrame:
    """new_id, old_id, new_words, old_words of the pairs that share one of their rarest words, of sides new and old (block, id and words of each)."""
    held = {name: stored(df.select("block", f"{name}_id", F.split(f"{name}_words", " ").alias(f"{name}_words")).filter(f"{name}_words <> array('')"), f"{name}-words") for name, df in sides.items()}
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("side"), F.col(f"{name}_id").alias("id"), "block", F.size(f"{name}_words").alias("n"), F.explode(f"{name}_words").alias("w")) for name, df in held.items()])
    df = stored(rows.groupBy("block", "w").agg(F.count("*").alias("df")), "word-counts")
    place = F.row_number().over(W.partitionBy("side", "id").orderBy("df", "w"))
    first = rows.join(df, ["block", "w"]).withColumn("k", place).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1)
    side = lambda name: first.filter(F.col("side") == name).select("block", "w", F.col("id").alias(f"{name}_id"))
    pairs = side("new").join(side("old"), ["block", "w"]).select("new_id", "old_id").distinct()
    return pairs.join(held["new"].drop("block"), "new_id").join(held["old"].drop("block"), "old_id").select("new_id", "old_id", "new_words", "old_words")


def committed_paths(log: DataFrame, since: Column, tree: DataFrame) -> DataFrame:
    """Paths of log(path, ts) from since that the tree's delta also holds."""
    return log.filter(F.col("ts") >= since).select("path").intersect(tree.select("path"))


def edge_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """entry, slug, change (added or removed)."""
    cols = ["entry", "slug"]
    added = current.select(*cols).exceptAll(baseline.select(*cols)).withColumn("change", F.lit("added"))
    return added.unionByName(baseline.select(*cols).exceptAll(current.select(*cols)).withColumn("change", F.lit("removed")))


def mass_new_links(current: DataFrame, baseline: DataFrame, limit: int = 50) -> DataFrame:
    """trigger, n_entries of triggers that newly link more than limit entries, against the baseline."""
    added = current.select("entry", "slug", "trigger").join(baseline.select("entry", "slug"), ["entry", "slug"], "left_anti").filter("trigger is not null")
    return added.groupBy("trigger").agg(F.countDistinct("entry").alias("n_entries")).filter(F.col("n_entries") > limit)


def dedupe(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def union_recovered(static: DataFrame, recovered: DataFrame) -> DataFrame:
    """path, origin: both, by canonical path (no './', no double slashes); a path that both have counts as static."""
    canonical = lambda df: df.select(F.regexp_replace(F.regexp_replace("path", "/+", "/"), r"^\./", "").alias("path")).distinct()
    a, b = canonical(static), canonical(recovered)
    return a.withColumn("origin", F.lit("static")).unionByName(b.join(a, "path", "left_anti").withColumn("origin", F.lit("recovered")))


def recover_unique_basename(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """ref, path: references resolved because their base name is unique in listing(path)."""
    base = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    unique = listing.groupBy(base(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1").drop("n")
    return refs.select("ref", base(F.col("ref")).alias("name")).join(unique, "name").select("ref", "path")
