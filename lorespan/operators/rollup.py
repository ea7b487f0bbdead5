"""Roll-ups of entries, concepts, findings, sessions and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions.text import stage_of, topic_of

#: Fixed values, strongest first.
STATUS_ORDER = ("contradicted", "robust", "supported", "preliminary")


def effective_status(concepts: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """slug, status, n_entries, n_families, effective: curated singletons stay, two entries of two families confirm, else candidate."""
    seen = edges.join(entries.select(F.col("id").alias("entry"), "family"), "entry").groupBy("slug").agg(F.countDistinct("entry").alias("n_entries"), F.countDistinct("family").alias("n_families"))
    out = concepts.select("slug", "status").join(seen, "slug", "left").fillna(0, ["n_entries", "n_families"])
    confirmed = (F.col("n_entries") >= 2) & (F.col("n_families") >= 2)
    return out.withColumn("effective", F.when(F.col("status") == "curated_singleton", "curated_singleton").when(confirmed, "confirmed").otherwise("candidate"))


def cross_family_concepts(status: DataFrame, edges: DataFrame, entries: DataFrame, examples: int = 3) -> DataFrame:
    """slug, span, n_entries, families, projects ('name: count', by name), example_ids, titles of confirmed concepts; examples are the first by project, title and id."""
    rows = edges.join(status.filter("effective = 'confirmed'").select("slug"), "slug", "left_semi").select("slug", "entry").distinct().join(entries.select(F.col("id").alias("entry"), "family", "project_id", "title"), "entry")
    top = rows.withColumn("k", F.row_number().over(W.partitionBy("slug").orderBy("project_id", "title", "entry"))).filter(F.col("k") <= examples)
    ordered = F.array_sort(F.collect_list(F.struct("k", "entry", "title")))
    top = top.groupBy("slug").agg(F.array_join(F.transform(ordered, lambda x: x["entry"].cast("string")), ",").alias("example_ids"), F.array_join(F.transform(ordered, lambda x: x["title"]), " | ").alias("titles"))
    spans = rows.groupBy("slug").agg(F.countDistinct("family").alias("span"), F.countDistinct("entry").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    counts = rows.groupBy("slug", "project_id").agg(F.count("*").alias("n")).groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list(F.concat("project_id", F.lit(": "), "n"))), ", ").alias("projects"))
    return spans.join(counts, "slug").join(top, "slug")


def with_stage(entries: DataFrame, curated: DataFrame | None = None) -> DataFrame:
    """entries(id, path, title, tags) with stage and stage_source: what curated(id, stage) says, else by path and keywords."""
    out = entries.withColumn("_s", stage_of(F.col("path"), F.col("title"), F.col("tags")))
    if curated is None:
        return out.select(*entries.columns, "_s.stage", "_s.stage_source")
    out = out.join(curated.select("id", F.col("stage").alias("_c")), "id", "left")
    return out.select(*entries.columns, F.coalesce("_c", "_s.stage").alias("stage"), F.when(F.col("_c").isNotNull(), "curated").otherwise(F.col("_s.stage_source")).alias("stage_source"))


def lifecycle_matrix(entries: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """project_id and a count for each stage, in fixed order."""
    return entries.groupBy("project_id").pivot("stage", list(stages)).agg(F.count(F.lit(1))).fillna(0)


def elevation_ladder(status: DataFrame, edges: DataFrame) -> DataFrame:
    """slug, effective, n_edges; concepts without edges have 0."""
    return status.select("slug", "effective").join(edges.groupBy("slug").agg(F.count("*").alias("n_edges")), "slug", "left").fillna(0, ["n_edges"])


def stale_concepts(status: DataFrame) -> DataFrame:
    """Concepts called confirmed whose evidence no longer confirms them."""
    return status.filter("status = 'confirmed' and effective = 'candidate'")


def status_rank(status: Column) -> Column:
    out = F
    for k, name in enumerate(STATUS_ORDER):
        out = out.when(status == name, k)
    return out.otherwise(len(STATUS_ORDER))


def topic_rollup(findings: DataFrame) -> DataFrame:
    """topic, n_projects, n_findings, n_open, strongest, description (the first by project that is not empty) of findings(topic, project, status, n_findings, n_open, description)."""
    said = F.nullif(F.trim("description"), F.lit("")) if "description" in findings.columns else F.lit(None).cast("string")
    return findings.groupBy("topic").agg(F.countDistinct("project").alias("n_projects"), F.sum("n_findings").alias("n_findings"), F.sum("n_open").alias("n_open"), F.min_by("status", status_rank(F.col("status"))).alias("strongest"), F.min_by(said, F.when(said.isNotNull(), F.struct("project", said))).alias("description"))


def stale_topics(files: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Topics of files(topic, mtime) whose newest file is at least days old."""
    return files.groupBy("topic").agg(F.max("mtime").alias("newest")).filter(F.datediff(now, "newest") >= days)


def tag_clusters(entries: DataFrame, least: int = 2, top: int = 6, last: int = 5) -> DataFrame:
    """tag, n_entries, last_ids: the top most frequent tags with at least `least` entries, and their last ids."""
    rows = entries.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    counts = rows.groupBy("tag").agg(F.count("*").alias("n_entries")).filter(F.col("n_entries") >= least).orderBy(F.desc("n_entries"), "tag").limit(top)
    recent = rows.join(counts, "tag").withColumn("k", F.row_number().over(W.partitionBy("tag").orderBy(F.desc("id")))).filter(F.col("k") <= last)
    return recent.groupBy("tag", "n_entries").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("last_ids"))


def inverted_index(entries: DataFrame) -> DataFrame:
    """tag, id: one row for each, so that no tag's list grows in one row."""
    return entries.select(F.explode(F.array_distinct("tags")).alias("tag"), "id")


def quick_reference(entries: DataFrame, logs: DataFrame | None = None, large: int = 500, shown: int = 5) -> DataFrame:
    """path, n_entries, n_lines, is_large, updated, topics (cleaned titles of the first entries) of each file; with logs(project_id) also n_logs of its project."""
    lines = F.size(F.split("body", "\n"))
    out = entries.groupBy("path").agg(F.count("*").alias("n_entries"), F.sum(lines).cast("long").alias("n_lines"), (F.sum(lines) > large).alias("is_large"), F.max("date").alias("updated"), F.min("project_id").alias("_p"))
    first = entries.withColumn("_k", F.row_number().over(W.partitionBy("path").orderBy("id"))).filter(F.col("_k") <= shown)
    topics = first.groupBy("path").agg(F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("_k", topic_of(F.col("title")).alias("t")))), lambda x: x["t"]), lambda t: t.isNotNull()), " | ").alias("topics"))
    out = out.join(topics, "path")
    if logs is not None:
        out = out.join(logs.groupBy(F.col("project_id").alias("_p")).agg(F.count("*").alias("n_logs")), "_p", "left").fillna(0, ["n_logs"])
    return out.drop("_p")


def findings_summary(findings: DataFrame, shown: int = 5) -> DataFrame:
    """project, n_findings, n_topics, updated, topics of findings(project, topic, text, changed), a row for each topic's file.

    Findings are the second-level headings with an id (F-). topics names the last changed ones (ties by name) and how many more.
    """
    own = findings.select("project", "topic", "changed", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda x: F.startswith(x, F.lit("## F-")))).alias("n"))
    rows = own.withColumn("k", F.row_number().over(W.partitionBy("project").orderBy(F.desc_nulls_last("changed"), "topic")))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", "topic")))), lambda x: x["topic"]), ", ")  # nulls are not collected
    out = rows.groupBy("project").agg(F.sum("n").alias("n_findings"), F.count("*").alias("n_topics"), F.date_format(F.max("changed"), "yyyy-MM-dd").alias("updated"), first.alias("topics"))
    more = F.when(F.col("n_topics") > shown, F.concat(F.lit(", +"), F.col("n_topics") - shown, F.lit(" more"))).otherwise("")
    return out.withColumn("topics", F.concat("topics", more))


def session_stats(events: DataFrame, shown: int = 3) -> DataFrame:
    """session, minutes, n_files, files of events(session, ts, path): the first names and how many more."""
    stats = events.groupBy("session").agg(F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60_000_000).alias("minutes"), F.countDistinct("path").alias("n_files"))
    names = events.select("session", "path").distinct().withColumn("k", F.row_number().over(W.partitionBy("session").orderBy("path"))).filter(F.col("k") <= shown)
    names = names.groupBy("session").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("first"))
    more = F.when(F.col("n_files") > shown, F.concat(F.lit(" (+"), F.col("n_files") - shown, F.lit(" more)"))).otherwise("")
    return stats.join(names, "session").select("session", "minutes", "n_files", F.concat("first", more).alias("files"))


def synthesize_findings(findings: DataFrame) -> DataFrame:
    """Of findings(file, line, category, agent, severity, confidence) on one spot the surest; major and unsure becomes minor; minor by several agents is a candidate to promote."""
    spot = ["file", "line", "category"]
    best = findings.withColumn("k", F.row_number().over(W.partitionBy(*spot).orderBy(F.desc("confidence"), "agent"))).filter("k = 1").drop("k")
    agents = findings.groupBy(*spot).agg(F.countDistinct("agent").alias("n_agents"))
    out = best.join(agents, spot).withColumn("severity", F.when((F.col("severity") == "major") & (F.col("confidence") < 0.5), "minor").otherwise(F.col("severity")))
    return out.withColumn("promote", (F.col("severity") == "minor") & (F.col("n_agents") > 1))


def read_telemetry(reads: DataFrame) -> DataFrame:
    """path, day, n of reads(path, ts)."""
    return reads.groupBy("path", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def corpus_summary(entries: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """One row: how many entries of each kind, and the newest date; with sessions(name, date) also how many, and the last one's name and date."""
    of = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    out = entries.agg(*(of(k) for k in ("learning", "decision", "finding", "convention")), F.max("date").alias("newest"), F.count("*").alias("n_entries"))
    if sessions is not None:
        last = F.max(F.struct("date", "name"))
        out = out.crossJoin(sessions.agg(F.count("*").alias("n_sessions"), last["name"].alias("last_session"), last["date"].alias("last_date")))  # a row each
    return out


def projected_coverage(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """total, connected, pct (one decimal; 0 when empty)."""
    linked = edges.select(F.col("entry").alias("id")).distinct().withColumn("on", F.lit(1))
    return entries.join(linked, "id", "left").agg(F.count("*").alias("total"), F.count("on").alias("connected")).withColumn("pct", F.when(F.col("total") > 0, F.round(100 * F.col("connected") / F.col("total"), 1)).otherwise(F.lit(0.0)))


def projected_gain(entries: DataFrame, edges: DataFrame, summaries: DataFrame) -> DataFrame:
    """total, connected, pct, and what clusters of summaries(size, families) of unlinked entries would add: absorbed and projected share of all clusters, and of those of two families and more."""
    x = projected_coverage(entries, edges)
    across = F.size("families") >= 2
    add = summaries.agg(F.count("*").alias("n_clusters"), F.count_if(across).alias("n_across"), F.coalesce(F.sum("size"), F.lit(0)).alias("absorbed"), F.coalesce(F.sum(F.when(across, F.col("size"))), F.lit(0)).alias("absorbed_across"))
    share = lambda n: F.when(F.col("total") > 0, F.round(100 * (F.col("connected") + n) / F.col("total"), 1)).otherwise(F.lit(0.0))
    return x.crossJoin(add).select(*x.columns, *add.columns, share(F.col("absorbed")).alias("pct_all"), share(F.col("absorbed_across")).alias("pct_across"))  # a row each


def crystallization_candidates(edges: DataFrame, entries: DataFrame, least: int = 3, families: int = 2) -> DataFrame:
    """kind, name, n_entries, n_families: concepts with enough entries over enough families, and tags of enough learnings, over any families."""
    rows = edges.join(entries.select(F.col("id").alias("entry"), "family"), "entry").select(F.lit("concept").alias("kind"), F.col("slug").alias("name"), "entry", "family")
    tags = entries.filter("kind = 'learning'").select(F.lit("tag").alias("kind"), F.explode(F.array_distinct("tags")).alias("name"), F.col("id").alias("entry"), "family")
    out = rows.unionByName(tags).groupBy("kind", "name").agg(F.countDistinct("entry").alias("n_entries"), F.countDistinct("family").alias("n_families"))
    return out.filter((F.col("n_entries") >= least) & ((F.col("kind") == "tag") | (F.col("n_families") >= families)))


def lineage_manifest(events: DataFrame) -> DataFrame:
    """One row for each session of events(session, ts, seq, agent, exit_code, wall_s, script, inputs, outputs).

    Missing agents are 'main'. total_wall is null when nothing was timed, and rounded half to even. inputs, outputs and
    scripts list each once, in the order in which they first came; first_script is that of the earliest event. If events
    has git_sha or warnings, the first sha and the distinct warnings are there too. Scripts without a name that have a
    script_sha256 (source given on the command line) are named by it. Each value's first place is found before a
    session's lists are put together, so a task holds what is different in a session and not all its events.
    """
    if "script_sha256" in events.columns:
        events = events.withColumn("script", F.coalesce("script", F.concat(F.lit("(inline "), F.substring("script_sha256", 1, 12), F.lit(")"))))
    base = events.groupBy("session").agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_actions"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("agent", F.lit("main")))), ",").alias("agents"),
        F.count("wall_s").alias("n_timed"), F.bround(F.sum("wall_s"), 3).alias("total_wall"),
        F.count_if(F.col("exit_code") == 0).alias("n_passed"), F.count_if(F.col("exit_code") != 0).alias("n_failed"), F.count_if(F.col("exit_code").isNull()).alias("n_unknown"),
        F.min_by("script", F.struct("ts", "seq")).alias("first_script"),
    )

    def once(values: Column, name: str) -> DataFrame:
        each = events.select("session", "ts", "seq", F.posexplode(values).alias("j", "x")).filter("x is not null")
        first = each.groupBy("session", "x").agg(F.min(F.struct("ts", "seq", "j")).alias("at"))
        return first.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias(name))

    more = []
    if "git_sha" in events.columns:
        more.append(F.min_by("git_sha", F.when(F.col("git_sha").isNotNull(), F.struct("ts", "seq"))).alias("git_sha"))
    if "warnings" in events.columns:
        found = events.select("session", F.explode("warnings").alias("x")).filter("x is not null").groupBy("session").agg(F.array_sort(F.collect_set("x")).alias("warnings"))
    rows = base if not more else base.join(events.groupBy("session").agg(*more), "session")
    lists = [once(F.col("inputs"), "inputs"), once(F.col("outputs"), "outputs"), once(F.array("script"), "scripts"), *([found] if "warnings" in events.columns else [])]
    for part in lists:
        name = part.columns[1]
        rows = rows.join(part, "session", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return rows.select("*", F.size("inputs").cast("long").alias("n_inputs"), F.size("outputs").cast("long").alias("n_outputs"))


def recent(entries: DataFrame, n: int = 10) -> DataFrame:
    return entries.orderBy(F.col("date").desc_nulls_last(), "path", "id").limit(n)


def recall(entries: DataFrame, tags: tuple[str, ...] = (), ids: tuple[int, ...] = (), since: str | None = None, path: str | None = None, n: int = 20) -> DataFrame:
    """Any of tags (case ignored), any of ids, dates from since (undated ones drop), one path; newest first."""
    out = entries
    if tags:
        out = out.filter(F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*(F.lit(t.lower()) for t in tags))))
    if ids:
        out = out.filter(F.col("id").isin(*ids))
    if since:
        out = out.filter(F.col("date") >= since)
    if path:
        out = out.filter(F.col("path") == path)
    return out.orderBy(F.col("date").desc_nulls_last(), "path", "id").limit(n)


def last_n_per_group(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= n)
