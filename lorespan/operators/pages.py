"""Pages of a knowledge graph, one row each: projects, concepts, entries and logs with their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.functions.text import STAGES


def _listed(df: DataFrame, keys: list[str], order: Column, line: Column, name: str) -> DataFrame:
    """The lines of each key in order, as one text."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("x")))).alias("l"))
    return rows.select(*keys, F.array_join(F.transform("l", lambda r: r["x"]), "\n").alias(name))


def _link(ident: Column, title: Column | None = None) -> Column:
    link = F.concat(F.lit("- [["), ident.cast("string"), F.lit("]]"))
    return link if title is None else F.concat(link, F.lit(" — "), F.coalesce(title, F.lit("")))


def _sections(df: DataFrame, key: str, order: Column, head: Column, lines: str, name: str) -> DataFrame:
    """Sections '## head' with their lines, one after the other."""
    body = F.concat(F.lit("## "), head, F.lit("\n"), F.col(lines), F.lit("\n"))
    return _listed(df, [key], order, body, name)


def _page(kind: str, path: Column, head: list[Column], title: Column, parts: list[Column]) -> list[Column]:
    """kind, path and text: fields between two rules, the title, and the parts that are there."""
    fields = F.concat_ws("\n", F.lit("---"), F.lit(f"type: {kind}"), *head, F.lit("---"), F.lit(""))
    return [F.lit(kind).alias("kind"), path.alias("path"), F.concat_ws("\n", fields, F.concat(F.lit("# "), title), F.lit(""), *parts).alias("text")]


def project_pages(entries: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """A page for each hub(project_id, name, family): its active entries(id, project_id, title, stage, status) by stage, and the concepts that they touch."""
    live = entries.filter("status = 'active'")
    rank = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col("stage"))
    by_stage = _listed(live, ["project_id", "stage"], F.col("id"), _link(F.col("id"), F.col("title")), "lines")
    stages = _sections(by_stage, "project_id", rank, F.initcap(F.replace("stage", F.lit("_"), F.lit(" "))), "lines", "stages")
    touched = edges.join(live.select(F.col("id").alias("entry"), "project_id"), "entry").select("project_id", "slug").distinct()
    touched = _listed(touched, ["project_id"], F.col("slug"), _link(F.col("slug")), "touched")
    rows = hubs.join(stages, "project_id", "left").join(touched, "project_id", "left")
    about = F.when(F.col("touched").isNotNull(), F.concat(F.lit("## Concepts touched\n"), F.col("touched"), F.lit("\n")))
    return rows.select(*_page("project", F.concat(F.lit("projects/"), "project_id", F.lit(".md")), [F.concat(F.lit("family: "), "family")], F.col("name"), [F.col("stages"), about]))


def concept_pages(entries: DataFrame, edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """A page for each of concepts(slug, label, definition, status, effective): its entries by project. Concepts of two families and more are bridges."""
    held = edges.select("entry", "slug").distinct().join(entries.select(F.col("id").alias("entry"), "project_id", "family", "title"), "entry")
    n = held.groupBy("slug").agg(F.countDistinct("family").alias("n_families"))
    by_project = _listed(held, ["slug", "project_id"], F.col("entry"), _link(F.col("entry"), F.col("title")), "lines")
    projects = _sections(by_project, "slug", F.col("project_id"), F.col("project_id"), "lines", "projects")
    rows = concepts.join(n, "slug", "left").join(projects, "slug", "left").fillna(0, ["n_families"])
    bridge = F.col("n_families") >= 2
    folder = F.when(bridge, "bridge").when(F.col("effective") == "candidate", "candidate").otherwise("confirmed")
    badge = F.when(bridge, F.concat(F.lit("**cross-project** — spans "), F.col("n_families"), F.lit(" families\n")))
    head = [F.concat(F.lit("status: "), "status"), F.concat(F.lit("effective_status: "), "effective"), F.concat(F.lit("families: "), "n_families")]
    return rows.select(*_page("concept", F.concat(F.lit("concepts/"), folder, F.lit("/"), "slug", F.lit(".md")), head, F.coalesce("label", "slug"), [F.concat(F.coalesce("definition", F.lit("")), F.lit("\n")), badge, F.col("projects")]))


def entry_pages(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """A page for each active entry: fields, excerpt, and its concepts."""
    about = _listed(edges.select("entry", "slug").distinct(), ["entry"], F.col("slug"), _link(F.col("slug")), "about")
    rows = entries.filter("status = 'active'").join(about.withColumnRenamed("entry", "id"), "id", "left")
    head = [F.concat(F.lit("project: "), "project_id"), F.concat(F.lit("stage: "), "stage"), F.concat(F.lit("date: "), F.coalesce("date", F.lit("undated")))]
    concepts = F.when(F.col("about").isNotNull(), F.concat(F.lit("## Concepts\n"), F.col("about"), F.lit("\n")))
    path = F.concat(F.lit("entries/"), "project_id", F.lit("/"), F.col("id").cast("string"), F.lit(".md"))
    return rows.select(*_page("entry", path, head, F.coalesce("title", F.lit("")), [F.concat(F.coalesce("excerpt", F.lit("")), F.lit("\n")), concepts]))


def log_pages(logs: DataFrame, follows: DataFrame, mentions: DataFrame) -> DataFrame:
    """A page for each of logs(id, project, date, title): the log before it, and the concepts of mentions(id, slug)."""
    said = _listed(mentions.select("id", "slug").distinct(), ["id"], F.col("slug"), _link(F.col("slug")), "said")
    rows = logs.join(follows.select(F.col("from_id").alias("id"), "to_id"), "id", "left").join(said, "id", "left")
    before = F.when(F.col("to_id").isNotNull(), F.concat(F.lit("Follows [["), F.col("to_id").cast("string"), F.lit("]]\n")))
    concepts = F.when(F.col("said").isNotNull(), F.concat(F.lit("## Mentions\n"), F.col("said"), F.lit("\n")))
    path = F.concat(F.lit("logs/"), "project", F.lit("/"), F.col("id").cast("string"), F.lit(".md"))
    return rows.select(*_page("log", path, [F.concat(F.lit("date: "), F.coalesce("date", F.lit("undated")))], F.coalesce("title", F.col("id").cast("string")), [before, concepts]))
