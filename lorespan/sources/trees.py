"""File trees as tables, and tables as canonical text."""

from __future__ import annotations

import json
import os
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.sources.folders import stored, tables

#: Schema of a line of an event log.
FILE = "STRUCT<path: STRING, sha256: STRING, size_bytes: BIGINT, n_rows: BIGINT>"
EVENT_SCHEMA = f"ts STRING, agent_id STRING, agent_type STRING, bash_cmd STRING, bash_exit INT, bash_wall_s DOUBLE, script STRING, script_sha256 STRING, script_source STRING, git_sha STRING, inputs ARRAY<{FILE}>, outputs ARRAY<{FILE}>, io_detection STRING, lineage_warnings ARRAY<STRING>, filters_detected ARRAY<STRING>, seeds_detected ARRAY<BIGINT>, session_id STRING"
#: Files above this size get no hash.
HASH_LIMIT = 100 * 1024 * 1024


#: Files and folders of a `.living` folder that hold no entries, and files that hold many.
NO_ENTRIES = ("INDEX.md", "MENU.md", "LOG_REGISTRY.md", "FINDINGS_REGISTRY.md", "last-session.md")
NO_ENTRY_FOLDERS = ("generated-conventions", "graph")
AGGREGATES = (("learnings.md", "learning"), ("decisions.md", "decision"), ("findings.md", "finding"))
#: Folders whose files are an entry each, with its kind and shape.
FOLDERS = (("learnings", "learning", "per_entry_file"), ("findings", "finding", "standalone_finding_file"), ("decisions", "decision", "per_entry_file"))


def classify(rel: Column) -> Column:
    """kind and shape of a file by its path within its `.living` folder; null where it holds no entries."""
    parts = F.split(rel, "/")
    name, top = F.element_at(parts, -1), F.get(parts, F.lit(0))
    pair = lambda kind, shape: F.struct(F.lit(kind).alias("kind"), F.lit(shape).alias("shape"))
    gone = ~F.endswith(name, F.lit(".md")) | name.isin(*NO_ENTRIES) | F.endswith(name, F.lit("_MANIFEST.md")) | top.isin(*NO_ENTRY_FOLDERS, "log") | F.array_contains(parts, "generated-conventions") | F.array_contains(parts, ".living")
    out = F.when(gone, None).when(name == "conventions.md", pair("convention", "aggregate_section"))
    for file, kind in AGGREGATES:
        out = out.when(rel == file, pair(kind, "aggregate_section"))
    for folder, kind, shape in FOLDERS:
        out = out.when((top == folder) & (F.size(parts) > 1), pair(kind, shape))
    return out


def inclusion_flags(files: DataFrame, projects: DataFrame | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """files(path) with project, rel (within the project's `.living` folder), kind, shape, included.

    Included are files that hold entries, of projects(project, has_living) that have such a folder if projects are given,
    and of the asked kinds if there are any. Files outside of every `.living` folder are not.
    """
    living = F.instr("path", "/.living/")
    rel = F.when(living > 0, F.expr("substring(path, instr(path, '/.living/') + 9)"))
    df = files.withColumn("rel", rel).withColumn("project", F.when(living > 0, F.expr("substring(path, 1, instr(path, '/.living/') - 1)"))).withColumn("_c", F.when(F.col("rel").isNotNull(), classify(F.col("rel"))))
    df = df.select(*files.columns, "project", "rel", "_c.kind", "_c.shape")
    on = F.col("kind").isNotNull()
    if kinds:
        on = on & F.col("kind").isin(*kinds)
    if projects is None:
        return df.withColumn("included", on)
    df = df.join(projects.select("project", F.col("has_living").alias("_has")), "project", "left")
    return df.withColumn("included", on & F.coalesce("_has", F.lit(False))).drop("_has")


def _open(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, as tasks open it, and the root's path there."""
    store, at = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
    return store, at.rstrip("/")


#: Bytes of files that a task reads, about, and rows of a listing that travel together.
READ_BYTES, LISTED = 32 << 20, 10_000
_LISTING = "path string, inside boolean, hidden boolean, folder boolean, bytes long"


def tree_files(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """path (below the root, beginning with a slash) and bytes of the files under root whose names end with suffix, as a stored table.

    Folders are listed level by level, each level's folders dealt to tasks: the driver sees their number alone. `.living`
    folders are entered wherever they lie, but for those within another one; names that begin with a dot or an underscore
    are passed over elsewhere, and within a `.living` folder. Linked folders of a local file system are not followed.
    """
    store, at = _open(root)
    local = isinstance(store, fs.LocalFileSystem)

    def listing(rows):
        for batch in rows:
            for path, inside, hidden in zip(*(batch.column(k).to_pylist() for k in ("path", "inside", "hidden")), strict=True):
                out = []
                for info in store.get_file_info(fs.FileSelector(f"{at}{path}/")):
                    name, folder = info.base_name, info.type == fs.FileType.Directory
                    dark = name.startswith((".", "_"))
                    living = name == ".living"
                    if folder and not (inside and dark) and not (local and os.path.islink(f"{at}{path}/{name}")):
                        out.append((f"{path}/{name}", inside or living, not (inside or living) and (hidden or dark), True, 0))
                    elif info.type == fs.FileType.File and name.endswith(suffix) and not (hidden or dark):
                        out.append((f"{path}/{name}", inside, hidden, False, info.size))
                for k in range(0, len(out), LISTED):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + LISTED], strict=True), types, strict=True)], names=names)

    types, names = (pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64()), [c.split(" ")[0] for c in _LISTING.split(", ")]
    tasks = 4 * spark.sparkContext.defaultParallelism
    level, n, levels = spark.createDataFrame([("", False, False, True, 0)], _LISTING), 1, []
    with tables(spark) as scope:
        while n:
            level = stored(level.repartition(min(n, tasks), "path").mapInArrow(listing, _LISTING), "level")
            levels.append(level.filter("NOT folder"))
            level = level.filter("folder")
            n = level.count()
        return scope.keep(reduce(DataFrame.unionByName, levels).select("path", "bytes"), "files")


def tree_texts(spark: SparkSession, root: str, suffix: str = ".md") -> DataFrame:
    """path and text of the files of tree_files(), read in tasks that share the bytes, a file at a time; bytes that aren't UTF-8 become replacement marks."""
    files, (store, at) = tree_files(spark, root, suffix), _open(root)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).head()

    def read(rows):
        for batch in rows:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{at}{path}") as f:
                    text = f.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text])], names=["path", "text"])

    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))))
    return files.select("path").repartition(tasks, "path").mapInArrow(read, "path string, text string")


def scan_entries(spark: SparkSession, *roots: str) -> DataFrame:
    """path, project, rel, name, kind, shape, text of the Markdown files with entries under the roots.

    Files in a `.living` folder go by their place in it (classify()); project is the folder that holds it, below the root.
    Files of a plain tree, outside of every such folder, go by names and folders alone; its hidden folders and manifests
    are left out.
    """
    each = (tree_texts(spark, root).select(F.concat(F.lit(file_prefix(root)), "path").alias("path"), "text", F.col("path").alias("_in")) for root in roots)
    files = reduce(DataFrame.unionByName, each)
    living = inclusion_flags(files.withColumnRenamed("path", "_path").withColumnRenamed("_in", "path")).filter("included").select(F.col("_path").alias("path"), F.regexp_replace("project", "^/+", "").alias("project"), "rel", "kind", "shape", "text")
    plain = files.filter(~F.contains("_in", F.lit("/.living/")) & ~F.regexp_like("_in", F.lit(r"/\.[^/]+/")) & ~F.endswith("path", F.lit("_MANIFEST.md")))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(F.contains("_in", F.lit("/findings/")), "finding").when(name.startswith("learnings"), "learning").when(name.startswith("decisions"), "decision").when(F.contains("_in", F.lit("/conventions/")), "convention").otherwise("other")
    plain = plain.withColumn("kind", kind).select("path", F.lit(None).cast("string").alias("project"), F.regexp_replace("_in", "^/", "").alias("rel"), "kind", F.when(F.col("kind").isin("finding", "convention"), "whole_file").otherwise("register").alias("shape"), "text")
    return living.unionByName(plain).withColumn("name", name)


def file_prefix(root: str) -> str:
    """A root as file paths begin with it."""
    bare = root.rstrip("/")
    return bare if "://" in bare else f"file://{bare.removeprefix('file:')}"


def scan_logs(spark: SparkSession, root: str, least: int = 150) -> DataFrame:
    """path, date, seq, text of log files named <date>[-<number>]...; bodies shorter than least drop."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    seq = F.nullif(F.regexp_extract(name, r"^\d{4}-\d{2}-\d{2}[-_](\d+)", 1), F.lit("")).cast("int")
    return df.select("path", F.nullif(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("date"), seq.alias("seq"), "text").filter(F.length(F.trim("text")) >= least)


def write_tree(files: DataFrame, root: str) -> None:
    """Writes files(path, text) as files below root, a task its own rows; paths are relative. A repeated task writes the same again."""
    store, at = _open(root)

    def run(rows):
        n = 0
        for batch in rows:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                where = f"{at}/{path}"
                store.create_dir(where.rpartition("/")[0], recursive=True)
                with store.open_output_stream(where) as out:
                    out.write((text or "").encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    files.select("path", "text").mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number


def read_lineage_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, warnings): JSON lines by schema; lines that are no JSON object or have no ts are warnings, blank lines nothing."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json("value", f"{EVENT_SCHEMA}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull() | ~F.startswith(F.trim("value"), F.lit("{"))
    warn = F.when(bad, "not a JSON object").when(F.col("e.ts").isNull(), "no ts")
    none = F.array().cast(f"array<{FILE}>")
    ok = lines.filter(warn.isNull()).select("e.*").drop("_bad")
    io = F.when((F.size(F.coalesce("inputs", none)) > 0) | (F.size(F.coalesce("outputs", none)) > 0), "detected").otherwise("none")
    events = ok.withColumns({"inputs": F.coalesce("inputs", none), "outputs": F.coalesce("outputs", none), "io_detection": F.coalesce("io_detection", io), "agent_id": F.coalesce("agent_id", F.lit("main"))})
    return events, lines.filter(warn.isNotNull()).select("value", warn.alias("warning"))


def fingerprint_files(spark: SparkSession, path: str, declared: DataFrame | None = None, limit: int = HASH_LIMIT) -> DataFrame:
    """path, size_bytes, sha256 (null above limit, '_missing' for declared(path) files that are not there)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= limit).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    out = small.unionByName(files.filter(F.col("length") > limit).select("path", F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("sha256")))
    if declared is not None:
        # one spelling of local paths, whatever the number of slashes
        gone = declared.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path")).join(out, "path", "left_anti")
        out = out.unionByName(gone.select("path", F.lit(None).cast("long").alias("size_bytes"), F.lit("_missing").alias("sha256")))
    return out


def row_counts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """path and n_rows of the parquet, csv or tsv files under path."""
    reader = spark.read.option("recursiveFileLookup", "true")
    df = reader.parquet(path) if kind == "parquet" else reader.option("header", "true").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))


def parse_pipe_table(lines: DataFrame) -> DataFrame:
    """doc, pos, cells of the rows of pipe tables in lines(doc, pos, line): separators, the headers above them and ragged rows go."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc").orderBy("pos")
    rows = lines.filter(F.regexp_like(F.trim("line"), F.lit(r"^\|.*\|$")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells).withColumn("sep", F.forall("cells", lambda c: F.regexp_like(c, F.lit("^:?-+:?$"))))
    rows = rows.withColumn("head", F.coalesce(F.lead("sep").over(w), F.lit(False))).withColumn("width", F.last(F.when(F.col("head"), F.size("cells")), ignorenulls=True).over(w))
    return rows.filter(~F.col("sep") & ~F.col("head") & (F.size("cells") == F.col("width"))).select("doc", "pos", "cells")


def canonical_json(df: DataFrame) -> DataFrame:
    """json: a line for each row, fields in name order, null fields kept; sorted globally."""
    cols = sorted(df.columns)
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json")).orderBy("json")


def graph_lines(tables: dict[str, DataFrame], version: int = 1) -> DataFrame:
    """part, json: all tables of a graph as one artefact of canonical lines, by part and line, headed by its schema version.

    The same rows give the same lines, whatever their order; nothing else, such as a time, is in it.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = spark.createDataFrame([("", json.dumps({"parts": sorted(tables), "schema_version": version}, sort_keys=True, separators=(",", ":")))], "part string, json string")
    for name, df in sorted(tables.items()):
        rows = rows.unionByName(df.select(F.lit(name).alias("part"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json")))
    return rows.orderBy("part", "json")


def write_graph(tables: dict[str, DataFrame], path: str, version: int = 1) -> None:
    """graph_lines() as text files in order."""
    graph_lines(tables, version).select(F.concat_ws("\t", "part", "json").alias("value")).write.mode("overwrite").text(path)


def declared_but_missing(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Of declared(path): the ones that files(path, size) lacks, or has empty."""
    there = files.filter(F.col("size") > 0).select("path")
    return declared.select("path").join(there, "path", "left_anti")


#: What a registry's columns may hold.
MODES, STATUSES, ACTIONS = ("alias", "keyword", "hybrid"), ("candidate", "confirmed", "curated_singleton"), ("force", "block")


def load_registry(concepts: DataFrame, projects: DataFrame, overrides: DataFrame | None = None, version: int = 1) -> DataFrame:
    """error, subject of each fault; the caller decides whether to go on.

    concepts(slug, label, definition, status, match_mode): slugs that are no slugs or repeat, labels and definitions that
    are missing, unknown statuses and modes. projects(id, name, path, family, has_living): missing fields, ids and
    resolved paths that repeat. overrides(entry, slug, action): unknown actions, and concepts that are not there. A column
    schema_version of any of them must be version throughout.
    """
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    one = lambda df, cond, name, c: df.filter(cond).select(F.lit(name).alias("error"), F.col(c).cast("string").alias("subject"))
    twice = lambda df, c, name: df.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("error"), F.col(c).cast("string").alias("subject"))
    known = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"(^|/)(\./)+", "$1"), r"[^/]+/\.\./", ""), "/+$", "")
    out = [
        one(concepts, ~F.coalesce(F.regexp_like("slug", F.lit(r"^[a-z0-9][a-z0-9-]*$")), F.lit(False)), "bad_slug", "slug"),
        *(one(concepts, empty(c), f"no_{c}", "slug") for c in ("label", "definition") if c in concepts.columns),
        *([one(concepts, known("status", STATUSES), "bad_status", "slug")] if "status" in concepts.columns else []),
        one(concepts, known("match_mode", MODES), "bad_mode", "slug"), twice(concepts, "slug", "duplicate_slug"),
        *(one(projects, F.col(c).isNull(), f"no_{c}", "id") for c in ("name", "path", "family", "has_living") if c in projects.columns),
        twice(projects, "id", "duplicate_project"), twice(projects.filter("path is not null").select(bare.alias("path")), "path", "duplicate_path"),
    ]
    if overrides is not None:
        out += [one(overrides, known("action", ACTIONS), "bad_action", "slug"), one(overrides.join(concepts.select("slug"), "slug", "left_anti"), F.lit(True), "unknown_concept", "slug")]
    for name, df in (("concepts", concepts), ("projects", projects), ("overrides", overrides)):
        if df is not None and "schema_version" in df.columns:
            out.append(df.filter(~F.col("schema_version").eqNullSafe(F.lit(version))).select(F.lit("schema_version").alias("error"), F.lit(name).alias("subject")).distinct())
    return reduce(lambda a, b: a.unionByName(b), out)
