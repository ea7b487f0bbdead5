"""Documents cut to entries by their headings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.functions.text import content_hash, entry_tags, extract_date, heading_title, is_template, macro_name, mitigation_type, topic_of
from lorespan.operators.rollup import STATUS_ORDER, status_rank

#: Fixed value: what marks a heading as the start of an entry: a date, an id, or the word.
SIGNATURE = r"^#{1,6}\s.*(\d{4}-\d{2}-\d{2}|\b[DLF]-?\d+\b|Finding:)"


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _cut(lines: DataFrame, starts: Column) -> DataFrame:
    """id, k, line_start, line_end, heading, body: lines from one start to the next; what stands before the first is left out."""
    k = F.sum(F.when(starts, 1).otherwise(0)).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    parts = lines.withColumn("k", k).filter("k > 0").groupBy("id", "k").agg(F.min("pos").alias("line_start"), F.max("pos").alias("line_end"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return parts.select("id", "k", "line_start", "line_end", F.col("l")[0]["line"].alias("heading"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def split_by_signature(docs: DataFrame) -> DataFrame:
    """Entries of docs(id, text) start at headings with a date, an entry id or 'Finding:'; other headings stay in the body."""
    return _cut(_lines(docs), F.regexp_like("line", F.lit(SIGNATURE)))


def split_by_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    """Entries start at lines with the fixed prefix."""
    return _cut(_lines(docs), F.startswith("line", F.lit(prefix)))


def register_entries(docs: DataFrame, prefix: str = "### ", letter: str = "L") -> DataFrame:
    """Entries of docs(id, text) that start at lines with the prefix: entry (letter and number in file order), title, date, tags (of the first Tags line with any), line_no, body."""
    head = F.trim(F.substring(F.rtrim("heading"), len(prefix) + 1, 1_000_000))
    date = F.nullif(F.regexp_extract(head, r"\[?(\d{4}-\d{2}-\d{2})\]?", 1), F.lit(""))
    title = F.regexp_replace(F.regexp_replace(head, r"\[?\d{4}-\d{2}-\d{2}\]?", ""), r"^[ :\-–—]+|[ :\-–—]+$", "")
    lines = F.slice(F.split("body", "\n"), 2, 1_000_000)
    tags = F.filter(F.transform(lines, _tag_line), lambda t: F.size(t) > 0)
    rows = split_by_prefix(docs, prefix)
    return rows.select("id", F.concat(F.lit(letter), F.lit("-"), F.col("k").cast("string")).alias("entry"), F.coalesce(F.nullif(title, F.lit("")), head).alias("title"), date.alias("date"), F.coalesce(F.get(tags, F.lit(0)), F.array().cast("array<string>")).alias("tags"), (F.col("line_start") + 1).alias("line_no"), F.regexp_replace("body", r"\s+$", "").alias("body"))


def _tag_line(line: Column) -> Column:
    """The tags of a line 'Tags: [a, b]', bold or not, with or without brackets; none of other lines."""
    raw = F.trim(F.regexp_extract(line, r"(?i)^\s*\*{0,2}Tags\*{0,2}:\*{0,2}\s*(.*)$", 1))
    inner = F.when(F.startswith(raw, F.lit("[")) & F.endswith(raw, F.lit("]")), F.substring(raw, 2, 1_000_000)).otherwise(raw)
    inner = F.when(F.startswith(raw, F.lit("[")), F.regexp_replace(inner, r"\]$", "")).otherwise(inner)
    return F.filter(F.transform(F.split(inner, ","), lambda t: F.trim(t)), lambda t: t != "")


def collect_with_legacy(docs: DataFrame) -> DataFrame:
    """register_entries() of '### ' headings, and entries of '## ' headings that begin with a date, as L-legacy-<line>, without tags; each with its mitigation.

    A legacy entry reaches to the next '## ' heading, so it may hold canonical ones.
    """
    canonical = register_entries(docs)
    legacy = register_entries(docs, "## ").join(split_by_prefix(docs, "## ").filter(F.regexp_like("heading", F.lit(r"^## \s*\[?\d{4}-\d{2}-\d{2}\]?"))).select("id", (F.col("line_start") + 1).alias("line_no")), ["id", "line_no"], "left_semi")
    legacy = legacy.withColumn("entry", F.concat(F.lit("L-legacy-"), F.col("line_no").cast("string"))).withColumn("tags", F.array().cast("array<string>"))
    return canonical.unionByName(legacy).withColumn("mitigation", mitigation_type(F.col("body")))


def whole_file_entries(docs: DataFrame) -> DataFrame:
    """One entry for each of docs(id, path, text): title (of the first heading after the front matter, else the file's stem), date (front matter's, else the heading's), tags, line_end, excerpt, content_hash."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n$", ""), "\n")
    df = docs.select("id", "path", lines.alias("lines"))
    closes = F.array_position(F.transform(F.slice("lines", 2, 1_000_000_000), lambda x: F.trim(x) == "---"), True)
    front = F.when((F.trim(F.get("lines", F.lit(0))) == "---") & (closes > 0), closes).otherwise(0).cast("int")
    df = df.withColumn("front", front)
    dates = F.filter(F.transform(F.slice("lines", 2, F.greatest(F.col("front") - 1, F.lit(0))), lambda x: F.regexp_extract(x, r"(?i)^date:\s*(\d{4}-\d{2}-\d{2})", 1)), lambda x: x != "")
    after = F.when(F.col("front") > 0, F.slice("lines", F.col("front") + 2, 1_000_000_000)).otherwise(F.col("lines"))
    heads = F.filter(after, lambda x: F.regexp_like(x, F.lit(r"^#{1,6}\s+")))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    head = F.coalesce(F.trim(F.regexp_replace(F.get(heads, F.lit(0)), r"^#{1,6}\s+", "")), stem)
    df = df.withColumn("head", head).withColumn("own", F.get(dates, F.size(dates) - 1)).withColumn("body", F.regexp_replace(F.array_join("lines", "\n"), r"^\s+|\s+$", ""))
    none = F.coalesce(F.size("lines") == 0, F.lit(True)) | (F.array_join("lines", "") == "")
    return df.select("id", "path", heading_title(F.col("head")).alias("title"), F.coalesce("own", extract_date(F.col("head"))).alias("date"), entry_tags(F.col("lines")).alias("tags"), F.lit(1).alias("line_start"), F.when(none & (F.size("lines") == 1), 0).otherwise(F.size("lines")).alias("line_end"), F.substring("body", 1, 500).alias("excerpt"), content_hash(F.col("body")).alias("content_hash"), is_template(F.col("head"), F.col("body")).alias("template"))


def header_topics(docs: DataFrame, prefixes: tuple[str, ...] = ("### ", "## ")) -> DataFrame:
    """id, n_headers and topics (the first five headers that begin with a prefix, cleaned, empty ones gone)."""
    mine = reduce(lambda a, b: a | b, (F.startswith("line", F.lit(p)) for p in prefixes))
    text = reduce(lambda a, p: a.when(F.startswith("line", F.lit(p)), F.substring("line", len(p) + 1, 1_000_000)), prefixes, F)
    rows = _lines(docs).withColumn("line", F.rtrim("line")).filter(mine).withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("pos")))
    kept = F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("pos", topic_of(text).alias("t")))))
    return rows.groupBy("id").agg(F.count("*").alias("n_headers"), F.filter(F.transform(kept, lambda x: x["t"]), lambda t: t.isNotNull()).alias("topics"))


def findings_registry(docs: DataFrame) -> DataFrame:
    """finding (F-n), number, id, claim, status, implications, tags, last_evidence (of the last ledger row), newest_evidence of each '## F-n' section of docs(id, text).

    A field's last line counts. Ledger rows count after '### Evidence Ledger', as far as the next heading.
    """
    lines = _lines(docs)
    k = F.sum(F.regexp_like("line", F.lit(r"^## F-\d+")).cast("int")).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    ledger = F.last(F.when(F.startswith("line", F.lit("#")), F.startswith("line", F.lit("### Evidence Ledger"))), ignorenulls=True).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("k", k).withColumn("ledger", ledger).filter("k > 0")

    def field(name: str, pattern: str = r"(.*)") -> Column:
        on = F.regexp_like("line", F.lit(rf"^\*\*{name}:\*\*\s*{pattern}"))
        return F.max_by(F.when(on, F.trim(F.regexp_extract("line", rf"^\*\*{name}:\*\*\s*{pattern}", 1))), F.when(on, F.col("pos")))

    dated = F.when(F.col("ledger"), F.nullif(F.regexp_extract("line", r"^\|\s*(\d{4}-\d{2}-\d{2})\s*\|", 1), F.lit("")))
    out = rows.groupBy("id", "k").agg(
        F.min_by(F.regexp_extract("line", r"^## (F-\d+)", 1), "pos").alias("finding"), field("Claim").alias("claim"), F.lower(field("Status", r"(\w+)")).alias("status"), field("Implications").alias("implications"), field("Tags").alias("tags"),
        F.max_by(dated, F.when(dated.isNotNull(), F.col("pos"))).alias("last_evidence"), F.max(dated).alias("newest_evidence"),
    )
    text = lambda c, missing: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(missing)).alias(c)
    return out.select("finding", F.substring("finding", 3, 20).cast("long").alias("number"), "id", text("claim", "(no claim)"), text("status", "preliminary"), text("implications", ""), text("tags", ""), "last_evidence", "newest_evidence")


def finding_counts(docs: DataFrame) -> DataFrame:
    """id, n_findings ('## F-' headings), n_open (bullets under '### Open Questions', as far as the next heading or rule), strongest status of docs(id, text)."""
    lines = _lines(docs)
    head = F.when(F.startswith("line", F.lit("### Open Questions")), F.lit(True)).when(F.startswith("line", F.lit("#")) | F.startswith("line", F.lit("---")), F.lit(False))
    asked = F.last(head, ignorenulls=True).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rank = status_rank(F.lower(F.nullif(F.regexp_extract("line", r"^\*\*Status:\*\*\s*(\w+)", 1), F.lit(""))))
    rows = lines.withColumn("asked", F.coalesce(asked, F.lit(False)))
    out = rows.groupBy("id").agg(F.count_if(F.startswith("line", F.lit("## F-"))).alias("n_findings"), F.count_if(F.col("asked") & F.startswith(F.trim("line"), F.lit("- "))).alias("n_open"), F.least(F.min(rank), F.lit(len(STATUS_ORDER) - 1)).alias("r"))
    return out.select("id", "n_findings", "n_open", F.element_at(F.array(*(F.lit(x) for x in STATUS_ORDER)), F.col("r") + 1).alias("strongest"))


def split_with_fallback(docs: DataFrame) -> DataFrame:
    """Entries start at '## ' headings; where a document has none at '### ', else it is one entry. One pass of windows by document."""
    lines = _lines(docs)
    has = lambda p: F.max(F.startswith("line", F.lit(p))).over(W.partitionBy("id"))
    lines = lines.withColumn("two", has("## ")).withColumn("three", has("### "))
    starts = F.when(F.col("two"), F.startswith("line", F.lit("## "))).when(F.col("three"), F.startswith("line", F.lit("### "))).otherwise(F.col("pos") == 0)
    return _cut(lines, starts)


def open_questions(docs: DataFrame) -> DataFrame:
    """id, pos, question: bullets under a heading 'Open Questions', as far as the next heading or rule."""
    lines = _lines(docs)
    edge = F.regexp_like("line", F.lit(r"^(#{1,6}\s|---+\s*$)"))
    last = F.last(F.when(edge, F.col("line")), ignorenulls=True).over(W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = lines.withColumn("head", last).filter(F.regexp_like("head", F.lit(r"(?i)^#+\s+open questions")) & F.regexp_like("line", F.lit(r"^\s*[-*]\s+\S")))
    return rows.select("id", "pos", F.regexp_replace("line", r"^\s*[-*]\s+", "").alias("question"))


def sample_newest(entries: DataFrame, n: int = 500) -> DataFrame:
    """The newest n / 2 entries of entries(id, date), undated last, and every k-th of the rest, k = max(1, rest div n / 2)."""
    from lorespan.operators.identity import global_rank

    half = n // 2
    ranked = global_rank(entries, [F.col("date").desc_nulls_last(), F.col("id")], "rank")
    total = entries.agg(F.count("*").alias("_t"))
    k = F.greatest(F.lit(1), F.floor((F.col("_t") - half) / half))
    return ranked.crossJoin(F.broadcast(total)).filter((F.col("rank") <= half) | (F.pmod(F.col("rank") - half - 1, k) == 0)).drop("_t")


def validate_tally(findings: DataFrame, tally: DataFrame) -> DataFrame:
    """category, severity, counted, declared, problem where findings(category, severity) and tally(category, severity, n) differ.

    Besides the cells, the totals of each category (severity null) and of all (both null) are held against each other. problem is
    missing or unexpected where only one side has the cell, duplicate where tally has it twice, else count.
    """
    own = findings.groupBy("category", "severity").agg(F.count("*").alias("counted"))
    said = tally.groupBy("category", "severity").agg(F.sum("n").alias("declared"), F.count("*").alias("_twice"))
    cells = own.join(said, ["category", "severity"], "full")
    sums = cells.rollup("category").agg(F.coalesce(F.sum("counted"), F.lit(0)).alias("counted"), F.coalesce(F.sum("declared"), F.lit(0)).alias("declared")).select("category", F.lit(None).cast("string").alias("severity"), "counted", "declared", F.lit(1).alias("_twice"))
    rows = cells.unionByName(sums)
    problem = F.when(F.col("_twice") > 1, "duplicate").when(F.col("declared").isNull(), "missing").when(F.col("counted").isNull(), "unexpected").when(F.col("counted") != F.col("declared"), "count")
    return rows.withColumn("problem", problem).filter("problem is not null").select("category", "severity", F.coalesce("counted", F.lit(0)).alias("counted"), F.coalesce("declared", F.lit(0)).alias("declared"), "problem")


def sequence_gaps(findings: DataFrame) -> DataFrame:
    """id, expected of findings(report, id): ids of a report that are not 1, 2, 3 ... in their order, each with the number that should stand there."""
    k = F.row_number().over(W.partitionBy("report").orderBy("id"))
    return findings.select("report", "id", k.alias("expected")).filter("id <> expected")


def macro_collisions(ids: DataFrame) -> DataFrame:
    """macro, n_ids, first_id of macros that several of ids(id) give: an error, as one would hide the others."""
    rows = ids.select("id", macro_name(F.col("id")).alias("macro")).distinct().filter("macro <> ''")
    return rows.groupBy("macro").agg(F.count("*").alias("n_ids"), F.min("id").alias("first_id")).filter("n_ids > 1")


#: For each name that scripts give a module or object, the calls that take a file's path first.
READ_CALLS = {
    "pd": ("read_parquet", "read_csv", "read_tsv", "read_feather", "read_hdf", "read_h5", "read_json", "read_excel", "read_stata", "read_sas", "read_orc", "read_pickle", "read_table"),
    "ad": ("read_h5ad", "read_csv"),
    "np": ("load",),
    "xr": ("open_dataset", "open_dataarray", "open_zarr", "open_mfdataset"),
    "sc": ("read", "read_h5ad", "read_csv", "read_mtx", "read_10x_h5", "read_10x_mtx"),
}
#: The same for calls that write; those under "" are methods of whatever object.
WRITE_CALLS = {
    "": ("to_parquet", "to_csv", "to_tsv", "to_feather", "to_hdf", "to_h5", "to_json", "to_excel", "to_stata", "to_sas", "to_orc", "to_pickle", "to_table", "write_csv", "write_parquet", "write_json", "write_h5ad", "to_netcdf"),
    "np": ("save", "save_compressed", "savez"),
    "plt": ("savefig",),
    "fig": ("savefig",),
    "ax": ("savefig",),
}
#: Calls whose first argument is a seed.
SEED_CALLS = {"np.random": ("seed", "default_rng"), "random": ("seed",), "torch": ("manual_seed",)}
#: Methods that choose, drop or combine rows, functions that do, and indexers.
ROW_METHODS, ROW_FUNCTIONS, INDEXERS = ("sample", "filter", "merge", "join"), ("pd.concat",), ("loc", "iloc")
_QUOTED = r"""(?:"[^"]*"|'[^']*')"""


def _calls(table: dict[str, tuple[str, ...]], argument: str) -> list[str]:
    """A pattern for each owner: one of its calls, the bracket, and the argument, which has the pattern's groups."""
    owner = lambda o: re.escape(o) + r"\." if o else r"\."
    return [rf"{owner(o)}(?:{'|'.join(sorted(calls, key=len, reverse=True))})\(\s*{argument}" for o, calls in table.items()]


def _literal(mark: str) -> str:
    """A whole argument that is one quoted string without quotes in it."""
    return rf"{mark}([^'\"]+){mark}\s*[,)]"


def _first_of(table: dict[str, tuple[str, ...]]) -> Column:
    """Paths that stand literally as the first argument, owner by owner, in double quotes and in single ones, in the order of the text within each."""
    return F.flatten(F.array(*(F.regexp_extract_all("source", F.lit(p), 1) for mark in "\"'" for p in _calls(table, _literal(mark)))))


#: Expressions that leave rows out or bring some in: what a bracket holds, with strings taken whole where they stand alone.
ROW_RULES = (
    rf"(\.query\(\s*{_QUOTED}\s*\))",
    *(rf"(\.{m}\([^()]*\))" for m in ROW_METHODS),
    *(rf"({re.escape(f)}\([^()]*\))" for f in ROW_FUNCTIONS),
    *(rf"(\.{i}\[[^\]]+\])" for i in INDEXERS),
    # a table indexed by a condition on itself or another: name[name.column ...], name[~mask ...], name[name["column"] ...]
    rf"(\b[A-Za-z_]\w*\[\s*~?[A-Za-z_]\w*(?:\.\w+|\[{_QUOTED}\])[^\[\]]*\])",
)


def scan_source_io(scripts: DataFrame) -> DataFrame:
    """script, inputs, outputs, filters (each once, pattern by pattern in the order of the text), seeds (sorted) of scripts(script, source): what stands there literally."""
    rows = F.flatten(F.array(*(F.regexp_extract_all("source", F.lit(p), 1) for p in ROW_RULES)))
    numbers = F.flatten(F.array(*(F.regexp_extract_all("source", F.lit(p), 1) for p in _calls(SEED_CALLS, r"(\d+)\s*\)"))))
    seeds = F.array_sort(F.array_distinct(F.transform(numbers, lambda x: x.try_cast("long"))))
    return scripts.select("script", F.array_distinct(_first_of(READ_CALLS)).alias("inputs"), F.array_distinct(_first_of(WRITE_CALLS)).alias("outputs"), F.array_distinct(rows).alias("filters"), F.filter(seeds, lambda x: x.isNotNull()).alias("seeds"))


#: Python modules that are tools, not analysis.
TOOLS = ("black", "compileall", "cProfile", "doctest", "ensurepip", "flake8", "http.server", "isort", "json.tool", "mypy", "pdb", "pip", "pydoc", "pyright", "pytest", "ruff", "site", "tarfile", "timeit", "unittest", "venv", "zipfile")
#: Words of the shell that begin or join compound commands, and programs that run the command after them.
COMPOUND = ("if", "then", "elif", "else", "fi", "for", "while", "until", "do", "done", "case", "esac", "select", "function", "coproc", "{")
PREFIXES = ("command", "builtin", "time", "env", "exec", "nohup", "sudo")
#: Two characters that no command holds, between a command's words and between commands.
_WORD, _END = "\x01", "\x02"
_QUOTE = r"""\\.|'[^']*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
#: What a command's text is made of: comments, words with their quotes and escapes, redirections, separators, and quotes without an end.
SHELL = rf"""(?s)(#[^\n]*+|(?:{_QUOTE}|[^\s;|&()<>'"\\]++)++|[<>]++&?|[;|&()\n]|['"\\])"""


def shell_commands(command: Column) -> Column:
    """The simple commands of a shell's command line, each an array of its words without their quotes; null if a quote isn't closed, or if there are compound commands or heredocs.

    Comments go, from a # at the start of a word to the end of the line. Separators are ; | & ( ) and line ends outside of
    quotes; a backslash before a line end joins lines. A backslash within double quotes stays. Variables and substitutions are text like any other.
    """
    tokens = F.regexp_extract_all(F.translate(command, _WORD + _END, ""), F.lit(SHELL), 1)
    single = lambda t, *of: t.isin(*of)
    marked = F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit("#")), "").when(single(t, ";", "|", "&", "(", ")", "\n"), _END).otherwise(F.concat(t, F.lit(_WORD))))
    raw = F.filter(F.transform(F.split(F.array_join(marked, ""), _END), lambda c: F.filter(F.split(c, _WORD), lambda w: ~single(w, "", "\\\n"))), lambda c: F.size(c) > 0)
    bad = F.exists(tokens, lambda t: single(t, "'", '"', "\\") | F.startswith(t, F.lit("<<"))) | F.exists(raw, lambda c: F.get(c, F.lit(0)).isin(*COMPOUND))
    bare = lambda w: F.regexp_replace(w, r"""(?s)\\\n|\\(.)|'([^']*+)'|"([^"\\]*+(?:\\.[^"\\]*+)*+)\"""", "$1$2$3")
    return F.when(~bad, F.transform(raw, lambda c: F.transform(c, bare)))


def _started(words: Column) -> Column:
    """kind and target of the program that a simple command starts; kind is null for others. Assignments and PREFIXES before it are passed over."""
    lead = F.aggregate(words, F.lit(0), lambda n, w: F.when(n < 0, n).when(w.isin(*PREFIXES) | F.regexp_like(w, F.lit("^[A-Za-z_][A-Za-z0-9_]*=")), n + 1).otherwise(-n - 1))
    words = F.slice(words, F.when(lead < 0, -lead).otherwise(lead + 1), F.size(words) + 1)
    exe = F.regexp_extract(F.get(words, F.lit(0)), r"([^/]*)$", 1)
    rest = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))

    def after(options: str) -> tuple[Column, Column]:
        """The first word that is no option, and the one after it."""
        n = F.aggregate(rest, F.lit(0), lambda n, w: F.when((n >= 0) & F.regexp_like(w, F.lit(options)), n + 1).when(n >= 0, -n - 1).otherwise(n))
        n = F.when(n < 0, -n - 1).otherwise(n)
        return F.get(rest, n), F.get(rest, n + 1)

    short, then = after(r"^-(?!c$|m$)[A-Za-z]+$")
    long, value = after(r"^--\S+$")
    note = F.get(F.filter(F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))), lambda w: F.endswith(w, F.lit(".ipynb"))), F.lit(0))
    python, none = F.regexp_like(exe, F.lit("^python[0-9.]*$")), F.lit(None).cast("string")
    at = lambda kind, target: F.struct(F.lit(kind).alias("kind"), target.alias("target"))
    return (
        F.when(python & (short == "-c") & then.isNotNull(), at("python_inline", none))
        .when(python & (short == "-m") & F.regexp_like(then, F.lit(r"^[A-Za-z_][A-Za-z0-9_.]*$")), at("python_module", then))
        .when(python & F.endswith(short, F.lit(".py")), at("python_script", short))
        .when((exe == "R") & (long == "-e") & value.isNotNull(), at("r_inline", none))
        .when((exe == "Rscript") & F.regexp_like(long, F.lit(r"\.[Rr]$")), at("r_script", long))
        .when((exe == "jupyter") & F.get(rest, F.lit(0)).isin("nbconvert", "execute") & note.isNotNull(), at("notebook", note))
    )


def classify_invocation(commands: DataFrame, managed: str | None = None) -> DataFrame:
    """commands(command) with programs (kind, target of each analysis that the command line starts, in order), and kind and target of the first.

    Left out are tools (python -m pytest, say) and scripts under the managed path; programs is empty and kind null where nothing
    else starts, and for a null command, one with a quote that isn't closed, compound commands or heredocs: what such a line
    runs can't be told from its text. Text within quotes and comments starts nothing. target is null for source given inline.
    """
    started = F.filter(F.transform(shell_commands(F.col("command")), _started), lambda p: p["kind"].isNotNull())
    gone = lambda p: (p["kind"] == "python_module") & p["target"].isin(*TOOLS)
    keep = (lambda p: ~gone(p) & ~F.coalesce(F.contains(p["target"], F.lit(managed)), F.lit(False))) if managed else (lambda p: ~gone(p))
    empty = F.array().cast("array<struct<kind: string, target: string>>")
    df = commands.withColumn("programs", F.coalesce(F.filter(started, keep), empty))
    first = F.get("programs", F.lit(0))
    return df.withColumns({"kind": first["kind"], "target": first["target"]})
