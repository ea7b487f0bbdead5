"""Column functions over text: titles, dates, tags, tokens, slugs, hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stages in the order of their sections.
STAGES = ("data_registry", "lit_review", "planning", "analysis", "figure_generation", "writing", "evaluation", "infrastructure", "unassigned", "conventions")
#: Parts of a path and the stages that they mark, first match wins.
PATH_STAGES = (("figures/", "figure_generation"), ("data/", "data_registry"), ("docs/plans", "planning"), ("eval", "evaluation"), ("tests/", "infrastructure"), ("analysis/", "analysis"), ("plan", "planning"))
#: Keywords in title and tags and the stages that they mark, first match wins.
KEYWORD_STAGES = (("figure_generation", ("figure", "panel", "dpi", "colorblind")), ("planning", ("prereg", "protocol", "pilot")), ("evaluation", ("calibration", "benchmark", "κ", "kappa")), ("analysis", ("extract", "prompt", "llm")))
#: Spelt digits of a macro name, and kinds of mitigation.
DIGITS = ("Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine")
MITIGATIONS = ("structural", "convention", "ambient-awareness")
DATE = r"(\d{4}-\d{2}-\d{2})"
WORD_EDGE = r"[^\p{L}\p{N}_]"


def normalize(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed; null stays null. Input is taken to be in composed form."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def token_set(text: Column) -> Column:
    """Distinct white-space tokens of the normalized text; none for null and empty."""
    return F.filter(F.array_distinct(F.split(F.coalesce(normalize(text), F.lit("")), " ")), lambda t: t != "")


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of the normalized text, in order."""
    return F.filter(F.split(F.coalesce(normalize(text), F.lit("")), WORD_EDGE + "+"), lambda t: t != "")


def has_term(text: Column, term: Column) -> Column:
    """Whether the normalized term stands in the normalized text between word edges (or the text's ends)."""
    quoted = F.regexp_replace(normalize(term), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.regexp_like(normalize(text), F.concat(F.lit(rf"(^|{WORD_EDGE})"), quoted, F.lit(rf"({WORD_EDGE}|$)")))


def tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Terms for weighting, repeats kept: comments and mark-up gone, [a-z][a-z0-9-]+, over two long, no stop words."""
    bare = F.when(F.contains(text, F.lit("<!--")), F.regexp_replace(text, r"(?s)<!--.*?-->", " ")).otherwise(text)
    found = F.regexp_extract_all(F.lower(bare), F.lit(r"([a-z][a-z0-9\-]{2,})"), 1)  # signs of mark-up end a term as any other sign does
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def first_line(text: Column) -> Column:
    return F.split(text, "\n", 2)[0]


def extract_date(text: Column) -> Column:
    """The first ISO date in text; null if there is none."""
    return F.nullif(F.regexp_extract(text, DATE, 1), F.lit(""))


def clean_title(title: Column) -> Column:
    """Without dates, entry ids, brackets and punctuation at the edges."""
    bare = F.regexp_replace(F.regexp_replace(title, DATE, ""), r"\b[DLF]-?\d+\b", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^[\s\-:#\[\]|.,!]+", ""), r"[\s\-:#\[\]|.,!]+$", "")


def parse_tags(text: Column) -> Column:
    """Tags of a comma or semicolon list in optional brackets, trimmed, empty ones gone."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\[|\]\s*$", "")
    return F.filter(F.transform(F.split(inner, "[,;]"), lambda t: F.trim(t)), lambda t: t != "")


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"#([A-Za-z][A-Za-z0-9_\-]*)"), 1)


def heading_title(heading: Column) -> Column:
    """A heading without dates (in brackets or bare) and entry ids, and without dashes, colons and spaces at its ends."""
    bare = F.regexp_replace(F.regexp_replace(heading, r"\[\d{4}-\d{2}-\d{2}\]|\d{4}-\d{2}-\d{2}", ""), r"\b[DLF]-?\d+\b", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^[\s\-–—:]+", ""), r"[\s\-–—:]+$", "")


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def entry_tags(lines: Column) -> Column:
    """Tags of the first line 'Tags: a, b; c' (bold or not) that has any text: cut at commas and semicolons, stars gone."""
    line = _first(F.filter(F.transform(lines, lambda x: F.regexp_extract(F.trim(x), r"(?i)^\*{0,2}Tags\*{0,2}:\s*(.+)", 1)), lambda x: x != ""))
    cut = F.transform(F.split(line, "[,;]"), lambda t: F.trim(F.regexp_replace(F.trim(t), r"^\*+|\*+$", "")))
    return F.coalesce(F.filter(cut, lambda t: t != ""), F.array().cast("array<string>"))


def log_tags(lines: Column) -> Column:
    """Tags of a Tags line, else the hashtags of the first 30 lines."""
    own = entry_tags(lines)
    found = F.regexp_extract_all(F.array_join(F.slice(lines, 1, 30), "\n"), F.lit(r"(?<![\p{L}\p{N}_])#([A-Za-z][A-Za-z0-9_\-]*)"), 1)
    return F.when(F.size(own) > 0, own).otherwise(found)


def stage_of(path: Column, title: Column, tags: Column) -> Column:
    """stage and stage_source: the first part of a path that path holds, else the first keyword in title and tags (case ignored), else unassigned."""
    at, said = F.lower(path), F.lower(F.concat_ws(" ", title, F.concat_ws(" ", tags)))
    pair = lambda stage, source: F.struct(F.lit(stage).alias("stage"), F.lit(source).alias("stage_source"))
    out = F
    for part, stage in PATH_STAGES:
        out = out.when(F.contains(at, F.lit(part)), pair(stage, "path"))
    for stage, keys in KEYWORD_STAGES:
        held = F.contains(said, F.lit(keys[0]))
        for k in keys[1:]:
            held = held | F.contains(said, F.lit(k))
        out = out.when(held, pair(stage, "keyword"))
    return out.otherwise(pair("unassigned", "default"))


def infer_stage(path: Column, title: Column, tags: Column) -> Column:
    return stage_of(path, title, tags)["stage"]


def mitigation_type(body: Column) -> Column:
    """The value of the first line 'mitigation_type: ...' outside comments, spelling variants mapped; 'unknown' without one."""
    bare = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    line = F.regexp_extract(bare, r"(?im)^[ \t>]*\*?\*?mitigation_type\*?\*?[ \t]*:[ \t]*(\S[^\n]*)$", 1)
    v = F.lower(F.regexp_replace(F.trim(line), "^[*`\"']+|[*`\"']+$", ""))
    return F.when(line == "", "unknown").when(v.isin(*MITIGATIONS), v).when(F.startswith(v, F.lit("ambient")), "ambient-awareness").when(v.isin("struct", "structual"), "structural").when(v.isin("conv", "checklist"), "convention").otherwise(v)


def topic_of(header: Column) -> Column:
    """A header without date and other brackets, bold marks, and edge signs; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(header, r"\[\d{4}-\d{2}-\d{2}\]", ""), r"\*\*([^*]+)\*\*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\[[^\]]+\]", ""), r"^#+\s*", "")
    return F.nullif(F.regexp_replace(bare, r"^[ :\-–—]+|[ :\-–—]+$", ""), F.lit(""))


def nfc_fold(text: Column) -> Column:
    """Composed form (NFC), case folded, runs of white space as one space, trimmed: for text that normalize() is not enough for. Null stays null."""

    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))

    return F.pandas_udf(fold, "string")(text)


def slugify(text: Column, limit: int = 40, fallback: str = "untitled") -> Column:
    """Lower-case kebab text of at most limit characters, cut at a hyphen where there is one."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    head = F.substring(s, 1, limit)
    whole = (F.length(s) <= limit) | (F.substring(s, limit + 1, 1) == "-")
    cut = F.when(whole, head).otherwise(F.when(F.contains(head, F.lit("-")), F.regexp_replace(head, r"-[^-]*$", "")).otherwise(head))
    return F.coalesce(F.nullif(F.regexp_replace(cut, r"-+$", ""), F.lit("")), F.lit(fallback))


def content_hash(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body, 256))


def fingerprint_key(*parts: Column) -> Column:
    """The parts joined by '|'; null is written None."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def is_template(heading: Column, body: Column) -> Column:
    """Whether heading or body hold a mark of a sample: <placeholder>, YYYY-MM-DD, or TEMPLATE in any case."""
    both = F.concat_ws(" ", heading, body)
    return F.contains(both, F.lit("<placeholder>")) | F.contains(both, F.lit("YYYY-MM-DD")) | F.contains(F.upper(both), F.lit("TEMPLATE"))


def format_value(value: Column, unit: Column | None = None, precision: Column | None = None, display: Column | None = None) -> Column:
    """A value as shown in a report: unit 'percent' gives 100 times a fraction with precision digits (1 if null; 0 to 9) and a sign; else display as it is; else the value itself.

    Numbers are written in their shortest form, booleans as true and false. Another unit, or a percentage of what is no number, gives null: format_errors lists them.
    """
    none = F.lit(None).cast("string")
    unit, display = (none if c is None else c for c in (unit, display))
    digits = F.coalesce(F.lit(1) if precision is None else precision, F.lit(1))
    number = value.try_cast("double") * 100
    shown = F.element_at(F.array(*(F.format_string(f"%.{d}f", number) for d in range(10))), digits + 1)
    return F.when(unit == "percent", F.when(number.isNotNull(), F.concat(shown, F.lit("%")))).when(unit.isNull(), F.coalesce(display, value.cast("string")))


def macro_name(ident: Column) -> Column:
    """Letters only, of the part of an id after its last '.', ':' or '/': parts between '_' are spelt digits, capitals (up to three letters), or a capital and small letters with digits spelt."""
    local = F.element_at(F.split(ident, "[.:/]"), -1)

    def spell(x: Column) -> Column:
        for k, name in enumerate(DIGITS):
            x = F.replace(x, F.lit(str(k)), F.lit(name))
        return x

    def part(x: Column) -> Column:
        # digits keep their place while the letters' case is set
        low = F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000)))
        return F.when((F.length(x) <= 3) & F.regexp_like(x, F.lit(r"^\p{L}+$")), F.upper(x)).otherwise(spell(low))

    return F.array_join(F.transform(F.filter(F.split(local, "_"), lambda x: x != ""), part), "")


def frontmatter(text: Column) -> Column:
    """The fields 'key: value' between the first two lines '---' as a map; empty where there is no such block."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    keys = F.transform(pairs, lambda x: F.trim(F.substring_index(x, ":", 1)))
    return F.map_from_arrays(keys, F.transform(pairs, lambda x: F.trim(F.substring(x, F.instr(x, ":") + 1, 10_000))))


def visible_lines(lines: Column) -> Column:
    """The lines outside fenced code; a fence closes with the same sign, at least as often."""
    fence = lambda x: F.regexp_extract(x, r"^\s*(`{3,}|~{3,})", 1)
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(s, x):
        f = fence(x)
        inside = s["open"] != ""
        closes = inside & (F.substring(f, 1, 1) == F.substring(s["open"], 1, 1)) & (F.length(f) >= F.length(s["open"]))
        opened = F.when(closes, F.lit("")).when(~inside & (f != ""), f).otherwise(s["open"])
        return F.struct(opened.alias("open"), F.when(~inside & (f == ""), F.concat(s["out"], F.array(x))).otherwise(s["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda s: s["out"])
