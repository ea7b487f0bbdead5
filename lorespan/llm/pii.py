"""Personal data: patterns propose spans, checksums confirm them, words nearby raise their score. Column functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What words nearby add to a score, what a span needs that isn't of a base kind, and the characters before and after in which such words count.
NEARBY, ENOUGH, BEFORE, AFTER = 35, 50, 40, 20


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether digits (a string of at least one) end in their Luhn check digit."""

    def value(c, i):
        v = c.try_cast("int")
        return F.when(i % 2 == 0, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether code (A-Z and 0-9, five at least) has the remainder 1 of account numbers: its first four at the end, letters as 10 to 35."""
    moved = F.concat(F.substring(code, 5, 1 << 30), F.substring(code, 1, 4))

    def step(s, c):
        return F.when(c < "A", (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _n_digits(least: int, most: int) -> Callable[..., Column]:
    return lambda m, *_: F.length(digits_of(m)).between(least, most)


def _card(least: int, most: int) -> Callable[..., Column]:
    return lambda m, *_: let(digits_of(m), lambda d: F.when(F.length(d).between(least, most), luhn(d)).otherwise(False))


def _words(*words: str) -> str:
    """A pattern of any of words that stands alone, whatever its case."""
    return f"(?i)(?:^|[^A-Za-z])(?:{'|'.join(words)})(?:$|[^A-Za-z])"


class Kind(NamedTuple):
    """pattern proposes; confirm(match, before, after) tells which proposals count; score in percent, raised by NEARBY where words match nearby."""

    name: str
    pattern: str
    confirm: Callable[..., Column]
    score: int
    words: str
    base: bool = False


_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_OUT, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_LOCAL = "A-Za-z0-9._%+-"
#: The base kinds first, in the order in which spans are listed. Possessive repeats find what plain ones would, in linear
#: time and without recursion: what follows each is no character of it. For the same reason, runs of letters or digits
#: are entered at their beginning or where the match before ended.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m, *_: F.lit(True), 60, _words("e-?mail", "mail", "contact", "correo", "courriel", "adresse"), True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m, *_: m.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"), 50, _words("ip", "host", "server", "address", "adresse", "addr"), True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card(16, 19), 65, _words("card", "credit", "visa", "mastercard", "karte", "carte", "tarjeta"), True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _n_digits(8, 15), 50, _words("phone", "tel", "telefon", "t[ée]l[ée]phone", "tel[ée]fono", "call", "fax", "mobile"), True),
    Kind("iban", rf"{_OUT}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?){_END}", lambda m, *_: mod97(F.replace(m, F.lit(" "), F.lit(""))), 60, _words("iban", "account", "konto", "compte", "cuenta", "bank")),
    Kind("ssn", rf"{_OUT}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}", lambda m, *_: ~m.rlike("^(?:000|666|9..)-|-00-|-0000$"), 40, _words("ssn", "social security")),
    Kind("short_card", r"[0-9](?:[\x20-]?[0-9])++", _card(13, 15), 30, _words("card", "credit", "visa", "amex", "american express", "karte", "carte", "tarjeta")),
    Kind("local_phone", rf"{_OUT}[0-9]{{3}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}{_END}", lambda m, before, after: ~F.right(before, F.lit(BEFORE)).rlike(r"\+[0-9][\x20().0-9-]*$"), 30, _words("phone", "tel", "telefon", "t[ée]l[ée]phone", "tel[ée]fono", "call", "fax", "mobile")),
    Kind("birth_date", rf"{_OUT}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{_END}", lambda m, *_: m.rlike("^(?:19|20)..-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$"), 20, _words("born", "birth", "birthday", "dob", "geboren", "nacid[oa]", "naissance")),
)
SPAN = "array<struct<kind:string,start:long,end:long,score:int>>"


def running_sums(values: Column) -> Column:
    """The sum of values (an array of longs, not empty) up to each place. By blocks of about the root of the size, as each step of an aggregate copies what it has."""
    zero = F.array(F.lit(0).cast("long"))
    add = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))

    def blocks(v):
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(v), size), lambda i: F.aggregate(F.slice(v, i, size), zero, add))

    def joined(inner):
        before = F.slice(F.aggregate(inner, zero, lambda s, b: add(s, F.element_at(b, -1))), F.lit(1), F.size(inner))
        return F.flatten(F.zip_with(inner, before, lambda b, o: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda x: x + o)))

    return let(values, lambda v: let(blocks(v), joined))


def _proposals(text: Column, kind: Kind, use: Callable[[Column], Column], otherwise: Column) -> Column:
    """use(rows), rows being the kind's matches m in text with what is before and after each, up to the next match; otherwise without a match."""
    pattern = F.lit(kind.pattern)

    def met(found):
        rest = F.split(text, kind.pattern, -1)
        return let(rest, lambda g: use(F.arrays_zip(found.alias("m"), F.slice(g, F.lit(1), F.size(found)).alias("before"), F.slice(g, F.lit(2), F.size(found)).alias("after"))))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) == 0, otherwise).otherwise(met(found)))


def _score(kind: Kind, x: Column) -> Column:
    near = F.right(x["before"], F.lit(BEFORE)).rlike(kind.words) | F.left(x["after"], F.lit(AFTER)).rlike(kind.words)
    return (F.lit(kind.score) + F.when(near, F.least(F.lit(NEARBY), F.lit(100 - kind.score))).otherwise(0)).cast("int")


def _counts(kind: Kind, x: Column) -> Column:
    ok = kind.confirm(x["m"], x["before"], x["after"])
    return ok if kind.base else F.when(ok, _score(kind, x) >= ENOUGH).otherwise(False)


def pii_spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind, start, end (code points, end exclusive) and score of each confirmed span of text: by kind in the order of kinds, then by start. Null text: none.

    Matches of a kind don't overlap; one that its check refuses is dropped and not tried again from another start. Spans
    of a base kind count at any score, others need ENOUGH.
    """

    def of(kind: Kind) -> Column:
        def spans(rows):
            ends = running_sums(F.transform(rows, lambda x: (F.length(x["before"]) + F.length(x["m"])).cast("long")))
            placed = F.zip_with(rows, ends, lambda x, end: F.struct(x.alias("x"), end.alias("end")))
            good = F.filter(placed, lambda p: _counts(kind, p["x"]))
            return F.transform(good, lambda p: F.struct(F.lit(kind.name).alias("kind"), (p["end"] - F.length(p["x"]["m"])).alias("start"), p["end"].alias("end"), _score(kind, p["x"]).alias("score")))

        return _proposals(F.coalesce(text, F.lit("")), kind, spans, F.array().cast(SPAN)).cast(SPAN)

    return F.concat(*(of(k) for k in kinds))


def redacted(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """text with each confirmed span replaced by its kind in brackets. Kinds are replaced one after another, so what an earlier one has replaced no later one sees. Null stays null."""

    def of(kind: Kind, text: Column) -> Column:
        def replaced(rows):
            piece = lambda x: F.concat(x["before"], F.when(_counts(kind, x), F.lit(f"[{kind.name.upper()}]")).otherwise(x["m"]))
            return F.concat(F.array_join(F.transform(rows, piece), ""), F.element_at(rows, -1)["after"])

        return let(text, lambda t: _proposals(t, kind, replaced, t))

    return reduce(lambda t, kind: of(kind, t), kinds, text)


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with their column text redacted; all other columns, whatever their names, stay as they are."""
    return docs.select(*(redacted(F.col(f"`{c}`"), kinds).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and spans (kind, start, end, score) of docs(doc_id, text), a row for each row.

    Nothing is shuffled, so rows that repeat a doc_id, rows without one and very many equal texts change nothing. Null,
    empty and blank texts have no spans; an empty table gives an empty one; other columns are left out. Time is linear in
    the text, and n matches take n to the power 1.5 short steps.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), pii_spans(F.col("text"), kinds).alias("spans"))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans (kind:start:end), all spans, the scores (kind:start:end:score), and n_spans."""
    base = [k.name for k in KINDS if k.base]
    text = lambda s, *more: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), *more)
    n = lambda k: F.size(F.filter("own", lambda s: s["kind"] == k)).cast("long")
    rows = find_pii(docs).select("doc_id", "spans", F.filter("spans", lambda s: s["kind"].isin(base)).alias("own"))
    return rows.select(
        "doc_id", *(n(k).alias(f"n_{k}") for k in base),
        F.sha2(F.array_join(F.transform("own", lambda s: text(s)), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", lambda s: text(s)), ",").alias("spans"),
        F.array_join(F.transform("spans", lambda s: text(s, s["score"].cast("string"))), ",").alias("scored"), F.size("spans").cast("long").alias("n_spans"),
    )
