"""Small text functions of reports and sources, all built in. Null texts count as empty unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\r\n]+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeezed(c: Column) -> Column:
    """White space collapsed to one space, ends stripped."""
    return F.trim(F.regexp_replace(_text(c), SPACE, " "))


def excerpt(c: Column, limit: int) -> Column:
    """Ends stripped; a longer text is cut to ``limit`` characters, the last three of them dots."""
    t = F.regexp_replace(_text(c), rf"^{SPACE}|{SPACE}$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit - 3), rf"{SPACE}$", ""), F.lit("...")))


def shortened(c: Column, limit: int) -> Column:
    """``squeezed``, then cut as in ``excerpt``, the end not stripped."""
    t = squeezed(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def head_tail(c: Column, head: int = 3200, tail: int = 2200, slack: int = 200) -> Column:
    """Both ends of a text that is longer than they and ``slack`` together."""
    t = _text(c)
    return F.when(F.length(t) <= head + tail + slack, t).otherwise(F.concat(F.substring(t, 1, head), F.lit("\n...\n"), F.substring(t, -tail, tail)))


def unfenced(c: Column) -> Column:
    """Without one leading and one trailing code fence."""
    t = F.regexp_replace(_text(c), rf"^{SPACE}|{SPACE}$", "")
    return F.regexp_replace(F.regexp_replace(t, r"^```[A-Za-z0-9_]*[ \t]*\n", ""), r"\n```$", "")


def slug(c: Column, default: str = "model") -> Column:
    t = F.lower(F.regexp_replace(F.regexp_replace(_text(c), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""))
    return F.when(t == "", default).otherwise(t)


def looks_like_json(c: Column) -> Column:
    """Begins and ends with brackets that match."""
    t = F.regexp_replace(_text(c), rf"^{SPACE}|{SPACE}$", "")
    return (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))


def flags(c: Column) -> Column:
    """Distinct non-empty parts between semicolons."""
    return F.array_distinct(F.filter(F.transform(F.split(_text(c), ";"), lambda x: F.trim(x)), lambda x: x != ""))


def pass_fraction(c: Column) -> Column:
    """passed / total of ``p/t``; both 0 where it has another form."""
    good = F.coalesce(c.rlike(r"^[0-9]+/[0-9]+$"), F.lit(False))
    part = lambda i: F.when(good, F.try_to_number(F.split_part(c, F.lit("/"), F.lit(i)), F.lit("9" * 18)).cast("long")).otherwise(0)
    return F.struct(part(1).alias("passed"), part(2).alias("total"))


def ratio_verdict(ratio: Column, full: float = 1.0, half: float = 0.5) -> Column:
    return F.when(ratio >= full, "PASS").when(ratio >= half, "PARTIAL").otherwise("FAIL")


def compact_notes(notes: Column, most: int = 2) -> Column:
    """The first distinct non-empty notes of an array, each on one line."""
    one = F.transform(notes, lambda x: F.trim(F.regexp_replace(_text(x), "\n", " ")))
    return F.array_join(F.slice(F.array_distinct(F.filter(one, lambda x: x != "")), 1, most), "; ")


def counts_text(counts: Column) -> Column:
    """``k=v`` of a map in the order of its keys; ``none`` if it is empty or null."""
    pairs = F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, "none").otherwise(F.array_join(pairs, "; "))


def test_cell(status: Column, failure: Column, exception: Column) -> Column:
    """What a result shows in a table of tests; statuses outside the ladder in capitals."""
    named = lambda other, *cs: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cs), F.lit(other))
    s = F.lower(_text(status))
    return F.when(s == "pass", "PASS").when(s == "fail", F.concat(F.lit("FAIL:"), named("incorrect_output", failure))).when(s == "timeout", "TIMEOUT").when(s == "error", F.concat(F.lit("ERROR:"), named("error", failure, exception))).otherwise(F.upper(s))


def execution_failure(exception: Column) -> Column:
    return F.when(F.lower(_text(exception)).contains("syntax"), "syntax_error").otherwise("runtime_error")


def incomplete_reason(details: Column, finish: Column, status: Column) -> Column:
    """Why a generation is incomplete: its stated reason, else a finish of length or incomplete, else such a status; empty if complete."""
    bad = lambda c: F.lower(_text(c)).isin("length", "incomplete")
    return F.when(_text(details) != "", details).when(bad(finish), F.lower(finish)).when(F.lower(_text(status)) == "incomplete", "incomplete").otherwise("")


def repaired(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again, if that succeeds; line ends become newlines."""
    t = _text(c)
    latin = t.rlike("[âÃÂð]") & ~t.rlike(r"[^\x{0}-\x{FF}]")
    again = F.encode(F.regexp_replace(t, r"[^\x{0}-\x{FF}]", "?"), "ISO-8859-1").cast("string")
    return F.regexp_replace(F.when(latin & F.is_valid_utf8(again), again).otherwise(t), "\r\n?", "\n")


def json_object(c: Column) -> Column:
    """The object that a text is, or that its outermost braces hold, as JSON; null if there is none."""

    def parsed(t: Column) -> Column:
        v = F.try_parse_json(t)
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v))

    return F.coalesce(parsed(c), parsed(F.regexp_extract(c, r"(?s)\{.*\}", 0)))


def to_float(c: Column, other: float | None = 0.0) -> Column:
    """A number of a text; what is none, blank or null gives ``other`` (0, null or minus infinity, as the caller orders such rows)."""
    value = F.trim(c.cast("string")).try_cast("double")
    return value if other is None else F.coalesce(value, F.lit(other))


def to_int(c: Column) -> Column:
    """A whole number of a text, decimals cut off; 0 for what is none or does not fit."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(value), value).try_cast("long"), F.lit(0))


def to_bool(c: Column) -> Column:
    """Whether a text is ``true``, whatever its case and the spaces around it."""
    return F.lower(F.trim(_text(c.cast("string")))) == "true"


def printable(c: Column) -> Column:
    """Without the control characters that workbooks and XML don't allow; tabs and line ends stay."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
