"""Text features as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line ends of Unicode texts, and what counts as a word.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
LINE_END = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])"
WORD = r"[\p{L}\p{N}_]+"
# Words that a template keeps.
KEPT = ("input", "output", "return", "function", "problem", "statement", "constraints")


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed to one space, ends stripped; null stays null."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def line_count(text: Column) -> Column:
    """Lines once newlines at both ends are gone; 0 for an empty text."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\n+|\n+$", "")
    return F.when(body == "", 0).otherwise(F.regexp_count(body, F.lit(LINE_END)) + F.when(body.rlike(LINE_END + r"\z"), 0).otherwise(1))


def band(value: Column, low: int, high: int) -> Column:
    return F.when(value < low, "short").when(value < high, "medium").otherwise("long")


def windows(t: Column, n: int = 5) -> Column:
    """Distinct windows of n characters; a text of at most n characters is its only one, an empty or null text has none."""
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, F.array().cast("array<string>")).when(F.length(t) <= n, F.array(t)).otherwise(found)


def ngrams(text: Column, n: int = 5) -> Column:
    """``windows`` of the normalised text."""
    return windows(normalise(text), n)


def tokens(text: Column) -> Column:
    """Runs of a-z, 0-9 and underscores of the normalised text."""
    return F.filter(F.split(normalise(text), "[^a-z0-9_]+"), lambda x: x != "")


def template(text: Column) -> Column:
    """Numbers, quoted strings and identifiers of three characters or more abstracted; a few words are kept.

    The identifiers in the marks of numbers and strings are abstracted with the others, so both end as ``<<id>>``.
    """
    mark = "\u0001"
    t = F.regexp_replace(normalise(text), r"\p{Nd}+", " <num> ")
    t = F.regexp_replace(t, "'[^']*'|\"[^\"]*\"", " <str> ")
    edge = lambda body: r"(?<![\p{L}\p{N}_])" + body + r"(?![\p{L}\p{N}_])"
    t = F.regexp_replace(t, edge("(?=[a-z0-9_]{3})__[a-z0-9_]*(?<=__)"), mark)
    t = F.regexp_replace(t, edge(f"(?!(?:{'|'.join(KEPT)})(?![a-z0-9_]))[a-z_][a-z0-9_]{{2,}}"), "<id>")
    return F.trim(F.regexp_replace(F.regexp_replace(t, mark, "<magic>"), SPACE, " "))


def test_signature(tests: Column) -> Column:
    """Windows of four characters of all tests (visibility, testtype, input, output)."""
    fields = lambda t: F.concat_ws(":", *(F.coalesce(t[c], F.lit("")) for c in ("visibility", "testtype", "input", "output")))
    return F.coalesce(F.array_distinct(F.flatten(F.transform(tests, lambda t: ngrams(fields(t), 4)))), F.array().cast("array<string>"))


def mixed_signature(text: Column) -> Column:
    """Windows of five characters and tokens: of starter code, or of a function's name."""
    t = F.coalesce(text, F.lit(""))
    return F.array_union(ngrams(t), tokens(t))


def embedding_text(title: Column, name: Column, prompt: Column, starter: Column, prompt_cap: int = 2500, starter_cap: int = 1000) -> Column:
    """What an embedding is made of: the parts that are not empty, a line each; the caps are the model's."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), f"^{SPACE}|{SPACE}$", "")
    parts = (strip(title), strip(name), F.substring(strip(prompt), 1, prompt_cap), F.substring(strip(starter), 1, starter_cap))
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(1.0))


def sql_normalised(text: str) -> str:
    """``normalise`` in DuckDB's SQL."""
    return f"trim(regexp_replace(lower({text}), '{SPACE}', ' ', 'g'), ' ')"


def sql_template(text: str) -> str:
    """``template`` in DuckDB's SQL, which has no look-around: the text is parted into words and what stands between them."""
    quoted = "'''[^'']*''|\"[^\"]*\"'"
    marked = f"regexp_replace(regexp_replace({sql_normalised(text)}, '\\p{{Nd}}+', ' <num> ', 'g'), {quoted}, ' <str> ', 'g')"
    kept = ", ".join(f"'{k}'" for k in KEPT)
    word = f"CASE WHEN NOT regexp_full_match(w, '[a-z_][a-z0-9_]{{2,}}') OR w IN ({kept}) THEN w WHEN starts_with(w, '__') AND ends_with(w, '__') THEN '<magic>' ELSE '<id>' END"
    parts = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'"
    return f"trim(regexp_replace(array_to_string(list_transform(regexp_extract_all({marked}, {parts}), lambda w: {word}), ''), '{SPACE}', ' ', 'g'), ' ')"
