"""Texts and JSON values as HTML; prompts and lines of evidence as columns. HTML is for reports of bounded slices."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import scalars

#: Marks inside a line, in this order: code, strong, emphasis, formulas.
_INLINE = (
    (re.compile(r"`([^`]+)`"), "code", ""),
    (re.compile(r"\*\*([^*]+)\*\*"), "strong", ""),
    (re.compile(r"(?<!\*)\*([^*]+)\*(?!\*)"), "em", ""),
    (re.compile(r"\\\((.+?)\\\)"), "span", ' class="math inline"'),
    (re.compile(r"\$(.+?)\$"), "span", ' class="math inline"'),
)
_BLOCK = re.compile(r"(?P<rule>-{3,})|(?P<level>#{1,6})\s+(?P<title>.*)|\d+\.\s+(?P<item>.*)")


def _tag(name: str, body: str, more: str = "") -> str:
    return f"<{name}{more}>{body}</{name}>"


def inline(line: str) -> str:
    out = html.escape(line, quote=False)
    for pattern, tag, more in _INLINE:
        out = pattern.sub(lambda m: _tag(tag, m[1], more), out)  # noqa: B023
    return out


def code_block(language: str, body: str) -> str:
    label = _tag("div", html.escape(language, quote=False), ' class="code-label"') if language else ""
    return _tag("div", label + _tag("pre", _tag("code", html.escape(body, quote=False))), ' class="code-block"')


def _blocks(text: str):
    """(kind, value) of each block: fences, rules, headings, items, paragraphs and the gaps between them."""
    fence, rows, paragraph = None, [], []
    for raw in [*text.split("\n"), None]:
        line = raw.strip() if raw is not None else ""
        if fence is not None:
            if raw is None or line.startswith("```"):
                yield "fence", (fence, "\n".join(rows))
                fence, rows = None, []
            else:
                rows.append(raw)
            continue
        if paragraph:
            if line:
                paragraph.append(line)
                continue
            yield "paragraph", " ".join(paragraph)
            paragraph = []
        if raw is None:
            return
        found = _BLOCK.fullmatch(line)
        if line.startswith("```"):
            fence = line[3:].strip()
        elif found and found["rule"]:
            yield "rule", ""
        elif found and found["level"]:
            yield "heading", (len(found["level"]), found["title"])
        elif found:
            yield "item", found["item"]
        elif line:
            paragraph = [line]
        else:
            yield "gap", ""


def markdown(text: str | None) -> str:
    """Headings (one level down), numbered lists, fences, rules, paragraphs and marks inside lines."""
    body = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    if not body:
        return _tag("p", "Empty", ' class="muted"')
    out, listed = [], False
    for kind, value in _blocks(body):
        if listed and kind != "item":
            out.append("</ol>")
            listed = False
        if kind == "item":
            out.append(("" if listed else "<ol>") + _tag("li", inline(value)))
            listed = True
        elif kind == "fence":
            out.append(code_block(*value))
        elif kind == "rule":
            out.append("<hr>")
        elif kind == "heading":
            out.append(_tag(f"h{min(value[0] + 1, 6)}", inline(value[1])))
        elif kind == "paragraph":
            out.append(_tag("p", inline(value)))
    return "".join(out) + ("</ol>" if listed else "")


def json_html(value: object, depth: int = 0) -> str:
    """Objects as titled cards, lists by item, texts as JSON or Markdown, truth values as pills."""
    muted = lambda text: _tag("p", text, ' class="muted"')
    match value:
        case dict():
            title = lambda k: " ".join(w.capitalize() for w in re.split(r"[_\-\s]+", str(k).strip()))
            cards = (_tag(f"h{min(depth, 2) + 3}", html.escape(title(k), quote=False)) + json_html(v, depth + 1) for k, v in value.items())
            return "".join(_tag("section", c, f' class="kv-card depth-{depth}"') for c in cards) or muted("Empty object")
        case list():
            items = "".join(_tag("section", _tag("div", f"Item {i}", ' class="list-index"') + json_html(v, depth + 1), f' class="list-item depth-{depth}"') for i, v in enumerate(value))
            return _tag("div", items, ' class="list-wrap"') if items else muted("Empty list")
        case bool():
            word = str(value).lower()
            return _tag("p", _tag("span", word, f' class="pill {word}"'))
        case None:
            return muted("null")
        case str():
            text = value.strip()
            if text[:1] in ("{", "["):
                try:
                    return json_html(json.loads(text), depth)
                except ValueError:
                    pass
            return markdown(text)
    return _tag("p", html.escape(str(value), quote=False))


@F.pandas_udf(StringType())
def markdown_html(texts: pd.Series) -> pd.Series:
    return texts.map(markdown, na_action=None)


def distribution_text(summary: Column) -> Column:
    """A struct of count, mean, median, q1 and q3 as text; ``none`` for a null."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(summary[k].cast("string"), F.lit("None"))) for k in ("count", "mean", "median", "q1", "q3")]
    return F.when(summary.isNull(), "none").otherwise(F.concat_ws(", ", *parts))


@F.pandas_udf(StringType())
def sorted_json(texts: pd.Series) -> pd.Series:
    """JSON texts with the keys of every object in order; what is no JSON stays as it is."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
        except (ValueError, RecursionError):
            return text

    return texts.map(one)


def compact_json(value: Column, limit: int = 160) -> Column:
    """A JSON text on one line with keys in order, cut at ``limit``; nulls, empty texts, empty strings and empty objects give an empty text."""
    t = F.coalesce(value, F.lit(""))
    return F.when(t.isin("", "null", '""', "{}"), "").otherwise(scalars.shortened(sorted_json(t), limit))


def case_label(visibility: Column, case_index: Column) -> Column:
    """Column name of a test: Public_01 for the first public one; blank visibilities are Test."""
    v = F.when(F.coalesce(visibility, F.lit("")) == "", "test").otherwise(visibility)
    return F.concat(F.initcap(v), F.lit("_"), F.format_string("%02d", (case_index + 1).cast("long")))


def case_order(label: Column) -> Column:
    """Sort key of such names: public, private, generated, others; then the number (999 where there is none)."""
    kind, number = F.split_part(label, F.lit("_"), F.lit(1)), F.split_part(label, F.lit("_"), F.lit(2)).try_cast("int")
    return F.struct(F.when(kind == "Public", 0).when(kind == "Private", 1).when(kind == "Generated", 2).otherwise(9).alias("kind"), F.coalesce(number, F.lit(999)).alias("number"))


def request_id(sample: Column, attempt: Column, visibility: Column, case_index: Column) -> Column:
    v = F.when(F.trim(F.coalesce(visibility, F.lit(""))) == "", "unknown").otherwise(F.trim(visibility))
    return F.format_string("sample%d_attempt%d_%s_%d", sample.cast("long"), attempt.cast("long"), v, case_index.cast("long"))


def test_line(label: Column, cell: Column, failure: Column, exception: Column, message: Column, expected: Column, actual: Column) -> Column:
    """A failed test as a line of evidence; blank parts are left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}="), c))
    return F.concat_ws("; ", F.concat(F.lit("- "), label, F.lit(": result="), cell), part("failure_type", failure), part("exception_type", exception), part("exception_message", F.when(F.coalesce(message, F.lit("")) != "", scalars.shortened(message, 160))), part("expected", compact_json(expected)), part("actual", compact_json(actual)))


# The solver's instructions.
SOLVER = (
    "Solve the following Python coding task.",
    "",
    "Requirements:",
    "- Return only Python code.",
    "- Implement the requested entry function exactly.",
    "- Do not include explanations before or after the code.",
    "- Use only the Python standard library unless the prompt explicitly permits otherwise.",
    "",
    "Problem Statement:",
)


def solver_prompt(prompt: Column, starter: Column) -> Column:
    """What a model is asked: instructions, the problem, and the starter code in a fence where there is any."""
    code = scalars.unfenced(starter)
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    tail = F.when(strip(code) != "", F.concat(F.lit("\n\nStarter Code:\n```python\n"), strip(code), F.lit("\n```"))).otherwise("")
    return F.concat(F.lit("\n".join(SOLVER) + "\n"), strip(prompt), tail, F.lit("\n"))
