"""Typed equality of JSON texts in expressions; code extraction and facts about code, which need Python, in Arrow batches."""

from __future__ import annotations

import ast
import json
import math
import re
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a refusal holds, notes on how code was found, beginnings of a line of code.
REFUSALS = ("i can't help", "i cannot help", "i can’t provide", "i cannot provide", "sorry, but", "as an ai")
NOTES = {
    "no_code": "Model returned an empty response.",
    "refusal": "Model refused or declined to answer.",
    "fence": "Extracted the largest fenced code block.",
    "suffix": "Extracted the earliest parseable Python module that preserves top-level imports and helpers.",
    "malformed_response": "No runnable Python function was found in the model output.",
}
BEGINS = re.compile(r"""(?:from|import|def|async[ ]def|class)[ ]|[@#]|\"{3}|'{3}|[A-Za-z_][A-Za-z0-9_]*\s*=""")


def same(expected: object, actual: object) -> bool:
    """Deep equality that keeps types apart: truth values and null by identity, numbers with a tolerance, lists in order."""
    if isinstance(expected, bool) or isinstance(actual, bool) or expected is None or actual is None:
        return expected is actual
    if isinstance(expected, int | float) and isinstance(actual, int | float):
        if float(expected).is_integer() and float(actual).is_integer():
            return expected == actual
        return math.isclose(expected, actual, rel_tol=1e-9, abs_tol=1e-5)
    if type(expected) is not type(actual):
        return False
    if isinstance(expected, list):
        return len(expected) == len(actual) and all(map(same, expected, actual))
    if isinstance(expected, dict):
        return expected.keys() == actual.keys() and all(same(v, actual[k]) for k, v in expected.items())
    return expected == actual


def mismatch(expected: object, actual: object) -> str:
    """Kind of a difference: of the types (whole and decimal numbers are two), or of the values."""
    return "incorrect_output" if type(expected) is type(actual) else "format_mismatch"


def loosely_same(expected: object, actual: object) -> bool:
    """Plain equality, once results that are JSON texts are read."""
    if isinstance(actual, str):
        try:
            actual = json.loads(actual)
        except ValueError:
            pass
    return expected == actual


#: A string of JSON, or (group 2) a number outside one.
_ATOM = r'("(?:[^"\\]|\\.)*+")|(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)'


def typed_equal(expected: Column | str, actual: Column | str) -> Column:
    """Whether two JSON texts hold the same typed value, as ``same`` has it; false if either is null or not JSON.

    Both are read as VARIANT and written again, which orders the keys; then they are equal where they are the same but for their numbers, and each number
    has its like in place. Not JSON here: NaN and Infinity, an object that repeats a key, and what exceeds the size of a VARIANT.
    """
    written = [F.to_json(F.try_parse_json(F.col(c) if isinstance(c, str) else c)) for c in (expected, actual)]
    shape = [F.regexp_replace(x, _ATOM, "$1#") for x in written]
    numbers = [F.filter(F.regexp_extract_all(x, F.lit(_ATOM), F.lit(2)), lambda n: n != "") for x in written]
    like = F.forall(F.zip_with(*numbers, _close), lambda x: x)
    return F.coalesce(F.when(written[0] == written[1], True).otherwise((shape[0] == shape[1]) & like), F.lit(False))


def _close(a: Column, b: Column) -> Column:
    """Numbers as text: whole ones exactly (beyond 38 digits, as doubles), others within a relative 1e-9 or an absolute 1e-5."""
    x, y = a.cast("double"), b.cast("double")
    exact = [F.when(text.rlike("^-?[0-9]{1,38}$"), text.try_cast("decimal(38,0)")).otherwise(number.try_cast("decimal(38,0)")) for text, number in ((a, x), (b, y))]
    whole = (x == F.rint(x)) & (y == F.rint(y))
    near = (x == y) | (F.abs(x - y) <= F.greatest(1e-9 * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-5)))
    return F.coalesce(F.when(whole, F.coalesce(exact[0] == exact[1], x == y)).otherwise(near), F.lit(False))


def parsed(text: str) -> ast.Module | None:
    """The syntax tree; None for what is no Python, or too deep for the parser."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _defines(tree: ast.Module | None) -> bool:
    return tree is not None and any(isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) for x in tree.body)


def suffix(text: str) -> str:
    """The first part, from a line that looks like code to the furthest line, that parses and defines a function; empty without one.

    The end moves back line by line, but at once to the line of the parser's error where that is earlier: every part that holds it has the same error.
    """
    rows = text.splitlines()
    if not any(x.lstrip().startswith(("def ", "async def ")) for x in rows):
        return ""
    for begin in (i for i, x in enumerate(rows) if BEGINS.match(x.lstrip())):
        end = len(rows)
        while end > begin:
            part = "\n".join(rows[begin:end]).strip()
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    tree = ast.parse(part)
            except SyntaxError as e:
                at = begin + (e.lineno or 0) - 1
                # The lines up to the error's are whole where the tokenizer got through them.
                end = min(end - 1, at + 1) if begin < at < end - 1 else end - 1
                continue
            except (ValueError, RecursionError, MemoryError):
                end -= 1
                continue
            if _defines(tree):
                return part
            # It parses without a function: of shorter parts one that defines one must hold its lines.
            end -= 1
            if not any(re.match(r"(async\s+)?def ", x if i else x.lstrip()) for i, x in enumerate(rows[begin:end])):
                break
    return ""


def extract(response: str | None) -> tuple[str, str, str]:
    """(status, code, note): a refusal has no code; then the largest fenced block, else the first part that parses."""
    text = (response or "").strip()
    if not text:
        return "no_code", "", NOTES["no_code"]
    lowered = text.lower()
    if any(r in lowered for r in REFUSALS):
        return "refusal", "", NOTES["refusal"]
    fences = re.findall(r"```(?:python)?\s*(.*?)```", text, re.I | re.S)
    if fences and (best := max(fences, key=len).strip()):
        return "ok", best, NOTES["fence"]
    if part := suffix(text):
        return "ok", part, NOTES["suffix"]
    return "malformed_response", "", NOTES["malformed_response"]


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("code", T.StringType()), T.StructField("note", T.StringType())]))
def extract_code(response: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(r) for r in response], columns=["status", "code", "note"])


@F.pandas_udf(T.StructType([T.StructField("parses", T.BooleanType()), T.StructField("functions", T.IntegerType()), T.StructField("classes", T.IntegerType()), T.StructField("first_function", T.StringType()), T.StructField("arity", T.IntegerType())]))
def code_facts(code: pd.Series) -> pd.DataFrame:
    """Facts of the syntax tree; nulls and zeros where the text doesn't parse."""
    out = []
    for text in code:
        tree = parsed(text or "")
        if tree is None:
            out.append((False, 0, 0, None, None))
            continue
        nodes = list(ast.walk(tree))
        defs = sorted((x for x in nodes if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)), key=lambda x: x.lineno)
        out.append((True, len(defs), sum(isinstance(x, ast.ClassDef) for x in nodes), defs[0].name if defs else None, len(defs[0].args.args) if defs else None))
    return pd.DataFrame(out, columns=["parses", "functions", "classes", "first_function", "arity"]).astype({"arity": "Int32"})


_INT = T.IntegerType()
SIGNATURE = T.StructType([T.StructField("functions", _INT), T.StructField("classes", _INT), T.StructField("name", T.StringType()), T.StructField("arity", _INT), T.StructField("kwonly", _INT), T.StructField("defaults", _INT), T.StructField("bad_types", T.BooleanType())])


def _tree(code: str) -> ast.Module | None:
    """The syntax tree of a module, or of its first ``def`` line alone with an empty body."""
    line = re.search(r"^[ \t]*(def[ \t]+\w+[ \t]*\(.*\)[^:\n]*):?", code, re.M)
    tree = parsed(code)
    return tree if tree is not None or not line else parsed(f"{line[1].rstrip()}: pass")


def _not_json(node: ast.AST) -> bool:
    """Whether an annotation holds a tuple, a set, or a mapping whose keys are not strings."""
    for x in ast.walk(node):
        if isinstance(x, ast.Name) and x.id in ("Tuple", "tuple", "Set", "set"):
            return True
        if isinstance(x, ast.Subscript) and isinstance(x.value, ast.Name) and x.value.id in ("Dict", "dict"):
            key = x.slice.elts[0] if isinstance(x.slice, ast.Tuple) and x.slice.elts else x.slice
            if not (isinstance(key, ast.Name) and key.id == "str"):
                return True
    return False


def signature(code: str | None) -> tuple:
    """Functions and classes of a module, and the name and parameters of its first function; zeros where nothing parses."""
    tree = _tree(code or "")
    nodes = list(ast.walk(tree)) if tree else []
    defs = sorted((x for x in nodes if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)), key=lambda x: x.lineno)
    classes = sum(isinstance(x, ast.ClassDef) for x in nodes)
    if not defs:
        return 0, classes, None, 0, 0, 0, False
    a = defs[0].args
    every = [*a.posonlyargs, *a.args, *a.kwonlyargs]
    notes = [x.annotation for x in every if x.annotation] + ([defs[0].returns] if defs[0].returns else [])
    return len(defs), classes, defs[0].name, len(every), len(a.kwonlyargs), len(a.defaults) + sum(x is not None for x in a.kw_defaults), any(map(_not_json, notes))


@F.pandas_udf(SIGNATURE)
def signature_facts(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([signature(x) for x in code], columns=SIGNATURE.names)
