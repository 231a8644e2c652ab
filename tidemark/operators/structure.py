"""Complexity of source texts: functions, decisions and nesting per file.

Python is read with the interpreter's grammar. Rust and the scripts are read by a
scanner that skips comments and literals, knows the words that decide, and follows
the braces. Texts Python cannot parse give no row, as an unparsable file has no
complexity.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths, text
from tidemark.session import ship

SKIP = {
    "Rust": re.compile(r"""//[^\n]*|/\*.*?\*/|r(\#*)".*?"\1|b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\[^\n]{1,9}?)'""", re.S),
    "script": re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|(?<=[=(,:\[!&|?{};])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*""", re.S),
}
WORDS = {
    "Rust": re.compile(r"\b(?:(?P<f>fn\s+\w+)|(?P<d>if|match|while|for(?!\s*<)|loop))\b|(?P<c>(?<=[=(,{\s])(?:move\s*)?\|[^|\n{};]*\|(?!\|))|(?P<o>\{)|(?P<e>\})"),
    "script": re.compile(r"(?P<f>\bfunction\b|=>)|\b(?P<d>if|for|while|do|case|catch)\b|(?P<t>\?(?![.?:]))(?!\?)|(?P<o>\{)|(?P<e>\})|\b(?P<n>switch|try)\b"),
}
METHOD = re.compile(r"^\s*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?!(?:if|for|while|switch|catch|function|return)\b)[#\w$]+\s*(?:<[^<>()]*>)?\([^()]*\)\s*(?::\s*[^={}\n]+)?\{", re.M)
NESTS = {"if", "match", "for", "while", "loop", "do"}


def _python(source: str) -> tuple[int, int, int] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    functions = decisions = deepest = 0
    stack: list[tuple[ast.AST, int]] = [(tree, 0)]
    while stack:
        node, depth = stack.pop()
        functions += isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda))
        decisions += isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler))
        nests = isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith))
        inner = depth + (2 if nests else 1 if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.ExceptHandler)) else 0)
        deepest = max(deepest, inner)
        for child in ast.iter_child_nodes(node):
            # an elif stands beside its if, not inside it
            beside = isinstance(node, ast.If) and isinstance(child, ast.If) and node.orelse == [child] and child.col_offset == node.col_offset
            stack.append((child, depth if beside else inner))
    return decisions + 1, functions, deepest


def _scanned(source: str, language: str) -> tuple[int, int, int]:
    kind = "Rust" if language == "Rust" else "script"
    bare = SKIP[kind].sub(lambda m: " " if m.group()[:1] in "/" else '""', source)
    functions = decisions = deepest = 0
    stack: list[int] = []
    depth = due = 0
    for m in WORDS[kind].finditer(bare):
        group = m.lastgroup
        if group in ("f", "c"):
            functions += 1
        elif group in ("d", "t"):
            decisions += 1
            if m.group() in NESTS:
                due += 1
                deepest = max(deepest, depth + due)
        elif group == "n":
            due += 1
        elif group == "o":
            step = 1 + due
            due = 0
            depth += step
            stack.append(step)
            deepest = max(deepest, depth)
        elif stack:
            depth -= stack.pop()
            due = 0
    if kind == "script":
        functions += len(METHOD.findall(bare))
    return decisions + 1, functions, deepest


def complexity_of(source: str, language: str) -> tuple[int, int, int] | None:
    """(cyclomatic complexity, functions, deepest nesting); null where the text cannot be read."""
    return _python(source) if language == "Python" else _scanned(source, language)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [complexity_of(t, k) for t, k in zip(batch.pop("content"), batch["language"])]
        keep = [x is not None for x in found]
        out = batch[keep].copy()
        for i, name in enumerate(("cyclomatic", "functions", "max_nesting_depth")):
            out[name] = pd.array([x[i] for x in found if x is not None], dtype="int64")
        yield out


def complexity(sources: DataFrame) -> DataFrame:
    """(repo, path, language, size_bytes, lines, cyclomatic, functions, max_nesting_depth) of files in a known language.

    size_bytes is that of the content as it is.
    """
    ship(sources.sparkSession)
    lang = paths.language(F.col("path"))
    s = sources.select("repo", "path", lang.alias("language"), F.octet_length("content").cast("bigint").alias("size_bytes"), text.line_count(F.col("content")).cast("bigint").alias("lines"), "content").where("language is not null and content is not null")
    return s.mapInPandas(_rows, "repo string, path string, language string, size_bytes bigint, lines bigint, cyclomatic bigint, functions bigint, max_nesting_depth bigint")


def structural_features(complexity: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The nine structural features of each file; no dependency counts as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias
    return complexity.join(dependencies, ["repo", "path"], "left").select(
        "repo", "path", F.col("size_bytes").alias("file_size_bytes"), F.col("lines").alias("lines_of_code"), F.col("functions").alias("function_count"), F.col("cyclomatic").alias("cyclomatic_complexity"), "max_nesting_depth",
        zero("incoming")("incoming_dependencies"), zero("outgoing")("outgoing_dependencies"), zero("coupling")("coupling"), zero("incoming")("num_dependents"))


def source_totals(sources: DataFrame) -> DataFrame:
    """Per repo: files, lines and bytes of the contents."""
    return sources.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum(text.line_count(F.col("content"))).alias("lines"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))
