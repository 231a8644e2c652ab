"""Source files that are not valid in the language of their path.

Each language has a lexer with a pushdown stack, which tells unterminated literals,
unbalanced delimiters, premature ends and merge-conflict markers; for Rust and the
scripts it drives a parser of the language's grammar, for Python one of blocks and
statements, after which the interpreter's own grammar is asked.

Invalid is what the languages' own front ends call a syntax error: so a return, break
or continue with nothing around it counts in Python and the scripts, whose standards
make them early errors, and does not in Rust, whose grammar has them anywhere.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.syntax_js import Bad, Script
from tidemark.llm.syntax_python import MARKER, Python
from tidemark.llm.syntax_rust import Rust
from tidemark.session import ship

# The language of a path's extension.
LANGUAGES = {"rs": "Rust", "py": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TSX"}
SCRIPTS = {"JavaScript": "js", "TypeScript": "ts", "TSX": "tsx"}
#: Calls the parsers may hold at once (on the heap, about 250 bytes each): some 300,000 nested levels.
LIMIT = 2_000_000
#: The least Python whose own grammar has the last word on Python files.
GRAMMAR = (3, 13)


def language_of(path):
    """The language a path's extension names; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = None
    for e, name in LANGUAGES.items():
        out = (F.when if out is None else out.when)(ext == e, F.lit(name))
    return out


def fault(text: str | None, language: str | None) -> str | None:
    """What is wrong with a text in a language; null where nothing is (or nothing can be told)."""
    if not text or language is None:
        return None
    if language == "Python" and sys.version_info < GRAMMAR:
        raise RuntimeError(f"Python files are read by the grammar of {GRAMMAR}, which this worker's Python is too old for")
    if text[0] == "﻿":
        text = text[1:]
    if sys.getrecursionlimit() < LIMIT:
        sys.setrecursionlimit(LIMIT)
    try:
        if language == "Python":
            Python(text).check()
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "text", "exec", dont_inherit=True)
        elif language == "Rust":
            Rust(text).check()
        else:
            Script(text, SCRIPTS[language]).check()
    except Bad as e:
        at = text.rfind("\n", 0, e.at + 1) + 1
        return "merge conflict" if MARKER.match(text, at) or MARKER.match(text, max(0, e.at)) else e.why
    except SyntaxError as e:
        return "nested too deep" if "too many" in str(e) else "premature end" if "expected an indented block" in str(e) or "unexpected EOF" in str(e) else "unexpected token"
    except ValueError:
        return "stray sign"
    except (RecursionError, MemoryError):
        return "nested too deep"
    return None


def _faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["fault"] = [fault(t, k) for t, k in zip(batch.pop("_text"), batch["_language"])]
        yield batch


def unparsable(files: DataFrame, file_id: str = "file_id", repo: str = "repo", path: str = "path", content: str = "content") -> DataFrame:
    """(file_id, repo, language, fault) of every row whose path has one of the extensions and whose content is not null.

    language is that of the extension; fault says what makes the content invalid in it
    and is null where it is valid. Empty content and a leading byte-order mark are
    valid; contents are read whole; repeated rows count each. A text nested deeper than
    can be read (in Rust and the scripts some 300,000 levels, in Python what the
    interpreter takes) has the fault "nested too deep". No shuffle.
    """
    ship(files.sparkSession)
    kinds = {c: files.schema[c].dataType.simpleString() for c in (file_id, repo)}
    rows = files.select(F.col(file_id).alias("_id"), F.col(repo).alias("_repo"), language_of(F.col(path)).alias("_language"), F.col(content).alias("_text")).where("_language is not null and _text is not null")
    out = rows.mapInPandas(_faults, f"_id {kinds[file_id]}, _repo {kinds[repo]}, _language string, fault string")
    return out.select(F.col("_id").alias(file_id), F.col("_repo").alias(repo), F.col("_language").alias("language"), "fault")


def fault_rates(checked: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, language, files, invalid, share): the part of each repository's files of a language that is invalid."""
    return checked.groupBy(repo, "language").agg(
        F.count(F.lit(1)).alias("files"), F.count("fault").alias("invalid"), F.round(F.count("fault") / F.count(F.lit(1)), 6).alias("share"))
