"""Column expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories left out of histories; suffixes of files without text.
IGNORED = [".git", "target", "node_modules", "dist", "build"]
BINARY = "png jpg jpeg gif webp ico svg pdf zip gz tar mp3 mp4 mov avi wasm lock map".split()
LANGUAGES = {"rs": "Rust", "py": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "tsx": "TSX"}
MOST_SOURCE_BYTES = 1_000_000


def parts(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def is_ignored(path: Column) -> Column:
    """Whether a directory or the name itself, in any case, is one of IGNORED."""
    return F.exists(parts(path), lambda x: x.isin(IGNORED))


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-case text after the last dot of the name; empty where there is none."""
    return F.when(F.instr(name(path), ".") > 0, F.lower(F.substring_index(name(path), ".", -1))).otherwise(F.lit(""))


def language(path: Column) -> Column:
    out = None
    for ext, lang in LANGUAGES.items():
        out = (F.when if out is None else out.when)(extension(path) == ext, F.lit(lang))
    return out


def parent(path: Column) -> Column:
    """The text before the last slash; empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def directory(path: Column) -> Column:
    return F.when(parent(path) == "", F.lit("(root)")).otherwise(parent(path))


def is_source_candidate(path: Column, size: Column, kind: Column | None = None) -> Column:
    """Files whose text is read: blobs up to a size, not ignored, no binary suffix."""
    ok = ~is_ignored(path) & (F.coalesce(size, F.lit(0)) <= MOST_SOURCE_BYTES) & ~extension(path).isin(BINARY)
    return ok if kind is None else ok & (kind == "blob")


def _any(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def kind(path: Column) -> Column:
    """test, else config, else docs, else source."""
    low, file = F.lower(path), name(F.lower(path))
    test = _any(low.rlike("(^|/)tests?/"), low.contains("__tests__"), file.contains(".test."), file.contains("_test."), file.rlike("^(test_|conftest)"))
    config = _any(low.contains("config"), low.contains("settings"), file.startswith(".env"), file.rlike(r"\.(env\.example|yml|yaml|toml|ini)$"))
    docs = _any(low.rlike("(^|/)docs/"), file.rlike(r"\.(md|rst)$"))
    return F.when(test, "test").when(config, "config").when(docs, "docs").otherwise("source")


def kind_of_text(path: Column) -> Column:
    """The coarser variant: test, configuration, documentation or source."""
    low, file = F.lower(path), name(F.lower(path))
    test = _any(low.contains("/test"), F.array_contains(F.split(file, r"\."), "test"), file.startswith("test_"))
    config = _any(low.contains("config"), low.contains("setting"), file.startswith(".env"), file.rlike(r"\.(yml|yaml|toml|ini)$"))
    docs = _any(low.rlike("(^|/)docs/"), file.endswith(".md"))
    return F.when(test, "test").when(config, "configuration").when(docs, "documentation").otherwise("source")


def kind_shown(path: Column) -> Column:
    """The variant of lists shown to people: test, config or source."""
    low, file = F.lower(path), name(F.lower(path))
    test = _any(low.rlike("/tests?/"), low.contains("__tests__"), file.contains(".test."), file.contains("_test."), file.startswith("test_"), file == "conftest.py")
    config = _any(file.rlike(r"\.(yml|yaml|toml|ini)$"), file.startswith(".env"), low.rlike("/(config|settings)/"), file.isin("config", "settings"))
    return F.when(test, "test").when(config, "config").otherwise("source")


def renamed(path: Column) -> Column:
    """The new path of a rename written as ``a/{old => new}/b`` or ``old => new``, without quotes."""
    bare = F.regexp_replace(path, r'^"|"$', "")
    inside = F.regexp_replace(bare, r"\{[^{}]* => ([^{}]*)\}", "$1")
    whole = F.regexp_replace(inside, r"^.* => ", "")
    return F.regexp_replace(whole, "//+", "/")


def status(letter: Column) -> Column:
    """The word for a status letter; anything unknown is modified."""
    first = F.upper(F.substring(letter, 1, 1))
    return F.when(first == "A", "added").when(first == "D", "removed").when(first == "R", "renamed").when(first == "C", "copied").otherwise("modified")
