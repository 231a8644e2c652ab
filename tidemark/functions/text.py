"""Column expressions over messages and other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a fix or a revert.
FIX_WORDS = "fix fixes fixed fixing bugfix bugfixes hotfix hotfixes patch patches patched revert reverts reverted reverting followup followups bug bugs".split()
REVERT_WORDS = "revert reverts reverted reverting".split()


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def _holds(text: Column, words: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tokens(text), F.array(*[F.lit(w) for w in words])), F.lit(False))


def is_fix(text: Column) -> Column:
    """Whether a whole word of the message marks a fix; null messages do not."""
    return _holds(text, FIX_WORDS)


def is_revert(text: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_replace(text, r"^\s+", "")).startswith("revert"), F.lit(False)) | _holds(text, REVERT_WORDS)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def first_sorted(values: Column, n: int = 3) -> Column:
    """The first values in order, joined by a comma."""
    return F.array_join(F.slice(F.array_sort(values), 1, n), ", ")


def line_count(text: Column) -> Column:
    """Lines, where a last line end begins no further line; 0 for empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)))


def epoch(date: Column) -> Column:
    """Seconds of an RFC 3339 date; null where it is none."""
    return F.unix_timestamp(F.try_to_timestamp(date))


def upper_median(values: Column) -> Column:
    """The element at half the size of the sorted array."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int")))


def repository_of(url: Column) -> Column:
    """owner/name of a forge's address or of owner/name itself; null where it is neither."""
    bare = F.regexp_replace(F.trim(url), r"(?i)^(https?://)?(www\.)?github\.com/|^git@github\.com:", "")
    found = F.regexp_extract(bare, r"^([A-Za-z0-9][A-Za-z0-9-]*)/([A-Za-z0-9._-]+?)(\.git)?(/.*)?(\?.*)?(#.*)?$", 0)
    return F.when(found != "", F.concat_ws("/", F.regexp_extract(bare, r"^([^/]+)/", 1), F.regexp_replace(F.regexp_extract(bare, r"^[^/]+/([^/?#]+)", 1), r"\.git$", "")))
