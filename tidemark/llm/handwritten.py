"""Source files nobody wrote by hand in their repository: generated, minified, vendored, or data as code.

Layout statistics (line lengths, shares of white space and letters, density of number
literals, long encoded runs) against thresholds per language come first. What was written
by a tool or taken over can look like any other code, so after them count the notice
in a file's first or last comment, the place of its path, and exact copies of a vendored
file, found by the digest of their content; ``evidence`` says which of them spoke. All of it
is built-in expressions; the costly patterns are only tried on texts whose cheap counts leave
them a chance. The only shuffle is the one on digests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.syntax import language_of
from tidemark.session import cut


@dataclass(frozen=True)
class Layout:
    """Thresholds of one language; a line counts as long from long_line characters on."""

    long_line: int = 400
    long_share: float = 0.5  # of the text in long lines
    longest: int = 2000  # no one writes a line of so many characters ...
    code_space: float = 0.14  # ... of code; prose has more white space than this
    dense_mean: float = 110.0  # mean line length of minified code ...
    dense_space: float = 0.10  # ... with no more white space than this
    packed: float = 0.33  # so few letters and digits are left where names are packed into signs ...
    packed_mean: float = 60.0  # ... in lines of this mean length
    letters_mean: float = 45.0  # the mean line length from which the share of letters tells something
    blob: float = 0.86  # so many are there only in encoded data
    numbers: float = 0.36  # number literals among the words
    least_numbers: int = 80
    encoded: float = 0.45  # of the text in encoded runs
    least_size: int = 400  # characters from which shares of letters and of encoded runs tell something
    rows: float = 0.55  # of the lines that are rows of values
    least_rows: int = 25
    shapes: float = 0.08  # different line shapes among the lines of what a tool repeats
    least_lines: int = 60


# Written code of 33,000 files of each language's own style has lines of at most 910 characters; letters and digits are
# 43 to 78 % of it in Rust, 48 to 82 % in Python, 46 to 82 % in JavaScript, 52 to 80 % in the others.
LAYOUTS = {
    "Rust": Layout(numbers=0.40, packed=0.30, blob=0.84),
    "Python": Layout(packed=0.32),
    "JavaScript": Layout(longest=1500, packed=0.32),
    "TypeScript": Layout(long_line=600, packed=0.36),
    "TSX": Layout(long_line=600, packed=0.36),
}

# How tools and other projects sign their files, in the words of several languages.
TOOL = (
    r"(?i)(@generated\b|\bauto-?generated\b|\bautomatically generated\b|\bcode generated by\b|\bgenerated (on \S+ )?(by|from)\b|\bautomatic bindings\b"
    r"|\bdo not (edit|modify)\b|\bdon't edit\b|\bchanges will be (lost|overwritten)\b|\bgénéré (par|automatiquement)|\bne pas modifier\b|\berzeugt (durch|von)\b"
    r"|\bnicht von hand\b|\bgenerado (por|automáticamente)|\bno (editar|modificar)\b|\bgerado (por|automaticamente)|\bnão (editar|edite|modificar|modifique)\b"
    r"|\bgenerato (da|automaticamente)|\bnon modificare\b|\bwygenerowan|\bnie edytowa|создан автоматически|сгенерирован|не редактир|自动生成|请勿(修改|编辑)|自動生成|編集しないで|자동 생성|수정하지 마)"
)
MENTION = r"(?i)^\W*(reads|writes|parses|loads|checks|edits|formats|lists|prints|finds|tests|removes)\b"
OTHERS = (
    r"(?i)(^|\s)(@license\b|@preserve\b)|\bupstream:|\bimported unchanged\b|\blocal copy of\b|\bvendored from\b|\bcopied from\b|\btaken from\b"
    r"|\bcontributors, released under\b|^\W*[\w.-]+ v?\d+(\.\d+)+ - (MIT|BSD|Apache|ISC|MPL|GPL)"
)
PLACE = (
    r"(?i)(^|/)(third[_-]?party|3rd[_-]?party|vendor|vendored|node_modules|bower_components|external|externals|extern|deps|site-packages|jspm_packages)/"
    r"|(^|/)[\w.-]*[a-z][\w-]*[-.]v?\d+\.\d+(\.\d+)+(\.min)?\.(c|m)?jsx?$|/\d+\.\d+(\.\d+)+/[^/]+$"
)
TOOL_PLACE = r"(?i)(^|/)(__generated__|generated|gen|autogen|auto_generated)/|[._-](generated|gen|g|pb|pb2|pb2_grpc|grpc|auto)\.[a-z]+$"
MINIFIED_NAME = r"(?i)\.min\.(js|mjs|cjs)$"
PACKED = r"^\s*eval\(function\(p,a,c,k,e,[dr]\)"


def leading_comment(text: Column) -> Column:
    """The comments (or docstring) before the first code, however long."""
    block = r"\A﻿?(?:#![^\n]*\n)?((?:\s*(?:(?://|#(?!\[|!\[))[^\n]*(?:\n|\z)|/\*(?:[^*]|\*(?!/))*+\*/|\"\"\"(?:[^\"]|\"(?!\"\"))*+\"\"\"|'''(?:[^']|'(?!''))*+'''))*+)"
    return F.regexp_extract(text, block, 1)


def closing_comment(text: Column, lines: Column) -> Column:
    """The comment lines after the last code, of a text's lines: those behind the last line that is neither blank nor a comment."""
    is_code = F.transform(F.reverse(lines), lambda x: ~x.rlike(r"^\s*+(?:(?://|#(?!\[|!\[)|\*|/\*).*)?$"))
    behind = F.coalesce(F.array_position(is_code, F.lit(True)).cast("int"), F.lit(0)) - 1
    last = F.substring_index(F.rtrim(F.rtrim(text, F.lit("\r\n\t ")), F.lit(" \r\n\t")), "\n", -1)
    none = F.array().cast("array<string>")
    return F.when(last.rlike(r"^\s*+(//|#|\*|/\*)") | F.endswith(last, F.lit("*/")), F.when(behind > 0, F.slice(lines, F.size(lines) - behind + 1, behind)).otherwise(none)).otherwise(none)


def _at_least(text: Column, signs: str, n: int) -> Column:
    """Whether a text has n of some signs; the pattern stops at the n-th."""
    return text.rlike(rf"\A(?:[^{signs}]*+[{signs}]){{{n}}}") if n > 0 else F.lit(True)


def layout_statistics(text: Column, lines: Column, language: bool = True) -> dict[str, Column]:
    """Statistics of a text and its lines, each a column; with the limits of a language the costly ones only where they can matter.

    Then numbers and words are null where there are too few digits or quotes for data and no long lines,
    space and alnum where lines are short, rows 0 where there are too few separators, encoded 0 where no
    run can be long enough, shapes null where there are too few lines to repeat.
    """
    limit = _limit if language else (lambda name: F.lit(0))
    least = min(x.least_numbers for x in LAYOUTS.values()) if language else 0
    lengths = F.transform(lines, lambda x: F.length(x))
    size = F.greatest(F.length(text), F.lit(1))
    n = F.size(lines)
    long, mean = F.array_max(lengths), size / n
    wide = long >= limit("long_line")
    many_digits, many_quotes = _at_least(text, "0-9", least), _at_least(text, "\"'", 2 * least)
    runs = F.regexp_extract_all(text, F.lit(r"((?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}|(?:\\x[0-9a-fA-F]{2}(?:\\n)?[a-z]{0,10}){8,}|(?<!\w)(?:(?:0x[0-9a-fA-F]{1,2}|\d{1,3}), *){24,})"), F.lit(1))
    row = r"^\s*+[\[({]?\s*+(?:(?:-?\d[\d.eE+-]*+|\"[^\"]*+\"|'[^']*+'|\w++) *+[,;|\t] *+){2,}(?:-?[\w.]++|\"[^\"]*+\")?\s*+[\])}]?[,;]?\s*+$"
    could_be_run = (long >= 40) & (size >= limit("least_size")) & (F.contains(text, F.lit("\\x")) | many_digits | text.rlike(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}"))
    return {
        "max_line": long,
        "mean_line": mean,
        "space": F.when((mean >= limit("dense_mean")) | wide, (size - F.length(F.translate(text, " \t\r\n\f", ""))) / size),
        "alnum": F.when((size >= limit("least_size")) & (mean >= limit("letters_mean")), F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")) / size),
        "words": F.when(many_digits | many_quotes | wide, F.regexp_count(text, F.lit(r"\w++"))),
        "numbers": F.when(many_digits | wide, F.regexp_count(text, F.lit(r"(?<![\w.])-?(?:0x[0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?)(?![\w.])"))),
        "quoted": F.when(many_quotes, F.regexp_count(text, F.lit(r"\"[^\"\n]*+\" *,|'[^'\n]*+' *,"))),
        "encoded": F.when(could_be_run, F.aggregate(runs, F.lit(0), lambda a, x: a + F.length(x)) / size).otherwise(0.0),
        "rows": F.when(_at_least(text, ",;|\\t", 2 * min(x.least_rows for x in LAYOUTS.values()) if language else 0), F.size(F.filter(lines, lambda x: x.rlike(row)))).otherwise(0),
        "n_lines": n,
        "shapes": F.when(n >= limit("least_lines"), F.size(F.array_distinct(F.transform(lines, lambda x: F.regexp_replace(x, r"\w++", "w"))))),
        "long_share": F.when(wide, F.aggregate(F.filter(lengths, lambda k: k >= limit("long_line")), F.lit(0), lambda a, k: a + k) / size).otherwise(0.0),
    }


def _limit(name: str) -> Column:
    out = None
    for language, layout in LAYOUTS.items():
        out = (F.when if out is None else out.when)(F.col("language") == language, F.lit(getattr(layout, name)))
    return out


def not_handwritten(files: DataFrame, file_id: str = "file_id", path: str = "path", content: str = "content") -> DataFrame:
    """(file_id, reason, evidence) of every file with a known extension that nobody wrote by hand where it is.

    reason: "minified", "data" or "generated" if the layout says so, else "generated" (its first or
    last comment says a tool wrote it, or its path does), or "vendored" (its
    path or notice says it was taken over, or it is an exact copy of such a file).
    The first that holds in this order is given. evidence: which of "layout", "notice",
    "place" and "copy" speak for the file. Null and empty
    contents, other extensions and null paths are never cases (an empty file in a
    vendored place is: its path alone tells); each fetched row counts. Texts are read
    whole.
    """
    f = files.select(F.col(file_id).alias("_id"), F.col(path).alias("_path"), F.col(content).alias("_text"), language_of(F.col(path)).alias("language")).where("language is not null and _text is not null")
    f = f.withColumn("_lines", F.split("_text", "\n")).withColumn("_head", leading_comment(F.col("_text")))
    notes = F.concat(F.filter(F.split("_head", "\n"), lambda x: ~x.rlike(MENTION)), closing_comment(F.col("_text"), F.col("_lines")))
    f = f.select("*", *[column.alias(f"_{name}") for name, column in layout_statistics(F.col("_text"), F.col("_lines")).items()])
    c = lambda name: F.col(f"_{name}")
    said = lambda column: F.coalesce(column, F.lit(False))
    long_lines = (c("long_share") >= _limit("long_share")) | (c("max_line") >= _limit("longest"))
    listed = said((c("quoted") >= _limit("least_numbers")) & (c("quoted") >= 0.6 * c("words")))
    encoded = (c("encoded") >= _limit("encoded")) & (F.length("_text") >= _limit("least_size"))
    data = said(
        (c("numbers") >= _limit("least_numbers")) & (c("numbers") >= _limit("numbers") * c("words"))
        | encoded
        | (c("alnum") >= _limit("blob"))
        | (c("rows") >= _limit("least_rows")) & (c("rows") >= _limit("rows") * c("n_lines"))
        | long_lines & (c("space") > _limit("dense_space")) & (c("numbers") >= 0.2 * c("words")) & (c("words") > 0)
    ) | listed
    dense = said((c("space") <= _limit("dense_space")) & ((c("mean_line") >= _limit("dense_mean")) | long_lines))
    packed = (c("alnum") <= _limit("packed")) & (c("mean_line") >= _limit("packed_mean"))
    minified = said(F.col("_text").rlike(PACKED) | dense & ~encoded & ~listed | packed)
    endless = (c("max_line") >= _limit("longest")) & (c("space") <= _limit("code_space"))
    repeated = said((c("n_lines") >= _limit("least_lines")) & (c("shapes") <= _limit("shapes") * c("n_lines")) & ~(c("rows") >= _limit("rows") * c("n_lines")))
    f = f.select(
        "_id", "_path", "_text", notes.alias("_notes"), F.when(minified, "minified").when(data, "data").when(endless, "minified").when(repeated, "generated").alias("_layout"))
    tool, other = F.exists("_notes", lambda x: x.rlike(TOOL)), F.exists("_notes", lambda x: x.rlike(OTHERS))
    by_place = F.when(F.col("_path").rlike(TOOL_PLACE), "generated").when(F.col("_path").rlike(PLACE), "vendored").when(F.col("_path").rlike(MINIFIED_NAME), "minified")
    f = f.select("_id", F.sha2("_text", 256).alias("_digest"), F.length("_text").alias("_size"), "_layout", F.when(tool, "generated").when(other, "vendored").alias("_notice"), by_place.alias("_place"), (other | F.col("_path").rlike(PLACE)).alias("_vendored"))
    f = cut(f.withColumn("reason", F.coalesce("_layout", F.when((F.col("_notice") == "generated") | (F.col("_place") == "generated"), "generated"), F.col("_notice"), F.col("_place"))))
    originals = f.where("_vendored and _size > 0").select("_digest").distinct()
    speaks = F.array_compact(F.array(*[F.when(F.col(f"_{x}").isNotNull(), x) for x in ("layout", "notice", "place")]))
    rest = f.where("reason is null and _size > 0").join(originals, "_digest", "left_semi").select("_id", F.lit("vendored").alias("reason"), F.array(F.lit("copy")).alias("evidence"))
    return f.where("reason is not null").select("_id", "reason", speaks.alias("evidence")).unionByName(rest).withColumnRenamed("_id", file_id)
