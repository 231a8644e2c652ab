"""Queries of the corpus operators (p1-p4, p6, p8-p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import grouped_split, related_commits
from tidemark.llm.cooccurrence import SIGNIFICANT, cooccurrence
from tidemark.llm.encodings import wrong_encodings
from tidemark.llm.handwritten import not_handwritten
from tidemark.llm.mixing import mix_report, mix_sources, shard_report
from tidemark.llm.syntax import fault_rates, unparsable
from tidemark.llm.subsequences import frequent_subsequences
from tidemark.llm.tokens import token_counts, token_ids
from tidemark.session import cut


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _related(spark: SparkSession, d: str) -> DataFrame:
    return cut(related_commits(_table(spark, d, "commits"), _table(spark, d, "author_aliases"), _table(spark, d, "dataset_rows").select("commit_sha", "series_id")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The commits of dataset_rows related to another one there, with the smallest sha of their group."""
    related = _related(spark, d)
    groups = related.groupBy("root").agg(F.min("commit_sha").alias("group_sha"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return related.join(groups, "root").select("commit_sha", "group_sha")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Each dataset row's split (about 70, 15 and 15 %), no group of related commits in two."""
    rows = _table(spark, d, "dataset_rows").select("row_id", F.lower("commit_sha").alias("commit_sha"))
    grouped = cut(rows.join(_related(spark, d), "commit_sha", "left").select("row_id", "root"))
    return grouped_split(grouped, "row_id", "root", {"train": 0.70, "validation": 0.15, "test": 0.15})


def p1_holds(spark: SparkSession, d: str) -> DataFrame:
    """One row: the rows in a split, groups of related commits in two splits, and whether each share is met to within one point, or the largest group where that is more."""
    rows = _table(spark, d, "dataset_rows").select("row_id", F.lower("commit_sha").alias("commit_sha"))
    grouped = cut(rows.join(_related(spark, d), "commit_sha", "left").select("row_id", "root"))
    want = {"train": 0.70, "validation": 0.15, "test": 0.15}
    split = cut(grouped_split(grouped, "row_id", "root", want))
    torn = grouped.join(split, "row_id").where("root is not null").groupBy("root").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"))
    target = F.create_map(*[F.lit(x) for pair in want.items() for x in pair])
    got = split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    most = grouped.where("root is not null").groupBy("root").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k").alias("most"))
    total = got.agg(F.sum("n").alias("rows")).crossJoin(F.broadcast(most))  # one row each
    return got.crossJoin(F.broadcast(total)).agg(F.first("rows").alias("rows"), F.bool_and(F.abs(F.col("n") / F.col("rows") - target[F.col("split")]) <= F.greatest(F.lit(0.01), F.coalesce("most", F.lit(0)) / F.col("rows"))).alias("shares_hold")).crossJoin(F.broadcast(torn))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Triples of paths changed one after another in many series of a repository."""
    return p2_sequences(spark, d).select("repo", "path_1", "path_2", "path_3")


def p2_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The triples of p2_found with their number of series."""
    rows = _table(spark, d, "dataset_rows").where("label = 1 and series_id is not null").select("repo", "series_id", "timestamp", "file_path")
    found = frequent_subsequences(rows, "repo", "series_id", "timestamp", "file_path", min_count=8, min_share=0.06, shortest=3, longest=3, repeats=False)
    return found.select("repo", *[F.col("pattern")[i].alias(f"path_{i + 1}") for i in range(3)], F.col("support").alias("n_series"))


def _pairs(spark: SparkSession, d: str, min_lift: float, **more) -> DataFrame:
    rows = _table(spark, d, "dataset_rows").where("label = 1").select("repo", "commit_sha", "file_path")
    return cooccurrence(rows, "repo", "commit_sha", "file_path", min_count=8, min_lift=min_lift, **more)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The source files nobody wrote by hand in their repository."""
    return not_handwritten(_table(spark, d, "source_files")).select("file_id")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Those files with the reason why."""
    return not_handwritten(_table(spark, d, "source_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files that change together at least 8 times and 4 times as often as by chance."""
    return _pairs(spark, d, 4.0).select("repo", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of files that change together at least 8 times, with lift and log-likelihood ratio."""
    return _pairs(spark, d, 0.0).select("repo", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), "llr")


def p4_significant(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of files that change together more often than by chance, as their log-likelihood ratio tells (a chance below 1 in 1000)."""
    return _pairs(spark, d, 1.0, min_llr=SIGNIFICANT).select("repo", F.col("item_a").alias("path_a"), F.col("item_b").alias("path_b"), "n_ab", "llr")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The source files that are not valid in the language of their path."""
    return unparsable(_table(spark, d, "source_files")).where("fault is not null").select("file_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of such files per repository and language."""
    return fault_rates(unparsable(_table(spark, d, "source_files")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k; none for null and empty texts."""
    return token_ids(_table(spark, d, "documents"), ["doc_id"])


def p8_empty(spark: SparkSession, d: str) -> DataFrame:
    """For every document, whether its list of ids is empty."""
    return token_ids(_table(spark, d, "documents"), ["doc_id"]).select("doc_id", (F.size("ids") == 0).alias("empty"))


#: Tokens of a shard of p9: the splitting tree is drawn from some ten thousand documents on.
SHARD_TOKENS = 32_768


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = cut(token_counts(_table(spark, d, "documents"), ["doc_id", "source"]))
    targets = _table(spark, d, "mix_targets")
    return mix_sources(docs, targets, shard_tokens=SHARD_TOKENS), targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix of mix_targets, with their shard and number of copies."""
    return _mixed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """The share of the tokens each source reached in each mix, beside its target."""
    return mix_report(*_mixed(spark, d))


def p9_shards(spark: SparkSession, d: str) -> DataFrame:
    """The size of every shard of every mix."""
    return shard_report(_mixed(spark, d)[0])


def p9_holds(spark: SparkSession, d: str) -> DataFrame:
    """For every target: whether its source has documents, whether its share is met (to within half a document of each source), and its cap."""
    docs = cut(token_counts(_table(spark, d, "documents"), ["doc_id", "source"]))
    targets = _table(spark, d, "mix_targets")
    mixed = cut(mix_sources(docs, targets, shard_tokens=SHARD_TOKENS))
    got = mix_report(mixed, targets).join(docs.where("n_tokens > 0").select("source").distinct().withColumn("given", F.lit(True)), "source", "left")
    able = got.where("given and target_share > 0").groupBy("mix_name").agg(F.sum("target_share").alias("able"), F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("sources"))
    longest = mixed.groupBy("mix_name").agg(F.max("n_tokens").alias("longest"))
    off = F.abs(F.col("tokens") - F.col("target_share") / F.col("able") * F.col("total"))
    caps = targets.groupBy("mix_name", "source").agg(F.min("max_repeats").alias("cap"))
    return got.join(caps, ["mix_name", "source"]).join(able, "mix_name", "left").join(longest, "mix_name", "left").select(
        "mix_name", "source", F.coalesce("given", F.lit(False)).alias("given"),
        F.when(F.col("given"), off <= F.coalesce("longest", F.lit(0)) * (F.col("sources") + 1) / 2).otherwise(F.col("tokens") == 0).alias("share_holds"), (F.col("most_copies") <= F.coalesce("cap", "most_copies")).alias("cap_holds"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents with a stretch of text that was decoded with a wrong encoding."""
    return wrong_encodings(_table(spark, d, "documents")).where("garbled").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """Those documents with their text restored as far as possible and the decodings that went wrong."""
    return wrong_encodings(_table(spark, d, "documents")).where("garbled").select("doc_id", F.col("restored").alias("text"), F.array_join("chains", "; ").alias("chains"))


QUERIES = {
    "p1_found": p1_found, "p1_splits": p1_splits, "p1_holds": p1_holds, "p2_found": p2_found, "p2_sequences": p2_sequences,
    "p3_found": p3_found, "p3_reasons": p3_reasons, "p4_found": p4_found, "p4_pairs": p4_pairs, "p4_significant": p4_significant, "p6_found": p6_found, "p6_rates": p6_rates, "p8_ids": p8_ids, "p8_empty": p8_empty, "p9_mix": p9_mix, "p9_report": p9_report, "p9_shards": p9_shards, "p9_holds": p9_holds,
    "p10_found": p10_found, "p10_restored": p10_restored,
}

P1_FOUND = r"""
WITH RECURSIVE c AS (
  SELECT DISTINCT lower(sha) AS sha, coalesce(nullif(lower(trim(author.email)), ''), nullif(lower(trim(author.name)), '')) AS who, lower(message) AS message FROM commits),
r AS (SELECT DISTINCT 'c' || lower(commit_sha) AS k FROM dataset_rows WHERE commit_sha IS NOT NULL),
grams AS (
  SELECT DISTINCT sha, substr(run, i::BIGINT, 12) AS head FROM (
    SELECT sha, run, unnest(range(1, length(run) - 10)) AS i FROM (SELECT sha, unnest(regexp_extract_all(message, '[0-9a-f]{12,}')) AS run FROM c))),
e AS (
  SELECT 'c' || sha AS a, 'a' || who AS b FROM c WHERE who IS NOT NULL
  UNION SELECT 'a' || lower(trim(alias_key)), 'a' || lower(trim(canonical_key)) FROM author_aliases
  UNION SELECT 'c' || lower(commit_sha), 's' || series_id FROM dataset_rows WHERE series_id IS NOT NULL
  UNION SELECT 'c' || g.sha, 'c' || c.sha FROM grams g JOIN c ON substr(c.sha, 1, 12) = g.head WHERE g.sha <> c.sha),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT k AS origin, k AS node FROM r
  UNION SELECT reach.origin, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.node)
SELECT substr(origin, 2) AS commit_sha, min(substr(node, 2)) AS group_sha
FROM reach JOIN r ON r.k = reach.node GROUP BY origin HAVING count(*) > 1"""

P2_SEQUENCES = """
WITH r AS (SELECT DISTINCT repo, series_id, timestamp AS t, file_path AS p FROM dataset_rows WHERE label = 1 AND series_id IS NOT NULL),
n AS (SELECT repo, count(DISTINCT series_id) AS n FROM r GROUP BY repo),
f AS (SELECT repo, p FROM r JOIN n USING (repo) GROUP BY repo, p, n HAVING count(DISTINCT series_id) >= 8 AND count(DISTINCT series_id) * 100 >= 6 * n),
k AS (SELECT r.* FROM r JOIN f USING (repo, p)),
a AS (SELECT repo, series_id, p, min(t) AS t FROM k GROUP BY repo, series_id, p),
ab AS (SELECT a.repo, a.series_id, a.p AS p1, k.p AS p2, min(k.t) AS t FROM a JOIN k ON a.repo = k.repo AND a.series_id = k.series_id AND k.t > a.t AND k.p <> a.p GROUP BY ALL),
abc AS (SELECT DISTINCT ab.repo, ab.series_id, p1, p2, k.p AS p3 FROM ab JOIN k ON ab.repo = k.repo AND ab.series_id = k.series_id AND k.t > ab.t AND k.p <> p1 AND k.p <> p2)
SELECT repo, p1 AS path_1, p2 AS path_2, p3 AS path_3, count(*) AS n_series FROM abc JOIN n USING (repo)
GROUP BY repo, p1, p2, p3, n HAVING count(*) >= 8 AND count(*) * 100 >= 6 * n"""

P4_COUNTS = """
WITH r AS (SELECT DISTINCT repo, commit_sha, file_path AS p FROM dataset_rows WHERE label = 1),
n AS (SELECT repo, count(DISTINCT commit_sha) AS n FROM r GROUP BY repo),
f AS (SELECT repo, p, count(*) AS k FROM r GROUP BY repo, p),
x AS (SELECT a.repo, a.p AS path_a, b.p AS path_b, count(*) AS n_ab FROM r a JOIN r b ON a.repo = b.repo AND a.commit_sha = b.commit_sha AND a.p < b.p GROUP BY 1, 2, 3 HAVING count(*) >= 8),
y AS (SELECT x.repo, path_a, path_b, n, fa.k AS n_a, fb.k AS n_b, n_ab FROM x JOIN n USING (repo)
  JOIN f fa ON fa.repo = x.repo AND fa.p = path_a JOIN f fb ON fb.repo = x.repo AND fb.p = path_b)"""


def _cell(k: str, r: str, c: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN ({k}) * ln(({k}) * n::DOUBLE / (({r}) * ({c}))) ELSE 0.0 END)"


LLR = " + ".join([_cell("n_ab", "n_a", "n_b"), _cell("(n_a - n_ab)", "n_a", "n - n_b"), _cell("(n_b - n_ab)", "n - n_a", "n_b"), _cell("(n - n_a - n_b + n_ab)", "n - n_a", "n - n_b")])

ORACLES = {
    "p1_found": P1_FOUND,
    "p2_sequences": P2_SEQUENCES,
    "p2_found": f"SELECT repo, path_1, path_2, path_3 FROM ({P2_SEQUENCES})",
    "p4_found": P4_COUNTS + " SELECT repo, path_a, path_b FROM y WHERE n_ab * n >= 4 * n_a * n_b",
    "p4_pairs": P4_COUNTS + f" SELECT *, round(n_ab * n / (n_a * n_b)::DOUBLE, 6) AS lift, round(2 * ({LLR}), 6) AS llr FROM y",
    "p1_holds": "SELECT count(*) AS rows, true AS shares_hold, 0::BIGINT AS torn FROM dataset_rows",
    "p8_empty": "SELECT doc_id, coalesce(text, '') = '' AS empty FROM documents",
    "p9_holds": """SELECT t.mix_name, t.source, count(d.source) > 0 AS given, true AS share_holds, true AS cap_holds FROM (
      SELECT mix_name, source, sum(target_share) AS w FROM (SELECT DISTINCT mix_name, source, target_share, max_repeats FROM mix_targets) WHERE mix_name IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) t
      LEFT JOIN (SELECT DISTINCT source FROM documents WHERE text <> '') d ON d.source = t.source AND t.w > 0 GROUP BY 1, 2""",
    "p4_significant": P4_COUNTS + f" SELECT * FROM (SELECT repo, path_a, path_b, n_ab, round(2 * ({LLR}), 6) AS llr FROM y WHERE n_ab * n >= n_a * n_b) WHERE llr >= {SIGNIFICANT}",
}
