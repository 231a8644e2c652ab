"""Why a file was scored as it was, in features and in words, and what to look at before changing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prediction import FEATURES, MODEL, _z, finite

#: How many recommendations a file gets.
MOST = 3


def contributions(rows: DataFrame, model: dict[str, list[float]] | None = None) -> dict[str, Column]:
    """What each feature adds to a row's log-odds; missing values count as the model's median."""
    model = model or MODEL
    return {name: z * c for name, z, c in zip(FEATURES, _z(model), model["coefficient"])}


def evidence_by_direction(rows: DataFrame, keep: list[str], model: dict[str, list[float]] | None = None) -> DataFrame:
    """(keep..., direction, rank, feature, value, contribution): all features of each row that speak for ("supports") or against ("contradicts") rework.

    Each side has the strongest first, ties by name; a feature without weight is on neither.
    """
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), finite(F.col(n)).alias("value"), c.alias("contribution")) for n, c in contributions(rows, model).items()])

    def ordered(side: str, keeps) -> Column:
        kept = F.transform(F.filter("_all", keeps), lambda x: F.struct((-F.abs(x.contribution)).alias("o"), x.feature.alias("feature"), x.value.alias("value"), x.contribution.alias("contribution")))
        return F.transform(F.array_sort(kept), lambda x, i: F.struct(F.lit(side).alias("direction"), (i + 1).alias("rank"), x.feature.alias("feature"), x.value.alias("value"), x.contribution.alias("contribution")))

    both = F.concat(ordered("supports", lambda x: x.contribution > 0), ordered("contradicts", lambda x: x.contribution < 0))
    return rows.withColumn("_all", parts).select(*keep, F.explode(both).alias("e")).select(*keep, "e.direction", "e.rank", "e.feature", "e.value", "e.contribution")


def summaries(scored: DataFrame, keep: list[str], name: str = "logistic_regression", n: int = 5) -> DataFrame:
    """(keep..., summary): one sentence of the outcome and one of the n features that weigh most. scored have the features, probability and predicted."""
    top = F.slice(F.array_sort(F.array(*[F.struct((-F.abs(c)).alias("o"), F.lit(f).alias("f")) for f, c in contributions(scored).items()])), 1, n)
    # The wording of the summary.
    outcome = F.when(F.col("predicted") == 1, "likely to require rework").otherwise("unlikely to require rework")
    return scored.select(*keep, F.format_string("%s predicts the file is %s (probability %.2f). Evidence associated with this prediction comes from: %s.", F.lit(name), outcome, F.col("probability"), F.array_join(F.transform(top, lambda x: x.f), ", ")).alias("summary"))


def related_file(examples: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, path, related): the first other file of the newest example in which each file changed with others.

    examples (repo, path, commit_sha, ts, event_type); commits have the nested files.
    """
    newest = Window.partitionBy("repo", "path").orderBy(F.desc(F.coalesce("ts", F.lit(0))), "commit_sha")
    first = examples.where("event_type = 'co_change'").withColumn("_k", F.row_number().over(newest)).where("_k = 1").select("repo", "path", F.col("commit_sha").alias("sha"))
    return first.join(commits.select("repo", "sha", "files.filename"), ["repo", "sha"]).select("repo", "path", F.array_min(F.filter("filename", lambda f: f != F.col("path"))).alias("related"))


def recommendations(rows: DataFrame, related: DataFrame, keep: list[str], n: int = MOST) -> DataFrame:
    """(keep..., rank, recommendation): up to n hints a row, in the order of the rules.

    A rule of a feature holds where its value is above 0 and it supports rework; the rule of
    related changes where the file changed with others. rows have repo, file_path and the features.
    """
    x = rows.join(related.withColumnRenamed("path", "file_path"), ["repo", "file_path"], "left")
    c = contributions(rows)
    speaks = lambda f: (finite(F.col(f)) > 0) & (c[f] > 0)
    # The wording of the rules.
    rules = [
        (speaks("historical_rework_frequency"), F.format_string("Historical changes suggest reviewing past rework in %s before modifying it.", "file_path")),
        (F.col("related").isNotNull(), F.format_string("Consider reviewing related changes in %s before modifying %s.", "related", "file_path")),
        (speaks("followup_frequency"), F.format_string("Check whether recent follow-up changes affect %s.", "file_path")),
        (speaks("propagation_frequency"), F.format_string("Historical changes suggest checking downstream files that previously changed after %s.", "file_path")),
        (speaks("coupling"), F.format_string("Consider reviewing coupled files of %s; its coupling is associated with rework.", "file_path")),
    ]
    hints = F.slice(F.array_compact(F.array(*[F.when(holds, says) for holds, says in rules])), 1, n)
    return x.select(*keep, F.posexplode(hints).alias("rank", "recommendation")).withColumn("rank", F.col("rank") + 1)


def edge_evidence(edges: DataFrame) -> Column:
    """What speaks for each ripple edge, in words that name its files; an array."""
    many = lambda n: F.when(F.col(n) == 1, "").otherwise("s")
    # The wording of the evidence.
    delay = F.when(F.col("median_follow_delay_seconds").isNotNull(), F.format_string(" Median historical delay: %ds.", "median_follow_delay_seconds")).otherwise("")
    return F.array_compact(F.array(
        F.when(F.col("dependency_score") > 0, F.format_string("Structural dependency relationship between %s and %s.", "source", "target")),
        F.when(F.col("cochange_count") > 0, F.format_string("Changed together in %d historical commit%s.", "cochange_count", many("cochange_count"))),
        F.when(F.col("follow_count") > 0, F.concat(F.format_string("%s followed %s in %d comparable change%s.", "target", "source", "follow_count", many("follow_count")), delay)),
        F.when(F.col("recent_follow_probability") > 0, F.lit("Recent coupling increased."))))
