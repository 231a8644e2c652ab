"""Scores of files by a fixed logistic model, why, and how good scores are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import numbered

STRUCTURAL = "file_size_bytes lines_of_code function_count cyclomatic_complexity max_nesting_depth incoming_dependencies outgoing_dependencies coupling num_dependents".split()
HISTORICAL = "previous_change_count historical_churn contributor_count time_since_last_change_secs recent_change_frequency historical_cochange_frequency".split()
TEMPORAL = "recent_change_sequence_count previous_files_changed_count change_window_count avg_change_delay_seconds change_order_count propagation_frequency followup_frequency historical_rework_frequency".split()
FEATURES = STRUCTURAL + HISTORICAL + TEMPORAL

# The published model, in the order of FEATURES.
MODEL = {
    "median": [2298.0, 90.0, 3.0, 3.0, 2.0, 0.0, 4.0, 4.0, 0.0, 1.0, 21.0, 1.0, 55385.0, 3.8580246913580245e-07, 16.0, 0.0, 30.0, 0.0, 862270.0, 3.0, 2.0, 0.0, 0.0],
    "mean": [3455.4028776978416, 120.46762589928058, 7.071942446043166, 6.115107913669065, 2.697841726618705, 0.6115107913669064, 4.39568345323741, 5.0071942446043165, 0.6115107913669064, 0.8273381294964028, 57.18705035971223, 0.6546762589928058, 234801.1366906475, 3.191890931699085e-07, 20.575539568345324, 0.4244604316546763, 31.359712230215827, 0.4244604316546763, 838037.9136690648, 2.661870503597122, 4.237410071942446, 1.2014388489208634, 0.19424460431654678],
    "scale": [4104.273911581278, 138.84463146168292, 9.926086760913222, 7.938685117274291, 2.6732209878290427, 1.655645634098941, 3.357839972525956, 3.292669868290717, 1.655645634098941, 0.7289300087188684, 99.91511277261498, 0.4754737163124692, 357438.7360560221, 2.812229971909215e-07, 22.446732603320715, 2.09822952865247, 24.993814254657597, 0.5225617207866152, 144751.33031873286, 2.4831922968692295, 6.454692937558837, 1.7839405743687906, 0.5347990659005986],
    "coefficient": [0.9053947672771728, 1.088265018839879, 0.2591043543754576, -0.9189819808602587, 0.25393062990826754, -0.019699407674123898, 0.2875789594164691, 0.2833654524133612, -0.019699407674123898, -0.46924280963506343, -0.7058227482680903, -1.788284704597151, 0.07048810366693233, -0.4692428096350634, 0.3239912522232733, -0.07545113242074322, -0.3117904815666692, -1.4637498309588022, 0.07544779347151086, 0.5113356773929001, 0.3865758511552951, 0.3856869448902394, -0.0988304545280916],
}
INTERCEPT, THRESHOLD = 0.833135958569064, 0.5


def finite(value: Column) -> Column:
    """A number, or null where it is none (NaN)."""
    return F.when(~F.isnan(value), value)


def flatten(rows: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the 23 features as doubles, out of the three nested columns; missing values stay null."""
    nested = [*[(f"structural.{c}", c) for c in STRUCTURAL], *[(f"historical.{c}", c) for c in HISTORICAL], *[(f"temporal.{c}", c) for c in TEMPORAL]]
    return rows.select(*keep, *[F.col(a).cast("double").alias(b) for a, b in nested])


def _z(model: dict[str, list[float]]) -> list[Column]:
    return [(F.nanvl(F.coalesce(F.col(c), F.lit(m)), F.lit(m)) - mean) / (scale or 1.0) for c, m, mean, scale in zip(FEATURES, model["median"], model["mean"], model["scale"])]


def score(rows: DataFrame, model: dict[str, list[float]] | None = None, intercept: float = INTERCEPT, threshold: float = THRESHOLD) -> DataFrame:
    """Add probability, predicted (0 or 1) and confidence (high, medium, low) to rows with the 23 features."""
    model = model or MODEL
    z = sum((x * c for x, c in zip(_z(model), model["coefficient"])), F.lit(intercept))
    p = 1.0 / (1.0 + F.exp(-z))
    return rows.withColumn("probability", p).withColumn("predicted", (F.col("probability") >= threshold).cast("int")).withColumn("confidence", band(F.col("probability")))


def band(p: Column) -> Column:
    strength = F.greatest(p, 1 - p)
    return F.when(strength >= 0.8, "high").when(strength >= 0.6, "medium").otherwise("low")


def likelihood(p: Column, label: Column) -> Column:
    return F.when(label != 1, "Low likelihood").when(band(p) == "high", "Likely").when(band(p) == "medium", "Possible").otherwise("Low likelihood")


def evidence(rows: DataFrame, keep: list[str], n: int = 5, model: dict[str, list[float]] | None = None) -> DataFrame:
    """(keep..., rank, feature, value, contribution, direction): each row's n features that weigh most, by size, then name."""
    model = model or MODEL
    all_ = F.array_sort(F.array(*[
        F.struct((-F.abs(z * c)).alias("o"), F.lit(name).alias("feature"), F.col(name).alias("value"), (z * c).alias("contribution")) for name, z, c in zip(FEATURES, _z(model), model["coefficient"])]))
    x = rows.select(*keep, F.posexplode(F.slice(all_, 1, n)).alias("rank", "e"))
    return x.select(*keep, (F.col("rank") + 1).alias("rank"), "e.feature", "e.value", "e.contribution", F.when(F.col("e.contribution") >= 0, "increases").otherwise("decreases").alias("direction"))


def latest(rows: DataFrame) -> DataFrame:
    """The latest row of each (repo, file_path) by timestamp, commit and row."""
    w = Window.partitionBy("repo", "file_path").orderBy(F.desc("timestamp"), F.desc("commit_sha"), F.desc("row_id"))
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def distribution(scored: DataFrame) -> DataFrame:
    """Per repo: rows in each confidence band and predicted positives."""
    return scored.groupBy("repo").agg(*[F.count_if(F.col("confidence") == b).alias(b) for b in ("high", "medium", "low")], F.count_if(F.col("predicted") == 1).alias("positive"))


def confusion(scored: DataFrame, by: list[str], actual: str = "label", predicted: str = "predicted") -> DataFrame:
    """(by..., tp, fp, tn, fn, precision, recall, f1, false_positive_rate); rates without a denominator are null."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    n = scored.groupBy(*by).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn"))
    rate = lambda x, y: F.try_divide(x, y)
    n = n.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("false_positive_rate", rate(F.col("fp"), F.col("fp") + F.col("tn")))


def ranking(scored: DataFrame, by: list[str], actual: str = "label", p: str = "probability") -> DataFrame:
    """(by..., roc_auc, average_precision, brier): exact, ties shared; null for groups of one class.

    Rows are summed per distinct score first, and scores by slots of a thousandth, so the running
    sums go over the slots and then over the scores of each.
    """
    at = scored.groupBy(*by, F.col(p).alias("_p")).agg(F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg"), F.sum((F.col(p) - F.col(actual)) ** 2).alias("sq"))
    at = at.withColumn("_slot", F.coalesce(F.floor(F.col("_p") * 1000), F.lit(-1)))
    above = Window.partitionBy(*by).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by, "_slot").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    slots = at.groupBy(*by, "_slot").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")).select(*by, "_slot", zero("_pos").alias("_tp"), zero("_neg").alias("_fp"))
    at = at.join(slots, [*by, "_slot"]).withColumn("tp", F.col("_tp") + F.sum("pos").over(down)).withColumn("fp", F.col("_fp") + F.sum("neg").over(down))
    total = at.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum("sq").alias("sq"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))).alias("ap"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return total.select(*by, F.when(both, F.col("area") / (F.col("P") * F.col("N"))).alias("roc_auc"), F.when(both, F.col("ap") / F.col("P")).alias("average_precision"), F.try_divide(F.col("sq"), F.col("P") + F.col("N")).alias("brier"))


def error_means(scored: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """(outcome, n, mean of every feature) of true and false positives and negatives."""
    outcome = F.when(F.col("predicted") == 1, F.when(F.col("label") == 1, "tp").otherwise("fp")).otherwise(F.when(F.col("label") == 1, "fn").otherwise("tn"))
    return scored.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in features])


def validate(rows: DataFrame, commits: DataFrame, changed: DataFrame) -> DataFrame:
    """(row_id, reason) of rows that cannot be: the first of empty-key, label, timestamp, duplicate, unknown-commit, positive-absent, impossible-negative.

    A row repeats an earlier row_id of the same commit and file; a positive's commit has to
    list the file, a negative's must not.
    """
    r = rows.select("row_id", "repo", "commit_sha", "file_path", "label", "timestamp")
    r = r.withColumn("_k", F.row_number().over(Window.partitionBy("repo", "commit_sha", "file_path").orderBy("row_id")))
    c = commits.select("repo", F.col("sha").alias("commit_sha")).distinct().withColumn("_c", F.lit(True))
    f = changed.select("repo", F.col("sha").alias("commit_sha"), F.col("path").alias("file_path")).distinct().withColumn("_f", F.lit(True))
    r = r.join(c, ["repo", "commit_sha"], "left").join(f, ["repo", "commit_sha", "file_path"], "left")
    empty = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    reason = (
        F.when(empty("commit_sha") | empty("file_path"), "empty-key").when(F.col("label").isNull() | ~F.col("label").isin(0, 1), "label").when(F.coalesce("timestamp", F.lit(0)) <= 0, "timestamp")
        .when(F.col("_k") > 1, "duplicate").when(F.col("_c").isNull(), "unknown-commit").when((F.col("label") == 1) & F.col("_f").isNull(), "positive-absent").when((F.col("label") == 0) & F.col("_f").isNotNull(), "impossible-negative"))
    return r.select("row_id", reason.alias("reason")).where("reason is not null")


def dataset_stats(rows: DataFrame) -> DataFrame:
    """Per repo: rows, positives and negatives with their share, distinct commits and files."""
    pos, n = F.count_if(F.col("label") == 1), F.count(F.lit(1))
    return rows.groupBy("repo").agg(n.alias("rows"), pos.alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), (pos / n).alias("positive_rate"), F.count_distinct("commit_sha").alias("commits"), F.count_distinct("file_path").alias("files"))


def chronological_split(rows: DataFrame, train: float = 0.70, validation: float = 0.15, at_least_one: bool = False) -> DataFrame:
    """(repo, commit_sha, split): a repository's commits in order of time and sha, whole, cut by their number.

    Parts are rounded down; with at_least_one every part has a commit. Fewer than three
    commits are all train.
    """
    c = numbered(rows.groupBy("repo", "commit_sha").agg(F.min("timestamp").alias("t")), "t", "commit_sha").withColumnsRenamed({"_i": "i", "_n": "n"})
    a, b = F.floor(F.col("n") * train + 1e-9), F.floor(F.col("n") * validation + 1e-9)
    if at_least_one:
        a = F.least(F.greatest(a, F.lit(1)), F.col("n") - 2)
        b = F.least(F.greatest(b, F.lit(1)), F.col("n") - a - 1)
    split = F.when((F.col("n") < 3) | (F.col("i") <= a), "train").when(F.col("i") <= a + b, "validation").otherwise("test")
    return c.select("repo", "commit_sha", split.alias("split"))


def time_windows(rows: DataFrame, k: int = 3) -> DataFrame:
    """(repo, fold, commit_sha, part): k expanding windows; each tests the next n div (k + 1) commits and trains on all before."""
    c = numbered(rows.groupBy("repo", "commit_sha").agg(F.min("timestamp").alias("t")), "t", "commit_sha").withColumn("i", F.col("_i") - 1).withColumnRenamed("_n", "n")
    size = F.greatest(F.lit(1), F.expr("n div 2")) if k == 1 else F.expr(f"n div {k + 1}")
    c = c.withColumn("s", size).where("s > 0").withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.col("n") - (k - F.col("fold") + 1) * F.col("s")
    part = F.when(F.col("i") < start, "train").when(F.col("i") < start + F.col("s"), "test")
    return c.select("repo", "fold", "commit_sha", part.alias("part")).where("part is not null")
