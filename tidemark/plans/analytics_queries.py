"""Queries of forecasts, scores and rollups, each with its SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths, text
from tidemark.operators import history as h
from tidemark.operators import impact, learning, prediction, ripple, rollups, scoring
from tidemark.plans.history_queries import EDGES, KIND, KIND_SHOWN, LINES, PAIRS, PARENT, PROP_TOP, PROPAGATION, TEMPORAL, TEMPORAL_PAIRS, World, _lang, q, sql
from tidemark.session import cut
from tidemark.sources.history import table

DESCRIPTION = "Replace the session cache with a token queue and search index"
TERMS = impact.terms_of_description(DESCRIPTION)
FEATURES = prediction.FEATURES


def _edges(w: World) -> DataFrame:
    return ripple.edges(w.commit_files, w.changes, w.pairs, w.edges)


def _rounded(df: DataFrame, *columns: str, n: int = 9) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, n))
    return df


def _last_commit(w: World) -> DataFrame:
    """The files of each repository's last commit."""
    return h.top(w.commit_files.where("ts is not null and size(files) > 0"), 1, F.desc("ts"), F.desc("sha")).select("repo", F.explode("files").alias("path"))


def _files(w: World) -> DataFrame:
    return w.sources.select("repo", "path", "content")


def _lines(w: World) -> DataFrame:
    """(repo, path, lines_of_code) of the latest sources: the line counts of the structural features, so 0 for files of no language."""
    lines = F.when(paths.language(F.col("path")).isNotNull(), text.line_count(F.col("content"))).otherwise(0)
    return w.sources.select("repo", "path", lines.cast("bigint").alias("lines_of_code"))


def _items(w: World) -> DataFrame:
    return impact.simulate(_files(w), TERMS, w.pairs, h.change_counts(w.changes), w.edges)


def _rows(w: World) -> DataFrame:
    return table(w.spark, w.d, "dataset_rows")


def _usable(w: World) -> DataFrame:
    return _rows(w).where("label in (0, 1) and timestamp > 0 and file_path <> ''")


def _flat(w: World) -> DataFrame:
    return prediction.flatten(_usable(w), "row_id", "repo", "commit_sha", "file_path", "timestamp", "label")


def _latest(w: World) -> DataFrame:
    return prediction.flatten(prediction.latest(_usable(w)), "row_id", "repo", "commit_sha", "file_path", "timestamp", "label")


def _scored(w: World) -> DataFrame:
    return _rounded(prediction.score(_flat(w)), "probability")


def _train_test(w: World) -> tuple[DataFrame, DataFrame]:
    split = prediction.chronological_split(_usable(w))
    both = _flat(w).join(split, ["repo", "commit_sha"])
    return both.where("split = 'train'"), both.where("split = 'test'")


def _hotspots(w: World) -> DataFrame:
    rows = prediction.latest(_usable(w)).select("repo", F.col("file_path").alias("path"), F.col("structural.cyclomatic_complexity").cast("double").alias("complexity"), F.col("historical.historical_churn").cast("double").alias("churn"),
        F.col("structural.coupling").cast("double").alias("coupling"), F.col("structural.max_nesting_depth").cast("double").alias("nesting"))
    return rows


def _imputed(w: World) -> DataFrame:
    train, _ = _train_test(w)
    fill = learning.medians(train)
    by = learning.scaling(learning.impute(train, fill))
    out = [(c, fill[c], *by[c]) for c in FEATURES]
    return _rounded(w.spark.createDataFrame(out, "feature string, median double, mean double, scale double"), "median", "mean", "scale", n=6)


def _calibration(w: World) -> DataFrame:
    split = prediction.chronological_split(_usable(w))
    both = _flat(w).join(split, ["repo", "commit_sha"])
    model = learning.Model("logistic_regression").fit(both.where("split = 'train'"))
    sigmoid = learning.calibrate(model.score(both.where("split = 'validation'")))
    raw = model.score(both.where("split = 'test'"))
    return learning.metrics(raw, "raw").unionByName(learning.metrics(learning.calibrated(sigmoid, raw), "calibrated"))


def _importance(w: World) -> DataFrame:
    train, test = (cut(x) for x in _train_test(w))
    fill = learning.medians(train)
    each = [learning.permutation_importance(learning.Model(kind).fit(train, fill), test).select(F.lit(kind).alias("model"), "feature", "loss") for kind in learning.KINDS]
    return reduce(DataFrame.unionByName, each)


def _commit_stats(w: World) -> DataFrame:
    stats = w.commits.select("repo", "sha", F.col("stats.additions").alias("additions"), F.col("stats.deletions").alias("deletions"))
    return w.commit_files.join(stats, ["repo", "sha"])


QUERIES = {
    "ripple_edges": q(lambda w: _rounded(_edges(w), "cochange_probability", "follow_probability", "recent_follow_probability", "combined_score")),
    "ripple_candidates": q(lambda w: _rounded(ripple.candidates(_edges(w)), "combined_score").withColumn("reasons", F.array_join("reasons", " "))),
    "ripple_missing": q(lambda w: _rounded(ripple.missing(ripple.candidates(_edges(w)), _last_commit(w)).drop("reasons"), "combined_score")),
    "ripple_paths": q(lambda w: _rounded(ripple.paths(_edges(w), w.changes.select("repo", "path").distinct()).select("repo", "source", F.array_join("nodes", "|").alias("nodes"), "confidence"), "confidence")),
    "ripple_evaluation": q(lambda w: _rounded(ripple.evaluate(w.commit_files), "precision_at_k", "recall_at_k", "mrr", "map")),
    "change_intents": q(lambda w: impact.intent(w.commits.select("repo", "sha", "message"), "message").select("repo", "sha", "operation", F.array_join("domains", "|").alias("domains"), F.array_join("terms", "|").alias("terms"), "current_technology", "target_technology")),
    "impact_semantic": q(lambda w: _rounded(impact.semantic(_files(w), TERMS).select("repo", "path", "semantic", F.array_join("path_terms", "|").alias("path_terms"), F.array_join("content_terms", "|").alias("content_terms")), "semantic")),
    "impact_items": q(lambda w: _rounded(_items(w).withColumn("categories", F.array_join("categories", "|")), "score")),
    "impact_checklist": q(lambda w: impact.checklist(_items(w))),
    "impact_graph": q(lambda w: impact.graph(_items(w))),
    "capability_map": q(lambda w: impact.capabilities(w.changes.select("repo", "path").distinct())),
    "directory_stats": q(lambda w: rollups.directory_stats(w.changes, _lines(w))),
    "file_tree": q(lambda w: rollups.tree(w.changes)),
    "weekly_buckets": q(lambda w: rollups.weekly(_commit_stats(w))),
    "pair_trend": q(lambda w: rollups.pair_trend(w.commit_files, h.top(w.pairs, 50, F.desc("count"), F.col("file_a"), F.col("file_b")))),
    "activity_levels": q(lambda w: rollups.against_peak(h.change_counts(w.changes), "changes", "activity", 0.6, 0.25, ("high", "medium", "low"))),
    "coupling_strength": q(lambda w: rollups.against_peak(w.pairs, "count", "strength", 0.66, 0.33, ("Strong", "Moderate", "Weak"))),
    "commits_per_month": q(lambda w: _rounded(rollups.commits_per_month(h.repo_totals(w.commits, w.changes)), "per_month", n=6)),
    "timeline_filtered": q(lambda w: rollups.timeline_filter(_commit_stats(w), days=90, file="index", kind="mixed").select("repo", "sha", "ts", "additions", "deletions")),
    "search_palette": q(lambda w: rollups.search(w.commits, w.changes.select("repo", "path"), "cache")),
    "edges_of_tests": q(lambda w: rollups.edge_filter(w.propagation_top, "tests").select("repo", "source", "target", F.array_join(rollups.signals(), "|").alias("signals"), "strength")),
    "node_counts": q(lambda w: rollups.node_counts(w.propagation_top)),
    "degrees_top24": q(lambda w: rollups.degrees(w.propagation_top, 24)),
    "cochange_partners": q(lambda w: rollups.partners(w.pairs)),
    "neighbourhoods": q(lambda w: rollups.neighbourhood(w.propagation_top, rollups.degrees(w.propagation_top, 5).select("repo", F.col("node").alias("path")))),
    "hotspots_of_rows": q(lambda w: _rounded(scoring.hotspots(_hotspots(w)).withColumn("reasons", F.array_join("reasons", "|")), "score")),
    "difficulty_of_rows": q(lambda w: _rounded(scoring.difficulty(_hotspots(w), scoring.hotspots(_hotspots(w))), "score")),
    "lr_score": q(lambda w: _scored(w).select("row_id", "probability", "predicted", "confidence", prediction.likelihood(F.col("probability"), F.col("predicted")).alias("likelihood"))),
    "evidence_top5": q(lambda w: _rounded(prediction.evidence(_latest(w), ["row_id"]), "contribution")),
    "risk_distribution": q(lambda w: prediction.distribution(_rounded(prediction.score(_latest(w)), "probability"))),
    "confusion_metrics": q(lambda w: _rounded(prediction.confusion(_scored(w), ["repo"]), "precision", "recall", "f1", "false_positive_rate")),
    "ranking_metrics": q(lambda w: _rounded(prediction.ranking(_scored(w), ["repo"]), "roc_auc", "average_precision", "brier")),
    "error_means": q(lambda w: _rounded(prediction.error_means(_scored(w)), *FEATURES, n=6)),
    "dataset_validation": q(lambda w: prediction.validate(_rows(w), w.commits, w.changes)),
    "dataset_stats": q(lambda w: _rounded(prediction.dataset_stats(_rows(w)), "positive_rate")),
    "chronological_split": q(lambda w: prediction.chronological_split(_usable(w))),
    "time_windows": q(lambda w: prediction.time_windows(_usable(w))),
    "imputation_and_scaling": q(_imputed),
    "model_comparison": q(lambda w: learning.compare(*_train_test(w))),
    "time_window_scores": q(lambda w: learning.cross_validate(_flat(w), prediction.time_windows(_usable(w)))),
    "ablation": q(lambda w: learning.ablation(*_train_test(w))),
    "calibration": q(_calibration),
    "permutation_importance": q(_importance),
}


# SQL

W = ripple.weights_without()
RIPPLE = f"""
cnt AS (SELECT repo, path, count(DISTINCT sha) AS changes FROM ch GROUP BY 1, 2),
fl AS (SELECT repo, delay, r_ts, source, unnest(r_files) AS target FROM (SELECT repo, delay, r_ts, unnest(l_files) AS source, r_files FROM cpw)),
lastc AS (SELECT repo, max(ts) AS ref FROM cf WHERE ts IS NOT NULL AND len(files) > 0 GROUP BY repo),
fw AS (SELECT fl.repo, source, target, count(*) AS n, list_sort(list(delay))[(count(*) // 2 + 1)::BIGINT] AS med, (sum(delay) // count(*))::BIGINT AS av, count(*) FILTER (WHERE r_ts >= ref - {h.MONTH}) AS rn
  FROM fl JOIN lastc ON lastc.repo = fl.repo WHERE source <> target GROUP BY 1, 2, 3),
co AS (SELECT repo, file_a AS source, file_b AS target, count FROM pairs WHERE file_a <> file_b UNION ALL SELECT repo, file_b, file_a, count FROM pairs WHERE file_a <> file_b),
us AS (SELECT repo, source, target FROM edges WHERE source <> target UNION SELECT repo, target, source FROM edges WHERE source <> target),
keys AS (SELECT repo, source, target FROM fw UNION SELECT repo, source, target FROM co UNION SELECT repo, source, target FROM us),
re0 AS (SELECT k.repo, k.source, k.target, CASE WHEN us.repo IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS dependency_score, coalesce(co.count, 0) AS cochange_count, coalesce(fw.n, 0) AS follow_count, fw.med AS median_follow_delay_seconds, fw.av AS avg_follow_delay_seconds,
    coalesce(co.count / cnt.changes, 0.0)::DOUBLE AS cp, coalesce(fw.n / cnt.changes, 0.0)::DOUBLE AS fp, coalesce(fw.rn / cnt.changes, 0.0)::DOUBLE AS rp
  FROM keys k LEFT JOIN fw USING (repo, source, target) LEFT JOIN co USING (repo, source, target) LEFT JOIN us ON us.repo = k.repo AND us.source = k.source AND us.target = k.target LEFT JOIN cnt ON cnt.repo = k.repo AND cnt.path = k.source),
re AS (SELECT *, least({W['dependency']!r} * dependency_score + {W['cochange']!r} * least(cp, 1.0) + {W['temporal']!r} * least(fp, 1.0) + {W['recent']!r} * least(rp, 1.0), 1.0) AS score FROM re0),
rc AS (SELECT *, row_number() OVER (PARTITION BY repo, source ORDER BY round(score, 12) DESC, target) AS rank FROM re WHERE score >= 0.2 QUALIFY rank <= 10)"""
RIPPLE_PARTS = (PAIRS, TEMPORAL.format(w=h.WEEK), EDGES, RIPPLE)
TERM_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
STOP = "(" + ", ".join(f"'{x}'" for x in impact.STOPWORDS) + ")"


def _aliases(words: str) -> str:
    return "[" + ", ".join(f"'{a}'" for a in words.split()) + "]"


HITS = "[" + ", ".join(f"len(list_filter({_aliases(a)}, lambda a: contains(low, a)))" for a in impact.DOMAINS.values()) + "]"
NAMES = "[" + ", ".join(f"'{d}'" for d in impact.DOMAINS) + "]"


def _capability(source: str) -> str:
    """Rows of source (repo, path, ...) with their capability as column cap."""
    return f"""(SELECT * EXCLUDE (low, hits, stem), CASE WHEN list_max(hits) > 0 THEN {NAMES}[list_position(hits, list_max(hits))] WHEN named = '' THEN 'general' ELSE named END AS cap FROM (
      SELECT *, array_to_string(list_transform(list_filter(string_split_regex(stem, '[-_]'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), ' ') AS named FROM (
      SELECT *, {HITS} AS hits, regexp_replace(string_split(string_split(path, '/')[1], '.')[1], '^[_.]+', '') AS stem FROM (SELECT *, lower(path) AS low FROM {source}))))"""


STEMS = "list_transform(string_split(lower(path), '/'), lambda s: string_split(s, '.')[1])"
WORDS = f"list_distinct(list_filter(list_concat(flatten(list_transform({STEMS}, lambda s: regexp_split_to_array(s, '[^a-z0-9]+'))), list_transform({STEMS}, lambda s: regexp_replace(s, '[^a-z0-9]+', '', 'g'))), lambda w: length(w) > 1))"
SEMANTIC = f"""
sm0 AS (SELECT repo, path, list_filter({TERM_LIST}, lambda t: len(list_filter(words, lambda w: w = t OR (length(w) > 3 AND length(t) > 3 AND (contains(w, t) OR contains(t, w))))) > 0) AS pt,
  list_filter({TERM_LIST}, lambda t: length(t) > 2 AND contains(lower(content), t)) AS ct FROM (SELECT repo, path, content, {WORDS} AS words FROM src)),
sm AS (SELECT repo, path, least(greatest(len(pt), len(ct)) / 4.0, 1.0)::DOUBLE AS semantic, pt, ct FROM sm0)"""
V = impact.WEIGHTS
ITEMS = f"""
cnt AS (SELECT repo, path, count(DISTINCT sha) AS changes FROM ch GROUP BY 1, 2),
direct AS (SELECT repo, path AS hit FROM sm WHERE semantic >= 0.5),
dpn AS (SELECT DISTINCT e.repo, e.path FROM (SELECT repo, source AS path, target AS hit FROM edges UNION ALL SELECT repo, target, source FROM edges) e JOIN direct d ON d.repo = e.repo AND d.hit = e.hit),
cob AS (SELECT repo, file_a AS path, file_b AS hit, count FROM pairs WHERE file_a <> file_b UNION ALL SELECT repo, file_b, file_a, count FROM pairs WHERE file_a <> file_b),
peer AS (SELECT b.repo, b.path, b.hit, b.count, b.count / c.changes AS p FROM cob b JOIN direct d ON d.repo = b.repo AND d.hit = b.hit JOIN cnt c ON c.repo = b.repo AND c.path = b.hit
  QUALIFY row_number() OVER (PARTITION BY b.repo, b.path ORDER BY round(p, 12) DESC, b.hit) = 1),
it0 AS (SELECT sm.repo, sm.path, semantic, CASE WHEN dpn.path IS NULL THEN 0.0 ELSE 1.0 END AS dep, least(coalesce(p, 0.0), 1.0) AS hist, k, CASE WHEN k <> 'source' AND semantic > 0 THEN 1.0 ELSE 0.0 END AS kd, peer.hit AS peer, coalesce(peer.count, 0) AS co_changes
  FROM (SELECT *, {KIND} AS k FROM sm) sm LEFT JOIN dpn ON dpn.repo = sm.repo AND dpn.path = sm.path LEFT JOIN peer ON peer.repo = sm.repo AND peer.path = sm.path),
it1 AS (SELECT *, least(CASE WHEN semantic >= 0.5 THEN greatest(raw, 0.6) ELSE raw END, 1.0)::DOUBLE AS score FROM (SELECT *, {V['semantic']} * semantic + {V['dependency']} * dep + {V['historical']} * hist + {V['kind']} * kd AS raw FROM it0)),
items AS (SELECT repo, path, score, CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.15 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN cats = '' THEN 'indirect' ELSE cats END AS categories, peer, co_changes FROM (SELECT *, array_to_string(list_filter([CASE WHEN semantic >= 0.5 THEN 'direct' END, CASE WHEN dep > 0 THEN 'dependent' END, CASE WHEN hist >= 0.3 THEN 'historically_coupled' END,
    CASE WHEN kd > 0 THEN CASE k WHEN 'test' THEN 'test' WHEN 'config' THEN 'configuration' WHEN 'docs' THEN 'documentation' END END], lambda x: x IS NOT NULL), '|') AS cats FROM it1)
  WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY round(score, 12) DESC, path) <= 20)"""
ITEM_PARTS = (PAIRS, EDGES, SEMANTIC, ITEMS)

USABLE = "(SELECT * FROM dataset_rows WHERE label IN (0, 1) AND timestamp > 0 AND file_path <> '')"
LATEST = f"(SELECT * FROM {USABLE} QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY timestamp DESC, commit_sha DESC, row_id DESC) = 1)"
NESTED = {**{c: f"structural.{c}" for c in prediction.STRUCTURAL}, **{c: f"historical.{c}" for c in prediction.HISTORICAL}, **{c: f"temporal.{c}" for c in prediction.TEMPORAL}}
M = prediction.MODEL
ZS = {c: f"((coalesce({NESTED[c]}::DOUBLE, {M['median'][i]!r}::DOUBLE) - {M['mean'][i]!r}::DOUBLE) / {M['scale'][i]!r}::DOUBLE)" for i, c in enumerate(FEATURES)}
PROBABILITY = f"round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({prediction.INTERCEPT!r}::DOUBLE + " + " + ".join(f"{ZS[c]} * {M['coefficient'][i]!r}::DOUBLE" for i, c in enumerate(FEATURES)) + "))), 9)"
BAND = "CASE WHEN greatest(probability, 1 - probability) >= 0.8 THEN 'high' WHEN greatest(probability, 1 - probability) >= 0.6 THEN 'medium' ELSE 'low' END"


def _scored_sql(source: str) -> str:
    return f"(SELECT *, (probability >= 0.5)::INTEGER AS predicted, {BAND} AS confidence FROM (SELECT *, {PROBABILITY} AS probability FROM {source}))"


SCORED = _scored_sql(USABLE)
SPLIT = f"""(SELECT repo, commit_sha, CASE WHEN n < 3 OR i <= floor(n * 0.70 + 1e-9) THEN 'train' WHEN i <= floor(n * 0.70 + 1e-9) + floor(n * 0.15 + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT repo, commit_sha, row_number() OVER (PARTITION BY repo ORDER BY t, commit_sha) AS i, count(*) OVER (PARTITION BY repo) AS n FROM (SELECT repo, commit_sha, min(timestamp) AS t FROM {USABLE} GROUP BY 1, 2)))"""
SIGNALS = [("complexity", "structural.cyclomatic_complexity", 0.35), ("churn", "historical.historical_churn", 0.30), ("coupling", "structural.coupling", 0.20), ("nesting", "structural.max_nesting_depth", 0.15)]
HOT = "(SELECT repo, file_path AS path, " + ", ".join(f"CASE WHEN max({c}) OVER (PARTITION BY repo) = min({c}) OVER (PARTITION BY repo) THEN 0.0 ELSE (count(*) OVER (PARTITION BY repo ORDER BY {c} RANGE UNBOUNDED PRECEDING) - 1) / (count(*) OVER (PARTITION BY repo) - 1)::DOUBLE * 100.0 END AS {n}" for n, c, _ in SIGNALS) + f" FROM {LATEST})"
HOT_SCORE = " + ".join(f"{n} * {x}" for n, _, x in SIGNALS)
RANKED = "list_sort([" + ", ".join(f"{{'v': -{n}, 'i': {i}, 'r': '{scoring.REASONS[n]}'}}" for i, (n, _, _) in enumerate(SIGNALS)) + "])"
HOTSPOTS = f"""(SELECT repo, path, round(score, 9) AS score, array_to_string(list_transform(CASE WHEN len(list_filter(ranked, lambda x: x.v <= -75.0)) > 0 THEN list_filter(ranked, lambda x: x.v <= -75.0) ELSE ranked[1:1] END, lambda x: x.r), '|') AS reasons
  FROM (SELECT *, least(greatest({HOT_SCORE}, 0.0), 100.0) AS score, {RANKED} AS ranked FROM {HOT}) WHERE score > 0)"""

OPERATION = "CASE " + " ".join(f"WHEN contains(low, '{k}') THEN '{v}'" for k, v in impact.OPERATIONS.items()) + " ELSE 'general' END"
DOMAIN_HITS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN len(list_filter({_aliases(a)}, lambda a: contains(low, a))) > 0 THEN '{d}' END" for d, a in impact.DOMAINS.items()) + "], lambda x: x IS NOT NULL))"
ALL_ALIASES = "[" + ", ".join(f"'{a}'" for a in sorted({a for x in impact.DOMAINS.values() for a in x.split()})) + "]"
TECHS = "[" + ", ".join(f"'{t}'" for t in sorted(impact.TECHNOLOGIES)) + "]"
PROP_PARTS = (PAIRS, TEMPORAL_PAIRS, EDGES, PROPAGATION, f"pt AS {PROP_TOP}")
WEEK = "floor((ts - 345600) / 604800.0)::BIGINT"

ORACLES = {
    "ripple_paths": sql("""SELECT repo, source, array_to_string(nodes, '|') AS nodes, round(list_sum(scores) / len(scores), 9) AS confidence FROM walk WHERE len(scores) > 0 QUALIFY row_number() OVER (PARTITION BY repo, source ORDER BY d DESC) = 1""",
        *RIPPLE_PARTS, """nx AS (SELECT repo, source AS at_, list({'t': target, 's': score} ORDER BY round(score, 12) DESC, target) AS nexts FROM re WHERE score >= 0.2 AND source <> target GROUP BY 1, 2),
        walk AS (SELECT DISTINCT repo, path AS source, [path] AS nodes, []::DOUBLE[] AS scores, path AS here, 0 AS d FROM ch
          UNION ALL SELECT repo, source, list_append(nodes, step.t), list_append(scores, step.s), step.t, d + 1 FROM (
            SELECT w.*, list_filter(nexts, lambda x: NOT list_contains(nodes, x.t))[1] AS step FROM walk w JOIN nx ON nx.repo = w.repo AND nx.at_ = w.here WHERE d < 5) WHERE step IS NOT NULL)"""),
    "neighbourhoods": sql("SELECT repo, focus, node, hop FROM h0 UNION ALL SELECT repo, focus, node, 1 FROM h1 UNION ALL SELECT repo, focus, node, 2 FROM h2", *PROP_PARTS,
        """bo AS (SELECT repo, a AS at_, b AS to_, max(strength) AS strength FROM (SELECT repo, source AS a, target AS b, strength FROM pt WHERE source <> target UNION ALL SELECT repo, target, source, strength FROM pt WHERE source <> target) GROUP BY 1, 2, 3),
        h0 AS (SELECT repo, node AS focus, node, 0 AS hop FROM (SELECT repo, source AS node FROM pt WHERE source <> target UNION ALL SELECT repo, target FROM pt WHERE source <> target) GROUP BY repo, node QUALIFY row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, node) <= 5),
        h1 AS (SELECT h0.repo, focus, to_ AS node, 1 + row_number() OVER (PARTITION BY h0.repo, focus ORDER BY strength DESC, to_) AS place FROM h0 JOIN bo ON bo.repo = h0.repo AND bo.at_ = h0.node WHERE to_ <> focus QUALIFY place <= 24),
        m2 AS (SELECT h1.repo, focus, to_ AS node, min({'p': place, 's': -strength}) AS b FROM h1 JOIN bo ON bo.repo = h1.repo AND bo.at_ = h1.node WHERE to_ <> focus AND NOT EXISTS (SELECT 1 FROM h1 o WHERE o.repo = h1.repo AND o.focus = h1.focus AND o.node = to_) GROUP BY 1, 2, 3),
        h2 AS (SELECT m2.repo, m2.focus, node FROM m2 JOIN (SELECT h0.repo, h0.focus, 1 + count(h1.node) AS n FROM h0 LEFT JOIN h1 USING (repo, focus) GROUP BY 1, 2) z ON z.repo = m2.repo AND z.focus = m2.focus QUALIFY row_number() OVER (PARTITION BY m2.repo, m2.focus ORDER BY b.p, b.s, node) + n <= 24)"""),
    "ripple_edges": sql("SELECT repo, source, target, dependency_score, cochange_count, follow_count, median_follow_delay_seconds, avg_follow_delay_seconds, round(cp, 9) AS cochange_probability, round(fp, 9) AS follow_probability, round(rp, 9) AS recent_follow_probability, round(score, 9) AS combined_score FROM re", *RIPPLE_PARTS),
    "ripple_candidates": sql("""SELECT repo, source, target, rank::INTEGER AS rank, round(score, 9) AS combined_score, array_to_string(list_filter([CASE WHEN dependency_score > 0 THEN 'Strong dependency relationship.' END,
      CASE WHEN cochange_count > 0 THEN 'Changed together in ' || cochange_count || ' historical commit' || CASE WHEN cochange_count = 1 THEN '' ELSE 's' END || '.' END,
      CASE WHEN follow_count > 0 THEN 'Followed in ' || follow_count || ' comparable change' || CASE WHEN follow_count = 1 THEN '' ELSE 's' END || '.' END,
      CASE WHEN median_follow_delay_seconds IS NOT NULL THEN 'Median historical delay: ' || median_follow_delay_seconds || 's.' END, CASE WHEN rp > 0 THEN 'Recent coupling increased.' END], lambda x: x IS NOT NULL), ' ') AS reasons FROM rc""", *RIPPLE_PARTS),
    "ripple_missing": sql("SELECT repo, target, source, rank::INTEGER AS rank, round(score, 9) AS combined_score FROM rc WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.repo = rc.repo AND lc.path = rc.target)", *RIPPLE_PARTS,
        "lc AS (SELECT repo, unnest(files) AS path FROM (SELECT * FROM cf WHERE ts IS NOT NULL AND len(files) > 0 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, sha DESC) = 1))"),
    "ripple_evaluation": sql("""SELECT round(avg(hits / n), 9) AS precision_at_k, round(avg(hits / nt), 9) AS recall_at_k, round(avg(coalesce(1.0 / first, 0.0)), 9) AS mrr, round(avg(ap / nt), 9) AS map, count(*) AS evaluated FROM per""",
        """o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts, sha) - 1 AS i, count(*) OVER (PARTITION BY repo) AS n FROM cf WHERE ts IS NOT NULL),
        te AS (SELECT repo, sha, ts, files[1] AS source, files[2:] AS rest FROM o WHERE i >= floor(n * 7 / 10) AND len(files) > 1 AND n >= 3),
        tr AS (SELECT repo, sha, unnest(rest) AS item FROM te),
        sc AS (SELECT repo, sha, item, count(*) AS score FROM (SELECT te.repo, te.sha, te.source, unnest(o.files) AS item FROM te JOIN o ON o.repo = te.repo AND o.ts < te.ts AND list_contains(o.files, te.source)) WHERE item <> source GROUP BY 1, 2, 3),
        rk AS (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY score DESC, item) AS rank FROM sc QUALIFY rank <= 5),
        hh AS (SELECT rk.*, (tr.item IS NOT NULL)::INTEGER AS hit, sum((tr.item IS NOT NULL)::INTEGER) OVER (PARTITION BY rk.repo, rk.sha ORDER BY rank) AS seen FROM rk LEFT JOIN tr ON tr.repo = rk.repo AND tr.sha = rk.sha AND tr.item = rk.item),
        per AS (SELECT hh.repo, hh.sha, sum(hit) AS hits, count(*) AS n, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN hit = 1 THEN seen / rank ELSE 0.0 END) AS ap, any_value(nt) AS nt FROM hh JOIN (SELECT repo, sha, count(*) AS nt FROM tr GROUP BY 1, 2) t ON t.repo = hh.repo AND t.sha = hh.sha GROUP BY 1, 2)"""),
    "change_intents": sql(f"""SELECT repo, sha, operation, array_to_string({DOMAIN_HITS}, '|') AS domains, array_to_string(list_sort(list_distinct(list_concat(list_concat(words, list_filter({ALL_ALIASES}, lambda a: contains(low, a))), techs))), '|') AS terms,
      CASE WHEN operation = 'replace' AND len(techs) >= 2 THEN placed[1] ELSE techs[1] END AS current_technology, CASE WHEN operation = 'replace' AND len(techs) >= 2 THEN placed[2] ELSE techs[2] END AS target_technology FROM (
      SELECT *, {OPERATION} AS operation, list_filter({TECHS}, lambda t: list_contains(words, t)) AS techs, list_transform(list_sort(list_transform(list_filter({TECHS}, lambda t: list_contains(words, t)), lambda t: {{'i': instr(low, t), 't': t}})), lambda x: x.t) AS placed FROM (
      SELECT repo, sha, lower(message) AS low, list_filter(regexp_split_to_array(lower(message), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN {STOP}) AS words FROM c))"""),
    "impact_semantic": sql("SELECT repo, path, round(semantic, 9) AS semantic, array_to_string(pt, '|') AS path_terms, array_to_string(ct, '|') AS content_terms FROM sm", EDGES, SEMANTIC),
    "impact_items": sql("SELECT repo, path, round(score, 9) AS score, level, categories, peer, co_changes FROM items", *ITEM_PARTS),
    "impact_checklist": sql(f"""SELECT repo, label, array_to_string(list_sort(list_distinct(list(path))), '|') AS files FROM (SELECT repo, 'Review ' || lower(cap) AS label, path FROM {_capability('items')}
      UNION ALL SELECT repo, l.label, path FROM items JOIN (VALUES ('test', 'Review tests'), ('configuration', 'Review configuration'), ('documentation', 'Review documentation')) l(c, label) ON list_contains(string_split(categories, '|'), l.c)) GROUP BY repo, label""", *ITEM_PARTS),
    "impact_graph": sql(f"""SELECT repo, 'change' AS "from", 'capability:' || cap AS "to", CASE min(CASE level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS level FROM ic GROUP BY repo, cap
      UNION ALL SELECT repo, 'capability:' || cap, path, level FROM ic""", *ITEM_PARTS, f"ic AS {_capability('items')}"),
    "capability_map": sql(f"SELECT repo, cap AS name, count(*) AS files FROM {_capability('(SELECT DISTINCT repo, path FROM ch)')} GROUP BY 1, 2"),
    "directory_stats": sql(f"""SELECT s.repo, s.directory, files, lines, changes, test_files, coalesce(w.n, 0) AS contributors FROM (
      SELECT repo, CASE WHEN {PARENT.format(p='path')} = '' THEN '(root)' ELSE {PARENT.format(p='path')} END AS directory, count(*) AS files, coalesce(sum(n_lines), 0)::BIGINT AS lines, coalesce(sum(changes), 0)::BIGINT AS changes, count(*) FILTER (WHERE {KIND_SHOWN} = 'test') AS test_files FROM (
        SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.path, b.path) AS path, a.changes, b.n_lines FROM (SELECT repo, path, count(DISTINCT sha) AS changes FROM ch GROUP BY 1, 2) a FULL JOIN (SELECT repo, path, CASE WHEN {_lang('path')} IS NULL THEN 0 ELSE {LINES.format(t='content')} END AS n_lines FROM src) b ON a.repo = b.repo AND a.path = b.path) GROUP BY 1, 2) s
      LEFT JOIN (SELECT repo, CASE WHEN {PARENT.format(p='path')} = '' THEN '(root)' ELSE {PARENT.format(p='path')} END AS directory, count(DISTINCT who) AS n FROM ch WHERE who IS NOT NULL GROUP BY 1, 2) w ON w.repo = s.repo AND w.directory = s.directory""", EDGES),
    "file_tree": sql("SELECT repo, array_to_string(parts[1:i], '/') AS node, CASE WHEN i = len(parts) THEN 'file' ELSE 'dir' END AS kind, count(*) AS files FROM (SELECT repo, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT DISTINCT repo, string_split(path, '/') AS parts FROM ch)) GROUP BY 1, 2, 3"),
    "weekly_buckets": sql(f"""SELECT e.repo, (e.w - w0) >> h AS bucket, (min(e.w) * 7 + 4) * 86400 AS week_start, coalesce(sum(n), 0)::BIGINT AS commits, coalesce(sum(f), 0)::BIGINT AS files, coalesce(sum(a), 0)::BIGINT AS additions, coalesce(sum(dl), 0)::BIGINT AS deletions
      FROM (SELECT repo, w0, h, unnest(range(w0, w1 + 1)) AS w FROM sp) e LEFT JOIN wk ON wk.repo = e.repo AND wk.w = e.w GROUP BY 1, 2""",
        f"""wk AS (SELECT cf.repo, {WEEK.replace('ts', 'cf.ts')} AS w, count(*) AS n, sum(len(files)) AS f, sum(s.a) AS a, sum(s.d) AS dl FROM cf JOIN (SELECT repo, sha, stats.additions AS a, stats.deletions AS d FROM c) s ON s.repo = cf.repo AND s.sha = cf.sha WHERE cf.ts IS NOT NULL GROUP BY 1, 2),
        sp AS (SELECT repo, min(w) AS w0, max(w) AS w1, greatest(0, ceil(log2((max(w) - min(w) + 1) / 26.0)))::BIGINT AS h FROM wk GROUP BY repo)"""),
    "pair_trend": sql("""SELECT p.repo, p.file_a, p.file_b, CASE WHEN n.repo IS NULL THEN 'unknown' WHEN recent > older THEN 'increasing' WHEN recent < older THEN 'decreasing' ELSE 'stable' END AS trend, coalesce(recent, 0) AS recent, coalesce(older, 0) AS older FROM p LEFT JOIN (
      SELECT p.repo, p.file_a, p.file_b, count(*) FILTER (WHERE late) AS recent, count(*) FILTER (WHERE NOT late) AS older FROM p JOIN (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY t0, sha) - 1 >= floor(count(*) OVER (PARTITION BY repo) * 2 / 3) AS late FROM cf) x
        ON x.repo = p.repo AND list_contains(x.files, p.file_a) AND list_contains(x.files, p.file_b) GROUP BY 1, 2, 3) n ON n.repo = p.repo AND n.file_a = p.file_a AND n.file_b = p.file_b""",
        PAIRS, "p AS (SELECT repo, file_a, file_b FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY repo ORDER BY count DESC, file_a, file_b) <= 50) WHERE file_a <> file_b)"),
    "activity_levels": sql("SELECT repo, path, changes, CASE WHEN changes / max(changes) OVER (PARTITION BY repo) >= 0.6 THEN 'high' WHEN changes / max(changes) OVER (PARTITION BY repo) >= 0.25 THEN 'medium' ELSE 'low' END AS activity FROM (SELECT repo, path, count(DISTINCT sha) AS changes FROM ch GROUP BY 1, 2)"),
    "coupling_strength": sql("SELECT *, CASE WHEN count / max(count) OVER (PARTITION BY repo) >= 0.66 THEN 'Strong' WHEN count / max(count) OVER (PARTITION BY repo) >= 0.33 THEN 'Moderate' ELSE 'Weak' END AS strength FROM pairs", PAIRS),
    "commits_per_month": sql("SELECT repo, CASE WHEN max(ts) > min(ts) THEN round(count(*) / greatest((max(ts) - min(ts)) / 2592000.0, 1 / 30.0)::DOUBLE, 6) END AS per_month FROM c GROUP BY repo"),
    "timeline_filtered": sql("""SELECT cf.repo, cf.sha, cf.ts, c.stats.additions AS additions, c.stats.deletions AS deletions FROM cf JOIN c ON c.repo = cf.repo AND c.sha = cf.sha JOIN (SELECT repo, max(ts) AS newest FROM cf GROUP BY repo) n ON n.repo = cf.repo
      WHERE cf.ts >= newest - 90 * 86400 AND len(list_filter(cf.files, lambda f: contains(lower(f), 'index'))) > 0 AND c.stats.additions > 0 AND c.stats.deletions > 0"""),
    "search_palette": sql("""SELECT repo, kind, hit, row_number() OVER (PARTITION BY repo ORDER BY kind DESC, o, hit)::INTEGER AS place FROM (
      SELECT repo, 'file' AS kind, path AS hit, 0 AS o FROM (SELECT repo, path FROM (SELECT DISTINCT repo, path FROM ch WHERE contains(lower(path), 'cache')) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 6)
      UNION ALL SELECT repo, 'commit', sha, -t0 FROM (SELECT * FROM c WHERE contains(lower(message), 'cache') OR starts_with(lower(sha), 'cache') QUALIFY row_number() OVER (PARTITION BY repo ORDER BY t0 DESC, sha) <= 6)) QUALIFY place <= 10"""),
    "edges_of_tests": sql(f"SELECT repo, source, target, array_to_string(list_filter([CASE WHEN dependency THEN 'dependency' END, CASE WHEN temporal THEN 'temporal' END, CASE WHEN cochange THEN 'co-change' END], lambda x: x IS NOT NULL), '|') AS signals, strength FROM pt WHERE {KIND_SHOWN.replace('path', 'source')} = 'test' OR {KIND_SHOWN.replace('path', 'target')} = 'test'", *PROP_PARTS),
    "node_counts": sql("""SELECT repo, node, sum(o)::BIGINT AS dependencies_out, sum(i)::BIGINT AS dependents_in, sum(c)::BIGINT AS cochange, sum(t)::BIGINT AS temporal, count(DISTINCT (other, way)) AS neighbours FROM (
      SELECT repo, source AS node, target AS other, 'out' AS way, dependency::INTEGER AS o, 0 AS i, cochange::INTEGER AS c, temporal::INTEGER AS t FROM pt UNION ALL SELECT repo, target, source, 'in', 0, dependency::INTEGER, cochange::INTEGER, temporal::INTEGER FROM pt WHERE source <> target) GROUP BY 1, 2""", *PROP_PARTS),
    "degrees_top24": sql("SELECT repo, node, count(*) AS degree FROM (SELECT repo, source AS node FROM pt WHERE source <> target UNION ALL SELECT repo, target FROM pt WHERE source <> target) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY degree DESC, node) <= 24", *PROP_PARTS),
    "cochange_partners": sql("SELECT * FROM (SELECT repo, file_a AS path, file_b AS partner, count FROM pairs WHERE file_a <> file_b UNION ALL SELECT repo, file_b, file_a, count FROM pairs WHERE file_a <> file_b) QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY count DESC, partner) <= 5", PAIRS),
    "hotspots_of_rows": f"SELECT * FROM {HOTSPOTS}",
    "difficulty_of_rows": f"SELECT f.repo, round(coalesce(s, 0.0), 9) AS score, CASE WHEN coalesce(s, 0) >= 75 THEN 'high' WHEN coalesce(s, 0) >= 50 THEN 'medium' WHEN coalesce(s, 0) >= 25 THEN 'moderate' ELSE 'low' END AS level FROM (SELECT DISTINCT repo FROM {USABLE}) f LEFT JOIN (SELECT repo, avg(score) AS s FROM {HOTSPOTS} GROUP BY repo) x USING (repo)",
    "lr_score": f"SELECT row_id, probability, predicted, confidence, CASE WHEN predicted <> 1 THEN 'Low likelihood' WHEN confidence = 'high' THEN 'Likely' WHEN confidence = 'medium' THEN 'Possible' ELSE 'Low likelihood' END AS likelihood FROM {SCORED}",
    "evidence_top5": f"SELECT row_id, rank::INTEGER AS rank, feature, value, round(contribution, 9) AS contribution, CASE WHEN contribution >= 0 THEN 'increases' ELSE 'decreases' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) AS rank FROM ("
    + " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {NESTED[c]}::DOUBLE AS value, {ZS[c]} * {M['coefficient'][i]!r}::DOUBLE AS contribution FROM {LATEST}" for i, c in enumerate(FEATURES)) + ")) WHERE rank <= 5",
    "risk_distribution": f"SELECT repo, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE confidence = 'low') AS low, count(*) FILTER (WHERE predicted = 1) AS positive FROM {_scored_sql(LATEST)} GROUP BY repo",
    "confusion_metrics": f"SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round(fp / nullif(fp + tn, 0), 9) AS false_positive_rate FROM (SELECT repo, count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn FROM {SCORED} GROUP BY repo)",
    "ranking_metrics": f"""WITH s AS (SELECT repo, probability AS p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg, sum((probability - label) ** 2) AS sq FROM {SCORED} GROUP BY 1, 2),
      r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY repo ORDER BY p DESC))
      SELECT repo, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round((sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)))::DOUBLE, 9) END AS roc_auc, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round((sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / sum(pos))::DOUBLE, 9) END AS average_precision, round((sum(sq) / sum(pos + neg))::DOUBLE, 9) AS brier FROM r GROUP BY repo""",
    "error_means": "SELECT CASE WHEN predicted = 1 THEN CASE WHEN label = 1 THEN 'tp' ELSE 'fp' END ELSE CASE WHEN label = 1 THEN 'fn' ELSE 'tn' END END AS outcome, count(*) AS n, " + ", ".join(f"round(avg({NESTED[c]}::DOUBLE), 6) AS {c}" for c in FEATURES) + f" FROM {SCORED} GROUP BY 1",
    "dataset_validation": sql("""SELECT row_id, reason FROM (SELECT r.row_id, CASE WHEN coalesce(trim(r.commit_sha), '') = '' OR coalesce(trim(r.file_path), '') = '' THEN 'empty-key' WHEN r.label IS NULL OR r.label NOT IN (0, 1) THEN 'label' WHEN coalesce(r.timestamp, 0) <= 0 THEN 'timestamp' WHEN r.k > 1 THEN 'duplicate'
      WHEN c.sha IS NULL THEN 'unknown-commit' WHEN r.label = 1 AND f.path IS NULL THEN 'positive-absent' WHEN r.label = 0 AND f.path IS NOT NULL THEN 'impossible-negative' END AS reason
      FROM (SELECT *, row_number() OVER (PARTITION BY repo, commit_sha, file_path ORDER BY row_id) AS k FROM dataset_rows) r LEFT JOIN c ON c.repo = r.repo AND c.sha = r.commit_sha LEFT JOIN (SELECT DISTINCT repo, sha, path FROM ch) f ON f.repo = r.repo AND f.sha = r.commit_sha AND f.path = r.file_path) WHERE reason IS NOT NULL"""),
    "dataset_stats": "SELECT repo, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives, count(*) FILTER (WHERE label = 0) AS negatives, round(count(*) FILTER (WHERE label = 1) / count(*), 9) AS positive_rate, count(DISTINCT commit_sha) AS commits, count(DISTINCT file_path) AS files FROM dataset_rows GROUP BY repo",
    "chronological_split": f"SELECT * FROM {SPLIT}",
    "time_windows": f"""SELECT repo, fold::INTEGER AS fold, commit_sha, CASE WHEN i < n - (4 - fold) * s THEN 'train' ELSE 'test' END AS part FROM (SELECT *, n // 4 AS s FROM (SELECT repo, commit_sha, row_number() OVER (PARTITION BY repo ORDER BY t, commit_sha) - 1 AS i, count(*) OVER (PARTITION BY repo) AS n FROM (SELECT repo, commit_sha, min(timestamp) AS t FROM {USABLE} GROUP BY 1, 2)))
      CROSS JOIN (VALUES (1), (2), (3)) v(fold) WHERE s > 0 AND i < n - (4 - fold) * s + s""",
    "imputation_and_scaling": f"WITH t AS (SELECT r.* FROM {USABLE} r JOIN {SPLIT} x ON x.repo = r.repo AND x.commit_sha = r.commit_sha WHERE x.split = 'train') "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(any_value(m), 6) AS median, round(avg(coalesce(v, m)), 6) AS mean, round(CASE WHEN stddev_pop(coalesce(v, m)) = 0 THEN 1.0 ELSE stddev_pop(coalesce(v, m)) END, 6) AS scale FROM (SELECT {NESTED[c]}::DOUBLE AS v, coalesce((SELECT quantile_cont({NESTED[c]}::DOUBLE, 0.5) FROM t), 0.0) AS m FROM t)" for c in FEATURES),
}
