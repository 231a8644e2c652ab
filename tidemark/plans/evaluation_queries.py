"""Queries of examples, evaluations and filters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import evaluation, examples, explanations, forecasts, impact, prediction, ripple, rollups, scoring
from tidemark.operators import history as h
from tidemark.plans.analytics_queries import ALL_ALIASES, HOT, HOTSPOTS, LATEST, M, NESTED, RIPPLE_PARTS, TECHS, ZS, SCORED, STOP, USABLE, WORDS, _edges, _files, _hotspots, _latest, _rounded, _rows, _scored, _scored_sql, _usable
from tidemark.plans.history_queries import EDGES, KIND, LINKS, PAIRS, PARENT, REWORK, SEQUENCES, TEMPORAL, TEMPORAL_PAIRS, World, q, sql


def _top_sequences(w: World, n: int) -> DataFrame:
    return h.top(w.sequences, n, F.desc("occurrences"), F.col("avg_delay_seconds"), F.col("files"))


def _triples(w: World) -> DataFrame:
    triples = h.top(w.sequences.where("length = 3"), 10, F.desc("occurrences"), F.col("avg_delay_seconds"), F.col("files"))
    return examples.supporting_triples(w.commit_files, triples).select("repo", F.array_join("files", "|").alias("files"), F.array_join("shas", ",").alias("shas"))


def _labels(w: World) -> DataFrame:
    """Pairs of a commit and one that names it (rework), and of neighbours that do not."""
    c = w.commits.select("repo", "sha", "t0", F.lower("message").alias("m"))
    line = Window.partitionBy("repo").orderBy("t0", "sha")
    near = c.withColumn("p", F.lag("sha").over(line)).where("p is not null").select(F.col("p").alias("previous_sha"), F.col("sha").alias("current_sha"), F.expr("contains(m, substring(p, 1, 12))").alias("actual_rework"))
    heads = c.select(F.col("sha").alias("previous_sha"), F.substring("sha", 1, 12).alias("head"))
    named = c.select(F.col("sha").alias("current_sha"), F.explode(F.transform(F.regexp_extract_all("m", F.lit("([0-9a-f]{12,40})"), F.lit(1)), lambda x: F.substring(x, 1, 12))).alias("head"))
    return near.unionByName(named.join(heads, "head").where("previous_sha <> current_sha").select("previous_sha", "current_sha", F.lit(True).alias("actual_rework"))).groupBy("previous_sha", "current_sha").agg(F.max("actual_rework").alias("actual_rework"))


def _impact(baseline: str):
    def rule(w: World) -> DataFrame:
        ranked = evaluation.impact_ranking(w.commit_files.where("message is not null"), baseline)
        return _rounded(evaluation.impact_metrics(w.commit_files, ranked), "precision_at_k", "recall_at_k", "mrr", "map", "directory_accuracy")

    return rule


def _readiness(w: World) -> DataFrame:
    files = lambda c: prediction.latest(_usable(w)).where(F.col(c).isNotNull()).select("repo", "file_path")
    return rollups.readiness(files("structural.cyclomatic_complexity"), files("historical.previous_change_count"), files("temporal.avg_change_delay_seconds"))


def _drivers(w: World) -> DataFrame:
    spots = scoring.hotspots(_hotspots(w))
    return _rounded(rollups.drivers(_hotspots(w), spots, w.changes.select("repo", "path")), "complex_share", "hotspot_share", "connected_share")


FORECAST_SCORES = ["precision_at_k", "recall_at_k", "f1_at_k", "directory_accuracy", "test_discovery_rate", "config_discovery_rate"]


def _recommended(w: World) -> DataFrame:
    related = explanations.related_file(examples.prediction_examples(w.commits), w.commits)
    return explanations.recommendations(_latest(w), related, ["row_id"])


def _edge_words(w: World) -> DataFrame:
    e = _edges(w)
    return e.select("repo", "source", "target", F.array_join(explanations.edge_evidence(e), " ").alias("evidence"))


QUERIES = {
    "evidence_by_direction": q(lambda w: _rounded(explanations.evidence_by_direction(_latest(w), ["row_id"]), "contribution")),
    "explanation_summaries": q(lambda w: explanations.summaries(prediction.score(_latest(w)).withColumn("probability", F.round("probability", 9)), ["row_id"])),
    "recommendations": q(_recommended),
    "ripple_evidence": q(_edge_words),
    "impact_evaluation": q(lambda w: _rounded(forecasts.evaluate(w.commit_files, w.changes, _files(w), w.edges), *FORECAST_SCORES)),
    "supporting_triples": q(_triples),
    "ripple_examples": q(lambda w: examples.ripple_examples(w.commit_files, ripple.candidates(_edges(w)))),
    "prediction_examples": q(lambda w: examples.prediction_examples(w.commits)),
    "row_examples": q(lambda w: examples.row_examples(_rows(w))),
    "historical_examples": q(lambda w: examples.examples(w.temporal_top, _top_sequences(w, 50), w.pairs, w.edges).withColumn("sequence", F.array_join("sequence", "|")).withColumn("signals", F.array_join("signals", "|"))),
    "rework_evaluation": q(lambda w: _rounded(evaluation.rework_metrics(_labels(w), w.rework), "precision", "recall", "false_positive_rate")),
    "follow_probability": q(lambda w: _rounded(evaluation.follow_probability(w.commit_files), "probability")),
    "impact_evaluation_keyword": q(_impact("keyword")),
    "impact_evaluation_cochange": q(_impact("cochange")),
    "coupling_filtered": q(lambda w: rollups.coupling_filter(w.pairs, w.edges, 3, "src", False)),
    "predictions_filtered": q(lambda w: rollups.prediction_filter(_scored(w), 1, "high", "cache").select("row_id", "file_path", "probability")),
    "file_stamps": q(lambda w: rollups.stamps(w.commit_files).withColumn("stamps", F.array_join("stamps", ","))),
    "dataset_readiness": q(_readiness),
    "risk_drivers": q(_drivers),
}

TERMS = f"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(message), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN {STOP})))"
IMPACT = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts, sha) - 1 AS i, count(*) OVER (PARTITION BY repo) AS n FROM cf WHERE ts IS NOT NULL AND trim(message) <> ''),
te AS (SELECT repo, sha, ts, files, {TERMS} AS terms FROM o WHERE n >= 5 AND i >= n - floor(n / 5) AND len(files) BETWEEN 1 AND 15),
sn AS (SELECT repo, path AS item, min(ts) AS first_ts FROM (SELECT repo, ts, unnest(files) AS path FROM cf WHERE ts IS NOT NULL) GROUP BY 1, 2),
sw AS (SELECT repo, item, first_ts, {WORDS.replace('path', 'item')} AS words FROM sn),
sc AS (SELECT te.repo, te.sha, te.ts, item, least(len(list_filter(terms, lambda t: len(list_filter(words, lambda w: w = t OR (length(w) > 3 AND length(t) > 3 AND (contains(w, t) OR contains(t, w))))) > 0)) / least(len(terms), 4)::DOUBLE, 1.0) AS score
  FROM te JOIN sw ON sw.repo = te.repo AND first_ts < te.ts),
kw AS (SELECT *, row_number() OVER (PARTITION BY repo, sha ORDER BY score DESC, item) AS rank FROM sc WHERE score > 0)"""
COCHANGE_RANK = """
pe AS (SELECT repo, sha, ts, item AS peer FROM kw WHERE rank = 1),
cs AS (SELECT repo, sha, item, count(*) AS score FROM (SELECT pe.repo, pe.sha, peer, unnest(cf.files) AS item FROM pe JOIN cf ON cf.repo = pe.repo AND cf.ts < pe.ts AND list_contains(cf.files, peer)) WHERE item <> peer GROUP BY 1, 2, 3),
rk AS (SELECT repo, sha, item, row_number() OVER (PARTITION BY repo, sha ORDER BY score DESC, item) AS rank FROM cs QUALIFY rank <= 5)"""
DIRECTORY = f"CASE WHEN {PARENT.format(p='item')} = '' THEN '(root)' ELSE {PARENT.format(p='item')} END"
METRICS = f"""
tr AS (SELECT repo, sha, unnest(files) AS item FROM cf),
hh AS (SELECT rk.*, (tr.item IS NOT NULL)::INTEGER AS hit, sum((tr.item IS NOT NULL)::INTEGER) OVER (PARTITION BY rk.repo, rk.sha ORDER BY rank) AS seen FROM rk LEFT JOIN tr ON tr.repo = rk.repo AND tr.sha = rk.sha AND tr.item = rk.item),
per AS (SELECT hh.repo, hh.sha, sum(hit) AS hits, count(*) AS n, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN hit = 1 THEN seen / rank ELSE 0.0 END) AS ap, any_value(nt) AS nt FROM hh JOIN (SELECT repo, sha, count(*) AS nt FROM tr GROUP BY 1, 2) t ON t.repo = hh.repo AND t.sha = hh.sha GROUP BY 1, 2),
da AS (SELECT avg(ok) AS d FROM (SELECT repo, sha, max((y.d IS NOT NULL)::INTEGER) AS ok FROM (SELECT DISTINCT repo, sha, {DIRECTORY} AS d FROM rk) x LEFT JOIN (SELECT DISTINCT repo, sha, {DIRECTORY} AS d FROM tr) y USING (repo, sha, d) GROUP BY 1, 2))"""
METRICS = METRICS.replace("max((y.d IS NOT NULL)::INTEGER) AS ok FROM", "max(y.ok) AS ok FROM").replace(f"(SELECT DISTINCT repo, sha, {DIRECTORY} AS d FROM tr) y", f"(SELECT DISTINCT repo, sha, {DIRECTORY} AS d, 1 AS ok FROM tr) y").replace("SELECT avg(ok) AS d", "SELECT avg(coalesce(ok, 0)) AS d")
METRIC_ROW = "SELECT round(avg(hits / n), 9) AS precision_at_k, round(avg(hits / nt), 9) AS recall_at_k, round(avg(coalesce(1.0 / first, 0.0)), 9) AS mrr, round(avg(ap / nt), 9) AS map, count(*) AS evaluated, round((SELECT d FROM da), 9) AS directory_accuracy FROM per"

ALL_EVIDENCE = " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, {NESTED[c]}::DOUBLE AS value, {ZS[c]} * {M['coefficient'][i]!r}::DOUBLE AS contribution FROM {LATEST}" for i, c in enumerate(prediction.FEATURES))
CONTRIBUTION = {c: f"({ZS[c]} * {M['coefficient'][i]!r}::DOUBLE)" for i, c in enumerate(prediction.FEATURES)}
INTENT_TERMS = f"""list_sort(list_distinct(list_concat(list_concat(wds, list_filter({ALL_ALIASES}, lambda a: contains(low, a))), list_filter({TECHS}, lambda t: list_contains(wds, t)))))"""
FORECAST = f"""
o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts, sha) - 1 AS i, count(*) OVER (PARTITION BY repo) AS n, min(ts) OVER (PARTITION BY repo) AS t1 FROM cf WHERE ts IS NOT NULL AND trim(message) <> ''),
te AS (SELECT repo, sha, ts, files, {INTENT_TERMS} AS terms FROM (SELECT *, lower(message) AS low, list_filter(regexp_split_to_array(lower(message), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN {STOP}) AS wds FROM o) WHERE n >= 5 AND i >= n * 4 // 5 AND len(files) BETWEEN 1 AND 15 AND ts > t1),
sw AS (SELECT repo, path, lower(content) AS low, {WORDS} AS words, {KIND} AS k FROM src),
mt AS (SELECT te.repo, te.sha, te.ts, sw.path, k, len(terms) AS n, len(list_filter(terms, lambda t: len(list_filter(words, lambda w: w = t OR (length(w) > 3 AND length(t) > 3 AND (contains(w, t) OR contains(t, w))))) > 0)) AS p, len(list_filter(terms, lambda t: length(t) > 2 AND contains(low, t))) AS c FROM te JOIN sw USING (repo)),
mm AS (SELECT v.m, x.repo, x.sha, x.ts, x.path, x.k, CASE WHEN n = 0 THEN 0.0 ELSE least(CASE WHEN v.m = 'texts' THEN greatest(p, c) ELSE p END / least(n, 4)::DOUBLE, 1.0) END AS semantic FROM mt x, (VALUES ('texts'), ('paths')) v(m)),
dr AS (SELECT m, repo, sha, ts, path AS hit FROM mm WHERE semantic >= 0.5),
dp AS (SELECT DISTINCT m, dr.repo, sha, e.path FROM dr JOIN (SELECT repo, source AS path, target AS hit FROM edges UNION SELECT repo, target, source FROM edges) e ON e.repo = dr.repo AND e.hit = dr.hit),
chm AS (SELECT * FROM ch WHERE ts IS NOT NULL AND trim(message) <> ''),
hn AS (SELECT m, dr.repo, dr.sha, hit, count(DISTINCT chm.sha) AS changes FROM dr JOIN chm ON chm.repo = dr.repo AND chm.path = dr.hit AND chm.ts < dr.ts GROUP BY ALL),
ht AS (SELECT m, dr.repo, dr.sha, hit, b.path, count(*) AS n FROM dr JOIN chm a ON a.repo = dr.repo AND a.path = dr.hit AND a.ts < dr.ts JOIN chm b ON b.repo = a.repo AND b.sha = a.sha AND b.path <> a.path GROUP BY ALL),
hs AS (SELECT ht.m, ht.repo, ht.sha, ht.path, least(max(n / changes), 1.0) AS historical FROM ht JOIN hn ON hn.m = ht.m AND hn.repo = ht.repo AND hn.sha = ht.sha AND hn.hit = ht.hit GROUP BY ALL),
sg AS (SELECT mm.*, CASE WHEN dp.path IS NULL THEN 0.0 ELSE 1.0 END AS dependency, coalesce(historical, 0.0) AS historical, CASE WHEN k <> 'source' AND semantic > 0 THEN 1.0 ELSE 0.0 END AS kind FROM mm
  LEFT JOIN dp ON dp.m = mm.m AND dp.repo = mm.repo AND dp.sha = mm.sha AND dp.path = mm.path LEFT JOIN hs ON hs.m = mm.m AND hs.repo = mm.repo AND hs.sha = mm.sha AND hs.path = mm.path),
bl AS (SELECT * FROM (VALUES {", ".join(f"('{b}', '{'paths' if b == 'paths' else 'texts'}', {v['semantic']}::DOUBLE, {v['dependency']}::DOUBLE, {v['historical']}::DOUBLE, {v['kind']}::DOUBLE)" for b, v in forecasts.BASELINES.items())}) t(baseline, m, ws, wd, wh, wk)),
sd AS (SELECT baseline, repo, sha, path, CASE WHEN semantic >= 0.5 THEN greatest(ws * semantic + wd * dependency + wh * historical + wk * kind, 0.6) ELSE ws * semantic + wd * dependency + wh * historical + wk * kind END AS score FROM sg JOIN bl USING (m)),
rk AS (SELECT *, row_number() OVER (PARTITION BY baseline, repo, sha ORDER BY round(least(score, 1.0), 12) DESC, path) AS rank FROM sd WHERE score >= 0.01 QUALIFY rank <= 5),
gv AS (SELECT baseline, repo, sha, count(*) AS n FROM rk GROUP BY ALL),
tf AS (SELECT repo, sha, len(files) AS n_true, unnest(files) AS path FROM te),
tk AS (SELECT *, {KIND} AS k, {PARENT.format(p='path')} AS d FROM tf),
pr AS (SELECT gv.baseline, tk.repo, tk.sha, any_value(gv.n) AS n, any_value(n_true) AS n_true, count(rk.path) AS hits, avg(CASE WHEN k = 'test' THEN (rk.path IS NOT NULL)::INTEGER END) AS tests, avg(CASE WHEN k = 'config' THEN (rk.path IS NOT NULL)::INTEGER END) AS configs
  FROM gv JOIN tk USING (repo, sha) LEFT JOIN rk ON rk.baseline = gv.baseline AND rk.repo = tk.repo AND rk.sha = tk.sha AND rk.path = tk.path GROUP BY 1, 2, 3),
rd AS (SELECT DISTINCT baseline, repo, sha, {PARENT.format(p='path')} AS d FROM rk),
dd AS (SELECT gv.baseline, x.repo, x.sha, avg((rd.d IS NOT NULL)::INTEGER) AS dirs FROM gv JOIN (SELECT DISTINCT repo, sha, d FROM tk) x USING (repo, sha) LEFT JOIN rd ON rd.baseline = gv.baseline AND rd.repo = x.repo AND rd.sha = x.sha AND rd.d = x.d GROUP BY 1, 2, 3),
ms AS (SELECT baseline, avg(hits / n) AS precision_at_k, avg(hits / n_true) AS recall_at_k, avg(dirs) AS directory_accuracy, avg(tests) AS test_discovery_rate, avg(configs) AS config_discovery_rate, count(*) AS evaluated_targets FROM pr JOIN dd USING (baseline, repo, sha) GROUP BY baseline)"""


def _speaks(feature: str) -> str:
    return f"({NESTED[feature]}::DOUBLE > 0 AND {CONTRIBUTION[feature]} > 0)"


ORACLES = {
    "evidence_by_direction": f"SELECT row_id, direction, row_number() OVER (PARTITION BY row_id, direction ORDER BY abs(contribution) DESC, feature)::INTEGER AS rank, feature, value, round(contribution, 9) AS contribution FROM (SELECT *, CASE WHEN contribution > 0 THEN 'supports' ELSE 'contradicts' END AS direction FROM ({ALL_EVIDENCE}) WHERE contribution <> 0)",
    "explanation_summaries": f"""SELECT row_id, 'logistic_regression predicts the file is ' || CASE WHEN predicted = 1 THEN 'likely' ELSE 'unlikely' END || ' to require rework (probability ' || format('{{:.2f}}', probability) || '). Evidence associated with this prediction comes from: ' || names || '.' AS summary
      FROM (SELECT row_id, probability, predicted FROM {_scored_sql(LATEST)}) JOIN (SELECT row_id, string_agg(feature, ', ' ORDER BY abs(contribution) DESC, feature) AS names FROM (SELECT * FROM ({ALL_EVIDENCE}) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, feature) <= 5) GROUP BY row_id) USING (row_id)""",
    "recommendations": sql(f"""SELECT row_id, unnest(range(1, len(hints) + 1))::INTEGER AS rank, unnest(hints) AS recommendation FROM (SELECT row_id, list_filter([
        CASE WHEN {_speaks('historical_rework_frequency')} THEN 'Historical changes suggest reviewing past rework in ' || file_path || ' before modifying it.' END,
        CASE WHEN related IS NOT NULL THEN 'Consider reviewing related changes in ' || related || ' before modifying ' || file_path || '.' END,
        CASE WHEN {_speaks('followup_frequency')} THEN 'Check whether recent follow-up changes affect ' || file_path || '.' END,
        CASE WHEN {_speaks('propagation_frequency')} THEN 'Historical changes suggest checking downstream files that previously changed after ' || file_path || '.' END,
        CASE WHEN {_speaks('coupling')} THEN 'Consider reviewing coupled files of ' || file_path || '; its coupling is associated with rework.' END], lambda x: x IS NOT NULL)[1:3] AS hints
      FROM {LATEST} d LEFT JOIN rl ON rl.repo = d.repo AND rl.path = d.file_path)""",
      """pe AS (SELECT repo, path, sha, t0, names, unnest(CASE WHEN len(names) > 1 THEN ['co_change', 'prior_change'] ELSE ['prior_change'] END) AS event_type FROM (SELECT repo, sha, t0, names, unnest(names) AS path FROM (SELECT repo, sha, t0, list_distinct(list_filter(list_transform(files, lambda f: f.filename), lambda f: f IS NOT NULL)) AS names FROM c))),
      p5 AS (SELECT * FROM pe QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY t0 DESC, sha, event_type) <= 5),
      rl AS (SELECT repo, path, list_min(list_filter(names, lambda f: f <> path)) AS related FROM p5 WHERE event_type = 'co_change' QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY t0 DESC, sha) = 1)"""),
    "ripple_evidence": sql("""SELECT repo, source, target, array_to_string(list_filter([CASE WHEN dependency_score > 0 THEN 'Structural dependency relationship between ' || source || ' and ' || target || '.' END,
      CASE WHEN cochange_count > 0 THEN 'Changed together in ' || cochange_count || ' historical commit' || CASE WHEN cochange_count = 1 THEN '' ELSE 's' END || '.' END,
      CASE WHEN follow_count > 0 THEN target || ' followed ' || source || ' in ' || follow_count || ' comparable change' || CASE WHEN follow_count = 1 THEN '' ELSE 's' END || '.' || coalesce(' Median historical delay: ' || median_follow_delay_seconds || 's.', '') END,
      CASE WHEN rp > 0 THEN 'Recent coupling increased.' END], lambda x: x IS NOT NULL), ' ') AS evidence FROM re""", *RIPPLE_PARTS),
    "impact_evaluation": sql("SELECT baseline, round(precision_at_k, 9) AS precision_at_k, round(recall_at_k, 9) AS recall_at_k, round(CASE WHEN precision_at_k + recall_at_k > 0 THEN 2 * precision_at_k * recall_at_k / (precision_at_k + recall_at_k) END, 9) AS f1_at_k, round(directory_accuracy, 9) AS directory_accuracy, round(test_discovery_rate, 9) AS test_discovery_rate, round(config_discovery_rate, 9) AS config_discovery_rate, evaluated_targets FROM ms", EDGES, FORECAST),
    "supporting_triples": sql("""SELECT repo, array_to_string(files, '|') AS files, array_to_string(list_sort(list_distinct([sha, s1, s2])), ',') AS shas FROM (
      SELECT t3.repo, t3.files, x.t0, x.sha, x.s1, x.s2 FROM t3 JOIN cw x ON x.repo = t3.repo AND list_contains(x.files, t3.files[1]) AND list_contains(x.f1, t3.files[2]) AND list_contains(x.f2, t3.files[3]) QUALIFY row_number() OVER (PARTITION BY t3.repo, t3.files ORDER BY x.t0, x.sha) = 1)""",
        SEQUENCES, f"""t3 AS (SELECT * FROM seq WHERE length = 3 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, avg_delay_seconds, files) <= 10),
        cw AS (SELECT * FROM (SELECT *, lead(sha, 1) OVER w AS s1, lead(files, 1) OVER w AS f1, lead(sha, 2) OVER w AS s2, lead(files, 2) OVER w AS f2, lead(ts, 2) OVER w AS tt FROM cf WINDOW w AS (PARTITION BY repo ORDER BY t0, sha)) WHERE ts IS NOT NULL AND tt - ts BETWEEN 0 AND {h.WEEK})"""),
    "ripple_examples": sql("""SELECT repo, source, target, commit_sha, ts, event_type FROM (SELECT c3.repo, c3.source, c3.target, cf.sha AS commit_sha, cf.ts, 'co_change' AS event_type FROM c3 JOIN cf ON cf.repo = c3.repo AND list_contains(files, source) AND list_contains(files, target)
      UNION SELECT repo, source, target, (x).sha, (x).ts, 'follow_up' FROM (SELECT c3.repo, c3.source, c3.target, cpw.l_sha, min({'ts': r_ts, 'sha': r_sha}) AS x FROM c3 JOIN cpw ON cpw.repo = c3.repo AND list_contains(l_files, source) AND NOT list_contains(l_files, target) AND list_contains(r_files, target) GROUP BY 1, 2, 3, 4))
      QUALIFY row_number() OVER (PARTITION BY repo, source, target ORDER BY coalesce(ts, 0) DESC, commit_sha, event_type) <= 5""", *RIPPLE_PARTS, "c3 AS (SELECT * FROM rc)"),
    "prediction_examples": sql("""SELECT repo, path, commit_sha, ts, event_type FROM (SELECT repo, path, sha AS commit_sha, ts, t0, unnest(CASE WHEN n > 1 THEN ['prior_change', 'co_change'] ELSE ['prior_change'] END) AS event_type FROM (
      SELECT repo, sha, ts, t0, unnest(f) AS path, len(f) AS n FROM (SELECT repo, sha, ts, t0, list_distinct(list_transform(files, lambda x: x.filename)) AS f FROM c))) QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY t0 DESC, commit_sha, event_type) <= 5"""),
    "row_examples": """SELECT row_id, commit_sha, t FROM (SELECT r.row_id, p.commit_sha, p.t, row_number() OVER (PARTITION BY r.row_id ORDER BY p.t DESC, p.commit_sha DESC) AS k FROM dataset_rows r
      JOIN (SELECT DISTINCT repo, file_path, commit_sha, timestamp AS t FROM dataset_rows WHERE label = 1) p ON p.repo = r.repo AND p.file_path = r.file_path AND p.t < r.timestamp) WHERE k <= 5""",
    "historical_examples": sql("""SELECT repo, id, source_file, target_file, sequence, occurrences, avg_delay_seconds, signals FROM (SELECT repo, id, files[1] AS source_file, files[-1] AS target_file, array_to_string(files, '|') AS sequence, occurrences, avg_delay_seconds,
        array_to_string(list_filter([kind, CASE WHEN len(files) = 2 AND EXISTS (SELECT 1 FROM pairs WHERE pairs.repo = x.repo AND file_a = least(files[1], files[2]) AND file_b = greatest(files[1], files[2])) THEN 'co-change' END,
          CASE WHEN EXISTS (SELECT 1 FROM uses WHERE uses.repo = x.repo AND (uses.a = files[1] AND uses.b = files[2] OR len(files) = 3 AND uses.a = files[2] AND uses.b = files[3])) THEN 'dependency' END], lambda s: s IS NOT NULL), '|') AS signals
      FROM x) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, avg_delay_seconds, id) <= 20""", PAIRS, TEMPORAL_PAIRS, EDGES, LINKS, SEQUENCES,
        """x AS (SELECT repo, 'temporal-' || i AS id, [source, target] AS files, occurrences, avg_delay_seconds, 'temporal' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, source, target) AS i FROM tp50) WHERE i <= 10
        UNION ALL SELECT repo, 'sequence-' || i, files, occurrences, avg_delay_seconds, 'sequence' FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, avg_delay_seconds, files) AS i FROM seq) WHERE i <= 10)"""),
    "rework_evaluation": sql("""SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(fp / nullif(fp + tn, 0), 9) AS false_positive_rate FROM (SELECT count(*) FILTER (WHERE a AND p) AS tp, count(*) FILTER (WHERE NOT a AND p) AS fp, count(*) FILTER (WHERE NOT a AND NOT p) AS tn, count(*) FILTER (WHERE a AND NOT p) AS fn
      FROM (SELECT actual_rework AS a, e.initial_sha IS NOT NULL AS p FROM labels LEFT JOIN (SELECT DISTINCT initial_sha, rework_sha FROM rework) e ON e.initial_sha = previous_sha AND e.rework_sha = current_sha))""", PAIRS, EDGES, LINKS, REWORK,
        """labels AS (SELECT previous_sha, current_sha, bool_or(a) AS actual_rework FROM (SELECT p AS previous_sha, sha AS current_sha, contains(lower(message), substr(p, 1, 12)) AS a FROM (SELECT *, lag(sha) OVER (PARTITION BY repo ORDER BY t0, sha) AS p FROM c) WHERE p IS NOT NULL
        UNION ALL SELECT h.sha, n.sha, true FROM (SELECT sha, unnest(list_transform(regexp_extract_all(lower(message), '[0-9a-f]{12,40}'), lambda x: x[1:12])) AS head FROM c) n JOIN c h ON substr(h.sha, 1, 12) = n.head AND h.sha <> n.sha) GROUP BY 1, 2)"""),
    "follow_probability": sql("""SELECT f.repo, f.source, f.target, round(hits / n, 9) AS probability FROM (SELECT repo, source, target, count(DISTINCT l_sha) AS hits FROM (SELECT repo, l_sha, source, unnest(r_files) AS target FROM (SELECT repo, l_sha, unnest(l_files) AS source, r_files FROM cpw WHERE r_ts > l_ts) WHERE NOT list_contains(r_files, source)) GROUP BY 1, 2, 3) f
      JOIN (SELECT repo, source, count(*) AS n FROM (SELECT repo, unnest(files) AS source FROM cf WHERE ts IS NOT NULL) GROUP BY 1, 2) m ON m.repo = f.repo AND m.source = f.source""", TEMPORAL.format(w=h.WEEK)),
    "impact_evaluation_keyword": sql(METRIC_ROW, IMPACT, "rk AS (SELECT repo, sha, item, rank FROM kw WHERE rank <= 5)", METRICS),
    "impact_evaluation_cochange": sql(METRIC_ROW, IMPACT, COCHANGE_RANK, METRICS),
    "coupling_filtered": sql(f"SELECT * FROM pairs WHERE count >= 3 AND file_a <> file_b AND (contains({PARENT.format(p='file_a')}, 'src') OR contains({PARENT.format(p='file_b')}, 'src')) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo = pairs.repo AND least(e.source, e.target) = file_a AND greatest(e.source, e.target) = file_b)", PAIRS, EDGES),
    "predictions_filtered": f"SELECT row_id, file_path, probability FROM {SCORED} WHERE predicted = 1 AND confidence = 'high' AND contains(lower(file_path), 'cache')",
    "file_stamps": sql("SELECT repo, path, array_to_string(list_sort(list(t)), ',') AS stamps FROM (SELECT repo, unnest(files) AS path, ts * 1000 AS t FROM cf WHERE ts IS NOT NULL) GROUP BY 1, 2"),
    "dataset_readiness": f"SELECT repo, count(structural.cyclomatic_complexity) AS structural, count(historical.previous_change_count) AS historical, count(temporal.avg_change_delay_seconds) AS temporal FROM {LATEST} GROUP BY repo",
    "risk_drivers": sql(f"""SELECT a.repo, round(least(a.c / a.n, 1.0), 9) AS complex_share, round(least(coalesce(s.s, 0) / a.n, 1.0), 9) AS hotspot_share, coalesce(s.flagged, 0) AS flagged, round(least(coalesce(k.k, 0) / a.n, 1.0), 9) AS connected_share
      FROM (SELECT repo, count(*) AS n, count(*) FILTER (WHERE structural.cyclomatic_complexity >= 10) AS c FROM {LATEST} GROUP BY repo) a LEFT JOIN (SELECT repo, count(*) AS s, count(*) FILTER (WHERE score >= 40) AS flagged FROM {HOTSPOTS} GROUP BY repo) s USING (repo)
      LEFT JOIN (SELECT repo, count(*) AS k FROM {HOT} x WHERE EXISTS (SELECT 1 FROM ch WHERE ch.repo = x.repo AND ch.path = x.path) GROUP BY repo) k USING (repo)"""),
}
