"""Queries over the commit history and the source files, each with its SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths, text
from tidemark.operators import dependencies as dep
from tidemark.operators import features, prefix, scoring, structure
from tidemark.operators import history as h
from tidemark.session import cut
from tidemark.sources.history import BASE_SQL, IGNORED_SQL, changes, commit_files, load, table


class World:
    """The derived tables that several queries share, built when asked for."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self._have: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._have:
            self._have[name] = getattr(self, f"_make_{name}")()
        return self._have[name]

    def _make_commits(self):
        return load(self.spark, self.d)

    def _make_changes(self):
        return changes(self.commits)

    def _make_commit_files(self):
        return commit_files(self.commits)

    def _make_pairs(self):
        return h.cochange(self.changes)

    def _make_temporal(self):
        return h.temporal_pairs(self.commit_files)

    def _make_temporal_top(self):
        return h.top(self.temporal, 50, F.desc("occurrences"), F.col("source"), F.col("target"))

    def _make_raw_sources(self):
        return table(self.spark, self.d, "source_files")

    def _make_sources(self):
        return dep.latest_sources(self.raw_sources)

    def _make_edges(self):
        return dep.edges(self.sources, self.raw_sources)

    def _make_propagation(self):
        return h.propagation(self.pairs, self.temporal_top, self.edges)

    def _make_propagation_top(self):
        return h.top(self.propagation, 100, F.desc("strength"), F.col("source"), F.col("target"))

    def _make_sequences(self):
        return h.sequences(self.commit_files)

    def _make_followups(self):
        return h.followups(self.commit_files, self.pairs, self.edges)

    def _make_followups_bare(self):
        return h.followups(self.commit_files, self.pairs, self.edges, files=False)

    def _make_rework(self):
        return h.rework(self.commit_files, self.pairs, self.edges)

    def _make_complexity(self):
        return structure.complexity(self.sources)

    def _make_metrics(self):
        return dep.metrics(self.edges)

    def _make_structural(self):
        return structure.structural_features(self.complexity, self.metrics)

    def _make_signals(self):
        churn = h.file_history(self.changes).select("repo", "path", F.col("churn").cast("double").alias("churn"))
        coupling = self.metrics.select("repo", "path", F.col("coupling").cast("double").alias("coupling"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
        return self.complexity.join(churn, ["repo", "path"], "left").join(coupling, ["repo", "path"], "left").select(
            "repo", "path", F.col("cyclomatic").cast("double").alias("complexity"), F.col("max_nesting_depth").cast("double").alias("nesting"), zero("churn"), zero("coupling"))


def q(rule):
    """A query from a function of World."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return rule(World(spark, d))

    run.__doc__ = rule.__doc__
    return run


def _paths(w: World) -> DataFrame:
    names = w.commits.select("repo", F.explode("files.filename").alias("path")).distinct()
    p = F.col("path")
    return names.select("repo", "path", paths.is_ignored(p).alias("ignored"), paths.extension(p).alias("extension"), paths.language(p).alias("language"), paths.directory(p).alias("directory"),
        paths.kind(p).alias("kind"), paths.kind_of_text(p).alias("kind_of_text"), paths.kind_shown(p).alias("kind_shown"))


def _messages(w: World) -> DataFrame:
    m = F.col("message")
    return w.commits.select("repo", "sha", "who", text.is_fix(m).alias("is_fix"), text.is_revert(m).alias("is_revert"), F.array_join(text.tokens(m), " ").alias("tokens"), text.short_sha(F.col("sha")).alias("short_sha"), text.epoch(F.col("date")).alias("date_epoch"))


def _sources(w: World) -> DataFrame:
    return w.raw_sources.select("file_id", "repo", "path", paths.is_source_candidate(F.col("path"), F.octet_length("content").cast("bigint")).alias("candidate"), text.line_count(F.col("content")).cast("bigint").alias("lines"), paths.language(F.col("path")).alias("language"))


def _examples(w: World) -> DataFrame:
    wanted = h.top(w.temporal, 10, F.desc("occurrences"), F.col("source"), F.col("target"))
    shas = h.supporting_pairs(w.commit_files, wanted)
    return wanted.join(shas, ["repo", "source", "target"], "left").select("repo", "source", "target", "occurrences", "avg_delay_seconds", F.array_join(F.coalesce("shas", F.array()), ",").alias("example_shas"))


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.array_join(c, "|"))
    return df


def _temporal_features(w: World) -> DataFrame:
    follow = h.file_frequency(h.top(w.followups, 100, F.col("delay_seconds"), F.col("source_sha"), F.col("followup_sha")), F.concat("source_files", "followup_files"))
    again = h.file_frequency(h.top(w.rework, 100, F.col("delay_seconds"), F.col("file"), F.col("initial_sha"), F.col("rework_sha")), F.array("file"))
    return features.temporal(w.changes, w.temporal_top, w.propagation_top, follow, again)


def _measured(w: World) -> DataFrame:
    """The structural features that need no parser, of every latest source in a known language."""
    zero = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    s = w.sources.where(paths.language(F.col("path")).isNotNull() & F.col("content").isNotNull()).select("repo", "path", F.octet_length("content").cast("bigint").alias("file_size_bytes"), text.line_count(F.col("content")).cast("bigint").alias("lines_of_code"))
    return s.join(w.metrics, ["repo", "path"], "left").select("repo", "path", "file_size_bytes", "lines_of_code", zero("incoming", "incoming_dependencies"), zero("outgoing", "outgoing_dependencies"), zero("coupling", "coupling"), zero("incoming", "num_dependents"))


def _temporal_prefix(w: World) -> DataFrame:
    """The frequencies of temporal features as they were strictly before each commit."""
    commits = cut(w.commits.select("repo", "sha", "ts", "t0", "who", "message", "files"))
    changed = changes(commits)
    times = changed.where("ts is not null").select("repo", F.col("ts").alias("t")).distinct()
    edges = dep.resolve(cut(dep.references(w.sources)), w.raw_sources).select("repo", "source", "target")
    return prefix.temporal_features(commit_files(commits), changed, edges, times)


def _first(df: DataFrame, n: int, *order) -> DataFrame:
    return h.top(df, n, *order)


QUERIES = {
    "path_properties": q(_paths),
    "message_flags": q(_messages),
    "source_candidates": q(_sources),
    "repo_totals": q(lambda w: h.repo_totals(w.commits, w.changes)),
    "file_history": q(lambda w: h.file_history(w.changes)),
    "change_counts": q(lambda w: h.change_counts(w.changes)),
    "cochange_counts": q(lambda w: w.pairs),
    "cochange_top50": q(lambda w: _first(w.pairs, 50, F.desc("count"), F.col("file_a"), F.col("file_b"))),
    "temporal_pairs": q(lambda w: w.temporal),
    "temporal_top50": q(lambda w: w.temporal_top),
    "dependency_edges": q(lambda w: w.edges),
    "dependency_metrics": q(lambda w: w.metrics),
    "dependency_totals": q(lambda w: dep.totals(w.edges)),
    "coupled_top10": q(lambda w: _first(w.metrics, 10, F.desc("coupling"), F.col("path"))),
    "propagation_edges": q(lambda w: w.propagation),
    "propagation_top100": q(lambda w: w.propagation_top),
    "sequences": q(lambda w: _joined(w.sequences, "files")),
    "sequences_top50": q(lambda w: _joined(_first(w.sequences, 50, F.desc("occurrences"), F.col("avg_delay_seconds"), F.col("files")), "files")),
    "timeline_last300": q(lambda w: _joined(h.timeline(w.commit_files).select("repo", "sha", "ts", "message", "files", F.col("from_end").cast("bigint").alias("from_end")), "files")),
    "followups": q(lambda w: w.followups_bare.select("repo", "source_sha", "followup_sha", "delay_seconds", "reason", "evidence_type")),
    "followups_top100": q(lambda w: _first(w.followups_bare, 100, F.col("delay_seconds"), F.col("source_sha"), F.col("followup_sha")).select("repo", "source_sha", "followup_sha", "delay_seconds", "reason", "evidence_type")),
    "followup_reasons": q(lambda w: w.followups_bare.groupBy("repo", "reason").agg(F.count(F.lit(1)).alias("n"))),
    "rework_events": q(lambda w: w.rework),
    "rework_top100": q(lambda w: _first(w.rework, 100, F.col("delay_seconds"), F.col("file"), F.col("initial_sha"), F.col("rework_sha"))),
    "supporting_shas": q(_examples),
    "source_totals": q(lambda w: structure.source_totals(w.sources)),
    "complexity": q(lambda w: w.complexity),
    "complexity_outliers": q(lambda w: dep.above_spread(w.complexity, "cyclomatic")),
    "structural_features": q(lambda w: w.structural),
    "hotspots": q(lambda w: _joined(scoring.hotspots(w.signals), "reasons")),
    "difficulty": q(lambda w: scoring.difficulty(w.complexity, scoring.hotspots(w.signals))),
    "historical_features_snapshot": q(lambda w: features.snapshot(w.changes, w.pairs)),
    "historical_features_prefix": q(lambda w: features.prefix(w.changes)),
    "file_times": q(lambda w: features.file_times(w.changes)),
    "temporal_features": q(_temporal_features),
    "dataset_rows_full": q(lambda w: prefix.full_dataset(w.commit_files, w.changes, w.edges, w.structural)),
    "dataset_rows_prefix": q(lambda w: prefix.full_dataset(w.commit_files, w.changes, w.edges, _measured(w))),
    "temporal_features_prefix": q(_temporal_prefix),
    "dataset_rows_built": q(lambda w: features.dataset(w.changes, w.changes.select("repo", "path"))),
}


# SQL

EXT = "CASE WHEN contains(string_split({p}, '/')[-1], '.') THEN lower(string_split(string_split({p}, '/')[-1], '.')[-1]) ELSE '' END"


def _ext(p: str) -> str:
    return EXT.format(p=p)


def _lang(p: str) -> str:
    return "CASE " + _ext(p) + " " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in paths.LANGUAGES.items()) + " END"


def _list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


NAME = "string_split(lower(path), '/')[-1]"
KIND = f"""CASE WHEN regexp_matches(lower(path), '(^|/)tests?/') OR contains(lower(path), '__tests__') OR contains({NAME}, '.test.') OR contains({NAME}, '_test.') OR regexp_matches({NAME}, '^(test_|conftest)') THEN 'test'
  WHEN contains(lower(path), 'config') OR contains(lower(path), 'settings') OR starts_with({NAME}, '.env') OR regexp_matches({NAME}, '\\.(env\\.example|yml|yaml|toml|ini)$') THEN 'config'
  WHEN regexp_matches(lower(path), '(^|/)docs/') OR regexp_matches({NAME}, '\\.(md|rst)$') THEN 'docs' ELSE 'source' END"""
KIND_OF_TEXT = f"""CASE WHEN contains(lower(path), '/test') OR list_contains(string_split({NAME}, '.'), 'test') OR starts_with({NAME}, 'test_') THEN 'test'
  WHEN contains(lower(path), 'config') OR contains(lower(path), 'setting') OR starts_with({NAME}, '.env') OR regexp_matches({NAME}, '\\.(yml|yaml|toml|ini)$') THEN 'configuration'
  WHEN regexp_matches(lower(path), '(^|/)docs/') OR ends_with({NAME}, '.md') THEN 'documentation' ELSE 'source' END"""
KIND_SHOWN = f"""CASE WHEN regexp_matches(lower(path), '/tests?/') OR contains(lower(path), '__tests__') OR contains({NAME}, '.test.') OR contains({NAME}, '_test.') OR starts_with({NAME}, 'test_') OR {NAME} = 'conftest.py' THEN 'test'
  WHEN regexp_matches({NAME}, '\\.(yml|yaml|toml|ini)$') OR starts_with({NAME}, '.env') OR regexp_matches(lower(path), '/(config|settings)/') OR {NAME} IN ('config', 'settings') THEN 'config' ELSE 'source' END"""
TOKENS = "list_filter(regexp_split_to_array(lower({m}), '[^a-z0-9]+'), lambda x: x <> '')"
FIX = f"coalesce(len(list_intersect({TOKENS.format(m='{m}')}, [{', '.join(repr(x) for x in text.FIX_WORDS)}])) > 0, false)"
REVERT = f"(coalesce(starts_with(lower(regexp_replace({{m}}, '^\\s+', '')), 'revert'), false) OR coalesce(len(list_intersect({TOKENS.format(m='{m}')}, [{', '.join(repr(x) for x in text.REVERT_WORDS)}])) > 0, false))"
LINES = "CASE WHEN length({t}) = 0 THEN 0 ELSE length({t}) - length(replace({t}, chr(10), '')) + CASE WHEN ends_with({t}, chr(10)) THEN 0 ELSE 1 END END"
PARENT = "regexp_extract({p}, '^(.*)/[^/]*$', 1)"

PAIRS = """pairs AS (SELECT a.repo, least(a.path, b.path) AS file_a, greatest(a.path, b.path) AS file_b, count(*) AS count
  FROM ch a JOIN ch b ON a.repo = b.repo AND a.sha = b.sha AND a.pos < b.pos GROUP BY 1, 2, 3)"""
TEMPORAL = """cpw AS (SELECT a.repo, a.sha AS l_sha, b.sha AS r_sha, a.files AS l_files, b.files AS r_files, a.ts AS l_ts, b.ts AS r_ts, b.ts - a.ts AS delay, b.message AS r_message
  FROM cf a JOIN cf b ON a.repo = b.repo AND (b.ts > a.ts OR b.ts = a.ts AND b.sha > a.sha) AND b.ts - a.ts <= {w} WHERE len(a.files) > 0 AND len(b.files) > 0)"""
TEMPORAL_PAIRS = TEMPORAL.format(w=h.WEEK) + """,
tp AS (SELECT repo, source, target, count(*) AS occurrences, (sum(delay) // count(*))::BIGINT AS avg_delay_seconds FROM (
  SELECT repo, delay, source, unnest(r_files) AS target FROM (SELECT repo, delay, unnest(l_files) AS source, r_files FROM cpw)) WHERE source <> target GROUP BY 1, 2, 3),
tp50 AS (SELECT * FROM tp QUALIFY row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, source, target) <= 50)"""


def _found(patterns) -> str:
    return "list_concat(" * (len(patterns) - 1) + "regexp_extract_all(content, {}, 1)".format(_quote(patterns[0])) + "".join(f", regexp_extract_all(content, {_quote(p)}, 1))" for p in patterns[1:])


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


EDGES = f"""
src AS (SELECT * FROM source_files WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY fetched_at DESC, file_id DESC) = 1),
refs AS (SELECT DISTINCT repo, source, reference FROM (SELECT repo, path AS source, trim(unnest(CASE WHEN lang = 'Rust' THEN {_found(dep.RUST_PATTERNS)}
    WHEN lang = 'Python' THEN {_found(dep.PYTHON_PATTERNS)} WHEN lang IS NOT NULL THEN {_found(dep.SCRIPT_PATTERNS)} END)) AS reference
  FROM (SELECT *, {_lang('path')} AS lang FROM src)) WHERE reference <> ''),
plain AS (SELECT *, {PARENT.format(p='source')} || '/' AS here, regexp_replace(regexp_replace(replace(replace(trim(regexp_replace(trim(regexp_replace(reference, '^(?:use )+|^(?:import)+', '')), ';', '', 'g')), '::', '/'), '.', '/'), '^/+', ''), '/+$', '') AS p FROM refs),
variants AS (SELECT *, CASE WHEN contains(p, '/') THEN [p, regexp_replace(p, '^crate/', ''), regexp_replace(p, '^src/', '')] ELSE [p] END AS v FROM plain),
tried AS (SELECT repo, source, reference, unnest(cand) AS path, generate_subscripts(cand, 1) AS k FROM (
  SELECT repo, source, reference, list_concat(list_concat(v, list_transform(v, lambda x: here || x)), flatten(list_transform(v, lambda x: list_transform({dep.EXTENSIONS}, lambda e: here || x || '.' || e)))) AS cand FROM variants)),
hit AS (SELECT t.repo, source, reference, arg_min(t.path, k) AS hit FROM tried t JOIN (SELECT DISTINCT repo, path FROM source_files) f ON f.repo = t.repo AND f.path = t.path GROUP BY 1, 2, 3),
edges AS (SELECT refs.repo, refs.source, coalesce(hit, '$' || refs.reference) AS target FROM refs LEFT JOIN hit USING (repo, source, reference)),
de AS (SELECT DISTINCT repo, source, target FROM edges WHERE source <> target),
dm AS (SELECT repo, path, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming, count(*) AS coupling FROM (
  SELECT repo, source AS path, 1 AS o, 0 AS i FROM de UNION ALL SELECT repo, target, 0, 1 FROM de) GROUP BY 1, 2)"""
SPREAD = """(SELECT s.repo, s.n, s.mean, count(*) FILTER (WHERE v.{c} > s.mean + s.sd) AS high FROM (
  SELECT repo, count(*) AS n, avg({c}) AS mean, stddev_pop({c}) AS sd FROM {t} GROUP BY repo) s JOIN {t} v USING (repo) GROUP BY s.repo, s.n, s.mean)"""
PROPAGATION = """
prop AS (SELECT repo, source, target, bool_or(d) AS dependency, bool_or(t) AS temporal, bool_or(c) AS cochange, sum(n)::BIGINT AS strength FROM (
  SELECT repo, source, target, true AS d, false AS t, false AS c, 1 AS n FROM edges WHERE source <> target AND NOT starts_with(target, '$')
  UNION ALL SELECT repo, source, target, false, true, false, occurrences FROM tp50
  UNION ALL SELECT repo, file_a, file_b, false, false, true, count FROM pairs) GROUP BY 1, 2, 3)"""
LINKS = """
near AS (SELECT repo, file_a AS a, file_b AS b FROM pairs UNION SELECT repo, file_b, file_a FROM pairs),
uses AS (SELECT repo, source AS a, target AS b FROM edges UNION SELECT repo, target, source FROM edges)"""


def _related(pairs: str, links: str) -> str:
    return f"(SELECT DISTINCT x.repo, l_sha, r_sha FROM (SELECT repo, l_sha, r_sha, a, unnest(r_files) AS b FROM (SELECT repo, l_sha, r_sha, unnest(l_files) AS a, r_files FROM {pairs})) x JOIN {links} k ON k.repo = x.repo AND k.a = x.a AND k.b = x.b)"


FOLLOWUPS = f"""
fp AS (SELECT *, {FIX.format(m='r_message')} AS fix, len(list_intersect(l_files, r_files)) > 0 AS overlap FROM cpw),
fa AS (SELECT * FROM fp WHERE NOT overlap),
fo AS (SELECT fp.repo, fp.l_sha AS source_sha, fp.r_sha AS followup_sha, l_files AS source_files, r_files AS followup_files, delay AS delay_seconds, CASE WHEN overlap AND fix THEN 'same-file-fix' WHEN overlap THEN 'same-file'
    WHEN co.l_sha IS NOT NULL THEN 'co-change-history' WHEN us.l_sha IS NOT NULL THEN 'dependency' WHEN fix THEN 'fix-message' END AS reason, CASE WHEN overlap THEN 'observed' ELSE 'derived' END AS evidence_type
  FROM fp LEFT JOIN {_related('fa', 'near')} co ON co.repo = fp.repo AND co.l_sha = fp.l_sha AND co.r_sha = fp.r_sha
  LEFT JOIN {_related('fa', 'uses')} us ON us.repo = fp.repo AND us.l_sha = fp.l_sha AND us.r_sha = fp.r_sha),
followups AS (SELECT * FROM fo WHERE reason IS NOT NULL)"""
REWORK = TEMPORAL.format(w=h.TWO_WEEKS).replace("cpw AS", "cpr AS") + f""",
rp AS (SELECT *, {FIX.format(m='r_message')} AS fix, {REVERT.format(m='r_message')} AS revert, len(list_intersect(l_files, r_files)) > 0 AS overlap FROM cpr),
ra AS (SELECT * FROM rp WHERE NOT overlap AND fix),
both_links AS (SELECT * FROM near UNION SELECT * FROM uses),
rw AS (SELECT repo, unnest(list_intersect(l_files, r_files)) AS file, l_sha, r_sha, delay, CASE WHEN revert THEN 'revert' WHEN fix THEN 'fix-message' ELSE 'repeated-touch' END AS rule, '' AS near FROM rp WHERE overlap
  UNION ALL SELECT ra.repo, r_files[1], ra.l_sha, ra.r_sha, delay, 'related-fix', array_to_string(l_files[1:3], ', ') FROM ra JOIN {_related('ra', 'both_links')} x ON x.repo = ra.repo AND x.l_sha = ra.l_sha AND x.r_sha = ra.r_sha),
rework AS (SELECT repo, file, l_sha AS initial_sha, r_sha AS rework_sha, delay AS delay_seconds, rule, CASE WHEN rule = 'related-fix' THEN
    'candidate rework: ' || file || ' (related to ' || near || ') changed with a fix message after ' || delay || 's (' || substr(l_sha, 1, 7) || ' -> ' || substr(r_sha, 1, 7) || ') [rule: related-fix]'
    ELSE 'candidate rework: ' || file || ' changed again after ' || delay || 's (' || substr(l_sha, 1, 7) || ' -> ' || substr(r_sha, 1, 7) || ') [rule: ' || rule || ']' END AS evidence FROM rw)"""
SEQUENCES = f"""
lf AS (SELECT repo, sha, ts, f, lead(f, 1) OVER w AS f1, lead(ts, 1) OVER w AS t1, lead(f, 2) OVER w AS f2, lead(ts, 2) OVER w AS t2
  FROM (SELECT *, files[1:8] AS f FROM cf) WINDOW w AS (PARTITION BY repo ORDER BY t0, sha)),
sq AS (SELECT repo, delay, [a, b] AS files FROM (SELECT repo, delay, a, unnest(f1) AS b FROM (SELECT repo, t1 - ts AS delay, unnest(f) AS a, f1 FROM lf WHERE ts IS NOT NULL AND t1 - ts BETWEEN 0 AND {h.WEEK})) WHERE a <> b
  UNION ALL SELECT repo, delay, [a, b, c] FROM (SELECT repo, delay, a, b, unnest(f2) AS c FROM (SELECT repo, delay, a, unnest(f1) AS b, f2 FROM (
    SELECT repo, t2 - ts AS delay, unnest(f) AS a, f1, f2 FROM lf WHERE ts IS NOT NULL AND t2 - ts BETWEEN 0 AND {h.WEEK}))) WHERE a <> b AND b <> c),
seq AS (SELECT repo, files, len(files)::INTEGER AS length, count(*) AS occurrences, (sum(delay) // count(*))::BIGINT AS avg_delay_seconds FROM sq GROUP BY repo, files)"""
FILE_TIMES = f"""
tt AS (SELECT repo, ts, row_number() OVER (PARTITION BY repo ORDER BY ts) AS change_order_count FROM (SELECT DISTINCT repo, ts FROM ch WHERE ts IS NOT NULL)),
ft AS (SELECT x.repo, x.path, change_window_count, avg_change_delay_seconds, change_order_count FROM (
  SELECT ch.repo, path, count(*) FILTER (WHERE ts >= ref - {h.WEEK}) AS change_window_count, CASE WHEN count(*) > 1 THEN (max(ts) - min(ts)) // (count(*) - 1) END AS avg_change_delay_seconds, max(ts) AS ts
  FROM ch JOIN (SELECT repo, max(ts) AS ref FROM ch GROUP BY repo) r ON r.repo = ch.repo WHERE ts IS NOT NULL GROUP BY 1, 2) x JOIN tt ON tt.repo = x.repo AND tt.ts = x.ts)"""
BEFORE = f"""
size AS (SELECT repo, sha, count(*) AS n FROM ch GROUP BY repo, sha),
pre AS (SELECT k.repo, k.path, k.ts, count(o.path) AS previous_change_count, coalesce(sum(o.additions + o.deletions), 0)::BIGINT AS historical_churn, count(DISTINCT o.who) AS contributor_count, k.ts - max(o.ts) AS time_since_last_change_secs,
    count(*) FILTER (WHERE o.ts >= k.ts - {h.MONTH}) / {h.MONTH}.0::DOUBLE AS recent_change_frequency, coalesce(sum(o.n - 1), 0)::BIGINT AS historical_cochange_frequency
  FROM {{keys}} k LEFT JOIN (SELECT ch.*, size.n FROM ch JOIN size USING (repo, sha)) o ON o.repo = k.repo AND o.path = k.path AND o.ts < k.ts GROUP BY k.repo, k.path, k.ts)"""
REWORK_PAIRS = TEMPORAL.format(w=h.TWO_WEEKS).replace("cpw AS", "cpr AS")
# what was strictly before each time, list by list: everything seen by a time is counted for it again
LISTS = f"""
tm AS (SELECT DISTINCT repo, ts AS t FROM ch WHERE ts IS NOT NULL),
td AS (SELECT repo, r_ts AS seen, source, target, count(*) AS n FROM (SELECT repo, r_ts, source, unnest(r_files) AS target FROM (SELECT repo, r_ts, unnest(l_files) AS source, r_files FROM cpw)) WHERE source <> target GROUP BY ALL),
tq AS MATERIALIZED (SELECT tm.repo, t, source, target, sum(n)::BIGINT AS total FROM tm JOIN td ON td.repo = tm.repo AND td.seen < tm.t GROUP BY tm.repo, t, source, target QUALIFY row_number() OVER (PARTITION BY tm.repo, t ORDER BY sum(n) DESC, source, target) <= 50),
cd AS (SELECT a.repo, a.ts AS seen, least(a.path, b.path) AS source, greatest(a.path, b.path) AS target, count(*) AS n FROM ch a JOIN ch b ON a.repo = b.repo AND a.sha = b.sha AND a.pos < b.pos WHERE a.ts IS NOT NULL GROUP BY ALL),
pq AS MATERIALIZED (SELECT repo, t, source, target, sum(n)::BIGINT AS strength FROM (
    SELECT tm.repo, t, source, target, n FROM tm JOIN cd ON cd.repo = tm.repo AND cd.seen < tm.t
    UNION ALL SELECT tm.repo, t, source, target, 1 FROM tm JOIN edges USING (repo) WHERE source <> target AND NOT starts_with(target, '$')
    UNION ALL SELECT repo, t, source, target, total FROM tq) GROUP BY repo, t, source, target QUALIFY row_number() OVER (PARTITION BY repo, t ORDER BY sum(n) DESC, source, target) <= 100),
since AS (SELECT repo, a, b, min(seen) AS since FROM (SELECT repo, source AS a, target AS b, seen FROM cd UNION ALL SELECT repo, target, source, seen FROM cd UNION ALL SELECT repo, a, b, -1 FROM uses) GROUP BY ALL),
lk AS MATERIALIZED (SELECT x.repo, l_sha, r_sha, min(since) AS linked FROM (SELECT repo, l_sha, r_sha, a, unnest(r_files) AS b FROM (SELECT repo, l_sha, r_sha, unnest(l_files) AS a, r_files FROM cpr)) x JOIN since USING (repo, a, b) GROUP BY ALL),
cl AS (SELECT cpr.*, {FIX.format(m='r_message')} AS fix, len(list_intersect(l_files, r_files)) > 0 AS overlap, linked FROM cpr LEFT JOIN lk USING (repo, l_sha, r_sha)),
fv AS (SELECT *, CASE WHEN overlap OR fix THEN r_ts ELSE greatest(r_ts, linked) END AS seen FROM cl WHERE delay <= {h.WEEK} AND (overlap OR fix OR linked IS NOT NULL)),
fk AS (SELECT repo, l_sha, r_sha, seen, row_number() OVER (PARTITION BY repo ORDER BY delay, l_sha, r_sha) AS o FROM fv),
fi AS MATERIALIZED (SELECT tm.repo, t, o FROM tm JOIN fk ON fk.repo = tm.repo AND fk.seen < tm.t QUALIFY row_number() OVER (PARTITION BY tm.repo, t ORDER BY o) <= 100),
fl AS (SELECT fi.repo, t, list_distinct(list_concat(l_files, r_files)) AS files FROM fi JOIN fk USING (repo, o) JOIN fv USING (repo, l_sha, r_sha)),
rv AS (SELECT repo, r_ts AS seen, delay, unnest(list_intersect(l_files, r_files)) AS file, l_sha, r_sha FROM cl WHERE overlap
    UNION ALL SELECT repo, greatest(r_ts, linked), delay, r_files[1], l_sha, r_sha FROM cl WHERE NOT overlap AND fix AND linked IS NOT NULL),
rj AS (SELECT repo, file, seen, row_number() OVER (PARTITION BY repo ORDER BY delay, file, l_sha, r_sha) AS o FROM rv),
rl AS (SELECT z.repo, z.t, rj.file FROM (SELECT tm.repo, t, o FROM tm JOIN rj ON rj.repo = tm.repo AND rj.seen < tm.t QUALIFY row_number() OVER (PARTITION BY tm.repo, t ORDER BY o) <= 100) z JOIN rj USING (repo, o)),
lists AS MATERIALIZED (SELECT repo, t, path, sum(a)::BIGINT AS recent_change_sequence_count, sum(b)::BIGINT AS propagation_frequency, sum(c)::BIGINT AS followup_frequency, sum(d)::BIGINT AS historical_rework_frequency FROM (
    SELECT repo, t, source AS path, total AS a, 0 AS b, 0 AS c, 0 AS d FROM tq UNION ALL SELECT repo, t, target, 0, 0, 0, 0 FROM tq
    UNION ALL SELECT repo, t, source, 0, strength, 0, 0 FROM pq UNION ALL SELECT repo, t, target, 0, strength, 0, 0 FROM pq
    UNION ALL SELECT repo, t, unnest(files), 0, 0, 1, 0 FROM fl UNION ALL SELECT repo, t, file, 0, 0, 0, 1 FROM rl) GROUP BY ALL)"""
FOLLOW_COLUMNS = "repo, source_sha, followup_sha, delay_seconds, reason, evidence_type"
FOLLOW_TOP = "(SELECT * FROM followups QUALIFY row_number() OVER (PARTITION BY repo ORDER BY delay_seconds, source_sha, followup_sha) <= 100)"
REWORK_TOP = "(SELECT * FROM rework QUALIFY row_number() OVER (PARTITION BY repo ORDER BY delay_seconds, file, initial_sha, rework_sha) <= 100)"
PROP_TOP = "(SELECT * FROM prop QUALIFY row_number() OVER (PARTITION BY repo ORDER BY strength DESC, source, target) <= 100)"


def sql(select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BASE_SQL.strip(), *[p.strip() for p in parts]]) + "\n" + select


ORACLES = {
    "path_properties": f"""SELECT repo, path, {IGNORED_SQL.format(p='path')} AS ignored, {_ext('path')} AS extension, {_lang('path')} AS language,
      CASE WHEN {PARENT.format(p='path')} = '' THEN '(root)' ELSE {PARENT.format(p='path')} END AS directory,
      {KIND} AS kind, {KIND_OF_TEXT} AS kind_of_text, {KIND_SHOWN} AS kind_shown
      FROM (SELECT DISTINCT repo, f.filename AS path FROM (SELECT repo, unnest(files) AS f FROM commits))""",
    "message_flags": sql(f"SELECT repo, sha, who, {FIX.format(m='message')} AS is_fix, {REVERT.format(m='message')} AS is_revert, array_to_string({TOKENS.format(m='message')}, ' ') AS tokens, substr(sha, 1, 7) AS short_sha, epoch(try_cast(date AS TIMESTAMPTZ))::BIGINT AS date_epoch FROM c"),
    "source_candidates": f"SELECT file_id, repo, path, NOT ({IGNORED_SQL.format(p='path')}) AND coalesce(octet_length(encode(content)), 0) <= {paths.MOST_SOURCE_BYTES} AND {_ext('path')} NOT IN {_list(paths.BINARY)} AS candidate, {LINES.format(t='content')} AS lines, {_lang('path')} AS language FROM source_files",
    "repo_totals": sql("""SELECT a.*, coalesce(b.changed_files, 0) AS changed_files FROM (SELECT repo, count(*) AS total_commits, count(DISTINCT who) AS contributors, coalesce(sum(stats.additions), 0)::BIGINT AS additions, coalesce(sum(stats.deletions), 0)::BIGINT AS deletions,
      coalesce(sum(stats.additions + stats.deletions), 0)::BIGINT AS churn, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY repo) a LEFT JOIN (SELECT repo, count(DISTINCT path) AS changed_files FROM ch GROUP BY repo) b USING (repo)"""),
    "file_history": sql("SELECT repo, path, count(*) AS change_count, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions, sum(additions + deletions)::BIGINT AS churn FROM ch GROUP BY repo, path"),
    "change_counts": sql("SELECT repo, path, count(DISTINCT sha) AS changes FROM ch GROUP BY repo, path"),
    "cochange_counts": sql("SELECT * FROM pairs", PAIRS),
    "cochange_top50": sql("SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY repo ORDER BY count DESC, file_a, file_b) <= 50", PAIRS),
    "temporal_pairs": sql("SELECT * FROM tp", TEMPORAL_PAIRS),
    "temporal_top50": sql("SELECT * FROM tp50", TEMPORAL_PAIRS),
    "dependency_edges": sql("SELECT * FROM edges", EDGES),
    "dependency_metrics": sql("SELECT * FROM dm", EDGES),
    "dependency_totals": sql(f"SELECT a.*, s.high AS highly_connected_files FROM (SELECT repo, sum(outgoing)::BIGINT AS total_dependencies, count(*) AS connected_files, count(*) FILTER (WHERE NOT starts_with(path, '$')) AS resolved_dependencies FROM dm GROUP BY repo) a JOIN {SPREAD.format(c='coupling', t='dm')} s USING (repo)", EDGES),
    "coupled_top10": sql("SELECT * FROM dm QUALIFY row_number() OVER (PARTITION BY repo ORDER BY coupling DESC, path) <= 10", EDGES),
    "propagation_edges": sql("SELECT * FROM prop", PAIRS, TEMPORAL_PAIRS, EDGES, PROPAGATION),
    "propagation_top100": sql(f"SELECT * FROM {PROP_TOP}", PAIRS, TEMPORAL_PAIRS, EDGES, PROPAGATION),
    "sequences": sql("SELECT repo, array_to_string(files, '|') AS files, length, occurrences, avg_delay_seconds FROM seq", SEQUENCES),
    "sequences_top50": sql("SELECT repo, array_to_string(files, '|') AS files, length, occurrences, avg_delay_seconds FROM seq QUALIFY row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, avg_delay_seconds, files) <= 50", SEQUENCES),
    "timeline_last300": sql("SELECT repo, sha, ts, message, array_to_string(files, '|') AS files, row_number() OVER (PARTITION BY repo ORDER BY t0 DESC, sha DESC) AS from_end FROM cf QUALIFY from_end <= 300"),
    "followups": sql(f"SELECT {FOLLOW_COLUMNS} FROM followups", PAIRS, TEMPORAL.format(w=h.WEEK), EDGES, LINKS, FOLLOWUPS),
    "followups_top100": sql(f"SELECT {FOLLOW_COLUMNS} FROM {FOLLOW_TOP}", PAIRS, TEMPORAL.format(w=h.WEEK), EDGES, LINKS, FOLLOWUPS),
    "followup_reasons": sql("SELECT repo, reason, count(*) AS n FROM followups GROUP BY repo, reason", PAIRS, TEMPORAL.format(w=h.WEEK), EDGES, LINKS, FOLLOWUPS),
    "rework_events": sql("SELECT * FROM rework", PAIRS, EDGES, LINKS, REWORK),
    "rework_top100": sql(f"SELECT * FROM {REWORK_TOP}", PAIRS, EDGES, LINKS, REWORK),
    "supporting_shas": sql("""SELECT w.repo, w.source, w.target, w.occurrences, w.avg_delay_seconds, coalesce(array_to_string(s.shas, ','), '') AS example_shas FROM w LEFT JOIN s ON s.repo = w.repo AND s.source = w.source AND s.target = w.target""",
        TEMPORAL_PAIRS, """w AS (SELECT * FROM tp QUALIFY row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, source, target) <= 10),
        m AS (SELECT w.repo, w.source, w.target, r_sha, r_ts, arg_max(l_sha, (l_ts, l_sha)) AS l_sha FROM w JOIN cpw ON cpw.repo = w.repo AND list_contains(l_files, source) AND list_contains(r_files, target) GROUP BY 1, 2, 3, 4, 5),
        s AS (SELECT repo, source, target, list_sort(list_distinct(flatten(list([l_sha, r_sha])))) AS shas FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY repo, source, target ORDER BY r_ts, r_sha) <= 2) GROUP BY 1, 2, 3)"""),
    "source_totals": sql(f"SELECT repo, count(*) AS files, sum({LINES.format(t='content')})::BIGINT AS lines, sum(octet_length(encode(content)))::BIGINT AS bytes FROM src GROUP BY repo", EDGES),
    "historical_features_snapshot": sql(f"""SELECT a.*, coalesce(b.n, 0) AS historical_cochange_frequency FROM (SELECT ch.repo, path, count(*) AS previous_change_count, sum(additions + deletions)::BIGINT AS historical_churn, any_value(contributor_count) AS contributor_count, any_value(ref) - max(ts) AS time_since_last_change_secs,
      count(*) FILTER (WHERE ts >= ref - {h.MONTH}) / 30.0::DOUBLE AS recent_change_frequency FROM ch JOIN (SELECT repo, max(ts) AS ref, count(DISTINCT who) AS contributor_count FROM ch GROUP BY repo) r ON r.repo = ch.repo GROUP BY 1, 2) a
      LEFT JOIN (SELECT repo, path, sum(count)::BIGINT AS n FROM (SELECT repo, file_a AS path, count FROM pairs UNION ALL SELECT repo, file_b, count FROM pairs) GROUP BY 1, 2) b ON b.repo = a.repo AND b.path = a.path""", PAIRS),
    "historical_features_prefix": sql("SELECT * FROM pre", BEFORE.format(keys="(SELECT DISTINCT repo, path, ts FROM ch WHERE ts IS NOT NULL)")),
    "file_times": sql("SELECT * FROM ft", FILE_TIMES),
    "temporal_features": sql(f"""SELECT k.repo, k.path, coalesce(s.n, 0)::BIGINT AS recent_change_sequence_count, (coalesce(nf.n, 0) - CASE WHEN ft.path IS NULL THEN 0 ELSE 1 END)::BIGINT AS previous_files_changed_count, coalesce(ft.change_window_count, 0) AS change_window_count, ft.avg_change_delay_seconds,
      coalesce(ft.change_order_count, 0) AS change_order_count, coalesce(p.n, 0)::BIGINT AS propagation_frequency, coalesce(fq.n, 0)::BIGINT AS followup_frequency, coalesce(rq.n, 0)::BIGINT AS historical_rework_frequency
      FROM k LEFT JOIN (SELECT repo, source AS path, sum(occurrences) AS n FROM tp50 GROUP BY 1, 2) s USING (repo, path) LEFT JOIN p USING (repo, path) LEFT JOIN fq USING (repo, path) LEFT JOIN rq USING (repo, path)
      LEFT JOIN ft USING (repo, path) LEFT JOIN (SELECT repo, count(DISTINCT path) AS n FROM ch WHERE ts IS NOT NULL GROUP BY repo) nf ON nf.repo = k.repo""",
        PAIRS, TEMPORAL_PAIRS, EDGES, PROPAGATION, LINKS, FOLLOWUPS, REWORK, FILE_TIMES, f"""
      p AS (SELECT repo, path, sum(strength) AS n FROM (SELECT repo, source AS path, strength FROM {PROP_TOP} UNION ALL SELECT repo, target, strength FROM {PROP_TOP}) GROUP BY 1, 2),
      fq AS (SELECT repo, path, count(*) AS n FROM (SELECT repo, unnest(list_distinct(list_concat(source_files, followup_files))) AS path FROM {FOLLOW_TOP}) GROUP BY 1, 2),
      rq AS (SELECT repo, file AS path, count(*) AS n FROM {REWORK_TOP} GROUP BY 1, 2),
      k AS (SELECT repo, source AS path FROM tp50 UNION SELECT repo, target FROM tp50 UNION SELECT repo, path FROM p UNION SELECT repo, path FROM fq UNION SELECT repo, path FROM rq)"""),
    "temporal_features_prefix": sql("SELECT * FROM lists", PAIRS, TEMPORAL.format(w=h.WEEK), EDGES, LINKS, REWORK_PAIRS, LISTS),
    "dataset_rows_prefix": sql(f"""SELECT a.repo, a.sha, a.ts, a.path, a.label, ms.* EXCLUDE (repo, path), pre.* EXCLUDE (repo, path, ts), coalesce(l.recent_change_sequence_count, 0) AS recent_change_sequence_count,
      CASE WHEN l.path IS NULL THEN 0 ELSE n_files - CASE WHEN previous_change_count > 0 THEN 1 ELSE 0 END END AS previous_files_changed_count, CASE WHEN l.path IS NULL THEN 0 ELSE week_changes END AS change_window_count,
      CASE WHEN l.path IS NOT NULL AND previous_change_count > 1 THEN (last_ts - first_ts) // (previous_change_count - 1) END AS avg_change_delay_seconds, CASE WHEN l.path IS NULL THEN 0 ELSE coalesce(tt.change_order_count, 0) END AS change_order_count,
      coalesce(l.propagation_frequency, 0) AS propagation_frequency, coalesce(l.followup_frequency, 0) AS followup_frequency, coalesce(l.historical_rework_frequency, 0) AS historical_rework_frequency
      FROM a JOIN ms USING (repo, path) JOIN pre ON pre.repo = a.repo AND pre.path = a.path AND pre.ts = a.ts JOIN st ON st.repo = a.repo AND st.path = a.path AND st.ts = a.ts
      JOIN nf ON nf.repo = a.repo AND nf.t = a.ts LEFT JOIN lists l ON l.repo = a.repo AND l.t = a.ts AND l.path = a.path LEFT JOIN tt ON tt.repo = a.repo AND tt.ts = st.last_ts""",
        PAIRS, TEMPORAL.format(w=h.WEEK), EDGES, LINKS, REWORK_PAIRS, LISTS, FILE_TIMES, f"""
        ms AS (SELECT src.repo, src.path, octet_length(encode(content))::BIGINT AS file_size_bytes, ({LINES.format(t='content')})::BIGINT AS lines_of_code, coalesce(incoming, 0) AS incoming_dependencies, coalesce(outgoing, 0) AS outgoing_dependencies, coalesce(coupling, 0) AS coupling, coalesce(incoming, 0) AS num_dependents
          FROM src LEFT JOIN dm USING (repo, path) WHERE {_lang('path')} IS NOT NULL),
        pos AS (SELECT DISTINCT ch.repo, sha, ts, ch.path FROM ch JOIN ms USING (repo, path) WHERE ts IS NOT NULL),
        fs AS (SELECT repo, path, min(ts) AS first_ts FROM pos GROUP BY 1, 2),
        a AS (SELECT *, 1 AS label FROM pos UNION ALL SELECT t.repo, t.sha, t.ts, fs.path, 0 FROM (SELECT DISTINCT repo, sha, ts FROM ch WHERE ts IS NOT NULL) t JOIN fs ON fs.repo = t.repo AND fs.first_ts < t.ts
          WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.repo = t.repo AND pos.sha = t.sha AND pos.path = fs.path)),
        st AS MATERIALIZED (SELECT k.repo, k.path, k.ts, min(o.ts) AS first_ts, max(o.ts) AS last_ts, count(*) FILTER (WHERE o.ts >= k.ts - {h.WEEK}) AS week_changes FROM (SELECT DISTINCT repo, path, ts FROM a) k LEFT JOIN ch o ON o.repo = k.repo AND o.path = k.path AND o.ts < k.ts GROUP BY 1, 2, 3),
        nf AS MATERIALIZED (SELECT tm.repo, tm.t, count(DISTINCT path) AS n_files FROM tm LEFT JOIN ch ON ch.repo = tm.repo AND ch.ts < tm.t GROUP BY 1, 2)""", BEFORE.format(keys="(SELECT DISTINCT repo, path, ts FROM a)")),
    "dataset_rows_built": sql("""SELECT a.repo, a.sha, a.ts, a.path, a.label, pre.* EXCLUDE (repo, path, ts) FROM a JOIN pre ON pre.repo = a.repo AND pre.path = a.path AND pre.ts = a.ts""",
        """fs AS (SELECT repo, path, min(ts) AS first_ts FROM ch WHERE ts IS NOT NULL GROUP BY 1, 2),
        pos AS (SELECT DISTINCT repo, sha, ts, path FROM ch WHERE ts IS NOT NULL),
        a AS (SELECT *, 1 AS label FROM pos UNION ALL SELECT t.repo, t.sha, t.ts, fs.path, 0 FROM (SELECT DISTINCT repo, sha, ts FROM ch WHERE ts IS NOT NULL) t JOIN fs ON fs.repo = t.repo AND fs.first_ts < t.ts
          WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.repo = t.repo AND pos.sha = t.sha AND pos.path = fs.path))""", BEFORE.format(keys="(SELECT DISTINCT repo, path, ts FROM a)")),
}
