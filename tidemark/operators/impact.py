"""What a planned change, described in words, is likely to touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators.history import top

# The words of operations (the first found anywhere in the text decides), of domains and technologies, and those left out.
OPERATIONS = {
    "replace": "replace", "replaces": "replace", "migrate": "replace", "migration": "replace", "switch": "replace", "convert": "replace", "move from": "replace", "instead of": "replace",
    "add": "add", "adds": "add", "introduce": "add", "implement": "add", "support": "add", "create": "add", "remove": "remove", "removes": "remove", "delete": "remove", "drop": "remove",
    "deprecate": "remove", "refactor": "refactor", "restructure": "refactor", "clean up": "refactor", "cleanup": "refactor", "upgrade": "upgrade", "update": "upgrade", "modernize": "upgrade",
    "bump": "upgrade", "fix": "fix", "cache": "add",
}
DOMAINS = {
    "authentication": "auth authentication login logout session token jwt oauth oauth2 password sso credentials signup signin",
    "authorization": "authorization authorize permissions roles rbac acl policy policies guard",
    "payments": "payment payments stripe razorpay billing invoice checkout subscription pay",
    "database": "database postgres postgresql mysql sqlite mongo mongodb orm migration migrations schema query queries repository repositories",
    "api": "api rest graphql endpoint endpoints route routes router controller controllers handler handlers middleware response responses request",
    "caching": "cache caching redis memcached memoize invalidate",
    "frontend": "frontend ui login page pages component components view views redux zustand store theme style styles css",
    "messaging": "queue kafka rabbitmq message messages event events pubsub worker workers job jobs",
    "storage": "storage upload uploads file files s3 bucket blob asset assets",
    "search": "search elasticsearch index indexing query filter filters",
    "notifications": "notification notifications email emails sms push alert alerts webhook webhooks",
    "logging": "log logs logging tracing metrics monitor monitoring observability",
    "users": "user users profile profiles account accounts",
    "configuration": "config configuration settings env environment dotenv yaml yml toml",
}
TECHNOLOGIES = "jwt oauth oauth2 sso postgres postgresql mysql sqlite mongodb mongo redis memcached stripe razorpay redux zustand rest graphql docker kubernetes kafka rabbitmq elasticsearch jest vitest pytest axios express axum tokio react vue angular".split()
STOPWORDS = "the a an to of in on for with and or from by as is are be our we it its this that these those into over under all new old current existing please".split()
WEIGHTS = {"semantic": 0.35, "dependency": 0.20, "historical": 0.30, "kind": 0.15}
DIRECT, FLOOR, HIGH, MEDIUM, LEAST = 0.5, 0.6, 0.5, 0.15, 0.01


def terms_of(text: Column) -> Column:
    """Words of more than two ASCII letters or digits, in lower case, without the stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: (F.length(x) > 2) & ~x.isin(STOPWORDS))


def intent(df: DataFrame, text: str) -> DataFrame:
    """Add operation, domains, terms, current_technology and target_technology of a text column."""
    low, words = F.lower(F.col(text)), terms_of(F.col(text))
    operation = None
    for word, name in OPERATIONS.items():
        operation = (F.when if operation is None else operation.when)(low.contains(word), F.lit(name))
    named = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.lit(a) for a in aliases.split()]), lambda a: low.contains(a)), F.lit(d)) for d, aliases in DOMAINS.items()]))
    found = F.filter(F.array(*[F.lit(a) for a in sorted({a for x in DOMAINS.values() for a in x.split()})]), lambda a: low.contains(a))
    techs = F.filter(F.array(*[F.lit(t) for t in sorted(TECHNOLOGIES)]), lambda t: F.array_contains(words, t))
    placed = F.transform(F.array_sort(F.transform(techs, lambda t: F.struct(F.instr(low, t).alias("i"), t.alias("t")))), lambda x: x.t)
    d = df.withColumn("operation", operation.otherwise(F.lit("general"))).withColumn("_t", techs).withColumn("_p", placed)
    swap = (F.col("operation") == "replace") & (F.size("_t") >= 2)
    order = F.when(swap, F.col("_p")).otherwise(F.col("_t"))
    return d.select(*df.columns, "operation", F.array_sort(named).alias("domains"), F.array_sort(F.array_distinct(F.concat(words, found, techs))).alias("terms"), F.get(order, F.lit(0)).alias("current_technology"), F.get(order, F.lit(1)).alias("target_technology"))


def path_words(path: Column) -> Column:
    """Words of a path's parts before their first dot, and each part's letters and digits as one word."""
    stems = F.transform(F.split(F.lower(path), "/"), lambda s: F.substring_index(s, ".", 1))
    split = F.flatten(F.transform(stems, lambda s: F.split(s, "[^a-z0-9]+")))
    whole = F.transform(stems, lambda s: F.regexp_replace(s, "[^a-z0-9]+", ""))
    return F.array_distinct(F.filter(F.concat(split, whole), lambda w: F.length(w) > 1))


def _share(matched: Column, terms: Column) -> Column:
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(F.size(matched) / F.least(F.greatest(F.size(terms), F.lit(1)), F.lit(4)))


def path_matches(path: Column, terms: Column) -> Column:
    """The terms a path's words hold: the same word, or one within the other where both are longer than three."""
    words = path_words(path)
    return F.filter(terms, lambda t: F.exists(words, lambda w: (w == t) | ((F.length(w) > 3) & (F.length(t) > 3) & (w.contains(t) | t.contains(w)))))


def content_matches(content: Column, terms: Column) -> Column:
    """The terms of more than two characters found anywhere in a text."""
    low = F.lower(content)
    return F.filter(terms, lambda t: (F.length(t) > 2) & low.contains(t))


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def semantic(files: DataFrame, terms: list[str]) -> DataFrame:
    """(repo, path, semantic, path_terms, content_terms) of files with their content (null: none)."""
    t = F.array(*[F.lit(x) for x in terms]) if terms else F.array().cast("array<string>")
    p, c = path_matches(F.col("path"), t), F.coalesce(content_matches(F.col("content"), t), F.array().cast("array<string>"))
    return files.select("repo", "path", F.least(F.greatest(_share(p, t), _share(c, t)), F.lit(1.0)).alias("semantic"), p.alias("path_terms"), c.alias("content_terms"))


def simulate(files: DataFrame, terms: list[str], pairs: DataFrame, counts: DataFrame, edges: DataFrame, weights: dict[str, float] | None = None, n: int = 20, low: bool = False) -> DataFrame:
    """(repo, path, score, level, categories, peer, co_changes): each repository's n files most likely touched.

    Files that match the terms by half are direct; a file in a dependency with a direct
    one counts as dependent; of the direct files it changed with, the one with the
    highest share of its own changes counts (ties: the smaller path).
    """
    w = weights or WEIGHTS
    total = sum(w.values()) or 1.0
    s = semantic(files, terms)
    hit = s.where(F.col("semantic") >= DIRECT).select("repo", F.col("path").alias("hit"))
    both = edges.select("repo", F.col("source").alias("path"), F.col("target").alias("hit")).unionByName(edges.select("repo", F.col("target").alias("path"), F.col("source").alias("hit")))
    dependent = both.join(hit, ["repo", "hit"], "left_semi").select("repo", "path").distinct().withColumn("dependency", F.lit(1.0))
    co = pairs.select("repo", F.col("file_a").alias("path"), F.col("file_b").alias("hit"), "count").unionByName(pairs.select("repo", F.col("file_b").alias("path"), F.col("file_a").alias("hit"), "count")).where("path <> hit")
    peer = co.join(hit, ["repo", "hit"]).join(counts.withColumnRenamed("path", "hit"), ["repo", "hit"]).withColumn("p", F.col("count") / F.col("changes"))
    best = peer.groupBy("repo", "path").agg(F.min(F.struct((-F.round("p", 12)).alias("o"), "hit", "count", "p")).alias("b"))
    kind = paths.kind(F.col("path"))
    x = s.join(dependent, ["repo", "path"], "left").join(best, ["repo", "path"], "left").select(
        "repo", "path", "semantic", F.coalesce("dependency", F.lit(0.0)).alias("dependency"), F.least(F.coalesce("b.p", F.lit(0.0)), F.lit(1.0)).alias("historical"), F.when((kind != "source") & (F.col("semantic") > 0), 1.0).otherwise(0.0).alias("kind"), F.col("b.hit").alias("peer"), F.coalesce("b.count", F.lit(0)).alias("co_changes"), kind.alias("k"))
    raw = sum((F.col(c) * (w[c] / total) for c in WEIGHTS), F.lit(0.0))
    score = F.when(F.col("semantic") >= DIRECT, F.greatest(raw, F.lit(FLOOR))).otherwise(raw)
    names = F.array_compact(F.array(
        F.when(F.col("semantic") >= DIRECT, "direct"), F.when(F.col("dependency") > 0, "dependent"), F.when(F.col("historical") >= 0.3, "historically_coupled"),
        F.when((F.col("kind") > 0) & (F.col("k") == "test"), "test").when((F.col("kind") > 0) & (F.col("k") == "config"), "configuration").when((F.col("kind") > 0) & (F.col("k") == "docs"), "documentation")))
    x = x.withColumn("score", F.least(score, F.lit(1.0))).withColumn("level", level(F.col("score"))).withColumn("categories", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("indirect"))))
    x = x.where((F.col("score") >= LEAST) & (F.lit(low) | (F.col("level") != "low")))
    return top(x, n, F.desc(F.round("score", 12)), F.col("path")).select("repo", "path", "score", "level", "categories", "peer", "co_changes")


def capability(path: Column) -> Column:
    """The domain with the most aliases in a path (the first of equals), else a name from its top directory."""
    low = F.lower(path)
    hits = F.array(*[F.struct((-F.size(F.filter(F.array(*[F.lit(a) for a in aliases.split()]), lambda a: low.contains(a)))).alias("n"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, (d, aliases) in enumerate(DOMAINS.items())])
    best = F.array_min(hits)
    stem = F.regexp_replace(F.substring_index(F.substring_index(path, "/", 1), ".", 1), "^[_.]+", "")
    words = F.transform(F.filter(F.split(stem, "[-_]"), lambda x: x != ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))
    named = F.array_join(words, " ")
    return F.when(best.n < 0, best.d).when(named == "", "general").otherwise(named)


def capabilities(files: DataFrame) -> DataFrame:
    """(repo, name, files): how many of a repository's files belong to each capability."""
    return files.select("repo", capability(F.col("path")).alias("name")).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("files"))


def checklist(items: DataFrame) -> DataFrame:
    """(repo, label, files): what to review, by capability and by kind; files sorted and joined by a bar."""
    by = items.select("repo", F.concat(F.lit("Review "), F.lower(capability(F.col("path")))).alias("label"), "path")
    labels = {"test": "Review tests", "configuration": "Review configuration", "documentation": "Review documentation"}
    for category, label in labels.items():
        by = by.unionByName(items.where(F.array_contains("categories", category)).select("repo", F.lit(label).alias("label"), "path"))
    return by.groupBy("repo", "label").agg(F.array_join(F.array_sort(F.collect_set("path")), "|").alias("files"))


def graph(items: DataFrame) -> DataFrame:
    """(repo, from, to, level): edges from the change to each capability touched and from there to its files."""
    rank = F.when(F.col("level") == "high", 0).when(F.col("level") == "medium", 1).otherwise(2)
    x = items.withColumn("c", F.concat(F.lit("capability:"), capability(F.col("path"))))
    tops = x.groupBy("repo", "c").agg(F.min(rank).alias("r")).select("repo", F.lit("change").alias("from"), F.col("c").alias("to"), F.when(F.col("r") == 0, "high").when(F.col("r") == 1, "medium").otherwise("low").alias("level"))
    return tops.unionByName(x.select("repo", F.col("c").alias("from"), F.col("path").alias("to"), "level"))


def terms_of_description(text: str) -> list[str]:
    """The terms of one description, as ``intent`` gives them for a column."""
    import re

    low = text.lower()
    words = {w for w in re.split("[^a-z0-9]+", low) if len(w) > 2 and w not in STOPWORDS}
    return sorted(words | {a for x in DOMAINS.values() for a in x.split() if a in low} | (words & set(TECHNOLOGIES)))
