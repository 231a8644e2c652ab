"""Connected components by alternating large-star and small-star, and splits that keep them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut, discard, written

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (u, v), u > v, each once.

    Every node asks for the smallest of its neighbours (all of them, or the smaller
    ones). The minimum is aggregated map side; the join that hands it to the node's
    edges is one that AQE splits when a node has very many of them.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        out = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the bigint edges (a, b); root is the smallest node reached.

    Alternates large-star and small-star until the edges are stars, each round a
    table in the shared folder, so a lost executor costs one round at most. Edges
    with a null end are dropped, loops and repeats do no harm, an empty input gives
    an empty result.
    """
    spark = edges.sparkSession
    start = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    loops = start.where("u = v").select(F.col("u").alias("node")).distinct()
    work, at = written(start.where("u <> v").distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        work, new = written(_star(_star(work, True), False))
        discard(spark, at)
        at, now = new, tuple(work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = work.select(F.col("v").alias("node")).distinct()
    stars = work.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = roots.unionByName(loops.join(work.select(F.col("u").alias("node")), "node", "left_anti")).distinct()
    return stars.unionByName(own.withColumn("root", F.col("node")))


def keyed_components(links: DataFrame) -> DataFrame:
    """(key, root) for the string links (a, b): same root, same component.

    Keys become 64-bit hashes; should two keys ever share one, another seed is taken,
    so no two components are joined by chance.
    """
    keys = links.select(F.explode(F.array("a", "b")).alias("key")).where("key is not null").distinct()
    keys, _ = written(keys)
    for seed in range(64):
        ids = keys.withColumn("node", F.xxhash64(F.lit(seed), "key"))
        if ids.count() == ids.agg(F.count_distinct("node")).collect()[0][0]:
            break
    edges = links.select(F.xxhash64(F.lit(seed), "a").alias("a"), F.xxhash64(F.lit(seed), "b").alias("b")).where(
        F.col("a").isNotNull())
    return ids.join(components(edges), "node").select("key", "root")


#: Slots of the hash in which a split's bounds are found.
SLOTS = 4096


def grouped_split(rows: DataFrame, row_id: str, group: str, shares: dict[str, float], seed: int = 0, big: float = 0.005) -> DataFrame:
    """(row_id, split): every group whole in one split, rows near the given shares.

    Groups of more than ``big`` of all rows (fewer than 1 / big, so they fit the
    driver) are placed one by one, largest first, where most is missing; all others
    by the hash of their id into ranges of what is still missing, whose bounds lie where the
    groups' rows, counted in 4096 slots of the hash, fill them: shares are met to within
    one slot, however sizes vary. A row
    with a null group is a group of its own. Ties go to the group id; no rows give no
    rows; a single group takes one split whole.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(row_id).alias("_row"), F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("r"), F.col(row_id).cast("string"))).alias("_group"))
    sizes = cut(own.groupBy("_group").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    slot = F.pmod(F.xxhash64(F.lit(seed), "_group"), F.lit(SLOTS))
    large = sizes.where(F.col("n") > F.lit(big * total)).collect()
    by_slot = {r["slot"]: r["n"] for r in sizes.where(F.col("n") <= F.lit(big * total)).groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).collect()}
    missing = {k: v * total / sum(shares.values()) for k, v in shares.items()}
    placed = []
    for r in sorted(large, key=lambda r: (-r["n"], r["_group"])):
        to = max(missing, key=lambda k: missing[k])
        missing[to] -= r["n"]
        placed.append((r["_group"], to))
    left = {k: max(0.0, v) for k, v in missing.items()}
    names, at, rule = list(left), 0, None
    for name in names[:-1]:
        got = 0
        # a slot goes where at least half of it is missing
        while at < SLOTS and got + by_slot.get(at, 0) / 2 <= left[name] and left[name] > 0:
            got += by_slot.get(at, 0)
            at += 1
        rule = (F.when if rule is None else rule.when)(slot < F.lit(at), F.lit(name))
    hashed = F.lit(names[-1]) if rule is None else rule.otherwise(F.lit(names[-1]))
    table = spark.createDataFrame(placed, "_group string, _to string")
    return own.join(F.broadcast(table), "_group", "left").select(F.col("_row").alias(row_id), F.coalesce("_to", hashed).alias("split"))


def commit_links(commits: DataFrame, aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between commits and what relates them: authors, series, messages with a sha.

    Keys are tagged (c sha, a author, s series). A message links to each commit whose
    first 12 digits it contains, found by the 12-grams of its runs of hex digits in one
    equi-join on 48-bit numbers.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    clean = lambda c: F.when(bare(c) != "", F.lower(bare(c)))
    c = commits.where("sha is not null").select(
        F.lower("sha").alias("sha"), F.coalesce(clean(F.col("author.email")), clean(F.col("author.name"))).alias("who"), F.lower("message").alias("message"))
    commit = lambda x: F.concat(F.lit("c"), F.col(x))
    author = lambda x: F.concat(F.lit("a"), x)
    by_author = c.where("who is not null").select(commit("sha").alias("a"), author(F.col("who")).alias("b"))
    same = aliases.select(author(clean(F.col("alias_key"))).alias("a"), author(clean(F.col("canonical_key"))).alias("b")).where("a is not null and b is not null")
    series = rows.where("commit_sha is not null and series_id is not null").select(
        F.concat(F.lit("c"), F.lower("commit_sha")).alias("a"), F.concat(F.lit("s"), F.col("series_id").cast("string")).alias("b")).distinct()
    runs = c.select("sha", F.explode(F.regexp_extract_all("message", F.lit("([0-9a-f]{12,})"), 1)).alias("run"))
    grams = runs.select("sha", F.explode(F.sequence(F.lit(1), F.length("run") - 11)).alias("i"), "run").select(
        "sha", F.conv(F.substring("run", F.col("i"), F.lit(12)), 16, 10).cast("bigint").alias("head")).distinct()
    heads = c.select(F.col("sha").alias("named"), F.conv(F.substring("sha", 1, 12), 16, 10).cast("bigint").alias("head")).distinct()
    mentions = grams.join(heads, "head").where("sha <> named").select(commit("sha").alias("a"), commit("named").alias("b"))
    return by_author.unionByName(same).unionByName(series).unionByName(mentions).distinct()


def related_commits(commits: DataFrame, aliases: DataFrame, rows: DataFrame) -> DataFrame:
    """(commit_sha, root) for every commit_sha of rows; one without any link is its own root."""
    found = keyed_components(written(commit_links(commits, aliases, rows))[0])
    own = rows.where("commit_sha is not null").select(F.lower("commit_sha").alias("commit_sha")).distinct()
    linked = found.where(F.substring("key", 1, 1) == "c").select(F.substring("key", 2, 1 << 20).alias("commit_sha"), "root")
    return own.join(linked, "commit_sha", "left").select("commit_sha", F.coalesce(F.concat(F.lit("g"), F.col("root").cast("string")), F.concat(F.lit("c"), F.col("commit_sha"))).alias("root"))
