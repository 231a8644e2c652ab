"""Mixes of sources at target shares of the tokens, with a multivariate-hypergeometric splitting tree.

Plan. A source's documents are laid end to end in hashed order (running sums over hash
buckets, then within each), which cuts the source into blocks of ``block_tokens`` at
the documents' middles. The driver holds one size a source. A mix's total is the largest
at which every source can give its share within its cap; a source's quota is whole passes
over its blocks and a last pass that stops at a document. All blocks weigh the same (a
source smaller than a block gives several passes in one), so they are slots that can be
dealt by number: each node of a binary tree over the shards splits its exact slot counts
in two by one multivariate-hypergeometric draw, each leaf takes the next slots of every
source, in an order permuted for each pass. A node's draw depends on its place only, so
tasks walk down to their own part of the tree and no one holds all shards. The resulting
rows (source, block) -> shard are joined to the documents, which are then shuffled within
their shard.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship, tasks

MOST_TARGETS = 20_000
#: Blocks of a shard, and the slots up to which a draw is exact; more shards are an error.
BLOCKS_A_SHARD, MOST_SLOTS = 32, 1 << 28
#: Documents of a source that one task lays end to end, and shards that one walk deals.
BUCKET, LEAVES = 65_536, 512


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big"))


@dataclass(frozen=True)
class Run:
    """A source's part of a mix: its blocks, whole passes (``each`` of them a slot), and the tokens of the last pass."""

    source: str
    size: int
    blocks: int
    passes: int
    each: int
    rest: int
    quota: int
    share: float
    block_tokens: int

    @property
    def whole(self) -> int:
        """Slots of whole passes; with one block a slot is ``each`` passes, the last one what is left."""
        return self.blocks * self.passes if self.blocks > 1 else -(-self.passes // self.each)

    @property
    def last(self) -> int:
        """Slots of the last pass: whole blocks and the cut one."""
        return self.rest // self.block_tokens + (self.rest % self.block_tokens > 0) if self.rest else 0

    @property
    def slots(self) -> int:
        return self.whole + self.last


def plan_mix(targets: pd.DataFrame, size: dict[str, int], total: int | None, block_tokens: int) -> tuple[list[Run], int]:
    """The sources' runs of a mix and its tokens."""
    able = [(r.source, float(r.share), None if pd.isna(r.cap) else int(r.cap)) for r in targets.itertuples() if size.get(r.source, 0) > 0 and r.share > 0 and (pd.isna(r.cap) or r.cap > 0)]
    weight = sum(w for _, w, _ in able)
    bounds = [c * size[s] * weight / w for s, w, c in able if c is not None]
    most = min(bounds) if bounds else float(sum(size[s] for s, _, _ in able))
    whole = min(most, total) if total is not None else most
    runs = []
    for s, w, c in able:
        quota = round(whole * w / weight)
        if c is not None:
            quota = min(quota, c * size[s])
        passes, rest = divmod(quota, size[s])
        blocks = -(-size[s] // block_tokens)
        each = max(1, block_tokens // size[s]) if blocks == 1 else 1
        runs.append(Run(s, size[s], blocks, passes, each, rest, quota, w / weight, block_tokens))
    return runs, sum(r.quota for r in runs)


def split_counts(counts: np.ndarray, shards: int, key: tuple, depth: int = 0, node: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slots, numbers of slots) of the shards below a node of the tree, exact parts of counts.

    ``node`` numbers the nodes of a depth from the left; the tree's root is 0 of depth 0.
    """

    def halves(a: int, b: int, n: np.ndarray) -> tuple[int, np.ndarray]:
        mid = (a + b) // 2
        if b - a < 2:  # a leaf is the right half of itself
            return mid, np.zeros_like(n)
        take = round(int(n.sum()) * (mid - a) / (b - a))
        return mid, _rng(*key, a, b).multivariate_hypergeometric(n, take, method="marginals")

    a, b, n = 0, shards, counts.astype(np.int64)
    first = np.zeros(len(n), np.int64)
    for level in reversed(range(depth)):
        mid, left = halves(a, b, n)
        if node >> level & 1:
            a, n, first = mid, n - left, first + left
        else:
            b, n = mid, left
    stack = [(a, b, n, first)]
    while stack:
        a, b, n, first = stack.pop()
        if b - a == 1:
            yield a, first, n
        elif b > a:
            mid, left = halves(a, b, n)
            stack += [(mid, b, n - left, first + left), (a, mid, left, first)]


def _permuted(slot: np.ndarray, n: int, key: tuple) -> np.ndarray:
    """slot -> place of 0..n-1, each once."""
    rng = _rng(*key)
    step = int(rng.integers(1, n)) if n > 1 else 1
    while math.gcd(step, n) > 1:
        step = step % n + 1
    return (slot * step + int(rng.integers(n))) % n


def deal(name: str, runs: list[Run], shards: int, seed: int, depth: int = 0, node: int = 0) -> pd.DataFrame:
    """(mix_name, source, block, shard, copies, upto) of the shards below a node.

    upto is null for whole blocks; of the others the documents whose middle lies within
    that many tokens of the source are taken.
    """
    parts = []
    leaves = list(split_counts(np.array([r.slots for r in runs], np.int64), shards, (seed, name), depth, node))
    for i, r in enumerate(runs):
        shard = np.repeat(np.array([x for x, _, _ in leaves], np.int64), [int(n[i]) for _, _, n in leaves])
        slot = np.concatenate([np.arange(int(f[i]), int(f[i] + n[i])) for _, f, n in leaves]) if leaves else np.zeros(0, np.int64)
        if not len(slot):
            continue
        copies = np.ones(len(slot), np.int64)
        block, upto = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        whole = slot < r.whole
        if r.blocks == 1:
            copies[whole] = np.minimum(r.each, r.passes - slot[whole] * r.each)
        else:
            of = slot // r.blocks
            for k in np.unique(of[whole]).tolist():
                own = whole & (of == k)
                block[own] = _permuted(slot[own] - k * r.blocks, r.blocks, (seed, name, r.source, k))
        block[~whole] = _permuted(slot[~whole] - r.whole, r.last, (seed, name, r.source, "last")) if r.last else 0
        cut = ~whole & (block == r.rest // r.block_tokens)
        upto[cut] = r.rest
        rows = pd.DataFrame({"block": block, "shard": shard, "upto": upto, "copies": copies}).groupby(["block", "shard", "upto"], as_index=False)["copies"].sum()
        parts.append(rows.assign(mix_name=name, source=r.source, upto=rows["upto"].astype("Int64").mask(rows["upto"] == 0)))
    columns = ["mix_name", "source", "block", "shard", "copies", "upto"]
    return pd.concat(parts, ignore_index=True)[columns] if parts else pd.DataFrame({c: pd.Series([], dtype="object" if c in ("mix_name", "source") else "Int64") for c in columns})


def _targets(targets: DataFrame) -> pd.DataFrame:
    t = targets.where("mix_name is not null and source is not null").select("mix_name", "source", F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")).distinct()
    rows = t.groupBy("mix_name", "source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap")).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return pd.DataFrame([tuple(r) for r in rows], columns=["mix_name", "source", "share", "cap"]).fillna({"share": 0.0}).sort_values(["mix_name", "source"])


def _laid_out(d: DataFrame, sizes: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """Documents (doc_id, source, n_tokens) with the block their middle lies in and twice the place of that middle."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "doc_id"), 1)
    bucket = F.shiftright(F.shiftright("_u", 32) * F.col("buckets"), 31)
    d = d.join(F.broadcast(sizes), "source").withColumn("_u", u).withColumn("_bucket", bucket).drop("buckets")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_n")).select("source", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    line = Window.partitionBy("source", "_bucket").orderBy("_u", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = 2 * (F.col("_start") + F.sum("n_tokens").over(line)) - F.col("n_tokens")
    return d.join(starts, ["source", "_bucket"]).select("doc_id", "source", "n_tokens", middle.alias("middle")).withColumn("block", F.expr(f"middle div {2 * block_tokens}"))


def mix_sources(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", tokens: str = "n_tokens",
    total_tokens: int | None = None, shard_tokens: int = 1_000_000, seed: int = 0,
) -> DataFrame:
    """(mix_name, shard, shuffle_key, doc_id, source, n_tokens, copies): the documents of every mix.

    Each source with documents gets its target share (shares of sources without any
    are spread over the others in proportion), to within half a document; no document
    has more than max_repeats copies in a mix. The total is ``total_tokens`` or, where
    that is null or more than the caps allow, the largest at which all shares hold (the
    tokens of all its sources where none is capped). A shard has about ``shard_tokens``,
    or less where the total does not fill them; documents longer than a block (a 32nd of a
    shard) make shards differ by as much. Documents with a null source, null
    id or no tokens are in no mix; a repeated id is one document for each row. Repeated targets count
    once, two shares for one source add up, the smaller cap holds; targets with a null
    mix or source are left out; a cap of 0 or less is a source without documents. More
    shards than can be drawn exactly (2^27 of a mix) raise ValueError.
    """
    spark = docs.sparkSession
    ship(spark)
    want = _targets(targets)
    listed = spark.createDataFrame([(s,) for s in sorted(set(want["source"]))], "source string")
    d = docs.where(F.col(doc_id).isNotNull() & (F.col(tokens) > 0)).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("n_tokens"))
    d = d.join(F.broadcast(listed), "source")
    held = d.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k")).collect()  # at most MOST_TARGETS
    size = {r["source"]: int(r["n"]) for r in held}
    mixes = [(str(name), t) for name, t in want.groupby("mix_name")]
    most = max([plan_mix(t, size, total_tokens, 1)[1] for _, t in mixes], default=0)
    block_tokens = max(1, shard_tokens // BLOCKS_A_SHARD, -(-most // MOST_SLOTS))
    if 2 * block_tokens > shard_tokens and most > shard_tokens:
        raise ValueError(f"{most} tokens in shards of {shard_tokens}: too many shards, or shards too small, to be drawn exactly")
    plans, walks = {}, []
    for name, t in mixes:
        runs, whole = plan_mix(t, size, total_tokens, block_tokens)
        shards = max(1, -(-whole // shard_tokens))
        depth = max(0, (shards - 1) // LEAVES).bit_length()
        plans[name] = (runs, shards, depth)
        walks.append((name, 1 << depth))
    ends = np.cumsum([n for _, n in walks]).tolist()

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for walk in batch["id"].tolist():
                i = int(np.searchsorted(ends, walk, side="right"))
                name = walks[i][0]
                runs, shards, depth = plans[name]
                yield deal(name, runs, shards, seed, depth, walk - (ends[i] - walks[i][1]))

    n_walks = ends[-1] if ends else 0
    slots = spark.range(0, n_walks, 1, max(1, min(n_walks, tasks(spark)))).mapInPandas(dealt, "mix_name string, source string, block bigint, shard bigint, copies bigint, upto bigint")
    sizes = spark.createDataFrame([(r["source"], -(-int(r["k"]) // BUCKET)) for r in held], "source string, buckets bigint")
    laid = _laid_out(d, sizes, block_tokens, seed)
    met = laid.join(slots, ["source", "block"]).where(F.col("upto").isNull() | (F.col("middle") <= 2 * F.col("upto")))
    met = met.select("mix_name", "shard", F.xxhash64(F.lit(seed), "mix_name", "shard", "doc_id").alias("shuffle_key"), "doc_id", "source", "n_tokens", "copies").repartition("mix_name", "shard")
    out = met.groupBy("mix_name", "shard", "shuffle_key", "doc_id", "source", "n_tokens").agg(F.sum("copies").alias("copies"))
    return out.sortWithinPartitions("mix_name", "shard", "shuffle_key", "doc_id")


def shard_report(mixed: DataFrame) -> DataFrame:
    """(mix_name, shard, tokens, documents, copies) of every shard that got something."""
    return mixed.groupBy("mix_name", "shard").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, documents, most_copies) for every target.

    A source that gave nothing has zeros; shares are of the mix's tokens, null where it
    has none.
    """
    got = mixed.groupBy("mix_name", "source", "doc_id").agg(F.sum("copies").alias("c"), F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).groupBy("mix_name", "source").agg(
        F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("c").alias("most_copies"))
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("total"))
    t = targets.where("mix_name is not null and source is not null").select("mix_name", "source", "target_share", "max_repeats").distinct().groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return t.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left").select(
        "mix_name", "source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("actual_share"), zero("tokens"), zero("documents"), zero("most_copies"))
