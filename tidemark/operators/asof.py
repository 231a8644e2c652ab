"""Attributes as they were known at event time (bitemporal as-of join).

A fact is valid from one time on and becomes known at another. An event may only
see facts with both times strictly before its own, and of those the one with the
largest valid time, then known time, then id.

Plan. A fact is usable from ``avail = max(valid, known)`` on. Each entity's time
line is cut into blocks at quantiles of ``avail`` while a block has more facts
and events than ``block_rows``; a block holds the facts that become usable in it,
its events and one carried fact, the best of all earlier blocks. No task holds
more than its blocks, however hot an entity is; cut points reach the rows by joins
salted over the rows of a block, and a block of one time, whose facts none of its own
events may see, is dealt out by hash. Blocks are hashed to partitions,
one shuffle of facts and events together; in a partition all blocks of a batch
share one path-copied persistent search tree (a shard's tree): version t of the
tree holds the t facts first known, an event takes its known-time root and
descends to the last valid key before its time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut, ship

#: Parts into which a block is cut at a time, and into which its rows are salted in joins.
FAN, SALT = 32, 64
FIRST = -(2**63)


class PersistentTree:
    """Path-copied search tree over ranks 0..n-1, one version for each insertion.

    Inserting rank r copies the nodes from the root to leaf r: one node a level.
    So level d of version t is node t of that level, which keeps its count and
    the version of its other child. All copies of a level are made at once.
    """

    def __init__(self, order: np.ndarray):
        """order[t] is the rank inserted as version t + 1; each rank at most once."""
        n = len(order)
        self.depth = max(1, int(n - 1).bit_length()) if n else 1
        self.n = n
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        times = np.arange(n, dtype=np.int64)
        for level in range(self.depth):
            shift = self.depth - level - 1
            child = order >> shift
            # the newest copy of a node's left and right child at each version of it
            by_node = np.lexsort((times, child >> 1))
            parent = (child >> 1)[by_node]
            new_run = np.r_[True, parent[1:] != parent[:-1]] if n else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(new_run, np.arange(n), 0)) if n else times
            sides = []
            for side in (0, 1):
                at = np.where((child[by_node] & 1) == side, np.arange(n), -1)
                last = np.maximum.accumulate(at) if n else at
                last = np.where(last >= start, by_node[np.maximum(last, 0)], -1)
                pointer = np.full(n, -1, np.int64)
                pointer[by_node] = last
                sides.append(pointer)
            seen = np.empty(n, np.int64)
            is_left = ((child[by_node] & 1) == 0).astype(np.int64)
            running = np.cumsum(is_left)
            before = running[start] - is_left[start] if n else running
            seen[by_node] = running - before
            self.levels.append((sides[0], sides[1], seen))

    def count_below(self, version: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many ranks < bound the given versions hold (version 0 is empty)."""
        node, total = version - 1, np.zeros(len(version), np.int64)
        full = bound >= (1 << self.depth)
        for level in range(self.depth):
            left, right, seen = self.levels[level]
            bit = (bound >> (self.depth - level - 1)) & 1
            held = node >= 0
            at = np.maximum(node, 0)
            total += np.where(held & (bit == 1), seen[at], 0)
            node = np.where(held, np.where(bit == 1, right[at], left[at]), -1)
        return np.where(full, version, total)

    def select(self, version: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest rank (from 0) that each version holds."""
        node, rank, k = version - 1, np.zeros(len(version), np.int64), k.copy()
        for level in range(self.depth):
            left, right, seen = self.levels[level]
            at = np.maximum(node, 0)
            lefts = np.where(node >= 0, seen[at], 0)
            go = k >= lefts
            k = np.where(go, k - lefts, k)
            node = np.where(go, right[at], left[at])
            rank = rank * 2 + go
        return rank


def latest_known(entity, valid, known, tie, ask_entity, ask_time) -> np.ndarray:
    """For each asked (entity, time) the position of the fact that was known, or -1."""
    n = len(entity)
    if not n or not len(ask_time):
        return np.full(len(ask_time), -1, np.int64)
    by_key = np.lexsort((tie, known, valid, entity))
    rank = np.empty(n, np.int64)
    rank[by_key] = np.arange(n)
    by_known = np.argsort(known, kind="stable")
    tree = PersistentTree(rank[by_known])
    root = np.searchsorted(known[by_known], ask_time, side="left")
    # keys before (entity, time): facts of smaller entities, then those valid earlier
    keys_e, keys_v = entity[by_key], valid[by_key]
    low = np.searchsorted(keys_e, ask_entity, side="left")
    size = np.searchsorted(keys_e, ask_entity, side="right") - low
    pos = _bound(keys_v, low, size, ask_time)
    upto, below = tree.count_below(root, pos), tree.count_below(root, low)
    hit = upto > below
    found = tree.select(np.where(hit, root, 1), np.where(hit, upto - 1, 0))
    return np.where(hit, by_key[np.minimum(found, n - 1)], -1)


def _bound(values: np.ndarray, low: np.ndarray, size: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """First position in values[low:low+size] (sorted there) that is not below limit."""
    lo, hi = low.astype(np.int64).copy(), (low + size).astype(np.int64)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        less = (lo < hi) & (values[np.minimum(mid, len(values) - 1)] < limit)
        lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
    return lo


def _search(batches: Iterator[pd.DataFrame], names: list[str], kept: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Runs of whole blocks, sorted by block, through one tree each."""

    def answer(held: pd.DataFrame) -> pd.DataFrame:
        block = pd.factorize(held["_block"])[0]
        fact = held["_fact"].to_numpy(bool)
        facts, asks = held[fact], held[~fact]
        at = latest_known(
            block[fact], facts["_valid"].to_numpy(np.int64), facts["_known"].to_numpy(np.int64), facts["_tie"].to_numpy(np.int64),
            block[~fact], asks["_known"].to_numpy(np.int64),
        )
        out = {"_row": asks["_tie"].to_numpy(np.int64), "_hit": at >= 0}
        for name in names:
            column = facts[name].astype("Int64").array
            out[name] = pd.Series(column.take(at, allow_fill=True))
        for name in kept:
            out[name] = asks[name].astype("Int64").to_numpy(dtype=object, na_value=None)
        return pd.DataFrame(out)

    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= most:
            whole = pd.concat(held, ignore_index=True)
            blocks = whole["_block"].to_numpy()
            end = int((blocks == blocks[-1]).argmax())
            if end:
                yield answer(whole.iloc[:end].reset_index(drop=True))
                held = [whole.iloc[end:]]
                rows = len(held[0])
    if held:
        yield answer(pd.concat(held, ignore_index=True))


def known_at_event(
    events: DataFrame,
    facts: DataFrame,
    entity: list[str],
    event_id: str,
    event_time: str,
    valid_from: str,
    known_at: str,
    fact_id: str,
    values: list[str],
    default: int | None = None,
    prefix: str = "known_",
    carry: list[str] | None = None,
    block_rows: int = 200_000,
    batch_rows: int = 400_000,
) -> DataFrame:
    """One row per event: event_id, the bigint event columns in ``carry``, ``prefix + value``
    for each value, ``is_known``.

    event_id must be a unique bigint; times are bigint, values bigint. Nulls in an
    entity column match nothing; an event with a null time or a null entity gets the
    default and is_known false. Facts with a null valid or known time are never
    known; a null fact_id counts as the smallest. A known fact's null value stays
    null. Repeated facts and events do no harm. Empty inputs give an empty or an
    all-default result. Extra columns of either side are ignored, so their names
    may clash. All facts of an entity's block, plus one carried fact, are in one
    task: at most ``block_rows`` facts and events.
    """
    spark = events.sparkSession
    ship(spark)
    key = [F.col(c) for c in entity]
    carry = carry or []
    names = [f"_v{i}" for i in range(len(values))]
    kept = [f"_c{i}" for i in range(len(carry))]
    usable = F.greatest(F.col(valid_from), F.col(known_at))
    f = facts.where(F.col(valid_from).isNotNull() & F.col(known_at).isNotNull()).select(
        *[c.alias(f"_e{i}") for i, c in enumerate(key)], F.lit(True).alias("_fact"), usable.alias("_at"),
        F.col(valid_from).alias("_valid"), F.col(known_at).alias("_known"), F.coalesce(F.col(fact_id), F.lit(-(2**63))).alias("_tie"),
        *[F.col(v).cast("bigint").alias(n) for v, n in zip(values, names)], *[F.lit(None).cast("bigint").alias(n) for n in kept],
    )
    e = events.select(
        *[c.alias(f"_e{i}") for i, c in enumerate(key)], F.lit(False).alias("_fact"), F.col(event_time).cast("bigint").alias("_at"),
        F.lit(0).cast("bigint").alias("_valid"), F.col(event_time).cast("bigint").alias("_known"), F.col(event_id).alias("_tie"),
        *[F.lit(None).cast("bigint").alias(n) for n in names], *[F.col(c).cast("bigint").alias(n) for c, n in zip(carry, kept)],
    )
    ids = [f"_e{i}" for i in range(len(entity))]
    whole = F.lit(True)
    for c in ids:
        whole = whole & F.col(c).isNotNull()
    both = f.unionByName(e.where(F.col("_at").isNotNull())).where(whole)

    both = _in_blocks(both, ids, names, kept, block_rows)
    block = F.xxhash64(*ids, "_lo", "_sub")  # only spreads and orders; equality is by the exact key below
    exact = F.concat_ws("\x1f", *[F.regexp_replace(F.col(c).cast("string"), "\x1f", "\x1f\x1f") for c in ids], F.col("_lo").cast("string"), F.col("_sub").cast("string"))
    flat = both.select(block.alias("_h"), exact.alias("_block"), "_fact", "_valid", "_known", "_tie", *names, *kept)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = flat.repartition(n, "_h").sortWithinPartitions("_h", "_block").drop("_h")
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_hit", T.BooleanType()), *[T.StructField(x, T.LongType()) for x in [*names, *kept]]])
    got = flat.mapInPandas(lambda it: _search(it, names, kept, batch_rows), schema)
    fill = (lambda c: c) if default is None else (lambda c: F.when(F.col("_hit"), c).otherwise(F.lit(default).cast("bigint")))
    got = got.select(F.col("_row").alias(event_id), *[F.col(n).alias(c) for c, n in zip(carry, kept)], *[fill(F.col(n)).alias(prefix + v) for v, n in zip(values, names)], F.col("_hit").alias("is_known"))
    lost = events.where(F.col(event_time).isNull() | ~_all_set(entity)).select(
        F.col(event_id), *[F.col(c).cast("bigint").alias(c) for c in carry], *[F.lit(default).cast("bigint").alias(prefix + v) for v in values], F.lit(False).alias("is_known"))
    return got.unionByName(lost)


def _all_set(columns: list[str]):
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _in_blocks(both: DataFrame, ids: list[str], names: list[str], kept: list[str], block_rows: int) -> DataFrame:
    """Facts and events with the block they are in: the first time of its span (_lo) and a part of it (_sub), with the carried facts.

    Blocks of more than ``block_rows`` rows are cut at quantiles of their times, and just
    after their first time, until each is small enough or of one time; the latter are
    dealt to parts by hash. Only rows of entities that are too large for one block are
    written and read again.
    """
    key = [*ids, "_lo"]
    both = both.withColumn("_lo", F.lit(FIRST)).withColumn("_sub", F.lit(0))

    def too_large(rows: DataFrame) -> DataFrame:  # at most rows / block_rows of them
        return cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"), F.max("_at").alias("_to")).where(F.col("_n") > block_rows))

    large = too_large(both)
    if large.isEmpty():
        return both
    salt = F.pmod(F.xxhash64("_tie", "_at"), F.lit(SALT)).cast("int")
    tagged = both.withColumn("_salt", salt).join(_salted(large.select(*ids)).withColumn("_hot", F.lit(True)), [*ids, "_salt"], "left")
    cold = tagged.where("_hot is null").drop("_hot", "_salt")
    hot = cut(tagged.where("_hot").drop("_hot"))
    while not (wide := large.where("_from < _to")).isEmpty():
        inside = hot.join(_salted(wide.select(*key)), [*key, "_salt"], "left_semi")
        cuts = cut(inside.groupBy(*key).agg(F.array_append(F.percentile_approx("_at", [i / FAN for i in range(1, FAN)], 10_000), F.min("_at") + 1).alias("_cuts")))
        hot = hot.join(_salted(cuts), [*key, "_salt"], "left").withColumn("_lo", F.coalesce(F.array_max(F.filter("_cuts", lambda c: c <= F.col("_at"))), F.col("_lo"))).drop("_cuts")
        hot = cut(hot)
        large = too_large(hot)
    if not large.isEmpty():
        parts = large.select(*key, F.ceil(F.col("_n") / block_rows).cast("int").alias("_parts"))
        hot = cut(hot.join(_salted(parts), [*key, "_salt"], "left").withColumn("_sub", F.pmod(F.xxhash64(F.lit(1), "_tie", "_known"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts"))
    hot = hot.drop("_salt")
    # what the earlier blocks leave to a block: their best fact
    best = hot.groupBy(*key).agg(F.max(F.when(F.col("_fact"), F.struct("_valid", "_known", "_tie", *names))).alias("_best"), F.max("_sub").alias("_last"))
    earlier = Window.partitionBy(*ids).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    carried = best.withColumn("_b", F.max("_best").over(earlier)).where("_b is not null").select(
        *ids, F.lit(True).alias("_fact"), F.greatest("_b._valid", "_b._known").alias("_at"), "_b._valid", "_b._known", "_b._tie", *[f"_b.{n}" for n in names], *[F.lit(None).cast("bigint").alias(n) for n in kept],
        "_lo", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("_sub"))
    return cold.unionByName(hot).unionByName(carried)
