"""Frequent subsequences of many sequences, with gaps: a position-coded access-pattern tree.

A sequence is a list of steps in rising time, each a set of items. Sequences are
merged into a prefix tree whose nodes hold a count, the step they stand in and a
position code (preorder number and end of the subtree), so "below" is two
comparisons. Mining keeps for a pattern the topmost nodes where it first ends and
follows the header link of each item to the topmost nodes below them in a later
step: no tree is ever rebuilt.

Scale. A scope's sequences go to blocks of about ``block_size`` sequences and
``block_events`` events, whichever are fewer, by a hash, one tree each. Where a scope has
several blocks, a pattern frequent in the scope is frequent
in one of its blocks at least at the same rate; so the union of the blocks' patterns
holds all, and a second pass counts exactly those in every block. Both passes are
exact, and no task holds more than its blocks, however large a scope is.

Of a scope's sequences of more than ``long`` events the longest, up to half as many as a
pattern needs, are in no tree: a frequent pattern then has at least half its support in
the others, so theirs, mined with that much less, are looked up in these long sequences,
one step after the other for each shared prefix, by running minima over time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, ship


class PatternTree:
    """The prefix tree of sequences of events, given as flat columns sorted by sequence, step and item."""

    def __init__(self, sequence: np.ndarray, step: np.ndarray, item: np.ndarray, n_items: int):
        # an event's code orders as (step, item) does; sequences sorted by their codes have equal prefixes side by side
        events, code = np.unique(step * max(1, n_items) + item, return_inverse=True)
        edges = np.r_[np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]]), len(sequence)] if len(sequence) else np.zeros(1, np.int64)
        raw = code.astype(">u4").tobytes()
        order = sorted(range(len(edges) - 1), key=lambda k: raw[4 * edges[k] : 4 * edges[k + 1]])
        made, count, last = [], np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        path, previous, n = np.zeros(0, np.int64), code[:0], 0
        for k in order:
            own = code[edges[k] : edges[k + 1]]
            m = min(len(own), len(previous))
            apart = np.flatnonzero(own[:m] != previous[:m])
            same = int(apart[0]) if len(apart) else m
            last[path[same:]] = n - 1
            path = np.r_[path[:same], np.arange(n, n + len(own) - same)]
            made.append(own[same:])
            count[path] += 1
            n += len(own) - same
            previous = own
        last[path] = n - 1
        node = events[np.concatenate(made)] if made else events
        self.step, self.count, self.last = node // max(1, n_items), count[:n], last[:n]
        items = node % max(1, n_items)
        by_item = np.argsort(items, kind="stable")
        edges = np.searchsorted(items[by_item], np.arange(n_items + 1))
        self.header = [by_item[edges[i] : edges[i + 1]] for i in range(n_items)]

    def topmost(self, nodes: np.ndarray) -> np.ndarray:
        """Of nodes in preorder those with none of the others above."""
        if not len(nodes):
            return nodes
        reach = np.maximum.accumulate(self.last[nodes])
        return nodes[np.r_[True, nodes[1:] > reach[:-1]]]

    def first(self, item: int) -> np.ndarray:
        return self.topmost(self.header[item])

    def below(self, roots: np.ndarray, item: int) -> np.ndarray:
        """Topmost nodes of an item below the roots (disjoint, in preorder), in a later step."""
        nodes = self.header[item]
        if not len(roots) or not len(nodes):
            return nodes[:0]
        at = np.searchsorted(roots, nodes, side="left") - 1
        root = roots[np.maximum(at, 0)]
        ok = (at >= 0) & (nodes <= self.last[root]) & (self.step[nodes] > self.step[root])
        return self.topmost(nodes[ok])

    def support(self, nodes: np.ndarray) -> int:
        return int(self.count[nodes].sum())


def mine(tree: PatternTree, n_items: int, least: float, shortest: int, longest: int, repeats: bool) -> Iterator[tuple[tuple[int, ...], int]]:
    """Patterns of shortest..longest items in at least ``least`` sequences, with their counts."""
    firsts = [(i, tree.first(i)) for i in range(n_items)]
    firsts = [(i, nodes) for i, nodes in firsts if tree.support(nodes) >= least]
    alphabet = [i for i, _ in firsts]

    def grow(pattern: tuple[int, ...], roots: np.ndarray, items: list[int]):
        found = []
        for item in items:
            if not repeats and item in pattern:
                continue
            nodes = tree.below(roots, item)
            n = tree.support(nodes)
            if n >= least:
                found.append((item, nodes, n))
        # an item that does not follow the pattern follows none of its extensions
        deeper = [x for x, _, _ in found]
        for item, nodes, n in found:
            longer = (*pattern, item)
            if len(longer) >= shortest:
                yield longer, n
            if len(longer) < longest:
                yield from grow(longer, nodes, deeper)

    for item, nodes in firsts:
        if shortest <= 1:
            yield (item,), tree.support(nodes)
        if longest > 1:
            yield from grow((item,), nodes, alphabet)


def count_patterns(tree: PatternTree, code: dict[str, int], patterns: list[list[str]]) -> np.ndarray:
    """The sequences that hold each pattern; shared prefixes are walked once."""
    known: dict[tuple[int, ...], np.ndarray] = {}

    def nodes(p: tuple[int, ...]) -> np.ndarray:
        if p not in known:
            known[p] = tree.first(p[0]) if len(p) == 1 else tree.below(nodes(p[:-1]), p[-1])
        return known[p]

    out = np.zeros(len(patterns), np.int64)
    for k, pattern in enumerate(patterns):
        if all(x in code for x in pattern):
            out[k] = tree.support(nodes(tuple(code[x] for x in pattern)))
    return out


def _load(held: pd.DataFrame) -> tuple[PatternTree, list[str]]:
    sequence = np.repeat(np.arange(len(held)), [len(x) for x in held["items"]])
    item, names = pd.factorize(np.concatenate([np.asarray(x, object) for x in held["items"]]), sort=True)
    time = np.concatenate([np.asarray(x, np.int64) for x in held["times"]])
    order = np.lexsort((item, time, sequence))
    sequence, time, item = sequence[order], time[order], item[order].astype(np.int64)
    fresh = np.r_[True, sequence[1:] != sequence[:-1]]
    later = np.cumsum(np.r_[True, fresh[1:] | (time[1:] != time[:-1])])
    step = later - later[fresh][np.cumsum(fresh) - 1]  # from 0 in each sequence
    return PatternTree(sequence, step, item, len(names)), list(names)


def _mined(held: pd.DataFrame, shortest: int, longest: int, repeats: bool) -> pd.DataFrame:
    tree, items = _load(held)
    least = max(1.0, float(held["rate"].iloc[0]) * len(held) - 1e-9)
    found = [([items[i] for i in p], n) for p, n in mine(tree, len(items), least, shortest, longest, repeats)]
    first = held.iloc[0]
    return pd.DataFrame({"scope": first["scope"], "blocks": first["blocks"], "pattern": [p for p, _ in found], "support": pd.Series([n for _, n in found], dtype="int64")})


def _counted(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    if held.empty or wanted.empty:
        return pd.DataFrame({"scope": [], "pattern": [], "support": []})
    tree, items = _load(held)
    patterns = [list(p) for p in wanted["pattern"]]
    n = count_patterns(tree, {x: i for i, x in enumerate(items)}, patterns)
    return pd.DataFrame({"scope": held["scope"].iloc[0], "pattern": patterns, "support": n})


def frequent_subsequences(
    rows: DataFrame, scope: str, sequence: str, time: str, item: str, min_count: int = 1, min_share: float = 0.0,
    shortest: int = 1, longest: int = 3, repeats: bool = True, block_size: int = 4096, block_events: int = 1_000_000, long: int = 20_000,
) -> DataFrame:
    """(scope, pattern, support, n): patterns of shortest..longest items, steps at strictly rising times.

    support of the scope's n sequences hold the pattern (gaps allowed), at least
    min_count and min_share * n of them. With repeats=False a pattern holds no item
    twice. Rows with a null scope, sequence, time or item are left out and make no
    sequence; repeated rows change nothing; items at one time are one step and never
    follow each other. No rows, no patterns. Times are taken as bigint. A task holds a
    block, and no sequence is cut: besides the long ones that are looked up, the
    sequences of a scope have to fit a task one by one.
    """
    spark = rows.sparkSession
    ship(spark)
    r = rows.select(F.col(scope).alias("scope"), F.col(sequence).alias("seq"), F.col(time).cast("bigint").alias("t"), F.col(item).alias("item")).where(
        "scope is not null and seq is not null and t is not null and item is not null").distinct()
    n = r.groupBy("scope").agg(F.count_distinct("seq").alias("n"))
    need = F.greatest(F.lit(float(min_count)), F.lit(float(min_share)) * F.col("n"), F.lit(1.0))
    frequent = r.groupBy("scope", "item").agg(F.count_distinct("seq").alias("k")).join(n, "scope").where(F.col("k") >= need - 1e-9)
    kept = cut(r.join(frequent.select("scope", "item"), ["scope", "item"], "left_semi"))
    order = Window.partitionBy("scope").orderBy(F.desc("k"), "seq")
    giants = cut(kept.groupBy("scope", "seq").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > long).join(n, "scope").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= (need - 1) / 2).select("scope", "seq"))
    some = not giants.isEmpty()  # at most rows / long sequences
    short = kept.join(giants, ["scope", "seq"], "left_anti") if some else kept
    sizes = n.join(giants.groupBy("scope").agg(F.count(F.lit(1)).alias("h")), "scope", "left").withColumn("h", F.coalesce("h", F.lit(0))) if some else n.withColumn("h", F.lit(0))
    sizes = sizes.join(short.groupBy("scope").agg(F.count(F.lit(1)).alias("events")), "scope")
    sequences = short.groupBy("scope", "seq").agg(F.collect_list(F.struct("t", "item")).alias("e"))
    blocks = F.ceil(F.greatest(F.col("n") / float(block_size), F.col("events") / float(block_events))).cast("int")
    sequences = cut(sequences.join(sizes, "scope").select(
        "scope", F.col("e.t").alias("times"), F.col("e.item").alias("items"), (F.greatest(need - F.col("h"), F.lit(1.0)) / F.col("n")).alias("rate"), blocks.alias("blocks"),
        F.pmod(F.xxhash64(F.col("seq").cast("string")), blocks).cast("int").alias("block")))
    mined = cut(sequences.groupBy("scope", "block").applyInPandas(
        lambda held: _mined(held, shortest, longest, repeats), "scope string, blocks int, pattern array<string>, support bigint"))
    whole = mined.where("blocks = 1").select("scope", "pattern", "support")
    wanted = mined.where("blocks > 1").select("scope", "pattern", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).distinct()
    counted = sequences.where("blocks > 1").groupBy("scope", "block").cogroup(wanted.groupBy("scope", "block")).applyInPandas(
        lambda held, want: _counted(held, want), "scope string, pattern array<string>, support bigint")
    summed = counted.groupBy("scope", "pattern").agg(F.sum("support").alias("support"))
    found = whole.unionByName(summed)
    if some:
        found = cut(found)
        found = found.unionByName(_looked_up(found, giants, kept, longest)).groupBy("scope", "pattern").agg(F.sum("support").alias("support"))
    return found.join(n, "scope").where(F.col("support") >= need - 1e-9).select(F.col("scope").alias(scope), "pattern", "support", "n")


def _looked_up(patterns: DataFrame, giants: DataFrame, events: DataFrame, longest: int) -> DataFrame:
    """(scope, pattern, support) of patterns in the given sequences: the earliest place of each prefix, a step at a time.

    Prefixes shared by patterns are looked up once, and only in sequences that hold the
    prefix before; a step is a running minimum over the events of one item, latest first.
    """
    ev = cut(events.join(giants, ["scope", "seq"], "left_semi"))
    firsts = ev.groupBy("scope", "seq", "item").agg(F.min("t").alias("at"))
    prefix = lambda k: patterns.where(F.size("pattern") >= k).select("scope", F.slice("pattern", 1, k).alias("prefix")).distinct()
    at = prefix(1).withColumn("item", F.col("prefix")[0]).join(firsts, ["scope", "item"]).select("scope", "seq", "prefix", "at")
    out = []
    later = Window.partitionBy("scope", "seq", "item").orderBy(F.expr("-t")).rangeBetween(Window.unboundedPreceding, -1)
    for k in range(1, longest + 1):
        held = at.groupBy("scope", F.col("prefix").alias("pattern")).agg(F.count(F.lit(1)).alias("support"))
        out.append(held.join(patterns.where(F.size("pattern") == k).select("scope", "pattern").distinct(), ["scope", "pattern"], "left_semi"))
        if k < longest:
            longer = prefix(k + 1).select("scope", F.col("prefix").alias("longer"), F.slice("prefix", 1, k).alias("prefix"), F.get("prefix", F.lit(k)).alias("item"))
            asks = at.join(longer, ["scope", "prefix"]).select("scope", "seq", "item", F.col("at").alias("t"), F.col("longer").alias("prefix"), F.lit(None).cast("bigint").alias("e"))
            both = asks.unionByName(ev.select("scope", "seq", "item", "t", F.lit(None).cast("array<string>").alias("prefix"), F.col("t").alias("e")))
            at = both.withColumn("at", F.min("e").over(later)).where("prefix is not null and at is not null").select("scope", "seq", "prefix", "at")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
