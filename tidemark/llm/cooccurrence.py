"""Items that appear together: stripes of co-occurring neighbours, merged by key, with a log-likelihood ratio.

Plan. Items that can be in no result are dropped first: an item in fewer than
``min_count`` baskets, or (n_ab <= min(n_a, n_b)) in more than n / min_lift of its
scope's n baskets. So the hottest items never enter a pair. Baskets are dealt out in
units of at most about ``chunk`` items on either side: a larger basket is cut by a hash
of its items into chunks, and every two chunks are a unit, so no task holds a basket.
Each task turns its units into stripes (item -> neighbours with counts), merging
``PAIRS_HELD`` pairs at a time in memory; a stripe is sent in parts by a hash of the
neighbour, so no key's stripe has to be held whole; parts are merged after one shuffle
on (item, part).

Of the baskets larger than a chunk the ``min_count - 1`` largest of a scope make no
stripes: a pair needs a further basket, so it is in the stripes of the others, and is
then counted in these few by two equi-joins. A single basket with a large part of all
rows therefore costs no more than its rows and the pairs others have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, ship

#: Pairs and item places that a task turns into stripes at a time.
PAIRS_HELD, PLACES_HELD = 2_000_000, 1_000_000
PARTS = 8
#: Where a chi-squared variable with one degree of freedom lies with a chance of 1 in 1000.
SIGNIFICANT = 10.828


def _pairs(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) to pair, at most about ``most`` at a time.

    left and right are the numbers of places of both sides of each unit in the flattened
    places (all left sides, then all right sides). A unit without a right side pairs
    each place with the later ones of its left side.
    """
    n_left = int(left.sum())
    start = np.r_[0, np.cumsum(left)[:-1]]
    unit = np.repeat(np.arange(len(left)), left)
    own = right[unit] == 0
    place = np.arange(n_left)
    first = np.where(own, place + 1, n_left + np.r_[0, np.cumsum(right)[:-1]][unit])
    n = np.where(own, (start + left)[unit] - place - 1, right[unit])
    ends = np.cumsum(n)
    lo = 0
    while lo < n_left:
        done = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, side="right")))
        part = n[lo:hi]
        total = int(part.sum())
        if total:
            before = np.r_[0, np.cumsum(part)[:-1]]
            yield np.repeat(place[lo:hi], part), np.arange(total) + np.repeat(first[lo:hi] - before, part)
        lo = hi


def _encode(scopes: pa.Array, units: pa.Array, others: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Places as codes of (scope, item) in the order of scope and item; each code's scope, its item's code; the items."""
    scopes = scopes.dictionary_encode()
    names = pa.concat_arrays([units.flatten(), others.flatten()]).dictionary_encode()
    words = names.dictionary
    by_bytes = pc.sort_indices(words.cast(pa.binary())).to_numpy()
    rank = np.empty(len(words), np.int64)
    rank[by_bytes] = np.arange(len(words))
    item = rank[names.indices.to_numpy()]
    sizes = np.r_[np.diff(units.offsets.to_numpy()), np.diff(others.offsets.to_numpy())]
    scope = np.repeat(np.tile(scopes.indices.to_numpy(), 2), sizes).astype(np.int64)
    # both factors are below the places held, so their product is far from the end of int64
    codes, place = np.unique(scope * max(1, len(words)) + item, return_inverse=True)
    return place, scopes.dictionary, codes // max(1, len(words)), codes % max(1, len(words)), words.take(pa.array(by_bytes))


def _stripe_batches(a: np.ndarray, b: np.ndarray, n: np.ndarray, scopes: pa.Array, scope_of: np.ndarray, item_of: np.ndarray, words: pa.Array) -> Iterator[pa.RecordBatch]:
    """Counted pairs of codes, sorted by both, as parts of stripes."""
    part_of = (pd.util.hash_array(np.asarray(words.to_pylist(), object), categorize=False) % PARTS).astype(np.int64)[item_of]
    part = part_of[b]
    order = np.lexsort((b, part, a))
    a, b, n, part = a[order], b[order], n[order], part[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])]
    first = np.r_[np.flatnonzero(new), len(a)]
    for at in range(0, len(first) - 1, 4096):
        edge = first[at : at + 4097]
        inside = slice(edge[0], edge[-1])
        offsets = pa.array((edge - edge[0]).astype(np.int32))
        key = edge[:-1]
        yield pa.RecordBatch.from_arrays(
            [
                scopes.take(pa.array(scope_of[a[key]])), words.take(pa.array(item_of[a[key]])), pa.array(part[key].astype(np.int32)),
                pa.ListArray.from_arrays(offsets, words.take(pa.array(item_of[b[inside]]))), pa.ListArray.from_arrays(offsets, pa.array(n[inside])),
            ],
            names=["scope", "item", "part", "neighbours", "counts"],
        )


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of units (scope, items, other items or none) to parts of stripes.

    Units are taken PLACES_HELD places at a time and their pairs PAIRS_HELD at a time;
    pairs are merged over all units taken at a time as long as few enough differ.
    """

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [pa.concat_arrays([h.column(i) for h in held]) for i in range(3)]
        place, scopes, scope_of, item_of, words = _encode(*columns)
        m = len(scope_of)
        left, right = (np.diff(columns[i].offsets.to_numpy()).astype(np.int64) for i in (1, 2))
        codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            if len(codes):
                yield from _stripe_batches(codes // m, codes % m, sums, scopes, scope_of, item_of, words)

        for i, j in _pairs(left, right, PAIRS_HELD):
            a, b = place[i], place[j]
            new, n = np.unique(np.minimum(a, b) * m + np.maximum(a, b), return_counts=True)
            both, at = np.unique(np.r_[codes, new], return_inverse=True)
            codes, sums = both, np.bincount(at, np.r_[sums, n], len(both)).astype(np.int64)
            if len(codes) > PAIRS_HELD:
                yield from out()
                codes, sums = codes[:0], sums[:0]
        yield from out()

    held, due = [], 0
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64) + np.diff(batch.column(2).offsets.to_numpy())
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            done = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + PLACES_HELD - due, side="right")))
            held.append(batch.slice(lo, hi - lo))
            due += int(ends[hi - 1]) - done
            lo = hi
            if due >= PLACES_HELD:
                yield from flush(held)
                held, due = [], 0
    if held:
        yield from flush(held)


def cooccurrence(rows: DataFrame, scope: str, basket: str, item: str, min_count: int = 1, min_lift: float = 0.0, min_llr: float = 0.0, chunk: int = 1024) -> DataFrame:
    """(scope, item_a, item_b, n, n_a, n_b, n_ab, lift, llr) with item_a < item_b (by bytes).

    n baskets in the scope; n_a, n_b, n_ab of them hold a, b, both; an item counts once
    per basket. lift = n_ab n / (n_a n_b); llr is the log-likelihood ratio (G squared,
    rounded to 6 places) of the pair against independence. Only pairs with
    n_ab >= min_count, lift >= min_lift and llr >= min_llr (``SIGNIFICANT`` is the bound
    for a chance of 1 in 1000); the defaults keep all that occur. Rows with
    a null scope, basket or item are left out (they make no basket); empty strings are
    ordinary items. Repeated rows change nothing. No rows, no pairs.
    """
    ship(rows.sparkSession)
    r = rows.select(F.col(scope).alias("scope"), F.col(basket).alias("basket"), F.col(item).alias("item")).where(
        "scope is not null and basket is not null and item is not null").distinct()
    n = r.groupBy("scope").agg(F.count_distinct("basket").alias("n"))
    counts = r.groupBy("scope", "item").agg(F.count(F.lit(1)).alias("n_item"))
    kept = cut(counts.join(n, "scope").where((F.col("n_item") >= min_count) & (F.col("n_item") * min_lift <= F.col("n"))))
    held = cut(r.join(kept.select("scope", "item"), ["scope", "item"], "left_semi"))
    merged = _merged(held, min_count, chunk)
    pairs = merged.where(F.col("n_ab") >= min_count).select("scope", F.col("item").alias("item_a"), F.col("other").alias("item_b"), "n_ab")
    side = lambda c, name, *more: kept.select("scope", F.col("item").alias(c), F.col("n_item").alias(name), *more)
    pairs = pairs.join(side("item_a", "n_a", "n"), ["scope", "item_a"]).join(side("item_b", "n_b"), ["scope", "item_b"])
    pairs = pairs.where(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    out = pairs.select(
        F.col("scope").alias(scope), "item_a", "item_b", "n", "n_a", "n_b", "n_ab",
        (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"), F.round(_llr(), 6).alias("llr"))
    return out.where(F.col("llr") >= min_llr) if min_llr > 0 else out


def _merged(rows: DataFrame, min_count: int, chunk: int) -> DataFrame:
    """(scope, item, other, n_ab) of distinct rows (scope, basket, item): every pair that can have min_count baskets, by stripes."""
    none = F.array().cast("array<string>")
    large = cut(rows.groupBy("scope", "basket").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > chunk))  # at most rows / chunk baskets
    if large.isEmpty():
        return _counted(rows.groupBy("scope", "basket").agg(F.collect_list("item").alias("items")).where(F.size("items") > 1).select("scope", "items", none.alias("others")))
    first = Window.partitionBy("scope").orderBy(F.desc("k"), "basket")
    back = cut(large.withColumn("_k", F.row_number().over(first)).where(F.col("_k") < min_count).drop("_k"))  # fewer than min_count a scope
    chunks = F.ceil(F.col("k") / chunk).cast("int")
    dealt = rows.join(large, ["scope", "basket"], "left").join(back.select("scope", "basket"), ["scope", "basket"], "left_anti").withColumn("m", F.coalesce(chunks, F.lit(1))).withColumn(
        "c", F.pmod(F.xxhash64("item"), F.col("m")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o")).withColumn("lo", F.least("c", "o")).withColumn("hi", F.greatest("c", "o"))
    units = dealt.groupBy("scope", "basket", "lo", "hi").agg(
        F.collect_list(F.when(F.col("c") == F.col("lo"), F.col("item"))).alias("items"), F.collect_list(F.when(F.col("c") != F.col("lo"), F.col("item"))).alias("others"))
    # two chunks are a unit of their own pairs only if both have items
    stripes = cut(_counted(units.where((F.col("lo") == F.col("hi")) & (F.size("items") > 1) | (F.size("items") > 0) & (F.size("others") > 0)).select("scope", "items", "others")))
    h = back.groupBy("scope").agg(F.count(F.lit(1)).alias("h"))
    asked = stripes.join(h, "scope").where(F.col("n_ab") >= min_count - F.col("h"))
    members = rows.join(back.select("scope", "basket"), ["scope", "basket"], "left_semi")
    key = ["scope", "item", "other"]
    more = asked.select(*key).join(members, ["scope", "item"]).join(members.withColumnRenamed("item", "other"), ["scope", "basket", "other"]).groupBy(*key).agg(F.count(F.lit(1)).alias("n_ab"))
    return stripes.unionByName(more).groupBy(*key).agg(F.sum("n_ab").alias("n_ab"))


def _counted(units: DataFrame) -> DataFrame:
    """(scope, item, other, n_ab) of units (scope, items, others)."""
    parts = units.mapInArrow(_stripes, "scope string, item string, part int, neighbours array<string>, counts array<bigint>")
    return parts.repartition("scope", "item", "part").select(
        "scope", "item", "part", F.explode(F.arrays_zip("neighbours", "counts")).alias("x")).groupBy("scope", "item", "part", F.col("x.neighbours").alias("other")).agg(F.sum("x.counts").alias("n_ab")).drop("part")


def _llr():
    """2 sum k ln(k n / (row column)) over the four cells."""
    n, a, b, k = F.col("n").cast("double"), F.col("n_a"), F.col("n_b"), F.col("n_ab")
    cell = lambda k, r, c: F.when(k > 0, k * F.ln(k * n / (r * c))).otherwise(F.lit(0.0))
    return 2 * (cell(k, a, b) + cell(a - k, a, n - b) + cell(b - k, n - a, b) + cell(n - a - b + k, n - a, n - b))
