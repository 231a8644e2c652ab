"""One wide row per entity from a log of typed events.

Plan. Redelivered events are reduced to one in a shuffle on their id. Counts,
totals and latest times are then summed per entity and type, map side first, so
a hot entity sends at most one row per type and task. The sums (at most one row
per type for an entity) are bucketed and sorted by entity and type; a streaming
pass turns each run into one wide row, with no shuffle after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import ship

MOST_KINDS = 4096


def column_names(kinds: list[str]) -> list[str]:
    """A column prefix per kind: other signs than letters and digits become _; repeats get a number."""
    out: list[str] = []
    for kind in kinds:
        base = re.sub(r"[^0-9a-z]+", "_", kind.lower()).strip("_") or "kind"
        name, i = base, 2
        while name in out:
            name, i = f"{base}_{i}", i + 1
        out.append(name)
    return out


def _stream(batches: Iterator[pa.RecordBatch], n_keys: int, n_kinds: int, schema: pa.Schema, rows_out: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key..., kind, count, last, since, churn) runs to wide rows."""
    held: list[pa.RecordBatch] = []

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [table.column(i).combine_chunks() for i in range(n_keys)]
        change = np.zeros(len(table), bool)
        change[:1] = True
        for k in keys:
            code = k.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= code[1:] != code[:-1]
        entity = np.cumsum(change) - 1
        first = np.flatnonzero(change)
        kind = table.column(n_keys).to_numpy()
        values = [np.asarray(table.column(n_keys + 1 + j).cast(pa.int64()).fill_null(0)) for j in range(4)]
        there = [table.column(n_keys + 1 + j).is_valid().to_numpy() for j in range(4)]
        for lo in range(0, len(first), rows_out):
            hi = min(lo + rows_out, len(first))
            a, b = first[lo], first[hi] if hi < len(first) else len(table)
            row, k = entity[a:b] - lo, kind[a:b]
            ok = k >= 0
            columns = []
            for j in range(4):
                filled = np.zeros((n_kinds, hi - lo), np.int64)
                filled[k[ok], row[ok]] = values[j][a:b][ok]
                if j in (1, 2):
                    empty = np.ones((n_kinds, hi - lo), bool)
                    empty[k[ok], row[ok]] = ~there[j][a:b][ok]
                    columns.append([pa.array(filled[i], mask=empty[i]) for i in range(n_kinds)])
                else:
                    columns.append([pa.array(filled[i]) for i in range(n_kinds)])
            at = pa.array(first[lo:hi])
            arrays = [k.take(at) for k in keys]
            for i in range(n_kinds):
                arrays += [columns[j][i].cast(schema.field(n_keys + 4 * i + j).type) for j in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 32 * n_kinds:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(i)[-1].as_py() for i in range(n_keys)]
        end = len(table) - 1
        while end > 0 and [table.column(i)[end - 1].as_py() for i in range(n_keys)] == last:
            end -= 1
        if end:
            yield from emit(table.slice(0, end))
            held = table.slice(end).to_batches()
    if held:
        yield from emit(pa.Table.from_batches(held))


def wide_features(
    events: DataFrame,
    kinds: DataFrame,
    entity: list[str],
    event_id: str = "activity_id",
    event_kind: str = "event_kind",
    happened: str = "happened_at",
    received: str = "received_at",
    amount: str = "churn",
    kind: str = "kind",
    order: str = "kind_id",
    as_of=None,
    rows_out: int = 512,
) -> DataFrame:
    """entity columns, then for each kind ``<kind>_count`` (0 if none), ``<kind>_last_at``,
    ``<kind>_secs_since`` (whole seconds from last_at to as_of; both null if no time is
    known) and ``<kind>_churn`` (0 if none).

    Kinds are matched trimmed and without case; events of other or null kinds give
    their entity a row but count for no kind. An event id counts once, as its row
    received first (null times last); among rows received at once the smallest values
    count. Rows with a null id count each for themselves. Null and negative amounts add nothing. Null entity
    values group together. ``as_of`` is a timestamp literal, by default the largest
    received time (or, without any, happened time) of the table. The kinds table is a
    dimension of at most 4096 rows, repeated and null kinds are dropped; an empty
    table of events gives no rows.
    """
    spark = events.sparkSession
    ship(spark)
    listed = kinds.where(F.col(kind).isNotNull()).select(F.lower(F.trim(kind)).alias("_kind"), F.col(order).alias("_order"))
    rows = listed.groupBy("_kind").agg(F.min("_order").alias("_order")).limit(MOST_KINDS + 1).collect()
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds")
    names = [r["_kind"] for r in sorted(rows, key=lambda r: (r["_order"] is None, r["_order"], r["_kind"]))]
    prefixes = column_names(names)
    if as_of is None:
        top = events.agg(F.coalesce(F.max(received), F.max(happened)).alias("t")).collect()[0]["t"]
        as_of = F.lit(top).cast("timestamp") if top is not None else F.lit(None).cast("timestamp")
    keys = [f"_e{i}" for i in range(len(entity))]
    lookup = spark.createDataFrame([(n, i) for i, n in enumerate(names)] or [("", -1)], "_kind string, _k int")
    e = events.select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys)], F.col(event_id).alias("_id"), F.lower(F.trim(F.col(event_kind))).alias("_kind"),
        F.unix_micros(happened).alias("_at"), F.unix_micros(received).alias("_got"), F.col(amount).cast("bigint").alias("_amount"),
    ).join(F.broadcast(lookup), "_kind", "left").withColumn("_k", F.coalesce("_k", F.lit(-1)))
    none = 2**62
    chosen = F.min(F.struct(F.coalesce("_got", F.lit(none)).alias("g"), F.col("_k").alias("k"), F.col("_at").alias("a"), F.col("_amount").alias("m"), *[F.col(k) for k in keys])).alias("_s")
    once = e.where("_id is not null").groupBy("_id").agg(chosen).select(*[f"_s.{k}" for k in keys], F.col("_s.k").alias("_k"), F.col("_s.a").alias("_at"), F.col("_s.m").alias("_amount"))
    once = once.unionByName(e.where("_id is null").select(*keys, "_k", "_at", "_amount"))
    sums = once.groupBy(*keys, "_k").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last"), F.sum(F.when(F.col("_amount") >= 0, F.col("_amount"))).alias("_total"))
    since = F.floor((F.unix_micros(as_of) - F.col("_last")) / F.lit(1_000_000)).cast("bigint")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = sums.select(*keys, "_k", "_n", "_last", since.alias("_since"), "_total").repartition(n, *keys).sortWithinPartitions(*keys, "_k")
    types = {f.name: f.dataType for f in events.schema.fields}
    fields = [T.StructField(c, types[c]) for c in entity]
    for p in prefixes:
        fields += [T.StructField(f"{p}_count", T.LongType()), T.StructField(f"{p}_last_at", T.TimestampType()), T.StructField(f"{p}_secs_since", T.LongType()), T.StructField(f"{p}_churn", T.LongType())]
    schema, n_keys, n_kinds = T.StructType(fields), len(keys), len(names)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return runs.mapInArrow(lambda it: _stream(it, n_keys, n_kinds, arrow, rows_out), schema)
