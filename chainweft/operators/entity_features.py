"""Per-entity feature table: one wide row per entity, with figures over all its events and for each event type.

Events are combined by entity and type inside each map task, so that a busy entity sends one state per type and
task; the states are bucketed by entity and sorted by entity and type. Each bucket is then streamed once in that order:
a run of equal (entity, type) is folded into counters, totals and first and last times, and where the entity changes its
wide row is emitted, without another shuffle. No more than a block of states and the folded states of the entity at its
end are in memory, and those are as many as the entity has types.

Defined cases: null or empty entities have no row. A null type is the type null and is not in the map; null times
leave first and last as they are, null values add nothing. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainweft.operators.decimals import decimals, limbs

#: Rows folded together in a map task before their states are passed on.
COMBINE_ROWS = 1 << 18
#: States of a bucket that are folded at once.
MERGE_ROWS = 1 << 17

STATE = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.DecimalType(38, 0)),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
    ]
)
FIGURES = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DecimalType(38, 0)), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
WIDE = T.StructType([T.StructField("entity", T.StringType()), *FIGURES.fields, T.StructField("types", T.MapType(T.StringType(), FIGURES))])
MERGE = [("n", "sum"), ("total", "sum"), ("first", "min"), ("last", "max")]


def _fold(table: pa.Table) -> pa.Table:
    grouped = table.group_by(["entity", "type"]).aggregate(MERGE)
    columns = [grouped["entity"], grouped["type"], *(grouped[f"{c}_{how}"] for c, how in MERGE)]
    return pa.table(columns, names=["entity", "type", *(c for c, _ in MERGE)])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds rows into states; the states stay in memory as long as folding keeps them few."""
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= COMBINE_ROWS:
            folded = _fold(pa.concat_tables(held))
            if folded.num_rows > COMBINE_ROWS // 4:
                yield from folded.combine_chunks().to_batches()
                held, count = [], 0
            else:
                held, count = [folded], folded.num_rows
    if count:
        yield from _fold(pa.concat_tables(held)).combine_chunks().to_batches()


def _starts(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal values begin in sorted columns; null equals null."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        differs = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy()
        missing = c.is_null().to_numpy()
        change[1:] |= differs | (missing[1:] != missing[:-1])
    return np.flatnonzero(change)


def _reduced(table: pa.Table, starts: np.ndarray) -> dict[str, pa.Array]:
    """The merged states of the runs that begin at ``starts``; a figure is null if it is null in all of a run."""
    out = {"n": pa.array(np.add.reduceat(table["n"].to_numpy(), starts))}
    total = table["total"].combine_chunks()
    known = np.logical_or.reduceat(total.is_valid().to_numpy(zero_copy_only=False), starts)
    out["total"] = decimals(np.add.reduceat(limbs(total), starts, axis=0), known)
    for name, fold, rest in (("first", np.minimum, np.iinfo(np.int64).max), ("last", np.maximum, np.iinfo(np.int64).min)):
        known = np.logical_or.reduceat(table[name].is_valid().to_numpy(), starts)
        out[name] = pa.array(fold.reduceat(table[name].fill_null(rest).to_numpy(), starts), mask=~known)
    return out


def _merged_runs(table: pa.Table) -> pa.Table:
    """One state for each run of equal entity and type."""
    starts = _starts(table["entity"], table["type"])
    keys = table.select(["entity", "type"]).take(pa.array(starts))
    return pa.table({"entity": keys["entity"], "type": keys["type"], **_reduced(table, starts)})


def _wide(states: pa.Table) -> pa.RecordBatch:
    """Wide rows of whole entities from merged states."""
    starts = _starts(states["entity"])
    named = states["type"].is_valid().to_numpy()
    counts = np.add.reduceat(named.astype(np.int32), starts)
    kept = states.filter(pa.array(named)).combine_chunks()
    column = lambda c: kept[c].combine_chunks() if kept.num_rows else pa.array([], kept.schema.field(c).type)
    names = ["n", "total", "first", "last"]
    figures = pa.StructArray.from_arrays([column(c) for c in names], names)
    types = pa.MapArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), column("type"), figures)
    entity = states["entity"].take(pa.array(starts)).combine_chunks()
    return pa.record_batch({"entity": entity, **_reduced(states, starts), "types": types})


def _stream_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams states sorted by entity and type into wide rows; the entity at the end of a block waits for the next one."""
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= MERGE_ROWS:
            merged = _merged_runs(pa.concat_tables(held))
            cut = int(_starts(merged["entity"])[-1])
            if cut:
                yield _wide(merged.slice(0, cut))
            held = [merged.slice(cut)]
            count = held[0].num_rows
    if count:
        yield _wide(_merged_runs(pa.concat_tables(held)))


def entity_features(events: DataFrame) -> DataFrame:
    """Wide rows from events (entity string, type string, time long, value decimal(38,0)).

    Returns (entity, n, total, first, last, types): the first figures over everything, ``types`` a map from event
    type to the same figures.
    """
    lone = events.where(F.length("entity") > 0).select(
        "entity", "type", F.lit(1).cast("long").alias("n"), F.col("value").cast(T.DecimalType(38, 0)).alias("total"), F.col("time").cast("long").alias("first"), F.col("time").cast("long").alias("last")
    )
    runs = lone.mapInArrow(_combine, STATE).repartition("entity").sortWithinPartitions("entity", "type")
    return runs.mapInArrow(_stream_runs, WIDE)
