"""Structured Streaming forms: velocity on arrival, distinct messages, windows, latest state, score drift, rate limits.

State is kept by key in the state store and let go by a timeout: senders' windows and a key's accepted calls by event
time, an identifier by its watermark, the last scores of a key by the time it is idle; the latest state of a key is the
one that stays. Each has a batch twin that it equals when all rows have arrived and none came later than its delay;
rows that come later than that are dropped where event time lets state go.

Defined cases: rows without key are left out; rows within a micro-batch are put in order of arrival by key first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chainweft.functions.identity import hex_text
from chainweft.operators.velocity import ArrivalHistory
from chainweft.session import WrittenTables
from chainweft.sources.messages import from_messages


def stream_of(spark: SparkSession, folder: str, name: str, order: str, parts: int = 3, files: int = 1) -> DataFrame:
    """A table's files as a stream; ``files`` in each micro-batch.

    A folder of at least ``parts`` files, whose order is that of their times, is streamed as it is. A smaller table is
    first cut into ``parts`` files by ``order``, so that it takes several micro-batches.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    path = f"{folder}/{name}.parquet"
    if len(table._jdf.inputFiles()) < parts:
        path = f"{WrittenTables(spark, 'parts').root}/{name}"
        low, high = table.agg(F.min(order).cast("double"), F.max(order).cast("double")).first()
        place = F.coalesce(F.least(F.lit(parts - 1), F.floor((F.col(order).cast("double") - (low or 0.0)) / max((high or 0.0) - (low or 0.0), 1e-9) * parts)), F.lit(0))
        for k in range(parts):  # one after the other, so that their times are in order
            table.where(place == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(path)


def run_to_end(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Runs a query over what is there now, batch by batch into written tables, and returns its result table.

    In ``complete`` mode that is the last batch's output, in ``update`` mode the latest row of each of ``keys``, in
    ``append`` mode the rows of all batches. State has no more than ``partitions`` partitions: each is a task, a version of
    its store and a file of output in every micro-batch, however few rows that has.
    """
    spark = stream.sparkSession
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of its rows")
    tables = WrittenTables(spark, "stream")
    out = f"{tables.root}/out"
    written: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        written.append(number)

    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # a query has its own copy of the settings once it has started
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(usual), partitions or int(usual))))
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{tables.root}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    query.awaitTermination()
    batches = sorted(set(written))
    if not batches:
        return spark.createDataFrame([], stream.schema)
    read = lambda n: spark.read.schema(stream.schema).parquet(f"{out}/{n}")
    if mode == "complete":
        return read(batches[-1])
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(*(f"{out}/{n}" for n in batches))
    every = reduce(DataFrame.unionByName, (read(n).withColumn("__batch", F.lit(n)) for n in batches))
    newest = every.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "__batch").alias("__row"))
    return newest.select("__row.*")


def _expire(state: GroupState, at_s: float) -> None:
    """Lets state go once the watermark passes a time."""
    state.setTimeoutTimestamp(max(int(at_s * 1000), state.getCurrentWatermarkMs() + 1))


def _packed(held: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as out:
        out.write_table(held)
    return sink.getvalue().to_pybytes()


def velocity(stream: DataFrame, window_s: int = 3600, delay: str = "30 days", buckets: int = 256) -> DataFrame:
    """(seq, tx_count, value_sum, since_last) for rows (seq, sender, block_timestamp, value_eth), as known on arrival.

    A row is let go when the watermark, ``delay`` behind the latest time, has passed it by the window: no row that isn't
    later than that could see it. Null values count as 0.

    Senders share ``buckets`` groups, since a group costs Python milliseconds in each micro-batch, a row microseconds. A
    bucket's state is written anew when it gets rows, so a micro-batch writes up to all rows that are held. Values are
    held as doubles, which their billionths, rounded from doubles, are without loss.
    """
    kinds = pa.schema([("sender", pa.string()), ("time", pa.float64()), ("value", pa.float64())])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(frames).sort_values("seq")
        held = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else kinds.empty_table()
        here = pc.is_in(held["sender"], value_set=pa.array(rows["sender"].unique(), pa.string()))
        before: dict[str, tuple[list[float], list[int]]] = {}
        for s, t, v in zip(*(c.to_pylist() for c in held.filter(here).columns)):
            times, values = before.setdefault(s, ([], []))
            times.append(t), values.append(int(v))
        histories: dict[str, ArrivalHistory] = {}
        out = []
        for o, s, t, v in zip(*(rows[c].tolist() for c in ("seq", "sender", "t", "v"))):
            if s not in histories:
                histories[s] = ArrivalHistory(window_s, *before.get(s, ()))
            out.append((o, *histories[s].add(t, v)))
        kept = [(s, t, float(v)) for s, history in histories.items() for t, v in zip(*history.held())]
        held = pa.concat_tables([held.filter(pc.invert(here)), pa.table(list(map(list, zip(*kept))), schema=kinds)])
        # only now, as rows of this micro-batch may still be as late as the watermark before
        held = held.filter(pc.greater_equal(held["time"], state.getCurrentWatermarkMs() / 1000 - window_s))
        if len(held):
            state.update((_packed(held),))
            _expire(state, pc.max(held["time"]).as_py() + window_s)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["seq", "tx_count", "value_sum", "since_last"])

    known = stream.where((F.length("sender") > 0) & F.col("block_timestamp").isNotNull())
    slim = known.select("seq", "sender", F.col("block_timestamp").cast("double").alias("t"), F.coalesce(F.col("value_eth").cast("double"), F.lit(0.0)).alias("v"), F.timestamp_seconds("block_timestamp").alias("at"), F.pmod(F.hash("sender"), F.lit(buckets)).alias("bucket"))
    timed = slim.withWatermark("at", delay)
    return timed.groupBy("bucket").applyInPandasWithState(step, "seq long, tx_count long, value_sum double, since_last double", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_messages(stream: DataFrame, id_col: str, time_col: str, delay: str = "7 days") -> DataFrame:
    """The first arrival of each identifier; repeats are known for as long as the watermark is behind."""
    named = stream.where(F.col(id_col).isNotNull()).withColumn("__id", hex_text(F.col(id_col)))
    return named.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["__id"]).drop("__id")


def windowed_counts(stream: DataFrame, time_col: str, key: str, length: str, delay: str, slide: str | None = None) -> DataFrame:
    """(key, start, n) by tumbling or sliding windows."""
    window = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    return stream.withWatermark(time_col, delay).groupBy(key, window).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, time_col: str, key: str, gap: str, delay: str) -> DataFrame:
    """(key, start, end, n) of each run of rows with no longer gap."""
    grouped = stream.withWatermark(time_col, delay).groupBy(key, F.session_window(time_col, gap))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_state(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, updates): the latest value of each key and how often it was replaced, updated as rows arrive."""
    return stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value), (F.count(F.lit(1)) - 1).alias("updates"))


def last_scores(stream: DataFrame, key: str, order: str, score: str, time: str, most: int = 500, idle_s: int = 30 * 86400, delay: str = "1 day") -> DataFrame:
    """(key, upto, scores): the newest scores of each key as of each micro-batch; run it in ``update`` mode.

    ``time`` is a timestamp; a key without a row for ``idle_s`` seconds of the watermark, ``delay`` behind, begins anew.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*state.get)) if state.exists else []
        rows = pd.concat(frames)
        held = sorted(held + list(rows[["o", "x"]].itertuples(index=False, name=None)))[-most:]
        state.update(([o for o, _ in held], [s for _, s in held]))
        _expire(state, rows["at"].max().timestamp() + idle_s)
        yield pd.DataFrame([(name[0], held[-1][0], [s for _, s in held])], columns=[key, "upto", "scores"])

    known = _scores(stream, key, order, score, time).withWatermark("at", delay)
    return known.groupBy(key).applyInPandasWithState(step, f"{key} string, upto long, scores array<double>", "orders array<long>, scores array<double>", "update", GroupStateTimeout.EventTimeTimeout)


def _scores(stream: DataFrame, key: str, order: str, score: str, time: str) -> DataFrame:
    known = stream.where(F.col(key).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score) & F.col(time).isNotNull())
    return known.select(key, F.col(order).cast("long").alias("o"), F.col(score).cast("double").alias("x"), F.col(time).cast("timestamp").alias("at"))


def score_drift(stream: DataFrame, key: str, order: str, score: str, time: str, baseline: list[float], most: int = 500, least: int = 100, every: int = 50, idle_s: int = 30 * 86400, delay: str = "1 day") -> DataFrame:
    """(key, upto, n, psi): the stability index of the newest ``most`` scores after every ``every``-th score of a key.

    None before ``least`` scores were seen. ``baseline`` holds the shares of ten equal bins of [0, 1]; the last bin is
    closed, scores outside count nowhere, and no share counts less than a millionth. Keys begin anew as in ``last_scores``.
    """
    shares = [max(b, 1e-6) for b in baseline]

    def psi(scores: list[float]) -> float:
        counts = np.histogram(scores, bins=10, range=(0.0, 1.0))[0] / len(scores)
        return float(sum((max(x, 1e-6) - b) * np.log(max(x, 1e-6) / b) for x, b in zip(counts, shares)))

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = []
        rows = pd.concat(frames)
        for o, x in rows[["o", "x"]].sort_values("o").itertuples(index=False):
            seen += 1
            held = [*held[-(most - 1) :], float(x)]
            if seen % every == 0 and len(held) >= least:
                out.append((name[0], o, len(held), psi(held)))
        state.update((seen, held))
        _expire(state, rows["at"].max().timestamp() + idle_s)
        yield pd.DataFrame(out, columns=[key, "upto", "n", "psi"])

    known = _scores(stream, key, order, score, time).withWatermark("at", delay)
    return known.groupBy(key).applyInPandasWithState(step, f"{key} string, upto long, n int, psi double", "seen long, scores array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(stream: DataFrame, key: str, time: str, order: str, limit: int, window_s: int, delay: str = "1 day") -> DataFrame:
    """(order, allowed): a call passes if fewer than ``limit`` calls of its key passed within the window before it.

    A key's state goes when the watermark, ``delay`` behind the latest call, has passed its last call by the window.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(frames).sort_values("o").itertuples():
            passed = [t for t in passed if t > r.t - window_s]
            out.append((r.o, len(passed) < limit))
            if len(passed) < limit:
                passed.append(r.t)
        state.update((passed,))
        _expire(state, (max(passed) if passed else 0.0) + window_s)
        yield pd.DataFrame(out, columns=["o", "allowed"])

    known = stream.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(time).cast("double").alias("t"), F.col(order).cast("long").alias("o"), F.timestamp_millis((F.col(time).cast("double") * 1000).cast("long")).alias("at"))
    return known.withWatermark("at", delay).groupBy("k").applyInPandasWithState(step, "o long, allowed boolean", "passed array<double>", "append", GroupStateTimeout.EventTimeTimeout).withColumnRenamed("o", order)


def consume(messages: DataFrame, handle: Callable[[DataFrame], None], corrupt: Callable[[DataFrame], None], checkpoint: str, value: str = "value") -> StreamingQuery:
    """Hands parsed messages to a handler batch by batch, at least once, and unreadable ones to ``corrupt``.

    A batch is committed to the checkpoint only after both have returned, so a failing handler gets it again.
    """

    def step(batch: DataFrame, _: int) -> None:
        good, bad = from_messages(batch, value)
        corrupt(bad)
        handle(good)

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()


def from_kafka(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """The messages of topics (key, value) from the earliest on; needs the connector, which isn't part of Spark itself."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    return stream.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
