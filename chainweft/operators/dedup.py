"""Messages delivered more than once: exact quotient hash tables.

An identifier of 32 bytes, or the 32-byte digest of any other text, is permuted by an invertible mix, so clustered identifiers spread evenly and no two become
equal. Its leading bits, the quotient, choose the shard; the shard's table keeps the complete rest beside the quotient
and compares all of it, so there are no false matches. Each map task first inserts its own rows into such a table:
copies that meet there never reach the shuffle, which keeps an identifier that holds a large share of all rows from
loading one shard. Only one shuffle is needed. Rows of a shard lie together in their partition, so a table is held for a
few whole shards at a time: memory depends on the size of a shard, not on how many of them a task gets.

Defined cases: letter case, outer blanks and a leading ``0x`` of an identifier carry no meaning. Identifiers that
aren't 32 bytes of hexadecimal text are compared by a digest, and rows that meet must have the same text, else the query
fails rather than take two identifiers for one. A null identifier names no message: its rows
repeat nothing and are all kept. Of rows with the same identifier the smallest order value is kept, null coming last;
among equal ones the smallest hash of the carried columns. Empty input gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainweft.functions.identity import fixed_id, hex_text

#: Leading bits of a permuted identifier that name its shard.
QUOTIENT_BITS = 20
#: Rows that a map task gathers before it inserts them into its table and passes the survivors on.
BLOCK_ROWS = 1 << 17
LAST = np.iinfo(np.int64).max

WORDS = ["__w0", "__w1", "__w2", "__w3"]


def _scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, used as the round function of ``permute``."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permute(words: np.ndarray) -> np.ndarray:
    """Permutes identifiers, given as rows of four unsigned 64-bit words; ``unpermute`` is its inverse."""
    out = words.copy()
    for turn in range(2):
        for k in range(4):
            a, b, c = (out[:, (k + j) % 4] for j in (1, 2, 3))
            out[:, k] ^= _scramble(a + _scramble(b + np.uint64(4 * turn + k)) + (c << np.uint64(1)) + (c >> np.uint64(63)))
    return out


def unpermute(words: np.ndarray) -> np.ndarray:
    """Restores identifiers from ``permute``."""
    out = words.copy()
    for turn in (1, 0):
        for k in (3, 2, 1, 0):
            a, b, c = (out[:, (k + j) % 4] for j in (1, 2, 3))
            out[:, k] ^= _scramble(a + _scramble(b + np.uint64(4 * turn + k)) + (c << np.uint64(1)) + (c >> np.uint64(63)))
    return out


class QuotientTable:
    """Open addressing over permuted identifiers; keeps for each the row that comes first."""

    def __init__(self, capacity: int = 1 << 12):
        self.count = 0
        self._allocate(capacity)

    def _allocate(self, capacity: int) -> None:
        self.key = np.zeros((capacity, 4), np.uint64)
        self.used = np.zeros(capacity, bool)
        self.order = np.zeros(capacity, np.int64)
        self.tie = np.zeros(capacity, np.int64)
        self.row = np.zeros(capacity, np.int64)
        self._claim = np.zeros(capacity, np.int64)

    def _reserve(self, more: int) -> None:
        capacity = len(self.used)
        while (self.count + more) > 0.6 * capacity:
            capacity *= 2
        if capacity == len(self.used):
            return
        held = (self.key[self.used], self.order[self.used], self.tie[self.used], self.row[self.used])
        self._allocate(capacity)
        self.count = 0
        self._place(*held)

    def _first(self, slots: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Which of ``rows`` is the first to ask for its slot."""
        self._claim[slots[::-1]] = rows[::-1]
        return self._claim[slots] == rows

    def insert(self, key: np.ndarray, order: np.ndarray, tie: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Inserts rows; returns the ``row`` values, new or held, that turned out to be repeats."""
        if not len(key):
            return row[:0]
        self._reserve(len(key))
        by = np.lexsort((tie, order))
        return self._place(key[by], order[by], tie[by], row[by])

    def _place(self, key: np.ndarray, order: np.ndarray, tie: np.ndarray, row: np.ndarray) -> np.ndarray:
        mask = len(self.used) - 1
        at = (key[:, 1] & np.uint64(mask)).astype(np.int64)
        open_rows = np.arange(len(key))
        lost: list[np.ndarray] = []
        while len(open_rows):
            slots = at[open_rows]
            free = ~self.used[slots]
            asking, wanted = open_rows[free], slots[free]
            if len(asking):
                won = self._first(wanted, asking)
                new, place = asking[won], wanted[won]
                self.used[place] = True
                self.key[place], self.order[place], self.tie[place], self.row[place] = key[new], order[new], tie[new], row[new]
                self.count += len(new)
                settled = np.zeros(len(open_rows), bool)
                settled[np.flatnonzero(free)[won]] = True
                open_rows, slots = open_rows[~settled], slots[~settled]
            same = (self.key[slots] == key[open_rows]).all(axis=1)
            twin, place = open_rows[same], slots[same]
            if len(twin):
                sooner = (order[twin] < self.order[place]) | ((order[twin] == self.order[place]) & (tie[twin] < self.tie[place]))
                lost.append(row[twin[~sooner]])
                twin, place = twin[sooner], place[sooner]
                if len(twin):
                    best = self._first(place, twin)
                    lost += [row[twin[~best]], self.row[place[best]]]
                    twin, place = twin[best], place[best]
                    self.order[place], self.tie[place], self.row[place] = order[twin], tie[twin], row[twin]
            open_rows = open_rows[~same]
            at[open_rows] = (at[open_rows] + 1) & mask
        return np.concatenate(lost) if lost else row[:0]

    def rows(self) -> np.ndarray:
        """The ``row`` values kept."""
        return self.row[self.used]


def _distinct(words: np.ndarray, named: np.ndarray, other: pa.ChunkedArray, order: np.ndarray, tie: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The ``row`` values of rows that repeat an identifier; rows without one repeat nothing."""
    table = QuotientTable()
    lost = table.insert(words[named], order[named], tie[named], row[named])
    if other.null_count < len(other):  # texts behind digests
        text = pc.fill_null(pc.index_in(other, other.unique()), -1).to_numpy()
        by = np.lexsort(words.T)
        same = (words[by[1:]] == words[by[:-1]]).all(axis=1) & named[by[1:]] & named[by[:-1]]
        if (text[by[1:]] != text[by[:-1]])[same].any():
            raise ValueError("two identifiers have the same digest")
    return lost


def _numbers(column: pa.ChunkedArray, null: int = LAST) -> np.ndarray:
    return column.fill_null(null).to_numpy().astype(np.int64, copy=False)


def _id_words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Big-endian words of the fixed-width identifiers, and which rows have one."""
    fixed = column.is_valid().to_numpy()
    words = np.zeros((len(fixed), 4), np.uint64)
    if fixed.any():
        whole = column.drop_null().combine_chunks()
        whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
        start = whole.offset
        offsets = np.frombuffer(whole.buffers()[1], np.int32)[start : start + len(whole) + 1]
        data = np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        words[fixed] = np.ascontiguousarray(data).view(">u8").reshape(-1, 4).astype(np.uint64)
    return words, fixed


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.Table]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def _map_side(want_repeats: bool, carried: list[str]):
    """Sends each block's first rows on to their shards; with ``want_repeats`` also the repeats found here, as done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            words, fixed = _id_words(block["__id"])
            words = permute(words)
            order, tie = _numbers(block["__order"]), _numbers(block["__tie"], 0)
            lost = _distinct(words, fixed, block["__other"], order, tie, np.arange(block.num_rows))
            nameless = ~fixed
            quotient = (words[:, 0] >> np.uint64(64 - QUOTIENT_BITS)).astype(np.int32)
            quotient[nameless] = (order[nameless] & ((1 << QUOTIENT_BITS) - 1)).astype(np.int32)
            keep = np.ones(block.num_rows, bool)
            keep[lost] = False
            done = np.zeros(block.num_rows, bool)
            if want_repeats:
                done[lost] = True
                keep = ~nameless
                quotient[lost] = (order[lost] & ((1 << QUOTIENT_BITS) - 1)).astype(np.int32)
            arrays = [quotient, *(words[:, k].view(np.int64) for k in range(4)), fixed, done]
            table = pa.table(dict(zip(["__quotient", *WORDS, "__fixed", "__done"], map(pa.array, arrays))))
            for name in ["__other", "__order", "__tie", *carried]:
                table = table.append_column(name, block[name])
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _shard_rows(block: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.ChunkedArray, np.ndarray, np.ndarray]:
    words = np.stack([block[w].to_numpy().view(np.uint64) for w in WORDS], axis=1)
    fixed = block["__fixed"].to_numpy()
    return words, fixed, block["__other"], _numbers(block["__order"]), _numbers(block["__tie"], 0)


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Cuts rows in order of quotient into tables of whole shards."""
    rest: pa.Table | None = None
    for block in _blocks(batches):
        table = block if rest is None else pa.concat_tables([rest, block])
        quotient = table["__quotient"].to_numpy()
        cut = int(np.searchsorted(quotient, quotient[-1]))
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def _shard_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Order values of the repeats in each shard."""
    for shards in _whole_shards(batches):
        done = shards["__done"].to_numpy()
        if done.any():
            yield from shards.filter(pa.array(done)).select(["__order"]).combine_chunks().to_batches()
            shards = shards.filter(pa.array(~done))
        words, fixed, other, order, tie = _shard_rows(shards)
        lost = _distinct(words, fixed, other, order, tie, order)
        if len(lost):
            yield pa.record_batch({"__order": pa.array(lost, mask=lost == LAST)})


def _shard_firsts(carried: list[str]):
    """The carried columns of the first rows in each shard; rows without identifier are all kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shards in _whole_shards(batches):
            words, fixed, other, order, tie = _shard_rows(shards)
            keep = np.ones(shards.num_rows, bool)
            keep[_distinct(words, fixed, other, order, tie, np.arange(shards.num_rows))] = False
            yield from shards.select(carried).filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _sharded(df: DataFrame, id_col: str, order_col: str, want_repeats: bool, carried: list[str]) -> DataFrame:
    whole, text = fixed_id(F.col(id_col)), hex_text(F.col(id_col))
    ident = F.coalesce(whole, F.unhex(F.sha2(F.concat(F.lit("text:"), text), 256)))
    tie = F.xxhash64(*carried) if carried else F.lit(0).cast("long")
    slim = df.select(
        ident.alias("__id"),
        F.when(whole.isNull(), text).alias("__other"),
        F.col(order_col).cast("long").alias("__order"),
        tie.alias("__tie"),
        *(F.col(c).alias(f"__c{k}") for k, c in enumerate(carried)),
    )
    names = [f"__c{k}" for k in range(len(carried))]
    long = T.LongType()
    schema = T.StructType(
        [T.StructField("__quotient", T.IntegerType())]
        + [T.StructField(w, long) for w in WORDS]
        + [T.StructField("__fixed", T.BooleanType()), T.StructField("__done", T.BooleanType()), T.StructField("__other", T.StringType())]
        + [T.StructField("__order", long), T.StructField("__tie", long)]
        + [T.StructField(f"__c{k}", df.schema[c].dataType) for k, c in enumerate(carried)]
    )
    return slim.mapInArrow(_map_side(want_repeats, names), schema).repartition("__quotient").sortWithinPartitions("__quotient")


def repeated_messages(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """``order_col`` of every row that repeats an identifier, the row with the smallest order value excepted."""
    rows = _sharded(df, id_col, order_col, True, []).mapInArrow(_shard_repeats, "__order long")
    return rows.select(F.col("__order").alias(order_col))


def first_messages(df: DataFrame, id_col: str, order_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of exactly one row of each identifier, the one with the smallest order value."""
    schema = T.StructType([T.StructField(f"__c{k}", df.schema[c].dataType) for k, c in enumerate(columns)])
    names = [f"__c{k}" for k in range(len(columns))]
    rows = _sharded(df, id_col, order_col, False, columns).mapInArrow(_shard_firsts(names), schema)
    return rows.select(*(F.col(f"__c{k}").alias(c) for k, c in enumerate(columns)))
