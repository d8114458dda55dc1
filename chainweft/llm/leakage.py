"""Evaluation passages that leaked into a corpus: SimHash windows, multi-index Hamming blocks, exact verification.

A document carries an item if it has a long enough run of the item's words, a few of them altered. Windows of several
sizes, ``SIZES`` doubling from five tokens up to the item, are taken from items at every position and from documents at
every tenth of a window, and each gets a SimHash of its tokens, weighted by the part of a word that a token is and by
how few items have it. The fingerprint is cut into ``BLOCKS`` blocks; fingerprints no more than ``RADIUS`` = ``BLOCKS`` - 1
bits apart agree in a whole block, so looking up each block by itself finds all pairs within the radius. The sizes
complete each other: every stretch of ``LEAST_WORDS`` words with at most two altered holds five unaltered words in a row
(13 words in at most three pieces), so a window of the smallest size is met exactly; long passages with small changes
throughout, such as parts of numbers, have no such window, but are near in a larger one.

For each document and item that meet, the document is then compared exactly, over a window as long as the item around
the places found: shingles of ``SHINGLE`` tokens are chained in the order of both texts, and the words they cover are
weighed. Words count as they are part of one (a number is one word); wording that several items share counts nothing.
A case needs ``LEAST_WORDS`` words from the chain's first to its last and ``LEAST_SIMILARITY`` of them covered. Where no
chain has, single words around the places are aligned, so that words beside an altered one count as well: a case needs
``LEAST_WORDS`` words from the first to the last aligned one, altered ones included, and ``LEAST_INTACT`` of them aligned.
An altered word at the very end of a passage can't be told from a shorter passage and doesn't count.

Items are a stated query set. Tasks tokenize them, count how many of them have a word or a run of words, deal them to
blocks of about ``BLOCK_TOKENS`` tokens and build an index for each block, all in tables. One block's index at a time
goes through the driver to all tasks; its pairs are written and its broadcast is destroyed before the next, so what is
held has that bound however many items there are. Documents need no shuffle; if there are several blocks, they are
tokenized once into a written table.

Defined cases: null and empty texts carry nothing and leak nothing. Items with the same words are one text, reported
under each identifier; items shorter than ``LEAST_WORDS`` words can't be found. Repeated documents are each reported.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chainweft.llm.wording import weighted_tokens
from chainweft.operators.spread import spread
from chainweft.session import WrittenTables

LEAST_WORDS = 15
LEAST_SIMILARITY = 0.75
#: Two words in fifteen may be altered.
LEAST_INTACT = 13 / 15
#: Tokens of the smallest window; each further size is twice the one before, up to the longest item.
WINDOW = 5
#: Windows of a document start at every so many parts of their size, those of items at every token.
PARTS = 10
BITS, BLOCKS = 64, 4
RADIUS = BLOCKS - 1
#: Tokens of a shingle in the exact comparison, and the most tokens between chained ones.
SHINGLE, GAP = 3, 8
#: Most tokens from an aligned word to the next: two altered numbers of several parts between them.
STEP = 8
#: Wording is shared if so many tokens in a row occur in several items.
SHARED = 6
#: Tokens of items in one broadcast index on average, about 500 bytes each.
BLOCK_TOKENS = 200_000
#: Document tokens whose windows are held at once.
CHUNK_TOKENS = 1 << 15

BLOCK_BITS = BITS // BLOCKS


def run_marks(words: list[str]) -> list[int]:
    """Hashes of the token runs of length ``SHARED``, by position, as signed numbers."""
    return [xxhash.xxh64_intdigest(" ".join(words[i : i + SHARED])) - (1 << 63) for i in range(len(words) - SHARED + 1)]


class ItemIndex:
    """Windows and exact shingles of a block of items."""

    def __init__(self, items: list[tuple[object, list[str], list[float]]], shared: set[int], common: set[str]):
        #: words that more than a quarter as many items have as have the most frequent one
        self.common = common
        self.texts: list[tuple[list[object], list[str], np.ndarray]] = []
        by_words: dict[tuple, int] = {}
        for ident, words, weights in items:
            if tuple(words) in by_words:
                self.texts[by_words[tuple(words)]][0].append(ident)
                continue
            by_words[tuple(words)] = len(self.texts)
            own = np.array(weights)
            for i, mark in enumerate(run_marks(words)):
                if mark in shared:
                    own[i : i + SHARED] = 0.0
            self.texts.append(([ident], words, own))
        self.shingles = []
        for _, words, _ in self.texts:
            places: dict[tuple, list[int]] = defaultdict(list)
            for i in range(len(words) - SHINGLE + 1):
                places[tuple(words[i : i + SHINGLE])].append(i)
            self.shingles.append(dict(places))
        parts = {tuple(words): own for _, words, own in reversed(items)}
        longest = max((len(words) for _, words, _ in self.texts), default=0)
        #: for each size of window its fingerprints, the texts they belong to, and the lookup of each block
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        size = WINDOW
        while size <= longest:
            prints, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
            for k, (_, words, own) in enumerate(self.texts):
                if len(words) >= size:
                    # wording that several items share makes no window by itself
                    known = np.concatenate([[0.0], np.cumsum(own)])
                    keep = known[size:] - known[:-size] > 1e-9
                    prints.append(self._windows(self._sums(self._signs(words), self._parts(parts[tuple(words)], size)), size, 1)[keep])
                    owner.append(np.full(int(keep.sum()), k, np.int32))
            self._add(size, np.concatenate(prints), np.concatenate(owner))
            size *= 2

    def _add(self, size: int, prints: np.ndarray, owner: np.ndarray) -> None:
        blocks = []
        for b in range(BLOCKS):
            key = self._block(prints, b)
            order = np.argsort(key, kind="stable").astype(np.int32)
            blocks.append((order, np.searchsorted(key[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32)))
        self.sizes[size] = prints, owner, blocks

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)

    @staticmethod
    def _parts(weights: list[float], size: int) -> list[float]:
        """Weights for windows of a size: all alike in the smallest, which must be met whatever separates a number's parts."""
        return [1.0] * len(weights) if size == WINDOW else weights

    def _signs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The signs of each bit of the different words, which of those each word is, and how much it weighs."""
        number: dict[str, int] = {}
        at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        digest = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64)
        signs = np.unpackbits(digest.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
        rare = np.array([2 if w in self.common else 3 for w in number], np.float32)
        return signs, at, rare[at]

    @staticmethod
    def _sums(signed: tuple[np.ndarray, np.ndarray, np.ndarray], weights: list[float]) -> np.ndarray:
        """Running sums of the weighted signs of each bit, one row more than there are words."""
        signs, at, rare = signed
        # whole numbers, so that sums don't depend on where they begin
        weigh = np.maximum(1, np.rint(60 * np.array(weights, np.float32) * rare)).astype(np.int32)
        out = np.zeros((len(at) + 1, BITS), np.int32)
        np.multiply(signs[at], weigh[:, None], out=out[1:])
        np.cumsum(out[1:], axis=0, out=out[1:])
        return out

    @staticmethod
    def _windows(sums: np.ndarray, size: int, step: int) -> np.ndarray:
        """The SimHash of the window at every ``step``-th position."""
        return np.packbits(sums[size::step] > sums[:-size:step], axis=1).view(np.uint64).ravel()

    def near(self, words: list[str], weights: list[float], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, size, text) of all pairs of a window and an item's window no more than ``radius`` bits apart."""
        places, lengths, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        signed, sums = self._signs(words) if len(words) >= WINDOW else None, None
        for size, (own, owner, blocks) in self.sizes.items():
            if len(words) < size or not len(own):
                continue
            if size <= 2 * WINDOW:  # one for the smallest size, one for all others
                sums = self._sums(signed, self._parts(weights, size))
            step = max(1, size // PARTS)
            prints = self._windows(sums, size, step)
            for b, (order, starts) in enumerate(blocks):
                key = self._block(prints, b)
                many = starts[key + 1] - starts[key]
                place = np.repeat(np.arange(len(prints)), many)
                within = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
                mine = order[starts[key][place] + within]
                close = np.bitwise_count(prints[place] ^ own[mine]) <= radius
                places.append(place[close] * step)
                lengths.append(np.full(int(close.sum()), size))
                texts.append(owner[mine[close]])
        return np.concatenate(places), np.concatenate(lengths), np.concatenate(texts)

    def carries(self, words: list[str], text: int, places: set[int]) -> bool:
        """Whether the words hold a long enough run of an item's text near one of the places."""
        _, item, weights = self.texts[text]
        shingles, reach = self.shingles[text], len(item) + len(item) // 5 + GAP
        low, high = -1, -1
        for place in sorted(places):
            if place < high - reach:
                continue  # inside the stretch compared just now
            low, high = max(0, place - reach), min(len(words), place + 2 * reach)
            if self._chained(words[low:high], item, weights, shingles):
                return True
        low, high = 0, 0
        around = WINDOW + LEAST_WORDS + 2 * STEP
        for place in sorted(places):
            if low < high and place - around <= high:
                high = place + around
                continue
            if low < high and self._aligned(words[low:high], item, weights):
                return True
            low, high = max(0, place - around), place + around
        return low < high and self._aligned(words[low:high], item, weights)

    @staticmethod
    def _aligned(words: list[str], item: list[str], weights: np.ndarray) -> bool:
        """Whether single words, aligned in the order of both texts, make a long enough run with few words altered."""
        total = np.concatenate([[0.0], np.cumsum(weights)]).tolist()
        spots: dict[str, list[int]] = defaultdict(list)
        for i, word in enumerate(item):
            spots[word].append(i)
        recent: list[tuple[int, int, dict[int, tuple[float, float]]]] = []  # place in the text, in the item, (aligned, altered) by first word
        for j, word in enumerate(words):
            recent = [r for r in recent if j - r[0] <= STEP]
            fresh = []
            for i in spots.get(word, ()):
                own = total[i + 1] - total[i]
                runs = {i: (own, 0.0)}
                for last, end, before in recent:
                    if not 0 < i - end <= STEP:
                        continue
                    # words only put in between count as altered ones, too
                    gap = total[i] - total[end + 1] if i > end + 1 else float(j - last - 1)
                    if gap > 2:
                        continue
                    for first, (aligned, altered) in before.items():
                        longer = (aligned + own, altered + gap)
                        if first not in runs or longer[0] - longer[1] > runs[first][0] - runs[first][1]:
                            runs[first] = longer
                for first, (aligned, altered) in runs.items():
                    if total[i + 1] - total[first] >= LEAST_WORDS - 1e-9 and aligned >= LEAST_INTACT * (aligned + altered) - 1e-9:
                        return True
                fresh.append((j, i, runs))
            recent += fresh
        return False

    @staticmethod
    def _chained(words: list[str], item: list[str], weights: np.ndarray, shingles: dict) -> bool:
        total = np.concatenate([[0.0], np.cumsum(weights)])
        chains: list[tuple[int, int, int, float]] = []  # first, end in the item, last place in the text, covered
        for j in range(len(words) - SHINGLE + 1):
            fresh = []
            for i in shingles.get(tuple(words[j : j + SHINGLE]), ()):
                best = (i, i + SHINGLE, j, total[i + SHINGLE] - total[i])
                for first, end, last, covered in chains:
                    step = i + SHINGLE - end
                    if 0 < step <= GAP and 0 < j - last <= GAP:
                        longer = covered + total[i + SHINGLE] - total[max(i, end)]
                        if longer > best[3]:
                            best = (first, i + SHINGLE, j, longer)
                span = total[best[1]] - total[best[0]]
                if span >= LEAST_WORDS - 1e-9 and best[3] >= LEAST_SIMILARITY * span:
                    return True
                fresh.append(best)
            if fresh:
                chains = [c for c in chains if j - c[2] < GAP] + fresh
        return False


def _search(index, kind: pa.DataType):
    """(doc, item) of the documents, given as text or as tokens with weights, that carry an item of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = pickle.loads(index.value)

        def found(held: list[tuple[object, list[str], list[float]]]) -> Iterator[tuple]:
            words = [w for _, own, _ in held for w in own]
            starts = np.cumsum([0, *(len(own) for _, own, _ in held)])
            places, sizes, texts = items.near(words, [w for *_, own in held for w in own])
            doc = np.searchsorted(starts, places, side="right") - 1
            inside = places + sizes <= starts[doc + 1]
            meet: dict[tuple[int, int], set[int]] = defaultdict(set)
            for d, k, p, n in zip(doc[inside].tolist(), texts[inside].tolist(), (places - starts[doc])[inside].tolist(), sizes[inside].tolist()):
                meet[d, k].update(range(p, p + n, WINDOW))
            for (d, k), near in meet.items():
                if items.carries(held[d][1], k, near):
                    yield from ((held[d][0], ident) for ident in items.texts[k][0])

        for batch in batches:
            out, held, size = [], [], 0
            split = batch.num_columns > 2
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                words, weights = row[1:] if split else weighted_tokens(row[1])
                held.append((row[0], words, weights))
                size += len(words)
                if size >= CHUNK_TOKENS:
                    out += found(held)
                    held, size = [], 0
            if held:
                out += found(held)
            if out:
                docs, leaked = zip(*out)
                yield pa.record_batch({"doc": pa.array(docs, batch.schema.field(0).type), "item": pa.array(leaked, kind)})

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as tokens and weights."""
    for batch in batches:
        words, weights = zip(*map(weighted_tokens, batch.column(1).to_pylist())) if batch.num_rows else ((), ())
        yield pa.record_batch({"id": batch.column(0), "words": pa.array(words, pa.list_(pa.string())), "weights": pa.array(weights, pa.list_(pa.float64()))})


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to tokenized items a hash of their words and the hashes of their runs of ``SHARED`` tokens."""
    for batch in batches:
        words = batch["words"].to_pylist()
        text = pa.array([xxhash.xxh64_intdigest(" ".join(own)) - (1 << 63) for own in words], pa.int64())
        yield pa.record_batch({**{c: batch[c] for c in ("id", "words", "weights")}, "text": text, "marks": pa.array(map(run_marks, words), pa.list_(pa.int64()))})


def _build(table: pa.Table) -> pa.Table:
    """The pickled index of one block of items."""
    rows = table.select(["id", "words", "weights", "shared", "common"]).sort_by([("id", "ascending")]).to_pylist()
    shared = {m for r in rows for m in r["shared"] or ()}
    common = {w for r in rows for w in r["common"] or ()}
    index = ItemIndex([(r["id"], r["words"], r["weights"]) for r in rows], shared, common)
    # with its class, which pickling alone wouldn't carry to the executors
    return pa.table({"block": table["block"].slice(0, 1), "index": pa.array([cloudpickle.dumps(index)], pa.binary())})


def item_indexes(tables: WrittenTables, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(block, index) of all items long enough to be found, built in tasks."""
    kind = items.schema[item_id].dataType.simpleString()
    known = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("t")).distinct()
    split = known.mapInArrow(_split, f"id {kind}, words array<string>, weights array<double>").mapInArrow(_marked, f"id {kind}, words array<string>, weights array<double>, text long, marks array<long>")
    every, _ = tables.write(split)
    once = every.dropDuplicates(["text"])
    words = once.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    common = words.where(F.col("n") * 4 > words.agg(F.max("n")).scalar()).select("word", F.lit(True).alias("hit"))
    shared = once.select(F.explode(F.array_distinct("marks")).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", F.lit(True).alias("hit"))
    # an item's own row is exploded and gathered again, so a group is bounded by one item
    long_enough = every.where(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x) >= LEAST_WORDS - 1e-9).withColumn("row", F.monotonically_increasing_id())
    chosen, _ = tables.write(long_enough)
    own_marks = chosen.select("row", F.explode(F.array_distinct("marks")).alias("mark")).join(shared, "mark").groupBy("row").agg(F.collect_list("mark").alias("shared"))
    own_words = chosen.select("row", F.explode(F.array_distinct("words")).alias("word")).join(common, "word").groupBy("row").agg(F.collect_list("word").alias("common"))
    many = chosen.agg(F.sum(F.size("words"))).first()[0] or 0
    # items with the same words stay together
    block = F.pmod(F.xxhash64("text"), F.lit(-(-many // BLOCK_TOKENS) or 1)).cast("int").alias("block")
    ready = chosen.join(own_marks, "row", "left").join(own_words, "row", "left").select("id", "words", "weights", "shared", "common", block)
    indexes, _ = tables.write(ready.groupBy("block").applyInArrow(_build, "block int, index binary"))
    return indexes


def leaked_items(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc_id, item_id) of each document that carries part of an item, once."""
    spark = docs.sparkSession
    tables = WrittenTables(spark, "leakage")
    names = (doc_id, item_id) if doc_id != item_id else (doc_id, f"item_{item_id}")
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    indexes = item_indexes(tables, items, item_id, item_text)
    blocks = sorted(r[0] for r in indexes.select("block").collect())
    if not blocks:
        return spark.createDataFrame([], f"`{names[0]}` {kinds[0]}, `{names[1]}` {kinds[1]}")
    texts = spread(docs.where(F.length(doc_text) > 0).select(F.col(doc_id), F.col(doc_text).cast("string")))
    if len(blocks) > 1:
        texts, _ = tables.write(texts.mapInArrow(_split, f"id {kinds[0]}, words array<string>, weights array<double>"))
    parts = []
    for block in blocks:
        index = spark.sparkContext.broadcast(bytes(indexes.where(F.col("block") == block).first()["index"]))
        found = texts.mapInArrow(_search(index, to_arrow_type(items.schema[item_id].dataType)), f"doc {kinds[0]}, item {kinds[1]}")
        if len(blocks) == 1:
            return found.toDF(*names).distinct()
        parts.append(tables.write(found)[1])
        index.destroy()
    return spark.read.schema(f"doc {kinds[0]}, item {kinds[1]}").parquet(*parts).toDF(*names).distinct()
