"""Mixing sources to target weights: hierarchical token budgets and seeded epochs.

Documents are leaves of a tree, whose levels are columns from the root downwards - domain, language or any others - and
the source last. Each source's target share is its weight; a source's weight is split over its leaves by their size,
and every node weighs as its leaves together. The whole amount times a node's weight is what it is entitled to. A leaf
can supply its size times the number of times a document may be used in all. From the root down, a node's amount is
split among its children by their weights; a child never gets more than the leaves below it can supply, what it can't
take is spread over its siblings by their weights, and only what no sibling can take goes to the ancestors' other
children. A source whose leaves can't supply what they are entitled to is short. A leaf uses whole epochs of all its
documents as far as its budget goes, then a prefix, by tokens, of one more epoch in an order seeded by document and
epoch.

Sizes are counted in tokens over whole texts once and written to the shared folder. The tree and the budgets are
tables, too: children of one node are put in order of supply by weight, and prefix sums tell which of them get all
they have, so nothing but counts of rows comes to the driver, however many leaves there are. A node's children are one
row each in a window, at most as many as targets at the last level. The prefix needs no sorted leaf: documents
are dealt to ``BUCKETS`` ranges of their seeded order, the ranges' sums tell in which one the budget ends, and only that
range is sorted.

Defined cases: null and empty texts have no tokens and are used like others. Documents of sources without a target take
no part. A source with a target but without documents can't reach it. Repeated documents count each time. Null shares
count 0, null numbers of uses 1. Targets whose names differ only in spelling are one: shares add up, the larger number of
uses holds. Targets without a name are none. Shares that don't add up to 1 ask for that part of the whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainweft.operators.skew import lookup
from chainweft.operators.spread import spread
from chainweft.session import WrittenTables

#: The rank file of a public tokenizer, in a folder that every machine has.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern published with that tokenizer, which splits text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Rows of targets or leaves that are broadcast, about 200 bytes each; beyond that they are joined by a shuffle.
MOST_BROADCAST = 50_000
#: Part by which what a leaf is entitled to must exceed its supply, as rounding may: one token in 10^14.
ROUNDING = 1e-14
BUCKETS = 4096


def same_name(c: Column) -> Column:
    """A name without regard to case, outer blanks, and the choice of blank, hyphen or underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), r"[\s_-]", "_")


def _token_counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(text)) if text else 0 for text in batch.column(batch.num_columns - 1).to_pylist()]
            columns = {batch.schema.names[k]: batch.column(k) for k in range(batch.num_columns - 1)}
            yield pa.record_batch(columns | {"tokens": pa.array(counts, pa.int64())})

    return run


def with_tokens(docs: DataFrame, text_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with the number of tokens of a text in place of the text."""
    others = docs.drop(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others.schema) + ", tokens long"
    return docs.select(*(F.col(f"`{c}`") for c in others.columns), F.col(text_col).cast("string")).mapInArrow(_token_counter(tokenizer), schema)


@dataclass
class Mix:
    """What ``plan_mix`` made: sizes of documents, the tree's levels, its leaves, and the targets by canonical name."""

    sizes: DataFrame
    levels: list[str]
    leaves: DataFrame
    targets: DataFrame
    tables: WrittenTables

    def short_sources(self) -> DataFrame:
        """(source) of the targets with a leaf that can't supply what it is entitled to, or without documents."""
        short = self.leaves.groupBy("__source").agg(F.bool_or("short").alias("short"))
        return self.targets.join(short, "__source").where("short").select("source")


def _small(rows: DataFrame) -> bool:
    return rows.count() <= MOST_BROADCAST


def _met(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with its row of ``right``: by broadcast if that is small, else by a shuffle that treats hot keys apart."""
    return left.join(F.broadcast(right), key, "left") if _small(right) else lookup(left, right, key, left.count())


def plan_mix(docs: DataFrame, id_col: str, text_col: str, source: Column, targets: DataFrame, above: dict[str, Column] | None = None, tokenizer: str = TOKENIZER) -> Mix:
    """The tree with levels ``above``, root first, and the sources, whose shares ``targets`` gives.

    ``targets`` is (source, target_share, max_repeats). The amount to fill is the size of all documents with a target,
    each once. ``leaves`` of the result is (levels, size, documents, uses, weight, supply, entitled, short).
    """
    tables = WrittenTables(docs.sparkSession, "mixing")
    named = targets.select(same_name(F.col("source")).alias("__source"), "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    wanted, _ = tables.write(named.where(F.col("__source").isNotNull()).groupBy("__source").agg(F.min("source").alias("source"), F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")))
    upper = [f"__level{k}" for k in range(len(above or {}))]
    levels = [*upper, "__source"]
    slim = docs.select(F.col(id_col).alias("__id"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(upper, (above or {}).values())), same_name(source).alias("__source"), F.col(text_col).alias("__text"))
    keys = wanted.select("__source")
    if _small(keys):
        sizes, _ = tables.write(with_tokens(spread(slim).join(F.broadcast(keys), "__source", "left_semi").select("__id", *levels, "__text"), "__text", tokenizer))
    else:  # texts aren't shuffled to meet their source; their sizes are
        every, _ = tables.write(with_tokens(spread(slim), "__text", tokenizer))
        sizes, _ = tables.write(lookup(every, keys.withColumn("__listed", F.lit(True)), "__source", every.count()).where("__listed").drop("__listed"))
    own = sizes.groupBy(*levels).agg(F.sum("tokens").alias("size"), F.count(F.lit(1)).alias("documents"))
    whole = own.groupBy("__source").agg(F.sum("size").alias("__size"), F.count(F.lit(1)).alias("__leaves"))
    part = F.when(F.col("__size") > 0, F.col("size") / F.col("__size")).otherwise(1 / F.coalesce("__leaves", F.lit(1)))
    leaves, _ = tables.write(
        wanted.join(own, "__source", "left").join(whole, "__source", "left").select(
            *(F.coalesce(n, F.lit("")).alias(n) for n in upper), "__source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("documents", F.lit(0)).alias("documents"), F.col("max_repeats").alias("uses"),
            (F.col("target_share") * part).alias("weight"),
        )
    )
    entitled = F.col("weight") * leaves.agg(F.coalesce(F.sum("size"), F.lit(0))).scalar()
    supply = (F.col("size") * F.greatest("uses", F.lit(0))).cast("double")
    short = (F.col("documents") == 0) | (entitled > supply * (1 + ROUNDING))
    return Mix(sizes, levels, leaves.withColumns({"supply": supply, "entitled": entitled}).withColumn("short", short), wanted, tables)


def share_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` with ``given``: each parent's ``amount`` split by ``weight``, no child getting more than ``supply``.

    What a child can't supply is spread over its siblings by their weights. In order of supply by weight, a child gets
    all it has if what is left for it and those after it, by weight, is no less; the first one for which it is less, and
    all after it, share what is left by weight. Children without weight get nothing.
    """
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight"))
    rows = children.withColumn("__ratio", ratio)
    every = Window.partitionBy(*parent)
    order = every.orderBy(F.col("__ratio").asc_nulls_last(), name)
    before = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("supply"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    fits = F.try_divide(F.col("amount") - before, onward)
    placed = rows.withColumn("__fits", fits).withColumn("__full", F.coalesce(F.col("__fits") >= F.col("__ratio"), F.lit(False)))
    first = F.min(F.when(~F.col("__full") & (F.col("weight") > 0), F.struct("__ratio", name, "__fits"))).over(every)["__fits"]
    given = F.when(F.col("__full"), F.col("supply")).when(F.col("weight") > 0, F.least(F.col("supply"), F.greatest(F.lit(0.0), F.col("weight") * first))).otherwise(0.0)
    return placed.withColumn("given", given).drop("__ratio", "__fits", "__full")


def budgets(leaves: DataFrame, levels: list[str]) -> DataFrame:
    """``leaves`` with the ``budget`` that each gets, amounts going down the tree level by level."""
    useful = leaves.withColumn("supply", F.when(F.col("weight") > 0, F.col("supply")).otherwise(0.0))
    given = useful.agg(F.coalesce(F.sum("entitled"), F.lit(0.0)).alias("amount"))
    for depth in range(1, len(levels) + 1):
        own = levels[:depth]
        nodes = useful.groupBy(*own).agg(F.sum("weight").alias("weight"), F.sum("supply").alias("supply"))
        held = nodes.withColumn("amount", given.scalar()) if depth == 1 else nodes.join(given, own[:-1])
        given = share_out(held, own[:-1], own[-1]).select(*own, F.col("given").alias("amount"))
    return leaves.join(given.withColumnRenamed("amount", "budget"), levels)


def _leaf(levels: list[str]) -> Column:
    return F.concat_ws("\x1f", *levels).alias("__leaf")


def draw(mix: Mix, seed: int = 0) -> DataFrame:
    """(id, source, tokens, copies) of every document that is used at all."""
    budget = F.col("budget") + 1e-6
    whole = F.when(F.col("size") > 0, F.least("uses", F.floor(budget / F.greatest("size", F.lit(1))))).otherwise(F.least("uses", F.lit(1))).cast("int")
    left = F.when(F.col("__whole") < F.col("uses"), F.greatest(F.lit(0), F.floor(budget) - F.col("__whole") * F.col("size"))).otherwise(0).cast("long")
    plan, _ = mix.tables.write(budgets(mix.leaves, mix.levels).withColumn("__whole", whole).select(_leaf(mix.levels), "__whole", left.alias("__rest")))
    order = F.xxhash64(F.col("__id"), F.col("__whole"), F.lit(seed))
    rows = mix.sizes.select("__id", "__source", "tokens", _leaf(mix.levels))
    dealt = _met(rows, plan, "__leaf").withColumn("__order", order).withColumn("__bucket", F.shiftrightunsigned("__order", 52).cast("int"))
    sums = dealt.where(F.col("__rest") > 0).groupBy("__leaf", "__bucket").agg(F.sum("tokens").alias("__sum"), F.first("__rest").alias("__rest"))
    upto = Window.partitionBy("__leaf").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = sums.withColumn("__upto", F.sum("__sum").over(upto)).where(F.col("__upto") > F.col("__rest"))
    last = F.min(F.struct("__bucket", (F.col("__rest") - F.col("__upto") + F.col("__sum")).alias("__left")))
    edge, _ = mix.tables.write(ended.groupBy("__leaf").agg(last.alias("__edge")).select("__leaf", "__edge.*").withColumnRenamed("__bucket", "__last"))
    marked = _met(dealt, edge, "__leaf")
    inside = F.coalesce(F.col("__bucket") < F.col("__last"), F.col("__rest") > 0)
    sure = marked.where(~F.coalesce(F.col("__bucket") == F.col("__last"), F.lit(False))).withColumn("copies", F.col("__whole") + inside.cast("int"))
    run = Window.partitionBy("__leaf").orderBy("__order", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = marked.where(F.col("__bucket") == F.col("__last")).withColumn("copies", F.col("__whole") + (F.sum("tokens").over(run) <= F.col("__left")).cast("int"))
    columns = [F.col("__id").alias("id"), F.col("__source").alias("source"), "tokens", "copies"]
    return sure.select(columns).unionByName(cut.select(columns)).where(F.col("copies") > 0)


def reached_shares(mix: Mix, seed: int = 0) -> DataFrame:
    """(source, target_share, max_repeats, size, budget, tokens, documents, reached_share, short) for each target."""
    drawn = draw(mix, seed).groupBy(F.col("source").alias("__source")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"))
    drawn, _ = mix.tables.write(drawn)
    planned = budgets(mix.leaves, mix.levels).groupBy("__source").agg(F.sum("size").alias("size"), F.sum("budget").alias("budget"), F.bool_or("short").alias("short"))
    total = drawn.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    tokens = F.coalesce("tokens", F.lit(0))
    both = mix.targets.join(planned, "__source").join(drawn, "__source", "left")
    return both.select("source", "target_share", "max_repeats", "size", F.round("budget", 3).alias("budget"), tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce(F.try_divide(tokens, total), F.lit(0.0)), 6).alias("reached_share"), "short")
