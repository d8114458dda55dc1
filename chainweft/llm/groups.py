"""Consolidating pairwise matches into groups: minimum labels with pointer jumping.

Each round, every record takes the smallest of its own label and its neighbours' labels over the remaining edges.
That gives each record a parent; pointer jumping - every parent replaced by its parent - is repeated until no label
changes. Then edges are rewritten to the labels of their ends, and those within one label and repeated ones drop out;
what is left is a smaller graph of labels, on which the next round works. No edge is left when no label can change;
the last labels are then carried back through the rounds. Each round works on what the one before left, so all of them
together cost little more than the first.

Every round's tables are written to the shared folder, which cuts the lineage and survives a lost executor; nothing
but row counts comes to the driver. Minima are combined before the shuffle, so a hub with a third of all edges sends
one label from each task; lookups of labels treat hot keys apart (``operators.skew.lookup``).

Defined cases: pairs with a null end and pairs of a record with itself link nothing. Repeated and reversed pairs count
once. A record without any link has no row. The label is the smallest identifier of the group in the order of its
type; for strings that is their order in UTF-8. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.operators.skew import HOT_ROWS, lookup
from chainweft.session import WrittenTables


def connected_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(member, label): for each record in a pair the smallest record linked with it directly or indirectly."""
    tables = WrittenTables(pairs.sparkSession, "groups")
    ends = pairs.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), (F.col(left) != F.col(right)).alias("apart"))
    edges, edges_at = tables.write(ends.where("apart").select("a", "b").distinct())
    rounds: list[tuple[DataFrame, str]] = []
    while many := edges.count():
        parents, parents_at = _jump(tables, *tables.write(edges.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("parent"))))
        rounds.append((parents, parents_at))
        label, half_at = F.coalesce("parent", "label"), None
        half = lookup(edges.withColumnRenamed("a", "label"), parents, "label", many).select(label.alias("a"), F.col("b").alias("label"))
        if many >= HOT_ROWS:  # as the next lookup may read it twice
            half, half_at = tables.write(half)
        whole = lookup(half, parents, "label", many).select("a", label.alias("b")).where(F.col("a") != F.col("b"))
        rest, rest_at = tables.write(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        for path in filter(None, (half_at, edges_at)):
            tables.drop(path)
        edges, edges_at = rest, rest_at
    if not rounds:
        return edges.select(F.col("a").alias("member"), F.col("b").alias("label"))
    # each round's labels are the next one's records, so the last labels are carried back round by round
    final, final_at = rounds.pop()
    while rounds:
        parents, parents_at = rounds.pop()
        above = final.select(F.col("label").alias("parent"), F.col("parent").alias("above"))
        carried = lookup(parents, above, "parent", parents.count()).select("label", F.coalesce("above", "parent").alias("parent"))
        merged, merged_at = tables.write(carried.unionByName(final))
        tables.drop(parents_at), tables.drop(final_at)
        final, final_at = merged, merged_at
    smallest = final.select(F.col("parent").alias("label"), "parent").distinct()
    return final.unionByName(smallest).select(F.col("label").alias("member"), F.col("parent").alias("label"))


def _jump(tables: WrittenTables, parents: DataFrame, at: str) -> tuple[DataFrame, str]:
    """Replaces every parent by its parent's parent, or as far up as there is one, until none changes."""
    rows = parents.count()
    while True:
        above = parents.select(F.col("label").alias("parent"), F.col("parent").alias("above"))
        once = lookup(parents, above, "parent", rows).select("label", F.coalesce("above", "parent").alias("parent"))
        twice = lookup(once, above, "parent", rows).select("label", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        jumped, jumped_at = tables.write(twice)
        tables.drop(at)
        parents, at = jumped.select("label", "parent"), jumped_at
        if not jumped.where("moved").limit(1).count():
            return parents, at
