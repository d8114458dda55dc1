"""Queries p3, p6, p7 and p8 and, where SQL can express them, their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainweft.functions.identity import address
from chainweft.llm.encoding import garbled_documents, restored_documents
from chainweft.llm.groups import connected_groups
from chainweft.llm.leakage import leaked_items
from chainweft.llm.mixing import Mix, plan_mix, reached_shares, same_name
from chainweft.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every wallet that is linked with another one."""
    links = table(spark, folder, "wallet_links").where(F.col("is_match")).select(address(F.col("from_addr")).alias("a"), address(F.col("to_addr")).alias("b"))
    return connected_groups(links, "a", "b").select(F.col("member").alias("address"), F.col("label").alias("group_address"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry part of a held-out item, with the item."""
    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "bench_items"), "item_id", "text")


#: Domains of this project's sources; a parameter of the mix, others are a domain of their own.
DOMAINS = {"written": ["alert_explanations", "scan_findings", "changelogs", "runbooks"], "told": ["analyst_notes", "incident_reports", "forum_posts"]}


def _mix(spark: SparkSession, folder: str) -> Mix:
    domain = F.coalesce(*(F.when(same_name(F.col("source")).isin(names), name) for name, names in DOMAINS.items()), F.lit("other"))
    language = F.lower(F.substring(F.trim("lang"), 1, 2))
    return plan_mix(table(spark, folder, "documents"), "doc_id", "text", F.col("source"), table(spark, folder, "mix_targets"), {"domain": domain, "language": language})


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that can't reach their share."""
    return _mix(spark, folder).short_sources()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The mix drawn to the target shares: what each source was to have and what it has."""
    return reached_shares(_mix(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that were decoded with a wrong encoding, wholly or in part."""
    return garbled_documents(table(spark, folder, "documents"), "doc_id", "text")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The restored text of each such document, and whether all of it could be restored."""
    return restored_documents(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p3_found": p3_found, "p6_found": p6_found, "p7_found": p7_found, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}

# Sizes in characters, as the list is the same in any measure that tokens follow.
_SAME = "regexp_replace(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '[\\s_-]', '_', 'g')"

ORACLES = {
    "p7_found": f"""WITH docs AS (SELECT {_SAME.format('source')} AS k, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY 1),
own AS (SELECT m.source, m.target_share, m.max_repeats, coalesce(d.size, 0) AS size FROM mix_targets m LEFT JOIN docs d ON d.k = {_SAME.format('m.source')})
SELECT source FROM own WHERE size = 0 OR target_share * (SELECT sum(size) FROM own) > max_repeats * size""",
    "p3_found": """WITH RECURSIVE
pairs AS (SELECT lower(trim(from_addr)) AS a, lower(trim(to_addr)) AS b FROM wallet_links WHERE is_match AND lower(trim(from_addr)) <> lower(trim(to_addr))),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reached AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a)
SELECT a AS address, least(a, min(b)) AS group_address FROM reached GROUP BY a""",
}
