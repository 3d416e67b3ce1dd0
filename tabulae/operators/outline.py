"""Outlines: trees of nodes, page ranges and consecutive pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.session import checkpoint


def ancestors(nodes: DataFrame) -> DataFrame:
    """All pairs ``node_id``, ``ancestor_id`` and ``distance`` (0 for the node itself), by doubling jumps until no pair is new.

    ``nodes``: ``node_id``, ``parent_id``. Cycles end because their pairs are known already; parents that do not exist are no ancestors.
    """
    ids = nodes.select("node_id").distinct()
    up = nodes.select("node_id", F.col("parent_id").alias("ancestor_id")).join(ids.select(F.col("node_id").alias("ancestor_id")), "ancestor_id").where(F.col("node_id") != F.col("ancestor_id")).select("node_id", "ancestor_id", F.lit(1).alias("distance")).distinct()
    known, span = checkpoint(ids.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance")).unionByName(up)), 1
    while True:
        further = known.where(F.col("distance") == span).select(F.col("node_id"), F.col("ancestor_id").alias("via"))
        next_ = further.join(known.where("distance > 0").select(F.col("node_id").alias("via"), "ancestor_id", (F.col("distance") + span).alias("distance")), "via").select("node_id", "ancestor_id", "distance")
        new = checkpoint(next_.join(known, ["node_id", "ancestor_id"], "left_anti").groupBy("node_id", "ancestor_id").agg(F.min("distance").alias("distance")))
        if new.isEmpty():
            break
        known, span = checkpoint(known.unionByName(new)), span * 2
    return known


def paths(nodes: DataFrame, chain: DataFrame) -> DataFrame:
    """``node_id`` and ``path``, the titles from its root down to it."""
    named = chain.join(nodes.select(F.col("node_id").alias("ancestor_id"), "title"), "ancestor_id")
    return named.groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("distance", "title")), False), lambda x: x["title"]), " > ").alias("path"))


def page_ends(entries: DataFrame, levels: int = 8) -> DataFrame:
    """Entries with ``page_last``: the page before the next entry of their level or above, else the document's last.

    ``entries``: ``document_id``, ``pos``, ``level`` (1 to ``levels``), ``page_start``, ``pages``. One backward pass per level.
    """
    behind = W.partitionBy("document_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    following = F.array(*(F.last(F.when(F.col("level") <= n, F.col("page_start")), ignorenulls=True).over(behind) for n in range(1, levels + 1)))
    marked = entries.withColumn("_next", following)
    return marked.withColumn("page_last", F.coalesce(F.element_at("_next", F.col("level")) - 1, F.col("pages"))).drop("_next")


def nodes_of_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each page with the node that covers it, the one that begins last (then the lower id); pages without one stay with null.

    ``pages``: ``document_id``, ``page_number``; ``nodes``: ``document_id``, ``node_id``, ``page_start``,
    ``page_end``. The ranges are written out to pages, so the join is by equality.
    """
    covered = nodes.where("page_start <= page_end").select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"), "node_id", "page_start")
    best = covered.groupBy("document_id", "page_number").agg(F.min(F.struct((-F.col("page_start")).alias("s"), "node_id")).alias("b")).select("document_id", "page_number", F.col("b.node_id").alias("node_id"))
    return pages.select("document_id", "page_number").distinct().join(best, ["document_id", "page_number"], "left")


def page_ranges(flagged: DataFrame, size: int = 7, padding: int = 1) -> DataFrame:
    """Runs of consecutive flagged pages, cut to ``size`` with ``padding`` pages around each, within the document.

    ``flagged``: ``document_id``, ``page``, ``pages`` (null: no upper bound).
    """
    w = W.partitionBy("document_id").orderBy("page")
    runs = flagged.distinct().withColumn("run", F.col("page") - F.row_number().over(w))
    inside = F.row_number().over(W.partitionBy("document_id", "run").orderBy("page"))
    parts = runs.withColumn("part", F.floor((inside - 1) / (size - 2 * padding)))
    made = parts.groupBy("document_id", "run", "part").agg((F.min("page") - padding).alias("a"), (F.max("page") + padding).alias("b"), F.max("pages").alias("pages"))
    return made.select("document_id", F.greatest(F.lit(1), "a").alias("first_page"), F.least(F.col("b"), F.coalesce("pages", "b")).alias("last_page"))
