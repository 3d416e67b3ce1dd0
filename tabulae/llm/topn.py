"""The best N items of every group by mergeable bounded heaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of unfinished heaps that a task holds before it hands them on; more groups than fit cost shuffle, not rows.
HELD = 200_000


def _best(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The heap of each group: its ``n`` best different items, by score falling, tie rising with null last, item rising."""
    rows = rows.sort_values(["score", "tie", "item"], ascending=[False, True, True], na_position="last", kind="stable")
    rows = rows.drop_duplicates(["grp", "item"])
    return rows[rows.groupby("grp", sort=False).cumcount() < n]


def top_items(rows: DataFrame, group: str, item: str, score: str, tie: str, n: int = 5) -> DataFrame:
    """``group``, ``rank_no`` (from 1) and ``item`` of the ``n`` best different items of each group.

    An item counts once, with its highest score and, among equal scores, its lowest ``tie``. Order:
    score falling, ``tie`` rising with null last, ``item`` rising by code point; with different
    items in a group this is a total order, so the result is the same on every run. Rows with a
    null or empty group, a null item, or a null or NaN score do not compete. Groups with fewer items
    give fewer ranks; an empty table gives none; repeated rows change nothing.

    Each task keeps a heap of ``n`` different items per group over all its rows (a dropped item has
    ``n`` better ones, so nothing is lost) and sends only heaps into the one shuffle, by group. A
    group of millions of rows sends at most ``n`` rows a task and flush. The heaps are merged behind
    the shuffle, in the same partitioning.
    """
    picked = rows.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"), F.col(tie).cast("double").alias("tie"))
    picked = picked.where("grp IS NOT NULL AND grp <> '' AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")

    def heaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, waiting, size = None, [], 0
        for b in batches:
            waiting.append(_best(b, n))
            size += len(waiting[-1])
            # merged when as much waits as is held, so a row is sorted a few times however many batches come
            if size > max(20_000, 0 if held is None else len(held)):
                held, waiting, size = _best(pd.concat([*([] if held is None else [held]), *waiting], ignore_index=True), n), [], 0
                if len(held) > HELD:
                    yield held
                    held = None
        rest = [*([] if held is None else [held]), *waiting]
        if rest and sum(map(len, rest)):
            yield _best(pd.concat(rest, ignore_index=True), n)

    sent = picked.mapInPandas(heaps, picked.schema).repartition("grp")
    tie_key = F.coalesce("tie", F.lit(float("inf")))
    merged = sent.groupBy("grp", "item").agg(F.min(F.struct((-F.col("score")).alias("s"), tie_key.alias("t"))).alias("k"))
    place = F.row_number().over(W.partitionBy("grp").orderBy("k.s", "k.t", "item"))
    return merged.withColumn("rank_no", place).where(F.col("rank_no") <= n).select(F.col("grp").alias(group), "rank_no", F.col("item").alias(item))
