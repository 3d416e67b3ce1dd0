"""Representative choice: quotas, even spacing, groups, and diverse choice by marginal relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulae.session import checkpoint, numbered

#: Weight of relevance against novelty.
LAMBDA = 0.65
#: Items of a node that one task holds at most.
MOST = 4_000


def quotas(nodes: DataFrame, scope: str, budget: int) -> DataFrame:
    """Seats per node of a scope: one each, the others one by one to the greatest sqrt(size) / (seats + 1), as far as the node has items; ties go to the earlier node.

    ``nodes``: ``scope``, ``node_id``, ``pos``, ``n_items``. If the scope has more nodes than seats, evenly spaced nodes get one.
    """
    whole = W.partitionBy(scope)
    placed = nodes.withColumn("_n", F.count("*").over(whole)).withColumn("_i", F.row_number().over(whole.orderBy("pos")) - 1)
    placed = placed.withColumn("_first", even_place(F.col("_i"), F.col("_n"), budget)).where("_first")
    placed = placed.withColumn("_left", F.greatest(F.lit(0), F.lit(budget) - F.count("*").over(whole)))
    bids = placed.where("n_items > 1").select(scope, "node_id", "pos", "_left", F.explode(F.sequence(F.lit(1), F.least(F.col("n_items") - 1, F.lit(budget)))).alias("k"), F.sqrt(F.col("n_items").cast("double")).alias("weight"))
    won = bids.withColumn("_r", F.row_number().over(whole.orderBy(F.desc(F.col("weight") / (F.col("k") + 1)), "pos"))).where("_r <= _left")
    extra = won.groupBy(scope, "node_id").agg(F.count("*").alias("more"))
    return placed.join(extra, [scope, "node_id"], "left").select(scope, "node_id", (1 + F.coalesce("more", F.lit(0))).alias("quota"))


def even_place(index, length, limit: int):
    """Whether an index (from 0) is among ``limit`` evenly spaced ones of a sequence: rounded half to even; the middle one if the limit is 1."""
    if limit <= 1:
        return index == F.floor(length / 2)
    places = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda o: F.bround((length - 1) * o / (limit - 1), 0).cast("int"))
    return (length <= limit) | F.array_contains(places, index.cast("int"))


def evenly_spaced(rows: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    placed = numbered(rows, [by], [F.asc(order)], "_i", "_n")
    return placed.where(even_place(F.col("_i") - 1, F.col("_n"), limit)).drop("_n", "_i")


def unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def marginal(matrix: np.ndarray, chosen: set[int], budget: int) -> list[int]:
    """Indices chosen to the budget: each time the one whose likeness to the centre most outweighs its likeness to those chosen; the first index on ties."""
    centre = matrix.mean(axis=0)
    centre = centre / (np.linalg.norm(centre) or 1)
    relevance = matrix @ centre
    taken = sorted(chosen)
    nearest = (matrix @ matrix[taken].T).max(axis=1) if taken else np.full(len(matrix), -np.inf)
    open_ = np.ones(len(matrix), dtype=bool)
    open_[taken] = False
    while len(taken) < budget and open_.any():
        score = np.where(open_, LAMBDA * relevance - (1 - LAMBDA) * np.where(np.isinf(nearest), 0, nearest), -np.inf)
        best = int(score.argmax())
        taken.append(best)
        open_[best] = False
        nearest = np.maximum(nearest, matrix @ matrix[best])
    return sorted(taken)


def clusters(matrix: np.ndarray, k: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from farthest-first seeds; deterministic."""
    seeds = [0]
    near = matrix @ matrix[0]
    while len(seeds) < k:
        seeds.append(int(near.argmin()))
        near = np.maximum(near, matrix @ matrix[seeds[-1]])
    centres = matrix[seeds].copy()
    labels = np.full(len(matrix), -1)
    for _ in range(rounds):
        new = ((matrix**2).sum(1)[:, None] - 2 * matrix @ centres.T + (centres**2).sum(1)).argmin(axis=1)
        if (new == labels).all():
            break
        labels = new
        for c in range(k):
            if (labels == c).any():
                centres[c] = matrix[labels == c].mean(axis=0)
    return labels, centres


def representative_indices(matrix: np.ndarray, size: int | None = None) -> list[int]:
    """All of up to 8; else a fifth, 8 to 80: both ends, the nearest to each cluster's centre, and the rest by marginal relevance. ``size``: the node's items, if the matrix holds only candidates."""
    n = len(matrix)
    if n <= 8:
        return list(range(n))
    size = size or n
    budget = min(size, 80, max(8, -(-size // 5)))
    matrix = unit(matrix)
    labels, centres = clusters(matrix, max(1, min(round(size**0.5), budget - 3)))
    chosen = {0, n - 1}
    for c, centre in enumerate(centres):
        members = np.flatnonzero(labels == c)
        if len(members):
            chosen.add(int(members[(matrix[members] @ centre).argmax()]))
    return marginal(matrix, chosen, budget)


def _placed(rows: DataFrame, node: str, key: str, vector: str, block: int) -> DataFrame:
    """Items with a vector, their ``place`` (from 1) in the order of ``key`` in their node, ``size``, the node's items, and ``section``, the run of ``block`` items they are in."""
    flat = rows.select(F.col(node).cast("int").alias(node), F.col(key).cast("bigint").alias(key), vector).where(F.col(vector).isNotNull())
    return numbered(flat, [node], [F.asc(key)], "place", "size").withColumn("section", F.floor((F.col("place") - 1) / block).cast("bigint"))


def _matrix(group: pd.DataFrame, vector: str) -> np.ndarray:
    return np.stack(group[vector].to_numpy()).astype(np.float64)


def _bounded(placed: DataFrame, node: str, key: str, vector: str, keep: int) -> DataFrame:
    """The items of each node, and of nodes of more than ``MOST`` the candidates: runs of ``MOST`` are cut to ``keep`` by marginal relevance, with both ends, until none is larger."""

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        return group.iloc[marginal(unit(_matrix(group, vector)), {0, len(group) - 1}, keep)].drop(columns=["_run"])

    small_ = placed.where(F.col("size") <= MOST)
    large = placed.where(F.col("size") > MOST).withColumn("_at", F.col("place")).withColumn("_size", F.col("size"))
    while not large.where(F.col("_size") > MOST).isEmpty():
        runs = large.withColumn("_run", F.floor((F.col("_at") - 1) / MOST)).drop("_at", "_size")
        columns = [f for f in runs.schema.fields if f.name != "_run"]
        kept = checkpoint(runs.groupBy(node, "_run").applyInPandas(cut, StructType(columns)))
        large = numbered(kept, [node], [F.asc(key)], "_at", "_size")
    return small_.unionByName(large.drop("_at", "_size"))


def representatives(rows: DataFrame, node: str, key: str, vector: str, block: int = 400) -> DataFrame:
    """``node``, ``section``, ``key`` of the representatives of each node; ``section`` is the run of ``block`` items of the node, in order of ``key``, that the item is in.

    Budget and clusters go by the whole node's items. Of a node of more than ``MOST`` items, clusters
    and choice are over its candidates (``_bounded``), so no task holds more than ``MOST``.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        return group.iloc[representative_indices(_matrix(group, vector), int(group["size"].iloc[0]))][[node, "section", key]]

    bounded = _bounded(_placed(rows, node, key, vector, block), node, key, vector, 80)
    return bounded.groupBy(node).applyInPandas(choose, f"{node} int, section bigint, {key} bigint")


def node_diverse(rows: DataFrame, node: str, key: str, vector: str, budget: int, block: int = 400) -> DataFrame:
    """``budget`` items of each node by marginal relevance, both ends always among them; ``section`` and nodes of more than ``MOST`` items as in ``representatives``."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        n = len(group)
        picked = range(n) if n <= budget else marginal(unit(_matrix(group, vector)), {0, n - 1}, budget)
        return group.iloc[list(picked)][[node, "section", key]]

    bounded = _bounded(_placed(rows, node, key, vector, block), node, key, vector, max(80, budget))
    return bounded.groupBy(node).applyInPandas(choose, f"{node} int, section bigint, {key} bigint")


def diverse(rows: DataFrame, node: str, key: str, vector: str, budget: int, block: int = 400) -> DataFrame:
    """``budget`` items of each section of a node, a range of ``block`` values of ``key``, by marginal relevance, both ends always among them."""
    cut = rows.select(F.col(node).cast("int").alias(node), F.floor(F.col(key) / block).cast("bigint").alias("section"), F.col(key).cast("bigint").alias(key), vector).where(F.col(vector).isNotNull())

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        n = len(group)
        picked = range(n) if n <= budget else marginal(unit(np.stack(group[vector].to_numpy()).astype(np.float64)), {0, n - 1}, budget)
        return group.iloc[list(picked)][[node, "section", key]]

    return cut.groupBy(node, "section").applyInPandas(choose, f"{node} int, section bigint, {key} bigint")


def scope_representatives(rows: DataFrame, node: str, key: str, vector: str, budget: int, block: int = 400) -> DataFrame:
    """A budget over all sections of a node, runs of ``block`` of its items in order of ``key``: seats by ``quotas``, each section's items by marginal relevance within its seats; the node's first and last are always kept."""
    cut = checkpoint(_placed(rows, node, key, vector, block))
    sizes = cut.groupBy(node, "section").agg(F.count("*").alias("n_items")).select(node, F.col("section").alias("node_id"), F.col("section").alias("pos"), "n_items")
    seats = quotas(sizes, node, budget).select(node, F.col("node_id").alias("section"), "quota")
    given = cut.join(seats, [node, "section"])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        n, seats = len(group), int(group.quota.iloc[0])
        ends = {i for i in (0, n - 1) if seats >= 2 or group.place.iloc[i] in (1, group["size"].iloc[0])}
        picked = range(n) if seats >= n else marginal(unit(_matrix(group, vector)), ends, seats)
        return group.iloc[list(picked)][[node, "section", key]]

    return given.groupBy(node, "section").applyInPandas(choose, f"{node} int, section bigint, {key} bigint")
