"""Mixing of sources to target shares along a time-varying curriculum.

Each source has a weight schedule over the training run, t from 0 to 1, piecewise linear between
given points. Its integral gives the tokens that the source has contributed up to t; a document is
placed at the t at which the integral reaches the tokens of its source before it. Sorting by that
position gives the mixture, in which a source's share at t follows its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulae.session import checkpoint, small

#: Prefixes of the hash order that cumulative sums are first taken over: 2 ** BITS a source.
BITS = 12
#: How far a source's weight departs from its share at the ends of the run (0: constant weights).
TILT = 0.5


def plan_mixture(sizes: DataFrame, targets: DataFrame, tilt: float = TILT) -> DataFrame:
    """One row per source of ``targets``: what it has, what it should give and what it can give.

    ``sizes``: ``source`` and ``n_tokens`` of each document. ``targets``: ``source``,
    ``target_share``, ``max_repeats``. Sources match exactly; documents of other sources or of none
    take no part. ``demand`` is the source's share of the tokens of all documents that take part; a
    source is ``short`` if all its documents times ``max_repeats`` hold fewer tokens than that, and
    then gives all it has. ``slope`` tilts its schedule; the tilts cancel out, so at every t the
    weights sum to 1. A source listed twice counts with its first row by share and repeats; null
    shares and repeats count as 0, negative ones too. Empty documents: every demand is 0.
    """
    goal = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("g"))
    goal = goal.select("source", F.greatest(F.coalesce("g.target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("g.max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    one = goal.join(have, "source", "left").fillna(0, ["tokens", "documents"])
    every = W.partitionBy(F.lit(1))
    upto = every.orderBy("source").rowsBetween(W.unboundedPreceding, W.currentRow)
    one = one.withColumn("total", F.sum("tokens").over(every)).withColumn("middle", F.sum("target_share").over(upto) - F.col("target_share") / 2)
    one = one.withColumn("demand", F.col("target_share") * F.col("total")).withColumn("available", F.col("tokens") * F.col("max_repeats"))
    one = one.withColumn("short", F.col("available") < F.col("demand")).withColumn("planned", F.least(F.col("demand"), F.col("available").cast("double")))
    return one.withColumn("slope", F.lit(tilt) * (1 - 2 * F.col("middle"))).drop("middle")


def tilted(plan: DataFrame) -> DataFrame:
    """A schedule where none is given: each source's share, tilted by its ``slope`` from the run's begin to its end; the weights of all sources sum to 1 at every t."""
    ends = F.array(*(F.struct(F.lit(float(t)).alias("t"), (F.col("target_share") * (1 + sign * F.col("slope"))).alias("weight")) for t, sign in ((0, -1), (1, 1))))
    return plan.select("source", F.explode(ends).alias("k")).select("source", "k.t", "k.weight")


def segments(schedules: DataFrame) -> DataFrame:
    """``source`` and ``segments`` of its schedule: array of ``t``, ``span``, ``a`` and ``b`` (the weight at both ends), ``before`` (the share of the integral up to ``t``) and ``whole`` (the integral).

    ``schedules``: ``source``, ``t``, ``weight``. Points with null values or t beyond 0 and 1 do not count,
    negative weights are 0, of several weights at one t the greatest counts; the first and last
    weights hold to the ends. A schedule of zeros is constant.
    """
    points = schedules.where("source IS NOT NULL AND t BETWEEN 0 AND 1 AND weight IS NOT NULL AND NOT isnan(weight)").groupBy("source", "t").agg(F.max(F.greatest(F.lit(0.0), "weight")).alias("w"))
    knots = points.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), "w"))).alias("k"))
    first, last = F.element_at("k", 1), F.element_at("k", -1)
    whole = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), first["w"].alias("w"))), F.col("k"), F.array(F.struct(F.lit(1.0).alias("t"), last["w"].alias("w"))))
    pairs = F.zip_with(F.slice(whole, 1, F.size(whole) - 1), F.slice(whole, 2, F.size(whole) - 1), lambda x, y: F.struct(x["t"].alias("t"), (y["t"] - x["t"]).alias("span"), x["w"].alias("a"), y["w"].alias("b"), ((x["w"] + y["w"]) / 2 * (y["t"] - x["t"])).alias("area")))
    some = knots.select("source", F.filter(pairs, lambda p: p["span"] > 0).alias("p")).withColumn("whole", F.aggregate("p", F.lit(0.0), lambda s, p: s + p["area"]))
    flat = F.array(F.struct(F.lit(0.0).alias("t"), F.lit(1.0).alias("span"), F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(1.0).alias("area")))
    some = some.select("source", F.when(F.col("whole") > 0, F.col("p")).otherwise(flat).alias("p"), F.when(F.col("whole") > 0, F.col("whole")).otherwise(1.0).alias("whole"))
    before = lambda i: F.aggregate(F.slice("p", 1, i), F.lit(0.0), lambda s, q: s + q["area"])
    return some.select("source", F.transform("p", lambda p, i: F.struct(p["t"].alias("t"), p["span"].alias("span"), p["a"].alias("a"), p["b"].alias("b"), before(i).alias("before"), F.col("whole").alias("whole"))).alias("segments"))


def schedule_inverse(part: Column, parts: Column) -> Column:
    """The t at which the integral of a schedule (its ``segments``) reaches ``part`` of the whole; constant where there is none."""

    def within(s: Column) -> Column:
        rest = F.greatest(F.lit(0.0), part * s["whole"] - s["before"])
        bend = (s["b"] - s["a"]) / s["span"]
        straight = F.when(s["a"] > 0, rest / s["a"]).otherwise(0.0)
        # of the two forms of the root the one without cancellation
        curved = 2 * rest / (s["a"] + F.sqrt(F.greatest(F.lit(0.0), s["a"] * s["a"] + 2 * bend * rest)))
        return s["t"] + F.least(s["span"], F.when(rest <= 0, 0.0).when(F.abs(bend) < 1e-12, straight).otherwise(curved))

    # the last stretch that begins at or before the part and holds weight
    held = F.filter(parts, lambda s: (s["before"] <= part * s["whole"]) & (s["a"] + s["b"] > 0))
    first = F.element_at(F.filter(parts, lambda s: s["a"] + s["b"] > 0), 1)
    return F.when(parts.isNull(), part).otherwise(within(F.coalesce(F.try_element_at(held, F.lit(-1)), first)))


def mix(sizes: DataFrame, targets: DataFrame, schedules: DataFrame | None = None, bits: int = BITS, tilt: float = TILT, seed: int = 7) -> DataFrame:
    """``position`` (0 to 1), ``source``, ``doc_id``, ``copy_no`` (from 1) and ``n_tokens`` of each use of a document, in order.

    Each source's documents follow each other in hash order; the second copies start after the last
    first copy, and a copy is used if it starts before the source's demand is met, so a source
    exceeds its demand by less than one document. No document is used more than ``max_repeats``
    times; documents without tokens are used once at most. The order is the same on every run, as
    repeated rows of a document are interchangeable.

    ``schedules`` (``source``, ``t``, ``weight``) is the curriculum, see ``segments``; it shapes when a
    source's tokens come, while how many come is its target share. Sources that it does not name come
    evenly; without it the schedules of ``tilted`` hold.

    Cumulative sums run over prefixes of the hash first (2 ** ``bits`` a source, summed before the
    shuffle) and then within a prefix, so no task holds a whole source.
    """
    # written once: counting tokens is the dear part, and the plan, the prefixes and the documents all need them
    sizes = checkpoint(sizes.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    plan = plan_mixture(sizes, targets, tilt)
    shape = segments(tilted(plan) if schedules is None else schedules)
    # one row a source on both sides
    docs = sizes.join(small(plan.select("source", "tokens", "planned", "max_repeats").where("planned > 0").join(shape, "source", "left")), "source")
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("prefix", F.shiftrightunsigned("h", 64 - bits))
    sums = docs.groupBy("source", "prefix").agg(F.sum("n_tokens").alias("block"))
    before = W.partitionBy("source").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "prefix", F.coalesce(F.sum("block").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "prefix").orderBy("h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    docs = docs.withColumn("upto", F.sum("n_tokens").over(inside)).join(sums, ["source", "prefix"])
    docs = docs.withColumn("start", F.col("offset") + F.col("upto") - F.col("n_tokens"))
    copies = F.when(F.col("n_tokens") > 0, F.ceil((F.col("planned") - F.col("start")) / F.col("tokens"))).otherwise(F.lit(1))
    copies = F.least(F.col("max_repeats"), copies.cast("int"))
    used = docs.withColumn("copies", copies).where("copies > 0 AND start < planned").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    part = (F.col("start") + (F.col("copy_no") - 1) * F.col("tokens")) / F.col("planned")
    used = used.withColumn("position", schedule_inverse(F.least(part, F.lit(1.0)), F.col("segments")))
    return used.select("position", "source", "doc_id", "copy_no", "n_tokens").orderBy("position", "source", "doc_id", "copy_no")


def shares(sizes: DataFrame, targets: DataFrame, schedules: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """The shares really reached by the positions of ``mix``: ``source``, ``target_share``, ``demand``, ``used_tokens``, ``actual_share``, ``documents_used``, ``most_copies``, ``short`` (whether all uses of all documents hold fewer tokens than the demand)."""
    sizes = checkpoint(sizes.select("doc_id", "source", "n_tokens"))
    used = mix(sizes, targets, schedules, bits).groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count_distinct("doc_id").alias("documents_used"), F.max("copy_no").alias("most_copies"))
    rows = plan_mixture(sizes, targets).select("source", "target_share", "demand").join(used, "source", "left").fillna(0, ["used_tokens", "documents_used", "most_copies"])
    whole = F.sum("used_tokens").over(W.partitionBy(F.lit(1)))
    return rows.withColumn("actual_share", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(F.lit(0.0))).withColumn("short", F.col("used_tokens") < F.col("demand"))
