"""Mixing sources to target weights by entropy balancing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, with_rank, word_count

#: Weights of the sources by code point, repeating.
WEIGHTS = (1, 2, 3)
#: No source and no document is taken more often than this.
MOST = 3
#: Partitions over which sources are numbered.
RANGES = 64


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST):
    """Targets of ``totals`` (source, source_size): adds weight and target.

    Sources are numbered by code point, null last. Targets share the sum of all sizes by weight
    and stop at ``most`` times the size; the excess goes to the others by weight until none is
    above. Only sums come to the driver. Sources are numbered within ranges, so they need not fit one task.
    """
    ranged = checkpointed(
        totals.repartitionByRange(RANGES, F.col("source").asc_nulls_last()).withColumn(
            "part", F.spark_partition_id()
        )
    )
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(part, 0)
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    start = F.array(*map(F.lit, starts or [0]))[F.col("part")]
    number = start + F.row_number().over(inside) - 1
    choice = F.array(*map(F.lit, weights))
    weighed = checkpointed(
        ranged.withColumn("weight", choice[F.pmod(number, F.lit(len(weights))).cast("int")]).drop("part")
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while total:
        row = weighed.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("size"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not row["weight"]:
            break
        level = (total - most * (row["size"] or 0)) / row["weight"]
        # A source that is full stays full: the level only rises.
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
        if weighed.where(full).count() == row["n"]:
            break
    capped = (most * F.col("source_size")).cast("double")
    target = F.when(full, capped).otherwise(F.col("weight") * F.lit(float(level)))
    return weighed.withColumn("target", target.cast("double"))


def _rate(tilt: Column, x: Column, most: int) -> Column:
    """exp(tilt * x), at most ``most``; the exponent is cut first, so nothing overflows."""
    return F.exp(F.least(tilt * x, F.lit(float(_log(most))))).cast("double")


def _log(x: float) -> float:
    import math

    return math.log(x)


def balanced_rates(
    classes: DataFrame, targets: DataFrame, most: int = MOST, rounds: int = 200, near: float = 1e-9
) -> DataFrame:
    """Solve the dual of entropy balancing for ``classes`` (source, size, n): adds rate.

    The rates of documents that stay closest to 1 in relative entropy, do not exceed ``most`` and
    meet the token constraint of each source are min(most, exp(tilt * size / mean size)), with one
    tilt per source. Newton steps run for all sources at once; each is one aggregation over
    classes of equal source and size. A step that leaves the bracket of a source is replaced by
    its middle, so the search ends; if it has not after ``rounds`` steps, it raises.
    """
    means = classes.groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean")
    )
    x = F.col("size") / F.col("mean")
    limit = _log(most)
    live = targets.where("source_size > 0").select("source", "source_size", "target")
    state = _meet(live, means).select(
        "*",
        F.lit(0.0).alias("tilt"),
        F.lit(-700.0).alias("low"),
        # At this tilt each document is taken ``most`` times.
        F.lit(limit).cast("double").alias("high"),
    )
    shortest = classes.where("size > 0").groupBy("source").agg(F.min("size").alias("least"))
    state = _meet(state, shortest).withColumn("high", F.lit(limit) * F.col("mean") / F.col("least"))
    state = checkpointed(
        state.withColumn(
            "tilt", F.when(F.col("target") >= most * F.col("source_size"), F.col("high")).otherwise(0.0)
        ).withColumn("low", -F.lit(60.0) * F.col("mean") / F.col("least"))
    )
    for _ in range(rounds):
        rate = _rate(F.col("tilt"), x, most)
        words = F.col("n") * F.col("size")
        sums = (
            _meet(classes.where("size > 0"), state)
            .groupBy("source")
            .agg(
                F.sum(words * rate).alias("got"),
                F.sum(F.when(F.col("tilt") * x < limit, words * x * rate).otherwise(0.0)).alias("slope"),
            )
        )
        both = _meet(state, sums)
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - (F.col("got") - F.col("target")) / F.nullif(F.col("slope"), F.lit(0.0))
        done = F.abs(F.col("got") - F.col("target")) <= near * F.col("target")
        inside = (step > F.col("low")) & (step < F.col("high"))
        state = checkpointed(
            both.withColumn("low", low)
            .withColumn("high", high)
            .withColumn("next", F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
            .withColumn("open", ~done & (F.col("next") != F.col("tilt")))
            .withColumn("tilt", F.when(F.col("open"), F.col("next")).otherwise(F.col("tilt")))
            .drop("got", "slope", "next")
        )
        still = state.where("open").limit(1).count()
        state = state.drop("open")
        if not still:
            break
    else:
        raise RuntimeError(f"tilts still move after {rounds} steps")
    solved = _meet(classes, state.select("source", "mean", "tilt"), "left")
    rate = F.coalesce(_rate(F.col("tilt"), x, most), F.lit(1.0))
    return solved.withColumn("rate", rate).drop("mean", "tilt")


def _meet(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, where null meets null."""
    other = right.withColumnRenamed("source", "_source")
    return left.join(other, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def rounded_copies(rated: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """Whole copies per class: adds copies, the number that the ``n`` documents of a class share.

    Along falling sizes of a source, the running sum of rates is rounded, which leaves an error of
    about the largest size. What is left is settled by the largest class that fits, adding or
    taking copies, until no class fits or the target is met to the word. Each move leaves less, and a
    class of a source moves once at most for each larger one, so this ends by itself.
    """
    along = Window.partitionBy("source").orderBy(F.col("size").desc())
    running = F.sum(F.col("n") * F.col("rate")).over(along)
    whole = rated.withColumn("_to", F.round(running)).withColumn(
        "copies", (F.col("_to") - F.coalesce(F.lag("_to").over(along), F.lit(0.0))).cast("long")
    )
    whole = whole.withColumn("copies", F.least(F.col("copies"), F.col("n") * most)).drop("_to")
    whole = checkpointed(whole)
    goals = targets.select("source", F.round("target").cast("long").alias("goal"))
    while True:
        left = _meet(whole.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got")), goals)
        left = left.select("source", (F.col("goal") - F.col("got")).alias("left"))
        open_ = _meet(whole.where("size > 0"), left)
        room = F.when(F.col("left") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        fits = F.least(room, F.floor(F.abs(F.col("left")) / F.col("size"))) * F.signum("left").cast("long")
        moves = (
            open_.withColumn("by", fits)
            .where("by != 0")
            .groupBy("source")
            .agg(F.max(F.struct("size", "by")).alias("move"))
            .select("source", F.col("move.size").alias("_size"), F.col("move.by").alias("_by"))
        )
        moved = _meet(whole, moves, "left")
        here = F.col("_size").isNotNull() & (F.col("size") == F.col("_size"))
        whole = checkpointed(
            moved.withColumn("copies", F.col("copies") + F.when(here, F.col("_by")).otherwise(0))
            .withColumn("_open", F.col("_by").isNotNull())
            .drop("_size", "_by")
        )
        still = whole.where("_open").limit(1).count()
        whole = whole.drop("_open")
        if not still:
            break
    return whole


def mix_to_targets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    order_col: str | None = None,
) -> DataFrame:
    """One row per input row: ``id_col``, source, size, source_size, target, rate, copies, taken.

    Sources share the number of words of all documents by weight (see ``source_targets``). A
    document of a source is taken ``copies`` times, 0 to ``most``: its exponentially tilted rate,
    rounded so that the words taken from a source meet its target as closely as whole documents
    allow. Within one source and size, the copies that do not come out even go to the first
    documents in the order of a hash of the id, so reruns agree. With ``order_col``, its values give
    that order; the id decides for those that are equal or null.

    A null text has size 0 and is taken once in ``copies`` terms of rate 1, which adds no words;
    a null source is a source of its own, the last one. Repeated rows and equal ids count as
    documents of their own. Empty input gives no rows; other columns are ignored.
    """
    sized = checkpointed(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            *([F.struct(F.col(order_col).alias("by"), F.col(id_col).alias("id")).alias("order")] if order_col else []),
        )
    )
    classes = checkpointed(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = checkpointed(source_targets(totals, weights, most))
    rated = balanced_rates(classes, targets, most)
    whole = rounded_copies(rated, targets, most)
    whole = _meet(whole, targets.select("source", "source_size", "target"))
    if order_col:
        by = F.when(F.col("order")["by"].isNull(), F.xxhash64("id")).otherwise(F.xxhash64(F.col("order")["by"]))
        ranked = with_rank(sized, ["source", "size"], "order", spread=by)
    else:
        ranked = with_rank(sized, ["source", "size"], "id")
    mixed = ranked.join(
        whole.withColumnsRenamed({"source": "_source", "size": "_size"}),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")),
    )
    each = F.floor(F.col("copies") / F.col("n"))
    copies = (each + (F.col("rank") < F.col("copies") - each * F.col("n")).cast("long")).alias("copies")
    return mixed.select(
        F.col("id").alias(id_col), F.col("source"), "size", "source_size", "target", "rate", copies
    ).withColumn("taken", F.col("copies") * F.col("size"))
