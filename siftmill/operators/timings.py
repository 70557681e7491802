"""Overhead of observing, from timing vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed value: what the four places of a timing vector hold.
SERIES = ["bare", "no_op", "full", "optimised"]

PERCENTILES = (5, 25, 50, 75, 95)

WHOLE_BELOW = 20_000
SLACK = 0.001


def timing_pairs(timings: DataFrame) -> DataFrame:
    """(run, series, bare, time, ratio): every variant next to the bare run time."""
    bare = F.col("times")[0]

    def variant(place: int) -> Column:
        time = F.col("times")[place]
        return F.struct(F.lit(SERIES[place]).alias("series"), bare.alias("bare"), time.alias("time"), F.try_divide(time, bare).alias("ratio"))

    return timings.select("run", F.inline(F.array(*map(variant, range(1, len(SERIES))))))


def timing_summary(pairs: DataFrame) -> DataFrame:
    """Overhead per series; the percentiles are within a thousandth of the ranks."""
    return pairs.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("time").alias("mean_time"),
        F.avg("ratio").alias("mean_ratio"),
        F.min("ratio").alias("min_ratio"),
        F.max("ratio").alias("max_ratio"),
        *[F.percentile_approx("ratio", p / 100, 1000).alias(f"p{p}_ratio") for p in PERCENTILES],
    )


def timing_percentiles(pairs: DataFrame, whole_below: int = WHOLE_BELOW, slack: float = SLACK) -> DataFrame:
    """Exact percentiles of the overhead per series, between two ratios in proportion.

    A sketch gives, for every percentile, two ratios between which its rank
    lies for certain. What lies below is only counted; the ratios in between,
    some ``2 * slack`` of a series, are counted by value and walked in order to
    the rank. Series of fewer than ``whole_below`` ratios are walked as a whole.
    """
    rows = pairs.where(F.col("ratio").isNotNull()).select("series", "ratio")
    marks = [min(1.0, max(0.0, p / 100 + side)) for p in PERCENTILES for side in (-slack, slack)]
    accuracy = int(2 / slack)  # ranks of the sketch are off by half the slack at most
    sketch = rows.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("ratio", marks, accuracy).alias("marks"),
        F.min("ratio").alias("least"),
        F.max("ratio").alias("most"),
    )
    whole = F.col("n") < whole_below

    def bracket(place: int, percentile: int) -> Column:
        rank = (F.col("n") - 1) * (percentile / 100)
        return F.struct(
            F.lit(percentile).alias("p"),
            F.when(whole, F.col("least")).otherwise(F.col("marks")[2 * place]).alias("low"),
            F.when(whole, F.col("most")).otherwise(F.col("marks")[2 * place + 1]).alias("high"),
            rank.alias("rank"),
        )

    brackets = sketch.select("series", F.array(*[bracket(i, p) for i, p in enumerate(PERCENTILES)]).alias("brackets"))
    # one row for each series that timing vectors have, so the broadcast is bounded
    placed = rows.where(F.col("series").isin(SERIES)).join(F.broadcast(brackets), "series")
    below = placed.groupBy("series").agg(
        *[F.count_if(F.col("ratio") < F.col("brackets")[i]["low"]).alias(f"below{p}") for i, p in enumerate(PERCENTILES)]
    )
    below = below.select("series", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"below{p}").alias("below")) for p in PERCENTILES])))
    inside = F.filter("brackets", lambda b: (F.col("ratio") >= b["low"]) & (F.col("ratio") <= b["high"]))
    values = (
        placed.select("series", "ratio", F.explode(inside).alias("b"))
        .groupBy("series", F.col("b.p").alias("p"), F.col("b.rank").alias("rank"), "ratio")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    upto = F.sum("copies").over(Window.partitionBy("series", "p").orderBy("ratio")) + F.col("below")
    walked = values.join(below, ["series", "p"]).withColumn("upto", upto)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("ratio")))

    # the ratios at the whole ranks around the wanted one
    around = walked.groupBy("series", "p", "rank").agg(at(F.floor("rank")).alias("lower"), at(F.ceil("rank")).alias("upper"))
    share = F.col("rank") - F.floor("rank")
    value = F.when(share == 0, F.col("lower")).otherwise((1 - share) * F.col("lower") + share * F.col("upper"))
    return around.withColumn("value", value).groupBy("series").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}_ratio") for p in PERCENTILES]
    )
