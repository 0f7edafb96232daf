"""Distributions: dense histograms, peaks, truncation, weighted figures, local minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """`value`, `n` per key; nulls are left out."""
    return values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("bigint").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def dense(hist: DataFrame, key: str) -> DataFrame:
    """The histogram with its empty bins between the lowest and the highest value, per key."""
    ends = hist.groupBy(key).agg(F.min("value").alias("_a"), F.max("value").alias("_b"))
    bins = ends.select(key, F.explode(F.sequence("_a", "_b")).alias("value"))
    return bins.join(hist, [key, "value"], "left").fillna(0, ["n"])


def peaks(hist: DataFrame, key: str, half: int = 50) -> DataFrame:
    """The value around which a window of 2 half + 1 bins holds most rows (lowest of a tie), with that sum.

    The sum only rises where a value enters the window, so that the lowest best place is `half` below a value (or the lowest
    value): only these places are looked at, not every bin up to the highest value.
    """
    low = hist.groupBy(key).agg(F.min("value").alias("_lo"))
    places = hist.join(low, key).select(key, F.greatest(F.col("value") - half, F.col("_lo")).alias("value")).distinct()
    rows = hist.select(key, "value", "n", F.lit(False).alias("_at")).unionByName(places.select(key, "value", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("_at")))
    sums = rows.withColumn("mass", F.sum("n").over(Window.partitionBy(key).orderBy("value").rangeBetween(-half, half))).where("_at")
    return sums.groupBy(key).agg(F.max(F.struct("mass", (-F.col("value")).alias("v"))).alias("m")).select(key, (-F.col("m.v")).alias("peak"), F.col("m.mass").alias("mass"))


def bounded_figures(hist: DataFrame, peak: DataFrame, key: str, low: float = 0.25, high: float = 1.75) -> DataFrame:
    """Rows, weighted mean and sample deviation of the values within [low, high] times the peak (6 digits)."""
    rows = hist.join(peak.select(key, "peak"), key).where((F.col("value") >= low * F.col("peak")) & (F.col("value") <= high * F.col("peak")))
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("value"))
    mean = rows.groupBy(key).agg(n.alias("rows"), (s / n).alias("_m"))
    dev = F.sum(F.col("n") * F.pow(F.col("value") - F.col("_m"), 2))
    return rows.join(mean, key).groupBy(key, "rows").agg(F.round(F.max("_m"), 6).alias("mean"), F.when(F.col("rows") > 1, F.round(F.sqrt(dev / (F.col("rows") - 1)), 6)).alias("deviation"))


def truncated(hist: DataFrame, key: str, edge: float = 0.05) -> DataFrame:
    """The histogram without the values whose cumulated share of rows, from either end, stays below `edge`."""
    up, down = Window.partitionBy(key).orderBy("value"), Window.partitionBy(key).orderBy(F.desc("value"))
    rows = hist.withColumn("_all", F.sum("n").over(Window.partitionBy(key))).withColumn("_lo", F.sum("n").over(up)).withColumn("_hi", F.sum("n").over(down))
    return rows.where((F.col("_lo") >= edge * F.col("_all")) & (F.col("_hi") >= edge * F.col("_all"))).select(key, "value", "n")


def position_normalised(hist: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Frequencies divided by the number of places a fragment of that length has on the contigs, rescaled to the same total.

    The places come from sums over the distinct lengths not below the value, so that no fragment meets every contig.
    """
    per = lengths.where("len > 0").groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    axis = per.select(F.col("len").alias("v"), F.col("c"), (F.col("c") * (F.col("len") + 1)).alias("s")).unionByName(hist.select(F.col("value").alias("v")).distinct().select("v", F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("s")))
    tot = axis.groupBy("v").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    w = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    places = tot.select(F.col("v").alias("value"), (F.sum("s").over(w) - F.col("v") * F.sum("c").over(w)).alias("places"))
    rows = hist.join(places, "value").where("places > 0").withColumn("_f", F.col("n") / F.col("places"))
    total = rows.groupBy(key).agg(F.sum("n").alias("_n"), F.sum("_f").alias("_t"))
    return rows.join(total, key).select(key, "value", "n", "places", F.round(F.col("_f") / F.col("_t") * F.col("_n"), 6).alias("normalised"))


def left_minimum(hist: DataFrame, window: int = 3) -> DataFrame:
    """The first value at which the sum over the next `window` bins stops falling: one row `value`, `mass`; none for no rows.

    `hist` has `value` and `n`, few distinct values (occurrence counts).
    """
    one = dense(hist.withColumn("_k", F.lit(0)), "_k")
    w = Window.partitionBy("_k").orderBy("value")
    rows = one.withColumn("mass", F.sum("n").over(w.rangeBetween(0, window - 1))).withColumn("_next", F.lead("mass").over(w))
    return rows.where("_next >= mass OR _next IS NULL").groupBy("_k").agg(F.min(F.struct("value", "mass")).alias("m")).select("m.value", "m.mass")


def length_quantiles(rows: DataFrame, ps: tuple[float, ...]) -> DataFrame:
    """`p`, `len`: the lowest length that a share p of the rows does not exceed. Lengths are counted before they are ordered."""
    by = rows.groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    total = by.agg(F.sum("c")).scalar()
    run = by.withColumn("_run", F.sum("c").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    return run.where(F.col("_run") >= F.greatest(F.ceil(F.col("p") * total), F.lit(1))).groupBy("p").agg(F.min("len").alias("len"))


def weighted_mean(nodes: DataFrame, keep: str = "true") -> DataFrame:
    """Length-weighted coverage of the nodes, and again of those within half and twice it (two passes), 6 digits."""
    rows = nodes.where("len > 0").where(keep)
    first = rows.agg((F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("m")).scalar()
    inner = F.when(F.col("cov").between(first / 2, first * 2), F.col("len"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("cov") * F.col("len")) / F.sum("len"), 6).alias("mean"), F.round(F.sum(F.col("cov") * inner) / F.sum(inner), 6).alias("bounded_mean"))
