"""Positional signals: depth by events, islands, low regions, spanned gaps and binned contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions are handled in stretches of so many bases, so that no task orders the events of a whole long sequence.
STRETCH = 1 << 20


def depth(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Depth over [start, end) intervals as maximal segments: `key`, `seg_start`, `seg_end`, `depth` (> 0).

    Events of one position are added first. The running sum goes in two steps: within stretches of STRETCH bases, on top of
    the stretches' totals. Empty or reversed intervals count nothing.
    """
    good = intervals.where(F.col(start) < F.col(end))
    event = lambda c, d: good.select(F.col(key).alias("k"), F.col(c).cast("bigint").alias("p"), F.lit(d).cast("bigint").alias("d"))
    ev = event(start, 1).unionByName(event(end, -1)).groupBy("k", "p").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("s", F.floor(F.col("p") / STRETCH))
    totals = ev.groupBy("k", "s").agg(F.sum("d").alias("t"), F.min("p").alias("first"))
    by = Window.partitionBy("k").orderBy("s")
    base = totals.select("k", "s", F.coalesce(F.sum("t").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("first").over(by).alias("next"))
    w = Window.partitionBy("k", "s").orderBy("p")
    rows = ev.join(base, ["k", "s"]).select("k", F.col("p").alias("seg_start"), F.coalesce(F.lead("p").over(w), F.col("next")).alias("seg_end"), (F.col("base") + F.sum("d").over(w)).alias("depth"))
    return rows.where("depth > 0").select(F.col("k").alias(key), "seg_start", "seg_end", "depth")


def islands(intervals: DataFrame, key: str, start: str, end: str, join_within: int = 0) -> DataFrame:
    """Unions of intervals that overlap or lie at most `join_within` apart: `key`, `island_start`, `island_end`, `n`.

    Intervals are first united within stretches of their starts, so that a whole sequence is ordered by unions only.
    """
    rows = intervals.where(F.col(start) < F.col(end)).select(F.col(key).alias("k"), F.col(start).alias("a"), F.col(end).alias("b"), F.lit(1).cast("bigint").alias("n"), F.floor(F.col(start) / STRETCH).alias("s"))
    for keys in (["k", "s"], ["k"]):
        w = Window.partitionBy(*keys).orderBy("a", "b")
        upto = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = rows.withColumn("_new", F.when(upto.isNull() | (F.col("a") > upto + join_within), 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = new.groupBy(*keys, "_i").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).drop("_i")
    return rows.select(F.col("k").alias(key), F.col("a").alias("island_start"), F.col("b").alias("island_end"), "n")


def depth_summary(segments: DataFrame, key: str) -> DataFrame:
    """Covered bases, base-weighted mean depth and the median depth (lowest that half of the covered bases do not exceed)."""
    n = F.col("seg_end") - F.col("seg_start")
    by = segments.groupBy(key, "depth").agg(F.sum(n).alias("n"))
    run = by.withColumn("_run", F.sum("n").over(Window.partitionBy(key).orderBy("depth"))).withColumn("_all", F.sum("n").over(Window.partitionBy(key)))
    return run.groupBy(key).agg(
        F.sum("n").alias("covered"), F.round(F.sum(F.col("n") * F.col("depth")) / F.sum("n"), 6).alias("mean_depth"), F.min(F.when(F.col("_run") * 2 >= F.col("_all"), F.col("depth"))).alias("median_depth")
    )


def low_segments(segments: DataFrame, summary: DataFrame, key: str, rate: float = 0.5, min_len: int = 20) -> DataFrame:
    """Segments of at least `min_len` bases whose depth is below `rate` times the sequence's median: where to break it."""
    rows = segments.join(summary.select(key, "median_depth"), key)
    return rows.where((F.col("depth") < rate * F.col("median_depth")) & (F.col("seg_end") - F.col("seg_start") >= min_len)).select(key, "seg_start", "seg_end", "depth", "median_depth")


def gap_compensated(segments: DataFrame, clean: DataFrame, key: str, window: int = 1000) -> DataFrame:
    """Depth per window of `window` bases, scaled by the window's share of bases that are not N.

    `clean` has `key` and `bases`. Windows without clean bases have scaled depth null.
    """
    cut_at = segments.select(key, "depth", "seg_start", "seg_end", F.explode(F.sequence(F.floor(F.col("seg_start") / window), F.floor((F.col("seg_end") - 1) / window))).alias("win"))
    part = F.least("seg_end", (F.col("win") + 1) * window) - F.greatest("seg_start", F.col("win") * window)
    sums = cut_at.groupBy(key, "win").agg(F.sum(part * F.col("depth")).alias("mass"))
    wins = clean.where("bases <> ''").select(key, "bases", F.explode(F.sequence(F.lit(0), F.floor((F.length("bases") - 1) / window))).alias("win"))
    text = F.expr(f"substring(bases, cast(win * {window} + 1 as int), {window})")
    rows = wins.select(key, F.col("win").cast("bigint").alias("win"), F.length(text).alias("n"), F.length(F.translate(text, "N", "")).alias("n_clean"))
    return rows.join(sums, [key, "win"], "left").select(
        key, "win", F.round(F.coalesce("mass", F.lit(0)) / F.col("n"), 6).alias("depth"), F.round(F.coalesce("mass", F.lit(0)) / F.nullif("n_clean", F.lit(0)), 6).alias("scaled_depth")
    )


def lift(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs with both places on one scaffold: places lifted from contigs to the scaffold, `low` <= `high`.

    Contigs placed more than once are left out. A place on a reversed part counts from the part's end.
    """
    once = parts.groupBy("contig_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("contig_id")
    at = parts.join(once, "contig_id", "left_semi").select("contig_id", "scaffold_id", "strand", "comp_start", "comp_end")
    def side(i):
        p = at.select(*[F.col(c).alias(f"{c}{i}") for c in at.columns])
        pos = F.when(F.col(f"strand{i}") == "-", F.col(f"comp_end{i}") - 1 - F.col(f"place{i}")).otherwise(F.col(f"comp_start{i}") + F.col(f"place{i}"))
        return p, pos.alias(f"pos{i}")
    (p1, e1), (p2, e2) = side(1), side(2)
    rows = pairs.join(p1, F.abs("id1") == F.col("contig_id1")).join(p2, F.abs("id2") == F.col("contig_id2")).where("scaffold_id1 = scaffold_id2")
    rows = rows.select("lib_no", "pair_id", F.col("scaffold_id1").alias("scaffold_id"), e1, e2)
    return rows.select("lib_no", "pair_id", "scaffold_id", F.least("pos1", "pos2").alias("low"), F.greatest("pos1", "pos2").alias("high"))


def spanned_gaps(lifted: DataFrame, gaps: DataFrame, longest: int = 20_000, bin_width: int = 10_000) -> DataFrame:
    """How many pairs (of at most `longest` bases) span each gap; gaps nobody spans have 0. Joined by bins of positions."""
    near = lifted.where(F.col("high") - F.col("low") <= longest).select("scaffold_id", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / bin_width), F.floor(F.col("high") / bin_width))).alias("bin"))
    g = gaps.withColumn("bin", F.floor(F.col("gap_start") / bin_width))
    hits = g.join(near, ["scaffold_id", "bin"]).where("low < gap_start AND high >= gap_end").groupBy("scaffold_id", "gap_no").agg(F.count(F.lit(1)).alias("n_pairs"))
    return gaps.select("scaffold_id", "gap_no", "gap_start", "gap_end").join(hits, ["scaffold_id", "gap_no"], "left").fillna(0, ["n_pairs"])


def contact_map(lifted: DataFrame, width: int = 1000) -> DataFrame:
    """Sparse contacts `scaffold_id`, `i` <= `j`, `n` of position bins."""
    return lifted.groupBy("scaffold_id", F.floor(F.col("low") / width).alias("i"), F.floor(F.col("high") / width).alias("j")).agg(F.count(F.lit(1)).alias("n"))


def ideal_contact(contacts: DataFrame, lengths: DataFrame, width: int = 1000) -> DataFrame:
    """Mean contacts per bin distance over all scaffolds, cells without contact included: `distance`, `cells`, `n`, `mean`."""
    bins = lengths.where("len > 0").groupBy(F.ceil(F.col("len") / width).alias("b")).agg(F.count(F.lit(1)).alias("m"))
    cells = bins.select("m", "b", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("distance")).groupBy("distance").agg(F.sum(F.col("m") * (F.col("b") - F.col("distance"))).alias("cells"))
    got = contacts.groupBy((F.col("j") - F.col("i")).alias("distance")).agg(F.sum("n").alias("n"))
    return cells.join(got, "distance", "left").select("distance", "cells", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("cells"), 9).alias("mean"))


def end_scores(pairs: DataFrame, contigs: DataFrame, reach: int = 500) -> DataFrame:
    """Contact evidence between contig ends: pairs within `reach` of an end each, weighted by linear decay.

    `a` < `b`, `side_a`, `side_b` (L or R), `n`, `score` (6 digits). A place is counted to its nearer end.
    """
    n = contigs.select("contig_id", "len")
    def end(i):
        c = n.select(F.col("contig_id").alias(f"c{i}"), F.col("len").alias(f"n{i}"))
        left, right = F.col(f"place{i}"), F.col(f"n{i}") - 1 - F.col(f"place{i}")
        return c, F.least(left, right).alias(f"d{i}"), F.when(left <= right, "L").otherwise("R").alias(f"s{i}")
    (c1, d1, s1), (c2, d2, s2) = end(1), end(2)
    rows = pairs.where("abs(id1) <> abs(id2)").join(c1, F.abs("id1") == F.col("c1")).join(c2, F.abs("id2") == F.col("c2")).select("c1", "c2", d1, s1, d2, s2)
    rows = rows.where((F.col("d1") < reach) & (F.col("d2") < reach) & (F.col("d1") >= 0) & (F.col("d2") >= 0))
    swap = F.col("c1") > F.col("c2")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    value = (1 - F.col("d1") / reach) * (1 - F.col("d2") / reach)
    return rows.groupBy(pick("c1", "c2").alias("a"), pick("c2", "c1").alias("b"), pick("s1", "s2").alias("side_a"), pick("s2", "s1").alias("side_b")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("score"))


def contact_boundaries(contacts: DataFrame, reach: int = 3) -> DataFrame:
    """Per boundary between bins, contacts of up to `reach` bins apart that cross it and such contacts that end on either side of it.

    `boundary` is the lower bin's number plus one; `separation` = inside / (inside + crossing), 6 digits: near 1 where the map falls
    into two blocks. Every cell of the map meets at most 2 reach + 2 boundaries.
    """
    cells = contacts.where(F.col("j") - F.col("i") <= reach)
    at = cells.select("scaffold_id", "i", "j", "n", F.explode(F.sequence(F.greatest(F.col("j") - reach + 1, F.lit(1)), F.col("i") + reach)).alias("boundary"))
    cross = (F.col("i") < F.col("boundary")) & (F.col("j") >= F.col("boundary"))
    got = at.groupBy("scaffold_id", "boundary").agg(F.sum(F.when(cross, F.col("n")).otherwise(0)).alias("crossing"), F.sum(F.when(cross, 0).otherwise(F.col("n"))).alias("inside"))
    return got.withColumn("separation", F.round(F.col("inside") / (F.col("inside") + F.col("crossing")), 6))
