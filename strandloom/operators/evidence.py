"""Evidence for and against what is joined: concordant and discordant depth, spanned gaps, switches, contacts and diploid nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.coverage import STRETCH
from strandloom.operators.nodes import node_lengths, placed_once

# ---- depth of two kinds ----


def concordant(pairs: DataFrame, libraries: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Intervals of pairs that face each other on one contig with an insert within `tolerance` deviations of the library's mean."""
    lib = F.broadcast(libraries.where("avg_ins > 0 AND sd_ins > 0").select("lib_no", "avg_ins", "sd_ins"))
    n = F.abs(F.col("place1") - F.col("place2")) + 1
    rows = pairs.where("id1 = -id2").join(lib, "lib_no").where(F.abs(n - F.col("avg_ins")) <= tolerance * F.col("sd_ins"))
    return rows.select(F.abs("id1").alias("contig_id"), F.least("place1", "place2").alias("a"), (F.greatest("place1", "place2") + 1).alias("b"))


def discordant(pairs: DataFrame, contigs: DataFrame, libraries: DataFrame, least: int = 500) -> DataFrame:
    """Where a fragment should go on beyond a mate whose other mate lies on another contig of at least `least` bases.

    From one read length behind the mate's first base over one insert, cut to the contig.
    """
    lib = F.broadcast(libraries.where("avg_ins > 0 AND read_len > 0").select("lib_no", "avg_ins", "read_len"))
    rows = pairs.where("abs(id1) <> abs(id2)").join(lib, "lib_no")
    len_of = lambda i: contigs.select(F.col("contig_id").alias(f"c{i}"), F.col("len").alias(f"l{i}"))
    rows = rows.join(len_of(1), F.abs("id1") == F.col("c1")).join(len_of(2), F.abs("id2") == F.col("c2"))

    def side(i: int, j: int) -> DataFrame:
        p, top = F.col(f"place{i}"), F.col(f"l{i}") - 1
        clip = lambda x: F.least(F.greatest(x, F.lit(0)), top)
        ahead = F.col(f"id{i}") > 0
        a = F.when(ahead, clip(p + F.col("read_len"))).otherwise(clip(p - F.col("read_len") - F.col("avg_ins") + 1))
        b = F.when(ahead, clip(p + F.col("read_len") + F.col("avg_ins"))).otherwise(clip(p - F.col("read_len")))
        return rows.where(f"l{j} >= {least}").select(F.col(f"c{i}").alias("contig_id"), a.cast("bigint").alias("a"), (b + 1).cast("bigint").alias("b"))

    return side(1, 2).unionByName(side(2, 1))


def long_discordant(hits: DataFrame, contigs: DataFrame, least: int = 100) -> DataFrame:
    """Where a long read and a contig both go on beyond a hit's end, by at least `least` bases, without matching: the shorter of both rests."""
    ids = contigs.where("name IS NOT NULL").groupBy("name").agg(F.min("contig_id").alias("contig_id"))
    h = hits.join(ids, hits["t_name"] == ids["name"])
    turned = F.col("strand") == "-"
    left_q, right_q = F.when(turned, F.col("q_len") - F.col("q_end")).otherwise(F.col("q_start")), F.when(turned, F.col("q_start")).otherwise(F.col("q_len") - F.col("q_end"))
    left = h.select("contig_id", (F.col("t_start") - F.least("t_start", left_q)).alias("a"), F.col("t_start").alias("b"))
    right = h.select("contig_id", F.col("t_end").alias("a"), (F.col("t_end") + F.least(F.col("t_len") - F.col("t_end"), right_q)).alias("b"))
    return left.unionByName(right).where(F.col("b") - F.col("a") >= least)


def two_depths(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Segments of constant depth of two sets of intervals (`key`, `a`, `b`): `seg_start`, `seg_end`, `depth`, `against`; not both 0.

    As in `coverage.depth`, events of a position are added first and running sums go in two steps, within stretches and over them.
    """
    ev = lambda df, c, x, y: df.where("a < b").select(F.col(key).alias("k"), F.col(c).cast("bigint").alias("p"), F.lit(x).cast("bigint").alias("x"), F.lit(y).cast("bigint").alias("y"))
    rows = ev(one, "a", 1, 0).unionByName(ev(one, "b", -1, 0)).unionByName(ev(other, "a", 0, 1)).unionByName(ev(other, "b", 0, -1))
    rows = rows.groupBy("k", "p").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).where("x <> 0 OR y <> 0").withColumn("s", F.floor(F.col("p") / STRETCH))
    by, w = Window.partitionBy("k").orderBy("s"), Window.partitionBy("k", "s").orderBy("p")
    upto = lambda c: F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("k", "s").agg(F.sum("x").alias("tx"), F.sum("y").alias("ty"), F.min("p").alias("first"))
    base = totals.select("k", "s", upto("tx").alias("bx"), upto("ty").alias("by"), F.lead("first").over(by).alias("next"))
    seg = rows.join(base, ["k", "s"]).select(F.col("k").alias(key), F.col("p").alias("seg_start"), F.coalesce(F.lead("p").over(w), F.col("next")).alias("seg_end"), (F.col("bx") + F.sum("x").over(w)).alias("depth"), (F.col("by") + F.sum("y").over(w)).alias("against"))
    return seg.where("depth > 0 OR against > 0")


def breakpoints(segments: DataFrame, lengths: DataFrame, edge: int = 50, rate: float = 0.5, against: float = 1.0, least: int = 10) -> DataFrame:
    """Runs of at least `least` bases, off the `edge` bases at either end, whose depth is below `rate` times the median and whose
    evidence against exceeds `against` times the depth: `contig_id`, `run_start`, `run_end`.

    The median is that of all bases between the edges, uncovered ones included; contigs of up to two edges have no runs.
    """
    n = lengths.select("contig_id", "len").where(F.col("len") > 2 * edge)
    seg = segments.join(n, "contig_id").select("contig_id", "len", F.greatest("seg_start", F.lit(edge)).alias("a"), F.least("seg_end", F.col("len") - edge).alias("b"), "depth", "against").where("a < b")
    by = seg.where("depth > 0").groupBy("contig_id", "depth", "len").agg(F.sum(F.col("b") - F.col("a")).alias("m"))
    run = by.withColumn("_run", F.sum("m").over(Window.partitionBy("contig_id").orderBy("depth"))).withColumn("_all", F.sum("m").over(Window.partitionBy("contig_id")))
    size, zeros = F.col("len") - 2 * edge, F.col("len") - 2 * edge - F.col("_all")
    median = run.where(F.col("_run") + zeros > F.floor(size / 2)).groupBy("contig_id").agg(F.min(F.when(zeros > F.floor(size / 2), F.lit(0)).otherwise(F.col("depth"))).alias("median"))
    bad = seg.join(median, "contig_id").where((F.col("depth") < rate * F.col("median")) & (F.col("against") > against * F.col("depth")))
    w = Window.partitionBy("contig_id").orderBy("a")
    new = bad.withColumn("_new", F.when(F.lag("b").over(w) == F.col("a"), 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = new.groupBy("contig_id", "_g").agg(F.min("a").alias("run_start"), F.max("b").alias("run_end")).drop("_g")
    return runs.where(F.col("run_end") - F.col("run_start") >= least)


def broken_pieces(lengths: DataFrame, runs: DataFrame) -> DataFrame:
    """Sequences divided in the middle of their breakpoint runs: `contig_id`, `piece_no` from 1, `piece_start`, `piece_end`."""
    cuts = runs.select("contig_id", F.floor((F.col("run_start") + F.col("run_end")) / 2).alias("at")).unionByName(lengths.where("len > 0").select("contig_id", F.lit(0).cast("bigint").alias("at")))
    w = Window.partitionBy("contig_id").orderBy("at")
    rows = cuts.join(lengths.select("contig_id", "len"), "contig_id")
    return rows.select("contig_id", F.row_number().over(w).alias("piece_no"), F.col("at").alias("piece_start"), F.coalesce(F.lead("at").over(w), "len").alias("piece_end"))


# ---- gaps and joins ----


def below(points: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """`key`, `q` and `n`: how many of the points (`key`, `p`) lie below each distinct query position `q`. In two steps, as `two_depths`."""
    rows = points.groupBy(key, F.col("p").alias("x")).agg(F.count(F.lit(1)).alias("c")).withColumn("kind", F.lit(1)).unionByName(queries.select(key, F.col("q").alias("x")).distinct().withColumns({"c": F.lit(0).cast("bigint"), "kind": F.lit(0)}))
    rows = rows.withColumn("s", F.floor(F.col("x") / STRETCH))
    totals = rows.groupBy(key, "s").agg(F.sum("c").alias("t"))
    base = totals.select(key, "s", F.coalesce(F.sum("t").over(Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = F.sum("c").over(Window.partitionBy(key, "s").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("u", upto).where("kind = 0").join(base, [key, "s"]).select(key, F.col("x").alias("q"), (F.col("base") + F.col("u")).alias("n"))


def spanning(intervals: DataFrame, gaps: DataFrame) -> DataFrame:
    """How many intervals (`scaffold_id`, `low`, `high`) of any length span each gap: low < gap_start and high >= gap_end.

    Those that begin below the gap, less those that end below its end, but for those that lie inside it; only these are joined.
    """
    lows, highs = intervals.select("scaffold_id", F.col("low").alias("p")), intervals.select("scaffold_id", F.col("high").alias("p"))
    a = below(lows, gaps.select("scaffold_id", F.col("gap_start").alias("q")), "scaffold_id").select("scaffold_id", F.col("q").alias("gap_start"), F.col("n").alias("n_a"))
    b = below(highs, gaps.select("scaffold_id", F.col("gap_end").alias("q")), "scaffold_id").select("scaffold_id", F.col("q").alias("gap_end"), F.col("n").alias("n_b"))
    width = 1000
    bins = gaps.select("scaffold_id", "gap_no", "gap_start", "gap_end", F.explode(F.sequence(F.floor(F.col("gap_start") / width), F.floor((F.col("gap_end") - 1) / width))).alias("bin"))
    inside = bins.join(intervals.withColumn("bin", F.floor(F.col("low") / width)), ["scaffold_id", "bin"]).where("low >= gap_start AND high < gap_end").groupBy("scaffold_id", "gap_no").agg(F.count(F.lit(1)).alias("n_in"))
    rows = gaps.select("scaffold_id", "gap_no", "gap_start", "gap_end").join(a, ["scaffold_id", "gap_start"], "left").join(b, ["scaffold_id", "gap_end"], "left").join(inside, ["scaffold_id", "gap_no"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("scaffold_id", "gap_no", "gap_start", "gap_end", (zero("n_a") - zero("n_b") + zero("n_in")).cast("bigint").alias("n"))


def lifted_reads(hits: DataFrame, contigs: DataFrame, parts: DataFrame) -> DataFrame:
    """The extent of every long read on every scaffold: `q_name`, `scaffold_id`, `low`, `high`, from its hits on contigs placed once."""
    ids = contigs.where("name IS NOT NULL").groupBy("name").agg(F.min("contig_id").alias("contig_id"))
    at = placed_once(parts).select("contig_id", "scaffold_id", F.col("strand").alias("s"), "comp_start", "comp_end")
    rows = hits.join(ids, hits["t_name"] == ids["name"]).join(at, "contig_id")
    lo = F.when(F.col("s") == "-", F.col("comp_end") - F.col("t_end")).otherwise(F.col("comp_start") + F.col("t_start"))
    hi = F.when(F.col("s") == "-", F.col("comp_end") - F.col("t_start")).otherwise(F.col("comp_start") + F.col("t_end"))
    return rows.groupBy("q_name", "scaffold_id").agg(F.min(lo).alias("low"), F.max(hi).alias("high"))


def join_evidence(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Every join of two parts that follow each other: links between the two sides of the join, and links of the two parts to contigs
    of other scaffolds. `part_no` is the later part's; contigs placed once count."""
    w = Window.partitionBy("scaffold_id").orderBy("part_no", "comp_start", "comp_end", "contig_ref")
    order = parts.select("scaffold_id", "part_no", "contig_id", F.row_number().over(w).alias("i"))
    once = placed_once(order)
    end = lambda k: once.select(F.col("contig_id").alias(f"c{k}"), F.col("scaffold_id").alias(f"s{k}"), F.col("i").alias(f"i{k}"))
    both = links.select(F.abs("id1").alias("c1"), F.abs("id2").alias("c2")).join(end(1), "c1").join(end(2), "c2")
    same = both.where("s1 = s2 AND i1 <> i2").select(F.col("s1").alias("scaffold_id"), F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b"))
    steps = same.select("scaffold_id", (F.col("a") + 1).alias("i"), F.lit(1).alias("d")).unionByName(same.select("scaffold_id", (F.col("b") + 1).alias("i"), F.lit(-1).alias("d"))).groupBy("scaffold_id", "i").agg(F.sum("d").alias("d"))
    away = both.where("s1 <> s2")
    off = away.select(F.col("s1").alias("scaffold_id"), F.col("i1").alias("i")).unionByName(away.select(F.col("s2").alias("scaffold_id"), F.col("i2").alias("i"))).groupBy("scaffold_id", "i").agg(F.count(F.lit(1)).alias("o"))
    by = Window.partitionBy("scaffold_id").orderBy("i")
    rows = order.join(steps, ["scaffold_id", "i"], "left").join(off, ["scaffold_id", "i"], "left").withColumn("n_spanning", F.coalesce(F.sum("d").over(by), F.lit(0)))
    rows = rows.withColumn("n_erroneous", F.coalesce("o", F.lit(0)) + F.coalesce(F.lag("o").over(by), F.lit(0)))
    return rows.where("i > 1").select("scaffold_id", "part_no", "i", F.col("n_spanning").cast("bigint").alias("n_spanning"), F.col("n_erroneous").cast("bigint").alias("n_erroneous"))


def divide_by_evidence(evidence: DataFrame, parts: DataFrame) -> DataFrame:
    """Scaffolds cut at joins with more evidence against than for them: `piece_no` from 1, parts and extent."""
    w = Window.partitionBy("scaffold_id").orderBy("part_no", "comp_start", "comp_end", "contig_ref")
    cuts = evidence.where("n_erroneous > n_spanning").select("scaffold_id", "i", F.lit(1).alias("_cut"))
    rows = parts.select("scaffold_id", "comp_start", "comp_end", F.row_number().over(w).alias("i")).join(cuts, ["scaffold_id", "i"], "left")
    at = rows.withColumn("piece_no", 1 + F.coalesce(F.sum("_cut").over(Window.partitionBy("scaffold_id").orderBy("i")), F.lit(0)))
    return at.groupBy("scaffold_id", "piece_no").agg(F.count(F.lit(1)).alias("n_parts"), F.min("comp_start").alias("piece_start"), F.max("comp_end").alias("piece_end"))


def switch_links(links: DataFrame, parts: DataFrame, alleles: DataFrame) -> DataFrame:
    """Per scaffold: links within it, and links that lead from it to the allele of one of its contigs instead (switch errors)."""
    at = placed_once(parts).select("contig_id", "scaffold_id")
    end = lambda k: at.select(F.col("contig_id").alias(f"c{k}"), F.col("scaffold_id").alias(f"s{k}"))
    rows = links.select(F.abs("id1").alias("c1"), F.abs("id2").alias("c2"))
    both = rows.unionByName(rows.select(F.col("c2").alias("c1"), F.col("c1").alias("c2"))).join(end(1), "c1").join(end(2), "c2", "left")
    mate = alleles.select(F.col("contig_id").alias("c2"), F.col("partner").alias("p")).join(at.select(F.col("contig_id").alias("p"), F.col("scaffold_id").alias("sp")), "p").select("c2", "sp")
    got = both.join(mate, "c2", "left")
    return got.groupBy(F.col("s1").alias("scaffold_id")).agg(F.floor(F.count_if(F.col("s1") == F.col("s2")) / 2).cast("bigint").alias("n_inside"), F.count_if((F.col("sp") == F.col("s1")) & (F.col("s2").isNull() | (F.col("s2") != F.col("s1")))).alias("n_switch"))


# ---- contacts ----


def node_contacts(pairs: DataFrame, parts: DataFrame, width: int = 1000) -> DataFrame:
    """Contacts between different scaffolds by bins of their positions: `a` < `b`, `i`, `j`, `n`; contigs placed once count."""
    at = placed_once(parts).select("contig_id", "scaffold_id", "strand", "comp_start", "comp_end")

    def side(k: int) -> DataFrame:
        pos = F.when(F.col("strand") == "-", F.col("comp_end") - 1 - F.col("p")).otherwise(F.col("comp_start") + F.col("p"))
        rows = pairs.select("lib_no", "pair_id", F.abs(f"id{k}").alias("contig_id"), F.col(f"place{k}").alias("p")).join(at, "contig_id")
        return rows.select("lib_no", "pair_id", F.col("scaffold_id").alias(f"s{k}"), F.floor(pos / width).alias(f"b{k}"))

    both = side(1).join(side(2), ["lib_no", "pair_id"]).where("s1 <> s2")
    low = F.col("s1") < F.col("s2")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return both.groupBy(pick("s1", "s2").alias("a"), pick("s2", "s1").alias("b"), pick("b1", "b2").alias("i"), pick("b2", "b1").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def separation(contacts: DataFrame, bins: DataFrame, reach: int = 4) -> DataFrame:
    """How far the map falls into two blocks at every boundary with `reach` bins on either side: `s`, `s0`, `t` of both sides.

    Per diagonal k from 2 to reach - 1 and side, with a the mean of the cells inside the side and b that of the cells that cross
    the boundary from it (n and m cells, zeros included): s += n m (a - b)^2 / (n + m)^2 where a > b, s0 likewise with b = 0 where
    a > 0; t is the share of crossing cells below a, or zero. `bins` has `scaffold_id`, `n_bins`. A cell meets at most 2 reach
    boundaries. `evident`: s_down / s0_down + s_up / s0_up >= 1.3 and t_down + t_up >= 1.8 (a ratio over 0 counts 0).
    """
    at = contacts.where((F.col("j") - F.col("i")).between(2, reach - 1)).select("scaffold_id", "i", "j", "n", (F.col("j") - F.col("i")).alias("k"), F.explode(F.sequence(F.greatest(F.col("j") - reach + 1, F.lit(1)), F.col("i") + reach)).alias("boundary"))
    crosses = (F.col("i") < F.col("boundary")) & (F.col("j") >= F.col("boundary"))
    # A cell that crosses counts for either side; one inside for its own. It must lie within the reach.
    kind = F.when(crosses, F.array(F.lit(0), F.lit(1))).when(F.col("j") < F.col("boundary"), F.array(F.lit(0))).otherwise(F.array(F.lit(1)))
    near = at.where((F.col("i") >= F.col("boundary") - reach) & (F.col("j") < F.col("boundary") + reach)).withColumn("crosses", crosses).withColumn("up", F.explode(kind))
    per = near.groupBy("scaffold_id", "boundary", "up", "k").agg(F.sum(F.when(~F.col("crosses"), F.col("n"))).alias("si"), F.sum(F.when(F.col("crosses"), F.col("n"))).alias("so"), F.collect_list(F.when(F.col("crosses"), F.col("n"))).alias("out"))
    grid = bins.where(F.col("n_bins") >= 2 * reach).select("scaffold_id", F.explode(F.sequence(F.lit(reach).cast("bigint"), F.col("n_bins") - reach)).alias("boundary"))
    grid = grid.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("k", F.explode(F.sequence(F.lit(2).cast("bigint"), F.lit(reach - 1).cast("bigint"))))
    rows = grid.join(per, ["scaffold_id", "boundary", "up", "k"], "left").fillna(0, ["si", "so"])
    n, m = F.lit(reach) - F.col("k"), F.col("k")  # cells of the diagonal inside a side, and across
    a, b = F.col("si") / n, F.col("so") / m
    weight = n * m / ((n + m) * (n + m))
    high = F.coalesce(F.size(F.filter("out", lambda x: x >= a)), F.lit(0))
    low = m - F.when(F.size("out") > 0, high).otherwise(0)
    got = rows.groupBy("scaffold_id", "boundary", "up").agg(
        F.sum(F.when(a > b, weight * (a - b) * (a - b)).otherwise(0.0)).alias("s"), F.sum(F.when(a > 0, weight * a * a).otherwise(0.0)).alias("s0"), (F.sum(low) / F.sum(m)).alias("t"))
    side = lambda u, c: F.max(F.when(F.col("up") == u, F.col(c)))
    both = got.groupBy("scaffold_id", "boundary").agg(*[side(u, c).alias(f"{c}_{d}") for u, d in ((0, "down"), (1, "up")) for c in ("s", "s0", "t")])
    ratio = lambda d: F.coalesce(F.col(f"s_{d}") / F.nullif(f"s0_{d}", F.lit(0.0)), F.lit(0.0))
    evident = (ratio("down") + ratio("up") >= 1.3) & (F.col("t_down") + F.col("t_up") >= 1.8)
    return both.select("scaffold_id", "boundary", *[F.round(f"{c}_{d}", 6).alias(f"{c}_{d}") for d in ("down", "up") for c in ("s", "s0", "t")], evident.alias("evident"))


def without_gap_bins(contacts: DataFrame, gaps: DataFrame, width: int) -> DataFrame:
    """The map without the bins that lie wholly in a gap; the bins behind them move up."""
    bins = gaps.select("scaffold_id", F.ceil(F.col("gap_start") / width).alias("a"), F.floor(F.col("gap_end") / width).alias("b")).where("a < b").select("scaffold_id", F.explode(F.sequence("a", F.col("b") - 1)).alias("p"))
    asked = contacts.select("scaffold_id", F.explode(F.array("i", "j")).alias("q")).distinct()
    n = below(bins.select("scaffold_id", "p"), asked, "scaffold_id")
    gone = bins.withColumn("_g", F.lit(True))
    rows = contacts
    for c in ("i", "j"):
        rows = rows.join(gone.select("scaffold_id", F.col("p").alias(c)), ["scaffold_id", c], "left_anti").join(n.select("scaffold_id", F.col("q").alias(c), F.col("n").alias(f"_{c}")), ["scaffold_id", c], "left")
    return rows.select("scaffold_id", (F.col("i") - F.coalesce("_i", F.lit(0))).alias("i"), (F.col("j") - F.coalesce("_j", F.lit(0))).alias("j"), "n")


def depletion(contacts: DataFrame, ideal: DataFrame, bins: DataFrame, reach: int = 4) -> DataFrame:
    """Per boundary, how much less contact crosses it than the mean map has: sum over distances 1..reach of (x - ideal)^2 / ideal
    where x < ideal; x is the mean of the cells of that distance that cross (those outside the map count 0)."""
    at = contacts.where((F.col("j") - F.col("i")).between(1, reach)).select("scaffold_id", "n", (F.col("j") - F.col("i")).alias("k"), F.explode(F.sequence(F.col("i") + 1, F.col("j"))).alias("boundary"))
    sums = at.groupBy("scaffold_id", "boundary", "k").agg(F.sum("n").alias("x"))
    grid = bins.where("n_bins >= 2").select("scaffold_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_bins") - 1)).alias("boundary"))
    means = ideal.where(F.col("distance").between(1, reach) & (F.col("mean") > 0)).select(F.col("distance").alias("k"), "mean")
    rows = grid.join(F.broadcast(means)).join(sums, ["scaffold_id", "boundary", "k"], "left")  # at most `reach` rows of means
    x = F.coalesce(F.col("x"), F.lit(0)) / F.col("k")
    return rows.groupBy("scaffold_id", "boundary").agg(F.round(F.sum(F.when(x < F.col("mean"), (x - F.col("mean")) * (x - F.col("mean")) / F.col("mean")).otherwise(0.0)), 6).alias("depletion"))


def signal_peaks(signal: DataFrame, key: str, at: str, value: str, height: float = 0.0) -> DataFrame:
    """Positions where a signal rises to above `height` and falls afterwards: the first position of every highest plateau.

    Stretches of equal values are one, so that a peak is a stretch above both its neighbours; the ends of a signal are no peaks.
    """
    w = Window.partitionBy(key).orderBy(at)
    runs = signal.withColumn("_prev", F.lag(value).over(w)).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(value)))
    return runs.withColumn("_next", F.lead(value).over(w)).where((F.col(value) > F.col("_prev")) & (F.col(value) > F.col("_next")) & (F.col(value) > height)).select(key, at, value)


def chromosome_rounds(pairs: DataFrame, parts: DataFrame, windows: tuple[int, ...] = (1000, 2000, 5000), least: int = 2, gap: int = 500) -> DataFrame:
    """Scaffolds joined end to end by contacts, in rounds of growing windows: `scaffold_id`, `node`, `start`, `end`, `sign`.

    A round counts the pairs with both mates within the window of an end of what is joined so far, accepts joins of at least
    `least` pairs in order of their number (each end once) and unites with a fixed gap. Contigs placed once count.
    """
    from strandloom.operators import graph
    from strandloom.plans.shared import cut

    at = placed_once(parts).select("contig_id", "scaffold_id", "strand", "comp_start", "comp_end")

    def mate(k: int) -> DataFrame:
        pos = F.when(F.col("strand") == "-", F.col("comp_end") - 1 - F.col("p")).otherwise(F.col("comp_start") + F.col("p"))
        return pairs.select("lib_no", "pair_id", F.abs(f"id{k}").alias("contig_id"), F.col(f"place{k}").alias("p")).join(at, "contig_id").select("lib_no", "pair_id", F.col("scaffold_id").alias(f"s{k}"), pos.alias(f"p{k}"))

    mates = cut(mate(1).join(mate(2), ["lib_no", "pair_id"]).where("s1 <> s2"))
    spots = cut(node_lengths(parts).select("scaffold_id", F.col("scaffold_id").alias("node"), F.lit(0).cast("bigint").alias("start"), F.col("len").alias("end"), F.lit(1).alias("sign")))
    for window in windows:
        sizes = spots.groupBy(F.col("node").alias("contig_id")).agg(F.max("end").alias("len"))
        own = spots.join(sizes.withColumnRenamed("contig_id", "node"), "node")

        def end(k: int) -> DataFrame:
            o = own.select(F.col("scaffold_id").alias(f"s{k}"), F.col("node").alias(f"n{k}"), F.col("start").alias(f"a{k}"), F.col("end").alias(f"e{k}"), F.col("sign").alias(f"g{k}"), F.col("len").alias(f"l{k}"))
            return o

        rows = mates.join(end(1), "s1").join(end(2), "s2").where("n1 <> n2")
        place = lambda k: F.when(F.col(f"g{k}") > 0, F.col(f"a{k}") + F.col(f"p{k}")).otherwise(F.col(f"e{k}") - 1 - F.col(f"p{k}"))
        rows = rows.withColumns({"x": place(1), "y": place(2)})
        side = lambda k, v: F.when(F.col(v) < F.least(F.lit(window), F.col(f"l{k}") / 2), -1).when(F.col(f"l{k}") - 1 - F.col(v) < F.least(F.lit(window), F.col(f"l{k}") / 2), 1)
        rows = rows.withColumns({"d": side(1, "x"), "f": side(2, "y")}).where("d IS NOT NULL AND f IS NOT NULL")
        # Leaving node 1 by end d and entering node 2 by end f: the same strand if the ends differ.
        one = rows.select(F.col("n1").alias("src"), F.col("d").alias("direction"), F.col("n2").alias("dst"), (-F.col("d") * F.col("f")).alias("orient"))
        two = rows.select(F.col("n2").alias("src"), F.col("f").alias("direction"), F.col("n1").alias("dst"), (-F.col("d") * F.col("f")).alias("orient"))
        edges = one.unionByName(two).groupBy("src", "direction", "dst", "orient").agg(F.count(F.lit(1)).alias("num_link"), F.lit(gap).cast("bigint").alias("gap")).where(F.col("num_link") >= least)
        joins = cut(graph.greedy_joins(cut(edges)))
        if joins.isEmpty():
            continue
        chains = cut(graph.chain_offsets(graph.chains(joins), joins, cut(sizes)).select("chain", F.col("node").alias("node"), F.col("sign").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b")))
        moved = spots.join(chains, "node", "left")
        back = F.col("_s") < 0
        new_start = F.when(back, F.col("_b") - F.col("end")).otherwise(F.coalesce("_a", F.lit(0)) + F.col("start"))
        new_end = F.when(back, F.col("_b") - F.col("start")).otherwise(F.coalesce("_a", F.lit(0)) + F.col("end"))
        spots = cut(moved.select("scaffold_id", F.coalesce("chain", "node").alias("node"), new_start.alias("start"), new_end.alias("end"), (F.col("sign") * F.coalesce("_s", F.lit(1))).alias("sign")))
    return spots


# ---- diploid nodes ----


def consensus_parts(lengths: DataFrame, coverage: DataFrame, states: DataFrame, hetero: float) -> DataFrame:
    """Diploid nodes: `consensus_id`, `h` (haplotype), `scaffold_id`, `sign`, `len`.

    Nodes that are each other's allele make one diploid node, named by the lower, the primary in haplotype 0 and the other in 1; the
    partner has the sign of its strand. A node alone lies in haplotype 0 if its coverage is at most 1.75 times `hetero`, else in both.
    """
    n = lengths.join(coverage.select("scaffold_id", "coverage"), "scaffold_id", "left").join(states, "scaffold_id", "left")
    paired = n.where("partner IS NOT NULL").select(
        F.least("scaffold_id", F.abs("partner")).alias("consensus_id"), F.when(F.col("is_primary"), 0).otherwise(1).alias("h"), "scaffold_id", F.when(F.col("is_primary"), F.lit(1)).otherwise(F.signum("partner")).cast("int").alias("sign"), "len")
    both = F.when(F.col("coverage") <= 1.75 * hetero, F.array(F.lit(0))).when(F.col("coverage").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    alone = n.where("partner IS NULL").select(F.col("scaffold_id").alias("consensus_id"), F.explode(both).alias("h"), "scaffold_id", F.lit(1).alias("sign"), "len")
    return paired.unionByName(alone)


def consensus_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges of nodes lifted to diploid nodes: links within (`parallel`) and across (`crossed`) haplotypes, and the link-weighted gap.

    The gap loses what lies between a part's end and its diploid node's; division is to the next whole number towards zero. Edges
    within a diploid node are left out.
    """
    size = parts.groupBy("consensus_id").agg(F.max("len").alias("size"))
    p = parts.join(size, "consensus_id")
    side = lambda k, c: p.select(F.col("scaffold_id").alias(c), F.col("consensus_id").alias(f"k{k}"), F.col("h").alias(f"h{k}"), F.col("sign").alias(f"g{k}"), (F.col("size") - F.col("len")).alias(f"rest{k}"))
    rows = edges.join(side(1, "src"), "src").join(side(2, "dst"), "dst").where("k1 <> k2")
    leave, enter = F.col("direction") * F.col("g1"), F.col("direction") * F.col("orient") * F.col("g2")
    # Parts begin where their node begins: only the right end of a shorter part lies off the node's end.
    gap = F.col("gap") - F.when(leave > 0, F.col("rest1")).otherwise(0) - F.when(enter > 0, 0).otherwise(F.col("rest2"))
    got = rows.groupBy(F.col("k1").alias("src"), leave.cast("int").alias("direction"), F.col("k2").alias("dst"), (F.col("orient") * F.col("g1") * F.col("g2")).cast("int").alias("orient")).agg(
        F.sum(F.when(F.col("h1") == F.col("h2"), F.col("num_link")).otherwise(0)).alias("parallel"), F.sum(F.when(F.col("h1") != F.col("h2"), F.col("num_link")).otherwise(0)).alias("crossed"), F.sum(gap * F.col("num_link")).alias("_g"), F.sum("num_link").alias("_n"))
    mean = F.col("_g") / F.col("_n")
    return got.select("src", "direction", "dst", "orient", "parallel", "crossed", F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean)).cast("bigint").alias("gap"))
