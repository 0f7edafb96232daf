"""Pruning of link graphs: expected numbers of links, gap sizes by likelihood, and edges dropped by rates, coverage, tags and alleles.

Every pass decides from the edges as they come in and drops from both nodes. Conflicts are pairs of edges; of a pair that is left
after a pass neither edge is weak against the other, so that a second pass of the same rule finds nothing: one is the fixed point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chebyshev coefficients of the complementary error function (relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erf(z: Column) -> Column:
    t = 1 / (1 + F.abs(z) / 2)
    p = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        p = p * t + c
    tail = t * F.exp(-z * z + p)
    return F.when(z >= 0, 1 - tail).otherwise(tail - 1)


def normal_density(x: Column, mean: Column, deviation: Column) -> Column:
    z = (x - mean) / deviation
    return F.exp(-z * z / 2) / (deviation * math.sqrt(2 * math.pi))


def expected(coverage: Column, len1: Column, len2: Column, gap: Column, avg: Column, sd: Column, read: Column) -> Column:
    """Links expected between two sequences `gap` apart, of fragments with a normal insert and reads of `read` bases.

    The double integral of the insert's distribution over both sequences, in closed form.
    """
    s = sd * math.sqrt(2)

    def area(x: Column) -> Column:
        return x * erf(x / s) + s / math.sqrt(math.pi) * F.exp(-(x / s) * (x / s))

    d = gap - avg
    return coverage / (4 * read) * (area(len1 + d + len2) - area(read + d + len2) - area(len1 + d + read) + area(read + d + read))


def long_library(libraries: DataFrame, read_set: DataFrame, contigs: DataFrame) -> DataFrame:
    """The library of the longest insert with known figures (lowest number of a tie), one row, with its coverage of the contigs."""
    one = libraries.where("avg_ins > 0 AND sd_ins > 0 AND read_len > 0").orderBy(F.desc("avg_ins"), "lib_no").limit(1)
    bases = read_set.groupBy("lib_no").agg(F.sum(F.length("bases")).alias("b"))
    total = contigs.agg(F.sum("len")).scalar()
    return one.join(bases, "lib_no", "left").select("lib_no", "avg_ins", "sd_ins", "read_len", (F.coalesce("b", F.lit(0)) / total).alias("lib_cov"))


def mean_coverage(contigs: DataFrame) -> Column:
    return contigs.where("len > 0").agg((F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("m")).scalar()


def with_expectation(edges: DataFrame, contigs: DataFrame, library: DataFrame) -> DataFrame:
    """Edges with `expected` links at their gap, `typical` links at a gap of one insert, and `rate` = links / max(1, expected).

    The coverage is the library's, scaled by the lesser coverage of the two nodes against the mean; `library` has one row.
    """
    c = contigs.select("contig_id", F.col("len").cast("double").alias("len"), "cov")
    at = lambda k, i: c.select(F.col("contig_id").alias(k), F.col("len").alias(f"l{i}"), F.col("cov").alias(f"c{i}"))
    rows = edges.join(at("src", 1), "src").join(at("dst", 2), "dst").crossJoin(F.broadcast(library))  # one row
    cov = F.col("lib_cov") * F.least("c1", "c2") / mean_coverage(contigs)
    e = lambda gap: expected(cov, F.col("l1"), F.col("l2"), gap, F.col("avg_ins"), F.col("sd_ins"), F.col("read_len"))
    rows = rows.withColumn("_e", e(F.col("gap"))).withColumn("_t", e(F.col("avg_ins")))
    return rows.select(*edges.columns, F.round("_e", 4).alias("expected"), F.round("_t", 4).alias("typical"), F.round(F.col("num_link") / F.greatest(F.lit(1.0), "_e"), 6).alias("rate"))


def drop_thin(rated: DataFrame) -> DataFrame:
    """Edges with at least half the links that are typical for their nodes (both rounded half up)."""
    return rated.where(F.col("num_link") >= F.floor(F.floor(F.col("typical") + 0.5) / 2 + 0.5))


def drop_pairs(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """`edges` without those between the nodes `src`, `dst` of `gone`, seen from either."""
    both = gone.select("src", "dst").unionByName(gone.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return edges.join(both, ["src", "dst"], "left_anti").select(edges.columns)


def weaker(conflicts: DataFrame, value: DataFrame, column: str) -> DataFrame:
    """Conflicts with the `column` of both edges as `v1`, `v2` (null where `value`, by `src`, `dst`, has none)."""
    v = value.groupBy("src", "dst").agg(F.max(column).alias("v"))
    one = lambda i: v.select("src", F.col("dst").alias(f"dst{i}"), F.col("v").alias(f"v{i}"))
    return conflicts.join(one(1), ["src", "dst1"], "left").join(one(2), ["src", "dst2"], "left")


def drop_erroneous_by_expectation(rated: DataFrame, conflicts: DataFrame, ratio: float = 0.5, upper: float = 4.0) -> DataFrame:
    """Edges without the one of fewer links in a conflict whose rate is at most `ratio` of the other's; rates above `upper` decide nothing."""
    w = weaker(conflicts, rated, "rate").where((F.col("v1") <= upper) & (F.col("v2") <= upper))
    first, second = (F.col("n1") < F.col("n2")) & (F.col("v1") <= ratio * F.col("v2")), (F.col("n2") < F.col("n1")) & (F.col("v2") <= ratio * F.col("v1"))
    gone = w.where(first | second).select("src", F.when(first, F.col("dst1")).otherwise(F.col("dst2")).alias("dst"))
    return drop_pairs(rated, gone)


def drop_by_tags(edges: DataFrame, conflicts: DataFrame, tags: DataFrame, rate: float = 0.125) -> DataFrame:
    """Edges without those whose nodes share fewer than `rate` times the barcode evidence of a conflicting edge's nodes."""
    both = tags.select(F.col("contig_a").alias("src"), F.col("contig_b").alias("dst"), "score").unionByName(tags.select(F.col("contig_b").alias("src"), F.col("contig_a").alias("dst"), "score"))
    w = weaker(conflicts, both, "score").fillna(0, ["v1", "v2"])
    gone = w.where(F.col("v1") < rate * F.col("v2")).select("src", F.col("dst1").alias("dst")).unionByName(w.where(F.col("v2") < rate * F.col("v1")).select("src", F.col("dst2").alias("dst")))
    return drop_pairs(edges, gone)


def drop_hetero(edges: DataFrame, conflicts: DataFrame, contigs: DataFrame, centre: float = 1.5, arms: float = 0.75) -> DataFrame:
    """Edges without those to the shorter of two conflicting targets that both look like one allele.

    The node must have at most `centre` and both targets at most `arms` times the mean coverage; of equal lengths the higher id goes.
    """
    c, mean = contigs.select("contig_id", "len", "cov"), mean_coverage(contigs)
    at = lambda k: c.select(F.col("contig_id").alias(k), F.col("len").alias(f"len_{k}"), F.col("cov").alias(f"cov_{k}"))
    rows = conflicts.join(at("src"), "src").join(at("dst1"), "dst1").join(at("dst2"), "dst2")
    rows = rows.where((F.col("cov_src") <= centre * mean) & (F.col("cov_dst1") <= arms * mean) & (F.col("cov_dst2") <= arms * mean))
    return drop_pairs(edges, rows.select("src", F.when(F.col("len_dst1") < F.col("len_dst2"), F.col("dst1")).otherwise(F.col("dst2")).alias("dst")))


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose nodes are both in `nodes` (`contig_id`)."""
    keep = nodes.select(F.col("contig_id").alias("_id")).distinct()
    return edges.join(keep, edges["src"] == keep["_id"], "left_semi").join(keep, edges["dst"] == keep["_id"], "left_semi")


def possible_positions(len1: Column, len2: Column, gap: Column, insert: Column, half_read: Column) -> Column:
    """How many places a fragment of length `insert` has that spans the gap with both reads on their sequences."""
    way = F.greatest(F.lit(0), insert - F.greatest(gap, F.lit(0)) - half_read * 2 + 1)
    way = F.least(way, F.greatest(F.lit(0), F.least(len1, len2) + half_read + 1))
    return F.least(way, F.greatest(F.lit(0), len1 + len2 + gap - insert + 1))


def likely_gaps(links: DataFrame, width: int) -> DataFrame:
    """`id1`, `id2`, `num_link`, `gap`: the whole gap of highest likelihood, for a normal insert.

    The likelihood falls with the squared distance from the mean of the links' gaps; gaps are tried from the lowest to the highest
    of the links, but no farther than `width` from their median (of an even number the mean of the middle two, towards zero).
    Of two equal ones the lower counts.
    """
    got = links.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("num_link"), F.avg("gap").alias("m"), F.min("gap").alias("lo"), F.max("gap").alias("hi"), F.percentile("gap", 0.5).alias("med"))
    med = F.when(F.col("med") >= 0, F.floor("med")).otherwise(F.ceil("med"))
    best = F.ceil(F.col("m") - 0.5)
    return got.select("id1", "id2", "num_link", F.greatest(F.least(best, F.least("hi", med + width)), F.greatest("lo", med - width)).cast("bigint").alias("gap"))


def alleles(partners: DataFrame, contigs: DataFrame) -> DataFrame:
    """`contig_id`, `partner`, `is_primary`: of a pair, the one of higher coverage (then longer, then of lower id) is primary."""
    both = partners.select(F.col("a").alias("contig_id"), F.col("b").alias("partner")).unionByName(partners.select(F.col("b").alias("contig_id"), F.col("a").alias("partner")))
    c = contigs.select("contig_id", F.struct("cov", "len", (-F.col("contig_id")).alias("k")).alias("s"))
    rows = both.join(c, "contig_id").join(c.select(F.col("contig_id").alias("partner"), F.col("s").alias("t")), "partner")
    return rows.select("contig_id", "partner", (F.col("s") > F.col("t")).alias("is_primary"))


def classes(contigs: DataFrame, allele_rows: DataFrame) -> DataFrame:
    """Every contig with `class` (primary_bubble, secondary_bubble or non_bubble) and its partner."""
    kind = F.when(F.col("is_primary"), "primary_bubble").when(~F.col("is_primary"), "secondary_bubble").otherwise("non_bubble")
    one = allele_rows.groupBy("contig_id").agg(F.min("partner").alias("partner"), F.max("is_primary").alias("is_primary"))
    return contigs.select("contig_id", "name", "len").join(one, "contig_id", "left").select("contig_id", "name", "len", kind.alias("class"), "partner")


def forks(edges: DataFrame) -> DataFrame:
    """Sides of nodes with exactly two edges, to different nodes: `src`, `direction`, `a` < `b`."""
    rows = edges.groupBy("src", "direction").agg(F.count(F.lit(1)).alias("_n"), F.min("dst").alias("a"), F.max("dst").alias("b"))
    return rows.where("_n = 2 AND a < b").drop("_n")


def unique_conflicts(conflict_rows: DataFrame) -> DataFrame:
    """Pairs `a` < `b` of nodes that conflict with each other, on any side, and with no other node."""
    one = conflict_rows.select(F.col("dst1").alias("a"), F.col("dst2").alias("b")).distinct()
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    only = both.groupBy("a").agg(F.count(F.lit(1)).alias("_n"), F.min("b").alias("b")).where("_n = 1").select("a", "b")
    return only.join(only.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").where("a < b")


def cut_tips(edges: DataFrame, contigs: DataFrame, max_len: int, max_ratio: float = 0.5) -> DataFrame:
    """Edges left when short nodes of low coverage with edges on one side only are cut, again and again until there are none.

    Every round cuts at least one node, and chains of such nodes are cut from their ends inwards; each round is cut in the shared
    folder. A tip has at most `max_len` bases and at most `max_ratio` of its best neighbour's coverage.
    """
    from strandloom.operators.graph import tips
    from strandloom.plans.shared import cut

    while True:
        gone = cut(tips(edges, contigs, max_len, max_ratio).select("contig_id"))
        if gone.isEmpty():
            return edges
        left = edges.join(gone.select(F.col("contig_id").alias("src")), "src", "left_anti").join(gone.select(F.col("contig_id").alias("dst")), "dst", "left_anti")
        edges = cut(left.select(edges.columns))
