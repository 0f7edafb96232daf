"""Scaffolds as nodes: lifted links, evidence per contig, allele partners of nodes, division by them, and contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators import graph
from strandloom.plans.shared import cut

ORDER = ("part_no", "comp_start", "comp_end", "contig_ref")


def node_lengths(parts: DataFrame) -> DataFrame:
    return parts.groupBy("scaffold_id").agg(F.max("comp_end").alias("len"))


def placed_once(parts: DataFrame) -> DataFrame:
    """Parts whose contig lies nowhere else."""
    once = parts.groupBy("contig_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("contig_id")
    return parts.join(once, "contig_id", "left_semi")


def lifted_links(links: DataFrame, parts: DataFrame) -> DataFrame:
    """Links of contigs lifted to the scaffolds they lie in: canonical signed ids, the two contigs, and the gap between the scaffolds.

    Only contigs placed once take part; links within a scaffold are left out. The gap loses what lies between a contig's end and
    its scaffold's on either side. Of the two ways to write a link the one with the lower first id is given.
    """
    at = placed_once(parts).join(node_lengths(parts), "scaffold_id")
    spots = at.select("contig_id", "scaffold_id", F.when(F.col("strand") == "-", -1).otherwise(1).alias("o"), F.col("comp_start").alias("cs"), (F.col("len") - F.col("comp_end")).alias("ce"))
    side = lambda i: spots.select(F.col("contig_id").alias(f"contig{i}"), F.col("scaffold_id").alias(f"n{i}"), F.col("o").alias(f"o{i}"), F.col("cs").alias(f"cs{i}"), F.col("ce").alias(f"ce{i}"))
    rows = links.select(F.abs("id1").alias("contig1"), F.abs("id2").alias("contig2"), F.signum("id1").alias("g1"), F.signum("id2").alias("g2"), "gap").join(side(1), "contig1").join(side(2), "contig2").where("n1 <> n2")
    s1, s2 = (F.col("g1") * F.col("o1")).cast("bigint"), (F.col("g2") * F.col("o2")).cast("bigint")
    gap = F.col("gap") - F.when(s1 > 0, F.col("ce1")).otherwise(F.col("cs1")) - F.when(s2 > 0, F.col("cs2")).otherwise(F.col("ce2"))
    low = F.col("n1") < F.col("n2")
    return rows.select(
        F.when(low, s1 * F.col("n1")).otherwise(-s2 * F.col("n2")).alias("id1"), F.when(low, s2 * F.col("n2")).otherwise(-s1 * F.col("n1")).alias("id2"),
        F.when(low, F.col("contig1")).otherwise(F.col("contig2")).alias("contig1"), F.when(low, F.col("contig2")).otherwise(F.col("contig1")).alias("contig2"), gap.cast("bigint").alias("gap"),
    )


def breakdown(node_links: DataFrame) -> DataFrame:
    """Links of every edge by the contig of its source: `src`, `direction`, `dst`, `contig_id`, `n`, seen from both nodes."""
    side = lambda a, b, c, s: node_links.groupBy(F.abs(a).alias("src"), (F.signum(a) * s).cast("int").alias("direction"), F.abs(b).alias("dst"), F.col(c).alias("contig_id")).agg(F.count(F.lit(1)).alias("n"))
    return side("id1", "id2", "contig1", 1).unionByName(side("id2", "id1", "contig2", -1))


def mask_repeats(parts_of_edges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Edges and their links without the contigs of a node that support two conflicting edges; edges without links are gone."""
    b = parts_of_edges.select("src", "direction", "dst", "contig_id")
    x = conflicts.select("src", "direction", "dst1", "dst2")
    both = x.join(b.withColumnRenamed("dst", "dst1"), ["src", "direction", "dst1"]).join(b.withColumnRenamed("dst", "dst2"), ["src", "direction", "dst2", "contig_id"]).select("src", "contig_id").distinct()
    return parts_of_edges.join(both, ["src", "contig_id"], "left_anti").groupBy("src", "direction", "dst").agg(F.sum("n").alias("num_link"))


def overlap_links(overlaps: DataFrame) -> DataFrame:
    """Overlaps as links: canonical signed ids and the negative overlap as gap."""
    swap = F.abs("a") > F.abs("b")
    rows = overlaps.select(F.when(swap, -F.col("b")).otherwise(F.col("a")).alias("id1"), F.when(swap, -F.col("a")).otherwise(F.col("b")).alias("id2"), "overlap")
    return rows.groupBy("id1", "id2").agg((-F.max("overlap")).alias("gap"))


def end_overlaps(overlap_rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Overlaps (as links) between the contigs at the facing ends of two scaffolds: signed scaffolds |a| < |b|, `overlap`."""
    w = Window.partitionBy("scaffold_id")
    up, down = w.orderBy(*ORDER), w.orderBy(*[F.desc(c) for c in ORDER])
    at = parts.select("scaffold_id", "contig_ref", F.row_number().over(up).alias("i"), F.row_number().over(down).alias("j"))
    node = lambda s, cond: at.where(cond).select((F.col("scaffold_id") * s).alias("node"), (F.col("contig_ref") * s).alias("c"))
    right, left = node(1, "j = 1").unionByName(node(-1, "i = 1")), node(1, "i = 1").unionByName(node(-1, "j = 1"))
    both = overlap_rows.select("id1", "id2", "gap").unionByName(overlap_rows.select((-F.col("id2")).alias("id1"), (-F.col("id1")).alias("id2"), "gap"))
    rows = both.join(right.select(F.col("node").alias("a"), F.col("c").alias("id1")), "id1").join(left.select(F.col("node").alias("b"), F.col("c").alias("id2")), "id2")
    return rows.where("abs(a) < abs(b)").select("a", "b", (-F.col("gap")).alias("overlap"))


def edges_with_overlaps(grouped: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Edges of links and overlaps together: `num_link` counts links only, an overlap gives the gap and `is_overlap`."""
    o = overlap_links(overlaps).withColumnRenamed("gap", "_o")
    rows = grouped.join(o, ["id1", "id2"], "full").select("id1", "id2", F.coalesce("num_link", F.lit(0)).cast("bigint").alias("num_link"), F.coalesce("_o", "gap").alias("gap"), F.col("_o").isNotNull().alias("is_overlap"))
    orient = F.signum(F.col("id1") * F.col("id2")).cast("int").alias("orient")
    side = lambda a, b, s: rows.select(F.abs(a).alias("src"), (F.signum(a) * s).cast("int").alias("direction"), F.abs(b).alias("dst"), orient, "num_link", "gap", "is_overlap")
    return side("id1", "id2", 1).unionByName(side("id2", "id1", -1))


def unique_paths(edges: DataFrame, contigs: DataFrame) -> DataFrame:
    """Links between two nodes that exactly one path of two overlaps joins in the same direction: the link's gap and the path's."""
    first = edges.where("is_overlap").select("src", "direction", F.col("dst").alias("via"), F.col("orient").alias("o1"), F.col("gap").alias("g1"))
    second = edges.where("is_overlap").select(F.col("src").alias("via"), F.col("direction").alias("d2"), "dst", F.col("orient").alias("o2"), F.col("gap").alias("g2"))
    two = first.join(second, "via").where("d2 = direction * o1 AND src <> dst").join(contigs.select(F.col("contig_id").alias("via"), "len"), "via")
    paths = two.groupBy("src", "direction", "dst", (F.col("o1") * F.col("o2")).alias("orient")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col("g1") + F.col("len") + F.col("g2")).alias("path_gap")).where("_n = 1")
    return edges.where("NOT is_overlap").join(paths, ["src", "direction", "dst", "orient"]).select("src", "direction", "dst", "num_link", F.col("gap").alias("link_gap"), F.col("path_gap").cast("bigint").alias("path_gap"))


def part_partners(parts: DataFrame, alleles: DataFrame) -> DataFrame:
    """Every part with `partner`: the signed scaffold on which the contig's allele lies (negative: on the other strand), or null.

    Alleles placed more than once, or on the same scaffold, give none.
    """
    at = placed_once(parts).select(F.col("contig_id").alias("partner_contig"), F.col("scaffold_id").alias("other"), F.col("strand").alias("other_strand"))
    own = alleles.select("contig_id", F.col("partner").alias("partner_contig")).join(at, "partner_contig").drop("partner_contig")
    rows = parts.join(own.withColumnRenamed("contig_id", "_c"), (F.col("contig_id") == F.col("_c")) & (F.col("scaffold_id") != F.col("other")), "left")
    turn = F.when(F.col("strand") == F.col("other_strand"), F.col("other")).otherwise(-F.col("other"))
    return rows.select("scaffold_id", *ORDER, turn.alias("partner"))


def node_partners(rows: DataFrame) -> DataFrame:
    """`scaffold_id`, `partner` (signed) with most bases of parts (ties: lower id, same strand), `bases`."""
    got = rows.where("partner IS NOT NULL").groupBy("scaffold_id", "partner").agg(F.sum(F.col("comp_end") - F.col("comp_start")).alias("bases"))
    best = got.groupBy("scaffold_id").agg(F.max(F.struct("bases", (-F.abs("partner")).alias("k"), "partner")).alias("m"))
    return best.select("scaffold_id", "m.partner", "m.bases")


def node_states(partners: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes that are each other's partner; the longer (of equal ones the lower id) is primary."""
    back = partners.select(F.abs("partner").alias("scaffold_id"), F.col("scaffold_id").alias("_p"))
    n = lengths.select("scaffold_id", F.struct("len", (-F.col("scaffold_id")).alias("k")).alias("s"))
    rows = partners.join(back, "scaffold_id").where("abs(partner) = _p").join(n, "scaffold_id").join(n.select(F.col("scaffold_id").alias("_p"), F.col("s").alias("t")), "_p")
    return rows.select("scaffold_id", "partner", (F.col("s") > F.col("t")).alias("is_primary"))


def divide_by_partner(rows: DataFrame) -> DataFrame:
    """Scaffolds cut where the partner of their parts changes: `piece_no` from 1, `partner`, parts and extent."""
    w = Window.partitionBy("scaffold_id").orderBy(*ORDER)
    change = (F.coalesce("partner", F.lit(0)) != F.coalesce(F.lag("partner").over(w), F.lit(0))) & F.lag("comp_end").over(w).isNotNull()
    numbered = rows.withColumn("_new", change.cast("int")).withColumn("piece_no", 1 + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("scaffold_id", "piece_no").agg(F.max("partner").alias("partner"), F.count(F.lit(1)).alias("n_parts"), F.min("comp_start").alias("piece_start"), F.max("comp_end").alias("piece_end"))


def isolate_alleles(rows: DataFrame, partners: DataFrame, lengths: DataFrame) -> DataFrame:
    """Scaffolds less than half of which has one partner, with their parts that have an allele elsewhere as pieces of their own."""
    hetero = partners.join(lengths, "scaffold_id").where("2 * bases >= len").select("scaffold_id", F.lit(True).alias("_h"))
    w = Window.partitionBy("scaffold_id").orderBy(*ORDER)
    at = rows.join(hetero, "scaffold_id", "left").withColumn("_alone", F.col("_h").isNull() & F.col("partner").isNotNull())
    at = at.withColumn("_new", (F.col("_alone") | F.coalesce(F.lag("_alone").over(w), F.lit(False))).cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.groupBy("scaffold_id", "_g").agg(F.min("comp_start").alias("piece_start"), F.max("comp_end").alias("piece_end"), F.count(F.lit(1)).alias("n_parts"), F.bool_or("_alone").alias("is_allele")).drop("_g")


def drop_same_parent(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges without those between two contigs of one scaffold (contigs placed once)."""
    at = placed_once(parts).select("contig_id", "scaffold_id")
    rows = edges.join(at.select(F.col("contig_id").alias("src"), F.col("scaffold_id").alias("_a")), "src", "left").join(at.select(F.col("contig_id").alias("dst"), F.col("scaffold_id").alias("_b")), "dst", "left")
    return rows.where("_a IS NULL OR _b IS NULL OR _a <> _b").select(edges.columns)


def tag_counts(mapped: DataFrame, read_set: DataFrame, parts: DataFrame, most: int = 254) -> DataFrame:
    """Placed reads of every barcode on every scaffold, saturating at `most`."""
    tags = mapped.join(read_set.where("tag IS NOT NULL").select("lib_no", "pair_id", "mate", "tag"), ["lib_no", "pair_id", "mate"])
    at = tags.select(F.abs("signed_id").alias("contig_id"), "tag").join(placed_once(parts).select("contig_id", "scaffold_id"), "contig_id")
    return at.groupBy("scaffold_id", "tag").agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("bigint").alias("n"))


def contract(edges: DataFrame, contigs: DataFrame) -> DataFrame:
    """Nodes joined along reciprocal single edges, in rounds until no join is left: `contig_id`, `node`, `start`, `end`, `sign`.

    A round turns every chain of joins into one node, named by its lowest, and lifts the edges: those between the ends of nodes stay,
    those from inside a node are gone. New nodes may have single edges again; there are at most as many rounds as nodes merge.
    """
    spots = cut(contigs.where("len > 0").select("contig_id", F.col("contig_id").alias("node"), F.lit(0).cast("bigint").alias("start"), F.col("len").alias("end"), F.lit(1).alias("sign")))
    while True:
        joins = cut(graph.reciprocal(edges))
        if joins.isEmpty():
            return spots
        sizes = cut(spots.groupBy(F.col("node").alias("contig_id")).agg(F.max("end").alias("len")))
        place = cut(graph.chain_offsets(graph.chains(joins), joins, sizes).select("chain", F.col("node").alias("_n"), F.col("sign").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"), "place"))
        last = place.groupBy("chain").agg(F.max("place").alias("_last"))
        lifted = spots.join(place, spots["node"] == place["_n"], "left")
        on = F.col("_n").isNotNull()
        # A turned node is read backwards: its right end comes first.
        start = F.when(on & (F.col("_s") < 0), F.col("_b") - F.col("end")).otherwise(F.coalesce("_a", F.lit(0)) + F.col("start"))
        end = F.when(on & (F.col("_s") < 0), F.col("_b") - F.col("start")).otherwise(F.coalesce("_a", F.lit(0)) + F.col("end"))
        spots = cut(lifted.select("contig_id", F.coalesce("chain", "node").alias("node"), start.alias("start"), end.alias("end"), (F.col("sign") * F.coalesce("_s", F.lit(1))).alias("sign")))
        info = place.join(last, "chain").select(F.col("_n").alias("n"), "chain", F.col("_s").alias("s"), (F.col("place") == 1).alias("is_first"), (F.col("place") == F.col("_last")).alias("is_last"))
        own = lambda k: info.select(F.col("n").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("chain", "s", "is_first", "is_last")])
        rows = edges.join(own("src"), "src", "left").join(own("dst"), "dst", "left")
        s1, s2 = F.coalesce("s_src", F.lit(1)), F.coalesce("s_dst", F.lit(1))
        leave, enter = F.col("direction") * s1, -F.col("direction") * F.col("orient") * s2  # the ends of the new nodes
        free = lambda k, e: F.col(f"chain_{k}").isNull() | F.when(e > 0, F.col(f"is_last_{k}")).otherwise(F.col(f"is_first_{k}"))
        a, b = F.coalesce("chain_src", "src"), F.coalesce("chain_dst", "dst")
        new = rows.where(free("src", leave) & free("dst", enter)).select(a.alias("src"), leave.cast("int").alias("direction"), b.alias("dst"), (F.col("orient") * s1 * s2).cast("int").alias("orient"), "num_link", "gap").where("src <> dst")
        edges = cut(new.groupBy("src", "direction", "dst", "orient").agg(F.sum("num_link").alias("num_link"), F.max("gap").alias("gap")))
