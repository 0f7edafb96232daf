"""Signed link graphs: grouping, mirrored edges, pruning, reciprocal joins, components, chains and bounded paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.shared import cut


def group_links(links: DataFrame, min_links: int = 1) -> DataFrame:
    """`id1`, `id2`, `num_link`, `gap` (mean, rounded half up) of signed pairs with at least `min_links` links."""
    return links.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("num_link"), F.floor(F.avg("gap") + 0.5).alias("gap")).where(F.col("num_link") >= min_links)


def link_breakdown(links: DataFrame, by: str) -> DataFrame:
    """Links of each signed pair by the column `by`."""
    return links.groupBy("id1", "id2", by).agg(F.count(F.lit(1)).alias("num_link"))


def edges(grouped: DataFrame) -> DataFrame:
    """Each link seen from both nodes: `src`, `direction` (1 right, -1 left), `dst`, `orient` (1 same strand, -1 turned), `num_link`, `gap`."""
    orient = F.signum(F.col("id1") * F.col("id2")).cast("int").alias("orient")
    side = lambda a, b, s: grouped.select(F.abs(a).alias("src"), (F.signum(a) * s).cast("int").alias("direction"), F.abs(b).alias("dst"), orient, "num_link", "gap")
    return side("id1", "id2", 1).unionByName(side("id2", "id1", -1))


def degrees(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.groupBy("src", "direction").agg(F.count(F.lit(1)).alias("degree"), F.sum("num_link").alias("links"))


def conflicts(edge_rows: DataFrame, lengths: DataFrame, tolerance: int = 32, width: int = 4096) -> DataFrame:
    """Pairs of edges of one side whose targets would lie over each other by more than `tolerance` bases (`dst1` < `dst2`).

    Edges meet by bins of the places their targets would take, so that those of a hub that lie apart never do; a pair is stated in
    the first bin both are in. Pairs that do lie over each other are the result.
    """
    end = F.col("gap") + F.col("len")
    rows = edge_rows.join(lengths.select(F.col("contig_id").alias("dst"), F.col("len")), "dst").where("len > 0")
    rows = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("gap") / width), F.floor((end - 1) / width))))
    side = lambda i: rows.select("src", "direction", "bin", F.col("dst").alias(f"dst{i}"), F.col("num_link").alias(f"n{i}"), F.col("gap").alias(f"g{i}"), F.col("len").alias(f"l{i}"))
    over = F.least(F.col("g1") + F.col("l1"), F.col("g2") + F.col("l2")) - F.greatest("g1", "g2")
    met = side(1).join(side(2), ["src", "direction", "bin"]).where((F.col("dst1") < F.col("dst2")) & (over > tolerance) & (F.col("bin") == F.floor(F.greatest("g1", "g2") / width)))
    return met.select("src", "direction", "dst1", "n1", "dst2", "n2", over.alias("overlap"))


def drop_erroneous(edge_rows: DataFrame, conflict_rows: DataFrame, rate: float = 0.125) -> DataFrame:
    """Edges without those that have fewer than `rate` times the links of a conflicting edge, dropped from both nodes."""
    weak = conflict_rows.where(F.col("n1") < rate * F.col("n2")).select("src", F.col("dst1").alias("dst"))
    weak = weak.unionByName(conflict_rows.where(F.col("n2") < rate * F.col("n1")).select("src", F.col("dst2").alias("dst")))
    gone = weak.unionByName(weak.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return edge_rows.join(gone, ["src", "dst"], "left_anti").select(edge_rows.columns)


def repeats(conflict_rows: DataFrame, nodes: DataFrame, factor: float = 1.5) -> DataFrame:
    """Nodes that look repeated: coverage above `factor` times the length-weighted mean, or conflicting edges on a side."""
    mean = nodes.where("len > 0").agg((F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("m")).scalar()
    sides = conflict_rows.groupBy("src").agg(F.count(F.lit(1)).alias("n_conflicts"))
    rows = nodes.select("contig_id", "cov").join(sides, nodes["contig_id"] == sides["src"], "left")
    high = F.col("cov") > factor * mean
    return rows.where(high | F.col("n_conflicts").isNotNull()).select("contig_id", "cov", high.alias("high_coverage"), F.coalesce("n_conflicts", F.lit(0)).cast("bigint").alias("n_conflicts"))


def severe_repeats(edge_rows: DataFrame, conflict_rows: DataFrame, nodes: DataFrame, factor: float = 1.5, sides: int = 3, least: int = 2) -> DataFrame:
    """Nodes above `factor` times the mean coverage, with at least `least` conflicts, or with at least `sides` edges on one side."""
    mean = nodes.where("len > 0").agg((F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("m")).scalar()
    some = conflict_rows.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("src")
    many = degrees(edge_rows).where(F.col("degree") >= sides).select("src")
    return nodes.where(F.col("cov") > factor * mean).select("contig_id").unionByName(nodes.join(some.unionByName(many).select(F.col("src").alias("contig_id")), "contig_id", "left_semi").select("contig_id")).distinct()


def reciprocal(edge_rows: DataFrame) -> DataFrame:
    """Joins of nodes that are each other's only neighbour on the facing sides: `id1`, `id2` signed, |id1| < |id2|, `gap`."""
    single = degrees(edge_rows).where("degree = 1").select("src", "direction")
    only = edge_rows.join(single, ["src", "direction"])
    # Seen from the target, the edge leaves on the side -direction * orient.
    back = only.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("direction") * F.col("orient")).alias("direction"), "orient")
    both = only.join(back, ["src", "dst", "direction", "orient"], "left_semi").where("src < dst")
    return both.select((F.col("src") * F.col("direction")).alias("id1"), (F.col("dst") * F.col("direction") * F.col("orient")).alias("id2"), "num_link", "gap")


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `component` (its lowest node) of the graph of `pairs`, by alternating large and small stars.

    Every node ties its higher neighbours, then its lower ones, to the lowest node it knows, until only stars are left; the
    number of rounds grows with the logarithm of the longest path. Rows never exceed the edges; each round is cut in the
    shared folder. Null ends are left out; a pair of one node with itself gives that node; no pairs give no rows.
    """
    one = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    one = cut(one.distinct())
    links, seen = one.where("hi > lo"), None
    while True:
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(links.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        low = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("_l"))
        large = both.where("m > n").join(low, "n").select(F.col("m").alias("hi"), F.col("_l").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("_l"))
        small = large.join(least, "hi").where("lo > _l").select(F.col("lo").alias("hi"), F.col("_l").alias("lo"))
        links = cut(small.unionByName(least.select("hi", F.col("_l").alias("lo"))).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).unionByName(one.where("hi = lo").select(F.col("hi").alias("node"), F.col("hi").alias("component")))
    ).groupBy("node").agg(F.min("component").alias("component"))


def chains(joins: DataFrame) -> DataFrame:
    """Unbranched paths of `reciprocal` joins: `node`, `chain` (its lowest node), `place` from 1, `sign`.

    A chain is read from its end node with the lower id, forwards; a ring starts at its lowest node, to the right. Places come
    from pointer doubling over signed nodes: every round each node knows the node twice as far back, so that a chain of n
    nodes needs log2(n) rounds of joins, and no task walks a chain.
    """
    step = joins.select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    step = cut(step.unionByName(step.select((-F.col("b")).alias("a"), (-F.col("a")).alias("b"))))
    comp = components(joins.select(F.abs("id1").alias("x"), F.abs("id2").alias("y")), "x", "y")
    signed = step.select(F.col("a").alias("s")).unionByName(step.select(F.col("b").alias("s"))).distinct()
    heads = signed.join(step, F.col("s") == F.col("b"), "left_anti").select(F.col("s").alias("head"))
    tagged = comp.join(heads.select(F.abs("head").alias("node"), "head"), "node", "left")
    start = tagged.groupBy("component").agg(F.min(F.when(F.col("head").isNotNull(), F.struct(F.abs("head").alias("k"), (-F.col("head")).alias("h")))).alias("m"))
    start = cut(start.select("component", F.coalesce(-F.col("m.h"), F.col("component")).alias("head")))
    # A ring is opened at its start, on both strands, so that every walk ends.
    first = start.select(F.explode(F.array("head", -F.col("head"))).alias("s"), F.lit(True).alias("_first"))
    back = signed.join(step.select(F.col("b").alias("s"), F.col("a").alias("prev")), "s", "left").join(first, "s", "left").select("s", F.when(F.col("_first").isNull(), F.col("prev")).alias("prev"))
    root = cut(back.select("s", "prev", F.when(F.col("prev").isNull(), 0).otherwise(1).cast("bigint").alias("dist"), F.when(F.col("prev").isNull(), F.col("s")).alias("root")))
    while not root.where("prev IS NOT NULL").isEmpty():
        far = root.select(F.col("s").alias("prev"), F.col("prev").alias("_p"), F.col("dist").alias("_d"), F.col("root").alias("_r"))
        root = cut(root.join(far, "prev", "left").select("s", F.col("_p").alias("prev"), (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"), F.coalesce("root", "_r").alias("root")))
    at = root.join(start, F.col("root") == F.col("head"))
    return at.select(F.abs("s").alias("node"), F.col("component").alias("chain"), (F.col("dist") + 1).alias("place"), F.signum("s").cast("int").alias("sign"))


def widest_paths(edge_rows: DataFrame, hops: int = 3) -> DataFrame:
    """The most links that every edge of some path of up to `hops` edges has, per pair of nodes (`src` < `dst`).

    Only the best value per pair goes on to the next hop, so that intermediate rows are pairs, not paths.
    """
    one = edge_rows.groupBy("src", "dst").agg(F.max("num_link").alias("width"))
    best = one
    for _ in range(hops - 1):
        step = best.select(F.col("src"), F.col("dst").alias("_m"), F.col("width").alias("_w")).join(one.select(F.col("src").alias("_m"), "dst", "width"), "_m")
        longer = step.where("src <> dst").select("src", "dst", F.least("_w", "width").alias("width"))
        best = best.unionByName(longer).groupBy("src", "dst").agg(F.max("width").alias("width"))
    return best.where("src < dst")


def tips(edge_rows: DataFrame, nodes: DataFrame, max_len: int, max_ratio: float = 0.5) -> DataFrame:
    """Short nodes with edges on one side only whose coverage is at most `max_ratio` of a neighbour's: branches to cut."""
    sides = edge_rows.groupBy("src").agg(F.countDistinct("direction").alias("_sides")).where("_sides = 1").select("src")
    cov = nodes.select(F.col("contig_id").alias("dst"), F.col("cov").alias("_other"))
    near = edge_rows.join(sides, "src", "left_semi").join(cov, "dst").groupBy("src").agg(F.max("_other").alias("neighbour_cov"))
    rows = nodes.join(near, nodes["contig_id"] == near["src"])
    return rows.where((F.col("len") <= max_len) & (F.col("cov") <= max_ratio * F.col("neighbour_cov"))).select("contig_id", "len", "cov", "neighbour_cov")


def bubbles(edge_rows: DataFrame) -> DataFrame:
    """Simple bubbles: nodes `a` < `b` that lie, each alone, between the same two sides; `entry` and `exit` nodes.

    Pairs only come from sides with exactly two edges, so that no side gives more than one pair.
    """
    fork = degrees(edge_rows).where("degree = 2").select("src", "direction")
    arms = edge_rows.join(fork, ["src", "direction"]).groupBy("src", "direction").agg(F.min("dst").alias("a"), F.max("dst").alias("b")).where("a < b")
    x = arms.select(F.col("src").alias("entry"), "a", "b")
    y = arms.select(F.col("src").alias("exit"), "a", "b")
    return x.join(y, ["a", "b"]).where("entry < exit").select("entry", "a", "b", "exit").distinct()


def cross_support(edge_rows: DataFrame, evidence: DataFrame, ratio: float = 0.25) -> DataFrame:
    """Nodes with two neighbours on either side: evidence for the parallel and the crossed way through, and the one accepted.

    `evidence` has `a` < `b` and `n`. Neighbours are ordered by id: parallel pairs the lower ones. The stronger way is accepted if
    the weaker has at most `ratio` times its evidence and there is any.
    """
    two = degrees(edge_rows).where("degree = 2").select("src", "direction")
    arms = edge_rows.join(two, ["src", "direction"]).groupBy("src", "direction").agg(F.min("dst").alias("lo"), F.max("dst").alias("hi")).where("lo < hi")
    left, right = arms.where("direction < 0").select("src", F.col("lo").alias("l1"), F.col("hi").alias("l2")), arms.where("direction > 0").select("src", F.col("lo").alias("r1"), F.col("hi").alias("r2"))
    centre = left.join(right, "src")
    way = F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.lit(k).alias("way")) for p, q, k in (("l1", "r1", 0), ("l2", "r2", 0), ("l1", "r2", 1), ("l2", "r1", 1))]))
    rows = centre.select("src", "l1", "l2", "r1", "r2", way.alias("w")).join(evidence.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n"), (F.col("w.a") == F.col("_a")) & (F.col("w.b") == F.col("_b")), "left")
    total = lambda k: F.coalesce(F.sum(F.when(F.col("w.way") == k, F.col("n"))), F.lit(0)).cast("bigint")
    got = rows.groupBy("src", "l1", "l2", "r1", "r2").agg(total(0).alias("parallel"), total(1).alias("crossed"))
    weak, strong = F.least("parallel", "crossed"), F.greatest("parallel", "crossed")
    return got.withColumn("accepted", F.when((strong > 0) & (weak <= ratio * strong), F.when(F.col("parallel") > F.col("crossed"), "parallel").otherwise("crossed")))


def resolved(crosses: DataFrame) -> DataFrame:
    """The two ways through every centre of `cross_support` that has an accepted way: `src`, `left`, `right`."""
    far = F.when(F.col("accepted") == "parallel", F.array("r1", "r2")).otherwise(F.array("r2", "r1"))
    rows = crosses.where("accepted IS NOT NULL").select("src", F.explode(F.arrays_zip(F.array("l1", "l2").alias("l"), far.alias("r"))).alias("w"))
    return rows.select("src", F.col("w.l").alias("left"), F.col("w.r").alias("right"))


def greedy_joins(edge_rows: DataFrame) -> DataFrame:
    """Joins accepted in order of links (then nearer, then lower ids), each side of a node used once: `id1`, `id2` signed, `num_link`, `gap`.

    In every round the edges that come first on both their sides are accepted and the edges of used sides dropped, which
    gives the same joins as one pass in that order. Rings of joins are left as they are; `chains` opens them.
    """
    seen = edge_rows.where("src < dst").select(
        (F.col("src") * F.col("direction")).alias("id1"), (F.col("dst") * F.col("direction") * F.col("orient")).alias("id2"), "num_link", "gap"
    )
    # The side of a node that a join occupies: its own signed end.
    left = cut(seen.select("id1", "id2", "num_link", "gap", F.col("id1").alias("s1"), (-F.col("id2")).alias("s2"), F.struct((-F.col("num_link")).alias("a"), F.abs("gap").alias("b"), "gap", "id1", "id2").alias("rank")))
    taken = None
    while not left.isEmpty():
        sides = left.select(F.col("s1").alias("side"), "rank").unionByName(left.select(F.col("s2").alias("side"), "rank"))
        first = sides.groupBy("side").agg(F.min("rank").alias("best"))
        best = left.join(first.select(F.col("side").alias("s1"), F.col("best").alias("b1")), "s1").join(first.select(F.col("side").alias("s2"), F.col("best").alias("b2")), "s2")
        now = cut(best.where("rank = b1 AND rank = b2").select("id1", "id2", "num_link", "gap", "s1", "s2"))
        taken = now if taken is None else taken.unionByName(now)
        used = now.select(F.explode(F.array("s1", "s2")).alias("side"))
        left = cut(left.join(used.select(F.col("side").alias("s1")), "s1", "left_anti").join(used.select(F.col("side").alias("s2")), "s2", "left_anti").select(left.columns))
    return (left if taken is None else taken).select("id1", "id2", "num_link", "gap")


def chain_offsets(chain_rows: DataFrame, joins: DataFrame, lengths: DataFrame) -> DataFrame:
    """Start and end of every node on its chain, from the lengths of the nodes and the gaps of the joins; gaps may be negative."""
    from pyspark.sql import Window

    w = Window.partitionBy("chain").orderBy("place")
    rows = chain_rows.join(lengths.select(F.col("contig_id").alias("node"), "len"), "node").withColumn("signed", F.col("node") * F.col("sign")).withColumn("before", F.lag("signed").over(w))
    both = joins.select(F.col("id1").alias("before"), F.col("id2").alias("signed"), "gap").unionByName(joins.select((-F.col("id2")).alias("before"), (-F.col("id1")).alias("signed"), "gap"))
    rows = rows.join(both, ["before", "signed"], "left").withColumn("end", F.sum(F.col("len") + F.coalesce("gap", F.lit(0))).over(w))
    return rows.select("chain", "place", "node", "sign", (F.col("end") - F.col("len")).alias("start"), "end")


def phase_blocks(evidence: DataFrame) -> DataFrame:
    """Haplotype parity of blocks from evidence between them: `block`, `phase_set` (its lowest block), `parity` (0 or 1).

    `evidence` has `x` < `y`, `parallel`, `crossed`. The sets are joined along the evidence with the largest difference (ties: lower
    ids), crossed evidence turning one side: a maximum spanning forest with parity, built in rounds in which every set picks its
    best link. Pointer doubling carries parity along the picks. Equal evidence joins nothing.
    """
    links = evidence.where("parallel <> crossed").select("x", "y", F.abs(F.col("parallel") - F.col("crossed")).alias("w"), (F.col("crossed") > F.col("parallel")).cast("int").alias("turn"))
    links = cut(links)
    sets = cut(evidence.select(F.explode(F.array("x", "y")).alias("block")).distinct().select("block", F.col("block").alias("s"), F.lit(0).alias("p")))
    while True:
        a, b = sets.select(F.col("block").alias("x"), F.col("s").alias("sx"), F.col("p").alias("px")), sets.select(F.col("block").alias("y"), F.col("s").alias("sy"), F.col("p").alias("py"))
        out = links.join(a, "x").join(b, "y").where("sx <> sy").select("sx", "sy", "w", "x", "y", F.expr("(turn + px + py) % 2").alias("t"))
        both = out.unionByName(out.select(F.col("sy").alias("sx"), F.col("sx").alias("sy"), "w", "x", "y", "t"))
        pick = cut(both.groupBy("sx").agg(F.min(F.struct((-F.col("w")).alias("k"), "x", "y", "sy", "t")).alias("m")).select(F.col("sx").alias("s"), F.col("m.sy").alias("to"), F.col("m.t").alias("t")))
        if pick.isEmpty():
            break
        mutual = pick.select(F.col("to").alias("s"), F.col("s").alias("to"), F.lit(True).alias("_m"))
        ptr = pick.join(mutual, ["s", "to"], "left").withColumn("_root", F.col("_m").isNotNull() & (F.col("s") < F.col("to")))
        ptr = cut(ptr.select("s", F.when(F.col("_root"), F.col("s")).otherwise(F.col("to")).alias("to"), F.when(F.col("_root"), 0).otherwise(F.col("t")).alias("t")))
        while True:
            nxt = ptr.select(F.col("s").alias("to"), F.col("to").alias("_to"), F.col("t").alias("_t"))
            new = cut(ptr.join(nxt, "to").select("s", F.col("_to").alias("to"), F.expr("(t + _t) % 2").alias("t"), (F.col("_to") != F.col("to")).alias("_moved")))
            ptr = new.select("s", "to", "t")
            if new.where("_moved").isEmpty():
                break
        sets = cut(sets.join(ptr, "s", "left").select("block", F.coalesce("to", "s").alias("s"), F.expr("(p + coalesce(t, 0)) % 2").alias("p")))
    low = sets.groupBy("s").agg(F.min(F.struct("block", "p")).alias("m"))
    return sets.join(low, "s").select("block", F.col("m.block").alias("phase_set"), F.expr("(p + m.p) % 2").alias("parity"))


def block_evidence(partners: DataFrame, shared: DataFrame) -> DataFrame:
    """Evidence between allele pairs (named by their first member): links within (`parallel`) and across (`crossed`) haplotypes."""
    side = partners.select(F.col("a").alias("block"), F.col("a").alias("contig"), F.lit(0).alias("h")).unionByName(partners.select(F.col("a").alias("block"), F.col("b").alias("contig"), F.lit(1).alias("h")))
    one = lambda n: side.select(F.col("contig").alias(n), F.col("block").alias(f"b{n}"), F.col("h").alias(f"h{n}"))
    rows = shared.join(one("a"), "a").join(one("b"), "b").where("ba <> bb")
    return rows.groupBy(F.least("ba", "bb").alias("x"), F.greatest("ba", "bb").alias("y")).agg(F.sum(F.when(F.col("ha") == F.col("hb"), F.col("n")).otherwise(0)).alias("parallel"), F.sum(F.when(F.col("ha") != F.col("hb"), F.col("n")).otherwise(0)).alias("crossed"))
