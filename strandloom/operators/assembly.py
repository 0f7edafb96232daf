"""Assembly of word graphs (unitigs, tips, bubbles, choice of word lengths) and closing of gaps by local reads."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.codes import canonical_code, coded_words, dealt_words, run_words, runs, word_text
from strandloom.functions.pieces import joint_ends, pieces
from strandloom.functions.seq import revcomp
from strandloom.operators import graph
from strandloom.plans.shared import cut, settings
from strandloom.sources.tables import fanned, partitions


def unitigs(counts: DataFrame, k: int = 21) -> DataFrame:
    """Unbranched stretches of a word graph with their text: `unitig` (code of the lowest word), `bases`, `n_words`, `coverage` (6 digits).

    Words are joined to pieces within tasks (`pieces`), pieces by `joined`. A ring is opened at its lowest word. The text is read
    on the strand on which it is lower.
    """
    return _spelled(joined(cut(pieces(counts, k)), k), k)


def joined(units: DataFrame, k: int = 21) -> DataFrame:
    """`units` (as of `pieces`) with those joined that meet at a joint alone, one on either side. Kept in the shared folder."""
    meet = _meetings(units, k).where("x <> y")
    # Codes may be 0, which has no sign: chains work on codes + 1.
    named = meet.select((F.when(F.col("x_side") == "R", F.col("x") + 1).otherwise(-F.col("x") - 1)).alias("id1"), (F.when(F.col("y_side") == "R", -F.col("y") - 1).otherwise(F.col("y") + 1)).alias("id2"))
    at = units.join(_paths(named).withColumn("unitig", F.col("node") - 1), "unitig", "left")
    at = at.select("unitig", "n_words", "total", F.coalesce("chain", F.col("unitig") + 1).alias("chain"), F.coalesce("place", F.lit(1)).alias("place"), F.when(F.col("sign") < 0, revcomp(F.col("bases"))).otherwise(F.col("bases")).alias("t"))
    part = F.struct("place", F.when(F.col("place") == 1, F.col("t")).otherwise(F.expr(f"substring(t, {k})")).alias("t"))
    got = at.groupBy("chain").agg(F.min("unitig").alias("unitig"), F.sort_array(F.collect_list(part)).alias("ps"), F.sum("n_words").alias("n_words"), F.sum("total").alias("total"))
    return cut(got.select("unitig", F.array_join(F.transform("ps", lambda p: p["t"]), "").alias("bases"), "n_words", "total"))


def _paths(joins: DataFrame) -> DataFrame:
    """`node`, `chain`, `place`, `sign` as `graph.chains` has them, but that `chain` is the end with the lower id; in a third of the jobs.

    Every state (a node on a strand) knows the one its walk back has come to, three times as far in each round; those at an end go
    no further. Every round brings some state of each longer walk to its end, so that a round that brings none leaves rings only.
    """
    heads = [("id2", "id1"), ("id1", None), (-F.col("id1"), -F.col("id2")), (-F.col("id2"), None)]
    ends = F.array(*[F.struct((F.col(s) if isinstance(s, str) else s).alias("s"), (F.lit(None).cast("bigint") if b is None else F.col(b) if isinstance(b, str) else b).alias("prev")) for s, b in heads])
    back = cut(joins.select(F.explode(ends).alias("e")).select("e.*").groupBy("s").agg(F.max("prev").alias("prev")))
    state, before = back.select("s", "prev", F.when(F.col("prev").isNull(), 0).otherwise(1).cast("bigint").alias("dist"), F.when(F.col("prev").isNull(), F.col("s")).alias("root")), None
    while True:
        far = state.select(F.col("s").alias("at"), F.col("prev").alias("_p"), F.col("dist").alias("_d"), F.col("root").alias("_r"))
        for _ in range(2):
            # Those at an end meet themselves, so that no key is shared by many.
            at = state.select(F.coalesce("prev", "s").alias("at"), "s", F.col("prev").isNull().alias("ended"), "dist", "root")
            state = at.join(far, "at").select("s", F.when(~F.col("ended"), F.col("_p")).alias("prev"), (F.col("dist") + F.when(F.col("ended"), 0).otherwise(F.col("_d"))).alias("dist"), F.coalesce("root", "_r").alias("root"))
        state = cut(state)
        n = state.where("prev IS NOT NULL").count()
        if n in (0, before):
            break
        before = n
    strand = lambda up: F.max(F.when(F.col("s") > 0 if up else F.col("s") < 0, F.struct("root", "dist")))
    both = state.where("prev IS NULL").groupBy(F.abs("s").alias("node")).agg(strand(True).alias("u"), strand(False).alias("d"))
    up = F.abs("u.root") < F.abs("d.root")
    pick = lambda c: F.when(up, F.col("u." + c)).otherwise(F.col("d." + c))
    paths = both.select("node", F.abs(pick("root")).alias("chain"), (pick("dist") + 1).alias("place"), F.when(up, 1).otherwise(-1).alias("sign"))
    if not n:
        return paths
    # Of a join and its turned twin one.
    ring = back.where("prev + s < 0").join(state.where("prev IS NOT NULL").select("s"), "s", "left_semi")
    return paths.unionByName(graph.chains(cut(ring.select(F.col("prev").alias("id1"), F.col("s").alias("id2")))))


def _meetings(units: DataFrame, k: int) -> DataFrame:
    """Ends that are alone with each other at their joint: `x`, `x_side`, `y`, `y_side`; all heads of a joint that is its own reverse complement are `same`."""
    one = lambda same, c: F.max(F.when(F.col("same") == same, F.col(c)))
    at = unitig_ends(units, k).groupBy("joint").agg(
        F.count_if("same").alias("_a"), F.count_if(~F.col("same")).alias("_b"), one(True, "unitig").alias("x"), one(True, "side").alias("x_side"), one(False, "unitig").alias("y"), one(False, "side").alias("y_side"))
    return at.where("_a = 1 AND _b = 1").select("x", "x_side", "y", "y_side")


def _covered(units: DataFrame) -> DataFrame:
    return units.select("unitig", "bases", "n_words", F.round(F.col("total") / F.col("n_words"), 6).alias("coverage"))


def _spelled(units: DataFrame, k: int) -> DataFrame:
    """`units` as `unitigs` gives them: rings, whose ends meet each other, are turned to begin with their lowest word, as it is."""
    rings = _meetings(units, k).where("x = y").select(F.col("x").alias("unitig"), F.lit(True).alias("ring"))
    low = units.join(rings, "unitig", "left").withColumn("w", F.when(F.col("ring"), word_text(F.col("unitig"), k)))
    low = low.withColumn("t", F.when(F.col("ring") & ~F.contains("bases", F.col("w")), revcomp(F.col("bases"))).otherwise(F.col("bases"))).withColumn("p", F.expr("instr(t, w)"))
    text = F.when(F.col("ring"), F.expr(f"concat(substring(t, p), substring(t, {k}, p - 1))")).otherwise(F.col("t"))
    return _covered(low.withColumn("bases", text)).withColumn("bases", F.least("bases", revcomp(F.col("bases"))))


def unitig_ends(units: DataFrame, k: int = 21) -> DataFrame:
    """The joints of k - 1 bases at both ends of every unitig: `unitig`, `side` (L, R), `joint`, `same`; both sides as heads at their joint."""
    return joint_ends(units, k)


def unitig_tips(units: DataFrame, k: int = 21, ratio: float = 0.5) -> DataFrame:
    """Unitigs to cut as tips: at most k words, a free end, and at most `ratio` times the coverage of the best sibling at the other.

    Siblings begin at the same joint in the same reading.
    """
    e = unitig_ends(units, k).join(units.select("unitig", "coverage"), "unitig")
    w, s = Window.partitionBy("joint"), Window.partitionBy("joint", "same")
    at = e.withColumn("facing", F.count(F.lit(1)).over(w) - F.count(F.lit(1)).over(s)).withColumn("best", F.max("coverage").over(s)).withColumn("heads", F.count(F.lit(1)).over(s))
    per = at.groupBy("unitig").agg(F.count_if(F.expr("facing = 0 AND heads = 1")).alias("free"), F.max(F.when((F.col("facing") > 0) & (F.col("heads") > 1), F.col("best"))).alias("best"))
    rows = units.join(per, "unitig").where((F.col("n_words") <= k) & (F.col("free") == 1) & (F.col("coverage") <= ratio * F.col("best")))
    return rows.select("unitig", "n_words", "coverage", F.col("best").alias("best_sibling"))


def unitig_bubbles(units: DataFrame, k: int = 21, rate: float = 0.1) -> DataFrame:
    """Pairs of unitigs between the same two joints, each alone with the other there, with their edit distance; and the one kept.

    `a` < `b`; they collapse if the distance is at most `rate` of the longer. Kept is the higher coverage, of equal ones `a`.
    """
    e = unitig_ends(units, k)
    key = F.concat_ws(":", F.col("joint").cast("string"), F.col("same").cast("string"))
    ends = e.groupBy("unitig").agg(F.array_join(F.sort_array(F.collect_list(key)), "|").alias("ends"))
    pairs = ends.groupBy("ends").agg(F.count(F.lit(1)).alias("n"), F.min("unitig").alias("a"), F.max("unitig").alias("b")).where("n = 2").select("a", "b")
    u = units.select("unitig", "bases", "coverage")
    rows = pairs.join(u.select(F.col("unitig").alias("a"), F.col("bases").alias("ta"), F.col("coverage").alias("ca")), "a").join(u.select(F.col("unitig").alias("b"), F.col("bases").alias("tb"), F.col("coverage").alias("cb")), "b")
    d = F.least(F.levenshtein("ta", "tb"), F.levenshtein("ta", revcomp(F.col("tb"))))
    return rows.select("a", "b", d.cast("bigint").alias("distance"), (d <= rate * F.greatest(F.length("ta"), F.length("tb"))).alias("collapses"), F.when(F.col("ca") >= F.col("cb"), F.col("a")).otherwise(F.col("b")).alias("kept"))


def weak_unitigs(units: DataFrame, length: int, coverage: float) -> DataFrame:
    """Unitigs shorter and thinner than both limits: errors."""
    return units.where((F.length("bases") < length) & (F.col("coverage") < coverage))


def cleaned_unitigs(counts: DataFrame, k: int = 21) -> DataFrame:
    """`unitigs` without tips and the weaker arm of collapsing bubbles, again and again until nothing is cut."""
    return _spelled(_cleaned(counts, k), k)


def _cleaned(counts: DataFrame, k: int) -> DataFrame:
    """The cleaned graph, as `joined` gives it.

    Cutting joins what was branched at the cut's ends. Words are joined once; each round works on the unitigs of the one before, in
    the shared folder. A round that goes on has cut something, so that they end.
    """
    units = joined(cut(pieces(counts, k)), k)
    while True:
        now = _covered(units)
        arms = unitig_bubbles(now, k).where("collapses").select(F.when(F.col("kept") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("unitig"))
        gone = cut(unitig_tips(now, k).select("unitig").unionByName(arms).distinct())
        if gone.isEmpty():
            return units
        units = joined(cut(units.join(gone, "unitig", "left_anti")), k)


def clean_words(counts: DataFrame, k: int = 21) -> DataFrame:
    """The word counts that `cleaned_unitigs` are made of."""
    left = coded_words(_cleaned(counts, k), [], k).select(canonical_code(F.col("code"), k).alias("code"))
    return cut(counts.join(left, "code", "left_semi").select("code", "n"))


def log_join(cutoff: Column | int, coverage: Column, length: Column, large: Column, small: Column, most: int = 64) -> Column:
    """Log probability that stretches stay joined when words grow from `small` to `large` bases: (large - small + 1) times minus the
    Poisson probability of fewer than `cutoff` occurrences (at most `most`)."""
    lam = coverage * (length - large + 1.0) / length
    i = F.sequence(F.lit(0), F.lit(cutoff) - 1 if isinstance(cutoff, int) else cutoff - 1)
    logs = [sum(math.log(j) for j in range(1, x + 1)) for x in range(most)]
    fact = F.array(*[F.lit(x) for x in logs])
    s = F.aggregate(F.transform(i, lambda x: F.exp(x * F.log(lam) - F.get(fact, x) - lam)), F.lit(0.0), lambda a, x: a + x)
    return -(large - small + 1.0) * s


def word_steps(figures: DataFrame, smallest: int = 21, largest: int = 40, cutoffs: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """`large`, `cutoff`, `log_p` of growing words by one base at a time, from one row `coverage`, `length`."""
    grid = figures.select("coverage", "length", F.explode(F.sequence(F.lit(smallest + 1), F.lit(largest))).alias("large")).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    return grid.select("large", "cutoff", F.round(log_join(F.col("cutoff"), F.col("coverage"), F.col("length"), F.col("large"), F.col("large") - 1), 9).alias("log_p"))


def next_words(steps: DataFrame, accuracy: float = 8.0) -> DataFrame:
    """Per cutoff the largest word length all steps up to which keep log_p >= log(1 - 10^-accuracy); null if the first does not."""
    floor = math.log(1 - 10**-accuracy)
    bad = steps.groupBy("cutoff").agg(F.min(F.when(F.col("log_p") < floor, F.col("large"))).alias("bad"), F.max("large").alias("top"), F.min("large").alias("first"))
    return bad.select("cutoff", F.when(F.col("bad") == F.col("first"), F.lit(None)).otherwise(F.coalesce(F.col("bad") - 1, "top")).cast("int").alias("largest_k"))


# ---- gaps ----


def filling_votes(gaps: DataFrame, scaffolds: DataFrame, read_set: DataFrame, anchor: int = 20) -> DataFrame:
    """Every text that a read shows between the anchors of a gap: `scaffold_id`, `gap_no`, `filling`, `n_reads`.

    Reads are shuffled as runs of words; the text is fetched for those that hold a left anchor, once for all gaps that have it. Kept
    in the shared folder.
    """
    text = scaffolds.select("scaffold_id", "bases")
    flank = gaps.where(f"left_flank >= {anchor} AND right_flank >= {anchor}").join(text, "scaffold_id").select(
        "scaffold_id", "gap_no", F.expr(f"substring(bases, cast(gap_start - {anchor} + 1 as int), {anchor})").alias("bases"), F.expr(f"substring(bases, cast(gap_end + 1 as int), {anchor})").alias("right_anchor"))
    key, n = ["lib_no", "pair_id", "mate"], partitions(read_set.sparkSession)
    left = dealt_words(coded_words(flank.select("bases").distinct(), [], anchor).select("code"), [], anchor).repartition(n, "part")
    at = run_words(runs(fanned(read_set, "pair_id", "mate"), key, anchor).repartition(n, "part"), key, anchor)
    # The anchor on either strand of the read; a word that is its own reverse complement stands on both.
    strands = F.when(F.col("_own"), F.array(F.lit(1), F.lit(-1))).when(F.col("same") == F.col("_same"), F.array(F.lit(1))).otherwise(F.array(F.lit(-1)))
    found = at.join(left.hint("merge"), ["part", "code"]).select(*key, "at", "back", F.explode(strands).alias("strand"))
    found = found.select(*key, "strand", F.when(F.col("strand") > 0, F.col("at")).otherwise(F.col("back")).alias("at"))
    r = F.when(F.col("strand") > 0, F.col("bases")).otherwise(revcomp(F.col("bases")))
    hits = found.join(read_set.select(*key, "bases"), key).select(F.substring(r, F.col("at") + 1, F.lit(anchor)).alias("bases"), F.substring(r, F.col("at") + (anchor + 1), F.length("bases")).alias("rest"))
    # What does not hold the right anchor leaves where the two meet; gaps with the same two anchors are one until then.
    both = hits.join(flank.select("bases", "right_anchor").distinct().hint("merge"), "bases").withColumn("p", F.instr("rest", F.col("right_anchor"))).where("p > 0")
    votes = both.groupBy("bases", "right_anchor", F.expr("substring(rest, 1, p - 1)").alias("filling")).agg(F.count(F.lit(1)).alias("n_reads"))
    with settings(read_set.sparkSession, spark__sql__requireAllClusterKeysForCoPartition="false"):
        return cut(flank.join(votes.hint("merge"), ["bases", "right_anchor"]).select("scaffold_id", "gap_no", "filling", "n_reads"))


def closed_gaps(votes: DataFrame, least: int = 3, rate: float = 0.75) -> DataFrame:
    """Gaps with at least `least` spanning reads, at least `rate` of which agree on the length: `length`, `filling` by majority of bases.

    The most frequent length counts (the shortest of a tie); at each place the most frequent base of its texts (the lowest of a tie).
    """
    total = votes.groupBy("scaffold_id", "gap_no").agg(F.sum("n_reads").alias("n_reads")).where(F.col("n_reads") >= least)
    by = votes.groupBy("scaffold_id", "gap_no", F.length("filling").alias("length")).agg(F.sum("n_reads").alias("m"))
    best = by.groupBy("scaffold_id", "gap_no").agg(F.max(F.struct("m", (-F.col("length")).alias("k"))).alias("b")).select("scaffold_id", "gap_no", F.col("b.m").alias("m"), (-F.col("b.k")).alias("length"))
    good = best.join(total, ["scaffold_id", "gap_no"]).where(F.col("m") >= rate * F.col("n_reads"))
    bases = votes.join(good.select("scaffold_id", "gap_no", "length"), ["scaffold_id", "gap_no"]).where("length(filling) = length AND length > 0").select("scaffold_id", "gap_no", "n_reads", F.posexplode(F.split("filling", "")).alias("i", "base")).where("base <> ''")
    at = bases.groupBy("scaffold_id", "gap_no", "i", "base").agg(F.sum("n_reads").alias("c")).groupBy("scaffold_id", "gap_no", "i").agg(F.max(F.struct("c", (-F.ascii("base")).alias("k"))).alias("b"))
    text = at.groupBy("scaffold_id", "gap_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.char(-F.col("b.k")).alias("s")))), lambda x: x["s"]), "").alias("filling"))
    return good.join(text, ["scaffold_id", "gap_no"], "left").select("scaffold_id", "gap_no", "n_reads", F.col("length").cast("bigint").alias("length"), F.coalesce("filling", F.lit("")).alias("filling"))


def filled(scaffolds: DataFrame, gaps: DataFrame, fills: DataFrame) -> DataFrame:
    """Scaffolds with the gaps of `fills` replaced by their text: `scaffold_id`, `bases`. The pieces of one scaffold make one row again."""
    text = scaffolds.where("bases <> ''").select("scaffold_id", "bases")
    at = gaps.join(fills.select("scaffold_id", "gap_no", "filling"), ["scaffold_id", "gap_no"]).select("scaffold_id", "gap_start", "gap_end", "filling")
    ends = at.select("scaffold_id", F.col("gap_end").alias("a"), "filling").unionByName(text.select("scaffold_id", F.lit(0).cast("bigint").alias("a"), F.lit("").alias("filling")))
    starts = at.select("scaffold_id", F.col("gap_start").alias("b"))
    w = Window.partitionBy("scaffold_id")
    p = ends.withColumn("i", F.row_number().over(w.orderBy("a"))).join(starts.withColumn("i", F.row_number().over(w.orderBy("b"))), ["scaffold_id", "i"], "left").join(text, "scaffold_id")
    piece = F.concat("filling", F.expr("substring(bases, cast(a + 1 as int), cast(coalesce(b, length(bases)) - a as int))"))
    return p.select("scaffold_id", F.struct("i", piece.alias("t")).alias("p")).groupBy("scaffold_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["t"]), "").alias("bases"))


def local_reads(mapped: DataFrame, read_set: DataFrame, parts: DataFrame, gaps: DataFrame, libraries: DataFrame, lengths: DataFrame, factor: float = 3.0, width: int = 1000) -> DataFrame:
    """Reads that should lie in a gap: mates of placed reads whose expected place, within `factor` deviations of the insert, meets it.

    `scaffold_id`, `gap_no`, `lib_no`, `pair_id`, `mate` (the read to fetch). A read that looks right is followed by its mate one insert
    on; one that looks left is preceded by it. Joined by bins of positions.
    """
    once = parts.groupBy("contig_id").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("contig_id")
    at = parts.join(once, "contig_id", "left_semi").select("contig_id", "scaffold_id", F.col("strand").alias("s"), "comp_start", "comp_end")
    lib = F.broadcast(libraries.where("avg_ins > 0 AND sd_ins > 0").select("lib_no", "avg_ins", (F.lit(factor) * F.col("sd_ins")).alias("tol")))
    n = read_set.select("lib_no", "pair_id", "mate", F.length("bases").alias("n"))
    rows = mapped.join(n, ["lib_no", "pair_id", "mate"]).withColumn("contig_id", F.abs("signed_id")).join(at, "contig_id").join(lib, "lib_no").join(lengths.select("scaffold_id", F.col("len").alias("sl")), "scaffold_id")
    place = F.when(F.col("signed_id") > 0, F.col("diagonal")).otherwise(F.col("diagonal") + F.col("n") - 1)
    pos = F.when(F.col("s") == "-", F.col("comp_end") - 1 - place).otherwise(F.col("comp_start") + place)
    ahead = (F.col("signed_id") > 0) == (F.col("s") == "+")
    mate = n.select("lib_no", "pair_id", (3 - F.col("mate")).alias("mate"), F.col("n").alias("m"))
    rows = rows.join(mate, ["lib_no", "pair_id", "mate"]).withColumns({"pos": pos, "ahead": ahead})
    lo = F.when(F.col("ahead"), F.greatest(F.col("pos"), F.col("pos") + F.col("avg_ins") - F.col("tol") - F.col("m"))).otherwise(F.col("pos") - F.col("avg_ins") - F.col("tol"))
    hi = F.when(F.col("ahead"), F.col("pos") + F.col("avg_ins") + F.col("tol")).otherwise(F.least(F.col("pos"), F.col("pos") - F.col("avg_ins") + F.col("tol") + F.col("m")))
    span = rows.select("scaffold_id", "lib_no", "pair_id", (3 - F.col("mate")).alias("mate"), F.greatest(lo, F.lit(0)).cast("bigint").alias("lo"), F.least(hi, F.col("sl")).cast("bigint").alias("hi")).where("lo < hi")
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width))).alias("bin")
    g = gaps.select("scaffold_id", "gap_no", "gap_start", "gap_end", bins("gap_start", "gap_end"))
    return span.select("*", bins("lo", "hi")).join(g, ["scaffold_id", "bin"]).where("lo < gap_end AND hi > gap_start").select("scaffold_id", "gap_no", "lib_no", "pair_id", "mate").distinct()


def local_word_counts(local: DataFrame, read_set: DataFrame, k: int = 24) -> DataFrame:
    """Words of the local reads of every gap: how many distinct ones, how many in all, and reads."""
    reads = local.join(read_set.select("lib_no", "pair_id", "mate", "bases"), ["lib_no", "pair_id", "mate"]).select("scaffold_id", "gap_no", "bases")
    per = coded_words(fanned(reads), ["scaffold_id", "gap_no"], k).groupBy("scaffold_id", "gap_no", canonical_code(F.col("code"), k).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    n = local.groupBy("scaffold_id", "gap_no").agg(F.count(F.lit(1)).alias("n_reads"))
    return per.groupBy("scaffold_id", "gap_no").agg(F.count(F.lit(1)).alias("n_words"), F.sum("n").alias("total")).join(n, ["scaffold_id", "gap_no"])


def assembled_gaps(gaps: DataFrame, scaffolds: DataFrame, local: DataFrame, read_set: DataFrame, k: int = 24, least: int = 1, rounds: int | None = 8) -> DataFrame:
    """Gaps closed by a path of words of their local reads: `scaffold_id`, `gap_no`, `filling`.

    The words of both strands of a gap's reads, and of its flanks, are its graph; a word leads on where exactly one word of at least
    `least` occurrences follows. A gap is closed if the walk from the last k bases of the left flank meets the first k bases of the
    right one, with `rounds` within 2^rounds bases only; without (None) however far that is, until it ends or goes round in a ring. The
    distinct words of a gap are sorted in one task, which looks up what follows.
    """
    text, key = scaffolds.select("scaffold_id", "bases"), ["scaffold_id", "gap_no"]
    flank = gaps.where(f"left_flank >= {k} AND right_flank >= {k}").join(text, "scaffold_id").select(
        *key, F.expr(f"substring(bases, cast(gap_start - {k} + 1 as int), {k})").alias("l"), F.expr(f"substring(bases, cast(gap_end + 1 as int), {k})").alias("r"))
    flank = cut(flank)
    reads = local.join(read_set.select("lib_no", "pair_id", "mate", "bases"), ["lib_no", "pair_id", "mate"]).select(*key, "bases")
    own = coded_words(fanned(reads, *key), key, k, both=True).select(*key, "code")
    ends = lambda c: coded_words(flank.select(*key, F.col(c).alias("bases")), key, k).select(*key, "code")
    left, right = ends("l"), ends("r")
    nodes = own.unionByName(left).unionByName(right).groupBy(*key, "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kinds = [df.select(*key, F.lit(kind).alias("kind"), "code") for kind, df in enumerate((left, right, nodes))]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).repartition(partitions(read_set.sparkSession), *key).sortWithinPartitions(*key, "kind", "code")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(lambda batches: _walked(batches, k, None if rounds is None else 1 << rounds), f"scaffold_id {types['scaffold_id']}, gap_no {types['gap_no']}, filling string")


def _walked(batches: Iterator[pa.RecordBatch], k: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Walks (of at most `most` steps, if that is given) through the words of each gap, of rows in the order of gap, `kind` (0 left, 1 right, 2 any) and `code`."""
    gap, ends, held = None, {}, []

    def walk() -> str | None:
        if len(ends) < 2 or not held:
            return None
        nodes, at, out = np.concatenate(held), ends[0], []
        i = np.searchsorted(nodes, at)
        if i == len(nodes) or nodes[i] != at:
            return None
        mark, far = at, 1  # a walk that meets its mark again goes round; the mark moves on at each doubling of the steps
        while at != ends[1] and (most is None or len(out) < most):
            first = (at & ((1 << 2 * (k - 1)) - 1)) << 2
            a, b = np.searchsorted(nodes, [first, first + 4])
            if b - a != 1 or nodes[a] == at:
                return None
            at = int(nodes[a])
            if at == mark:
                return None
            out.append("ACGT"[at & 3])
            if len(out) == far:
                mark, far = at, 2 * far
        return "".join(out[: len(out) - k]) if at == ends[1] and len(out) >= k else None

    def found(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if (text := walk()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([gap[0]], schema.field(0).type), pa.array([gap[1]], schema.field(1).type), pa.array([text])], ["scaffold_id", "gap_no", "filling"])

    schema = None
    for batch in batches:
        schema = batch.schema
        s, g, kind, code = (batch.column(c).to_numpy() for c in range(4))
        begin = np.flatnonzero(np.concatenate([[len(s) > 0], (s[1:] != s[:-1]) | (g[1:] != g[:-1]) | (kind[1:] != kind[:-1])]))
        for a, b in zip(begin, [*begin[1:], len(s)]):
            if (s[a], g[a]) != gap:
                yield from found(schema)
                gap, ends, held = (s[a], g[a]), {}, []
            if kind[a] < 2:
                ends[int(kind[a])] = int(code[a])
            elif len(ends) == 2:
                held.append(code[a:b].copy())
    if schema is not None:
        yield from found(schema)
