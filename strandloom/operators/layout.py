"""Parts of scaffolds: layout, gaps, fragments, coverage, division and sequence building."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import revcomp


def placed(parts: DataFrame) -> DataFrame:
    """Parts with their contig, strand and the gap to the part before (null for the first)."""
    w = Window.partitionBy("scaffold_id").orderBy("part_no", "comp_start", "comp_end", "contig_ref")
    return parts.select(
        "scaffold_id", "part_no", "contig_ref", F.abs("contig_ref").alias("contig_id"), F.when(F.col("contig_ref") < 0, "-").otherwise("+").alias("strand"),
        "comp_start", "comp_end", (F.col("comp_start") - F.lag("comp_end").over(w)).alias("gap"), F.lag("contig_ref").over(w).alias("before"),
    )


def offsets(counts: DataFrame, key: str, n: str) -> DataFrame:
    """`key` and the sum `before` of `n` over all lower keys; in two steps, so that no task orders all keys.

    Keys are dealt to partitions by range, however sparse they are; the ranges are kept in the shared folder, as both steps need
    the same ones, and one row per partition is ordered as a whole.
    """
    from strandloom.plans.shared import cut

    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(counts.select(key, n).repartitionByRange(parts, key).withColumn("_b", F.spark_partition_id()))
    sums = rows.groupBy("_b").agg(F.sum(n).alias("_n"), F.min(key).alias("_k"))
    base = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum(n).over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inner).join(base, "_b").select(key, (F.col("_base") + F.col("_in")).alias("before"))


def gap_table(scaffolds: DataFrame, min_gap: int = 1) -> DataFrame:
    """Runs of at least `min_gap` N: `scaffold_id`, `gap_no` from 1, `gap_start`, `gap_end`, lengths of the clean flanks."""
    runs = scaffolds.select("scaffold_id", F.posexplode(F.transform(F.regexp_extract_all("bases", F.lit("(N+|[^N]+)"), F.lit(1)), lambda t: F.struct(F.length(t).cast("bigint").alias("n"), t.startswith("N").alias("is_n")))).alias("i", "run"))
    w = Window.partitionBy("scaffold_id").orderBy("i")
    at = runs.select(
        "scaffold_id", "i", "run.n", "run.is_n", (F.sum("run.n").over(w) - F.col("run.n")).alias("gap_start"),
        F.coalesce(F.lag("run.n").over(w), F.lit(0)).alias("left_flank"), F.coalesce(F.lead("run.n").over(w), F.lit(0)).alias("right_flank"),
    ).where(F.col("is_n") & (F.col("n") >= min_gap))
    return at.select("scaffold_id", F.row_number().over(w).alias("gap_no"), "gap_start", (F.col("gap_start") + F.col("n")).alias("gap_end"), "left_flank", "right_flank")


def review_fragments(scaffolds: DataFrame, gaps: DataFrame) -> DataFrame:
    """Fragments of every scaffold, cut in the middle of each gap, as the review assembly lists them.

    `record_no` numbers the fragments of all scaffolds in the order of `scaffold_id`. A scaffold without bases is one
    fragment of length 0.
    """
    cuts = gaps.select("scaffold_id", F.col("gap_no").alias("i"), (F.col("gap_start") + F.floor((F.col("gap_end") - F.col("gap_start")) / 2)).alias("cut"))
    ends = cuts.unionByName(scaffolds.select("scaffold_id", F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("cut")))
    w = Window.partitionBy("scaffold_id").orderBy("i")
    frags = ends.join(scaffolds.select("scaffold_id", "name", F.length("bases").cast("bigint").alias("_n")), "scaffold_id").select(
        "scaffold_id", "name", F.row_number().over(w).alias("fragment_no"), F.col("cut").alias("frag_start"), F.coalesce(F.lead("cut").over(w), F.col("_n")).alias("frag_end")
    )
    before = offsets(frags.groupBy("scaffold_id").agg(F.count(F.lit(1)).alias("n")), "scaffold_id", "n")
    return frags.join(before, "scaffold_id").select(
        "scaffold_id", F.concat("name", F.lit(":::fragment_"), F.col("fragment_no").cast("string")).alias("fragment"), "fragment_no",
        (F.col("before") + F.col("fragment_no")).alias("record_no"), "frag_start", "frag_end",
    )


def node_coverage(parts: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per scaffold: length-weighted mean coverage of its contigs, of all and of those placed once only; null if none."""
    times = parts.groupBy("contig_id").agg(F.count(F.lit(1)).alias("_times"))
    rows = parts.join(times, "contig_id").join(contigs.select("contig_id", "len", "cov"), "contig_id")
    mean = lambda cond: F.sum(F.when(cond, F.col("len") * F.col("cov"))) / F.nullif(F.sum(F.when(cond, F.col("len"))), F.lit(0))
    return rows.groupBy("scaffold_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("len").alias("bases"), F.round(mean(F.lit(True)), 6).alias("coverage"), F.round(mean(F.col("_times") == 1), 6).alias("unique_coverage")
    )


def divide_at_gaps(parts: DataFrame, max_gap: int = 150) -> DataFrame:
    """Scaffolds cut where the gap to the part before exceeds `max_gap`: `piece_no` from 1 with its parts and extent."""
    w = Window.partitionBy("scaffold_id").orderBy("part_no", "comp_start", "comp_end", "contig_ref")
    numbered = parts.withColumn("piece_no", 1 + F.sum(F.when(F.col("gap") > max_gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("scaffold_id", "piece_no").agg(F.count(F.lit(1)).alias("n_parts"), F.min("comp_start").alias("piece_start"), F.max("comp_end").alias("piece_end"))


def piece_coverage(parts: DataFrame, contigs: DataFrame, max_gap: int = 150) -> DataFrame:
    """Length-weighted mean coverage of every piece that `divide_at_gaps` makes (6 digits)."""
    w = Window.partitionBy("scaffold_id").orderBy("part_no", "comp_start", "comp_end", "contig_ref")
    numbered = parts.withColumn("piece_no", 1 + F.sum(F.when(F.col("gap") > max_gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = numbered.join(contigs.select("contig_id", "len", "cov"), "contig_id")
    return rows.groupBy("scaffold_id", "piece_no").agg(F.sum("len").alias("bases"), F.round(F.sum(F.col("len") * F.col("cov")) / F.nullif(F.sum("len"), F.lit(0)), 6).alias("coverage"))


def sparse_ends(parts: DataFrame) -> DataFrame:
    """End parts whose adjacent gap is longer than the part itself; scaffolds of one part have none."""
    w = Window.partitionBy("scaffold_id").orderBy("part_no", "comp_start", "comp_end", "contig_ref")
    n = F.col("comp_end") - F.col("comp_start")
    rows = parts.withColumn("_next", F.lead("gap").over(w)).withColumn("_after", F.lead("contig_ref").over(w))
    left, right = F.col("before").isNull() & (F.col("_next") > n), F.col("_after").isNull() & (F.col("gap") > n)
    return rows.where(left | right).select("scaffold_id", "part_no", "contig_ref", F.when(left, "left").otherwise("right").alias("side"), F.when(left, F.col("_next")).otherwise(F.col("gap")).alias("gap"))


def flag_repeats(coverage: DataFrame, factor: float = 1.75) -> DataFrame:
    """Scaffolds and the classes of their coverage against the length-weighted mean: `is_repeat` (above factor x mean), `is_homo` (at least the mean)."""
    mean = coverage.agg((F.sum(F.col("coverage") * F.col("bases")) / F.sum("bases")).alias("m")).scalar()
    return coverage.select("scaffold_id", "coverage", (F.col("coverage") > factor * mean).alias("is_repeat"), (F.col("coverage") >= mean).alias("is_homo"))


def build_sequences(parts: DataFrame, contigs: DataFrame) -> DataFrame:
    """Sequences of scaffolds from their contigs: reversed where the sign says so, N for gaps, overlaps cut off the later part.

    One row per scaffold with its `bases`; parts of unknown contigs stand as N. The parts of one scaffold are gathered in one
    row, as the result is one row of that size.
    """
    rows = parts.join(contigs.select("contig_id", F.col("bases").alias("_b")), "contig_id", "left")
    seq = F.when(F.col("strand") == "-", revcomp(F.col("_b"))).otherwise(F.col("_b"))
    seq = F.coalesce(F.nullif(seq, F.lit("")), F.repeat(F.lit("N"), F.greatest(F.col("comp_end") - F.col("comp_start"), F.lit(0)).cast("int")))
    gap = F.coalesce("gap", F.lit(0))
    piece = F.concat(F.repeat(F.lit("N"), F.greatest(gap, F.lit(0)).cast("int")), F.expr("substring(_s, 1 + cast(greatest(-coalesce(gap, 0), 0) as int))"))
    listed = rows.withColumn("_s", seq).select("scaffold_id", F.struct("part_no", "comp_start", "comp_end", "contig_ref", piece.alias("s")).alias("p"))
    return listed.groupBy("scaffold_id").agg(F.sort_array(F.collect_list("p")).alias("ps")).select("scaffold_id", F.concat_ws("", F.transform("ps", lambda p: p["s"])).alias("bases"))


def n_statistics(lengths: DataFrame, shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """`share`, `n_len`: the length L so that sequences of at least L hold that share of all bases (N50 and so on).

    Equal lengths are counted before the running sum, which then runs over distinct lengths only.
    """
    by = lengths.where("len > 0").groupBy("len").agg((F.count(F.lit(1)) * F.col("len")).alias("mass"))
    total = by.agg(F.sum("mass")).scalar()
    run = by.withColumn("_run", F.sum("mass").over(Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)))
    want = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return run.select("len", "_run", want).where(F.col("_run") >= F.col("share") * total).groupBy("share").agg(F.max("len").alias("n_len"))
