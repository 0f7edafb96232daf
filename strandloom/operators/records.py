"""Records of sequences: pieces, headers, names, masks, and what is written of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import revcomp


def clean_pieces(records: DataFrame, key: str = "contig_id") -> DataFrame:
    """Sequences cut at their runs of N: `key`, `piece_no` from 1, `piece_start`, `bases`. Runs at either end give no piece."""
    runs = records.where("bases <> ''").select(key, F.posexplode(F.regexp_extract_all("bases", F.lit("(N+|[^N]+)"), F.lit(1))).alias("i", "t"))
    w = Window.partitionBy(key).orderBy("i")
    at = runs.withColumn("piece_start", (F.sum(F.length("t")).over(w) - F.length("t")).cast("bigint")).where("NOT startswith(t, 'N')")
    return at.select(key, F.row_number().over(w).alias("piece_no"), "piece_start", F.col("t").alias("bases"))


def median_length(records: DataFrame) -> DataFrame:
    """One row `n`, `median`: of n sorted lengths (0-based) the one at n // 2. Lengths are counted first, so few rows are ordered."""
    by = records.groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    total = by.agg(F.sum("c")).scalar()
    run = by.withColumn("_run", F.sum("c").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("_run") > F.floor(total / 2)).agg(F.min("len").alias("median"), F.max(total).alias("n")).where("n IS NOT NULL").select("n", "median")


def name_index(records: DataFrame) -> DataFrame:
    """`name`, `contig_id`: the lowest id of every name, and how many records bear it."""
    return records.where("name IS NOT NULL").groupBy("name").agg(F.min("contig_id").alias("contig_id"), F.count(F.lit(1)).alias("n"))


def halves(read_set: DataFrame, at: int) -> DataFrame:
    """Reads divided before position `at`; a read that ends there has an empty second half."""
    return read_set.select("lib_no", "pair_id", "mate", F.expr(f"substring(bases, 1, {at})").alias("head"), F.expr(f"substring(bases, {at + 1})").alias("rest"))


def headed_fasta(contigs: DataFrame, read_len: int, max_k: int) -> DataFrame:
    """FASTA text whose headers carry number, length, coverage, read length and largest word: one row a contig with bases."""
    from strandloom.functions.seq import wrapped

    head = F.concat(F.lit(">seq"), F.col("contig_id").cast("string"), F.lit("_len"), F.col("len").cast("string"), F.lit("_cov"), F.col("cov").cast("string"), F.lit(f"_read{read_len}_maxK{max_k}\n"))
    return contigs.where("bases <> ''").select(F.concat(head, wrapped(F.col("bases"))).alias("value"))


def fastg(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """FASTG records of both strands of every node: the header lists the nodes that follow (`'` marks the reverse strand).

    `nodes` has `contig_id`, `cov` and `bases`; a node's followers are gathered in its header.
    """
    name = lambda i, n, c, turned: F.concat(F.lit("NODE_"), F.col(i).cast("string"), F.lit("_length_"), F.col(n).cast("string"), F.lit("_cov_"), F.col(c).cast("string"), F.when(turned, "'").otherwise(""))
    far = nodes.select(F.col("contig_id").alias("dst"), F.length("bases").alias("_n"), F.col("cov").alias("_c"))
    to = edges.join(far, "dst").select("src", F.col("direction").alias("side"), name("dst", "_n", "_c", F.col("direction") * F.col("orient") < 0).alias("to"))
    lists = to.groupBy("src", "side").agg(F.array_join(F.sort_array(F.collect_set("to")), ",").alias("tos"))
    both = nodes.where("bases <> ''").select("contig_id", "cov", "bases", F.length("bases").alias("n"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("side"))
    rows = both.join(lists.withColumnRenamed("src", "contig_id"), ["contig_id", "side"], "left")
    head = F.concat(F.lit(">"), name("contig_id", "n", "cov", F.col("side") < 0), F.when(F.col("tos").isNotNull(), F.concat(F.lit(":"), F.col("tos"))).otherwise(""), F.lit(";"))
    return rows.select(F.concat(head, F.lit("\n"), F.when(F.col("side") > 0, F.col("bases")).otherwise(revcomp(F.col("bases")))).alias("value"))


def polished(contigs: DataFrame, masked: DataFrame, least: int = 50) -> DataFrame:
    """Contigs with the positions of `masked` (`contig_id`, `pos`) as N, then runs of fewer than `least` clean bases as N, then
    N trimmed off both ends: `contig_id`, `bases`. Contigs of which nothing is left are left out.
    """
    at = masked.groupBy("contig_id").agg(F.collect_set("pos").alias("at"))  # at most a contig's length
    rows = contigs.where("bases <> ''").select("contig_id", "bases").join(at, "contig_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for seq, at in zip(batch.column(1), batch.column(2)):
                s = bytearray(seq.as_py(), "ascii")
                for p in at.as_py() or ():
                    s[p] = 78
                out.append("".join(t if len(t) >= least or t.startswith("N") else "N" * len(t) for t in _runs(s.decode())).strip("N"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["contig_id", "bases"])

    return rows.mapInArrow(run, "contig_id long, bases string").where("bases <> ''")


def _runs(s: str) -> list[str]:
    import re

    return re.findall("N+|[^N]+", s)


def self_overlaps(contigs: DataFrame, least: int = 100) -> DataFrame:
    """Contigs whose end repeats their beginning over at least `least` bases, less than all: `contig_id`, the longest `overlap`.

    Candidates are the places at which the first 31 bases stand again; contigs whose first 31 bases hold an N have none.
    """
    from strandloom.functions.codes import coded_words
    from strandloom.sources.tables import fanned

    rows = fanned(contigs.where(F.length("bases") > least).select("contig_id", "bases"), "contig_id")
    words = coded_words(rows, ["contig_id"], 31)
    first = words.where("at = 0").select("contig_id", "code")
    again = words.where("at > 0").join(first, ["contig_id", "code"]).select("contig_id", "at")
    got = again.join(contigs.select("contig_id", "bases"), "contig_id").withColumn("overlap", (F.length("bases") - F.col("at")).cast("bigint"))
    return got.where((F.col("overlap") >= least) & F.expr("right(bases, overlap) = left(bases, overlap)")).groupBy("contig_id").agg(F.max("overlap").alias("overlap"))


def by_number(hist: DataFrame, key: str, edge: float = 0.01) -> DataFrame:
    """A histogram without `edge` / 2 of its rows at either end; the bin in which a border falls keeps what lies inside (6 digits)."""
    all_ = Window.partitionBy(key)
    up, down = all_.orderBy("value").rowsBetween(Window.unboundedPreceding, 0), all_.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.sum("n").over(all_) * (edge / 2)
    lo, hi = F.greatest(F.sum("n").over(up) - cut, F.lit(0.0)), F.greatest(F.sum("n").over(down) - cut, F.lit(0.0))
    inside = F.greatest(F.least(F.col("n").cast("double"), lo) + F.least(F.col("n").cast("double"), hi) - F.col("n"), F.lit(0.0))
    return hist.select(key, "value", F.round(inside, 6).alias("n")).where("n > 0")


def by_deviation(hist: DataFrame, key: str, edge: float = 3.0, rounds: int = 5) -> DataFrame:
    """A histogram clipped to mean +/- `edge` deviations, measured again on what is left, `rounds` times (or while it shrinks).

    Mean and deviation are rounded half up to whole numbers, and a value on a border stays.
    """
    rows = hist
    for _ in range(rounds):
        m = rows.groupBy(key).agg(F.floor(F.sum(F.col("n") * F.col("value")) / F.sum("n") + 0.5).alias("_m"), F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("value") * F.col("value"))).alias("_q"), F.sum(F.col("n") * F.col("value")).alias("_s"))
        sd = F.when(F.col("_n") > 1, F.floor(F.sqrt(F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1), F.lit(0.0))) + 0.5)).otherwise(0)
        rows = rows.join(m.select(key, "_m", sd.alias("_d")), key).where(F.abs(F.col("value") - F.col("_m")) <= edge * F.col("_d")).select(key, "value", "n")
    return rows
