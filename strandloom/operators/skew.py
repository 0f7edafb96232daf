"""Per-key results where a few keys hold most rows: value-frequency compression.

Rows are first grouped by key *and* value, so that a hot key is spread over as many tasks as it has values and each
distinct value leaves one weighted row. Counts, exact distinct counts, modes and percentiles are then derived from the
weighted rows; map-side combination leaves at most one row per task and key for the last shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_postings(postings: DataFrame) -> DataFrame:
    """The distinct usable postings (`hash_key`, `contig_id`, `pos_offset`).

    A posting needs a key >= 0, a placed contig and an offset; a replayed one counts once. Null keys, contigs or offsets
    drop the row. Should one place be listed under several keys, the lowest key is its key.
    """
    return (
        postings.where("hash_key >= 0 AND contig_id <> 0 AND pos_offset IS NOT NULL")
        .groupBy("contig_id", "pos_offset")
        .agg(F.min("hash_key").alias("hash_key"))
    )


def compress(df: DataFrame, key: str, value: str, *aggs: Column) -> DataFrame:
    """One row per (`key`, `value`) with its number of rows `weight` and further aggregates `aggs`.

    Null keys and null values form groups of their own. Columns other than the two and those of `aggs` are dropped before
    the shuffle, so clashing names cannot reach it.
    """
    return df.groupBy(key, value).agg(F.count(F.lit(1)).alias("weight"), *aggs)


def key_profile(compressed: DataFrame, key: str, value: str, *aggs: Column) -> DataFrame:
    """Per key, from `compress`: `n` rows, `n_distinct` non-null values, the mode (lowest value of a tie) and `aggs`.

    A key whose values are all null has `n_distinct` 0 and a null mode.
    """
    return compressed.groupBy(key).agg(
        F.sum("weight").alias("n"),
        F.count(value).alias("n_distinct"),
        F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col(value).alias("v"))))["v"].alias("mode_value"),
        *aggs,
    )


def key_percentiles(compressed: DataFrame, key: str, value: str, ps: Sequence[float], bins: int = 1024) -> DataFrame:
    """Exact discrete percentiles of the integer column `value` per key: the lowest value whose share of rows reaches p.

    The range of each key is cut into at most `bins` bins, whose weights are summed with map-side combination; only the
    values of the bins that hold a wanted rank are looked at one by one. So no task sees more of a hot key than its bins
    and one bin of its values. Nulls are left out; a key without values gives no row. Columns: key, `p`, `percentile`.
    """
    vals = compressed.where(F.col(value).isNotNull()).select(key, value, "weight")
    ends = vals.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("weight").alias("_total"))
    width = F.floor((F.col("_hi") - F.col("_lo")) / F.lit(bins)) + 1
    binned = vals.join(ends, on=vals[key].eqNullSafe(ends[key])).drop(ends[key]).withColumn("_bin", F.floor((F.col(value) - F.col("_lo")) / width))
    per_bin = binned.groupBy(key, "_bin").agg(F.sum("weight").alias("_w"), F.first("_total").alias("_total"))
    upto = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.ceil(F.lit(float(p)) * F.col("_total")), F.lit(1)).alias("rank")) for p in ps]))
    hit = (
        per_bin.withColumn("_upto", F.sum("_w").over(upto)).withColumn("_r", ranks)
        .where("_r.rank <= _upto AND _r.rank > _upto - _w")
        .select(F.col(key).alias("_key"), F.col("_bin").alias("_hit"), F.col("_r.p").alias("p"), (F.col("_r.rank") - (F.col("_upto") - F.col("_w"))).alias("_rank"))
    )
    within = binned.join(hit, on=binned[key].eqNullSafe(hit["_key"]) & (binned["_bin"] == hit["_hit"]))
    run = Window.partitionBy(key, "p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        within.withColumn("_upto", F.sum("weight").over(run))
        .where("_upto >= _rank").groupBy(key, "p").agg(F.min(value).alias("percentile"))
    )


def key_report(postings: DataFrame) -> DataFrame:
    """Per hash key: `n_postings`, `n_contigs`, the contig with most postings and the first posting.

    The first posting has the lowest contig, then the lowest offset. An empty table gives no rows.
    """
    weighted = compress(usable_postings(postings), "hash_key", "contig_id", F.min("pos_offset").alias("pos_offset"))
    first = F.min(F.struct("contig_id", "pos_offset"))
    out = key_profile(weighted, "hash_key", "contig_id", first.alias("first"))
    return out.select(
        "hash_key", F.col("n").alias("n_postings"), F.col("n_distinct").alias("n_contigs"), F.col("mode_value").alias("mode_contig"),
        F.col("first.contig_id").alias("first_contig"), F.col("first.pos_offset").alias("first_pos"),
    )


def hot_keys(postings: DataFrame, share: float = 0.01) -> DataFrame:
    """Keys with at least `share` of all usable postings and the first posting of each (`hash_key`, `contig_id`, `pos_offset`)."""
    report = key_report(postings)
    total = report.agg(F.sum("n_postings").alias("n")).scalar()
    return report.where(F.col("n_postings") >= F.lit(share) * total).select(
        "hash_key", F.col("first_contig").alias("contig_id"), F.col("first_pos").alias("pos_offset")
    )


def pairs_within(rows: DataFrame, key: str, item: str, *values: str, block: int = 64) -> DataFrame:
    """Every pair of the items of a key once: `key` and the structs `x`, `y` (`item`, `values`; `x` has the lower item).

    `rows` has an item once per key. A key's items are dealt by hash into blocks of about `block`, and each two blocks are a
    join key of their own, so that a key with many items is spread over many tasks. No key is left out.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_blocks"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    dealt = rows.join(sizes, key).select(key, F.struct(item, *values).alias("_s"), "_blocks", F.pmod(F.xxhash64(item), F.col("_blocks")).alias("_b"))
    x = dealt.select(key, F.col("_s").alias("_x"), F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.col("_blocks") - 1)).alias("_j"))
    y = dealt.select(key, F.col("_s").alias("_y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"))
    both = x.join(y, [key, "_i", "_j"]).where((F.col("_i") < F.col("_j")) | (F.col(f"_x.{item}") < F.col(f"_y.{item}")))
    return both.select(key, F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y"))
