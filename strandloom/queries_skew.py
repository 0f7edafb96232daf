"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import skew
from strandloom.sources.tables import table

USABLE = "(SELECT contig_id, pos_offset, min(hash_key) AS hash_key FROM kmer_index WHERE hash_key >= 0 AND contig_id <> 0 AND pos_offset IS NOT NULL GROUP BY 1, 2)"


def p5_key_report(spark, sf_dir):
    return skew.key_report(table(spark, sf_dir, "kmer_index"))


def p5_key_percentiles(spark, sf_dir):
    weighted = skew.compress(skew.usable_postings(table(spark, sf_dir, "kmer_index")), "hash_key", "pos_offset")
    return skew.key_percentiles(weighted, "hash_key", "pos_offset", (0.5, 0.9)).withColumn("percentile", F.col("percentile").cast("bigint"))


def p5_found(spark, sf_dir):
    return skew.hot_keys(table(spark, sf_dir, "kmer_index"))


QUERIES = {"p5_found": p5_found, "p5_key_report": p5_key_report, "p5_key_percentiles": p5_key_percentiles}
ORACLE = {
    "p5_found": f"""WITH u AS {USABLE}, k AS (SELECT hash_key, count(*) AS n, min(contig_id) AS contig_id FROM u GROUP BY 1)
        SELECT k.hash_key, k.contig_id, min(u.pos_offset) AS pos_offset FROM k JOIN u ON u.hash_key = k.hash_key AND u.contig_id = k.contig_id
        WHERE k.n >= 0.01 * (SELECT count(*) FROM u) GROUP BY 1, 2""",
    "p5_key_report": f"""WITH u AS {USABLE}, w AS (SELECT hash_key, contig_id, count(*) AS weight, min(pos_offset) AS pos FROM u GROUP BY 1, 2),
        m AS (SELECT *, row_number() OVER (PARTITION BY hash_key ORDER BY weight DESC, contig_id) AS r, row_number() OVER (PARTITION BY hash_key ORDER BY contig_id) AS f FROM w)
        SELECT hash_key, CAST(sum(weight) AS BIGINT) AS n_postings, count(*) AS n_contigs, max(contig_id) FILTER (WHERE r = 1) AS mode_contig,
        max(contig_id) FILTER (WHERE f = 1) AS first_contig, max(pos) FILTER (WHERE f = 1) AS first_pos FROM m GROUP BY 1""",
    "p5_key_percentiles": f"""WITH u AS {USABLE}, r AS (SELECT hash_key, pos_offset, row_number() OVER (PARTITION BY hash_key ORDER BY pos_offset) AS i, count(*) OVER (PARTITION BY hash_key) AS n FROM u),
        q AS (SELECT * FROM (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) AS t(p))
        SELECT hash_key, p, CAST(min(pos_offset) AS BIGINT) AS percentile FROM r, q WHERE i >= greatest(ceil(p * n), 1) GROUP BY 1, 2""",
}
