"""Problem 2: frequency of every distinct term or n-gram of terms, by suffix-sorted counting.

Each record's term list is cut into truncated suffixes (at most `sigma` terms). Suffixes are routed by their first term,
sorted in reverse lexicographic order within a partition, and counted with a stack: a prefix stays on the stack as long as
the suffixes read begin with it; when it is taken off, its count and its set of records are final and flow into the next
shorter prefix. So one pass counts the n-grams of every length.

A first term may hold a third of all rows. The route therefore also has a salt, a hash of the *record*: every record's
occurrences of a term meet in one place, so that counts and numbers of records of the salts simply add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def suffixes(records: DataFrame, record: str, terms: str, sigma: int) -> DataFrame:
    """The truncated suffixes of the array column `terms`: `t1`..`t<sigma>` (null past the end) and `record`.

    Null terms end an n-gram: no n-gram spans one. Null or empty lists give no row.
    """
    at = records.select(F.col(record).alias("record"), F.col(terms).alias("_terms")).select("record", "_terms", F.posexplode("_terms").alias("_at", "t1"))
    cols, ok = [F.col("t1")], F.col("t1").isNotNull()
    for k in range(1, sigma):
        nxt = F.get("_terms", F.col("_at") + F.lit(k))
        cols.append(F.when(ok & nxt.isNotNull(), nxt).alias(f"t{k + 1}"))
        ok = ok & nxt.isNotNull()
    return at.where("t1 IS NOT NULL").select("record", *cols)


#: Positions of a record are handled in stretches of so many, so that no task orders a whole long record.
STRETCH = 1 << 20


def row_suffixes(rows: DataFrame, record: str, position: str, term: str, sigma: int) -> DataFrame:
    """The same rows as of `suffixes`, from one row per term: the terms of a record in the order of `position`.

    Positions are unique within a record; rows with a null in one of the three columns are left out. Terms follow each other
    within stretches of positions; the last ones of a stretch look up the first terms of the stretches behind it.
    """
    at = rows.where(f"`{record}` IS NOT NULL AND `{position}` IS NOT NULL AND `{term}` IS NOT NULL").select(F.col(record).alias("record"), F.col(position).alias("_p"), F.col(term).alias("t1"))
    w = Window.partitionBy("record", "_s").orderBy("_p")
    at = at.withColumn("_s", F.floor(F.col("_p") / STRETCH))
    if sigma == 1:
        return at.select("t1", "record")
    at = at.withColumn("_i", F.row_number().over(w))
    heads = at.where(F.col("_i") < sigma).groupBy("record", "_s").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "t1"))), lambda x: x["t1"]).alias("_h"))
    counts = at.groupBy("record", "_s").agg(F.count(F.lit(1)).alias("_n"))
    behind = Window.partitionBy("record").orderBy("_s").rowsBetween(1, sigma - 1)
    after = heads.select("record", "_s", F.flatten(F.collect_list("_h").over(behind)).alias("_a")).join(counts, ["record", "_s"])
    out = at.withColumns({f"t{k + 1}": F.lead("t1", k).over(w) for k in range(1, sigma)}).join(after, ["record", "_s"])
    pick = lambda k: F.coalesce(f"t{k + 1}", F.get("_a", (F.lit(k - 1) - (F.col("_n") - F.col("_i"))).cast("int"))).alias(f"t{k + 1}")
    return out.select("t1", *(pick(k) for k in range(1, sigma)), "record")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[int]]]:
    """Per batch its runs of equal rows and their lengths."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        for col in b.columns:
            x, y = col.slice(1), col.slice(0, n - 1)
            differ = pc.or_(pc.xor(pc.is_null(x), pc.is_null(y)), pc.fill_null(pc.not_equal(x, y), False))
            change[1:] |= differ.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(change)
        kept = b.take(pa.array(at))
        yield list(zip(*(c.to_pylist() for c in kept.columns))), np.diff(np.append(at, n)).tolist()


def count_ngrams(suffix_rows: DataFrame, sigma: int = 1) -> DataFrame:
    """Occurrences `n` and records `n_records` of every n-gram of up to `sigma` terms, from the rows of `suffixes`.

    Columns: `t1`..`t<sigma>` (null past the n-gram's length), `n`, `n_records`. A null record counts as a record of its
    own. An empty input gives no rows. One shuffle of the suffixes and one of the partial counts.
    """
    spark = suffix_rows.sparkSession
    ts = [f"t{k + 1}" for k in range(sigma)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = suffix_rows.schema["t1"].dataType
    schema = T.StructType([*(T.StructField(t, kind) for t in ts), T.StructField("n", T.LongType()), T.StructField("n_records", T.LongType())])
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[kind]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # of [term, occurrences, records]
        out: list[tuple] = []

        def pop() -> None:
            gram = tuple(e[0] for e in stack)
            _, n, records = stack.pop()
            out.append((*gram, *([None] * (sigma - len(gram))), n, len(records)))
            if stack:
                stack[-1][1] += n
                stack[-1][2] |= records

        def done() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * (sigma + 2)
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, arrow) for c in cols[:sigma]), pa.array(cols[sigma], pa.int64()), pa.array(cols[sigma + 1], pa.int64())], schema.names)

        for rows, weights in _runs(batches):
            for row, weight in zip(rows, weights):
                gram = [t for t in row[:sigma] if t is not None]
                same = 0
                while same < len(stack) and same < len(gram) and stack[same][0] == gram[same]:
                    same += 1
                while len(stack) > same:
                    pop()
                for t in gram[same:]:
                    stack.append([t, 0, set()])
                stack[-1][1] += weight
                stack[-1][2].add(row[sigma])
            yield done()
        while stack:
            pop()
        yield done()

    routed = (
        suffix_rows.select(*ts, "record")
        .repartition(parts, "t1", F.pmod(F.xxhash64("record"), F.lit(parts)))
        .sortWithinPartitions(*[F.col(t).desc_nulls_last() for t in ts], "record")
    )
    return routed.mapInArrow(count, schema).groupBy(*ts).agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records"))


def key_frequency(postings: DataFrame, max_postings: int = 256) -> DataFrame:
    """Per hash key its usable postings, contigs and `mark`.

    `common`: more than `max_postings` usable postings; `rare`: not common and all in one contig; else null. Rows that are
    no usable posting (null or negative key, unplaced contig, null offset) are left out, replayed ones count once.
    """
    from strandloom.operators.skew import usable_postings

    terms = usable_postings(postings).select(F.col("hash_key").alias("t1"), F.col("contig_id").alias("record"))
    return count_ngrams(terms, 1).select(
        F.col("t1").alias("hash_key"), F.col("n").alias("n_postings"), F.col("n_records").alias("n_contigs"),
        F.when(F.col("n") > max_postings, "common").when(F.col("n_records") == 1, "rare").alias("mark"),
    )


def key_ngrams(postings: DataFrame, sigma: int = 2) -> DataFrame:
    """Occurrences and contigs of every run of up to `sigma` keys that follow each other on a contig, by offset."""
    from strandloom.operators.skew import usable_postings

    return count_ngrams(row_suffixes(usable_postings(postings), "contig_id", "pos_offset", "hash_key", sigma), sigma)
