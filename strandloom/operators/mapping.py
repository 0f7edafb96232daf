"""Placing reads on contigs by seeds: an index join, votes for diagonals, pairs, inserts and links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.codes import coded_words, dealt, run_words, runs, turned_codes
from strandloom.functions.seq import K, revcomp
from strandloom.operators.skew import pairs_within, usable_postings
from strandloom.plans.shared import cut, settings
from strandloom.sources.tables import fanned, partitions

MAX_POSTINGS = 256


def capped_index(postings: DataFrame, most: int | None = MAX_POSTINGS) -> DataFrame:
    """Usable postings of the keys with at most `most` of them, or with None of all keys.

    A seed that is too common to tell places apart is left out of mapping as in the limited probe that mapping starts with;
    `seed_votes` takes the whole index too, and spreads its hot keys.
    """
    usable = usable_postings(postings)
    if most is None:
        return usable
    few = usable.groupBy("hash_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).select("hash_key")
    return usable.join(few, "hash_key", "left_semi")


def contig_index(contigs: DataFrame, k: int = K) -> DataFrame:
    """The full index of contigs: `hash_key`, `contig_id`, `pos_offset` of every k-base word without N."""
    rows = coded_words(fanned(contigs.select("contig_id", "bases"), "contig_id"), ["contig_id"], k)
    return rows.select(F.col("code").alias("hash_key"), "contig_id", F.col("at").alias("pos_offset"))


def read_words(read_set: DataFrame, k: int = K) -> DataFrame:
    """Words of both strands of every read: `hash_key`, `lib_no`, `pair_id`, `mate`, `strand` (1 or -1), `at`."""
    return coded_words(fanned(read_set, "pair_id", "mate"), ["lib_no", "pair_id", "mate"], k, both=True).withColumnRenamed("code", "hash_key")


def seed_votes(read_set: DataFrame, index: DataFrame, salts: int = 1) -> DataFrame:
    """Votes per read, signed contig (negative: the read's other strand) and diagonal.

    With `salts`, the postings of every key are dealt to so many parts by contig and the words of reads are repeated for each, so
    that a key that holds a large share of an uncapped index is joined by many tasks.
    """
    words = read_words(read_set)
    if salts > 1:
        index = index.withColumn("_salt", F.pmod(F.xxhash64("contig_id"), F.lit(salts)).cast("int"))
        words = words.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = words.join(index, ["hash_key", "_salt"] if salts > 1 else ["hash_key"])
    return hits.groupBy("lib_no", "pair_id", "mate", (F.col("strand") * F.col("contig_id")).alias("signed_id"), (F.col("pos_offset") - F.col("at")).cast("bigint").alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))


def dealt_index(postings: DataFrame, most: int = MAX_POSTINGS) -> DataFrame:
    """The postings of `capped_index` by canonical word: `part` (see `dealt`), by which they are partitioned, `code`, `_same` (whether
    it is the key itself), `contig_id`, `pos_offset`. Keys that are no word are left out.

    Before the shuffle a task leaves out what it has of a key beyond `most` + 1 postings, as the key then has too many anyway.
    """

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            new = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            begin = np.flatnonzero(np.concatenate([[True], new[1:]]))
            place = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
            place[: begin[1] if len(begin) > 1 else len(key)] += 0 if new[0] else seen
            last, seen = key[-1], place[-1] + 1
            pick = np.flatnonzero(place <= most)
            x = key[pick].astype(np.uint64)
            back = turned_codes(x, K)
            out = batch.take(pa.array(pick))
            yield pa.RecordBatch.from_arrays([pa.array(dealt(x, back, K)), pa.array(np.minimum(x, back).astype(np.int64)), pa.array(x < back), out.column(1), out.column(2)], ["part", "code", "_same", "contig_id", "pos_offset"])

    rows = usable_postings(postings).where(F.col("hash_key") < 1 << 2 * K).select("hash_key", "contig_id", "pos_offset").sortWithinPartitions("hash_key")
    rows = rows.mapInArrow(run, "part int, code long, _same boolean, contig_id long, pos_offset int").repartition(partitions(postings.sparkSession), "part")
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("part", "code", "_same"))).where(F.col("_n") <= most).drop("_n")


def capped_votes(read_set: DataFrame, postings: DataFrame) -> DataFrame:
    """`seed_votes` on `capped_index(postings)`, with reads shuffled as runs of words instead of word by word.

    Runs and postings are partitioned by `part`, which all words of a run have and either strand of a word, so that the words are
    made where they meet the index; under the setting of `placed_once` the planner doesn't shuffle them once more.
    """
    key = ["lib_no", "pair_id", "mate"]
    words = run_words(runs(fanned(read_set, "pair_id", "mate"), key, K).repartition(partitions(read_set.sparkSession), "part"), key, K)
    hits = words.join(dealt_index(postings).hint("merge"), ["part", "code"])  # the planner knows the size of the runs only, and might broadcast their words
    ahead = F.col("same") == F.col("_same")
    signed, at = F.when(ahead, F.col("contig_id")).otherwise(-F.col("contig_id")), F.when(ahead, F.col("at")).otherwise(F.col("back"))
    return hits.groupBy(*key, signed.alias("signed_id"), (F.col("pos_offset") - at).cast("bigint").alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))


def placed_once(votes: DataFrame) -> DataFrame:
    """`map_reads` of `capped_votes`, computed now and kept in the shared folder."""
    with settings(votes.sparkSession, spark__sql__requireAllClusterKeysForCoPartition="false"):
        return cut(map_reads(votes))


def map_reads(votes: DataFrame) -> DataFrame:
    """The place with most votes of each read; a tie leaves the read unplaced."""
    hi = F.max(F.struct("votes", "signed_id", "diagonal"))
    lo = F.max(F.struct("votes", (-F.col("signed_id")).alias("s"), (-F.col("diagonal")).alias("d")))
    top = votes.groupBy("lib_no", "pair_id", "mate").agg(hi.alias("_hi"), lo.alias("_lo"))  # the last and the first of the best places
    return top.where("_hi.signed_id = -_lo.s AND _hi.diagonal = -_lo.d").select("lib_no", "pair_id", "mate", "_hi.votes", "_hi.signed_id", "_hi.diagonal")


def map_reads_with_alleles(votes: DataFrame, alleles: DataFrame) -> DataFrame:
    """As `map_reads`, but two alleles of one place do not compete: `rep` is the primary allele (or the contig itself).

    A read whose best votes all lie on alleles of one `rep` is placed on the primary if that is among them, else on the lowest
    signed id; several best places on that contig leave it unplaced.
    """
    reps = alleles.where("NOT is_primary").groupBy(F.col("contig_id").alias("_c")).agg(F.min("partner").alias("rep"))
    rows = votes.join(reps, F.abs("signed_id") == F.col("_c"), "left").withColumn("rep", F.coalesce("rep", F.abs("signed_id")))
    key = ["lib_no", "pair_id", "mate"]
    best = rows.groupBy(*key).agg(F.max("votes").alias("votes"))
    top = rows.join(best, [*key, "votes"]).groupBy(*key, "votes", "signed_id").agg(F.count(F.lit(1)).alias("_n"), F.min("diagonal").alias("diagonal"), F.min("rep").alias("rep"))
    first = F.min(F.struct((F.abs("signed_id") != F.col("rep")).alias("_o"), "signed_id", "diagonal", "_n"))
    got = top.groupBy(*key, "votes").agg(F.min("rep").alias("rep"), F.max("rep").alias("_r"), first.alias("f")).where("rep = _r AND f._n = 1")
    return got.select(*key, "votes", "f.signed_id", "f.diagonal", "rep")


def ungapped(votes: DataFrame, read_set: DataFrame, contigs: DataFrame, least: float = 0.9) -> DataFrame:
    """The place with most equal bases of each read, of all places that have votes, without gaps; a tie leaves the read unplaced.

    `n_clean` bases of the read on the contig are no N, `n_same` of them equal; at least a share of `least` must.
    """
    key = ["lib_no", "pair_id", "mate"]
    text = read_set.select(*key, "bases")
    rows = votes.select(*key, "signed_id", "diagonal").join(text, key).withColumn("contig_id", F.abs("signed_id")).join(contigs.select("contig_id", F.col("bases").alias("b"), "len"), "contig_id")
    t = F.when(F.col("signed_id") < 0, revcomp(F.col("bases"))).otherwise(F.col("bases"))
    rows = rows.withColumn("t", t).withColumn("lo", F.greatest(F.col("diagonal"), F.lit(0))).withColumn("n", F.least(F.col("diagonal") + F.length("t"), F.col("len")) - F.col("lo"))
    x, y = F.expr("substring(t, cast(lo - diagonal as int) + 1, cast(n as int))"), F.expr("substring(b, cast(lo as int) + 1, cast(n as int))")
    same = F.size(F.filter(F.arrays_zip(F.split(x, "").alias("x"), F.split(y, "").alias("y")), lambda p: (p["x"] == p["y"]) & (p["x"] != "N") & (p["x"] != "")))
    good = rows.select(*key, "signed_id", "diagonal", F.length(F.translate(x, "N", "")).cast("bigint").alias("n_clean"), same.cast("bigint").alias("n_same")).where((F.col("n_clean") > 0) & (F.col("n_same") >= least * F.col("n_clean")))
    best = good.groupBy(*key).agg(F.max("n_same").alias("n_same"))
    top = good.join(best, [*key, "n_same"]).groupBy(*key, "n_same").agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in ("signed_id", "diagonal", "n_clean")]).where("_n = 1")
    return top.select(*key, "signed_id", "diagonal", "n_clean", "n_same")


def multi_reports(votes: DataFrame) -> DataFrame:
    """All contigs a read has votes on, with the vote-weighted mean diagonal, rounded."""
    mean = F.sum(F.col("diagonal") * F.col("votes")) / F.sum("votes")
    return votes.groupBy("lib_no", "pair_id", "mate", "signed_id").agg(F.sum("votes").alias("votes"), F.floor(mean + 0.5).alias("diagonal"))


def map_pairs(mapped: DataFrame, read_set: DataFrame) -> DataFrame:
    """Pairs with both mates placed: signed contigs and the 0-based place of each mate's first base on its contig.

    A mate on the other strand (negative id) begins at the far end of its bases.
    """
    n = read_set.select("lib_no", "pair_id", "mate", F.length("bases").alias("n"))
    at = mapped.join(n, ["lib_no", "pair_id", "mate"]).withColumn("place", F.when(F.col("signed_id") > 0, F.col("diagonal")).otherwise(F.col("diagonal") + F.col("n") - 1))
    side = lambda m: F.max(F.when(F.col("mate") == m, F.struct("signed_id", "place")))
    both = at.groupBy("lib_no", "pair_id").agg(side(1).alias("a"), side(2).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.select("lib_no", "pair_id", F.col("a.signed_id").alias("id1"), F.col("a.place").alias("place1"), F.col("b.signed_id").alias("id2"), F.col("b.place").alias("place2"))


def drop_blocked(pairs: DataFrame, blocked: DataFrame) -> DataFrame:
    """Pairs without those between two contigs that a block list (`id1`, `id2`, any order and sign) names."""
    lo, hi = F.least(F.abs("id1"), F.abs("id2")), F.greatest(F.abs("id1"), F.abs("id2"))
    gone = blocked.select(lo.alias("_a"), hi.alias("_b")).distinct()
    return pairs.withColumns({"_a": lo, "_b": hi}).join(gone, ["_a", "_b"], "left_anti").select(pairs.columns)


def shared_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with a mate on either of two contigs: `a` < `b`, `n`."""
    return pairs.where("abs(id1) <> abs(id2)").groupBy(F.least(F.abs("id1"), F.abs("id2")).alias("a"), F.greatest(F.abs("id1"), F.abs("id2")).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def insert_lengths(pairs: DataFrame) -> DataFrame:
    """Insert lengths of pairs that face each other on one contig."""
    return pairs.where("id1 = -id2").select("lib_no", "pair_id", F.abs("id1").alias("contig_id"), (F.abs(F.col("place1") - F.col("place2")) + 1).alias("insert_len"))


def pair_links(pairs: DataFrame, contigs: DataFrame, libraries: DataFrame) -> DataFrame:
    """Links between different contigs: canonical signed ids and the gap = insert - both tails.

    The tail of a mate runs from its first base to the contig's end it points to. Pairs of libraries without a positive mean
    insert are left out. Of the two equal ways to write a link, the one whose first id is lower in size is kept. `libraries`
    is a fixed table and is broadcast.
    """
    lens = contigs.select("contig_id", "len")
    l1, l2 = lens.select(F.col("contig_id").alias("_c1"), F.col("len").alias("_l1")), lens.select(F.col("contig_id").alias("_c2"), F.col("len").alias("_l2"))
    rows = pairs.where("abs(id1) <> abs(id2)").join(F.broadcast(libraries.where("avg_ins > 0").select("lib_no", "avg_ins")), "lib_no")
    rows = rows.join(l1, F.abs("id1") == F.col("_c1")).join(l2, F.abs("id2") == F.col("_c2"))
    tail = lambda i: F.when(F.col(f"id{i}") > 0, F.col(f"_l{i}") - F.col(f"place{i}")).otherwise(F.col(f"place{i}") + 1)
    swap = F.abs("id1") > F.abs("id2")
    return rows.select(
        "lib_no", "pair_id", F.when(swap, F.col("id2")).otherwise(F.col("id1")).alias("id1"), F.when(swap, -F.col("id1")).otherwise(-F.col("id2")).alias("id2"),
        (F.col("avg_ins") - tail(1) - tail(2)).cast("bigint").alias("gap"),
    )


def common_tags(mapped: DataFrame, read_set: DataFrame, most: int = 254) -> DataFrame:
    """Shared barcode evidence of contig pairs: the sum over all shared tags of the lesser read count (saturating at `most`)."""
    tags = mapped.join(read_set.where("tag IS NOT NULL").select("lib_no", "pair_id", "mate", "tag"), ["lib_no", "pair_id", "mate"])
    per = tags.groupBy("tag", F.abs("signed_id").alias("contig_id")).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"))
    pairs = pairs_within(per, "tag", "contig_id", "n")
    return pairs.groupBy(F.col("x.contig_id").alias("contig_a"), F.col("y.contig_id").alias("contig_b")).agg(F.sum(F.least("x.n", "y.n")).alias("score"), F.count(F.lit(1)).alias("n_tags"))


def long_read_filter(hits: DataFrame, min_identity: float = 0.8, min_len: int = 1000, min_share: float = 0.8) -> DataFrame:
    """Long-read hits good enough to use: identity, and length or share of the shorter sequence."""
    share = (F.col("t_end") - F.col("t_start")) / F.least("q_len", "t_len")
    return hits.where((F.col("identity") >= min_identity) & ((F.col("aln_len") >= min_len) | (share >= min_share)))


def keep_best_hits(hits: DataFrame, tolerance: int = 32) -> DataFrame:
    """Per read, hits in order of matches and span; one that overlaps a kept one by more than `tolerance` is dropped.

    The order is total (ties: start, target, target start), so that the result is unique. Reads are streamed in sorted
    partitions; a task keeps only the accepted, hardly overlapping intervals of the read it is at.
    """
    order = [F.desc("match_len"), F.desc(F.col("q_end") - F.col("q_start")), F.asc("q_start"), F.asc("t_name"), F.asc("t_start")]
    cols = hits.columns
    at = [cols.index(c) for c in ("q_name", "q_start", "q_end")]

    def run(batches):
        read, kept = None, []
        for batch in batches:
            pick = []
            for i, (q, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in at))):
                if q != read:
                    read, kept = q, []
                if all(min(b, y) - max(a, x) <= tolerance for x, y in kept):
                    kept.append((a, b))
                    pick.append(i)
            yield batch.take(pa.array(pick, pa.int64()))

    return hits.repartition("q_name").sortWithinPartitions("q_name", *order).mapInArrow(run, hits.schema)


def long_links(best: DataFrame, contigs: DataFrame) -> DataFrame:
    """Links between all contigs of a long read that do not contain each other: canonical signed ids and the gap.

    `best` is joined to contigs by name; of several hits of a read on one signed contig the one of most matches gives its
    place. The contig ends are projected onto the read; the gap is the distance from the right end of the contig that begins
    first to the left end of the other, negative if they overlap. One that begins first and ends last contains the other.
    """
    ids = contigs.where("name IS NOT NULL").groupBy("name").agg(F.min("contig_id").alias("contig_id"))
    turned = F.col("strand") == "-"
    right_rest = F.when(turned, F.col("t_start")).otherwise(F.col("t_len") - F.col("t_end"))
    left_rest = F.when(turned, F.col("t_len") - F.col("t_end")).otherwise(F.col("t_start"))
    rows = best.join(ids, best["t_name"] == ids["name"]).select(
        "q_name", F.when(turned, -F.col("contig_id")).otherwise(F.col("contig_id")).alias("sid"),
        F.struct("match_len", (F.col("q_end") - F.col("q_start")).alias("span"), (-F.col("q_start")).alias("at"), (F.col("q_start") - left_rest).alias("lo"), (F.col("q_end") + right_rest).alias("hi")).alias("hit"),
    )
    one = rows.groupBy("q_name", "sid").agg(F.max("hit").alias("hit")).select("q_name", "sid", "hit.lo", "hit.hi")
    pairs = pairs_within(one, "q_name", "sid", "lo", "hi").where("abs(x.sid) <> abs(y.sid)")
    ahead = F.col("x.lo") <= F.col("y.lo")
    pairs = pairs.where(F.when(ahead, F.col("x.hi") <= F.col("y.hi")).otherwise(F.col("y.hi") <= F.col("x.hi")))
    gap = F.when(ahead, F.col("y.lo") - F.col("x.hi")).otherwise(F.col("x.lo") - F.col("y.hi"))
    before = F.col("x.hi") < F.col("y.hi")
    nxt = pairs.select("q_name", F.when(before, F.col("x.sid")).otherwise(F.col("y.sid")).alias("a"), F.when(before, F.col("y.sid")).otherwise(F.col("x.sid")).alias("b"), gap.alias("gap"))
    swap = F.abs("a") > F.abs("b")
    return nxt.select("q_name", F.when(swap, -F.col("b")).otherwise(F.col("a")).alias("id1"), F.when(swap, -F.col("a")).otherwise(F.col("b")).alias("id2"), "gap")
