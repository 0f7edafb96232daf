"""Runs of words that reads are shuffled as, and the votes they give: the same as word by word, without a broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom import queries_assembly as qa
from strandloom.functions.codes import canonical_code, coded_words, run_words, runs
from strandloom.operators import assembly, mapping
from strandloom.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_runs_hold_every_word_once(spark):
    rnd = random.Random(3)
    seqs = ["", "ACGT", "A" * 200, "AC" * 90, "N".join(["".join(rnd.choices("ACGT", k=n)) for n in (31, 30, 75, 1)]), *("".join(rnd.choices("ACGTN", (9, 9, 9, 9, 0.3), k=400)) for _ in range(40))]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, bases string")
    rows = runs(df, ["id"])
    got = run_words(rows, ["id"])
    want = coded_words(df, ["id"], 31).join(df.select("id", F.length("bases").alias("n")), "id")
    want = want.select("id", canonical_code(F.col("code"), 31).alias("code"), (canonical_code(F.col("code"), 31) == F.col("code")).alias("same"), "at", (F.col("n") - 31 - F.col("at")).alias("back"))
    key = lambda d: sorted(map(tuple, d.select("id", "code", "same", "at", "back").collect()))
    assert key(got) == key(want)
    assert rows.count() * 4 < got.count()
    assert got.groupBy("code").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0  # either strand has one part


def test_votes_as_of_the_capped_index(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choices("ACGT", k=300))
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    code = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    postings = [(code(text[i : i + 31]), 1, i) for i in range(0, 270, 2)] + [(code(turn(text)[i : i + 31]), 2, i) for i in range(0, 270, 3)]
    postings += [(code(text[i : i + 31]), 100 + c, 5) for i, n in ((10, 255), (40, 256), (70, 300)) for c in range(n * (i // 10) % 7, n * (i // 10) % 7 + n)]
    index = spark.createDataFrame([*postings, *postings[:50], (1 << 62, 9, 1), (-1, 9, 2), (None, 9, 3), (5, 0, 1)], "hash_key long, contig_id long, pos_offset int").repartition(5)
    reads = spark.createDataFrame([(1, i, m, s[a : a + 100]) for i, a in enumerate(range(0, 200, 20)) for m, s in ((1, text), (2, turn(text)))], "lib_no int, pair_id long, mate int, bases string")
    got, want = mapping.capped_votes(reads, index), mapping.seed_votes(reads, mapping.capped_index(index))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, mapping.placed_once(got).collect())) == sorted(map(tuple, mapping.map_reads(want).collect()))


def test_no_broadcast_of_words(spark):
    """The planner takes words for as small as the reads."""
    votes = qa.votes_of(spark, SF)
    assert "Broadcast" not in votes._jdf.queryExecution().executedPlan().toString()
    assert votes.count() > 0


def test_filling_votes_on_both_strands(spark):
    """Also of an anchor that is its own reverse complement; no text of a read goes with every word, and no word is broadcast."""
    rnd = random.Random(5)
    new = lambda n: "".join(rnd.choices("ACGT", k=n))
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    half = new(10)
    lefts, rights, fills = [new(20), new(20), half + turn(half), "A" * 20], [new(20) for _ in range(4)], ["", new(30), new(7), new(12)]
    scaffolds = [(i + 1, new(40) + a + "N" * 15 + b + new(40)) for i, (a, b) in enumerate(zip(lefts, rights))]
    gaps = [(i + 1, 1, 60, 75, 60, 60) for i in range(4)]
    texts = [new(9) + a + f + b + new(5) for a, f, b in zip(lefts, fills, rights) for _ in range(3)] + [new(30) + half + turn(half) + new(30), "A" * 60, "A" * 40 + fills[3] + rights[3]]
    reads = [(1, i, 1, turn(t) if i % 2 else t) for i, t in enumerate(texts)]
    want = {}
    for i, (a, b) in enumerate(zip(lefts, rights)):
        for *_, t in reads:
            for r in (t, turn(t)):
                for at in range(len(r) - 19):
                    p = r.find(b, at + 20)
                    if r[at : at + 20] == a and p >= 0:
                        want[i + 1, 1, r[at + 20 : p]] = want.get((i + 1, 1, r[at + 20 : p]), 0) + 1
    got = assembly.filling_votes(
        spark.createDataFrame(gaps, "scaffold_id long, gap_no long, gap_start long, gap_end long, left_flank long, right_flank long"), spark.createDataFrame(scaffolds, "scaffold_id long, bases string"),
        spark.createDataFrame(reads, "lib_no int, pair_id long, mate int, bases string"))
    assert {tuple(r)[:3]: r.n_reads for r in got.collect()} == want and len(want) > 4
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["contact_map", "insert_histogram"])
def test_words_are_made_once(spark, name):
    """Reads are placed once, in the shared folder; what follows makes no words again and broadcasts none."""
    assert "MapInArrow" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
