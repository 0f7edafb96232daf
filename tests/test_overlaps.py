"""Overlaps by hashes of stretches from the ends: contigs and words that don't overlap never meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import rolling
from strandloom.operators import words
from strandloom.registry import QUERIES

SF = "/root/testdata/sf0.001"

turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_overlaps_of_contigs_longer_than_a_block(spark):
    """Over several blocks, on both strands, with N and with letters that are no base."""
    rnd = random.Random(21)
    new = lambda n: "".join(rnd.choices("ACGT", k=n))
    n, own = rolling.BLOCK, new(rolling.BLOCK + 100)
    other = own[: n // 2] + "N" * 40 + "RY" + own[n // 2 :]
    seqs = {1: new(2 * n) + other, 2: other + new(n), 3: turn(other) + new(50), 4: new(70) + own[:40], 5: own[:40] + new(30), 6: "N" * 40 + new(9), 7: new(9) + "N" * 40}
    got = words.end_overlaps(spark.createDataFrame(list(seqs.items()), "contig_id long, bases string"))
    want = _slow(seqs)
    assert (1, 2, len(other)) in want and len(want) > 2
    rows = got.collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def _slow(seqs, k=31):
    signed = {s * c: b if s > 0 else turn(b) for c, b in seqs.items() for s in (1, -1)}
    out = set()
    for a, x in signed.items():
        for b, y in signed.items():
            if abs(a) == abs(b) or max(a, b) < 0 or (a * b < 0 and abs(a) > abs(b)) or "N" in x[-k:]:
                continue
            at = y.find(x[-k:])
            best = 0
            while at >= 0:
                if at + k <= len(x) and x[-(at + k) :] == y[: at + k]:
                    best = at + k
                at = y.find(x[-k:], at + 1)
            if best:
                out.add((a, b, best))
    return out


def test_a_word_that_many_hold_gives_no_pairs(spark):
    """An end word in the middle of many contigs: the join by words had a row for each pair of them, now only overlaps meet."""
    rnd = random.Random(22)
    new = lambda n: "".join(rnd.choices("ACGT", k=n))
    hot = new(31)
    seqs = [(i, new(200) + hot) for i in range(1, 60)] + [(i, new(150) + hot + new(150)) for i in range(60, 300)]
    df = spark.createDataFrame(seqs, "contig_id long, bases string")
    ends = rolling.end_hashes(df, 31)
    rows = rolling.end_stretches(df, rolling.filter_of(ends, ends.count()), 31)
    assert rows.count() < 6 * len(seqs)
    assert words.end_overlaps(df).count() == 0


def test_hashes_of_ends_as_of_stretches(spark):
    text = "".join(random.Random(23).choices("ACGTN", k=300))
    df = spark.createDataFrame([(1, text)], "contig_id long, bases string")
    full = np.full(1 << 13, 255, np.uint8)  # a filter that lets all pass
    got = {(r.side, r.tail, r.n): r.hash for r in rolling.end_stretches(df, full, 31).collect()}
    back = {(r.side, r.tail, r.n): r.hash for r in rolling.end_stretches(spark.createDataFrame([(1, turn(text))], "contig_id long, bases string"), full, 31).collect()}
    heads = {(s, n): h for (s, tail, n), h in got.items() if not tail}
    assert len(heads) == 2 * 270 and heads == {(-s, n): h for (s, tail, n), h in back.items() if not tail}


@pytest.mark.parametrize("name", ["thin_edges_dropped_keeping_overlaps", "unique_overlap_paths"])
def test_no_words_of_contigs_are_made(spark, monkeypatch, name):
    def fail(*_, **__):
        raise AssertionError("words of contigs")

    monkeypatch.setattr(words, "coded_words", fail)
    assert {"src", "dst"} & set(QUERIES[name](spark, SF).columns)


def test_text_is_fetched_for_candidates_only(spark):
    """Deliveries of an id that don't count make no overlaps, and contigs without candidates don't have their text shuffled."""
    rnd = random.Random(24)
    new = lambda n: "".join(rnd.choices("ACGT", k=n))
    x, y = new(40), new(45)
    long_ = {1: new(300) + x, 2: x + new(300), 3: new(300) + "N" + x[10:], 4: y + new(200), **{i: new(250) for i in range(10, 400)}}
    rows = [*long_.items(), (3, new(100) + x), (5, new(60) + y), (5, new(120)), (1, long_[1])]
    df, got = spark.createDataFrame(rows, "contig_id long, bases string"), []

    def chosen(keep):
        got.append(keep(df).select("contig_id").distinct().count())
        return keep(df).groupBy("contig_id").agg(F.max_by("bases", F.length("bases")).alias("bases"))

    want = _slow({**long_, 5: rows[-2][1]})
    out = words.end_overlaps(df, chosen).collect()
    assert (1, 2, 40) in want and {tuple(r) for r in out} == want and len(out) == len(want)
    assert len(got) == 1 and 2 <= got[0] < 50


def test_lengths_of_contigs_without_their_text(spark):
    from strandloom.queries_assembly import contigs_of, lengths_of

    assert sorted(lengths_of(spark, SF).collect()) == sorted(contigs_of(spark, SF).select("contig_id", "len").collect())
    plan = lengths_of(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
