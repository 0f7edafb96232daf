"""Word graphs are joined within tasks once; each round of cleaning works on unitigs only."""

import random

from strandloom.operators import assembly, graph, words

TURN = str.maketrans("ACGT", "TGCA")


def lower(s):
    return min(s, s.translate(TURN)[::-1])


def new(rnd, n):
    return "".join(rnd.choices("ACGT", k=n))


def counts_of(spark, seqs):
    return words.word_counts(spark.createDataFrame([(s,) for s in seqs], "bases string"))


def opened(ring, k=21):
    at = {lower(s[p : p + k]): (s, p) for s in (ring * 2, (ring * 2).translate(TURN)[::-1]) for p in range(len(ring)) if s[p : p + k] == lower(s[p : p + k])}
    s, p = at[min(at)]
    return lower((s * 2)[p : p + len(ring) + k - 1])


def test_words_are_joined_once(spark, monkeypatch):
    rnd = random.Random(11)
    seq = new(rnd, 300)
    snp = seq[:150] + ("A" if seq[150] != "A" else "C") + seq[151:]
    counts = counts_of(spark, [seq] * 6 + [snp] * 3 + [seq[100:130] + new(rnd, 5)]).cache()
    made, pieces = [], assembly.pieces
    monkeypatch.setattr(assembly, "pieces", lambda c, k: made.append(c) or pieces(c, k))
    monkeypatch.setattr(graph, "chains", lambda joins: 1 / 0)  # for rings only
    got = assembly.cleaned_unitigs(counts).collect()
    assert [(r.bases, r.n_words) for r in got] == [(lower(seq), 280)] and len(made) == 1
    assert pieces(counts, 21).count() < counts.count() / 2


def test_ring_closed_by_cutting_a_tip(spark):
    rnd = random.Random(12)
    ring = new(rnd, 60)
    got = assembly.cleaned_unitigs(counts_of(spark, [ring + ring[:20]] * 6 + [ring[10:40] + new(rnd, 5)])).collect()
    assert [(r.bases, r.n_words) for r in got] == [(opened(ring), 60)]
