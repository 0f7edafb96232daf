"""Walks through the words of a gap: sorted in one task, without a round of joins and of copies in the shared folder per doubling."""

import random
from collections import defaultdict

from strandloom import queries_records
from strandloom.operators import assembly

turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
K = 24


def _slow(scaffolds, gaps, reads, most=256):
    out = set()
    for s, no, a, b in gaps:
        left, right = scaffolds[s][a - K : a], scaffolds[s][b : b + K]
        words = {t[i : i + K] for r in reads[s, no] for t in (r, turn(r)) for i in range(len(t) - K + 1)} | {left, right}
        follow, at, text = defaultdict(set), left, ""
        for w in words:
            follow[w[:-1]].add(w)
        while at != right and len(text) < most and len(nxt := follow[at[1:]]) == 1 and nxt != {at}:
            at = next(iter(nxt))
            text += at[-1]
        if at == right and len(text) >= K:
            out.add((s, no, text[:-K]))
    return out


def test_walks_against_words_in_a_dict_without_rounds(spark, monkeypatch):
    rnd, scaffolds, gaps, reads, rows = random.Random(8), {}, [], {}, []
    new = lambda n: "".join(rnd.choices("ACGT", k=n))
    fillings = ["", "A", new(50), new(231), new(232), new(233), new(300), "A" * 40, new(60)]
    for s, filling in enumerate(fillings, 1):
        left, right = new(60), new(60)
        text = left + filling + right
        scaffolds[s] = left + "N" * 30 + right
        gaps.append((s, 1, 60, 90))
        own = [text[i : i + 80] for i in range(0, len(text) - 79, 5)] + [text[-80:]]
        own += [text[40:90] + new(30)] if s == 9 else []  # a branch
        reads[s, 1] = [r if rnd.random() < 0.5 else turn(r) for r in own]
        rows += [(1, 1000 * s + i, 1, r, s) for i, r in enumerate(reads[s, 1])]
    cuts, real = [], assembly.cut
    monkeypatch.setattr(assembly, "cut", lambda df: cuts.append(1) or real(df))
    local = spark.createDataFrame([(r[4], 1, *r[:3]) for r in rows], "scaffold_id long, gap_no int, lib_no int, pair_id long, mate int")
    read_set = spark.createDataFrame([r[:4] for r in rows], "lib_no int, pair_id long, mate int, bases string")
    table = spark.createDataFrame([(*g, 60, 60) for g in gaps], "scaffold_id long, gap_no int, gap_start long, gap_end long, left_flank int, right_flank int")
    got = assembly.assembled_gaps(table, spark.createDataFrame(list(scaffolds.items()), "scaffold_id long, bases string"), local, read_set).collect()
    want = _slow(scaffolds, gaps, reads)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {s for s, *_ in want} == {1, 2, 3, 4, 5} and len(cuts) < 3


def test_query_walks_gaps_of_any_length(spark, monkeypatch):
    """Fillings of 233 bases and more were left out, as a walk ended after 256 steps. A walk that goes round ends as well."""
    rnd, scaffolds, reads, own = random.Random(9), {}, {}, []
    new = lambda n: "".join(rnd.choices("ACGT", k=n))
    turned = new(70)
    for s, filling in enumerate([new(231), new(233), new(300), new(5000), turned * 3], 1):
        left, right = new(60), new(60)
        scaffolds[s] = left + "N" * 30 + right
        text = left + filling + right if s < 5 else left + filling
        reads[s, 1] = [text[i : i + 80] for i in range(0, len(text) - 79, 5)] + [text[-80:]]
        own += [(1, 10_000 * s + i, 1, r, s) for i, r in enumerate(reads[s, 1])]
    monkeypatch.setattr(queries_records.qa, "scaffolds_of", lambda *_: spark.createDataFrame(list(scaffolds.items()), "scaffold_id long, bases string"))
    monkeypatch.setattr(queries_records, "reads_of", lambda *_: spark.createDataFrame([r[:4] for r in own], "lib_no int, pair_id long, mate int, bases string"))
    monkeypatch.setattr(queries_records, "_local", lambda *_: spark.createDataFrame([(r[4], 1, *r[:3]) for r in own], "scaffold_id long, gap_no int, lib_no int, pair_id long, mate int"))
    got = [tuple(r) for r in queries_records.gaps_assembled(spark, "").collect()]
    want = _slow(scaffolds, [(s, 1, 60, 90) for s in scaffolds], reads, 10_000)
    assert len(got) == len(want) and set(got) == want and {s for s, *_ in want} == {1, 2, 3, 4}
