"""Word graphs, gaps and contacts on fixtures in which every case occurs, against brute force."""

import random

from pyspark.sql import functions as F

from strandloom.operators import assembly, evidence, words

TURN = str.maketrans("ACGT", "TGCA")


def turned(s):
    return s.translate(TURN)[::-1]


def lower(s):
    return min(s, turned(s))


def new(rnd, n):
    return "".join(rnd.choices("ACGT", k=n))


def reads_of(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "bases string")


def test_unitigs_spell_the_sequences(spark):
    rnd = random.Random(1)
    a, b = new(rnd, 150), new(rnd, 90)
    got = assembly.unitigs(words.word_counts(reads_of(spark, [a, turned(a)[20:], b]))).collect()
    assert sorted((r.bases, r.n_words) for r in got) == sorted((lower(s), len(s) - 20) for s in (a, b))
    ring = new(rnd, 60)
    got = assembly.unitigs(words.word_counts(reads_of(spark, [ring + ring[:20]]))).collect()
    assert len(got) == 1 and got[0].n_words == 60 and len(got[0].bases) == 80
    assert got[0].bases in ring * 3 or turned(got[0].bases) in ring * 3
    single = words.word_counts(reads_of(spark, ["A" * 21, a[:21]]))
    assert sorted(r.bases for r in assembly.unitigs(single).collect()) == sorted(["A" * 21, lower(a[:21])])


def test_tips_and_bubbles_are_cut(spark):
    rnd = random.Random(2)
    seq = new(rnd, 300)
    snp = seq[:150] + ("A" if seq[150] != "A" else "C") + seq[151:]
    tip = seq[100:130] + new(rnd, 5)
    counts = words.word_counts(reads_of(spark, [seq] * 6 + [snp] * 3 + [tip])).cache()
    units = assembly.unitigs(counts).cache()
    bubbles = assembly.unitig_bubbles(units).collect()
    assert len(bubbles) == 1 and bubbles[0].distance == 1 and bubbles[0].collapses
    cov = {r.unitig: r.coverage for r in units.collect()}
    assert cov[bubbles[0].kept] == max(cov[bubbles[0].a], cov[bubbles[0].b])
    tips = assembly.unitig_tips(units).collect()
    assert [r.n_words for r in tips] == [5]
    left = assembly.unitigs(assembly.clean_words(counts)).collect()
    assert [r.bases for r in left] == [lower(seq)]


def test_probability_of_joining(spark):
    import math

    one = spark.createDataFrame([(12.5, 100.0)], "coverage double, length double")
    for r in assembly.word_steps(one, 21, 30).collect():
        lam = 12.5 * (100 - r.large + 1) / 100
        assert abs(r.log_p + 2 * sum(math.exp(i * math.log(lam) - math.lgamma(i + 1) - lam) for i in range(r.cutoff))) < 1e-8


def test_gaps_are_closed_by_words_of_local_reads(spark):
    rnd = random.Random(3)
    left, mid, right = new(rnd, 200), new(rnd, 130), new(rnd, 200)
    full = left + mid + right
    scaffolds = spark.createDataFrame([(1, left + "N" * 100 + right), (2, left + "N" * 20 + new(rnd, 60))], "scaffold_id long, bases string")
    gaps = spark.createDataFrame([(1, 1, 200, 300, 200, 200), (2, 1, 200, 220, 200, 60)], "scaffold_id long, gap_no int, gap_start long, gap_end long, left_flank int, right_flank int")
    parts = [full[i : i + 60] for i in range(150, 350, 15)]
    reads = spark.createDataFrame([(1, k, 1, p if k % 2 else turned(p)) for k, p in enumerate(parts)], "lib_no int, pair_id long, mate int, bases string")
    local = spark.createDataFrame([(g, 1, 1, k, 1) for g in (1, 2) for k in range(len(parts))], "scaffold_id long, gap_no int, lib_no int, pair_id long, mate int")
    got = assembly.assembled_gaps(gaps, scaffolds, local, reads).collect()
    assert [(r.scaffold_id, r.filling) for r in got] == [(1, mid)]
    out = {r.scaffold_id: r.bases for r in assembly.filled(scaffolds, gaps, assembly.assembled_gaps(gaps, scaffolds, local, reads)).collect()}
    assert out[1] == full and out[2].count("N") == 20


def test_small_gap_consensus(spark):
    votes = [(1, 1, "ACGT", 2), (1, 1, "ACGA", 1), (1, 1, "ACCA", 1), (1, 1, "AC", 1), (2, 1, "A", 2), (3, 1, "", 4), (4, 1, "A", 2), (4, 1, "CC", 2)]
    got = assembly.closed_gaps(spark.createDataFrame(votes, "scaffold_id long, gap_no int, filling string, n_reads long")).collect()
    assert sorted((r.scaffold_id, r.n_reads, r.length, r.filling) for r in got) == [(1, 5, 4, "ACGA"), (3, 4, 0, "")]


def test_spanning_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(evidence, "STRETCH", 64)
    rnd = random.Random(4)
    iv = [(s, *sorted(rnd.choices(range(3000), k=2))) for s in (1, 2) for _ in range(200)] + [(1, 505, 510)] * 3
    gaps = [(s, k, a, a + rnd.choice([1, 40, 2000])) for s in (1, 2, 3) for k, a in enumerate(rnd.sample(range(900), 9))]
    got = evidence.spanning(spark.createDataFrame(iv, "scaffold_id long, low long, high long"), spark.createDataFrame(gaps, "scaffold_id long, gap_no int, gap_start long, gap_end long")).collect()
    assert {(r.scaffold_id, r.gap_no): r.n for r in got} == {(s, k): sum(t == s and lo < a and hi >= b for t, lo, hi in iv) for s, k, a, b in gaps}


def test_two_depths_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(evidence, "STRETCH", 16)
    rnd = random.Random(5)
    sets = [[(k, *sorted(rnd.choices(range(90), k=2))) for k in "ab" for _ in range(12)] for _ in range(2)]
    dfs = [spark.createDataFrame(s, "k string, a long, b long") for s in sets]
    seen = {}
    for r in evidence.two_depths(*dfs, "k").collect():
        for p in range(r.seg_start, r.seg_end):
            seen[r.k, p] = (r.depth, r.against)
    want = {(k, p): tuple(sum(x == k and a <= p < b for x, a, b in s) for s in sets) for k in "ab" for p in range(90)}
    assert seen == {q: v for q, v in want.items() if v != (0, 0)}


def test_contacts_join_scaffolds_end_to_end(spark):
    rnd = random.Random(6)
    # Scaffolds of 10,000 bases in the order 3, -1, 2; 4 has no contacts. Contigs bear the scaffold's number.
    order, at = [(3, 1), (1, -1), (2, 1)], {}
    parts = spark.createDataFrame([(s, 1, s, s, "+", 0, 10_000, None, None) for s in (1, 2, 3, 4)], "scaffold_id long, part_no int, contig_ref long, contig_id long, strand string, comp_start long, comp_end long, gap long, before long")
    pairs = []
    for k in range(600):
        x = rnd.randrange(30_000)
        y = min(29_999, max(0, x + rnd.choice([-1, 1]) * int(rnd.expovariate(1 / 900))))
        place = lambda v: (order[v // 10_000][0], v % 10_000 if order[v // 10_000][1] > 0 else 9_999 - v % 10_000)
        (a, p), (b, q) = place(x), place(y)
        pairs.append((1, k, a, p, -b, q))
    df = spark.createDataFrame(pairs, "lib_no int, pair_id long, id1 long, place1 long, id2 long, place2 long")
    got = {r.scaffold_id: r for r in evidence.chromosome_rounds(df, parts).collect()}
    row = sorted((r.start, s, r.sign) for s, r in got.items() if r.node == 1)
    signed = [s * g for _, s, g in row]
    assert signed in ([3, -1, 2], [-2, 1, -3]) and [a for a, *_ in row] == [0, 10_500, 21_000] and got[4].node == 4


def test_peaks(spark):
    rnd = random.Random(7)
    rows = [(k, i, float(rnd.choice([0, 0, 1, 2, 3]))) for k in range(5) for i in range(40)]
    got = {tuple(r) for r in evidence.signal_peaks(spark.createDataFrame(rows, "k int, at int, v double"), "k", "at", "v", 1.0).select("k", "at").collect()}
    want = set()
    for k in range(5):
        v = [x for q, _, x in rows if q == k]
        for i in range(1, 39):
            j = i
            while j < 39 and v[j + 1] == v[i]:
                j += 1
            if v[i] > v[i - 1] and j < 39 and v[j + 1] < v[i] and v[i] > 1.0:
                want.add((k, i))
    assert got == want and want


def test_diploid_edges(spark):
    parts = spark.createDataFrame([(1, 0, 1, 1, 100), (1, 1, 5, -1, 80), (2, 0, 2, 1, 50), (2, 1, 2, 1, 50)], "consensus_id long, h int, scaffold_id long, sign int, len long")
    edges = spark.createDataFrame([(1, 1, 2, 1, 3, 10), (5, -1, 2, -1, 2, 40)], "src long, direction int, dst long, orient int, num_link long, gap long")
    got = [tuple(r) for r in evidence.consensus_edges(edges, parts).collect()]
    # 5 is turned: its left end is the right end of the diploid node, 20 bases short of it.
    assert got == [(1, 1, 2, 1, 5, 5, int((10 * 6 + 20 * 4) / 10))]
    assert evidence.consensus_edges(edges.limit(0), parts).where(F.lit(True)).collect() == []
