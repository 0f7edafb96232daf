"""Nothing is left out of large, long or dirty inputs: against brute force."""

import collections
import itertools
import random

from strandloom import queries_assembly
from strandloom.operators import mapping, skew, words


def test_pairs_within_blocks(spark):
    sizes = {1: 1, 2: 2, 3: 17, None: 3}
    rows = [(k, i * 7 - 20, i) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k long, item long, v long")
    want = sorted((k, x[1], x[2], y[1], y[2]) for k in (1, 2, 3) for x, y in itertools.combinations([r for r in rows if r[0] == k], 2))
    for block in (1, 4, 64):
        got = skew.pairs_within(df, "k", "item", "v", block=block).select("k", "x.item", "x.v", "y.item", "y.v").collect()
        assert sorted(map(tuple, got)) == want


def test_tags_on_many_contigs_count(spark):
    rnd = random.Random(11)
    reads = [(1, i, 1, "A", 5 if i < 400 else rnd.randrange(6, 9)) for i in range(450)]
    at = {i: rnd.randrange(1, 90) * rnd.choice([1, -1]) for i in range(450)}
    mapped = spark.createDataFrame([(1, i, 1, c, 0) for i, c in at.items()], "lib_no int, pair_id long, mate int, signed_id long, diagonal long")
    per = collections.defaultdict(collections.Counter)
    for _, i, _, _, tag in reads:
        per[tag][abs(at[i])] += 1
    want = collections.defaultdict(lambda: [0, 0])
    for n in per.values():
        for a, b in itertools.combinations(sorted(n), 2):
            want[a, b][0] += min(n[a], n[b])
            want[a, b][1] += 1
    assert len(per[5]) > 64
    got = mapping.common_tags(mapped, spark.createDataFrame(reads, "lib_no int, pair_id long, mate int, bases string, tag int")).collect()
    assert {(r.contig_a, r.contig_b): [r.score, r.n_tags] for r in got} == dict(want)


PAF = "q_name string, q_len long, q_start long, q_end long, strand string, t_name string, t_len long, t_start long, t_end long, match_len long, aln_len long, mapq int, cg string"


def test_long_reads_link_all_their_contigs(spark, tmp_path):
    hit = lambda q, a, b, t, n, lo, hi, strand="+", match=None: (q, 9000, a, b, strand, t, n, lo, hi, b - a if match is None else match, b - a, 60, None)
    rows = [
        hit("r", 0, 2000, "a", 2000, 0, 2000), hit("r", 2100, 4100, "b", 2000, 0, 2000, "-"), hit("r", 4300, 6300, "c", 2000, 0, 2000),
        hit("r", 2200, 3800, "d", 1600, 0, 1600, match=1500),  # lies over b, which has more matches
        hit("r", 6400, 7900, "e", 1500, 0, 1500, match=900),  # identity of 0.6
        hit("s", 100, 1200, "a", 9000, 3000, 4100), hit("s", 1300, 2400, "c", 1100, 0, 1100),  # c lies within the projected a
        hit("t", 0, 1500, "a", 2000, 0, 1500, match=1400), hit("t", 1500, 2600, "a", 2000, 900, 2000), hit("t", 3000, 5000, "c", 2000, 0, 2000),  # a's first hit is better
    ]
    spark.createDataFrame(rows, PAF).write.parquet(str(tmp_path / "paf_hits.parquet"))
    names = [(i + 1, n, "ACGT", None) for i, n in enumerate("cbade")]
    spark.createDataFrame(names, "contig_id long, name string, seq string, cov int").write.parquet(str(tmp_path / "contigs.parquet"))
    got = sorted(map(tuple, queries_assembly.long_links_of(spark, str(tmp_path)).collect()))
    assert got == [("r", -1, -3, 2300), ("r", -1, 2, 200), ("r", 2, -3, 100), ("t", -1, -3, 1000)]


def test_long_links_of_crowded_reads(spark):
    rnd = random.Random(12)
    hits = {}
    for i in range(1, 151):
        a = rnd.randrange(4000)
        hits[i * rnd.choice([1, -1])] = (a, a + rnd.randrange(30, 900))
    rows = [("q", a, b, "-" if s < 0 else "+", f"n{abs(s)}", b - a, 0, b - a, b - a) for s, (a, b) in hits.items()]
    want = set()
    for s, t in itertools.combinations(sorted(hits), 2):
        (a, b), (c, d) = hits[s], hits[t]
        if (b <= d) if a <= c else (d <= b):
            x, y = (s, t) if b < d else (t, s)
            want.add((*((x, y) if abs(x) < abs(y) else (-y, -x)), c - b if a <= c else a - d))
    df = spark.createDataFrame(rows, "q_name string, q_start long, q_end long, strand string, t_name string, t_len long, t_start long, t_end long, match_len long")
    contigs = spark.createDataFrame([(i, f"n{i}") for i in range(1, 151)], "contig_id long, name string")
    got = mapping.long_links(df, contigs).select("id1", "id2", "gap").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_reads_on_many_contigs_are_shared(spark):
    on = {"big": range(1, 101), "small": [5, 3, 9], "one": [7]}
    df = spark.createDataFrame([(q, f"n{c}") for q, cs in on.items() for c in cs for _ in range(2)], "q_name string, t_name string")
    contigs = spark.createDataFrame([(i, f"n{i}") for i in range(1, 101)], "contig_id long, name string")
    want = collections.Counter(p for cs in on.values() for p in itertools.combinations(sorted(cs), 2))
    assert {(r.a, r.b): r.n for r in words.shared_reads(df, contigs).collect()} == dict(want)


def turn(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_long_and_turned_overlaps(spark):
    rnd = random.Random(13)
    g = "".join(rnd.choices("ACGT", k=6000))
    seqs = {1: g[:3000], 2: g[1200:4200], 3: turn(g[3900:5000]), 4: turn(g[:1500]), 5: "NN" + g[4950:6000], 6: g[5960:] + "N", 7: "ACG", 8: "N" * 50}
    seqs |= {9: turn(g[2900:3100]) + turn(g[:60]), 10: "AC" * 40, 11: "CA" * 30}
    k, want = 31, {}
    signed = {s * c: b if s > 0 else turn(b) for c, b in seqs.items() for s in (1, -1)}
    for a, b in itertools.permutations(signed, 2):
        if abs(a) == abs(b) or max(a, b) < 0 or (a * b < 0 and abs(a) > abs(b)) or "N" in signed[a][-k:]:
            continue
        ns = [n for n in range(k, min(len(signed[a]), len(signed[b])) + 1) if signed[a][-n:] == signed[b][:n]]
        if ns:
            want[a, b] = max(ns)
    assert want[1, 2] == 1800 and want[2, -3] == 300
    got = words.end_overlaps(spark.createDataFrame(list(seqs.items()), "contig_id long, bases string")).collect()
    assert {(r.a, r.b): r.overlap for r in got} == want and len(got) == len(want)


def test_long_alleles_are_compared(spark):
    rnd = random.Random(14)
    g = "".join(rnd.choices("ACGT", k=2600))
    texts = {1: g, 2: g[:900] + g[910:2000] + "T" + g[2000:], 3: g[:31], 4: g[:50]}
    contigs = spark.createDataFrame([(c, t, 5 + c) for c, t in texts.items()], "contig_id long, bases string, cov int")

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != q))
        return row[-1]

    pairs = [(1, 2), (1, 3), (3, 4)]
    want = {(a, b, d := distance(texts[a], texts[b]), d <= 0.1 * max(len(texts[a]), len(texts[b])), b) for a, b in pairs}
    assert {tuple(r) for r in words.allele_similarity(spark.createDataFrame(pairs, "a long, b long"), contigs).collect()} == want


def test_an_n_at_the_other_end_does_no_harm(spark):
    rnd = random.Random(15)
    g = "".join(rnd.choices("ACGT", k=400))
    dirty = "".join("N" if i % 20 == 9 else c for i, c in enumerate(g))
    seqs = {1: g, 2: g[:80] + "N", 3: "NN" + g[5:], 4: "N" + g[50:90], 5: g[50:100] + "N", 6: g[20:30] + "N" + g[31:60], 7: "A" + g[300:] + "N" + g[50:100] + "N" + g[:31], 8: dirty, 9: turn(dirty[30:90])}
    df = spark.createDataFrame([*seqs.items(), (10, "N" + g[50:90] + "A"), (11, turn("T" + g[20:30] + "N" + g[31:60]))], "contig_id long, bases string")
    seqs = {r.contig_id: r.bases for r in df.collect()}
    want = {}
    for c, s in seqs.items():
        hosts = [h for h, t in seqs.items() if h != c and (len(t) > len(s) or (len(t) == len(s) and h < c)) and (s in t or s in turn(t))]
        if hosts:
            want[c] = min(hosts)
    assert want[4] == 7 and want[5] == 7 and want[6] == 11 and want[9] == 8
    assert {r.contig_id: r.within for r in words.contained(df).collect()} == want
    assert [tuple(r) for r in words.end_partners(df, both=False).collect()] == [(1, 2)]
    assert words.end_partners(df).collect() == []
