"""The core against brute force on small, dirty tables; sources and sinks as round trips."""

import bz2
import collections
import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import codes, seq
from strandloom.operators import coverage, graph, layout, mapping, skew, stats, words
from strandloom.sources import assembly as src
from strandloom.sources.tables import spread

POST = "hash_key long, contig_id long, pos_offset int"


def brute_keys(rows):
    place = {}
    for k, c, p in rows:
        if k is not None and k >= 0 and c not in (None, 0) and p is not None:
            place[c, p] = min(k, place.get((c, p), k))
    by = collections.defaultdict(list)
    for (c, p), k in place.items():
        by[k].append((c, p))
    return by


def test_key_report_with_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [(7 if rnd.random() < 0.4 else rnd.randrange(60), rnd.choice([0, None, *range(1, 30)]), rnd.choice([None, *range(40)])) for _ in range(3000)]
    rows += [(None, 1, 1), (-5, 1, 2), (0, 9, 99), (0, 9, 99)]
    df = spark.createDataFrame(rows, POST).withColumn("weight", F.lit("clash")).withColumn("n", F.lit(0))
    want = brute_keys(rows)
    got = {r.hash_key: r for r in skew.key_report(df).collect()}
    assert set(got) == set(want)
    for k, at in want.items():
        per = collections.Counter(c for c, _ in at)
        mode = min(per, key=lambda c: (-per[c], c))
        assert (got[k].n_postings, got[k].n_contigs, got[k].mode_contig, (got[k].first_contig, got[k].first_pos)) == (len(at), len(per), mode, min(at))
    total = sum(map(len, want.values()))
    assert {tuple(r) for r in skew.hot_keys(df).collect()} == {(k, *min(at)) for k, at in want.items() if len(at) * 100 >= total}
    assert skew.key_report(df.limit(0)).collect() == [] and skew.hot_keys(df.limit(0)).collect() == []


@pytest.mark.parametrize("bins", [1, 3, 1024])
def test_percentiles(spark, bins):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, -3, 0, 5, 5, 5, 900, 10**12])) for _ in range(300)] + [(9, None)]
    by = collections.defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    df = spark.createDataFrame(rows, "k long, v long")
    got = {(r.k, r.p): r.percentile for r in skew.key_percentiles(skew.compress(df, "k", "v"), "k", "v", (0.0, 0.5, 0.9, 1.0), bins).collect()}
    want = {(k, p): sorted(v)[max(1, -(-int(p * 10) * len(v) // 10)) - 1] for k, v in by.items() for p in (0.0, 0.5, 0.9, 1.0)}
    assert got == want


def test_components_and_chains(spark):
    rnd = random.Random(3)
    order = list(range(1, 41))
    rnd.shuffle(order)
    path = list(zip(order, order[1:]))
    pairs = path + [(100, 101), (101, 102), (102, 100), (None, 5), (60, None), (70, 70)]
    comp = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert comp == {**{k: 1 for k in order}, 100: 100, 101: 100, 102: 100, 70: 70}
    sign = {k: rnd.choice([1, -1]) for k in order}
    joins = [(sign[a] * a, sign[b] * b) for a, b in path]
    joins = [(x, y) if abs(x) < abs(y) else (-y, -x) for x, y in joins] + [(100, 101), (101, 102), (102, 100)]
    joins = [(x, y) if abs(x) < abs(y) else (-y, -x) for x, y in joins]
    got = {r.node: (r.chain, r.place, r.sign) for r in graph.chains(spark.createDataFrame(joins, "id1 long, id2 long")).collect()}
    walk = order if order[0] < order[-1] else order[::-1]
    turn = 1 if order[0] < order[-1] else -1
    assert {k: got[k] for k in order} == {k: (1, i + 1, sign[k] * turn) for i, k in enumerate(walk)}
    assert {got[k][0] for k in (100, 101, 102)} == {100} and got[100] == (100, 1, 1) and {got[k][1] for k in (100, 101, 102)} == {1, 2, 3}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_edges_of_all_orientations(spark):
    grouped = spark.createDataFrame([(1, 2, 3, 10), (1, -2, 1, 5), (-1, 2, 1, 5), (-1, -2, 1, -4)], "id1 long, id2 long, num_link long, gap long")
    got = {tuple(r) for r in graph.edges(grouped).select("src", "direction", "dst", "orient", "gap").collect()}
    assert got == {(1, 1, 2, 1, 10), (2, -1, 1, 1, 10), (1, 1, 2, -1, 5), (2, 1, 1, -1, 5), (1, -1, 2, -1, 5), (2, -1, 1, -1, 5), (1, -1, 2, 1, -4), (2, 1, 1, 1, -4)}


def test_conflicts_and_pruning(spark):
    e = spark.createDataFrame([(1, 1, 2, 1, 9, 0), (1, 1, 3, 1, 1, 60), (1, 1, 4, 1, 9, 100), (2, -1, 1, 1, 9, 0), (3, -1, 1, 1, 1, 60), (4, -1, 1, 1, 9, 100)], "src long, direction int, dst long, orient int, num_link long, gap long")
    lens = spark.createDataFrame([(1, 500), (2, 100), (3, 100), (4, 100)], "contig_id long, len long")
    c = graph.conflicts(e, lens)
    assert {(r.dst1, r.dst2, r.overlap) for r in c.collect()} == {(2, 3, 40), (3, 4, 60)}
    kept = {(r.src, r.dst) for r in graph.drop_erroneous(e, c).collect()}
    assert kept == {(1, 2), (1, 4), (2, 1), (4, 1)}


def test_depth_over_stretches(spark, monkeypatch):
    rnd = random.Random(4)
    iv = [(rnd.choice(["x", "y"]), a, a + rnd.randrange(-2, 90)) for a in (rnd.randrange(400) for _ in range(60))]
    df = spark.createDataFrame(iv, "k string, a long, b long")
    for size in (16, 1 << 20):
        monkeypatch.setattr(coverage, "STRETCH", size)
        seg = coverage.depth(df, "k", "a", "b").collect()
        got = {(r.k, p): r.depth for r in seg for p in range(r.seg_start, r.seg_end)}
        want = collections.Counter((k, p) for k, a, b in iv for p in range(a, b))
        assert got == dict(want)
    isl = coverage.islands(df, "k", "a", "b").collect()
    assert {(r.k, p) for r in isl for p in range(r.island_start, r.island_end)} == set(want)


def test_best_hits_are_greedy(spark):
    rnd = random.Random(5)
    rows = [(f"q{rnd.randrange(4)}", a, a + rnd.randrange(20, 200), f"t{i}", i, rnd.randrange(50)) for i, a in enumerate(rnd.randrange(500) for _ in range(80))]
    df = spark.createDataFrame(rows, "q_name string, q_start long, q_end long, t_name string, t_start long, match_len long")
    want = set()
    for q in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[5], -(r[2] - r[1]), r[1], r[3], r[4])):
            if all(min(r[2], y) - max(r[1], x) <= 32 for x, y in kept):
                kept.append((r[1], r[2]))
                want.add(r[3])
    assert {r.t_name for r in mapping.keep_best_hits(df).collect()} == want


def test_built_sequences(spark):
    parts = src.components(spark.createDataFrame([(1, 1, 5, 0, 4), (1, 2, -6, 6, 10), (1, 3, 7, 9, 12), (1, 3, 7, 9, 12), (2, 1, 99, 0, 3), (2, 2, 5, None, 9)], "scaffold_id long, part_no int, contig_ref long, comp_start long, comp_end long"))
    contigs = spark.createDataFrame([(5, "AACC"), (6, "GGTA"), (7, "CTT")], "contig_id long, bases string")
    got = {r.scaffold_id: r.bases for r in layout.build_sequences(layout.placed(parts), contigs).collect()}
    assert got == {1: "AACC" + "NN" + "TACC" + "TT", 2: "NNN"}


def test_word_graph(spark):
    seq = "".join(random.Random(6).choices("ACGT", k=120))
    rc = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    reads = spark.createDataFrame([(seq,), (rc[10:90],), ("ACGTNNACGT",)], "bases string")
    k = words.word_counts(reads, 15)
    want = collections.Counter(min(w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for r in (seq, rc[10:90]) for w in (r[i : i + 15] for i in range(len(r) - 14)))
    assert {r.kmer: r.n for r in k.select(codes.word_text(F.col("code"), 15).alias("kmer"), "n").collect()} == dict(want)
    st = words.stretches(k, words.straight_joins(k, 15), 15).collect()
    assert [(r.n_words, r.bases) for r in st] == [(106, 120)]
    ends = words.junctions(k, 15).collect()
    assert len(ends) == 2 and all(r.n_in + r.n_out == 1 for r in ends)


def test_coded_words(spark, monkeypatch):
    monkeypatch.setattr(codes, "PART", 64)
    rnd = random.Random(9)
    seqs = [(i, "".join(rnd.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n))) for i, n in enumerate((0, 1, 10, 11, 12, 63, 64, 65, 74, 75, 200, 3, 700))] + [(99, None)]
    df = spark.createDataFrame(seqs, "id long, bases string").withColumn("at", F.lit("clash"))
    text = codes.word_text(F.col("code"), 11)
    got = codes.coded_words(df, ["id"], 11, both=True).select("id", "strand", "at", text.alias("w"), codes.word_text(codes.reversed_code(F.col("code"), 11), 11).alias("r")).collect()
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    want = [(i, d, p, t[p : p + 11]) for i, s in seqs for d, t in ((1, s or ""), (-1, turn(s or ""))) for p in range(len(t) - 10) if "N" not in t[p : p + 11]]
    assert sorted((r.id, r.strand, r.at, r.w) for r in got) == sorted(want) and all(r.r == turn(r.w) for r in got)


def test_words_of_all_lengths(spark):
    seqs = ["".join(random.Random(n).choices("ACGTN", k=n)) for n in (0, 1, 14, 15, 16, 127, 128, 129, 141, 142, 143, 256, 257, 1000)]
    
    df = spark.createDataFrame([(s,) for s in seqs], "bases string")
    for r in df.select("bases", seq.kmers(F.col("bases"), 15).alias("w")).collect():
        assert list(r.w) == [r.bases[i : i + 15] for i in range(len(r.bases) - 14)]


def test_pile_up(spark):
    contig = "".join(random.Random(7).choices("ACGT", k=60))
    contigs = spark.createDataFrame([(1, contig, 60)], "contig_id long, bases string, len long")
    rc = contig[20:50].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    odd = "".join("ACGT"[("ACGT".index(c) + 1) % 4] for c in contig[40:60])
    reads = spark.createDataFrame([(1, 1, 1, contig[10:40], None), (1, 1, 2, rc, None), (1, 2, 1, odd, None), (1, 2, 2, "NN" + contig[:8], None)], "lib_no int, pair_id long, mate int, bases string, tag int")
    mapped = spark.createDataFrame([(1, 1, 1, 1, 10), (1, 1, 2, -1, 20), (1, 2, 1, 1, 40), (1, 2, 2, 1, -2)], "lib_no int, pair_id long, mate int, signed_id long, diagonal long")
    pile = {r.pos: r for r in words.pile_up(mapped, reads, contigs).collect()}
    assert all(pile[p].base == contig[p] for p in [*range(8), *range(10, 50)]) and pile[55].base is None
    assert pile[25].n_good == 2 and pile[45].n_good == 1 and pile[45].n_odd == 1 and 9 not in pile
    assert {r.pos for r in words.masked_positions(words.pile_up(mapped, reads, contigs)).collect()} == set(range(50, 60))
    assert [tuple(r) for r in words.low_ends(words.pile_up(mapped, reads, contigs), contigs).collect()] == [(1, 20, 10)]


def test_gap_filling(spark):
    s = "".join(random.Random(8).choices("ACGT", k=200))
    scaff = spark.createDataFrame([(1, s[:100] + "N" * 12 + s[110:])], "scaffold_id long, bases string")
    rc = s[70:140].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    reads = spark.createDataFrame([(s[60:130],), (rc,), (s[:90],)], "bases string")
    got = words.gap_fillings(layout.gap_table(scaff), scaff, reads).collect()
    assert [tuple(r) for r in got] == [(1, 1, s[100:110], 2)]


def test_left_minimum_and_cross(spark):
    hist = spark.createDataFrame([(1, 90), (2, 40), (3, 10), (4, 9), (5, 12), (8, 60)], "value long, n long")
    assert [tuple(r) for r in stats.left_minimum(hist, 1).collect()] == [(4, 9)]
    assert stats.left_minimum(hist.limit(0)).collect() == []
    e = [(5, -1, 1), (5, -1, 2), (5, 1, 3), (5, 1, 4)]
    edges = spark.createDataFrame([(s, d, t, 1, 1, 0) for s, d, t in e], "src long, direction int, dst long, orient int, num_link long, gap long")
    ev = spark.createDataFrame([(1, 3, 8), (2, 4, 1), (1, 4, 2)], "a long, b long, n long")
    r = graph.cross_support(edges, ev).collect()
    assert [(x.parallel, x.crossed, x.accepted) for x in r] == [(9, 2, "parallel")]


def test_gap_compensation(spark):
    seg = spark.createDataFrame([("a", 0, 30, 2)], "k string, seg_start long, seg_end long, depth long")
    clean = spark.createDataFrame([("a", "N" * 10 + "A" * 10 + "A" * 5 + "N" * 15 + "N" * 10)], "k string, bases string")
    got = {r.win: (r.depth, r.scaled_depth) for r in coverage.gap_compensated(seg, clean, "k", 20).collect()}
    assert got == {0: (2.0, 4.0), 1: (1.0, 4.0), 2: (0.0, None)}


def test_fasta_fastq_paf_files(spark, tmp_path):
    recs = [("c1", "ACGT" * 45), ("c2 extra", "NNAC"), ("c3", "")]
    text = "".join(f">{n}\n" + "".join(s[i : i + 80] + "\n" for i in range(0, len(s), 80)) for n, s in recs)
    (tmp_path / "a.fa").write_text(text)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.fa.bz2").write_bytes(bz2.compress(text.encode()))
    for f in ("a.fa", "b.fa.gz", "c.fa.bz2"):
        got = {(r.name, r.header, r.bases) for r in src.read_fasta(spark, str(tmp_path / f)).collect()}
        assert got == {(n.split()[0], n, s) for n, s in recs}
    assert src.file_kind(spark, str(tmp_path / "a.fa")) == "fasta"
    src.write_fasta(src.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    back = {(r.name, r.bases) for r in src.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert back == {("c1", recs[0][1]), ("c2", "NNAC")}
    (tmp_path / "r.fq").write_text("@r1 BX:Z:AC-1\nacgt\n+\nIIII\n@r2\nGGNN\n+\nIIII\n")
    assert [tuple(r)[1:] for r in src.read_fastq(spark, str(tmp_path / "r.fq")).orderBy("ordinal").collect()] == [(0, "r1", "AC-1", "ACGT"), (1, "r2", None, "GGNN")]
    assert src.file_kind(spark, str(tmp_path / "r.fq")) == "fastq"
    many = [(f"m{k}", "ACGTN"[k % 5] * (k % 70 + 1)) for k in range(400)]
    (tmp_path / "m.fq").write_text("".join(f"@{n}\r\n{s}\r\n+\r\n{'@' * len(s)}\r\n" for n, s in many))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = src.read_fastq(spark, str(tmp_path / "m.fq")).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r.ordinal, r.name, r.bases) for r in got] == [(k, n, s) for k, (n, s) in enumerate(many)]
    (tmp_path / "x.paf").write_text("q\t100\t0\t90\t+\tt\t500\t10\t101\t85\t92\t60\ttp:A:P\tcg:Z:40M2I49M1D\nq\t100\t0\tx\t-\t*\n")
    paf = src.read_paf(spark, str(tmp_path / "x.paf"))
    assert paf.count() == 2
    hit = src.alignments(paf).collect()
    assert [(h["ins"], h["del"], h.diagonal) for h in hit] == [(2, 1, 10)]


def test_spread_keeps_rows(spark):
    df = spark.range(50).coalesce(1)
    assert spread(df).rdd.getNumPartitions() >= 4 and spread(df).count() == 50


def test_dirty_and_empty_tables(spark):
    contigs = spark.createDataFrame([(1, "x_cov7_read9", "ac\ngt", 99, None, None), (1, "x_cov7_read9", "acgt", None, 3, None), (2, None, None, None, None, None), (None, "n", "A", 1, 1, None)], "contig_id long, name string, seq string, len long, cov int, loaded_at timestamp").withColumn("bases", F.lit("clash"))
    got = {r.contig_id: (r.name, r.bases, r.len, r.cov, r.read_len) for r in src.contig_set(contigs).collect()}
    assert got == {1: ("x_cov7_read9", "ACGT", 4, 3, 9), 2: (None, "", 0, 1, 1)}
    assert src.contig_set(contigs.limit(0)).collect() == []
    pairs = spark.createDataFrame([(1, 1, 1, "AC", 5), (1, 1, 1, "AC", None), (1, 1, 2, None, None), (2, 7, 1, "AAC", None), (2, 7, 2, "GGC", 1)], "lib_no int, pair_id long, mate int, seq string, tag int")
    libs = spark.createDataFrame([(1, "inward"), (2, "outward")], "lib_no int, kind string")
    assert [tuple(r) for r in src.oriented_pairs(src.reads(pairs), libs).collect()] == [(2, 7, "GTT", "GCC", 1)]
    assert [tuple(r) for r in src.tag_dictionary(src.reads(pairs)).orderBy("tag").collect()] == [(1, 1, 1), (5, 2, 1)]


def test_greedy_joins_as_in_order(spark):
    rnd = random.Random(9)
    links = {}
    while len(links) < 60:
        a, b = sorted(rnd.sample(range(1, 25), 2))
        links[a * rnd.choice([1, -1]), b * rnd.choice([1, -1])] = (rnd.randrange(1, 5), rnd.randrange(-9, 9))
    grouped = spark.createDataFrame([(x, y, n, g) for (x, y), (n, g) in links.items()], "id1 long, id2 long, num_link long, gap long")
    used, want = set(), set()
    for (x, y), (n, g) in sorted(links.items(), key=lambda r: (-r[1][0], abs(r[1][1]), r[1][1], *r[0])):
        if x not in used and -y not in used:
            used |= {x, -y}
            want.add((x, y))
    assert {(r.id1, r.id2) for r in graph.greedy_joins(graph.edges(grouped)).collect()} == want
    assert graph.greedy_joins(graph.edges(grouped.limit(0))).collect() == []
    joins = spark.createDataFrame([(1, 2, 1, 10), (2, -3, 1, -5)], "id1 long, id2 long, num_link long, gap long")
    lens = spark.createDataFrame([(1, 100), (2, 50), (3, 30)], "contig_id long, len long")
    got = {tuple(r) for r in graph.chain_offsets(graph.chains(joins), joins, lens).collect()}
    assert got == {(1, 1, 1, 1, 0, 100), (1, 2, 2, 1, 110, 160), (1, 3, 3, -1, 155, 185)}


def test_phasing_recovers_known_parity(spark):
    rnd = random.Random(10)
    parity = {b: rnd.randrange(2) for b in range(1, 15)}
    rows = []
    for x in parity:
        for y in parity:
            if x < y and (x <= 9) == (y <= 9) and rnd.random() < 0.6:
                strong, weak = rnd.randrange(5, 30), rnd.randrange(0, 4)
                rows.append((x, y, *((strong, weak) if parity[x] == parity[y] else (weak, strong))))
    rows.append((3, 12, 4, 4))
    got = {r.block: (r.phase_set, r.parity) for r in graph.phase_blocks(spark.createDataFrame(rows, "x long, y long, parallel long, crossed long")).collect()}
    for block, (s, p) in got.items():
        assert s == (1 if block <= 9 else 10) and p == (parity[block] + parity[s]) % 2


def test_contact_boundaries_of_blocks(spark):
    block = [(1, i, j, 5) for lo in (0, 4) for i in range(lo, lo + 4) for j in range(i, lo + 4)]
    smooth = [(2, i, j, 5) for i in range(8) for j in range(i, 8)]
    df = spark.createDataFrame(block + smooth, "scaffold_id long, i long, j long, n long")
    got = {(r.scaffold_id, r.boundary): r.separation for r in coverage.contact_boundaries(df).collect()}
    assert got[1, 4] == 1.0 and all(got[2, b] < 0.8 for b in range(2, 7))
