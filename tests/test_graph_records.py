"""Sources, records, pruning and contraction against brute force on small fixtures in which the cases occur."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import graph, nodes, pruning, records
from strandloom.sources import assembly as src

EDGE = "src long, direction int, dst long, orient int, num_link long, gap long"


def mirrored(spark, links):
    """Edges of (id1, id2, num_link, gap)."""
    return graph.edges(spark.createDataFrame(links, "id1 long, id2 long, num_link long, gap long"))


def test_wrapped_fastq_and_pairs(spark, tmp_path):
    rnd = random.Random(2)
    want, text = [], []
    for k in range(40):
        seq = "".join(rnd.choices("ACGTN", k=rnd.choice([1, 30, 95])))
        qual = "".join(rnd.choices("@+ABI#", k=len(seq)))
        width = rnd.choice([1000, 20])
        wrap = lambda s: "\n".join(s[i : i + width] for i in range(0, len(s), width))
        if width == 20:
            qual = "I" * len(seq)
        text.append(f"@r{k} BX:Z:A{k % 3}-1\n{wrap(seq)}\n+\n{wrap(qual)}\n")
        want.append((k, f"r{k}", f"A{k % 3}-1", seq))
    plain, packed = tmp_path / "a.fq", tmp_path / "b.fq.gz"
    plain.write_text("".join(text))
    packed.write_bytes(gzip.compress("".join(text).replace("\n", "\r\n").encode()))
    for p in (plain, packed):
        got = src.read_fastq(spark, str(p)).select("ordinal", "name", "tag", "bases").collect()
        assert sorted(map(tuple, got)) == want
    fasta = tmp_path / "c.fa"
    fasta.write_text("".join(f">r{k} BX:Z:A{k % 3}-1\n{s}\n" for k, _, _, s in want))
    assert sorted(map(tuple, src.read_tagged_fasta(spark, str(fasta)).select("ordinal", "name", "tag", "bases").collect())) == want
    pairs = src.paired_files(src.read_fastq(spark, str(plain)), src.read_fastq(spark, str(packed)).where("ordinal < 30"))
    assert sorted(map(tuple, pairs.select("pair_id", "mate", "bases").collect())) == sorted((k, m, s) for k, _, _, s in want[:30] for m in (1, 2))
    one = src.interleaved(src.read_fastq(spark, str(plain)).where("ordinal < 39"))
    assert sorted(map(tuple, one.select("pair_id", "mate", "bases").collect())) == [(k // 2, k % 2 + 1, s) for k, _, _, s in want[:38]]


def test_block_list(spark, tmp_path):
    (tmp_path / "block.tsv").write_text("a\tb\n\nc  zz\nonly\n")
    ids = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "contig_id long, name string")
    got = src.blocked_ids(src.read_block_list(spark, str(tmp_path / "block.tsv")), ids)
    assert [tuple(r) for r in got.collect()] == [(1, 2)]
    from strandloom.operators.mapping import drop_blocked

    pairs = spark.createDataFrame([(1, -2), (-2, -1), (1, 3)], "id1 long, id2 long")
    assert [tuple(r) for r in drop_blocked(pairs, got).collect()] == [(1, 3)]


def test_expected_links_against_the_integral(spark):
    import math

    cov, l1, l2, gap, avg, sd, read = 30.0, 900.0, 700.0, 120.0, 500.0, 60.0, 100.0
    total = 0.0
    for ins in range(int(avg - 6 * sd), int(avg + 6 * sd)):  # fragments of each length, by the places they have
        ways = sum(1 for a in range(int(read), int(l1) + 1) if read <= ins - gap - a <= l2)
        total += ways * math.exp(-(((ins - avg) / sd) ** 2) / 2) / (sd * math.sqrt(2 * math.pi))
    lit = [F.lit(x) for x in (cov, l1, l2, gap, avg, sd, read)]
    got = spark.range(1).select(pruning.expected(*lit).alias("e"), pruning.erf(F.lit(0.5)).alias("p"), pruning.erf(F.lit(-1.3)).alias("q")).first()
    assert abs(got.e - cov / (2 * read) * total) / got.e < 0.02
    assert abs(got.p - math.erf(0.5)) < 1e-6 and abs(got.q - math.erf(-1.3)) < 1e-6


def test_likely_gaps(spark):
    rnd = random.Random(4)
    links = [(1, k, rnd.randrange(-60, 60) * (10 if rnd.random() < 0.1 else 1)) for k in range(2, 9) for _ in range(rnd.randrange(1, 9))]
    got = {r.id2: r.gap for r in pruning.likely_gaps(spark.createDataFrame(links, "id1 long, id2 long, gap long"), 40).collect()}
    for k in range(2, 9):
        g = sorted(x for _, i, x in links if i == k)
        n = len(g)
        med = g[n // 2] if n % 2 else int((g[n // 2 - 1] + g[n // 2]) / 2)
        tried = range(max(g[0], med - 40), min(g[-1], med + 40) + 1)
        assert got[k] == min(tried, key=lambda d: (sum((d - x) ** 2 for x in g), d))


def test_one_pass_of_pruning_is_the_fixed_point(spark):
    rnd = random.Random(5)
    e = mirrored(spark, [(a, b * rnd.choice([1, -1]), rnd.choice([1, 2, 9, 40]), rnd.randrange(0, 300)) for a in range(1, 20) for b in rnd.sample(range(a + 1, 40), 3)]).cache()
    n = spark.createDataFrame([(k, 400) for k in range(1, 40)], "contig_id long, len long")
    once = graph.drop_erroneous(e, graph.conflicts(e, n)).cache()
    assert 0 < once.count() < e.count()
    assert once.exceptAll(graph.drop_erroneous(once, graph.conflicts(once, n))).isEmpty()


def test_tips_are_cut_to_the_end(spark):
    # 1-2-3 is a trunk; 4-5 hang on 2 as a chain of tips; 9 is long and stays.
    e = mirrored(spark, [(1, 2, 9, 0), (2, 3, 9, 0), (2, 4, 1, 0), (4, 5, 1, 0), (3, 9, 1, 0)])
    c = spark.createDataFrame([(1, 900, 20), (2, 900, 20), (3, 900, 20), (4, 90, 10), (5, 90, 5), (9, 5000, 1)], "contig_id long, len long, cov int")
    got = pruning.cut_tips(e, c, 2000)
    assert {(r.src, r.dst) for r in got.collect()} == {(1, 2), (2, 1), (2, 3), (3, 2), (3, 9), (9, 3)}


def brute_contract(links, lens):
    """Contraction of reciprocal single edges, one chain at a time, on signed ids."""
    nodes_ = {n: [(n, 0, ln, 1)] for n, ln in lens.items()}
    edges = [(a, b, n, g) for a, b, n, g in links]  # signed: the right end of a faces the left end of b
    while True:
        out = {}
        for a, b, n, g in edges:
            out.setdefault(a, []).append((b, g))
            out.setdefault(-b, []).append((-a, g))
        join = next(((a, v[0][0], v[0][1]) for a, v in sorted(out.items()) if len(v) == 1 and len(out.get(-v[0][0], [])) == 1 and abs(a) != abs(v[0][0])), None)
        if join is None:
            return nodes_
        a, b, g = join
        size = lambda n: max(e for _, _, e, _ in nodes_[n])
        turn = lambda n, rows: [(c, size(n) - e, size(n) - s, -d) for c, s, e, d in rows]
        left = nodes_[abs(a)] if a > 0 else turn(abs(a), nodes_[abs(a)])
        right = nodes_[abs(b)] if b > 0 else turn(abs(b), nodes_[abs(b)])
        shift = size(abs(a)) + g
        new = min(abs(a), abs(b)) + 1000 * (1 + max(nodes_) // 1000)
        merged = left + [(c, s + shift, e + shift, d) for c, s, e, d in right]
        rename = {a: None, -b: None, -a: -new, b: new}
        edges = [(rename.get(x, x), -rename.get(-y, -y) if rename.get(-y, -y) is not None else None, n, gg) for x, y, n, gg in edges]
        edges = [e for e in edges if e[0] is not None and e[1] is not None and abs(e[0]) != abs(e[1])]
        del nodes_[abs(a)], nodes_[abs(b)]
        nodes_[new] = merged


@pytest.mark.parametrize("seed", range(3))
def test_contraction(spark, seed):
    rnd = random.Random(seed)
    order = rnd.sample(range(1, 25), 24)
    links = []
    for a, b in zip(order, order[1:]):
        if rnd.random() < 0.75:
            x, y = a * rnd.choice([1, -1]), b * rnd.choice([1, -1])
            links.append((x, y, 3, rnd.randrange(0, 50)) if abs(x) < abs(y) else (-y, -x, 3, rnd.randrange(0, 50)))
    for _ in range(3):
        x, y = rnd.sample(range(1, 25), 2)
        links.append((min(x, y), max(x, y) * rnd.choice([1, -1]), 1, 7))
    links = list({(a, b): (a, b, n, g) for a, b, n, g in links}.values())
    lens = {k: 100 + 10 * k for k in range(1, 25)}
    c = spark.createDataFrame([(k, n) for k, n in lens.items()], "contig_id long, len long")
    got = {}
    for r in nodes.contract(mirrored(spark, links), c).collect():
        got.setdefault(r.node, []).append((r.contig_id, r.start, r.end, r.sign))
    flat = lambda rows: min(tuple(sorted(rows)), tuple(sorted((c, max(x[2] for x in rows) - e, max(x[2] for x in rows) - s, -d) for c, s, e, d in rows)))
    assert {frozenset(c for c, *_ in v) for v in got.values()} == {frozenset(c for c, *_ in v) for v in brute_contract(links, lens).values()}
    assert sorted(flat(v) for v in got.values()) == sorted(flat(v) for v in brute_contract(links, lens).values())


def test_polished_and_self_overlap(spark):
    rnd = random.Random(8)
    core = "".join(rnd.choices("ACGT", k=400))
    c = spark.createDataFrame([(1, core + core[:150]), (2, core), (3, "A" * 300), (4, ""), (5, "N" * 200)], "contig_id long, bases string")
    assert sorted(map(tuple, records.self_overlaps(c).collect())) == [(1, 150), (3, 299)]
    masked = spark.createDataFrame([(2, 10), (2, 70), (2, 70), (3, 0)], "contig_id long, pos long")
    got = {r.contig_id: r.bases for r in records.polished(c, masked).collect()}
    assert got == {1: core + core[:150], 2: core[11:70] + "N" + core[71:], 3: "A" * 299}


def test_histogram_by_number(spark):
    hist = spark.createDataFrame([("a", 1, 10), ("a", 2, 80), ("a", 5, 10), ("b", 3, 1)], "k string, value long, n long")
    got = {(r.k, r.value): r.n for r in records.by_number(hist, "k", edge=0.3).collect()}
    assert got == {("a", 2): 70.0, ("b", 3): 0.7}
