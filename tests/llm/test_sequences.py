"""Problems 1 to 4 against brute force on small tables."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.llm import bases, frequency, near, registry, spans, splitting
from strandloom.sources.tables import table

SF = "/root/testdata/sf0.001"
SCHEMA = "contig_id long, name string, seq string"


def plain(seq):
    return "".join((seq or "").split()).upper()


def brute_spans(rows):
    where = {}
    for cid, seq in rows:
        for i in range(len(seq) - 99):
            w = seq[i : i + 100]
            if "N" not in w:
                where.setdefault(w, set()).add((cid, i))
    shared = {}
    for places in where.values():
        if len({c for c, _ in places}) > 1:
            for c, i in places:
                shared.setdefault(c, set()).update(range(i, i + 100))
    out = set()
    for c, at in shared.items():
        at = sorted(at)
        for _, g in itertools.groupby(enumerate(at), lambda x: x[1] - x[0]):
            g = [p for _, p in g]
            out.add((c, g[0], g[-1] + 1))
    return out


def brute_pairs(rows):
    sets = {}
    for cid, seq in rows:
        sets[cid] = {seq[i : i + 16] for i in range(len(seq) - 15) if "N" not in seq[i : i + 16]}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def contigs(spark):
    rows = {r[0]: plain(r[1]) for r in table(spark, SF, "contigs").select("contig_id", "seq").collect() if r[1]}
    return list(rows.items())


def test_cover_has_every_difference():
    assert {(a - b) % spans.PERIOD for a in spans.COVER for b in spans.COVER} == set(range(spans.PERIOD))


def test_words():
    s = "ACGTTGCANACGT" * 3
    v = bases.codes(s)
    for k in (1, 5, 16, 25, 28):
        w, ok = bases.words(v, k), bases.clean(v, k)
        for i in range(len(s) - k + 1):
            assert ok[i] == ("N" not in s[i : i + k])
            if ok[i]:
                assert int(w[i]) == int("".join(str("ACGT".index(c)) for c in s[i : i + k]), 4)


def test_spans_whole_table(spark, contigs):
    got = {tuple(r) for r in registry.p3_found(spark, SF).collect()}
    assert got == brute_spans(contigs) and got
    share = {r.contig_id: r for r in registry.p3_shared_share(spark, SF).collect()}
    assert len(share) == table(spark, SF, "contigs").select("contig_id").distinct().count()
    assert sum(r.shared_bases for r in share.values()) == sum(e - s for _, s, e in got)


@pytest.mark.parametrize("few, many", [(1, 5), (1, 1 << 16), (5, 1 << 16), (64, 1 << 16), (64, 20)])
def test_spans_long_contigs_repeats_and_dirt(spark, monkeypatch, few, many):
    monkeypatch.setattr(spans, "FEW", few)
    monkeypatch.setattr(spans, "MANY", many)
    rnd = random.Random(3)
    new = lambda n: "".join(rnd.choices("ACGT", k=n))
    core, hot = new(40_000), "TTAGGG" * 40
    rows = [(1, new(500) + core + new(60)), (2, core[:20_000] + new(30) + core[20_050:]), (3, new(99)), (4, core[100:199]), (5, core[100:200]),
            (6, new(50) + hot + "N" + hot), *((10 + k, hot + new(k)) for k in range(30)), (7, "A" * 300), (8, None), (9, "")]
    dirty = [(c, "x", s if s is None or c % 2 else "\n".join(re.findall(".{1,60}", s.lower()))) for c, s in rows]
    df = spark.createDataFrame([*dirty, *dirty[:3], (None, "n", core)], SCHEMA).withColumn("code", F.lit(1)).withColumn("pos", F.lit("clash"))
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == brute_spans([(c, s or "") for c, s in rows])
    assert spans.shared_spans(df.limit(0)).collect() == []


def test_spans_of_a_code_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(spans, "LEAST", 20)
    rnd = random.Random(9)
    hot = "".join(rnd.choices("ACGT", k=130))
    rows = [(k, "".join(rnd.choices("ACGT", k=rnd.randrange(90))) + hot + "".join(rnd.choices("ACGT", k=rnd.randrange(90)))) for k in range(1, 400)]
    df = spark.createDataFrame([(c, None, s) for c, s in rows], SCHEMA).coalesce(1)
    kinds = {r.kind: r["count"] for r in spans.anchors(df, 1 << 20).groupBy("kind").count().collect()}
    assert kinds.get(2, 0) > 500 and kinds[1] >= 2  # settled where they are made
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == brute_spans(rows)


def test_spans_of_contigs_with_other_bases(spark):
    rnd = random.Random(4)
    core = "".join(rnd.choices("ACGT", k=700))
    rows = [(1, core), (1, core[:300] + "N" * 120), (1, "T" * 150), (2, core[100:400]), (3, "")]
    got = [tuple(r) for r in spans.shared_spans(spark.createDataFrame([(c, None, s) for c, s in rows], SCHEMA)).collect()]
    assert all(e - a >= 100 for _, a, e in got) and {c for c, _, _ in got} <= {1, 2}


def test_pairs_whole_table(spark, contigs):
    got = [tuple(r) for r in registry.p4_found(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(contigs) and got
    group = {r.contig_id: r for r in registry.p4_groups(spark, SF).collect()}
    assert all(group[a].group_id == group[b].group_id for a, b in got)


def test_pairs_copies_edges_and_dirt(spark, monkeypatch):
    rnd = random.Random(5)
    new = lambda n: "".join(rnd.choices("ACGT", k=n))
    core = new(900)
    rows = [(k, core[: 500 + 25 * k] + new(25 * k)) for k in range(1, 12)]
    rows += [(20, core), (21, core), (22, core), (23, core[450:] + core[:450]), (24, "A" * 40), (25, "A" * 60), (26, "ACG"), (27, "N" * 50), (28, ""), (29, None)]
    rows += [(40 + k, "TTAGGG" * 30 + new(150)) for k in range(20)]
    df = spark.createDataFrame([*((c, None, s) for c, s in rows), (20, "again", core.lower()), (None, "n", core)], SCHEMA).withColumn("rep", F.lit(0)).withColumn("words", F.lit("clash"))
    classes, links = near.near_duplicates(df)
    got = [tuple(r) for r in near.pairs(classes, links).collect()]
    want = brute_pairs([(c, s or "") for c, s in rows])
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(near, "WRITTEN_OUT", 2)
    few = {tuple(r) for r in near.pairs(classes, links).collect()}
    assert few < want and {(20, 21), (20, 22)} <= few and (21, 22) not in few
    empty = near.near_duplicates(df.limit(0))
    assert near.pairs(*empty).collect() == [] and near.groups(*empty).collect() == []


def brute_cuts(seq):
    """The rule of TESTDATA, position by position."""
    mids = [m.start() + (m.end() - m.start()) // 2 for m in re.finditer("N{10,}", seq)]
    out, start = [], 0
    while len(seq) - start > 4000:
        end = max([m for m in mids if start + 150 < m <= start + 4000], default=start + 4000)
        out.append((start, end))
        start = end - 150
    return [*out, (start, len(seq))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("AN"), st.one_of(st.integers(1, 30), st.integers(100, 9000))), max_size=40))
def test_bisection_gives_the_fixed_pieces(runs):
    seq = "".join(c * n for c, n in runs)
    got = splitting.pieces_of(len(seq), splitting.gaps(seq, 10), "fixed", 4000, 150)
    assert got == brute_cuts(seq)
    free = splitting.pieces_of(len(seq), splitting.gaps(seq, 10), "free", 4000, 150)
    assert all(b - a <= 4000 for a, b in free) and free[0][0] == 0 and free[-1][1] == len(seq)


def test_split_whole_table(spark):
    seqs = {r[0]: plain(r[1]) for r in table(spark, SF, "scaffolds").select("scaffold_id", "seq").collect() if r[1]}
    want = {(s, k, a, b) for s, q in seqs.items() if len(q) > 4000 for k, (a, b) in enumerate(brute_cuts(q), 1)}
    got = [tuple(r) for r in registry.p1_found(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_split_cases(spark):
    gap = "N" * 10
    rows = [
        (1, ">first word", "A" * 3990 + "n" * 20 + "C" * 100), (1, ">first word", "A" * 3990 + "n" * 20 + "C" * 100), (2, None, "ACGT" * 1000), (3, "x", "ACGT" * 1000 + "A"),
        (4, "y", None), (5, "y", ""), (6, " >z\tq", (gap + "A" * 20) * 400), (7, "g", "N" * 9000), (8, "m", ("AC\r\n" * 9 + gap) * 300), (None, "q", "A" * 4001),
    ]
    df = spark.createDataFrame(rows, "scaffold_id long, name string, seq string").withColumn("piece", F.lit("clash")).withColumn("total", F.lit(0))
    for rule in ("fixed", "free"):
        got = splitting.split(df, rule, text=True).where("scaffold_id IS NOT NULL").collect()
        by = {}
        for r in got:
            by.setdefault(r.scaffold_id, []).append(r)
        assert set(by) == {1, 3, 6, 7, 8}
        for sid, pieces in by.items():
            pieces.sort(key=lambda r: r.piece_no)
            seq = plain(next(s for i, _, s in rows if i == sid))
            assert [r.piece_no for r in pieces] == list(range(1, len(pieces) + 1))
            assert all(r.piece_end - r.piece_start <= 4000 and r.seq == seq[r.piece_start : r.piece_end] for r in pieces)
            assert pieces[0].piece_start == 0 and pieces[-1].piece_end == len(seq)
            assert all(b.piece_start == a.piece_end - 150 for a, b in zip(pieces, pieces[1:]))
            if rule == "fixed":
                assert [(r.piece_start, r.piece_end) for r in pieces] == brute_cuts(seq)
    assert {r.name for r in got if r.scaffold_id == 6 and r.piece_no == 2} == {"z:::fragment_2"}
    assert splitting.split(df.limit(0)).collect() == []


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_ngrams(spark, sigma):
    rnd = random.Random(sigma)
    records = [(k % 40 if k % 41 else None, [rnd.choice([1, 1, 1, 2, 3, None]) for _ in range(rnd.randrange(9))]) for k in range(120)] + [(7, None), (8, [])]
    want = {}
    for rec, terms in records:
        for i in range(len(terms or [])):
            for n in range(1, sigma + 1):
                gram = tuple(terms[i : i + n])
                if len(gram) == n and None not in gram:
                    c, s = want.setdefault(gram, [0, set()])
                    want[gram][0] += 1
                    s.add(rec)
    df = spark.createDataFrame(records, "record long, terms array<long>").withColumn("t1", F.lit("clash"))
    got = frequency.count_ngrams(frequency.suffixes(df, "record", "terms", sigma), sigma).collect()
    assert {tuple(x for x in r[:sigma] if x is not None): (r.n, r.n_records) for r in got} == {g: (c, len(s)) for g, (c, s) in want.items()}
    assert len(got) == len(want)
    assert frequency.count_ngrams(frequency.suffixes(df.limit(0), "record", "terms", sigma), sigma).collect() == []


@pytest.mark.parametrize("sigma", [1, 2, 4])
def test_suffixes_of_rows_across_stretches(spark, monkeypatch, sigma):
    monkeypatch.setattr(frequency, "STRETCH", 8)
    rnd = random.Random(sigma)
    lists = {rec: {p: rnd.randrange(3) for p in rnd.sample(range(90), rnd.choice([1, 2, 9, 40]))} for rec in range(12)}
    rows = [(rec, p, t) for rec, d in lists.items() for p, t in d.items()] + [(None, 1, 1), (1, None, 1), (2, 95, None)]
    got = frequency.row_suffixes(spark.createDataFrame(rows, "r long, p int, t long").withColumn("_h", F.lit("clash")), "r", "p", "t", sigma).collect()
    want = []
    for rec, d in lists.items():
        terms = [d[p] for p in sorted(d)]
        want += [(*(terms + [None] * sigma)[i : i + sigma], rec) for i in range(len(terms))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_key_frequency_marks(spark):
    rows = [(0, 1, k) for k in range(257)] + [(1, 1, k + 300) for k in range(256)] + [(2, 5, 1), (2, 6, 1), (2, 6, 1), (None, 5, 2), (-4, 5, 3), (3, 0, 4), (3, 5, None)]
    got = frequency.key_frequency(spark.createDataFrame(rows, "hash_key long, contig_id long, pos_offset int")).collect()
    assert {tuple(r) for r in got} == {(0, 257, 1, "common"), (1, 256, 1, "rare"), (2, 2, 2, None)}
