"""Named queries of pruning, alleles and scaffold nodes, with their DuckDB statements."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from strandloom import queries_assembly as qa
from strandloom.operators import graph, mapping, nodes, pruning, words
from strandloom.plans.shared import cut
from strandloom.queries_assembly import CONFLICTS, CONTIGS, EDGES, ENDS, LONG, MAPPED, PAIRS, PARTS, RC, READS, contigs_of, edges_of, parts_of, query, reads_of
from strandloom.sources.tables import table


def conflicts_of(spark, d, e=None):
    return cut(graph.conflicts(edges_of(spark, d) if e is None else e, contigs_of(spark, d)))


def library_of(spark, d):
    return cut(pruning.long_library(table(spark, d, "libraries"), reads_of(spark, d), contigs_of(spark, d)))


def rated_of(spark, d):
    return cut(pruning.with_expectation(edges_of(spark, d), contigs_of(spark, d), library_of(spark, d)))


def partners_of(spark, d):
    return words.end_partners(contigs_of(spark, d), both=False)


def alleles_of(spark, d):
    return pruning.alleles(partners_of(spark, d), contigs_of(spark, d))


def _erf(z):
    t = f"(1 / (1 + abs({z}) / 2))"
    p = str(pruning.ERFC[-1])
    for c in reversed(pruning.ERFC[:-1]):
        p = f"({p} * {t} + ({c}))"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {t} * exp(-({z}) * ({z}) + {p}) ELSE {t} * exp(-({z}) * ({z}) + {p}) - 1 END)"


@cache
def _area(x):
    return f"({x} * {_erf('(' + x + ' / (sqrt(2) * sd))')} + sqrt(2) * sd / sqrt(pi()) * exp(-pow({x} / (sqrt(2) * sd), 2)))"


EXPECTED = "(ec / (4 * rl) * (" + " ".join(f"{s} {_area(x)}" for s, x in (("", "(l1 + g + l2)"), ("-", "(rl + g + l2)"), ("-", "(l1 + g + rl)"), ("+", "(rl + g + rl)"))) + "))"
LIBRARY = f"""{READS}, lb AS (SELECT lib_no, avg_ins, sd_ins, read_len AS lib_read, coalesce(b, 0) / (SELECT sum(len) FROM c) AS lib_cov FROM (SELECT * FROM libraries WHERE avg_ins > 0 AND sd_ins > 0 AND read_len > 0 ORDER BY avg_ins DESC, lib_no LIMIT 1) LEFT JOIN
    (SELECT lib_no, sum(length(bases)) AS b FROM r GROUP BY 1) USING (lib_no)), mc AS (SELECT sum(cov * len) / sum(len) AS m FROM c WHERE len > 0)"""
RATED = f"""{CONFLICTS}, {LIBRARY}, e0 AS (SELECT e.*, CAST(x.len AS DOUBLE) AS l1, CAST(y.len AS DOUBLE) AS l2, lib_cov * least(x.cov, y.cov) / m AS ec, CAST(avg_ins AS DOUBLE) AS av, CAST(sd_ins AS DOUBLE) AS sd, CAST(lib_read AS DOUBLE) AS rl
    FROM e JOIN c x ON src = x.contig_id JOIN c y ON dst = y.contig_id, lb, mc), e1 AS (SELECT *, gap - av AS g FROM e0), e2 AS (SELECT *, {EXPECTED} AS ex FROM e1), e3 AS (SELECT * REPLACE (CAST(0 AS DOUBLE) AS g) FROM e2),
    e4 AS (SELECT src, direction, dst, orient, num_link, gap, round(ex, 4) AS expected, round({EXPECTED}, 4) AS typical, round(num_link / greatest(1.0, ex), 6) AS rate FROM e3)"""
GONE = lambda q: f"gn AS ({q}), gone AS (SELECT src, dst FROM gn UNION SELECT dst, src FROM gn)"
LEFT = "SELECT e.* FROM e ANTI JOIN gone USING (src, dst)"
ALLELES = f"""pr AS (SELECT min(contig_id) AS a, max(contig_id) AS b FROM (SELECT contig_id, bases[:31] AS lw FROM c WHERE len >= 31 AND NOT contains(bases[:31], 'N')) GROUP BY lw HAVING count(*) = 2), bo AS (SELECT a AS contig_id, b AS partner FROM pr UNION ALL SELECT b, a FROM pr),
    al AS (SELECT bo.contig_id, partner, (x.cov, x.len, -x.contig_id) > (y.cov, y.len, -y.contig_id) AS is_primary FROM bo JOIN c x ON bo.contig_id = x.contig_id JOIN c y ON partner = y.contig_id)"""


@query(f"WITH {RATED} SELECT * FROM e4")
def expected_links(spark, d):
    return rated_of(spark, d)


@query(f"WITH {RATED} SELECT * FROM e4 WHERE num_link >= floor(floor(typical + 0.5) / 2 + 0.5)")
def thin_edges_by_expectation(spark, d):
    return pruning.drop_thin(rated_of(spark, d))


@query(f"""WITH {RATED}, rt AS (SELECT src, dst, max(rate) AS v FROM e4 GROUP BY 1, 2), {GONE('''SELECT x.src, CASE WHEN n1 < n2 THEN dst1 ELSE dst2 END AS dst FROM x JOIN rt a ON x.src = a.src AND dst1 = a.dst JOIN rt b ON x.src = b.src AND dst2 = b.dst
    WHERE a.v <= 4 AND b.v <= 4 AND ((n1 < n2 AND a.v <= 0.5 * b.v) OR (n2 < n1 AND b.v <= 0.5 * a.v))''')} SELECT e4.* FROM e4 ANTI JOIN gone USING (src, dst)""")
def erroneous_edges_by_expectation(spark, d):
    rated = rated_of(spark, d)
    return pruning.drop_erroneous_by_expectation(rated, conflicts_of(spark, d, rated))


@query(f"""WITH {CONTIGS}, {LIBRARY}, v AS (SELECT lib_no, avg(len) FILTER (WHERE len > 0) AS l1, max(m) AS ec, CAST(max(avg_ins) AS DOUBLE) AS av, CAST(max(sd_ins) AS DOUBLE) AS sd, CAST(max(lib_read) AS DOUBLE) AS rl FROM c, lb, mc GROUP BY 1),
    w AS (SELECT *, l1 AS l2, -2 * rl AS g FROM v) SELECT lib_no, round(greatest(1.0, {EXPECTED}), 4) AS expected FROM w""")
def typical_link_number(spark, d):
    c = contigs_of(spark, d)
    mean, cov = c.where("len > 0").agg(F.avg("len")).scalar(), pruning.mean_coverage(c)
    one = library_of(spark, d).withColumns({"_l": mean, "_c": cov})
    e = pruning.expected(F.col("_c"), F.col("_l"), F.col("_l"), F.col("avg_ins") - 2.0 * F.col("read_len"), F.col("avg_ins"), F.col("sd_ins"), F.col("read_len").cast("double"))
    return one.select("lib_no", F.round(F.greatest(F.lit(1.0), e), 4).alias("expected"))


@query(f"""WITH {EDGES}, {LIBRARY}, z AS (SELECT e.*, x.len AS l1, y.len AS l2, avg_ins AS av, lib_read // 2 AS hr FROM e JOIN c x ON src = x.contig_id JOIN c y ON dst = y.contig_id, lb)
    SELECT src, direction, dst, CAST(least(greatest(0, av - greatest(gap, 0) - hr * 2 + 1), greatest(0, least(l1, l2) + hr + 1), greatest(0, l1 + l2 + gap - av + 1)) AS BIGINT) AS positions FROM z""")
def possible_positions(spark, d):
    c = contigs_of(spark, d).select("contig_id", "len")
    rows = edges_of(spark, d).join(c.select(F.col("contig_id").alias("src"), F.col("len").alias("l1")), "src").join(c.select(F.col("contig_id").alias("dst"), F.col("len").alias("l2")), "dst").crossJoin(F.broadcast(library_of(spark, d)))
    way = pruning.possible_positions(F.col("l1"), F.col("l2"), F.col("gap"), F.col("avg_ins"), F.floor(F.col("read_len") / 2))
    return rows.select("src", "direction", "dst", way.cast("bigint").alias("positions"))


@query(f"""WITH {LONG}, t AS (SELECT id1, id2, count(*) AS num_link, avg(gap) AS m, min(gap) AS lo, max(gap) AS hi, trunc(quantile_cont(gap, 0.5)) AS md FROM ll GROUP BY 1, 2)
    SELECT id1, id2, num_link, CAST(greatest(least(ceil(m - 0.5), least(hi, md + 300)), greatest(lo, md - 300)) AS BIGINT) AS gap FROM t""")
def likely_gaps(spark, d):
    return pruning.likely_gaps(qa.long_links_of(spark, d), 300)


@query(f"""WITH {CONFLICTS}, mc AS (SELECT sum(cov * len) / sum(len) AS m FROM c WHERE len > 0), {GONE('''SELECT src, CASE WHEN p.len < q.len THEN dst1 ELSE dst2 END AS dst FROM x JOIN c s ON src = s.contig_id JOIN c p ON dst1 = p.contig_id JOIN c q ON dst2 = q.contig_id, mc
    WHERE s.cov <= 1.5 * m AND p.cov <= 0.75 * m AND q.cov <= 0.75 * m''')} {LEFT}""")
def hetero_edges_dropped(spark, d):
    e = edges_of(spark, d)
    return pruning.drop_hetero(e, conflicts_of(spark, d, e), contigs_of(spark, d))


@query(f"WITH {EDGES}, mc AS (SELECT sum(cov * len) / sum(len) AS m FROM c WHERE len > 0), k AS (SELECT contig_id FROM c, mc WHERE len >= 500 AND cov BETWEEN 0.1 * m AND 3 * m) SELECT e.* FROM e WHERE src IN (SELECT contig_id FROM k) AND dst IN (SELECT contig_id FROM k)")
def abnormal_coverage_edges_dropped(spark, d):
    c = contigs_of(spark, d)
    m = pruning.mean_coverage(c)
    return pruning.between(edges_of(spark, d), c.where((F.col("len") >= 500) & F.col("cov").between(0.1 * m, 3 * m)))


@query(f"WITH {EDGES} SELECT * FROM e WHERE gap <= 500")
def long_edges_dropped(spark, d):
    return edges_of(spark, d).where("gap <= 500")


@query(f"""WITH {CONFLICTS}, {MAPPED}, t AS (SELECT tag, abs(signed_id) AS contig_id, least(count(*), 254) AS n FROM m JOIN r USING (lib_no, pair_id, mate) WHERE tag IS NOT NULL GROUP BY 1, 2), sc AS (SELECT x.contig_id AS src, y.contig_id AS dst, sum(least(x.n, y.n)) AS v FROM t x JOIN t y ON x.tag = y.tag AND x.contig_id <> y.contig_id GROUP BY 1, 2),
    xv AS (SELECT x.*, coalesce(a.v, 0) AS v1, coalesce(b.v, 0) AS v2 FROM x LEFT JOIN sc a ON x.src = a.src AND dst1 = a.dst LEFT JOIN sc b ON x.src = b.src AND dst2 = b.dst), {GONE('SELECT src, dst1 AS dst FROM xv WHERE v1 < 0.125 * v2 UNION ALL SELECT src, dst2 FROM xv WHERE v2 < 0.125 * v1')} {LEFT}""")
def tag_rate_edges_dropped(spark, d):
    e = edges_of(spark, d)
    return pruning.drop_by_tags(e, conflicts_of(spark, d, e), cut(mapping.common_tags(qa.mapped_of(spark, d), reads_of(spark, d))))


@query(f"""WITH {CONFLICTS}, {PAIRS}, bl AS (SELECT src AS a, dst1 AS b FROM x WHERE n1 <= n2 UNION SELECT src, dst2 FROM x WHERE n2 <= n1), b2 AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM bl) SELECT q.* FROM q WHERE NOT EXISTS (SELECT 1 FROM b2 WHERE a = least(abs(id1), abs(id2)) AND b = greatest(abs(id1), abs(id2)))""")
def pairs_off_weak_edges(spark, d):
    x = conflicts_of(spark, d)
    weak = x.where("n1 <= n2").select("src", F.col("dst1").alias("dst")).unionByName(x.where("n2 <= n1").select("src", F.col("dst2").alias("dst")))
    return mapping.drop_blocked(qa.pairs_of(spark, d), weak.select(F.col("src").alias("id1"), F.col("dst").alias("id2")))


@query(f"WITH {CONTIGS}, {ALLELES} SELECT * FROM al")
def allele_states(spark, d):
    return alleles_of(spark, d)


@query(f"""WITH {CONTIGS}, {ALLELES}, o AS (SELECT contig_id, min(partner) AS partner, max(is_primary) AS p FROM al GROUP BY 1)
    SELECT contig_id, name, len, CASE WHEN p THEN 'primary_bubble' WHEN NOT p THEN 'secondary_bubble' ELSE 'non_bubble' END AS class, partner FROM c LEFT JOIN o USING (contig_id)""")
def contig_classes(spark, d):
    return pruning.classes(contigs_of(spark, d), alleles_of(spark, d))


@query(f"WITH {EDGES}, {ALLELES} SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM al WHERE NOT is_primary AND contig_id IN (src, dst))")
def secondary_edges_dropped(spark, d):
    c = contigs_of(spark, d)
    return pruning.between(edges_of(spark, d), c.join(alleles_of(spark, d).where("NOT is_primary"), "contig_id", "left_anti"))


@query(f"WITH {EDGES}, {ALLELES}, k AS (SELECT contig_id FROM c WHERE len >= 700 OR contig_id IN (SELECT contig_id FROM al)) SELECT e.* FROM e WHERE src IN (SELECT contig_id FROM k) AND dst IN (SELECT contig_id FROM k)")
def short_edges_dropped_keeping_alleles(spark, d):
    c = contigs_of(spark, d)
    keep = c.where("len >= 700").select("contig_id").unionByName(alleles_of(spark, d).select("contig_id"))
    return pruning.between(edges_of(spark, d), keep)


@query(f"WITH {EDGES} SELECT src, direction, min(dst) AS a, max(dst) AS b FROM e GROUP BY 1, 2 HAVING count(*) = 2 AND min(dst) < max(dst)")
def fork_pairs(spark, d):
    return pruning.forks(edges_of(spark, d))


@query(f"""WITH {CONFLICTS}, b AS (SELECT * FROM c WHERE len > 0 AND kind IN ('primary_bubble', 'secondary_bubble')), hm AS (SELECT sum(cov * len) / sum(len) AS m FROM b)
    SELECT DISTINCT dst1 AS a, dst2 AS b FROM x JOIN c p ON dst1 = p.contig_id JOIN c q ON dst2 = q.contig_id, hm WHERE p.cov <= 1.25 * m AND q.cov <= 1.25 * m""")
def conflicting_alleles(spark, d):
    c = contigs_of(spark, d)
    m = c.where("kind IN ('primary_bubble', 'secondary_bubble') AND len > 0").agg((F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("m")).scalar()
    low = c.where(F.col("cov") <= 1.25 * m).select("contig_id")
    x = conflicts_of(spark, d).select(F.col("dst1").alias("src"), F.col("dst2").alias("dst"))
    return pruning.between(x, low).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


@query()
def tips_cut(spark, d):
    return pruning.cut_tips(edges_of(spark, d), contigs_of(spark, d), 2000)


OVERLAPS = f"""sg AS (SELECT contig_id AS id, 1 AS s, bases AS t FROM c UNION ALL SELECT contig_id, -1, {RC('bases')} FROM c), st AS (SELECT id, s, t, ofs, substr(t, ofs, 31) AS w FROM (SELECT *, unnest(range(1, length(t) - 29)) AS ofs FROM sg)),
    rt AS (SELECT *, right(t, 31) AS w FROM sg WHERE length(t) >= 31 AND NOT contains(right(t, 31), 'N')), ov AS (SELECT x.id * x.s AS a, y.id * y.s AS b, CAST(max(y.ofs + 30) AS BIGINT) AS n FROM rt x JOIN st y ON x.w = y.w
    AND ((x.s = 1 AND y.s = 1 AND x.id <> y.id) OR (x.s <> y.s AND x.id < y.id)) AND y.ofs + 30 <= length(x.t) AND right(x.t, y.ofs + 30) = left(y.t, y.ofs + 30) GROUP BY 1, 2),
    ol AS (SELECT CASE WHEN abs(a) > abs(b) THEN -b ELSE a END AS id1, CASE WHEN abs(a) > abs(b) THEN -a ELSE b END AS id2, max(n) AS n FROM ov GROUP BY 1, 2)"""
ALL_EDGES = f"""{LONG}, {OVERLAPS}, gg AS (SELECT id1, id2, coalesce(num_link, 0) AS num_link, CASE WHEN n IS NULL THEN gap ELSE -n END AS gap, n IS NOT NULL AS is_overlap FROM gl FULL JOIN ol USING (id1, id2)),
    ae AS (SELECT abs(id1) AS src, CAST(sign(id1) AS INT) AS direction, abs(id2) AS dst, CAST(sign(id1 * id2) AS INT) AS orient, num_link, gap, is_overlap FROM gg UNION ALL SELECT abs(id2), CAST(-sign(id2) AS INT), abs(id1), CAST(sign(id1 * id2) AS INT), num_link, gap, is_overlap FROM gg)"""


def all_edges_of(spark, d):
    return cut(nodes.edges_with_overlaps(graph.group_links(qa.long_links_of(spark, d)), qa.overlaps_of(spark, d)))


@query(f"WITH {CONTIGS}, {OVERLAPS} SELECT id1, id2, -n AS gap FROM ol")
def overlap_links(spark, d):
    return nodes.overlap_links(qa.overlaps_of(spark, d))


@query(f"WITH {ALL_EDGES} SELECT * FROM ae")
def edges_with_overlaps(spark, d):
    return all_edges_of(spark, d)


@query(f"WITH {ALL_EDGES} SELECT * FROM ae WHERE num_link >= 2 OR is_overlap")
def thin_edges_dropped_keeping_overlaps(spark, d):
    return all_edges_of(spark, d).where("num_link >= 2 OR is_overlap")


@query(f"WITH {ALL_EDGES}, {ALLELES} SELECT ae.* FROM ae WHERE is_overlap OR (src IN (SELECT contig_id FROM al) AND dst IN (SELECT contig_id FROM al))")
def homo_edges_dropped(spark, d):
    e = all_edges_of(spark, d)
    return e.where("is_overlap").unionByName(pruning.between(e.where("NOT is_overlap"), alleles_of(spark, d)))


@query(f"""WITH {ALL_EDGES}, gd AS (SELECT * FROM ae WHERE NOT is_overlap), o2 AS (SELECT a.src, a.direction, b.dst, b.orient * a.orient AS orient, max(a.gap + c.len + b.gap) AS longest, min(a.gap + c.len + b.gap) AS shortest, count(*) AS n FROM ae a JOIN ae b ON a.dst = b.src AND b.direction = a.direction * a.orient
    AND a.is_overlap AND b.is_overlap JOIN c ON a.dst = c.contig_id WHERE a.src <> b.dst GROUP BY 1, 2, 3, 4) SELECT gd.src, gd.direction, gd.dst, gd.num_link, gd.gap AS link_gap, CAST(shortest AS BIGINT) AS path_gap FROM gd JOIN o2 USING (src, direction, dst, orient) WHERE n = 1""")
def unique_overlap_paths(spark, d):
    return nodes.unique_paths(all_edges_of(spark, d), qa.lengths_of(spark, d))


# Scaffolds as nodes.
ONCE = "o1 AS (SELECT * FROM p WHERE contig_id IN (SELECT contig_id FROM p GROUP BY 1 HAVING count(*) = 1)), nl AS (SELECT scaffold_id, max(comp_end) AS n FROM p GROUP BY 1)"
NODE_LINKS = f"""{LONG}, {PARTS}, {ONCE}, sp AS (SELECT contig_id, o1.scaffold_id, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS o, comp_start AS cs, n - comp_end AS ce FROM o1 JOIN nl USING (scaffold_id)),
    k0 AS (SELECT abs(id1) AS contig1, abs(id2) AS contig2, CAST(sign(id1) * x.o AS INT) AS s1, CAST(sign(id2) * y.o AS INT) AS s2, x.scaffold_id AS n1, y.scaffold_id AS n2, gap - CASE WHEN sign(id1) * x.o > 0 THEN x.ce ELSE x.cs END - CASE WHEN sign(id2) * y.o > 0 THEN y.cs ELSE y.ce END AS gap
    FROM ll JOIN sp x ON abs(id1) = x.contig_id JOIN sp y ON abs(id2) = y.contig_id WHERE x.scaffold_id <> y.scaffold_id),
    k1 AS (SELECT CASE WHEN n1 < n2 THEN s1 * n1 ELSE -s2 * n2 END AS id1, CASE WHEN n1 < n2 THEN s2 * n2 ELSE -s1 * n1 END AS id2, CASE WHEN n1 < n2 THEN contig1 ELSE contig2 END AS contig1, CASE WHEN n1 < n2 THEN contig2 ELSE contig1 END AS contig2, CAST(gap AS BIGINT) AS gap FROM k0)"""
NODE_EDGES = f"""{NODE_LINKS}, kg AS (SELECT id1, id2, count(*) AS num_link, CAST(floor(avg(gap) + 0.5) AS BIGINT) AS gap FROM k1 GROUP BY 1, 2), ne AS (SELECT abs(id1) AS src, CAST(sign(id1) AS INT) AS direction, abs(id2) AS dst, CAST(sign(id1 * id2) AS INT) AS orient, num_link, gap FROM kg
    UNION ALL SELECT abs(id2), CAST(-sign(id2) AS INT), abs(id1), CAST(sign(id1 * id2) AS INT), num_link, gap FROM kg)"""
NODE_CONFLICTS = f"""{NODE_EDGES}, nb AS (SELECT abs(id1) AS src, CAST(sign(id1) AS INT) AS direction, abs(id2) AS dst, contig1 AS contig_id, count(*) AS n FROM k1 GROUP BY 1, 2, 3, 4 UNION ALL SELECT abs(id2), CAST(-sign(id2) AS INT), abs(id1), contig2, count(*) FROM k1 GROUP BY 1, 2, 3, 4),
    nx1 AS (SELECT a.src, a.direction, a.dst AS dst1, b.dst AS dst2 FROM ne a JOIN ne b ON a.src = b.src AND a.direction = b.direction AND a.dst < b.dst JOIN nl x ON a.dst = x.scaffold_id JOIN nl y ON b.dst = y.scaffold_id WHERE least(a.gap + x.n, b.gap + y.n) - greatest(a.gap, b.gap) > 32)"""


def node_links_of(spark, d):
    return cut(nodes.lifted_links(qa.long_links_of(spark, d), parts_of(spark, d)))


def node_edges_of(spark, d, links=None):
    return graph.edges(graph.group_links(node_links_of(spark, d) if links is None else links))


@query(f"WITH {NODE_LINKS} SELECT * FROM k1")
def node_links(spark, d):
    return node_links_of(spark, d)


@query(f"WITH {NODE_EDGES} SELECT * FROM ne")
def node_edges(spark, d):
    return node_edges_of(spark, d)


@query(f"WITH {NODE_CONFLICTS} SELECT * FROM nb")
def node_edge_breakdown(spark, d):
    return nodes.breakdown(node_links_of(spark, d))


@query(f"""WITH {NODE_CONFLICTS}, bo AS (SELECT DISTINCT x.src, p.contig_id FROM nx1 x JOIN nb p ON p.src = x.src AND p.direction = x.direction AND p.dst = x.dst1 JOIN nb q ON q.src = x.src AND q.direction = x.direction AND q.dst = x.dst2 AND q.contig_id = p.contig_id),
    lf AS (SELECT src, direction, dst, CAST(sum(n) AS BIGINT) AS num_link FROM nb ANTI JOIN bo USING (src, contig_id) GROUP BY 1, 2, 3) SELECT * FROM lf""")
def repeat_contigs_masked(spark, d):
    links = node_links_of(spark, d)
    lens = nodes.node_lengths(parts_of(spark, d)).withColumnRenamed("scaffold_id", "contig_id")
    return nodes.mask_repeats(nodes.breakdown(links), graph.conflicts(node_edges_of(spark, d, links), lens))


NODE_PARTNERS = f"""{PARTS}, {ONCE}, {CONTIGS}, {ALLELES}, pp AS (SELECT x.scaffold_id, x.part_no, x.comp_start, x.comp_end, x.contig_ref, y.scaffold_id AS other, CASE WHEN x.strand = y.strand THEN 1 ELSE -1 END AS turn, x.comp_end - x.comp_start AS w FROM p x LEFT JOIN (al JOIN o1 y ON partner = y.contig_id) ON al.contig_id = x.contig_id AND y.scaffold_id <> x.scaffold_id),
    ps AS (SELECT scaffold_id, other * turn AS partner, CAST(sum(w) AS BIGINT) AS bases FROM pp WHERE other IS NOT NULL GROUP BY 1, 2), np AS (SELECT scaffold_id, partner, bases FROM (SELECT *, row_number() OVER (PARTITION BY scaffold_id ORDER BY bases DESC, abs(partner), partner DESC) AS rk FROM ps) WHERE rk = 1)"""


def part_partners_of(spark, d):
    return cut(nodes.part_partners(parts_of(spark, d), alleles_of(spark, d)))


@query(f"WITH {NODE_PARTNERS} SELECT * FROM np")
def node_partners(spark, d):
    return nodes.node_partners(part_partners_of(spark, d))


@query(f"WITH {NODE_PARTNERS} SELECT x.scaffold_id, x.partner, (nx.n, -x.scaffold_id) > (ny.n, -abs(x.partner)) AS is_primary FROM np x JOIN np y ON abs(x.partner) = y.scaffold_id AND abs(y.partner) = x.scaffold_id JOIN nl nx ON nx.scaffold_id = x.scaffold_id JOIN nl ny ON ny.scaffold_id = abs(x.partner)")
def node_allele_states(spark, d):
    return nodes.node_states(nodes.node_partners(part_partners_of(spark, d)), nodes.node_lengths(parts_of(spark, d)))


@query(f"""WITH {NODE_PARTNERS}, ch AS (SELECT *, CASE WHEN coalesce(other * turn, 0) <> coalesce(lag(other * turn) OVER w, 0) AND lag(part_no) OVER w IS NOT NULL THEN 1 ELSE 0 END AS nw FROM pp WINDOW w AS (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref)),
    i AS (SELECT *, 1 + sum(nw) OVER (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref ROWS UNBOUNDED PRECEDING) AS piece_no FROM ch) SELECT scaffold_id, CAST(piece_no AS BIGINT) AS piece_no, max(other * turn) AS partner, count(*) AS n_parts, min(comp_start) AS piece_start, max(comp_end) AS piece_end FROM i GROUP BY 1, 2""")
def divided_by_partner(spark, d):
    return nodes.divide_by_partner(part_partners_of(spark, d))


@query(f"""WITH {NODE_PARTNERS}, al2 AS (SELECT pp.*, np.scaffold_id IS NULL AND other IS NOT NULL AS alone FROM pp LEFT JOIN (SELECT scaffold_id FROM np WHERE 2 * bases >= (SELECT n FROM nl WHERE nl.scaffold_id = np.scaffold_id)) np USING (scaffold_id)), ch AS (SELECT *, CASE WHEN alone OR lag(alone) OVER w THEN 1 ELSE 0 END AS nw FROM al2 WINDOW w AS (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref)),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref ROWS UNBOUNDED PRECEDING) AS g FROM ch) SELECT scaffold_id, min(comp_start) AS piece_start, max(comp_end) AS piece_end, count(*) AS n_parts, bool_or(alone) AS is_allele FROM i GROUP BY scaffold_id, g""")
def allele_parts_isolated(spark, d):
    pp = part_partners_of(spark, d)
    return nodes.isolate_alleles(pp, nodes.node_partners(pp), nodes.node_lengths(parts_of(spark, d)))


@query(f"WITH {EDGES}, {PARTS}, {ONCE} SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM o1 x JOIN o1 y ON x.scaffold_id = y.scaffold_id WHERE x.contig_id = src AND y.contig_id = dst)")
def former_parent_edges_dropped(spark, d):
    return nodes.drop_same_parent(edges_of(spark, d), parts_of(spark, d))


@query(f"WITH {MAPPED}, {PARTS}, {ONCE} SELECT scaffold_id, tag, CAST(least(count(*), 254) AS BIGINT) AS n FROM m JOIN r USING (lib_no, pair_id, mate) JOIN o1 ON abs(signed_id) = o1.contig_id WHERE tag IS NOT NULL GROUP BY 1, 2")
def scaffold_tag_counts(spark, d):
    return nodes.tag_counts(qa.mapped_of(spark, d), reads_of(spark, d), parts_of(spark, d))


@query()
def contracted_nodes(spark, d):
    return nodes.contract(edges_of(spark, d), contigs_of(spark, d))
