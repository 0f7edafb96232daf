"""Named queries of records, distributions, depth by kind of evidence, contacts, diploid nodes and gaps, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom import queries_assembly as qa
from strandloom.operators import assembly, coverage, evidence, graph, layout, nodes, pruning, records, words
from strandloom.plans.shared import cut
from strandloom.queries_assembly import CONTIGS, EDGES, INSERTS, RC, READS, contigs_of, edges_of, query, reads_of
from strandloom.queries_graph import ALLELES, NODE_EDGES, NODE_PARTNERS, ONCE, alleles_of, node_edges_of
from strandloom.sources.tables import table

ONE_LINE = "rtrim(regexp_replace(bases, '(.{80})', '\\1' || chr(10), 'g'), chr(10))"


@query(f"WITH {CONTIGS}, t AS (SELECT contig_id, unnest(regexp_extract_all(bases, 'N+|[^N]+')) AS t, generate_subscripts(regexp_extract_all(bases, 'N+|[^N]+'), 1) AS i FROM c), a AS (SELECT *, sum(length(t)) OVER (PARTITION BY contig_id ORDER BY i) - length(t) AS s FROM t) SELECT contig_id, row_number() OVER (PARTITION BY contig_id ORDER BY i) AS piece_no, CAST(s AS BIGINT) AS piece_start, t AS bases FROM a WHERE t[1] <> 'N'")
def clean_pieces(spark, d):
    return records.clean_pieces(contigs_of(spark, d))


@query(f"WITH {CONTIGS}, o AS (SELECT len, row_number() OVER (ORDER BY len) AS r, count(*) OVER () AS n FROM c) SELECT n, len AS median FROM o WHERE r = n // 2 + 1")
def contig_length_median(spark, d):
    return records.median_length(contigs_of(spark, d))


@query(f"WITH {CONTIGS} SELECT name, min(contig_id) AS contig_id, count(*) AS n FROM c WHERE name IS NOT NULL GROUP BY 1")
def name_index(spark, d):
    return records.name_index(contigs_of(spark, d))


@query(f"WITH {READS} SELECT lib_no, pair_id, mate, bases[:40] AS head, bases[41:] AS rest FROM r")
def read_halves(spark, d):
    return records.halves(reads_of(spark, d), 40)


@query(f"WITH {CONTIGS} SELECT '>seq' || contig_id || '_len' || len || '_cov' || cov || '_read100_maxK31' || chr(10) || {ONE_LINE} AS value FROM c WHERE bases <> ''")
def headed_contigs(spark, d):
    return records.headed_fasta(contigs_of(spark, d), 100, 31)


FASTG = f"""{EDGES}, nm2 AS (SELECT contig_id, bases, 'NODE_' || contig_id || '_length_' || length(bases) || '_cov_' || cov AS nm FROM c), ls AS (SELECT src, direction, string_agg(t, ',' ORDER BY t) AS tos FROM (SELECT DISTINCT src, direction, nm || CASE WHEN direction * orient < 0 THEN '''' ELSE '' END AS t FROM e JOIN nm2 ON dst = contig_id) GROUP BY 1, 2)"""


@query(f"WITH {FASTG}, sd AS (SELECT *, 1 AS side FROM nm2 UNION ALL SELECT *, -1 FROM nm2) SELECT '>' || nm || CASE WHEN side < 0 THEN '''' ELSE '' END || coalesce(':' || tos, '') || ';' || chr(10) || CASE WHEN side > 0 THEN bases ELSE {RC('bases')} END AS value FROM sd LEFT JOIN ls ON src = contig_id AND direction = side WHERE bases <> ''")
def fastg_lines(spark, d):
    return records.fastg(contigs_of(spark, d), edges_of(spark, d))


@query(f"""WITH {CONTIGS}, st AS (SELECT contig_id, bases, unnest(range(1, length(bases) - 99)) AS p FROM c WHERE length(bases) > 100 AND NOT contains(bases[:31], 'N'))
    SELECT contig_id, CAST(max(length(bases) - p) AS BIGINT) AS overlap FROM st WHERE substr(bases, p + 1, 31) = bases[:31] AND right(bases, length(bases) - p) = left(bases, length(bases) - p) GROUP BY 1""")
def self_overlaps(spark, d):
    return records.self_overlaps(contigs_of(spark, d))


@query(f"WITH {INSERTS}, f AS (SELECT lib_no, value, CAST(avg_ins AS DOUBLE) AS m, CAST(sd_ins AS DOUBLE) AS s FROM hi JOIN libraries USING (lib_no) WHERE avg_ins > 0 AND sd_ins > 0) SELECT lib_no, value, round(exp(-pow((value - m) / s, 2) / 2) / (s * sqrt(2 * pi())), 9) AS density FROM f")
def insert_density(spark, d):
    lib = table(spark, d, "libraries").where("avg_ins > 0 AND sd_ins > 0").select("lib_no", F.col("avg_ins").cast("double").alias("m"), F.col("sd_ins").cast("double").alias("s"))
    return qa.insert_histogram(spark, d).join(F.broadcast(lib), "lib_no").select("lib_no", "value", F.round(pruning.normal_density(F.col("value"), F.col("m"), F.col("s")), 9).alias("density"))


@query(f"""WITH {INSERTS}, t AS (SELECT *, sum(n) OVER (PARTITION BY lib_no) * 0.05 AS k, sum(n) OVER (PARTITION BY lib_no ORDER BY value) AS u, sum(n) OVER (PARTITION BY lib_no ORDER BY value DESC) AS v FROM hi),
    tq AS (SELECT lib_no, value, round(CAST(greatest(least(n, greatest(u - k, 0)) + least(n, greatest(v - k, 0)) - n, 0) AS DOUBLE), 6) AS n FROM t) SELECT * FROM tq WHERE n > 0""")
def insert_truncated_by_number(spark, d):
    return records.by_number(qa.insert_histogram(spark, d), "lib_no", edge=0.1)


def _clipped(name, source):
    return f"""m{name} AS (SELECT lib_no, floor(sum(n * value) / sum(n) + 0.5) AS m, CASE WHEN sum(n) > 1 THEN floor(sqrt(greatest((sum(n * value * value) - sum(n * value) * sum(n * value) / sum(n)) / (sum(n) - 1), 0)) + 0.5) ELSE 0 END AS s FROM {source} GROUP BY 1),
    {name} AS (SELECT lib_no, value, n FROM {source} JOIN m{name} USING (lib_no) WHERE abs(value - m) <= 2.0 * s)"""


@query(f"WITH {INSERTS}, hd AS (SELECT lib_no, value, CAST(n AS DOUBLE) AS n FROM hi), {_clipped('h1', 'hd')}, {_clipped('h2', 'h1')}, {_clipped('h3', 'h2')} SELECT lib_no, value, CAST(n AS BIGINT) AS n FROM h3")
def insert_truncated_by_deviation(spark, d):
    return records.by_deviation(qa.insert_histogram(spark, d), "lib_no", edge=2.0, rounds=3)


@query(f"""WITH {CONTIGS}, b AS (SELECT * FROM c WHERE len >= 500), m AS (SELECT sum(cov * len) / sum(len) AS m FROM b)
    SELECT count(*) AS n, round(sum(cov * len) / sum(len), 6) AS mean, round(sum(cov * len) FILTER (WHERE cov BETWEEN m / 100 AND m * 100) / sum(len) FILTER (WHERE cov BETWEEN m / 100 AND m * 100), 6) AS bounded_mean FROM b, m""")
def coverage_without_outliers(spark, d):
    rows = contigs_of(spark, d).where("len >= 500")
    first = rows.agg((F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("m")).scalar()
    inner = F.when(F.col("cov").between(first / 100, first * 100), F.col("len"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("cov") * F.col("len")) / F.sum("len"), 6).alias("mean"), F.round(F.sum(F.col("cov") * inner) / F.sum(inner), 6).alias("bounded_mean"))


@query()
def polished_contigs(spark, d):
    pile = words.pile_up(qa.mapped_of(spark, d), reads_of(spark, d), contigs_of(spark, d))
    return records.polished(contigs_of(spark, d), words.masked_positions(pile))


# Depth for and against.
def _depths(one, other, key="contig_id"):
    return f"""ev2 AS (SELECT {key} AS k, p, sum(x) AS x, sum(y) AS y FROM (SELECT {key}, a AS p, 1 AS x, 0 AS y FROM {one} WHERE a < b UNION ALL SELECT {key}, b, -1, 0 FROM {one} WHERE a < b UNION ALL SELECT {key}, a, 0, 1 FROM {other} WHERE a < b UNION ALL SELECT {key}, b, 0, -1 FROM {other} WHERE a < b) GROUP BY 1, 2 HAVING sum(x) <> 0 OR sum(y) <> 0),
    sg2 AS (SELECT * FROM (SELECT k AS {key}, p AS seg_start, lead(p) OVER w AS seg_end, CAST(sum(x) OVER w AS BIGINT) AS depth, CAST(sum(y) OVER w AS BIGINT) AS against FROM ev2 WINDOW w AS (PARTITION BY k ORDER BY p)) WHERE depth > 0 OR against > 0)"""


PAIR_EVIDENCE = f"""{qa.PAIRS}, {CONTIGS}, pc AS (SELECT abs(id1) AS contig_id, least(place1, place2) AS a, greatest(place1, place2) + 1 AS b FROM q JOIN libraries l ON q.lib_no = l.lib_no WHERE id1 = -id2 AND avg_ins > 0 AND sd_ins > 0 AND abs(abs(place1 - place2) + 1 - avg_ins) <= 3.0 * sd_ins),
    dq AS (SELECT id1, id2, place1, place2, avg_ins AS ai, l.read_len AS rl, x.len AS l1, y.len AS l2 FROM q JOIN libraries l ON q.lib_no = l.lib_no JOIN c x ON abs(id1) = x.contig_id JOIN c y ON abs(id2) = y.contig_id WHERE abs(id1) <> abs(id2) AND avg_ins > 0 AND l.read_len > 0),
    dm AS (SELECT id1 AS id, place1 AS p, l1 AS n, ai, rl FROM dq WHERE l2 >= 500 UNION ALL SELECT id2, place2, l2, ai, rl FROM dq WHERE l1 >= 500),
    pd AS (SELECT abs(id) AS contig_id, CAST(least(greatest(CASE WHEN id > 0 THEN p + rl ELSE p - rl - ai + 1 END, 0), n - 1) AS BIGINT) AS a, CAST(least(greatest(CASE WHEN id > 0 THEN p + rl + ai ELSE p - rl END, 0), n - 1) + 1 AS BIGINT) AS b FROM dm)"""
READ_EVIDENCE = f"""{CONTIGS}, {qa.ALIGN}, nm AS (SELECT name, min(contig_id) AS contig_id FROM c WHERE name IS NOT NULL GROUP BY 1), hc AS (SELECT h.*, contig_id FROM h JOIN nm ON t_name = name), lc AS (SELECT contig_id, t_start AS a, t_end AS b FROM hc),
    ld AS (SELECT * FROM (SELECT contig_id, t_start - least(t_start, CASE WHEN strand = '-' THEN q_len - q_end ELSE q_start END) AS a, t_start AS b FROM hc UNION ALL SELECT contig_id, t_end, t_end + least(t_len - t_end, CASE WHEN strand = '-' THEN q_start ELSE q_len - q_end END) FROM hc) WHERE b - a >= 100)"""
BREAKS = f"""{READ_EVIDENCE}, {_depths('lc', 'ld')}, cs AS (SELECT s.contig_id, len, greatest(seg_start, 50) AS a, least(seg_end, len - 50) AS b, depth, against FROM sg2 s JOIN c USING (contig_id) WHERE len > 100 AND greatest(seg_start, 50) < least(seg_end, len - 50)),
    bd AS (SELECT contig_id, depth, len, sum(b - a) AS m FROM cs WHERE depth > 0 GROUP BY 1, 2, 3), rn AS (SELECT *, sum(m) OVER (PARTITION BY contig_id ORDER BY depth) AS run, len - 100 - sum(m) OVER (PARTITION BY contig_id) AS z FROM bd),
    md AS (SELECT contig_id, min(CASE WHEN z > (len - 100) // 2 THEN 0 ELSE depth END) AS md FROM rn WHERE run + z > (len - 100) // 2 GROUP BY 1), bp AS (SELECT cs.contig_id, a, b FROM cs JOIN md USING (contig_id) WHERE depth < 0.5 * md AND against > 1.0 * depth),
    bn AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY contig_id ORDER BY a) = a THEN 0 ELSE 1 END AS nw FROM bp), bg AS (SELECT *, sum(nw) OVER (PARTITION BY contig_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM bn), br AS (SELECT contig_id, min(a) AS run_start, max(b) AS run_end FROM bg GROUP BY contig_id, g HAVING max(b) - min(a) >= 10)"""


def _pair_depths(spark, d):
    p, lib = cut(qa.pairs_of(spark, d)), table(spark, d, "libraries")
    return evidence.two_depths(evidence.concordant(p, lib), evidence.discordant(p, contigs_of(spark, d), lib), "contig_id")


def _read_breaks(spark, d):
    h, c = qa.hits_of(spark, d), contigs_of(spark, d)
    ids = c.where("name IS NOT NULL").groupBy("name").agg(F.min("contig_id").alias("contig_id"))
    on = h.join(ids, h["t_name"] == ids["name"]).select("contig_id", F.col("t_start").alias("a"), F.col("t_end").alias("b"))
    return evidence.breakpoints(evidence.two_depths(on, evidence.long_discordant(h, c), "contig_id"), c)


@query(f"WITH {PAIR_EVIDENCE}, {_depths('pc', 'pd')} SELECT * FROM sg2")
def pair_depths(spark, d):
    return _pair_depths(spark, d)


@query(f"WITH {READ_EVIDENCE}, {_depths('lc', 'ld')} SELECT * FROM sg2")
def long_read_depths(spark, d):
    h, c = qa.hits_of(spark, d), contigs_of(spark, d)
    ids = c.where("name IS NOT NULL").groupBy("name").agg(F.min("contig_id").alias("contig_id"))
    on = h.join(ids, h["t_name"] == ids["name"]).select("contig_id", F.col("t_start").alias("a"), F.col("t_end").alias("b"))
    return evidence.two_depths(on, evidence.long_discordant(h, c), "contig_id")


@query(f"WITH {BREAKS} SELECT * FROM br")
def evidence_breakpoints(spark, d):
    return _read_breaks(spark, d)


@query(f"WITH {BREAKS}, ct AS (SELECT contig_id, (run_start + run_end) // 2 AS ofs FROM br UNION ALL SELECT contig_id, 0 FROM c WHERE len > 0) SELECT contig_id, row_number() OVER w AS piece_no, CAST(ofs AS BIGINT) AS piece_start, CAST(coalesce(lead(ofs) OVER w, len) AS BIGINT) AS piece_end FROM ct JOIN c USING (contig_id) WINDOW w AS (PARTITION BY contig_id ORDER BY ofs)")
def broken_contigs(spark, d):
    return evidence.broken_pieces(contigs_of(spark, d), _read_breaks(spark, d))


@query(f"WITH {qa.PAIRS}, hb AS (SELECT abs(id1) AS contig_id, least(place1, place2) AS a, greatest(place1, place2) + 1 AS b FROM q WHERE abs(id1) = abs(id2)), nn AS (SELECT contig_id, a, b FROM hb WHERE FALSE), {_depths('hb', 'nn')} SELECT contig_id, seg_start, seg_end, depth FROM sg2")
def contact_depth(spark, d):
    rows = qa.pairs_of(spark, d).where("abs(id1) = abs(id2)").select(F.abs("id1").alias("contig_id"), F.least("place1", "place2").alias("a"), (F.greatest("place1", "place2") + 1).alias("b"))
    return coverage.depth(rows, "contig_id", "a", "b")


@query(f"WITH {qa.LIFT}, {qa.GAPS} SELECT g.scaffold_id, gap_no, gap_start, gap_end, count(pair_id) AS n FROM g LEFT JOIN li ON g.scaffold_id = li.scaffold_id AND low < gap_start AND high >= gap_end GROUP BY 1, 2, 3, 4")
def gaps_spanned_by_pairs(spark, d):
    return evidence.spanning(cut(qa.lifted_pairs(spark, d)), cut(layout.gap_table(qa.scaffolds_of(spark, d))))


READ_LIFT = f"""{CONTIGS}, {qa.ALIGN}, {qa.PARTS}, {ONCE}, nm AS (SELECT name, min(contig_id) AS contig_id FROM c WHERE name IS NOT NULL GROUP BY 1), rl AS (SELECT q_name, o1.scaffold_id, min(CASE WHEN o1.strand = '-' THEN comp_end - t_end ELSE comp_start + t_start END) AS low,
    max(CASE WHEN o1.strand = '-' THEN comp_end - t_start ELSE comp_start + t_end END) AS high FROM h JOIN nm ON t_name = name JOIN o1 USING (contig_id) GROUP BY 1, 2)"""


@query(f"WITH {READ_LIFT}, {qa.GAPS} SELECT g.scaffold_id, gap_no, gap_start, gap_end, count(q_name) AS n FROM g LEFT JOIN rl ON g.scaffold_id = rl.scaffold_id AND low < gap_start AND high >= gap_end GROUP BY 1, 2, 3, 4")
def gaps_spanned_by_long_reads(spark, d):
    lifted = evidence.lifted_reads(qa.hits_of(spark, d), contigs_of(spark, d), qa.parts_of(spark, d))
    return evidence.spanning(cut(lifted), cut(layout.gap_table(qa.scaffolds_of(spark, d))))


JOIN_EVIDENCE = f"""{qa.LONG}, {qa.PARTS}, od AS (SELECT scaffold_id, part_no, contig_id, comp_start, comp_end, row_number() OVER (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref) AS i FROM p), oc AS (SELECT * FROM od WHERE contig_id IN (SELECT contig_id FROM od GROUP BY 1 HAVING count(*) = 1)),
    bt AS (SELECT x.scaffold_id AS s1, x.i AS i1, y.scaffold_id AS s2, y.i AS i2 FROM ll JOIN oc x ON abs(id1) = x.contig_id JOIN oc y ON abs(id2) = y.contig_id), aw AS (SELECT s1 AS s, i1 AS i FROM bt WHERE s1 <> s2 UNION ALL SELECT s2, i2 FROM bt WHERE s1 <> s2),
    je AS (SELECT od.scaffold_id, od.part_no, od.i, (SELECT count(*) FROM bt WHERE s1 = s2 AND s1 = od.scaffold_id AND least(i1, i2) < od.i AND greatest(i1, i2) >= od.i) AS n_spanning, (SELECT count(*) FROM aw WHERE s = od.scaffold_id AND aw.i IN (od.i, od.i - 1)) AS n_erroneous FROM od WHERE od.i > 1)"""


@query(f"WITH {JOIN_EVIDENCE} SELECT * FROM je")
def join_evidence(spark, d):
    return evidence.join_evidence(qa.long_links_of(spark, d), qa.parts_of(spark, d))


@query(f"""WITH {JOIN_EVIDENCE}, n AS (SELECT od.*, 1 + sum(CASE WHEN n_erroneous > n_spanning THEN 1 ELSE 0 END) OVER (PARTITION BY od.scaffold_id ORDER BY od.i) AS piece_no FROM od LEFT JOIN je ON od.scaffold_id = je.scaffold_id AND od.i = je.i)
    SELECT scaffold_id, CAST(piece_no AS BIGINT) AS piece_no, count(*) AS n_parts, min(comp_start) AS piece_start, max(comp_end) AS piece_end FROM n GROUP BY 1, 2""")
def divided_by_evidence(spark, d):
    p = qa.parts_of(spark, d)
    return evidence.divide_by_evidence(evidence.join_evidence(qa.long_links_of(spark, d), p), p)


@query(f"""WITH {qa.LONG}, {qa.PARTS}, {ONCE}, {ALLELES}, l2 AS (SELECT abs(id1) AS c1, abs(id2) AS c2 FROM ll UNION ALL SELECT abs(id2), abs(id1) FROM ll), s2 AS (SELECT x.scaffold_id AS s1, y.scaffold_id AS s2, z.scaffold_id AS sp FROM l2 JOIN o1 x ON c1 = x.contig_id LEFT JOIN o1 y ON c2 = y.contig_id LEFT JOIN (al JOIN o1 z ON partner = z.contig_id) ON al.contig_id = c2)
    SELECT s1 AS scaffold_id, CAST(count(*) FILTER (WHERE s1 = s2) // 2 AS BIGINT) AS n_inside, count(*) FILTER (WHERE sp = s1 AND s2 IS DISTINCT FROM s1) AS n_switch FROM s2 GROUP BY 1""")
def switch_error_links(spark, d):
    return evidence.switch_links(qa.long_links_of(spark, d), qa.parts_of(spark, d), alleles_of(spark, d))


# Contacts.
@query(f"""WITH {qa.PAIRS}, {qa.PARTS}, {ONCE}, z AS (SELECT x.scaffold_id AS s1, y.scaffold_id AS s2, CASE WHEN x.strand = '-' THEN x.comp_end - 1 - place1 ELSE x.comp_start + place1 END AS p1, CASE WHEN y.strand = '-' THEN y.comp_end - 1 - place2 ELSE y.comp_start + place2 END AS p2 FROM q JOIN o1 x ON abs(id1) = x.contig_id JOIN o1 y ON abs(id2) = y.contig_id WHERE x.scaffold_id <> y.scaffold_id)
    SELECT least(s1, s2) AS a, greatest(s1, s2) AS b, CAST(floor(CASE WHEN s1 < s2 THEN p1 ELSE p2 END / 1000) AS BIGINT) AS i, CAST(floor(CASE WHEN s1 < s2 THEN p2 ELSE p1 END / 1000) AS BIGINT) AS j, count(*) AS n FROM z GROUP BY 1, 2, 3, 4""")
def node_contacts(spark, d):
    return evidence.node_contacts(qa.pairs_of(spark, d), qa.parts_of(spark, d))


CELLS = f"{qa.LIFT}, {qa.SCAFFOLDS}, cm AS (SELECT scaffold_id, low // 500 AS i, high // 500 AS j, count(*) AS n FROM li WHERE low >= 0 GROUP BY 1, 2, 3), bi AS (SELECT scaffold_id, CAST((length(bases) + 499) // 500 AS BIGINT) AS nb FROM s WHERE length(bases) > 0)"
SEPARATION = f"""{CELLS}, gr AS (SELECT scaffold_id, unnest(range(4, nb - 3)) AS boundary FROM bi WHERE nb >= 8), gk AS (SELECT * FROM gr, (VALUES (0), (1)) u(up), (VALUES (2), (3)) v(k)), ce AS (SELECT gk.*, o, CASE WHEN up = 0 THEN boundary - 4 + o ELSE boundary - k + o END AS i FROM gk, range(0, 4) r(o) WHERE o < 4),
    cl AS (SELECT ce.scaffold_id, boundary, up, k, ce.i < boundary AND ce.i + k >= boundary AS cr, coalesce(n, 0) AS n FROM ce LEFT JOIN cm ON cm.scaffold_id = ce.scaffold_id AND cm.i = ce.i AND cm.j = ce.i + k), mn AS (SELECT scaffold_id, boundary, up, k, avg(n) FILTER (WHERE NOT cr) AS a, avg(n) FILTER (WHERE cr) AS b, count(*) FILTER (WHERE NOT cr) AS ni, count(*) FILTER (WHERE cr) AS no FROM cl GROUP BY 1, 2, 3, 4),
    lo AS (SELECT cl.scaffold_id, cl.boundary, cl.up, cl.k, count(*) FILTER (WHERE cr AND (cl.n < a OR cl.n = 0)) AS low FROM cl JOIN mn USING (scaffold_id, boundary, up, k) GROUP BY 1, 2, 3, 4), sd AS (SELECT scaffold_id, boundary, up, sum(CASE WHEN a > b THEN ni * no * (a - b) * (a - b) / ((ni + no) * (ni + no)) ELSE 0 END) AS s, sum(CASE WHEN a > 0 THEN ni * no * a * a / ((ni + no) * (ni + no)) ELSE 0 END) AS s0, sum(low) / sum(no) AS t FROM mn JOIN lo USING (scaffold_id, boundary, up, k) GROUP BY 1, 2, 3),
    se AS (SELECT x.scaffold_id, x.boundary, round(CAST(x.s AS DOUBLE), 6) AS s_down, round(CAST(x.s0 AS DOUBLE), 6) AS s0_down, round(CAST(x.t AS DOUBLE), 6) AS t_down, round(CAST(y.s AS DOUBLE), 6) AS s_up, round(CAST(y.s0 AS DOUBLE), 6) AS s0_up, round(CAST(y.t AS DOUBLE), 6) AS t_up, coalesce(x.s / nullif(x.s0, 0), 0) + coalesce(y.s / nullif(y.s0, 0), 0) >= 1.3 AND x.t + y.t >= 1.8 AS evident FROM sd x JOIN sd y ON x.scaffold_id = y.scaffold_id AND x.boundary = y.boundary AND x.up = 0 AND y.up = 1)"""


def _cells(spark, d):
    s = qa.scaffolds_of(spark, d).where("bases <> ''").select("scaffold_id", F.length("bases").cast("bigint").alias("len"))
    return cut(coverage.contact_map(qa.lifted_pairs(spark, d).where("low >= 0"), 500)), s.select("scaffold_id", "len", F.ceil(F.col("len") / 500).cast("bigint").alias("n_bins"))


@query(f"WITH {SEPARATION} SELECT * FROM se")
def contact_separation(spark, d):
    return evidence.separation(*_cells(spark, d))


DEPLETION = f"""{CELLS}, id AS (SELECT distance, n / cells AS mean FROM (SELECT distance, CAST(sum(nb - distance) AS BIGINT) AS cells FROM (SELECT nb, unnest(range(0, nb)) AS distance FROM bi) GROUP BY 1) JOIN (SELECT j - i AS distance, sum(n) AS n FROM cm GROUP BY 1) USING (distance)), id2 AS (SELECT distance AS k, round(mean, 9) AS mean FROM id WHERE distance BETWEEN 1 AND 4 AND round(mean, 9) > 0),
    gb AS (SELECT scaffold_id, unnest(range(1, nb)) AS boundary FROM bi WHERE nb >= 2), dp AS (SELECT scaffold_id, boundary, round(sum(CASE WHEN x / k < mean THEN (x / k - mean) * (x / k - mean) / mean ELSE 0 END), 6) AS depletion FROM (SELECT gb.scaffold_id, boundary, k, mean, coalesce((SELECT sum(n) FROM cm WHERE cm.scaffold_id = gb.scaffold_id AND j - i = k AND i < boundary AND j >= boundary), 0) AS x FROM gb, id2) GROUP BY 1, 2)"""


def _depletion(cells, bins):
    return evidence.depletion(cells, coverage.ideal_contact(cells, bins.select("len"), 500), bins)


@query(f"WITH {DEPLETION} SELECT * FROM dp")
def contact_depletion(spark, d):
    return _depletion(*_cells(spark, d))


PEAKS = f"""{DEPLETION}, pr2 AS (SELECT *, lag(depletion) OVER (PARTITION BY scaffold_id ORDER BY boundary) AS pv FROM dp), pn2 AS (SELECT *, lead(depletion) OVER (PARTITION BY scaffold_id ORDER BY boundary) AS nx FROM pr2 WHERE pv IS NULL OR pv <> depletion), pk2 AS (SELECT scaffold_id, boundary, depletion FROM pn2 WHERE depletion > pv AND depletion > nx AND depletion > 0.01)"""


@query(f"WITH {PEAKS} SELECT * FROM pk2")
def contact_change_peaks(spark, d):
    return evidence.signal_peaks(_depletion(*_cells(spark, d)), "scaffold_id", "boundary", "depletion", 0.01)


@query(f"WITH {PEAKS}, {SEPARATION.replace(CELLS + ', ', '')} SELECT scaffold_id, boundary, depletion FROM pk2 JOIN se USING (scaffold_id, boundary) WHERE evident")
def contact_breaks(spark, d):
    cells, bins = _cells(spark, d)
    peaks = evidence.signal_peaks(_depletion(cells, bins), "scaffold_id", "boundary", "depletion", 0.01)
    return peaks.join(evidence.separation(cells, bins).where("evident").select("scaffold_id", "boundary"), ["scaffold_id", "boundary"])


@query(f"WITH {SEPARATION} SELECT p.scaffold_id, part_no, comp_start FROM p JOIN se ON p.scaffold_id = se.scaffold_id AND CAST(floor(comp_start / 500 + 0.5) AS BIGINT) = boundary WHERE before IS NOT NULL AND NOT evident")
def joins_upheld_by_contacts(spark, d):
    at = qa.parts_of(spark, d).where("before IS NOT NULL").select("scaffold_id", "part_no", "comp_start", F.floor(F.col("comp_start") / 500 + 0.5).cast("bigint").alias("boundary"))
    return at.join(evidence.separation(*_cells(spark, d)).where("NOT evident").select("scaffold_id", "boundary"), ["scaffold_id", "boundary"]).select("scaffold_id", "part_no", "comp_start")


@query()
def contact_scaffolds(spark, d):
    return evidence.chromosome_rounds(qa.pairs_of(spark, d), qa.parts_of(spark, d))


# Diploid nodes.
CONSENSUS = f"""{qa.COVER.replace(CONTIGS + ', ', '').replace(qa.PARTS + ', ', '')}, hm AS (SELECT sum(cov * len) / sum(len) AS m FROM c WHERE len > 0 AND kind IN ('primary_bubble', 'secondary_bubble')), ns AS (SELECT x.scaffold_id, x.partner, (nx.n, -x.scaffold_id) > (ny.n, -abs(x.partner)) AS is_primary FROM np x JOIN np y ON abs(x.partner) = y.scaffold_id AND abs(y.partner) = x.scaffold_id JOIN nl nx ON nx.scaffold_id = x.scaffold_id JOIN nl ny ON ny.scaffold_id = abs(x.partner)),
    cp AS (SELECT least(scaffold_id, abs(partner)) AS consensus_id, CASE WHEN is_primary THEN 0 ELSE 1 END AS h, scaffold_id, CAST(CASE WHEN is_primary THEN 1 ELSE sign(partner) END AS INT) AS sign, n AS len FROM nl JOIN ns USING (scaffold_id) UNION ALL
    SELECT scaffold_id, unnest(CASE WHEN coverage IS NULL OR coverage <= 1.75 * m THEN [0] ELSE [0, 1] END), scaffold_id, 1, n FROM nl LEFT JOIN nc USING (scaffold_id), hm WHERE scaffold_id NOT IN (SELECT scaffold_id FROM ns))"""
CONSENSUS_PARTS = f"{NODE_PARTNERS}, {CONSENSUS}"
CONSENSUS_EDGES = f"""{NODE_EDGES}, {NODE_PARTNERS.split(ONCE + ', ')[1].replace(CONTIGS + ', ', '')}, {CONSENSUS}, cz AS (SELECT cp.*, max(len) OVER (PARTITION BY consensus_id) AS size FROM cp), cl AS (SELECT x.consensus_id AS src, direction * x.sign AS direction, y.consensus_id AS dst, orient * x.sign * y.sign AS orient, x.h = y.h AS same, num_link,
    gap - CASE WHEN direction * x.sign > 0 THEN x.size - x.len ELSE 0 END - CASE WHEN direction * orient * y.sign > 0 THEN 0 ELSE y.size - y.len END AS gap FROM ne JOIN cz x ON src = x.scaffold_id JOIN cz y ON dst = y.scaffold_id WHERE x.consensus_id <> y.consensus_id),
    cg AS (SELECT src, CAST(direction AS INT) AS direction, dst, CAST(orient AS INT) AS orient, CAST(sum(CASE WHEN same THEN num_link ELSE 0 END) AS BIGINT) AS parallel, CAST(sum(CASE WHEN same THEN 0 ELSE num_link END) AS BIGINT) AS crossed, CAST(trunc(sum(gap * num_link) / sum(num_link)) AS BIGINT) AS gap FROM cl GROUP BY 1, 2, 3, 4)"""


def consensus_of(spark, d):
    c, p = contigs_of(spark, d), qa.parts_of(spark, d)
    hetero = c.where("len > 0 AND kind IN ('primary_bubble', 'secondary_bubble')").agg(F.sum(F.col("cov") * F.col("len")) / F.sum("len")).first()[0] or 0.0  # one figure
    lens = nodes.node_lengths(p)
    states = nodes.node_states(nodes.node_partners(nodes.part_partners(p, alleles_of(spark, d))), lens)
    return cut(evidence.consensus_parts(lens, layout.node_coverage(p, c), states, hetero))


@query(f"WITH {CONSENSUS_PARTS} SELECT * FROM cp")
def consensus_nodes(spark, d):
    return consensus_of(spark, d)


@query(f"WITH {CONSENSUS_EDGES} SELECT * FROM cg")
def consensus_edges(spark, d):
    return evidence.consensus_edges(node_edges_of(spark, d), consensus_of(spark, d))


@query(f"WITH {CONSENSUS_EDGES}, g1 AS (SELECT * FROM cg WHERE parallel + crossed >= 1), dg AS (SELECT src, direction FROM g1 GROUP BY 1, 2 HAVING count(*) = 1), o3 AS (SELECT g1.* FROM g1 JOIN dg USING (src, direction)) SELECT x.src * x.direction AS id1, x.dst * x.direction * x.orient AS id2, x.parallel + x.crossed AS num_link, x.gap FROM o3 x SEMI JOIN o3 y ON x.src = y.dst AND x.dst = y.src AND y.direction = -x.direction * x.orient AND x.orient = y.orient WHERE x.src < x.dst")
def consensus_joins(spark, d):
    e = cut(evidence.consensus_edges(node_edges_of(spark, d), consensus_of(spark, d)).withColumn("num_link", F.col("parallel") + F.col("crossed")))
    return graph.reciprocal(e)


# Word graphs and gaps.
def _counts(spark, d):
    return cut(words.word_counts(reads_of(spark, d), least=2))


@query()
def unitigs(spark, d):
    return assembly.unitigs(_counts(spark, d))


@query()
def unitig_tips(spark, d):
    return assembly.unitig_tips(cut(assembly.unitigs(_counts(spark, d))))


@query()
def unitig_bubbles(spark, d):
    return assembly.unitig_bubbles(cut(assembly.unitigs(_counts(spark, d))))


@query()
def weak_unitigs(spark, d):
    return assembly.weak_unitigs(assembly.unitigs(_counts(spark, d)), 42, 3.0)


@query()
def cleaned_unitigs(spark, d):
    return assembly.cleaned_unitigs(_counts(spark, d))


FIGURES = f"{READS}, {CONTIGS}, fg AS (SELECT sum(length(bases)) / (SELECT sum(len) FROM c) AS coverage, avg(length(bases)) AS length FROM r)"
STEPS = f"""{FIGURES}, gr AS (SELECT coverage, length, unnest(range(22, 41)) AS large FROM fg), gc AS (SELECT *, unnest([1, 2, 3, 4]) AS cutoff FROM gr), lm AS (SELECT *, coverage * (length - large + 1.0) / length AS lam FROM gc),
    st2 AS (SELECT CAST(large AS INT) AS large, cutoff, round(-2.0 * list_sum(list_transform(range(0, cutoff), lambda i: exp(i * ln(lam) - lgamma(i + 1) - lam))), 9) AS log_p FROM lm)"""


def _steps(spark, d):
    total = contigs_of(spark, d).agg(F.sum("len")).scalar()
    one = reads_of(spark, d).agg((F.sum(F.length("bases")) / F.max(total)).alias("coverage"), F.avg(F.length("bases")).alias("length"))
    return assembly.word_steps(cut(one))


@query(f"WITH {STEPS} SELECT * FROM st2")
def word_length_steps(spark, d):
    return _steps(spark, d)


@query(f"WITH {STEPS}, bd AS (SELECT cutoff, min(large) FILTER (WHERE log_p < ln(1 - 1e-8)) AS bad, max(large) AS top, min(large) AS frst FROM st2 GROUP BY 1) SELECT cutoff, CAST(CASE WHEN bad = frst THEN NULL ELSE coalesce(bad - 1, top) END AS INT) AS largest_k FROM bd")
def largest_word_length(spark, d):
    return assembly.next_words(_steps(spark, d))


VOTES2 = f"""{qa.GAPS}, {READS}, fl AS (SELECT scaffold_id, gap_no, substr(bases, gap_start - 19, 20) AS lw, substr(bases, gap_end + 1, 20) AS rw FROM g JOIN s USING (scaffold_id) WHERE left_flank >= 20 AND right_flank >= 20),
    bo AS (SELECT bases AS t FROM r UNION ALL SELECT {RC('bases')} FROM r), hh AS (SELECT scaffold_id, gap_no, rw, substr(t, ofs + 20) AS rest FROM (SELECT t, unnest(range(1, length(t) - 18)) AS ofs FROM bo) JOIN fl ON substr(t, ofs, 20) = lw),
    vt AS (SELECT scaffold_id, gap_no, substr(rest, 1, strpos(rest, rw) - 1) AS filling, count(*) AS n_reads FROM hh WHERE strpos(rest, rw) > 0 GROUP BY 1, 2, 3)"""
CLOSED = f"""{VOTES2}, tt AS (SELECT scaffold_id, gap_no, sum(n_reads) AS n FROM vt GROUP BY 1, 2), bl AS (SELECT scaffold_id, gap_no, length(filling) AS len, sum(n_reads) AS m FROM vt GROUP BY 1, 2, 3), b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scaffold_id, gap_no ORDER BY m DESC, len) AS rk FROM bl) WHERE rk = 1),
    gd AS (SELECT scaffold_id, gap_no, n, len FROM b1 JOIN tt USING (scaffold_id, gap_no) WHERE n >= 1 AND m >= 0.75 * n), bs AS (SELECT scaffold_id, gap_no, i, substr(filling, i, 1) AS base, sum(n_reads) AS c FROM (SELECT vt.*, unnest(range(1, len + 1)) AS i FROM vt JOIN gd USING (scaffold_id, gap_no) WHERE length(filling) = len) GROUP BY 1, 2, 3, 4),
    tx AS (SELECT scaffold_id, gap_no, string_agg(base, '' ORDER BY i) AS filling FROM (SELECT *, row_number() OVER (PARTITION BY scaffold_id, gap_no, i ORDER BY c DESC, base) AS rk FROM bs) WHERE rk = 1 GROUP BY 1, 2),
    clo AS (SELECT scaffold_id, gap_no, CAST(n AS BIGINT) AS n_reads, CAST(len AS BIGINT) AS length, coalesce(filling, '') AS filling FROM gd LEFT JOIN tx USING (scaffold_id, gap_no))"""


def _closed(spark, d, least=3):
    s = qa.scaffolds_of(spark, d)
    return assembly.closed_gaps(assembly.filling_votes(layout.gap_table(s), s, reads_of(spark, d)), least)


@query(f"WITH {CLOSED} SELECT * FROM clo WHERE n_reads >= 3")
def small_gaps_closed(spark, d):
    return _closed(spark, d)


@query(f"WITH {CLOSED} SELECT * FROM clo")
def gaps_with_any_filling(spark, d):
    return _closed(spark, d, 1)


@query(f"""WITH {CLOSED}, pz AS (SELECT scaffold_id, i, t FROM (SELECT scaffold_id, unnest(regexp_extract_all(bases, 'N+|[^N]+')) AS t, generate_subscripts(regexp_extract_all(bases, 'N+|[^N]+'), 1) AS i FROM s)), nu AS (SELECT *, sum(CASE WHEN t[1] = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY scaffold_id ORDER BY i) AS gap_no FROM pz)
    SELECT nu.scaffold_id, string_agg(CASE WHEN t[1] = 'N' AND clo.filling IS NOT NULL THEN clo.filling ELSE t END, '' ORDER BY i) AS bases FROM nu LEFT JOIN clo ON nu.scaffold_id = clo.scaffold_id AND nu.gap_no = clo.gap_no AND t[1] = 'N' GROUP BY 1""")
def filled_scaffolds(spark, d):
    s = qa.scaffolds_of(spark, d)
    return assembly.filled(s, layout.gap_table(s), _closed(spark, d, 1))


def _local(spark, d):
    s = qa.scaffolds_of(spark, d)
    lens = s.select("scaffold_id", F.length("bases").cast("bigint").alias("len"))
    return assembly.local_reads(qa.mapped_of(spark, d), reads_of(spark, d), qa.parts_of(spark, d), layout.gap_table(s), table(spark, d, "libraries"), lens)


@query(f"""WITH {qa.MAPPED}, {qa.GAPS}, {qa.PARTS}, {ONCE}, mr AS (SELECT m.*, length(bases) AS n FROM m JOIN r USING (lib_no, pair_id, mate)), mt AS (SELECT lib_no, pair_id, 3 - mate AS mate, length(bases) AS mm FROM r),
    ps AS (SELECT lib_no, pair_id, mate, o1.scaffold_id, avg_ins AS ai, 3.0 * sd_ins AS tol, mm, length(s.bases) AS sl, (signed_id > 0) = (o1.strand = '+') AS ahead, CASE WHEN o1.strand = '-' THEN comp_end - 1 - CASE WHEN signed_id > 0 THEN diagonal ELSE diagonal + n - 1 END ELSE comp_start + CASE WHEN signed_id > 0 THEN diagonal ELSE diagonal + n - 1 END END AS ps
    FROM mr JOIN o1 ON abs(signed_id) = o1.contig_id JOIN libraries l USING (lib_no) JOIN s ON s.scaffold_id = o1.scaffold_id JOIN mt USING (lib_no, pair_id, mate) WHERE avg_ins > 0 AND sd_ins > 0),
    sn AS (SELECT scaffold_id, lib_no, pair_id, 3 - mate AS mate, CAST(trunc(greatest(CASE WHEN ahead THEN greatest(ps, ps + ai - tol - mm) ELSE ps - ai - tol END, 0)) AS BIGINT) AS lo, CAST(trunc(least(CASE WHEN ahead THEN ps + ai + tol ELSE least(ps, ps - ai + tol + mm) END, sl)) AS BIGINT) AS hi FROM ps)
    SELECT DISTINCT sn.scaffold_id, gap_no, lib_no, pair_id, CAST(mate AS INT) AS mate FROM sn JOIN g ON sn.scaffold_id = g.scaffold_id AND lo < hi AND lo < gap_end AND hi > gap_start""")
def gap_local_reads(spark, d):
    return _local(spark, d)


@query()
def gaps_assembled(spark, d):
    s = qa.scaffolds_of(spark, d)
    return assembly.assembled_gaps(cut(layout.gap_table(s)), s, cut(_local(spark, d)), reads_of(spark, d), rounds=None)
