"""Named queries that combine the operators: allele-aware and ungapped mapping, figures of alleles and pieces, word sets of reads and contigs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom import queries_assembly as qa
from strandloom.functions.codes import canonical_code, coded_words, word_text
from strandloom.functions.seq import wrapped
from strandloom.operators import assembly, graph, layout, mapping, nodes, pruning, stats, words
from strandloom.plans.shared import cut
from strandloom.queries_assembly import CONFLICTS, CONTIGS, LIFT, PARTS, RC, READS, VOTES, contigs_of, edges_of, query, reads_of
from strandloom.queries_graph import ALLELES, alleles_of, conflicts_of
from strandloom.queries_records import ONCE, _local
from strandloom.sources.tables import fanned, table

WORD_ROWS = lambda source, k: f"(SELECT substr(bases, i, {k}) AS w FROM (SELECT bases, unnest(range(1, length(bases) - {k - 2})) AS i FROM {source}))"
CANON = lambda w: f"least({w}, {RC(w)})"


@query(f"WITH {CONFLICTS}, pr3 AS (SELECT DISTINCT dst1 AS a, dst2 AS b FROM x), bo3 AS (SELECT a, b FROM pr3 UNION ALL SELECT b, a FROM pr3), o3 AS (SELECT a, min(b) AS b FROM bo3 GROUP BY 1 HAVING count(*) = 1) SELECT x.a, x.b FROM o3 x JOIN o3 y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def unique_conflicts(spark, d):
    return pruning.unique_conflicts(conflicts_of(spark, d))


@query(f"""WITH {VOTES}, {CONTIGS}, {ALLELES}, rp AS (SELECT contig_id, min(partner) FILTER (WHERE NOT is_primary) AS rep FROM al GROUP BY 1), vr AS (SELECT v.*, coalesce(rep, abs(signed_id)) AS rep FROM v LEFT JOIN rp ON abs(signed_id) = contig_id), tp AS (SELECT *, max(votes) OVER (PARTITION BY lib_no, pair_id, mate) AS best FROM vr),
    us AS (SELECT lib_no, pair_id, mate FROM tp WHERE votes = best GROUP BY 1, 2, 3 HAVING count(DISTINCT rep) = 1), rk AS (SELECT tp.*, row_number() OVER (PARTITION BY lib_no, pair_id, mate ORDER BY CASE WHEN abs(signed_id) = rep THEN 0 ELSE 1 END, signed_id, diagonal) AS rn, count(*) OVER (PARTITION BY lib_no, pair_id, mate, signed_id) AS same FROM tp SEMI JOIN us USING (lib_no, pair_id, mate) WHERE votes = best)
    SELECT lib_no, pair_id, mate, votes, signed_id, diagonal, rep FROM rk WHERE rn = 1 AND same = 1""")
def mapped_reads_with_alleles(spark, d):
    return mapping.map_reads_with_alleles(qa.votes_of(spark, d), alleles_of(spark, d))


@query(f"""WITH {VOTES}, {CONTIGS}, pl3 AS (SELECT lib_no, pair_id, mate, signed_id, diagonal, CASE WHEN signed_id < 0 THEN {RC('r.bases')} ELSE r.bases END AS t, c.bases AS b, len FROM v JOIN r USING (lib_no, pair_id, mate) JOIN c ON abs(signed_id) = contig_id),
    cu AS (SELECT lib_no, pair_id, mate, signed_id, diagonal, substr(t, greatest(diagonal, 0) - diagonal + 1, least(diagonal + length(t), len) - greatest(diagonal, 0)) AS x, substr(b, greatest(diagonal, 0) + 1, least(diagonal + length(t), len) - greatest(diagonal, 0)) AS y FROM pl3),
    ms AS (SELECT lib_no, pair_id, mate, signed_id, diagonal, length(replace(x, 'N', '')) AS n_clean, len(list_filter(range(1, length(x) + 1), lambda i: x[i] = y[i] AND x[i] <> 'N')) AS n_same FROM cu), gd AS (SELECT * FROM ms WHERE n_clean > 0 AND n_same >= 0.9 * n_clean),
    bs AS (SELECT *, max(n_same) OVER (PARTITION BY lib_no, pair_id, mate) AS best FROM gd), un AS (SELECT *, count(*) OVER (PARTITION BY lib_no, pair_id, mate) AS ties FROM bs WHERE n_same = best) SELECT lib_no, pair_id, mate, signed_id, diagonal, CAST(n_clean AS BIGINT) AS n_clean, CAST(n_same AS BIGINT) AS n_same FROM un WHERE ties = 1""")
def ungapped_reads(spark, d):
    return mapping.ungapped(qa.votes_of(spark, d), reads_of(spark, d), contigs_of(spark, d))


@query(f"WITH {CONTIGS} SELECT kind, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM c WHERE len > 0 GROUP BY 1")
def contig_kinds(spark, d):
    return contigs_of(spark, d).where("len > 0").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))


@query(f"WITH {CONTIGS}, {ALLELES}, o AS (SELECT len, row_number() OVER (ORDER BY len) AS r, count(*) OVER () AS n FROM c WHERE contig_id IN (SELECT contig_id FROM al)), q AS (SELECT * FROM (VALUES (CAST(0.25 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.75 AS DOUBLE))) AS t(p)) SELECT p, min(len) AS len FROM o, q WHERE r >= greatest(ceil(p * n), 1) GROUP BY 1")
def allele_length_quartiles(spark, d):
    rows = contigs_of(spark, d).join(alleles_of(spark, d).select("contig_id").distinct(), "contig_id", "left_semi")
    return stats.length_quantiles(rows, (0.25, 0.5, 0.75))


@query(f"""WITH {PARTS}, {CONTIGS}, i AS (SELECT *, 1 + sum(CASE WHEN gap > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref ROWS UNBOUNDED PRECEDING) AS piece_no FROM p)
    SELECT scaffold_id, CAST(piece_no AS BIGINT) AS piece_no, CAST(sum(len) AS BIGINT) AS bases, round(sum(len * cov) / nullif(sum(len), 0), 6) AS coverage FROM i JOIN c USING (contig_id) GROUP BY 1, 2""")
def piece_coverage(spark, d):
    return layout.piece_coverage(qa.parts_of(spark, d), contigs_of(spark, d))


@query(f"WITH {LIFT} SELECT lib_no, high - low + 1 AS value, count(*) AS n FROM li GROUP BY 1, 2")
def scaffold_insert_histogram(spark, d):
    return stats.histogram(qa.lifted_pairs(spark, d).withColumn("insert_len", F.col("high") - F.col("low") + 1), "insert_len", "lib_no")


@query(f"WITH {CONTIGS}, k2 AS (SELECT {CANON('w')} AS kmer, sum(cov) AS n FROM (SELECT substr(bases, i, 21) AS w, cov FROM (SELECT bases, cov, unnest(range(1, length(bases) - 19)) AS i FROM c)) WHERE NOT contains(w, 'N') GROUP BY 1) SELECT CAST(least(n, 65534) AS BIGINT) AS value, count(*) AS n FROM k2 GROUP BY 1")
def contig_word_histogram(spark, d):
    w = coded_words(fanned(contigs_of(spark, d).select("cov", "bases")), ["cov"], 21)
    n = w.groupBy(canonical_code(F.col("code"), 21).alias("code")).agg(F.least(F.sum("cov"), F.lit(words.MOST)).cast("bigint").alias("n"))
    return words.occurrence_histogram(n)


@query(f"WITH {READS}, {CONTIGS}, rk AS (SELECT {CANON('w')} AS kmer, count(*) AS n FROM {WORD_ROWS('r', 21)} WHERE regexp_full_match(w, '[ACGT]+') GROUP BY 1), ck AS (SELECT DISTINCT {CANON('w')} AS kmer FROM {WORD_ROWS('c', 21)} WHERE regexp_full_match(w, '[ACGT]+')) SELECT kmer, CAST(least(n, 65534) AS BIGINT) AS n FROM rk ANTI JOIN ck USING (kmer) WHERE n >= 2")
def words_of_no_contig(spark, d):
    own = coded_words(fanned(contigs_of(spark, d).select("bases")), [], 21).select(canonical_code(F.col("code"), 21).alias("code")).distinct()
    left = words.word_counts(reads_of(spark, d), least=2).join(own, "code", "left_anti")
    return left.select(word_text(F.col("code"), 21).alias("kmer"), "n")


@query(f"""WITH {READS}, {CONTIGS}, en3 AS (SELECT DISTINCT {CANON('w')} AS kmer FROM (SELECT bases[:31] AS w FROM c WHERE len >= 31 UNION ALL SELECT bases[-31:] FROM c WHERE len >= 31) WHERE regexp_full_match(w, '[ACGT]+')), rw AS (SELECT lib_no, pair_id, mate, substr(bases, i, 31) AS w FROM (SELECT *, unnest(range(1, length(bases) - 29)) AS i FROM r))
    SELECT lib_no, pair_id, mate, count(*) AS n FROM rw WHERE regexp_full_match(w, '[ACGT]+') AND {CANON('w')} IN (SELECT kmer FROM en3) GROUP BY 1, 2, 3""")
def reads_on_contig_ends(spark, d):
    return words.reads_on_ends(reads_of(spark, d), contigs_of(spark, d))


@query(f"""WITH {LIFT}, {qa.GAPS}, cm AS (SELECT scaffold_id, low // 200 AS i, high // 200 AS j, count(*) AS n FROM li WHERE low >= 0 GROUP BY 1, 2, 3), gb AS (SELECT scaffold_id, unnest(range((gap_start + 199) // 200, gap_end // 200)) AS b FROM g WHERE gap_end // 200 > (gap_start + 199) // 200)
    SELECT scaffold_id, i - (SELECT count(*) FROM gb WHERE gb.scaffold_id = cm.scaffold_id AND b < i) AS i, j - (SELECT count(*) FROM gb WHERE gb.scaffold_id = cm.scaffold_id AND b < j) AS j, n FROM cm WHERE NOT EXISTS (SELECT 1 FROM gb WHERE gb.scaffold_id = cm.scaffold_id AND b IN (i, j))""")
def contact_map_without_gaps(spark, d):
    from strandloom.operators import coverage, evidence

    cells = coverage.contact_map(qa.lifted_pairs(spark, d).where("low >= 0"), 200)
    return evidence.without_gap_bins(cut(cells), cut(layout.gap_table(qa.scaffolds_of(spark, d))), 200)


@query(f"""WITH {CONTIGS}, {ALLELES}, hm AS (SELECT sum(cov * len) / sum(len) AS m FROM c WHERE contig_id IN (SELECT contig_id FROM al)) SELECT contig_id, contig_id IN (SELECT contig_id FROM al) AS has_allele, cov <= 1.25 * m AS low_coverage FROM c, hm WHERE len > 0""")
def hetero_flags(spark, d):
    c, a = contigs_of(spark, d), cut(alleles_of(spark, d).select("contig_id").distinct())
    m = c.join(a, "contig_id", "left_semi").agg((F.sum(F.col("cov") * F.col("len")) / F.sum("len")).alias("m")).scalar()
    return c.where("len > 0").join(a.withColumn("_a", F.lit(True)), "contig_id", "left").select("contig_id", F.coalesce("_a", F.lit(False)).alias("has_allele"), (F.col("cov") <= 1.25 * m).alias("low_coverage"))


@query()
def gap_word_counts(spark, d):
    return assembly.local_word_counts(cut(_local(spark, d)), reads_of(spark, d))


@query(f"""WITH {CONFLICTS}, dg3 AS (SELECT src, direction, count(*) AS n FROM e GROUP BY 1, 2), cf AS (SELECT src, count(*) AS n FROM x GROUP BY 1), mc AS (SELECT sum(cov * len) / sum(len) AS m FROM c WHERE len > 0)
    SELECT contig_id FROM c, mc WHERE cov > 1.5 * m OR contig_id IN (SELECT src FROM cf WHERE n >= 2) OR contig_id IN (SELECT src FROM dg3 WHERE n >= 3)""")
def severe_repeats(spark, d):
    e = edges_of(spark, d)
    return graph.severe_repeats(e, conflicts_of(spark, d, e), contigs_of(spark, d))


def _once(spark, d):
    return nodes.placed_once(qa.parts_of(spark, d))


@query(f"WITH {PARTS}, {ONCE}, {CONTIGS}, {ALLELES} SELECT a.contig_id, partner, o1.scaffold_id, comp_start, comp_end, is_primary FROM al a JOIN o1 ON a.contig_id = o1.contig_id")
def placed_alleles(spark, d):
    return alleles_of(spark, d).join(_once(spark, d).select("contig_id", "scaffold_id", "comp_start", "comp_end"), "contig_id")


# Alleles, sequences and libraries once more.
PAIR_SHARED = "sr AS (SELECT least(abs(id1), abs(id2)) AS a, greatest(abs(id1), abs(id2)) AS b, count(*) AS n FROM q WHERE abs(id1) <> abs(id2) GROUP BY 1, 2)"
PAIR_EVIDENCE2 = f"""{qa.PAIRS}, {CONTIGS}, {PAIR_SHARED}, {ALLELES}, sd AS (SELECT a AS block, a AS contig, 0 AS hp FROM pr UNION ALL SELECT a, b, 1 FROM pr), be AS (SELECT least(u.block, w.block) AS x, greatest(u.block, w.block) AS y, CAST(sum(CASE WHEN u.hp = w.hp THEN n ELSE 0 END) AS BIGINT) AS parallel,
    CAST(sum(CASE WHEN u.hp <> w.hp THEN n ELSE 0 END) AS BIGINT) AS crossed FROM sr JOIN sd u ON sr.a = u.contig JOIN sd w ON sr.b = w.contig AND u.block <> w.block GROUP BY 1, 2)"""


@query(f"WITH {PAIR_EVIDENCE2} SELECT * FROM be")
def pair_block_evidence(spark, d):
    return graph.block_evidence(words.end_partners(contigs_of(spark, d), both=False), mapping.shared_pairs(qa.pairs_of(spark, d)))


@query()
def phased_blocks_all_evidence(spark, d):
    both = qa.block_evidence(spark, d).unionByName(pair_block_evidence(spark, d)).groupBy("x", "y").agg(F.sum("parallel").alias("parallel"), F.sum("crossed").alias("crossed"))
    return graph.phase_blocks(cut(both))


@query()
def contracted_all_libraries(spark, d):
    return nodes.contract(cut(graph.edges(qa.links_of_all_libraries(spark, d))), contigs_of(spark, d))


@query(f"""WITH RECURSIVE cs0 AS ({qa.ORACLE['cross_structures']}) SELECT src, l1 AS "left", CASE WHEN accepted = 'parallel' THEN r1 ELSE r2 END AS "right" FROM cs0 WHERE accepted IS NOT NULL UNION ALL SELECT src, l2, CASE WHEN accepted = 'parallel' THEN r2 ELSE r1 END FROM cs0 WHERE accepted IS NOT NULL""")
def crosses_resolved(spark, d):
    return graph.resolved(qa.cross_structures(spark, d))


@query(f"""WITH {CONTIGS}, {ALLELES}, o AS (SELECT contig_id, max(is_primary) AS p FROM al GROUP BY 1), z AS (SELECT *, CASE WHEN p THEN 'primary_bubble' WHEN NOT p THEN 'secondary_bubble' ELSE 'non_bubble' END AS class FROM c LEFT JOIN o USING (contig_id))
    SELECT class, '>' || class || contig_id || '_len' || len || '_cov' || cov || chr(10) || rtrim(regexp_replace(bases, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM z WHERE bases <> ''""")
def class_fasta(spark, d):
    c = contigs_of(spark, d)
    rows = c.join(pruning.classes(c, alleles_of(spark, d)).select("contig_id", "class"), "contig_id")
    head = F.concat("class", F.col("contig_id").cast("string"), F.lit("_len"), F.col("len").cast("string"), F.lit("_cov"), F.col("cov").cast("string"))
    return rows.where("bases <> ''").select("class", F.concat(F.lit(">"), head, F.lit("\n"), wrapped(F.col("bases"))).alias("value"))


@query(f"WITH RECURSIVE b0 AS ({qa.ORACLE['broken_contigs']}), {CONTIGS} SELECT contig_id, piece_no, substr(bases, piece_start + 1, piece_end - piece_start) AS bases FROM b0 JOIN c USING (contig_id)")
def broken_contig_sequences(spark, d):
    from strandloom.queries_records import broken_contigs

    rows = broken_contigs(spark, d).join(contigs_of(spark, d).select("contig_id", "bases"), "contig_id")
    return rows.select("contig_id", "piece_no", F.expr("substring(bases, cast(piece_start + 1 as int), cast(piece_end - piece_start as int))").alias("bases"))


@query(f"WITH f0 AS ({qa.ORACLE['insert_figures']}) SELECT lib_no, kind, CAST(floor(coalesce(mean, nullif(avg_ins, 0)) + 0.5) AS INT) AS avg_ins, CAST(floor(coalesce(deviation, nullif(sd_ins, 0)) + 0.5) AS INT) AS sd_ins, read_len, mean IS NOT NULL AS is_measured FROM libraries LEFT JOIN f0 USING (lib_no)")
def updated_libraries(spark, d):
    f = qa.insert_figures(spark, d).select("lib_no", "mean", "deviation")
    whole = lambda m, old: F.floor(F.coalesce(m, F.nullif(old, F.lit(0)).cast("double")) + 0.5).cast("int").alias(old)
    return table(spark, d, "libraries").join(f, "lib_no", "left").select("lib_no", "kind", whole("mean", "avg_ins"), whole("deviation", "sd_ins"), "read_len", F.col("mean").isNotNull().alias("is_measured"))


@query(f"WITH n0 AS ({qa.ORACLE['insert_normalised']}), m AS (SELECT lib_no, sum(normalised * value) / sum(normalised) AS m FROM n0 GROUP BY 1) SELECT lib_no, round(max(m), 4) AS mean, round(sqrt(sum(normalised * pow(value - m, 2)) / sum(normalised)), 4) AS deviation FROM n0 JOIN m USING (lib_no) GROUP BY 1")
def insert_figures_normalised(spark, d):
    h = cut(qa.insert_normalised(spark, d))
    m = h.groupBy("lib_no").agg((F.sum(F.col("normalised") * F.col("value")) / F.sum("normalised")).alias("m"))
    sd = F.sqrt(F.sum(F.col("normalised") * F.pow(F.col("value") - F.col("m"), 2)) / F.sum("normalised"))
    return h.join(m, "lib_no").groupBy("lib_no").agg(F.round(F.max("m"), 4).alias("mean"), F.round(sd, 4).alias("deviation"))


@query(f"WITH {qa.ALIGN}, {qa.DEPTH}, {CONTIGS}, lg AS (SELECT name FROM c WHERE name IN (SELECT t_name FROM seg) ORDER BY len DESC, contig_id LIMIT 1) SELECT seg.* FROM seg JOIN lg ON t_name = name")
def longest_contig_depth(spark, d):
    seg = cut(qa.physical_coverage(spark, d))
    named = contigs_of(spark, d).join(seg.select(F.col("t_name").alias("name")).distinct(), "name", "left_semi")
    one = named.orderBy(F.desc("len"), "contig_id").limit(1).select(F.col("name").alias("t_name"))
    return seg.join(F.broadcast(one), "t_name", "left_semi")  # one row


SIGNED = f"{qa.LONG}, tx AS (SELECT contig_id AS id, bases AS t FROM c UNION ALL SELECT -contig_id, {RC('bases')} FROM c)"


@query(f"WITH {SIGNED} SELECT id1, id2, CAST(list_max(list_filter(range(10, 31), lambda k: right(x.t, k) = left(y.t, k) AND NOT contains(left(y.t, k), 'N') AND k <= length(x.t) AND k <= length(y.t))) AS BIGINT) AS overlap FROM gl JOIN tx x ON id1 = x.id JOIN tx y ON id2 = y.id")
def short_overlaps_of_links(spark, d):
    return words.linked_overlaps(graph.group_links(qa.long_links_of(spark, d)), contigs_of(spark, d), 10, 30, 0.0)


@query(f"WITH {SIGNED} SELECT id1, id2, CAST(list_max(list_filter(range(20, 101), lambda k: k <= length(x.t) AND k <= length(y.t) AND hamming(right(x.t, k), left(y.t, k)) <= 0.05 * k AND NOT contains(left(y.t, k), 'N'))) AS BIGINT) AS overlap FROM gl JOIN tx x ON id1 = x.id JOIN tx y ON id2 = y.id WHERE length(x.t) >= 100 AND length(y.t) >= 100")
def similar_overlaps_of_links(spark, d):
    c = contigs_of(spark, d).where("len >= 100")
    return words.linked_overlaps(graph.group_links(qa.long_links_of(spark, d)), c, 20, 100, 0.05)


@query(f"""WITH RECURSIVE o0 AS ({qa.ORACLE['overlap_links']}), {PARTS}, {ONCE}, ed AS (SELECT scaffold_id, contig_ref, row_number() OVER (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref) AS i, row_number() OVER (PARTITION BY scaffold_id ORDER BY part_no DESC, comp_start DESC, comp_end DESC, contig_ref DESC) AS j FROM p),
    en AS (SELECT scaffold_id AS node, contig_ref AS c FROM ed WHERE j = 1 UNION ALL SELECT -scaffold_id, -contig_ref FROM ed WHERE i = 1), st3 AS (SELECT scaffold_id AS node, contig_ref AS c FROM ed WHERE i = 1 UNION ALL SELECT -scaffold_id, -contig_ref FROM ed WHERE j = 1), bo4 AS (SELECT id1, id2, gap FROM o0 UNION ALL SELECT -id2, -id1, gap FROM o0)
    SELECT en.node AS a, st3.node AS b, -gap AS overlap FROM bo4 JOIN en ON id1 = en.c JOIN st3 ON id2 = st3.c WHERE abs(en.node) < abs(st3.node)""")
def scaffold_end_overlaps(spark, d):
    return nodes.end_overlaps(nodes.overlap_links(qa.overlaps_of(spark, d)), qa.parts_of(spark, d))
