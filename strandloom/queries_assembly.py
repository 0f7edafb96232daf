"""Named queries of the assembly operators, each with an equal DuckDB statement where SQL can state it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strandloom.functions.seq import revcomp
from strandloom.operators import coverage, graph, layout, mapping, stats, words
from strandloom.plans.shared import cut
from strandloom.sources import assembly as src
from strandloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("WITH ", "WITH RECURSIVE ", 1) if " kb AS " in sql and "RECURSIVE" not in sql else sql
        return f

    return add


def contigs_of(spark, d):
    return src.contig_set(table(spark, d, "contigs"))


def lengths_of(spark, d):
    return src.contig_lengths(table(spark, d, "contigs"))


def overlaps_of(spark, d):
    rows = table(spark, d, "contigs").where("contig_id IS NOT NULL")
    return words.end_overlaps(src.deliveries(rows), lambda keep: src.contig_set(keep(rows)))


def scaffolds_of(spark, d):
    return src.scaffold_set(table(spark, d, "scaffolds"))


def parts_of(spark, d):
    return layout.placed(src.components(table(spark, d, "scaffold_components")))


def reads_of(spark, d):
    return src.reads(table(spark, d, "read_pairs"))


def hits_of(spark, d):
    return src.alignments(table(spark, d, "paf_hits"))


def votes_of(spark, d):
    return mapping.capped_votes(reads_of(spark, d), table(spark, d, "kmer_index"))


def mapped_of(spark, d):
    return mapping.placed_once(votes_of(spark, d))


def pairs_of(spark, d):
    return mapping.map_pairs(mapped_of(spark, d), reads_of(spark, d))


def long_links_of(spark, d):
    return mapping.long_links(mapping.keep_best_hits(mapping.long_read_filter(hits_of(spark, d))), contigs_of(spark, d))


def edges_of(spark, d):
    return cut(graph.edges(graph.group_links(long_links_of(spark, d))))


P = lambda c: f"upper(regexp_replace(coalesce({c}, ''), '\\s', '', 'g'))"
RC = lambda c: f"reverse(translate({c}, 'ACGT', 'TGCA'))"
NUM = lambda tag: f"coalesce(try_cast(nullif(regexp_extract(name, '{tag}(\\d+)', 1), '') AS INT), 1)"
CONTIGS = f"""c AS (SELECT contig_id, name, bases, CAST(length(bases) AS BIGINT) AS len, least(greatest(coalesce(cov, {NUM('_cov')}), 1), 65535) AS cov,
    {NUM('_read')} AS read_len, {NUM('_maxK')} AS max_k, regexp_extract(name, '^([a-z_]*[a-z])', 1) AS kind FROM (SELECT *, row_number() OVER (PARTITION BY contig_id
    ORDER BY length(bases) DESC, bases, name NULLS LAST, cov NULLS LAST) AS r FROM (SELECT contig_id, name, cov, {P('seq')} AS bases FROM contigs WHERE contig_id IS NOT NULL)) WHERE r = 1)"""
SCAFFOLDS = f"""s AS (SELECT scaffold_id, regexp_extract(name, '^>?(\\S+)', 1) AS name, bases FROM (SELECT *, row_number() OVER (PARTITION BY scaffold_id ORDER BY length(bases) DESC, bases, name NULLS LAST) AS r
    FROM (SELECT scaffold_id, name, {P('seq')} AS bases FROM scaffolds WHERE scaffold_id IS NOT NULL)) WHERE r = 1)"""
GAPS = f"""{SCAFFOLDS}, tok AS (SELECT scaffold_id, unnest(regexp_extract_all(bases, 'N+|[^N]+')) AS t, generate_subscripts(regexp_extract_all(bases, 'N+|[^N]+'), 1) AS i FROM s),
    run AS (SELECT scaffold_id, i, length(t) AS n, t[1] = 'N' AS is_n, coalesce(sum(length(t)) OVER w - length(t), 0) AS gap_start, coalesce(lag(length(t)) OVER w, 0) AS left_flank, coalesce(lead(length(t)) OVER w, 0) AS right_flank
    FROM tok WINDOW w AS (PARTITION BY scaffold_id ORDER BY i)), g AS (SELECT scaffold_id, row_number() OVER (PARTITION BY scaffold_id ORDER BY i) AS gap_no, CAST(gap_start AS BIGINT) AS gap_start,
    CAST(gap_start + n AS BIGINT) AS gap_end, left_flank, right_flank FROM run WHERE is_n)"""
PARTS = """d AS (SELECT DISTINCT * FROM scaffold_components WHERE scaffold_id IS NOT NULL AND contig_ref IS NOT NULL AND comp_start IS NOT NULL AND comp_end IS NOT NULL),
    p AS (SELECT scaffold_id, part_no, contig_ref, abs(contig_ref) AS contig_id, CASE WHEN contig_ref < 0 THEN '-' ELSE '+' END AS strand, comp_start, comp_end,
    comp_start - lag(comp_end) OVER w AS gap, lag(contig_ref) OVER w AS before FROM d WINDOW w AS (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref))"""
READS = f"""r AS (SELECT lib_no, pair_id, mate, min(bases) AS bases, max(tag) AS tag FROM (SELECT lib_no, pair_id, mate, tag, {P('seq')} AS bases FROM read_pairs) WHERE bases <> '' GROUP BY 1, 2, 3)"""
ALIGN = """h AS (SELECT *, match_len / aln_len AS identity, (q_end - q_start) / q_len AS q_share, CAST(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(cg, ''), '(\\d+)I', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS ins,
    CAST(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(cg, ''), '(\\d+)D', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS del, CASE WHEN strand = '-' THEN t_end + q_start ELSE t_start - q_start END AS diagonal
    FROM (SELECT DISTINCT * FROM paf_hits WHERE t_name IS NOT NULL AND t_name <> '*' AND q_name IS NOT NULL AND aln_len > 0 AND q_len > 0))"""
USABLE = "u AS (SELECT contig_id, pos_offset, min(hash_key) AS hash_key FROM kmer_index WHERE hash_key >= 0 AND contig_id <> 0 AND pos_offset IS NOT NULL GROUP BY 1, 2)"
INDEX = f"{USABLE}, ix AS (SELECT * FROM u WHERE hash_key IN (SELECT hash_key FROM u GROUP BY 1 HAVING count(*) <= 256))"
KCODE = "CAST(list_sum(list_transform(range(0, 31), lambda i: CAST(strpos('ACGT', kmer[i + 1]) - 1 AS BIGINT) << (2 * (30 - i)))) AS BIGINT)"
VOTES = f"""{READS}, {INDEX}, b AS (SELECT lib_no, pair_id, mate, 1 AS strand, bases AS b FROM r UNION ALL SELECT lib_no, pair_id, mate, -1, {RC('bases')} FROM r),
    kw AS (SELECT lib_no, pair_id, mate, strand, ofs, substr(b, ofs + 1, 31) AS kmer FROM (SELECT *, unnest(range(0, length(b) - 30)) AS ofs FROM b)), dk AS (SELECT kmer, {KCODE} AS hash_key FROM (SELECT DISTINCT kmer FROM kw WHERE regexp_full_match(kmer, '[ACGT]+'))),
    v AS (SELECT lib_no, pair_id, mate, strand * contig_id AS signed_id, CAST(pos_offset - ofs AS BIGINT) AS diagonal, count(*) AS votes FROM kw JOIN dk USING (kmer) JOIN ix USING (hash_key) GROUP BY 1, 2, 3, 4, 5)"""
MAPPED = f"{VOTES}, m AS (SELECT lib_no, pair_id, mate, votes, min(signed_id) AS signed_id, min(diagonal) AS diagonal FROM (SELECT *, max(votes) OVER (PARTITION BY lib_no, pair_id, mate) AS best FROM v) WHERE votes = best GROUP BY 1, 2, 3, 4 HAVING count(*) = 1)"
PAIRS = f"""{MAPPED}, pl AS (SELECT lib_no, pair_id, mate, signed_id, CASE WHEN signed_id > 0 THEN diagonal ELSE diagonal + length(bases) - 1 END AS place FROM m JOIN r USING (lib_no, pair_id, mate)),
    q AS (SELECT x.lib_no, x.pair_id, x.signed_id AS id1, x.place AS place1, y.signed_id AS id2, y.place AS place2 FROM pl x JOIN pl y ON x.lib_no = y.lib_no AND x.pair_id = y.pair_id AND x.mate = 1 AND y.mate = 2)"""
INSERTS = f"{PAIRS}, ins AS (SELECT lib_no, pair_id, abs(id1) AS contig_id, abs(place1 - place2) + 1 AS insert_len FROM q WHERE id1 = -id2), hi AS (SELECT lib_no, insert_len AS value, count(*) AS n FROM ins GROUP BY 1, 2)"
# The greedy choice of hits walks down each read's hits in their order, with the intervals kept so far.
LONG = f"""{CONTIGS}, {ALIGN}, nm AS (SELECT name, min(contig_id) AS contig_id FROM c WHERE name IS NOT NULL GROUP BY 1),
    oh AS (SELECT *, row_number() OVER (PARTITION BY q_name ORDER BY match_len DESC, q_end - q_start DESC, q_start, t_name, t_start) AS i FROM h WHERE identity >= 0.8 AND (aln_len >= 1000 OR (t_end - t_start) / least(q_len, t_len) >= 0.8)),
    kb AS (SELECT q_name, i, TRUE AS keep, [q_start, q_end] AS kept FROM oh WHERE i = 1 UNION ALL SELECT q_name, i, ok, CASE WHEN ok THEN kept || [q_start, q_end] ELSE kept END FROM (SELECT oh.q_name, oh.i, kept, q_start, q_end,
    len(list_filter(range(1, len(kept), 2), lambda k: least(q_end, kept[k + 1]) - greatest(q_start, kept[k]) > 32)) = 0 AS ok FROM kb JOIN oh ON oh.q_name = kb.q_name AND oh.i = kb.i + 1)),
    lr AS (SELECT q_name, match_len, q_end - q_start AS span, q_start, CASE WHEN strand = '-' THEN -contig_id ELSE contig_id END AS sid, q_start - CASE WHEN strand = '-' THEN t_len - t_end ELSE t_start END AS lo, q_end + CASE WHEN strand = '-' THEN t_start ELSE t_len - t_end END AS hi
    FROM oh SEMI JOIN (SELECT q_name, i FROM kb WHERE keep) USING (q_name, i) JOIN nm ON t_name = name), on2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_name, sid ORDER BY match_len DESC, span DESC, q_start, lo DESC, hi DESC) AS rn FROM lr) WHERE rn = 1),
    nx AS (SELECT x.q_name, CASE WHEN x.hi < y.hi THEN x.sid ELSE y.sid END AS a, CASE WHEN x.hi < y.hi THEN y.sid ELSE x.sid END AS b, CASE WHEN x.lo <= y.lo THEN y.lo - x.hi ELSE x.lo - y.hi END AS gap FROM on2 x JOIN on2 y
    ON x.q_name = y.q_name AND x.sid < y.sid AND abs(x.sid) <> abs(y.sid) AND CASE WHEN x.lo <= y.lo THEN x.hi <= y.hi ELSE y.hi <= x.hi END),
    ll AS (SELECT q_name, CASE WHEN abs(a) > abs(b) THEN -b ELSE a END AS id1, CASE WHEN abs(a) > abs(b) THEN -a ELSE b END AS id2, gap FROM nx),
    gl AS (SELECT id1, id2, count(*) AS num_link, CAST(floor(avg(gap) + 0.5) AS BIGINT) AS gap FROM ll GROUP BY 1, 2)"""
EDGES = f"""{LONG}, e AS (SELECT abs(id1) AS src, CAST(sign(id1) AS INT) AS direction, abs(id2) AS dst, CAST(sign(id1 * id2) AS INT) AS orient, num_link, gap FROM gl
    UNION ALL SELECT abs(id2), CAST(-sign(id2) AS INT), abs(id1), CAST(sign(id1 * id2) AS INT), num_link, gap FROM gl)"""
CONFLICTS = f"""{EDGES}, el AS (SELECT e.*, len FROM e JOIN c ON dst = contig_id), x AS (SELECT a.src, a.direction, a.dst AS dst1, a.num_link AS n1, b.dst AS dst2, b.num_link AS n2,
    least(a.gap + a.len, b.gap + b.len) - greatest(a.gap, b.gap) AS overlap FROM el a JOIN el b ON a.src = b.src AND a.direction = b.direction AND a.dst < b.dst WHERE least(a.gap + a.len, b.gap + b.len) - greatest(a.gap, b.gap) > 32)"""
DEPTH = """ev AS (SELECT t_name, p, sum(d) AS d FROM (SELECT t_name, t_start AS p, 1 AS d FROM h WHERE t_start < t_end UNION ALL SELECT t_name, t_end, -1 FROM h WHERE t_start < t_end) GROUP BY 1, 2 HAVING sum(d) <> 0),
    seg AS (SELECT * FROM (SELECT t_name, p AS seg_start, lead(p) OVER w AS seg_end, CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY t_name ORDER BY p)) WHERE depth > 0)"""
SUMMARY = """su AS (SELECT t_name, CAST(sum(n) AS BIGINT) AS covered, round(sum(n * depth) / sum(n), 6) AS mean_depth, min(depth) FILTER (WHERE run * 2 >= total) AS median_depth FROM
    (SELECT *, sum(n) OVER (PARTITION BY t_name ORDER BY depth) AS run, sum(n) OVER (PARTITION BY t_name) AS total FROM (SELECT t_name, depth, sum(seg_end - seg_start) AS n FROM seg GROUP BY 1, 2)) GROUP BY 1)"""
LIFT = f"""{PAIRS}, {PARTS}, o1 AS (SELECT * FROM p WHERE contig_id IN (SELECT contig_id FROM p GROUP BY 1 HAVING count(*) = 1)),
    lf AS (SELECT lib_no, pair_id, x.scaffold_id, CASE WHEN x.strand = '-' THEN x.comp_end - 1 - place1 ELSE x.comp_start + place1 END AS p1, CASE WHEN y.strand = '-' THEN y.comp_end - 1 - place2 ELSE y.comp_start + place2 END AS p2
    FROM q JOIN o1 x ON abs(id1) = x.contig_id JOIN o1 y ON abs(id2) = y.contig_id AND x.scaffold_id = y.scaffold_id), li AS (SELECT lib_no, pair_id, scaffold_id, least(p1, p2) AS low, greatest(p1, p2) AS high FROM lf)"""
WORDS = f"""{READS}, w AS (SELECT substr(bases, i, 21) AS w FROM (SELECT bases, unnest(range(1, length(bases) - 19)) AS i FROM r)), k AS (SELECT least(w, {RC('w')}) AS kmer, CAST(least(count(*), 65534) AS BIGINT) AS n FROM w WHERE regexp_full_match(w, '[ACGT]+') GROUP BY 1)"""
BOTH = f"{WORDS}, o AS (SELECT kmer FROM k UNION SELECT {RC('kmer')} FROM k), l AS (SELECT x.kmer AS a, y.kmer AS b FROM o x JOIN o y ON x.kmer[2:] = y.kmer[:20])"
ENDS = f"{CONTIGS}, en AS (SELECT contig_id, CASE WHEN NOT contains(bases[:31], 'N') THEN bases[:31] END AS lw, CASE WHEN NOT contains(bases[-31:], 'N') THEN bases[-31:] END AS rw FROM c WHERE len >= 31)"


@query(f"WITH {CONTIGS} SELECT contig_id, name, len, cov, read_len, max_k, kind FROM c")
def contig_set(spark, d):
    return contigs_of(spark, d).drop("bases")


@query(f"WITH {CONTIGS} SELECT '>' || coalesce(name, '') || chr(10) || rtrim(regexp_replace(bases, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM c WHERE bases <> ''")
def fasta_lines(spark, d):
    return src.fasta_lines(contigs_of(spark, d))


@query("SELECT kind, lib_no, count(*) AS n_rows, count(DISTINCT pair_id) AS n_pairs FROM read_pairs JOIN libraries USING (lib_no) GROUP BY 1, 2")
def record_counts(spark, d):
    rows = table(spark, d, "read_pairs").groupBy("lib_no").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("pair_id").alias("n_pairs"))
    return rows.join(F.broadcast(table(spark, d, "libraries").select("lib_no", "kind")), "lib_no").select("kind", "lib_no", "n_rows", "n_pairs")


@query(f"""WITH {READS}, z AS (SELECT r.lib_no, pair_id, mate, r.tag, CASE WHEN kind = 'outward' THEN {RC('bases')} ELSE bases END AS bases FROM r JOIN libraries USING (lib_no))
    SELECT x.lib_no, x.pair_id, x.bases AS first, y.bases AS second, greatest(x.tag, y.tag) AS tag FROM z x JOIN z y ON x.lib_no = y.lib_no AND x.pair_id = y.pair_id AND x.mate = 1 AND y.mate = 2""")
def oriented_pairs(spark, d):
    return src.oriented_pairs(reads_of(spark, d), table(spark, d, "libraries"))


@query(f"WITH {READS} SELECT tag, row_number() OVER (ORDER BY tag) AS tag_no, count(*) AS n_reads FROM r WHERE tag IS NOT NULL GROUP BY 1")
def tag_dictionary(spark, d):
    return src.tag_dictionary(reads_of(spark, d))


@query(f"WITH {ALIGN} SELECT q_name, q_len, q_start, q_end, strand, t_name, t_len, t_start, t_end, match_len, aln_len, mapq, identity, q_share, ins, del, diagonal FROM h")
def paf_alignments(spark, d):
    return hits_of(spark, d)


@query(f"WITH {ALIGN} SELECT q_name, t_name, q_start, t_start, identity FROM h WHERE identity >= 0.8 AND (aln_len >= 1000 OR (t_end - t_start) / least(q_len, t_len) >= 0.8)")
def paf_filtered(spark, d):
    return mapping.long_read_filter(hits_of(spark, d)).select("q_name", "t_name", "q_start", "t_start", "identity")


@query(f"WITH {ALIGN} SELECT round(sum(ins) / sum(q_end - q_start), 9) AS insertion_rate, round(sum(del) / sum(t_end - t_start), 9) AS deletion_rate, round(sum(q_end - q_start) / sum(t_end - t_start), 9) AS stretch, count(*) AS n_hits FROM h")
def paf_rates(spark, d):
    q, t = F.sum(F.col("q_end") - F.col("q_start")), F.sum(F.col("t_end") - F.col("t_start"))
    return hits_of(spark, d).agg(F.round(F.sum("ins") / q, 9).alias("insertion_rate"), F.round(F.sum("del") / t, 9).alias("deletion_rate"), F.round(q / t, 9).alias("stretch"), F.count(F.lit(1)).alias("n_hits"))


@query(f"""WITH {ALIGN}, oh AS (SELECT *, row_number() OVER (PARTITION BY q_name ORDER BY match_len DESC, q_end - q_start DESC, q_start, t_name, t_start) AS i FROM h),
    kb AS (SELECT q_name, i, TRUE AS keep, [q_start, q_end] AS kept FROM oh WHERE i = 1 UNION ALL SELECT q_name, i, ok, CASE WHEN ok THEN kept || [q_start, q_end] ELSE kept END FROM (SELECT oh.q_name, oh.i, kept, q_start, q_end,
    len(list_filter(range(1, len(kept), 2), lambda k: least(q_end, kept[k + 1]) - greatest(q_start, kept[k]) > 32)) = 0 AS ok FROM kb JOIN oh ON oh.q_name = kb.q_name AND oh.i = kb.i + 1))
    SELECT * EXCLUDE (i, cg) FROM oh SEMI JOIN (SELECT q_name, i FROM kb WHERE keep) USING (q_name, i)""")
def paf_best_hits(spark, d):
    return mapping.keep_best_hits(hits_of(spark, d))


@query(f"WITH {GAPS} SELECT * FROM g")
def gap_table(spark, d):
    return layout.gap_table(scaffolds_of(spark, d)).select("scaffold_id", "gap_no", "gap_start", "gap_end", F.col("left_flank").cast("bigint").alias("left_flank"), F.col("right_flank").cast("bigint").alias("right_flank"))


@query(f"""WITH {GAPS}, cut AS (SELECT scaffold_id, gap_no AS i, gap_start + (gap_end - gap_start) // 2 AS ofs FROM g UNION ALL SELECT scaffold_id, 0, 0 FROM s),
    f AS (SELECT scaffold_id, s.name, row_number() OVER w AS fragment_no, ofs AS frag_start, coalesce(lead(ofs) OVER w, length(bases)) AS frag_end FROM cut JOIN s USING (scaffold_id) WINDOW w AS (PARTITION BY scaffold_id ORDER BY i))
    SELECT scaffold_id, name || ':::fragment_' || fragment_no AS fragment, fragment_no, row_number() OVER (ORDER BY scaffold_id, fragment_no) AS record_no, CAST(frag_start AS BIGINT) AS frag_start, CAST(frag_end AS BIGINT) AS frag_end FROM f""")
def review_assembly(spark, d):
    s = scaffolds_of(spark, d)
    return layout.review_fragments(s, layout.gap_table(s))


@query(f"WITH {PARTS} SELECT scaffold_id, part_no, contig_ref, contig_id, strand, comp_start, comp_end, gap, before FROM p")
def scaffold_layout(spark, d):
    return parts_of(spark, d)


@query(f"WITH {PARTS}, {CONTIGS} SELECT scaffold_id, comp_start, comp_end, coalesce(name, CAST(contig_id AS VARCHAR)) AS name, 0 AS score, strand FROM p LEFT JOIN c USING (contig_id)")
def component_bed(spark, d):
    named = contigs_of(spark, d).select("contig_id", "name")
    return parts_of(spark, d).join(named, "contig_id", "left").select("scaffold_id", "comp_start", "comp_end", F.coalesce("name", F.col("contig_id").cast("string")).alias("name"), F.lit(0).alias("score"), "strand")


COVER = f"""{PARTS}, {CONTIGS}, t AS (SELECT contig_id, count(*) AS times FROM p GROUP BY 1), nc AS (SELECT scaffold_id, count(*) AS n_parts, CAST(sum(len) AS BIGINT) AS bases, round(sum(len * cov) / nullif(sum(len), 0), 6) AS coverage,
    round(sum(len * cov) FILTER (WHERE times = 1) / nullif(sum(len) FILTER (WHERE times = 1), 0), 6) AS unique_coverage FROM p JOIN t USING (contig_id) JOIN c USING (contig_id) GROUP BY 1)"""


@query(f"WITH {COVER} SELECT * FROM nc")
def node_coverage(spark, d):
    return layout.node_coverage(parts_of(spark, d), contigs_of(spark, d))


@query(f"WITH {COVER}, a AS (SELECT sum(coverage * bases) / sum(bases) AS m FROM nc) SELECT scaffold_id, coverage, coverage > 1.75 * m AS is_repeat, coverage >= m AS is_homo FROM nc, a")
def repeat_and_homo_flags(spark, d):
    return layout.flag_repeats(node_coverage(spark, d))


@query(f"""WITH {PARTS}, i AS (SELECT *, 1 + sum(CASE WHEN gap > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref ROWS UNBOUNDED PRECEDING) AS piece_no FROM p)
    SELECT scaffold_id, CAST(piece_no AS BIGINT) AS piece_no, count(*) AS n_parts, min(comp_start) AS piece_start, max(comp_end) AS piece_end FROM i GROUP BY 1, 2""")
def divided_at_gaps(spark, d):
    return layout.divide_at_gaps(parts_of(spark, d))


@query(f"""WITH {PARTS}, i AS (SELECT *, lead(gap) OVER w AS nx, lead(contig_ref) OVER w AS af, comp_end - comp_start AS n FROM p WINDOW w AS (PARTITION BY scaffold_id ORDER BY part_no, comp_start, comp_end, contig_ref))
    SELECT scaffold_id, part_no, contig_ref, CASE WHEN before IS NULL AND nx > n THEN 'left' ELSE 'right' END AS side, CASE WHEN before IS NULL AND nx > n THEN nx ELSE gap END AS gap FROM i WHERE (before IS NULL AND nx > n) OR (af IS NULL AND gap > n)""")
def sparse_ends(spark, d):
    return layout.sparse_ends(parts_of(spark, d))


@query(f"""WITH {PARTS}, {CONTIGS}, z AS (SELECT p.*, coalesce(nullif(CASE WHEN strand = '-' THEN {RC('bases')} ELSE bases END, ''), repeat('N', CAST(greatest(comp_end - comp_start, 0) AS INT))) AS sq FROM p LEFT JOIN c USING (contig_id))
    SELECT scaffold_id, string_agg(repeat('N', CAST(greatest(coalesce(gap, 0), 0) AS INT)) || substr(sq, 1 + CAST(greatest(-coalesce(gap, 0), 0) AS INT)), '' ORDER BY part_no, comp_start, comp_end, contig_ref) AS bases FROM z GROUP BY 1""")
def built_scaffolds(spark, d):
    return layout.build_sequences(parts_of(spark, d), contigs_of(spark, d))


@query(f"""WITH {CONTIGS}, t AS (SELECT len, sum(len) OVER (ORDER BY len DESC) AS run, sum(len) OVER () AS total FROM c WHERE len > 0), q AS (SELECT * FROM (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) AS v(share))
    SELECT share, max(len) AS n_len FROM t, q WHERE run >= share * total GROUP BY 1""")
def contig_n_statistics(spark, d):
    return layout.n_statistics(contigs_of(spark, d))


@query(f"WITH {INDEX} SELECT hash_key, count(*) AS n, min(contig_id) AS first_contig FROM ix GROUP BY 1")
def capped_index(spark, d):
    return mapping.capped_index(table(spark, d, "kmer_index")).groupBy("hash_key").agg(F.count(F.lit(1)).alias("n"), F.min("contig_id").alias("first_contig"))


@query(f"""WITH {CONTIGS}, w AS (SELECT contig_id, substr(bases, i, 31) AS kmer FROM (SELECT contig_id, bases, unnest(range(1, length(bases) - 29)) AS i FROM c)), n AS (SELECT kmer, count(*) AS n, count(DISTINCT contig_id) AS nc FROM w WHERE NOT contains(kmer, 'N') GROUP BY 1)
    SELECT least(n, 300) AS occurrences, nc > 1 AS shared, count(*) AS n_keys FROM n GROUP BY 1, 2""")
def contig_index_profile(spark, d):
    ix = mapping.contig_index(contigs_of(spark, d)).groupBy("hash_key", "contig_id").agg(F.count(F.lit(1)).alias("n"))
    per = ix.groupBy("hash_key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("nc"))
    return per.groupBy(F.least("n", F.lit(300)).alias("occurrences"), (F.col("nc") > 1).alias("shared")).agg(F.count(F.lit(1)).alias("n_keys"))


@query(f"WITH {MAPPED} SELECT * FROM m")
def mapped_reads(spark, d):
    return mapped_of(spark, d)


@query(f"WITH {VOTES} SELECT lib_no, pair_id, mate, signed_id, CAST(sum(votes) AS BIGINT) AS votes, CAST(floor(sum(diagonal * votes) / sum(votes) + 0.5) AS BIGINT) AS diagonal FROM v GROUP BY 1, 2, 3, 4")
def multi_reports(spark, d):
    return mapping.multi_reports(votes_of(spark, d))


@query(f"""WITH {VOTES.replace(INDEX, USABLE + ", ix AS (SELECT * FROM u)")}, pl AS (SELECT lib_no, pair_id, mate, signed_id, diagonal, votes, count(*) OVER (PARTITION BY lib_no, pair_id, mate, votes) AS ties, max(votes) OVER (PARTITION BY lib_no, pair_id, mate) AS best FROM v)
    SELECT lib_no, pair_id, mate, votes, signed_id, diagonal FROM pl WHERE votes = best AND ties = 1""")
def mapped_reads_all_seeds(spark, d):
    return mapping.map_reads(mapping.seed_votes(reads_of(spark, d), mapping.capped_index(table(spark, d, "kmer_index"), None), salts=8))


@query(f"WITH {MAPPED} SELECT lib_no, pair_id, mate FROM r ANTI JOIN m USING (lib_no, pair_id, mate)")
def unmapped_reads(spark, d):
    return reads_of(spark, d).join(mapped_of(spark, d), ["lib_no", "pair_id", "mate"], "left_anti").select("lib_no", "pair_id", "mate")


@query(f"WITH {PAIRS} SELECT * FROM q")
def mapped_pairs(spark, d):
    return pairs_of(spark, d)


@query(f"WITH {INSERTS} SELECT * FROM hi")
def insert_histogram(spark, d):
    return stats.histogram(mapping.insert_lengths(pairs_of(spark, d)), "insert_len", "lib_no")


PEAK = f"""{INSERTS}, en AS (SELECT lib_no, min(value) AS lo, max(value) AS hi FROM hi GROUP BY 1), bi AS (SELECT lib_no, unnest(range(lo, hi + 1)) AS value FROM en), de AS (SELECT lib_no, value, coalesce(n, 0) AS n FROM bi LEFT JOIN hi USING (lib_no, value)),
    ma AS (SELECT *, sum(n) OVER (PARTITION BY lib_no ORDER BY value RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS mass FROM de), pk AS (SELECT lib_no, value AS peak, CAST(mass AS BIGINT) AS mass FROM (SELECT *, row_number() OVER (PARTITION BY lib_no ORDER BY mass DESC, value) AS r FROM ma) WHERE r = 1)"""


@query(f"WITH {PEAK} SELECT * FROM pk")
def insert_peak(spark, d):
    return stats.peaks(insert_histogram(spark, d), "lib_no")


@query(f"""WITH {PEAK}, bb AS (SELECT * FROM hi JOIN pk USING (lib_no) WHERE value BETWEEN 0.25 * peak AND 1.75 * peak), mm AS (SELECT lib_no, CAST(sum(n) AS BIGINT) AS rws, sum(n * value) / sum(n) AS m FROM bb GROUP BY 1)
    SELECT lib_no, rws AS rows, round(max(m), 6) AS mean, CASE WHEN rws > 1 THEN round(sqrt(sum(n * pow(value - m, 2)) / (rws - 1)), 6) END AS deviation FROM bb JOIN mm USING (lib_no) GROUP BY 1, 2""")
def insert_figures(spark, d):
    h = insert_histogram(spark, d)
    return stats.bounded_figures(h, stats.peaks(h, "lib_no"), "lib_no")


@query(f"""WITH {INSERTS}, t AS (SELECT *, sum(n) OVER (PARTITION BY lib_no) AS total, sum(n) OVER (PARTITION BY lib_no ORDER BY value) AS lo, sum(n) OVER (PARTITION BY lib_no ORDER BY value DESC) AS up FROM hi)
    SELECT lib_no, value, n FROM t WHERE lo >= 0.05 * total AND up >= 0.05 * total""")
def insert_truncated(spark, d):
    return stats.truncated(insert_histogram(spark, d), "lib_no")


@query(f"""WITH {INSERTS}, {CONTIGS}, pp AS (SELECT value, sum(len + 1 - value) AS places FROM (SELECT DISTINCT value FROM hi) JOIN c ON len >= value AND len > 0 GROUP BY 1),
    f AS (SELECT lib_no, value, n, places, n / places AS f FROM hi JOIN pp USING (value) WHERE places > 0) SELECT lib_no, value, n, CAST(places AS BIGINT) AS places, round(f / sum(f) OVER (PARTITION BY lib_no) * sum(n) OVER (PARTITION BY lib_no), 6) AS normalised FROM f""")
def insert_normalised(spark, d):
    return stats.position_normalised(insert_histogram(spark, d), contigs_of(spark, d), "lib_no")


PLINKS = f"""{PAIRS}, {CONTIGS}, pk AS (SELECT q.*, avg_ins, CASE WHEN id1 > 0 THEN x.len - place1 ELSE place1 + 1 END AS t1, CASE WHEN id2 > 0 THEN y.len - place2 ELSE place2 + 1 END AS t2 FROM q JOIN libraries l ON q.lib_no = l.lib_no AND avg_ins > 0
    JOIN c x ON abs(id1) = x.contig_id JOIN c y ON abs(id2) = y.contig_id WHERE abs(id1) <> abs(id2)),
    pn AS (SELECT lib_no, pair_id, CASE WHEN abs(id1) > abs(id2) THEN id2 ELSE id1 END AS id1, CASE WHEN abs(id1) > abs(id2) THEN -id1 ELSE -id2 END AS id2, CAST(avg_ins - t1 - t2 AS BIGINT) AS gap FROM pk)"""


@query(f"WITH {PLINKS} SELECT * FROM pn")
def pair_links(spark, d):
    return mapping.pair_links(pairs_of(spark, d), contigs_of(spark, d), table(spark, d, "libraries"))


@query(f"WITH {PLINKS} SELECT id1, id2, lib_no, count(*) AS num_link FROM pn GROUP BY 1, 2, 3")
def pair_link_breakdown(spark, d):
    return graph.link_breakdown(pair_links(spark, d), "lib_no")


@query(f"WITH {LONG} SELECT * FROM ll")
def long_read_links(spark, d):
    return long_links_of(spark, d)


@query(f"""WITH {LONG}, {PLINKS.split('c AS (')[0].rstrip().rstrip(',')}, pk AS (SELECT q.*, avg_ins, CASE WHEN id1 > 0 THEN x.len - place1 ELSE place1 + 1 END AS t1, CASE WHEN id2 > 0 THEN y.len - place2 ELSE place2 + 1 END AS t2 FROM q JOIN libraries l ON q.lib_no = l.lib_no AND avg_ins > 0
    JOIN c x ON abs(id1) = x.contig_id JOIN c y ON abs(id2) = y.contig_id WHERE abs(id1) <> abs(id2)), al AS (SELECT id1, id2, gap FROM ll UNION ALL SELECT CASE WHEN abs(id1) > abs(id2) THEN id2 ELSE id1 END, CASE WHEN abs(id1) > abs(id2) THEN -id1 ELSE -id2 END, CAST(avg_ins - t1 - t2 AS BIGINT) FROM pk)
    SELECT id1, id2, count(*) AS num_link, CAST(floor(avg(gap) + 0.5) AS BIGINT) AS gap FROM al GROUP BY 1, 2""")
def links_of_all_libraries(spark, d):
    one = [x.select("id1", "id2", "gap") for x in (long_links_of(spark, d), pair_links(spark, d))]
    return graph.group_links(reduce(lambda a, b: a.unionByName(b), one))


@query(f"WITH {EDGES} SELECT * FROM e")
def link_edges(spark, d):
    return edges_of(spark, d)


@query(f"WITH {EDGES} SELECT src, direction, count(*) AS degree, CAST(sum(num_link) AS BIGINT) AS links FROM e GROUP BY 1, 2")
def side_degrees(spark, d):
    return graph.degrees(edges_of(spark, d))


@query(f"WITH {EDGES} SELECT * FROM e WHERE num_link >= 2")
def thin_edges_dropped(spark, d):
    return edges_of(spark, d).where("num_link >= 2")


@query(f"WITH {EDGES} SELECT e.* FROM e JOIN c x ON src = x.contig_id JOIN c y ON dst = y.contig_id WHERE x.len >= 500 AND y.len >= 500")
def short_node_edges_dropped(spark, d):
    keep = contigs_of(spark, d).where("len >= 500").select("contig_id")
    e = edges_of(spark, d)
    return e.join(keep, e["src"] == keep["contig_id"], "left_semi").join(keep, e["dst"] == keep["contig_id"], "left_semi")


@query(f"WITH {CONFLICTS} SELECT * FROM x")
def edge_conflicts(spark, d):
    return graph.conflicts(edges_of(spark, d), contigs_of(spark, d))


@query(f"""WITH {CONFLICTS}, wk AS (SELECT src, dst1 AS dst FROM x WHERE n1 < 0.125 * n2 UNION SELECT src, dst2 FROM x WHERE n2 < 0.125 * n1), gone AS (SELECT src, dst FROM wk UNION SELECT dst, src FROM wk) SELECT e.* FROM e ANTI JOIN gone USING (src, dst)""")
def erroneous_edges_dropped(spark, d):
    e = edges_of(spark, d)
    return graph.drop_erroneous(e, graph.conflicts(e, contigs_of(spark, d)))


@query(f"""WITH {CONFLICTS}, a AS (SELECT sum(cov * len) / sum(len) AS m FROM c WHERE len > 0), k AS (SELECT src, count(*) AS n FROM x GROUP BY 1)
    SELECT contig_id, cov, cov > 1.5 * m AS high_coverage, coalesce(n, 0) AS n_conflicts FROM c CROSS JOIN a LEFT JOIN k ON contig_id = src WHERE cov > 1.5 * m OR n IS NOT NULL""")
def repeat_nodes(spark, d):
    c = contigs_of(spark, d)
    return graph.repeats(graph.conflicts(edges_of(spark, d), c), c)


RECIP = f"""{EDGES}, dg AS (SELECT src, direction FROM e GROUP BY 1, 2 HAVING count(*) = 1), o1 AS (SELECT e.* FROM e JOIN dg USING (src, direction)),
    rj AS (SELECT x.src * x.direction AS id1, x.dst * x.direction * x.orient AS id2, x.num_link, x.gap FROM o1 x SEMI JOIN o1 y ON x.src = y.dst AND x.dst = y.src AND y.direction = -x.direction * x.orient AND x.orient = y.orient WHERE x.src < x.dst)"""


@query(f"WITH {RECIP} SELECT * FROM rj")
def reciprocal_joins(spark, d):
    return graph.reciprocal(edges_of(spark, d))


@query(f"""WITH RECURSIVE {RECIP}, nd AS (SELECT abs(id1) AS a, abs(id2) AS b FROM rj UNION SELECT abs(id2), abs(id1) FROM rj), rc AS (SELECT a AS node, a AS l FROM nd UNION SELECT rc.node, nd.b FROM rc JOIN nd ON rc.l = nd.a)
    SELECT node, min(l) AS component FROM rc GROUP BY 1""")
def join_components(spark, d):
    return graph.components(reciprocal_joins(spark, d).select(F.abs("id1").alias("a"), F.abs("id2").alias("b")), "a", "b")


@query()
def join_chains(spark, d):
    return graph.chains(reciprocal_joins(spark, d))


@query(f"""WITH {EDGES}, w1 AS (SELECT src, dst, max(num_link) AS w FROM e GROUP BY 1, 2), w2 AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM w1 UNION ALL SELECT a.src, b.dst, least(a.w, b.w) FROM w1 a JOIN w1 b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY 1, 2),
    w3 AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM w2 UNION ALL SELECT a.src, b.dst, least(a.w, b.w) FROM w2 a JOIN w1 b ON a.dst = b.src WHERE a.src <> b.dst) GROUP BY 1, 2) SELECT src, dst, w AS width FROM w3 WHERE src < dst""")
def widest_paths(spark, d):
    return graph.widest_paths(edges_of(spark, d))


@query(f"""WITH {EDGES}, sd AS (SELECT src FROM e GROUP BY 1 HAVING count(DISTINCT direction) = 1), nb AS (SELECT src, max(cov) AS neighbour_cov FROM e SEMI JOIN sd USING (src) JOIN c ON dst = contig_id GROUP BY 1)
    SELECT contig_id, len, cov, neighbour_cov FROM c JOIN nb ON contig_id = src WHERE len <= 2000 AND cov <= 0.5 * neighbour_cov""")
def tip_nodes(spark, d):
    return graph.tips(edges_of(spark, d), contigs_of(spark, d), 2000)


@query(f"""WITH {EDGES}, fk AS (SELECT src, direction, min(dst) AS a, max(dst) AS b FROM e GROUP BY 1, 2 HAVING count(*) = 2 AND min(dst) < max(dst)) SELECT DISTINCT x.src AS entry, x.a, x.b, y.src AS "exit" FROM fk x JOIN fk y ON x.a = y.a AND x.b = y.b AND x.src < y.src""")
def simple_bubbles(spark, d):
    return graph.bubbles(edges_of(spark, d))


SHARED = "on1 AS (SELECT DISTINCT q_name, contig_id FROM h JOIN nm ON t_name = name), sr AS (SELECT x.contig_id AS a, y.contig_id AS b, count(*) AS n FROM on1 x JOIN on1 y ON x.q_name = y.q_name AND x.contig_id < y.contig_id GROUP BY 1, 2)"


@query(f"WITH {LONG}, {SHARED} SELECT * FROM sr")
def shared_long_reads(spark, d):
    return words.shared_reads(hits_of(spark, d), contigs_of(spark, d))


@query(f"""WITH {EDGES}, {SHARED}, ar AS (SELECT src, direction, min(dst) AS lo, max(dst) AS hi FROM e GROUP BY 1, 2 HAVING count(*) = 2 AND min(dst) < max(dst)), ce AS (SELECT l.src, l.lo AS l1, l.hi AS l2, r.lo AS r1, r.hi AS r2 FROM ar l JOIN ar r ON l.src = r.src AND l.direction < 0 AND r.direction > 0),
    ev AS (SELECT a, b, n FROM sr UNION ALL SELECT b, a, n FROM sr), cs AS (SELECT ce.*, coalesce((SELECT sum(n) FROM ev WHERE (a = l1 AND b = r1) OR (a = l2 AND b = r2)), 0) AS pa, coalesce((SELECT sum(n) FROM ev WHERE (a = l1 AND b = r2) OR (a = l2 AND b = r1)), 0) AS cr FROM ce)
    SELECT src, l1, l2, r1, r2, CAST(pa AS BIGINT) AS parallel, CAST(cr AS BIGINT) AS crossed, CASE WHEN greatest(pa, cr) > 0 AND least(pa, cr) <= 0.25 * greatest(pa, cr) THEN CASE WHEN pa > cr THEN 'parallel' ELSE 'crossed' END END AS accepted FROM cs""")
def cross_structures(spark, d):
    return graph.cross_support(edges_of(spark, d), shared_long_reads(spark, d))


@query(f"""WITH {LONG}, {SHARED}, ev AS (SELECT a, b, n FROM sr UNION ALL SELECT b, a, n FROM sr), be AS (SELECT a, b, n FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM ev) WHERE r = 1) SELECT x.a, x.b, x.n FROM be x JOIN be y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""")
def mutual_partners(spark, d):
    return words.mutual_best(shared_long_reads(spark, d))


@query(f"""WITH {MAPPED}, t AS (SELECT tag, abs(signed_id) AS contig_id, least(count(*), 254) AS n FROM m JOIN r USING (lib_no, pair_id, mate) WHERE tag IS NOT NULL GROUP BY 1, 2)
    SELECT x.contig_id AS contig_a, y.contig_id AS contig_b, CAST(sum(least(x.n, y.n)) AS BIGINT) AS score, count(*) AS n_tags FROM t x JOIN t y ON x.tag = y.tag AND x.contig_id < y.contig_id GROUP BY 1, 2""")
def common_tags(spark, d):
    return mapping.common_tags(mapped_of(spark, d), reads_of(spark, d))


@query(f"WITH {MAPPED} SELECT tag, abs(signed_id) AS contig_id, CAST(least(count(*), 254) AS BIGINT) AS n FROM m JOIN r USING (lib_no, pair_id, mate) WHERE tag IS NOT NULL GROUP BY 1, 2")
def tag_counts(spark, d):
    rows = mapped_of(spark, d).join(reads_of(spark, d).where("tag IS NOT NULL").select("lib_no", "pair_id", "mate", "tag"), ["lib_no", "pair_id", "mate"])
    return rows.groupBy("tag", F.abs("signed_id").alias("contig_id")).agg(F.least(F.count(F.lit(1)), F.lit(254)).cast("bigint").alias("n"))


@query(f"WITH {ALIGN}, {DEPTH} SELECT * FROM seg")
def physical_coverage(spark, d):
    return coverage.depth(hits_of(spark, d), "t_name", "t_start", "t_end")


@query(f"WITH {ALIGN}, {DEPTH}, {SUMMARY} SELECT * FROM su")
def coverage_summary(spark, d):
    return coverage.depth_summary(physical_coverage(spark, d), "t_name")


@query(f"WITH {ALIGN}, {DEPTH}, {SUMMARY} SELECT t_name, seg_start, seg_end, depth, median_depth FROM seg JOIN su USING (t_name) WHERE depth < 0.5 * median_depth AND seg_end - seg_start >= 20")
def coverage_breakpoints(spark, d):
    seg = physical_coverage(spark, d)
    return coverage.low_segments(seg, coverage.depth_summary(seg, "t_name"), "t_name")


@query(f"""WITH {ALIGN}, b AS (SELECT *, CASE WHEN t_start > max(t_end) OVER w THEN 1 WHEN max(t_end) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM h WHERE t_start < t_end WINDOW w AS (PARTITION BY t_name ORDER BY t_start, t_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY t_name ORDER BY t_start, t_end ROWS UNBOUNDED PRECEDING) AS g FROM b) SELECT t_name, min(t_start) AS island_start, max(t_end) AS island_end, count(*) AS n FROM i GROUP BY t_name, g""")
def covered_islands(spark, d):
    return coverage.islands(hits_of(spark, d), "t_name", "t_start", "t_end")


@query(f"""WITH {ALIGN}, {DEPTH}, {CONTIGS}, tx AS (SELECT name AS t_name, max(bases) AS bases FROM c WHERE name IS NOT NULL GROUP BY 1), wi AS (SELECT t_name, bases, unnest(range(0, (length(bases) - 1) // 1000 + 1)) AS win FROM tx WHERE bases <> ''), cu AS (SELECT *, unnest(range(seg_start // 1000, (seg_end - 1) // 1000 + 1)) AS win FROM seg),
    ms AS (SELECT t_name, win, sum((least(seg_end, (win + 1) * 1000) - greatest(seg_start, win * 1000)) * depth) AS mass FROM cu GROUP BY 1, 2), nn AS (SELECT t_name, win, length(substr(bases, win * 1000 + 1, 1000)) AS n, length(replace(substr(bases, win * 1000 + 1, 1000), 'N', '')) AS nc FROM wi)
    SELECT t_name, win, round(coalesce(mass, 0) / n, 6) AS depth, round(coalesce(mass, 0) / nullif(nc, 0), 6) AS scaled_depth FROM nn LEFT JOIN ms USING (t_name, win)""")
def gap_compensated_depth(spark, d):
    c = contigs_of(spark, d).where("name IS NOT NULL").groupBy("name").agg(F.max("bases").alias("bases")).withColumnRenamed("name", "t_name")
    return coverage.gap_compensated(physical_coverage(spark, d), c, "t_name")


@query(f"WITH {LIFT} SELECT * FROM li")
def lifted_pairs(spark, d):
    return coverage.lift(pairs_of(spark, d), parts_of(spark, d))


@query(f"WITH {LIFT}, {GAPS} SELECT g.scaffold_id, gap_no, gap_start, gap_end, count(pair_id) AS n_pairs FROM g LEFT JOIN li ON g.scaffold_id = li.scaffold_id AND low < gap_start AND high >= gap_end AND high - low <= 20000 GROUP BY 1, 2, 3, 4")
def spanned_gaps(spark, d):
    return coverage.spanned_gaps(lifted_pairs(spark, d), layout.gap_table(scaffolds_of(spark, d)))


@query(f"WITH {LIFT} SELECT scaffold_id, low // 1000 AS i, high // 1000 AS j, count(*) AS n FROM li WHERE low >= 0 GROUP BY 1, 2, 3")
def contact_map(spark, d):
    return coverage.contact_map(lifted_pairs(spark, d).where("low >= 0"))


@query(f"""WITH {LIFT}, {SCAFFOLDS}, cm AS (SELECT high // 1000 - low // 1000 AS distance, count(*) AS n FROM li WHERE low >= 0 GROUP BY 1), bn AS (SELECT (length(bases) + 999) // 1000 AS b FROM s WHERE length(bases) > 0),
    ce AS (SELECT distance, CAST(sum(b - distance) AS BIGINT) AS cells FROM (SELECT b, unnest(range(0, b)) AS distance FROM bn) GROUP BY 1) SELECT distance, cells, coalesce(n, 0) AS n, round(coalesce(n, 0) / cells, 9) AS mean FROM ce LEFT JOIN cm USING (distance)""")
def ideal_contact(spark, d):
    return coverage.ideal_contact(contact_map(spark, d), scaffolds_of(spark, d).select(F.length("bases").cast("bigint").alias("len")))


@query(f"""WITH {PAIRS}, {CONTIGS}, z AS (SELECT abs(id1) AS c1, abs(id2) AS c2, least(place1, x.len - 1 - place1) AS d1, least(place2, y.len - 1 - place2) AS d2, CASE WHEN place1 <= x.len - 1 - place1 THEN 'L' ELSE 'R' END AS s1, CASE WHEN place2 <= y.len - 1 - place2 THEN 'L' ELSE 'R' END AS s2
    FROM q JOIN c x ON abs(id1) = x.contig_id JOIN c y ON abs(id2) = y.contig_id WHERE abs(id1) <> abs(id2)) SELECT CASE WHEN c1 > c2 THEN c2 ELSE c1 END AS a, CASE WHEN c1 > c2 THEN c1 ELSE c2 END AS b, CASE WHEN c1 > c2 THEN s2 ELSE s1 END AS side_a, CASE WHEN c1 > c2 THEN s1 ELSE s2 END AS side_b,
    count(*) AS n, round(sum((1 - d1 / 500) * (1 - d2 / 500)), 6) AS score FROM z WHERE d1 < 500 AND d2 < 500 AND d1 >= 0 AND d2 >= 0 GROUP BY 1, 2, 3, 4""")
def end_contact_scores(spark, d):
    return coverage.end_scores(pairs_of(spark, d), contigs_of(spark, d))


@query(f"WITH {WORDS} SELECT n AS value, count(*) AS n FROM k GROUP BY 1")
def word_histogram(spark, d):
    return words.occurrence_histogram(words.word_counts(reads_of(spark, d)))


@query(f"""WITH {WORDS}, hs AS (SELECT n AS value, count(*) AS m FROM k GROUP BY 1), dn AS (SELECT value, coalesce(m, 0) AS m FROM (SELECT unnest(range((SELECT min(value) FROM hs), (SELECT max(value) FROM hs) + 1)) AS value) LEFT JOIN hs USING (value)),
    ms AS (SELECT value, sum(m) OVER (ORDER BY value RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS mass FROM dn), nx2 AS (SELECT *, lead(mass) OVER (ORDER BY value) AS nx FROM ms) SELECT value, CAST(mass AS BIGINT) AS mass FROM nx2 WHERE nx >= mass OR nx IS NULL ORDER BY value LIMIT 1""")
def word_left_minimum(spark, d):
    return stats.left_minimum(word_histogram(spark, d))


@query(f"WITH {BOTH}, ou AS (SELECT a AS kmer, count(*) AS n FROM l GROUP BY 1), nn AS (SELECT b AS kmer, count(*) AS n FROM l GROUP BY 1) SELECT kmer, k.n, coalesce(nn.n, 0) AS n_in, coalesce(ou.n, 0) AS n_out FROM k LEFT JOIN ou USING (kmer) LEFT JOIN nn USING (kmer) WHERE coalesce(nn.n, 0) <> 1 OR coalesce(ou.n, 0) <> 1")
def word_junctions(spark, d):
    return words.junctions(words.word_counts(reads_of(spark, d)))


@query()
def word_stretches(spark, d):
    k = cut(words.word_counts(reads_of(spark, d), least=2))
    return words.stretches(k, words.straight_joins(k))


@query(f"WITH {ENDS} SELECT min(contig_id) AS a, max(contig_id) AS b FROM en WHERE lw IS NOT NULL AND rw IS NOT NULL GROUP BY lw, rw HAVING count(*) = 2")
def allele_partners(spark, d):
    return words.end_partners(contigs_of(spark, d))


@query(f"WITH {ENDS} SELECT min(contig_id) AS a, max(contig_id) AS b FROM en WHERE lw IS NOT NULL GROUP BY lw HAVING count(*) = 2")
def one_end_partners(spark, d):
    return words.end_partners(contigs_of(spark, d), both=False)


@query(f"""WITH {ENDS}, pr AS (SELECT min(contig_id) AS a, max(contig_id) AS b FROM en WHERE lw IS NOT NULL GROUP BY lw HAVING count(*) = 2), z AS (SELECT a, b, x.bases AS ta, y.bases AS tb, x.cov AS ca, y.cov AS cb, levenshtein(x.bases, y.bases) AS dd FROM pr JOIN c x ON a = x.contig_id JOIN c y ON b = y.contig_id)
    SELECT a, b, CAST(dd AS BIGINT) AS distance, dd <= 0.1 * greatest(length(ta), length(tb)) AS collapses, CASE WHEN ca >= cb THEN a ELSE b END AS kept FROM z""")
def allele_similarity(spark, d):
    c = contigs_of(spark, d)
    return words.allele_similarity(words.end_partners(c, both=False), c)


@query(f"""WITH {CONTIGS}, sg AS (SELECT contig_id AS id, 1 AS s, bases AS t FROM c UNION ALL SELECT contig_id, -1, {RC('bases')} FROM c), st AS (SELECT id, s, t, ofs, substr(t, ofs, 31) AS w FROM (SELECT *, unnest(range(1, length(t) - 29)) AS ofs FROM sg)),
    rt AS (SELECT *, right(t, 31) AS w FROM sg WHERE length(t) >= 31 AND NOT contains(right(t, 31), 'N')) SELECT x.id * x.s AS a, y.id * y.s AS b, CAST(max(y.ofs + 30) AS BIGINT) AS overlap FROM rt x JOIN st y ON x.w = y.w
    AND ((x.s = 1 AND y.s = 1 AND x.id <> y.id) OR (x.s <> y.s AND x.id < y.id)) AND y.ofs + 30 <= length(x.t) AND right(x.t, y.ofs + 30) = left(y.t, y.ofs + 30) GROUP BY 1, 2""")
def end_overlaps(spark, d):
    return overlaps_of(spark, d)


@query(f"""WITH {ENDS}, f AS (SELECT contig_id, bases, len FROM c WHERE len >= 31), hs AS (SELECT contig_id AS host, bases AS hb, len FROM c WHERE bases <> '' UNION ALL SELECT contig_id, {RC('bases')}, len FROM c WHERE bases <> '')
    SELECT contig_id, min(host) AS within FROM f JOIN hs ON host <> contig_id AND (hs.len > f.len OR (hs.len = f.len AND host < contig_id)) AND contains(hb, bases) GROUP BY 1""")
def contained_contigs(spark, d):
    return words.contained(contigs_of(spark, d))


@query(f"""WITH {CONTIGS}, b AS (SELECT * FROM c WHERE len > 0 AND kind IN ('primary_bubble', 'secondary_bubble')), m AS (SELECT sum(cov * len) / sum(len) AS m FROM b)
    SELECT count(*) AS n, round(sum(cov * len) / sum(len), 6) AS mean, round(sum(cov * len) FILTER (WHERE cov BETWEEN m / 2 AND m * 2) / sum(len) FILTER (WHERE cov BETWEEN m / 2 AND m * 2), 6) AS bounded_mean FROM b, m""")
def hetero_coverage(spark, d):
    return stats.weighted_mean(contigs_of(spark, d), "kind IN ('primary_bubble', 'secondary_bubble')")


PILE = f"""{MAPPED}, {CONTIGS}, og AS (SELECT abs(signed_id) AS contig_id, diagonal, CASE WHEN signed_id < 0 THEN {RC('r.bases')} ELSE r.bases END AS t FROM m JOIN r USING (lib_no, pair_id, mate)), on3 AS (SELECT og.contig_id, greatest(diagonal, 0) AS lo, least(diagonal + length(t), len) - greatest(diagonal, 0) AS n, diagonal, t, bases FROM og JOIN c USING (contig_id)),
    cu AS (SELECT row_number() OVER () AS id, contig_id, lo, n, substr(t, lo - diagonal + 1, n) AS rs, substr(bases, lo + 1, n) AS cs FROM on3 WHERE n > 0), ex AS (SELECT id, contig_id, lo, unnest(range(0, n)) AS i, rs, cs FROM cu), by1 AS (SELECT id, contig_id, lo + i AS pos, substr(rs, i + 1, 1) AS base, substr(cs, i + 1, 1) AS own FROM ex),
    gd AS (SELECT id, count(*) FILTER (WHERE base <> 'N') > 0 AND count(*) FILTER (WHERE base = own) >= 0.9 * count(*) FILTER (WHERE base <> 'N') AS good FROM by1 GROUP BY 1), pb AS (SELECT contig_id, pos, base, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS o FROM by1 JOIN gd USING (id) GROUP BY 1, 2, 3),
    pl2 AS (SELECT contig_id, CAST(pos AS BIGINT) AS pos, CAST(sum(g) AS BIGINT) AS n_good, CAST(sum(o) AS BIGINT) AS n_odd, (list(base ORDER BY g DESC, base) FILTER (WHERE g > 0 AND base <> 'N'))[1] AS base FROM pb GROUP BY 1, 2)"""


@query(f"WITH {PILE} SELECT * FROM pl2")
def pile_up(spark, d):
    return words.pile_up(mapped_of(spark, d), reads_of(spark, d), contigs_of(spark, d))


@query(f"WITH {PILE} SELECT contig_id, pos, n_good, n_odd FROM pl2 WHERE n_odd > n_good")
def masked_positions(spark, d):
    return words.masked_positions(pile_up(spark, d))


@query(f"WITH {PILE}, dp AS (SELECT contig_id, min(pos) AS a, max(pos) AS b FROM pl2 WHERE n_good + n_odd >= 2 GROUP BY 1) SELECT contig_id, coalesce(a, len) AS left_low, coalesce(len - 1 - b, len) AS right_low FROM c LEFT JOIN dp USING (contig_id) WHERE len > 0")
def low_ends(spark, d):
    return words.low_ends(pile_up(spark, d), contigs_of(spark, d))


@query(f"""WITH {GAPS}, {READS}, fl AS (SELECT scaffold_id, gap_no, substr(bases, gap_start - 19, 20) AS lw, substr(bases, gap_end + 1, 20) AS rw FROM g JOIN s USING (scaffold_id) WHERE left_flank >= 20 AND right_flank >= 20),
    bo AS (SELECT bases AS t FROM r UNION ALL SELECT {RC('bases')} FROM r), hh AS (SELECT scaffold_id, gap_no, rw, substr(t, ofs + 20) AS rest FROM (SELECT t, unnest(range(1, length(t) - 18)) AS ofs FROM bo) JOIN fl ON substr(t, ofs, 20) = lw),
    vt AS (SELECT scaffold_id, gap_no, substr(rest, 1, strpos(rest, rw) - 1) AS filling, count(*) AS n_reads FROM hh WHERE strpos(rest, rw) > 0 GROUP BY 1, 2, 3)
    SELECT scaffold_id, gap_no, filling, n_reads FROM (SELECT *, row_number() OVER (PARTITION BY scaffold_id, gap_no ORDER BY n_reads DESC, length(filling), filling) AS rk FROM vt) WHERE rk = 1""")
def gap_fillings(spark, d):
    s = scaffolds_of(spark, d)
    return words.gap_fillings(layout.gap_table(s), s, reads_of(spark, d))


@query(f"WITH {READS} SELECT lib_no, pair_id, mate, {RC('bases')} AS reverse, trim(bases, 'N') AS trimmed, length(bases) - length(replace(bases, 'N', '')) AS n_unknown FROM r")
def read_text(spark, d):
    b = F.col("bases")
    return reads_of(spark, d).select("lib_no", "pair_id", "mate", revcomp(b).alias("reverse"), F.trim(b, F.lit("N")).alias("trimmed"), (F.length(b) - F.length(F.replace(b, F.lit("N"), F.lit("")))).cast("bigint").alias("n_unknown"))


@query()
def greedy_joins(spark, d):
    return graph.greedy_joins(edges_of(spark, d))


@query()
def greedy_layout(spark, d):
    joins = graph.greedy_joins(edges_of(spark, d))
    return graph.chain_offsets(graph.chains(joins), joins, contigs_of(spark, d))


EVIDENCE = f"""{ENDS}, {LONG.replace(CONTIGS + ', ', '')}, {SHARED}, pr AS (SELECT min(contig_id) AS a, max(contig_id) AS b FROM en WHERE lw IS NOT NULL GROUP BY lw HAVING count(*) = 2), sd AS (SELECT a AS block, a AS contig, 0 AS hp FROM pr UNION ALL SELECT a, b, 1 FROM pr),
    be AS (SELECT least(u.block, w.block) AS x, greatest(u.block, w.block) AS y, CAST(sum(CASE WHEN u.hp = w.hp THEN n ELSE 0 END) AS BIGINT) AS parallel, CAST(sum(CASE WHEN u.hp <> w.hp THEN n ELSE 0 END) AS BIGINT) AS crossed
    FROM sr JOIN sd u ON sr.a = u.contig JOIN sd w ON sr.b = w.contig AND u.block <> w.block GROUP BY 1, 2)"""


@query(f"WITH {EVIDENCE} SELECT * FROM be")
def block_evidence(spark, d):
    return graph.block_evidence(words.end_partners(contigs_of(spark, d), both=False), shared_long_reads(spark, d))


@query()
def phased_blocks(spark, d):
    return graph.phase_blocks(block_evidence(spark, d))


@query(f"""WITH {LIFT}, cm AS (SELECT scaffold_id, low // 1000 AS i, high // 1000 AS j, count(*) AS n FROM li WHERE low >= 0 GROUP BY 1, 2, 3), z AS (SELECT *, unnest(range(greatest(j - 2, 1), i + 4)) AS boundary FROM cm WHERE j - i <= 3),
    t AS (SELECT scaffold_id, boundary, CAST(sum(CASE WHEN i < boundary AND j >= boundary THEN n ELSE 0 END) AS BIGINT) AS crossing, CAST(sum(CASE WHEN i < boundary AND j >= boundary THEN 0 ELSE n END) AS BIGINT) AS inside FROM z GROUP BY 1, 2)
    SELECT *, round(inside / (inside + crossing), 6) AS separation FROM t""")
def contact_boundaries(spark, d):
    return coverage.contact_boundaries(contact_map(spark, d))
