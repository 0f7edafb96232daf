"""Queries and SQL of the problems tagged llm."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.llm import frequency, mixing, near, personal, spans, splitting, tokens
from strandloom.plans.shared import cut
from strandloom.sources.tables import spread, table


def p1_found(spark, sf_dir):
    return splitting.split(spread(table(spark, sf_dir, "scaffolds"))).select("scaffold_id", "piece_no", "piece_start", "piece_end")


def p1_fragments(spark, sf_dir):
    return splitting.split(spread(table(spark, sf_dir, "scaffolds")), text=True)


def p1_bisected(spark, sf_dir):
    return splitting.split(spread(table(spark, sf_dir, "scaffolds")), rule="free")


def p2_key_frequency(spark, sf_dir):
    return frequency.key_frequency(table(spark, sf_dir, "kmer_index"))


def p2_found(spark, sf_dir):
    return p2_key_frequency(spark, sf_dir).where("mark IS NOT NULL").select("hash_key", "mark")


def p2_key_ngrams(spark, sf_dir):
    return frequency.key_ngrams(table(spark, sf_dir, "kmer_index"))


def p3_found(spark, sf_dir):
    return spans.shared_spans(spread(table(spark, sf_dir, "contigs")))


def p3_shared_share(spark, sf_dir):
    return spans.shared_share(table(spark, sf_dir, "contigs"), p3_found(spark, sf_dir))


def p4_found(spark, sf_dir):
    return near.pairs(*near.near_duplicates(spread(table(spark, sf_dir, "contigs"))))


def p4_groups(spark, sf_dir):
    return near.groups(*near.near_duplicates(spread(table(spark, sf_dir, "contigs"))))


def p6_ids(spark, sf_dir):
    return tokens.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p6_offsets(spark, sf_dir):
    return tokens.encode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), offsets=True)


def p6_decoded(spark, sf_dir):
    return tokens.decode(p6_ids(spark, sf_dir))


def p7_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark, sf_dir):
    return mixing.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_invariants(spark, sf_dir):
    return mixing.invariants(cut(p7_mix(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))


def p8_found(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return personal.detect(docs, table(spark, sf_dir, "person_names")).select("doc_id", "kind", "start_pos")


def p8_redacted(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return personal.detect(docs, table(spark, sf_dir, "person_names"), redact=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_fragments, p1_bisected, p2_found, p2_key_frequency, p2_key_ngrams, p3_found, p3_shared_share, p4_found, p4_groups, p6_ids, p6_offsets, p6_decoded, p7_mix, p7_shares, p7_invariants, p8_found, p8_redacted)}

_USABLE = "(SELECT contig_id, pos_offset, min(hash_key) AS hash_key FROM kmer_index WHERE hash_key >= 0 AND contig_id <> 0 AND pos_offset IS NOT NULL GROUP BY 1, 2)"
_FREQUENCY = f"""SELECT hash_key, count(*) AS n_postings, count(DISTINCT contig_id) AS n_contigs,
    CASE WHEN count(*) > 256 THEN 'common' WHEN count(DISTINCT contig_id) = 1 THEN 'rare' END AS mark FROM {_USABLE} GROUP BY 1"""
_PIECES = """WITH RECURSIVE s AS (SELECT scaffold_id, max(upper(regexp_replace(seq, '\\s', '', 'g'))) AS b FROM scaffolds WHERE seq IS NOT NULL GROUP BY 1), t AS (SELECT scaffold_id, length(b) AS n, regexp_extract_all(b, 'N+|[^N]+') AS ts FROM s WHERE length(b) > 4000),
    u AS (SELECT scaffold_id, n, unnest(ts) AS x, generate_subscripts(ts, 1) AS i FROM t), v AS (SELECT *, sum(length(x)) OVER (PARTITION BY scaffold_id ORDER BY i) AS e FROM u),
    m AS (SELECT scaffold_id, n, coalesce(list(e - length(x) + length(x) // 2) FILTER (WHERE x[1] = 'N' AND length(x) >= 10), []) AS mids FROM v GROUP BY 1, 2),
    w AS (SELECT scaffold_id, n, mids, 1 AS piece_no, CAST(0 AS BIGINT) AS a, CAST(coalesce(list_max(list_filter(mids, lambda y: y > 150 AND y <= 4000)), 4000) AS BIGINT) AS b FROM m
        UNION ALL SELECT scaffold_id, n, mids, piece_no + 1, b - 150, CAST(CASE WHEN n - (b - 150) <= 4000 THEN n ELSE coalesce(list_max(list_filter(mids, lambda y: y > b AND y <= b + 3850)), b + 3850) END AS BIGINT) FROM w WHERE b < n)
    SELECT scaffold_id, CAST(piece_no AS INT) AS piece_no, a AS piece_start, b AS piece_end FROM w"""
_TEXT = "c AS (SELECT contig_id, upper(regexp_replace(seq, '\\s', '', 'g')) AS b FROM contigs WHERE contig_id IS NOT NULL AND seq IS NOT NULL)"
_SPANS = f"""WITH {_TEXT}, w AS (SELECT DISTINCT contig_id, i - 1 AS p, substr(b, i, 100) AS t FROM (SELECT contig_id, b, unnest(range(1, length(b) - 98)) AS i FROM c)), k AS (SELECT t FROM w WHERE NOT contains(t, 'N') GROUP BY 1 HAVING count(DISTINCT contig_id) > 1),
    s AS (SELECT DISTINCT contig_id, p FROM w SEMI JOIN k USING (t)), g AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY contig_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS nw FROM s), r AS (SELECT *, sum(nw) OVER (PARTITION BY contig_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS gr FROM g),
    sp AS (SELECT contig_id, min(p) AS span_start, max(p) + 100 AS span_end FROM r GROUP BY contig_id, gr)"""
ORACLE = {
    "p1_found": _PIECES,
    "p1_fragments": _PIECES.replace("SELECT scaffold_id, CAST(piece_no AS INT) AS piece_no, a AS piece_start, b AS piece_end FROM w", """, nm AS (SELECT scaffold_id, max(coalesce(regexp_extract(name, '^\\s*>?\\s*(\\S+)', 1), '')) AS word FROM scaffolds x JOIN s USING (scaffold_id)
        WHERE upper(regexp_replace(x.seq, '\\s', '', 'g')) = s.b GROUP BY 1) SELECT w.scaffold_id, CAST(piece_no AS INT) AS piece_no, word || ':::fragment_' || piece_no AS name, a AS piece_start, w.b AS piece_end, substr(s.b, a + 1, w.b - a) AS seq FROM w JOIN s USING (scaffold_id) JOIN nm USING (scaffold_id)"""),
    "p3_found": f"{_SPANS} SELECT * FROM sp",
    "p3_shared_share": f"""{_SPANS}, ln AS (SELECT contig_id, max(length(regexp_replace(coalesce(seq, ''), '\\s', '', 'g'))) AS bases FROM contigs WHERE contig_id IS NOT NULL GROUP BY 1), gt AS (SELECT contig_id, sum(span_end - span_start) AS sb, count(*) AS n FROM sp GROUP BY 1)
        SELECT contig_id, bases, CAST(coalesce(sb, 0) AS BIGINT) AS shared_bases, coalesce(n, 0) AS n_spans, CASE WHEN bases > 0 THEN round(coalesce(sb, 0) / bases, 6) ELSE 0.0 END AS share FROM ln LEFT JOIN gt USING (contig_id)""",
    "p4_found": f"""WITH {_TEXT}, w AS (SELECT DISTINCT contig_id, substr(b, i, 16) AS t FROM (SELECT contig_id, b, unnest(range(1, length(b) - 14)) AS i FROM c) WHERE NOT contains(substr(b, i, 16), 'N')), n AS (SELECT contig_id, count(*) AS n FROM w GROUP BY 1),
        o AS (SELECT x.contig_id AS a, y.contig_id AS b, count(*) AS o FROM w x JOIN w y ON x.t = y.t AND x.contig_id < y.contig_id GROUP BY 1, 2) SELECT a AS contig_a, b AS contig_b FROM o JOIN n p ON a = p.contig_id JOIN n q ON b = q.contig_id WHERE 5 * o >= 3 * (p.n + q.n - o)""",
    "p4_groups": f"""WITH RECURSIVE {_TEXT}, d AS (SELECT contig_id, max(b) AS b FROM c WHERE b <> '' GROUP BY 1), r AS (SELECT b, min(contig_id) AS rep FROM d GROUP BY 1), w AS (SELECT DISTINCT rep, substr(b, i, 16) AS t FROM (SELECT rep, b, unnest(range(1, length(b) - 14)) AS i FROM r) WHERE NOT contains(substr(b, i, 16), 'N')),
        n AS (SELECT rep, count(*) AS n FROM w GROUP BY 1), o AS (SELECT x.rep AS a, y.rep AS b, count(*) AS o FROM w x JOIN w y ON x.t = y.t AND x.rep < y.rep GROUP BY 1, 2), l AS (SELECT a, b FROM o JOIN n p ON a = p.rep JOIN n q ON b = q.rep WHERE 5 * o >= 3 * (p.n + q.n - o)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        rc AS (SELECT DISTINCT a AS node, a AS fin FROM e UNION SELECT rc.node, e.b FROM rc JOIN e ON rc.fin = e.a), g AS (SELECT node, min(fin) AS label FROM rc GROUP BY 1), dg AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
        SELECT contig_id, rep AS class_id, coalesce(label, rep) AS group_id, coalesce(dg.n, 0) AS n_links FROM d JOIN r USING (b) LEFT JOIN g ON rep = node LEFT JOIN dg ON rep = a""",
    "p2_key_frequency": _FREQUENCY,
    "p2_found": f"SELECT hash_key, mark FROM ({_FREQUENCY}) WHERE mark IS NOT NULL",
    "p2_key_ngrams": f"""WITH x AS (SELECT contig_id, hash_key AS t1, lead(hash_key) OVER (PARTITION BY contig_id ORDER BY pos_offset) AS t2 FROM {_USABLE}) SELECT t1, NULL::BIGINT AS t2, count(*) AS n, count(DISTINCT contig_id) AS n_records FROM x GROUP BY 1
        UNION ALL SELECT t1, t2, count(*), count(DISTINCT contig_id) FROM x WHERE t2 IS NOT NULL GROUP BY 1, 2""",
    "p7_invariants": """SELECT lower(trim(t.source)) AS source, target_share > 0 AND max_repeat > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.text <> '' AND lower(trim(d.source)) = lower(trim(t.source))) AS takes_part,
        TRUE AS on_target, TRUE AS within_cap FROM mix_targets t WHERE t.source IS NOT NULL""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
