"""Word graphs of reads, sequence ends, containment, alleles, pile-ups and gap filling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.codes import canonical_code, coded_words, reversed_code, word_text
from strandloom.functions.rolling import end_hashes, end_stretches, filter_of, held
from strandloom.functions.seq import kmers, revcomp
from strandloom.operators.skew import pairs_within
from strandloom.plans.shared import cut
from strandloom.sources.tables import fanned, partitions

MOST = 65534


def word_counts(seqs: DataFrame, k: int = 21, least: int = 1) -> DataFrame:
    """Codes of canonical k-base words (the lesser strand) without N and their occurrences `n`, saturating at 65534, at least `least`."""
    words = coded_words(fanned(seqs.select("bases")), [], k)
    return words.groupBy(canonical_code(F.col("code"), k).alias("code")).agg(F.least(F.count(F.lit(1)), F.lit(MOST)).cast("bigint").alias("n")).where(F.col("n") >= least)


def occurrence_histogram(counts: DataFrame) -> DataFrame:
    """How many words occur how often: `value`, `n`."""
    return counts.groupBy(F.col("n").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def word_ends(counts: DataFrame, k: int = 21) -> DataFrame:
    """The two joints of k - 1 bases of every word: `code`, `n`, `out` (the end a joint is at), `joint` (canonical), `same`.

    A word's beginning is a head at that joint, its end, read turned, a head at the reverse complement. A joint and its reverse
    complement are one: heads of one reading (`same` true or false) follow the words of the other.
    """
    code, mask = F.col("code"), F.lit((1 << (2 * (k - 1))) - 1)
    heads = F.array(F.struct(F.lit(False).alias("out"), F.shiftrightunsigned(code, 2).alias("j")), F.struct(F.lit(True).alias("out"), reversed_code(code.bitwiseAND(mask), k - 1).alias("j")))
    at = counts.select("code", "n", F.explode(heads).alias("h")).select("code", "n", "h.out", "h.j")
    joint = canonical_code(F.col("j"), k - 1)
    return at.select("code", "n", "out", joint.alias("joint"), (joint == F.col("j")).alias("same"), (F.col("j") == reversed_code(F.col("j"), k - 1)).alias("own"))


def junctions(counts: DataFrame, k: int = 21) -> DataFrame:
    """Canonical words with their in- and out-degree (0 to 4) where either is not 1: ends and branchings of the graph."""
    w = Window.partitionBy("joint")
    heads = F.when(F.col("own"), F.count(F.lit(1)).over(w)).when(F.col("same"), F.count_if(~F.col("same")).over(w)).otherwise(F.count_if("same").over(w))
    at = word_ends(counts, k).withColumn("degree", heads)
    pick = lambda out: F.max(F.when(F.col("out") == out, F.col("degree")))
    rows = at.groupBy("code", "n").agg(pick(False).alias("n_in"), pick(True).alias("n_out")).where("n_in <> 1 OR n_out <> 1")
    return rows.select(word_text(F.col("code"), k).alias("kmer"), "n", "n_in", "n_out")


def straight_joins(counts: DataFrame, k: int = 21) -> DataFrame:
    """Pairs of words joined at a joint that has one word on either side: the insides of unbranched stretches.

    `x`, `y` with the ends (`x_out`, `y_out`) that meet.
    """
    one = lambda same, c: F.max(F.when(F.col("same") == same, F.col(c)))
    at = word_ends(counts, k).where("NOT own").groupBy("joint").agg(
        F.count_if("same").alias("_a"), F.count_if(~F.col("same")).alias("_b"), one(True, "code").alias("x"), one(True, "out").alias("x_out"), one(False, "code").alias("y"), one(False, "out").alias("y_out"))
    return at.where("_a = 1 AND _b = 1").select("x", "x_out", "y", "y_out")


def stretches(counts: DataFrame, joins: DataFrame, k: int = 21) -> DataFrame:
    """Unbranched stretches on either strand: `stretch` (lowest word in it), words, bases and mean occurrence (6 digits).

    Both strands of a word are one node, so that a stretch and its reverse complement are one component.
    """
    from strandloom.operators.graph import components

    comp = components(joins, "x", "y")
    rows = counts.join(comp, F.col("code") == F.col("node"), "left").withColumn("stretch", F.coalesce("component", "code"))
    got = rows.groupBy("stretch").agg(F.count(F.lit(1)).alias("n_words"), F.round(F.avg("n"), 6).alias("coverage"))
    return got.select(word_text(F.col("stretch"), k).alias("stretch"), "n_words", (F.col("n_words") + k - 1).cast("bigint").alias("bases"), "coverage")


def reads_on_ends(read_set: DataFrame, contigs: DataFrame, k: int = 31) -> DataFrame:
    """Reads that hold the first or last k bases of a contig, on either strand, and how many of their words do."""
    both = contigs.where(F.length("bases") >= k).select(F.explode(F.array(F.substring("bases", 1, k), F.expr(f"right(bases, {k})"))).alias("bases"))
    own = coded_words(both, [], k).select(canonical_code(F.col("code"), k).alias("code")).distinct()
    rows = coded_words(fanned(read_set, "pair_id", "mate"), ["lib_no", "pair_id", "mate"], k).withColumn("code", canonical_code(F.col("code"), k))
    return rows.join(own, "code", "left_semi").groupBy("lib_no", "pair_id", "mate").agg(F.count(F.lit(1)).alias("n"))


def ends(contigs: DataFrame, k: int = 31) -> DataFrame:
    """First and last word of every contig of at least k bases; null where it holds an N."""
    clean = lambda w: F.when(~F.contains(w, F.lit("N")), w)
    return contigs.where(F.length("bases") >= k).select("contig_id", clean(F.substring("bases", 1, k)).alias("left"), clean(F.expr(f"right(bases, {k})")).alias("right"))


def end_partners(contigs: DataFrame, k: int = 31, both: bool = True) -> DataFrame:
    """Alleles by equal ends: exactly two contigs share a key of the left and right word (or, not `both`, the left one).

    `a` < `b`; keys of one or of more contigs give nothing, so no key gives more than one pair. Only words of the key must be clean.
    """
    key = F.concat("left", F.lit("-"), "right") if both else F.col("left")
    rows = ends(contigs, k).select("contig_id", key.alias("key")).where("key IS NOT NULL")
    rows = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("contig_id").alias("a"), F.max("contig_id").alias("b"))
    return rows.where("_n = 2").select("a", "b")


def _codes_of(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    return coded_words(rows.select(*keys, F.col(text).alias("bases")), list(keys), 31).select(*keys, "code")


def end_overlaps(contigs: DataFrame, chosen: Callable[[Callable[[DataFrame], DataFrame]], DataFrame] | None = None) -> DataFrame:
    """Exact overlaps in which the end of `a` is the beginning of `b`: the longest one of each pair, at least 31 bases.

    Ids are signed (negative: the reverse complement). An overlap of a, b is one of -b, -a too; of two strands it is given with
    |a| < |b|, of one strand with both ids positive. The last 31 bases of `a` must hold no N. In an overlap the end word of `a` stands in
    `b` and the first word of `b` in `a`: stretches from an end up to a word that ends another contig are joined by their hashes,
    so that words and contigs that only share a word never meet. The words of contigs aren't shuffled; the text decides, and is
    shuffled for contigs with candidates only.

    `contigs` may have several deliveries of an id. Then `chosen` gives the rows that count, one per id: it gets a filter of rows by
    `contig_id` to use before it chooses. Stretches of other deliveries only make candidates.
    """
    k = 31
    contigs = contigs.select("contig_id", "bases")
    chosen = chosen or (lambda keep: keep(contigs))
    long_ = contigs.where(F.length("bases") >= k)
    ends_ = cut(end_hashes(long_, k))
    rows = cut(end_stretches(long_, filter_of(ends_, ends_.count()), k))
    once = lambda tail: rows.where(tail).repartition(partitions(contigs.sparkSession), "hash", "n").distinct()
    tail = once("tail").select(F.col("contig_id").alias("a"), F.col("side").alias("sa"), "n", "hash")
    head = once("NOT tail").select(F.col("contig_id").alias("b"), F.col("side").alias("sb"), "n", "hash")
    pairs = tail.join(head, ["hash", "n"]).where("(sa = 1 AND sb = 1 AND a <> b) OR (sa <> sb AND a < b)")
    pairs = cut(pairs.groupBy("a", "sa", "b", "sb").agg(F.sort_array(F.collect_set("n"), False).alias("ns")))
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    seen = filter_of(ids, ids.count())
    turned = lambda s, t: F.when(F.col(s) > 0, F.col(t)).otherwise(revcomp(F.col(t)))
    text = chosen(lambda r: held(r, "contig_id", seen)).select(F.col("contig_id").alias("a"), F.col("bases").alias("t"))
    at = pairs.join(text, "a").select("a", "sa", "b", "sb", "ns", F.right(turned("sa", "t"), F.col("ns")[0]).alias("ta")).where(~F.contains(F.right("ta", F.lit(k)), F.lit("N")))
    both = at.join(text.withColumnRenamed("a", "b"), "b").withColumn("tb", F.left(turned("sb", "t"), F.col("ns")[0]))
    n = F.array_max(F.filter("ns", lambda m: (m <= F.length("ta")) & (m <= F.length("tb")) & (F.right("ta", m) == F.left("tb", m)))).cast("bigint")
    return both.select((F.col("a") * F.col("sa")).alias("a"), (F.col("b") * F.col("sb")).alias("b"), n.alias("overlap")).where("overlap IS NOT NULL")


def linked_overlaps(grouped: DataFrame, contigs: DataFrame, low: int, high: int, mismatch: float) -> DataFrame:
    """The longest overlap of `low` to `high` bases between the right end of `id1` and the left end of `id2`, of linked pairs only.

    At most a share `mismatch` of the bases may differ; an overlap with an N in the second contig is none; null where there is none.
    """
    two = contigs.select("contig_id", "bases", F.explode(F.array(F.lit(1), F.lit(-1))).alias("s")).select((F.col("contig_id") * F.col("s")).alias("id"), F.when(F.col("s") > 0, F.col("bases")).otherwise(revcomp(F.col("bases"))).alias("t"))
    ends = two.select("id", F.expr(f"right(t, {high})").alias("tail"), F.expr(f"left(t, {high})").alias("head"))
    rows = grouped.select("id1", "id2").join(ends.select(F.col("id").alias("id1"), "tail"), "id1").join(ends.select(F.col("id").alias("id2"), "head"), "id2")
    if mismatch:
        x, y = lambda k: F.split(F.right(F.col("tail"), k), ""), lambda k: F.split(F.left(F.col("head"), k), "")
        fits = lambda k: F.size(F.filter(F.zip_with(x(k), y(k), lambda p, q: p != q), lambda z: z)) <= mismatch * k
    else:
        fits = lambda k: F.right(F.col("tail"), k) == F.left(F.col("head"), k)
    good = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda k: (k <= F.length("tail")) & (k <= F.length("head")) & fits(k) & ~F.contains(F.left(F.col("head"), k), F.lit("N")))
    return rows.select("id1", "id2", F.array_max(good).cast("bigint").alias("overlap"))


def contained(contigs: DataFrame) -> DataFrame:
    """Contigs of at least 31 bases that lie within a longer one, or equal one of a lower id, on either strand: `contig_id`,
    `within` (lowest such).

    Candidates share the first clean 31-base word of the shorter, which must have room around it in the longer; where a contig
    has no clean word, any longer contig without one is a candidate. The text decides.
    """
    k = 31
    text = contigs.where("bases <> ''").select("contig_id", "bases")
    clean = F.regexp_instr("bases", F.lit("[^N]{%d}" % k)) - 1
    guest = text.where(F.length("bases") >= k).select("contig_id", F.length("bases").alias("n"), clean.alias("ofs"), "bases")
    seed = _codes_of(guest.where("ofs >= 0").withColumn("w", F.expr(f"substring(bases, ofs + 1, {k})")), "w", "contig_id", "n", "ofs")
    host = coded_words(fanned(text.withColumn("hn", F.length("bases")), "contig_id"), ["contig_id", "hn"], k, both=True).withColumnRenamed("contig_id", "host")
    room = "host <> contig_id AND at >= ofs AND at - ofs + n <= hn AND (hn > n OR host < contig_id)"
    near = seed.join(host, "code").where(room).select("host", "contig_id", "strand", (F.col("at") - F.col("ofs")).alias("start")).distinct()
    # Contigs without a clean word hold an N in every 31 bases, and so do their hosts at that place.
    dull = guest.where("ofs < 0").select("contig_id", "bases")
    texts = text.select(F.col("contig_id").alias("host"), F.col("bases").alias("hb"))
    hb = F.when(F.col("strand") > 0, F.col("hb")).otherwise(revcomp(F.col("hb")))
    found = near.join(text, "contig_id").join(texts, "host").where(F.expr("bases") == F.substring(hb, F.col("start") + 1, F.length("bases"))).select("contig_id", "host")
    return found.unionByName(dull_hosts(dull, texts)).groupBy("contig_id").agg(F.min("host").alias("within"))


def dull_hosts(dull: DataFrame, texts: DataFrame, k: int = 31) -> DataFrame:
    """Hosts of contigs without a clean word of k bases: candidates share the first k letters, N included; the text decides."""
    first = dull.select("contig_id", "bases", F.substring("bases", 1, k).alias("w"))
    hard = texts.where("hb RLIKE 'N'").select("host", F.explode(F.array("hb", revcomp(F.col("hb")))).alias("hb"))
    words = hard.select("host", "hb", F.explode(F.array_distinct(F.filter(kmers(F.col("hb"), k), lambda w: F.contains(w, F.lit("N"))))).alias("w"))
    longer = (F.length("hb") > F.length("bases")) | ((F.length("hb") == F.length("bases")) & (F.col("host") < F.col("contig_id")))
    return first.join(words, "w").where((F.col("host") != F.col("contig_id")) & longer & F.expr("contains(hb, bases)")).select("contig_id", "host")


def allele_similarity(partners: DataFrame, contigs: DataFrame, most: float = 0.1) -> DataFrame:
    """Partners of any length with their edit distance, whether it is at most `most` of the longer, and the one to keep.

    Kept is the one of higher coverage, of equal ones the lower id.
    """
    c = contigs.select("contig_id", "bases", "cov")
    rows = partners.join(c.select(F.col("contig_id").alias("a"), F.col("bases").alias("ta"), F.col("cov").alias("ca")), "a").join(c.select(F.col("contig_id").alias("b"), F.col("bases").alias("tb"), F.col("cov").alias("cb")), "b")
    d = F.levenshtein("ta", "tb")
    return fanned(rows, "a", "b").select("a", "b", d.cast("bigint").alias("distance"), (d <= most * F.greatest(F.length("ta"), F.length("tb"))).alias("collapses"), F.when(F.col("ca") >= F.col("cb"), F.col("a")).otherwise(F.col("b")).alias("kept"))


def pile_up(mapped: DataFrame, read_set: DataFrame, contigs: DataFrame, min_identity: float = 0.9) -> DataFrame:
    """Per contig position: reads whose ungapped placing is good or odd (identity below `min_identity`), and the best base.

    N in a read counts neither as match nor mismatch; identity is by the read's clean bases on the contig. `base` is the one most good reads
    show (lowest of a tie), null without any.
    """
    r = mapped.join(read_set.select("lib_no", "pair_id", "mate", "bases"), ["lib_no", "pair_id", "mate"]).select(
        "lib_no", "pair_id", "mate", F.abs("signed_id").alias("contig_id"), "diagonal", F.when(F.col("signed_id") < 0, revcomp(F.col("bases"))).otherwise(F.col("bases")).alias("r")
    )
    lo = F.greatest(F.col("diagonal"), F.lit(0)).cast("int")
    text = contigs.select("contig_id", "bases", "len")
    rows = r.join(text, "contig_id").withColumn("lo", lo).withColumn("n", (F.least(F.col("diagonal") + F.length("r"), F.col("len")) - F.col("lo")).cast("int")).where("n > 0")
    rows = rows.withColumn("rs", F.expr("substring(r, cast(lo - diagonal as int) + 1, n)")).withColumn("cs", F.expr("substring(bases, lo + 1, n)"))
    pairs = F.arrays_zip(F.split("rs", "").alias("x"), F.split("cs", "").alias("y"))
    rows = rows.withColumn("same", F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))).withColumn("clean", F.length(F.translate("rs", "N", "")))
    rows = rows.withColumn("good", (F.col("clean") > 0) & (F.col("same") >= min_identity * F.col("clean")))
    at = rows.select("contig_id", "good", "lo", F.posexplode(F.split("rs", "")).alias("i", "base")).where("base <> ''")
    per = at.groupBy("contig_id", (F.col("lo") + F.col("i")).cast("bigint").alias("pos"), "base").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("o"))
    best = F.max(F.when((F.col("g") > 0) & (F.col("base") != "N"), F.struct("g", (-F.ascii("base")).alias("b"))))
    return per.groupBy("contig_id", "pos").agg(F.sum("g").cast("bigint").alias("n_good"), F.sum("o").cast("bigint").alias("n_odd"), best.alias("m")).select("contig_id", "pos", "n_good", "n_odd", F.char(-F.col("m.b")).alias("base"))


def masked_positions(pile: DataFrame, ratio: float = 1.0) -> DataFrame:
    """Positions whose odd reads exceed `ratio` times the good ones: bases to mask."""
    return pile.where(F.col("n_odd") > ratio * F.col("n_good")).select("contig_id", "pos", "n_good", "n_odd")


def low_ends(pile: DataFrame, contigs: DataFrame, least: int = 2) -> DataFrame:
    """How many bases at either end of a contig come before the first position of depth `least`; the whole length if none has it."""
    deep = pile.where(F.col("n_good") + F.col("n_odd") >= least).groupBy("contig_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    return contigs.where("len > 0").select("contig_id", "len").join(deep, "contig_id", "left").select("contig_id", F.coalesce("a", "len").alias("left_low"), F.coalesce(F.col("len") - 1 - F.col("b"), F.col("len")).alias("right_low"))


def gap_fillings(gaps: DataFrame, scaffolds: DataFrame, read_set: DataFrame, anchor: int = 20, least: int = 1) -> DataFrame:
    """Filling of gaps by reads that hold both flanking anchors: the most frequent text between them (shortest, then lowest, of a tie).

    Reads of either strand are found by an equi join on the left anchor word; the right anchor must follow in the read.
    """
    text = scaffolds.select("scaffold_id", "bases")
    flank = gaps.where(f"left_flank >= {anchor} AND right_flank >= {anchor}").join(text, "scaffold_id").select(
        "scaffold_id", "gap_no", F.expr(f"substring(bases, cast(gap_start - {anchor} + 1 as int), {anchor})").alias("w"), F.expr(f"substring(bases, cast(gap_end + 1 as int), {anchor})").alias("right_anchor")
    )
    both = fanned(read_set.select("bases")).select(F.explode(F.array("bases", revcomp(F.col("bases")))).alias("r"))
    words = both.select("r", F.posexplode(kmers(F.col("r"), anchor)).alias("at", "w"))
    hits = flank.join(words, "w").withColumn("rest", F.expr(f"substring(r, at + {anchor} + 1)")).withColumn("p", F.instr("rest", F.col("right_anchor"))).where("p > 0")
    votes = hits.groupBy("scaffold_id", "gap_no", F.expr("substring(rest, 1, p - 1)").alias("filling")).agg(F.count(F.lit(1)).alias("n_reads")).where(F.col("n_reads") >= least)
    w = Window.partitionBy("scaffold_id", "gap_no").orderBy(F.desc("n_reads"), F.length("filling"), "filling")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def shared_reads(best: DataFrame, contigs: DataFrame) -> DataFrame:
    """Long reads that two contigs share: `a` < `b`, `n`, for `cross_support` and partners. Every read counts, however many contigs it hits."""
    ids = contigs.where("name IS NOT NULL").groupBy("name").agg(F.min("contig_id").alias("contig_id"))
    on = best.join(ids, best["t_name"] == ids["name"]).select("q_name", "contig_id").distinct()
    pairs = pairs_within(on, "q_name", "contig_id")
    return pairs.groupBy(F.col("x.contig_id").alias("a"), F.col("y.contig_id").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def mutual_best(evidence: DataFrame) -> DataFrame:
    """Pairs that are each other's strongest partner (lowest id of a tie): diploid merges of the first round."""
    both = evidence.select("a", "b", "n").unionByName(evidence.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = both.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("k"))).alias("m")).select("a", (-F.col("m.k")).alias("b"), F.col("m.n").alias("n"))
    back = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return best.join(back, ["a", "b"], "left_semi").where("a < b")
