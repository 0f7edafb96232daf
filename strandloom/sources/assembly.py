"""Sources and sinks of assemblies: clean views of the raw tables, FASTA/FASTQ/PAF readers, FASTA/TSV/BED writers.

Every view is defined for dirty input: redelivered rows count once, null or empty sequences stay as empty text where a row is
the unit and are left out where bases are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.seq import plain, revcomp, wrapped


def contig_set(contigs: DataFrame) -> DataFrame:
    """One row per `contig_id` (its longest delivery): name, bases, true length, coverage and the header's figures.

    Coverage is the column's or else the header's `_cov` number, at least 1 and at most 65535; a header without a figure
    gives 1 for it. Null ids are left out.
    """
    w = Window.partitionBy("contig_id").orderBy(F.length("bases").desc(), "bases", F.col("name").asc_nulls_last(), F.col("cov").asc_nulls_last())
    field = lambda tag: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("name", tag + r"(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))
    return (
        contigs.where("contig_id IS NOT NULL").select("contig_id", "name", "cov", plain("seq").alias("bases"))
        .withColumn("_r", F.row_number().over(w)).where("_r = 1")
        .select(
            "contig_id", "name", "bases", F.length("bases").cast("bigint").alias("len"),
            F.least(F.greatest(F.coalesce("cov", field("_cov")), F.lit(1)), F.lit(65535)).alias("cov"),
            field("_read").alias("read_len"), field("_maxK").alias("max_k"), F.regexp_extract("name", "^([a-z_]*[a-z])", 1).alias("kind"),
        )
    )


def deliveries(contigs: DataFrame) -> DataFrame:
    """`contig_id`, `bases` of all rows that `contig_set` chooses from."""
    return contigs.where("contig_id IS NOT NULL").select("contig_id", plain("seq").alias("bases"))


def contig_lengths(contigs: DataFrame) -> DataFrame:
    """`contig_id`, `len` of `contig_set`, whose text isn't shuffled: its longest delivery has the most bases."""
    return deliveries(contigs).groupBy("contig_id").agg(F.max(F.length("bases")).cast("bigint").alias("len"))


def scaffold_set(scaffolds: DataFrame) -> DataFrame:
    """One row per `scaffold_id` (its longest delivery): first word of the name without '>', bases."""
    w = Window.partitionBy("scaffold_id").orderBy(F.length("bases").desc(), "bases", F.col("name").asc_nulls_last())
    rows = scaffolds.where("scaffold_id IS NOT NULL").select("scaffold_id", "name", plain("seq").alias("bases"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("scaffold_id", F.regexp_extract("name", r"^>?(\S+)", 1).alias("name"), "bases")


def components(table: DataFrame) -> DataFrame:
    """Distinct parts of scaffolds with both ends known."""
    return table.where("scaffold_id IS NOT NULL AND contig_ref IS NOT NULL AND comp_start IS NOT NULL AND comp_end IS NOT NULL").distinct()


def reads(read_pairs: DataFrame) -> DataFrame:
    """One row per (`lib_no`, `pair_id`, `mate`) that has bases; of doubled reads the lowest text and highest tag count."""
    rows = read_pairs.select("lib_no", "pair_id", "mate", "tag", plain("seq").alias("bases")).where("bases <> ''")
    return rows.groupBy("lib_no", "pair_id", "mate").agg(F.min("bases").alias("bases"), F.max("tag").alias("tag"))


def oriented_pairs(read_set: DataFrame, libraries: DataFrame) -> DataFrame:
    """Pairs with both mates; the mates of outward libraries are reverse-complemented, so that all pairs face inward.

    `libraries` is a fixed table of a few rows and is broadcast.
    """
    kinds = F.broadcast(libraries.select("lib_no", "kind"))
    rows = read_set.join(kinds, "lib_no").withColumn("bases", F.when(F.col("kind") == "outward", revcomp(F.col("bases"))).otherwise(F.col("bases")))
    pick = lambda m: F.max(F.when(F.col("mate") == m, F.col("bases")))
    return rows.groupBy("lib_no", "pair_id").agg(pick(1).alias("first"), pick(2).alias("second"), F.max("tag").alias("tag")).where("first IS NOT NULL AND second IS NOT NULL")


def tag_dictionary(read_set: DataFrame) -> DataFrame:
    """Dense numbers of the tags, in order, with their reads; numbered in two steps so that no task orders all tags."""
    from strandloom.operators.layout import offsets

    per_tag = read_set.where("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("n_reads"))
    before = offsets(per_tag.select("tag", F.lit(1).cast("bigint").alias("one")), "tag", "one")
    return per_tag.join(before, "tag").select("tag", (F.col("before") + 1).alias("tag_no"), "n_reads")


def alignments(paf_hits: DataFrame) -> DataFrame:
    """Distinct placed long-read hits with identity, read share, insertions and deletions of the CIGAR, and the diagonal."""
    size = lambda op: F.aggregate(F.transform(F.regexp_extract_all(F.coalesce("cg", F.lit("")), F.lit(rf"(\d+){op}"), F.lit(1)), lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    rows = paf_hits.where("t_name IS NOT NULL AND t_name <> '*' AND q_name IS NOT NULL AND aln_len > 0 AND q_len > 0").distinct()
    return rows.select(
        "q_name", "q_len", "q_start", "q_end", "strand", "t_name", "t_len", "t_start", "t_end", "match_len", "aln_len", "mapq",
        (F.col("match_len") / F.col("aln_len")).alias("identity"), ((F.col("q_end") - F.col("q_start")) / F.col("q_len")).alias("q_share"),
        size("I").alias("ins"), size("D").alias("del"),
        F.when(F.col("strand") == "-", F.col("t_end") + F.col("q_start")).otherwise(F.col("t_start") - F.col("q_start")).alias("diagonal"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files (plain, gzip or bzip2): `file`, `name` (first word), `header`, `bases`. Text before the first '>' is left out.

    Records are split by the text source itself, so that plain and bzip2 files are read in parallel.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>", "").alias("r"))
    head = F.regexp_replace(F.substring_index("r", "\n", 1), r"\s+$", "")
    body = F.when(F.instr("r", "\n") > 0, F.expr("substring(r, instr(r, '\n') + 1)")).otherwise(F.lit(""))
    return rows.where("trim(r) <> ''").select("file", F.regexp_extract(head, r"^(\S+)", 1).alias("name"), head.alias("header"), plain(body).alias("bases"))


def numbered(rows: DataFrame, *columns: str) -> DataFrame:
    """`columns` and `ordinal`: the row's number from 0 within its file. `rows` has `file`, `part` (start of its split) and `id`.

    A row's number is its place within its split plus the rows of the file's earlier splits, which are counted first.
    """
    parts = rows.groupBy("file", "part").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    n = F.col("last") - F.col("first") + 1
    before = F.coalesce(F.sum(n).over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = parts.select("file", "part", "first", before.alias("before"))
    return rows.join(at, ["file", "part"]).select(*columns, (F.col("before") + F.col("id") - F.col("first")).alias("ordinal"))


def _split(rows: DataFrame, text: str) -> DataFrame:
    return rows.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("part"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r", "").alias(text))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """FASTQ files (plain, gzip or bzip2): `file`, `ordinal` from 0, `name`, `tag` (of BX:Z:), `bases`.

    Sequences and qualities may be wrapped over lines. The text is split before every line that begins with '+'; what comes
    before it ends with a header line ('@') and lines of letters only, the record. So files are split and read in parallel, and
    lines of qualities are never taken for records, but for letters behind a line '@...' at the end of a wrapped quality.
    """
    chunks = _split(spark.read.option("lineSep", "\n+").text(path), "r")
    tail = "(?s)(?:^|\\n)@([^\\n]*)\\n([A-Za-z.*\\-\\n]+)$"
    rows = numbered(chunks, "file", "part", "r", "id").withColumn("head", F.regexp_extract("r", tail, 1)).withColumn("seq", F.regexp_extract("r", tail, 2)).where("seq <> ''")
    # A quality that begins with '+' splits a record's rest once more; records are numbered among themselves.
    kept = rows.select("file", F.lit(0).cast("bigint").alias("part"), F.col("ordinal").alias("at"), "head", "seq")
    w = Window.partitionBy("file", F.floor(F.col("at") / (1 << 20))).orderBy("at")
    sizes = kept.groupBy("file", F.floor(F.col("at") / (1 << 20)).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("file", "s", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    got = kept.withColumn("s", F.floor(F.col("at") / (1 << 20))).withColumn("k", F.row_number().over(w) - 1).join(base, ["file", "s"])
    return got.select(
        "file", (F.col("base") + F.col("k")).alias("ordinal"), F.regexp_extract("head", r"^(\S+)", 1).alias("name"), F.nullif(F.regexp_extract("head", "BX:Z:([A-Za-z0-9-]+)", 1), F.lit("")).alias("tag"), plain("seq").alias("bases")
    )


def read_tagged_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records with `ordinal` from 0 in their file and the barcode `tag` of BX:Z: in the header."""
    rows = _split(spark.read.option("lineSep", "\n>").text(path), "r").where("trim(r) <> ''")
    at = numbered(rows, "file", "r")
    head = F.substring_index(F.regexp_replace("r", "^>", ""), "\n", 1)
    body = F.when(F.instr("r", "\n") > 0, F.expr("substring(r, instr(r, '\n') + 1)")).otherwise(F.lit(""))
    return at.select("file", "ordinal", F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.nullif(F.regexp_extract(head, "BX:Z:([A-Za-z0-9-]+)", 1), F.lit("")).alias("tag"), plain(body).alias("bases"))


def paired_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """The reads of two files (each with `ordinal`, `name`, `tag`, `bases`) as pairs by their place: `pair_id`, `mate`, `tag`, `bases`.

    A read without counterpart, in the longer file, makes no pair. Both mates get the pair's tag.
    """
    a, b = (x.select(F.col("ordinal").alias("pair_id"), F.col("tag").alias(f"t{m}"), F.col("bases").alias(f"b{m}")) for m, x in ((1, first), (2, second)))
    both = a.join(b, "pair_id").withColumn("tag", F.coalesce("t1", "t2"))
    return both.select("pair_id", "tag", F.explode(F.array(*(F.struct(F.lit(m).alias("mate"), F.col(f"b{m}").alias("bases")) for m in (1, 2)))).alias("m")).select("pair_id", "m.mate", "tag", "m.bases")


def interleaved(reads_of_file: DataFrame) -> DataFrame:
    """The reads of one file that holds both mates in turn: `pair_id`, `mate`, `tag`, `bases`; a last read alone makes no pair."""
    rows = reads_of_file.select(F.floor(F.col("ordinal") / 2).alias("pair_id"), (F.col("ordinal") % 2 + 1).cast("int").alias("mate"), "tag", "bases")
    whole = rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"), F.max("tag").alias("tag")).where("_n = 2").select("pair_id", "tag")
    return rows.drop("tag").join(whole, "pair_id").select("pair_id", "mate", "tag", "bases")


def read_block_list(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of names that must not be linked, one pair a line, separated by white space: `name1`, `name2`."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(f[0].alias("name1"), F.get(f, F.lit(1)).alias("name2")).where("name2 IS NOT NULL")


def blocked_ids(block_list: DataFrame, records: DataFrame) -> DataFrame:
    """`id1`, `id2` of the contigs a block list names; names that no contig bears are left out."""
    ids = records.where("name IS NOT NULL").groupBy("name").agg(F.min("contig_id").alias("id"))
    one = lambda i: ids.select(F.col("name").alias(f"name{i}"), F.col("id").alias(f"id{i}"))
    return block_list.join(one(1), "name1").join(one(2), "name2").select("id1", "id2")


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """PAF files as the columns of `paf_hits`; the `cg:Z:` field may stand anywhere among the optional ones."""
    f = F.split("value", "\t")
    names = ("q_name", "q_len", "q_start", "q_end", "strand", "t_name", "t_len", "t_start", "t_end", "match_len", "aln_len", "mapq")
    kinds = ("string", "bigint", "bigint", "bigint", "string", "string", "bigint", "bigint", "bigint", "bigint", "bigint", "int")
    cols = [F.try_element_at(f, F.lit(i + 1)).try_cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))]
    return spark.read.text(path).where("value <> ''").select(*cols, F.nullif(F.regexp_extract("value", r"\t(cg:Z:\S+)", 1), F.lit("")).alias("cg"))


def file_kind(spark: SparkSession, path: str) -> str:
    """`fasta`, `fastq` or `unknown`, by the first lines."""
    lines = [r[0] for r in spark.read.text(path).limit(4).collect()]
    if len(lines) >= 2 and lines[0].startswith(">") and not set(lines[1].upper()) - set("ACGTN"):
        return "fasta"
    if len(lines) >= 3 and lines[0].startswith("@") and not set(lines[1].upper()) - set("ACGTN") and lines[2].startswith("+"):
        return "fastq"
    return "unknown"


def fasta_lines(records: DataFrame, width: int = 80) -> DataFrame:
    """`value`: each record as FASTA text, wrapped at `width`; records without bases are left out."""
    return records.where("bases <> ''").select(F.concat(F.lit(">"), F.coalesce("name", F.lit("")), F.lit("\n"), wrapped(F.col("bases"), width)).alias("value"))


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    fasta_lines(records, width).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)
