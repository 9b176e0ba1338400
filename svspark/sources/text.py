"""Text formats: TSV and its kin, SAM, FASTQ, FASTA, GTF, VCF; readers are DataFrame expressions over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from svspark.functions.seq import valid_strand


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False, null: str | None = None) -> DataFrame:
    """Positional tab-separated rows; chromosomes stay strings because the schema says so."""
    reader = spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", "").option("mode", "FAILFAST")
    return (reader.option("nullValue", null) if null is not None else reader).csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = False, na: str | None = None) -> None:
    """Tab-separated rows; nulls as ``na`` if given.  Booleans are written True and False."""
    named = df.select(*[F.initcap(F.col(c).cast("string")).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])
    writer = named.write.option("sep", "\t").option("header", header).option("quote", "\u0000").option("emptyValue", "")
    (writer.option("nullValue", na) if na is not None else writer).csv(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, start, end); a row with fewer than three fields is an error."""
    parts = F.split("value", "\t")
    checked = F.when(F.size(parts) >= 3, parts).otherwise(F.raise_error(F.lit("a region needs three fields")))
    return spark.read.text(path).select(checked.alias("p")).select(F.col("p")[0].alias("chromosome"), F.col("p")[1].cast("long").alias("start"), F.col("p")[2].cast("long").alias("end"))


def read_dgv(spark: SparkSession, path: str) -> DataFrame:
    """(id, chromosome, start, end) by position; the header row of each file is skipped."""
    p = F.split("value", "\t")
    rows = numbered_lines(spark, path).where("line > 0").select(p.alias("p"))
    return rows.select(F.col("p")[0].alias("id"), F.col("p")[1].alias("chromosome"), F.col("p")[2].cast("long").alias("start"), F.col("p")[3].cast("long").alias("end"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("chromosome"), parts[1].cast("long").alias("length"))


def read_bedgraph(spark: SparkSession, path: str, cap: int = 255) -> DataFrame:
    """(chromosome, start, end, value) of half-open ranges, values capped."""
    rows = read_tsv(spark, path, "chromosome string, start long, end long, value double")
    return rows.withColumn("value", F.least(F.col("value"), F.lit(cap)).cast("int"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments (read_id, read_end, chromosome, strand, position, end, seq, cigar, flag); headers and unmapped rows are skipped.

    The end is the name's /1 or /2, else flags 0x40 and 0x80; the region is [pos, pos + len(seq) - 1].
    """
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(p.alias("p")).where("p[2] <> '*'")
    flag = F.col("p")[1].cast("int")
    name = F.col("p")[0]
    end = F.when(name.rlike("/1$"), 0).when(name.rlike("/2$"), 1).when(flag.bitwiseAND(0x40) != 0, 0).when(flag.bitwiseAND(0x80) != 0, 1)
    pos = F.col("p")[3].cast("long")
    return rows.select(
        F.regexp_replace(name, "/[12]$", "").alias("read_id"), end.alias("read_end"), F.col("p")[2].alias("chromosome"), F.when(flag.bitwiseAND(0x10) != 0, "-").otherwise("+").alias("strand"),
        pos.alias("position"), (pos + F.length(F.col("p")[9]) - 1).alias("end"), F.col("p")[9].alias("seq"), F.col("p")[5].alias("cigar"), flag.alias("flag"),
    )


def primary_only(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("flag").bitwiseAND(0x100) == 0)


def qc_passed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of which no mate failed quality control."""
    return pairs.where((F.col("flag_1").bitwiseAND(0x200) == 0) & (F.col("flag_2").bitwiseAND(0x200) == 0))


def original_orientation(seq: Column, qual: Column, strand: Column) -> tuple[Column, Column]:
    from svspark.functions.seq import reverse_complement

    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq), F.when(strand == "-", F.reverse(qual)).otherwise(qual)


def barcode_comment(name: Column, tag: Column, tag_type: Column) -> Column:
    """name:CB_tag for a string tag, else the name."""
    return F.when(tag.isNotNull() & (tag_type == "Z"), F.concat(name, F.lit(":CB_"), tag)).otherwise(name)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value) with line numbers from 0 within each file.

    Splits are not read in file order, so lines are numbered by file and by the byte where their block begins: blocks are counted,
    and a line's number is its block's offset and its place in the block.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.withColumn("_base", before), ["file", "block"]).select("file", "block", (F.col("_base") + F.col("_id") - F.col("_first")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(fragment, read_end, seq, comment, qual) from four-line records; names end in /1 or /2.

    A record without its four lines, or with letters and qualities of different number, is an error.
    """
    lines = numbered_lines(spark, path)
    of = F.col("line") % 4
    records = lines.groupBy("file", F.floor(F.col("line") / 4).alias("r")).agg(*[F.max(F.when(of == i, F.col("value"))).alias(f"l{i}") for i in range(4)])
    name = F.regexp_extract("l0", r"^@(.*)/([12])\s*$", 1)
    end = F.regexp_extract("l0", r"^@(.*)/([12])\s*$", 2)
    whole = (end != "") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    checked = F.when(whole, end.cast("int") - 1).otherwise(F.raise_error(F.concat(F.lit("bad read record "), F.coalesce("l0", F.lit("")))))
    return records.select(name.alias("fragment"), checked.alias("read_end"), F.col("l1").alias("seq"), F.substring("l2", 2, 1 << 30).alias("comment"), F.col("l3").alias("qual"))


def write_fastq(reads: DataFrame, path: str, compression: str = "gzip", max_records: int = 0) -> None:
    """Four-line records, one file set; ``max_records`` reads a file at most."""
    text = F.concat(F.lit("@"), F.col("fragment"), F.lit("/"), (F.col("read_end") + 1).cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+"), F.coalesce("comment", F.lit("")), F.lit("\n"), F.col("qual"))
    reads.orderBy("fragment", "read_end").select(text.alias("value")).write.option("compression", compression).option("maxRecordsPerFile", max_records).text(path)


def write_sorted(rows: DataFrame, path: str, by: str) -> None:
    """Tab-separated rows in the order of a numeric column, ties by all other columns as text; files are in order."""
    write_tsv(rows.orderBy(F.col(by).cast("double"), *[F.col(c).cast("string") for c in rows.columns if c != by]), path)


def paired_reads(alignments: DataFrame, rename: bool = False) -> DataFrame:
    """(fragment, read_end, seq, comment, qual) of all primary pairs of which no mate failed quality control, in the reads' own orientation.

    alignments: read_id, read_end, strand, seq, qual, flag.  The comment is the read's name; with ``rename`` fragments are numbered from 0 in the order of names.
    """
    from svspark.operators.aggregates import dense_ids

    rows = primary_only(alignments).groupBy("read_id", "read_end").agg(F.min(F.struct("flag", "strand", "seq", "qual")).alias("r"))
    ends = rows.groupBy("read_id").agg(F.count("*").alias("n"), F.max(F.col("r.flag").bitwiseAND(0x200)).alias("bad")).where("n = 2 and bad = 0").select("read_id")
    seq, qual = original_orientation(F.col("r.seq"), F.col("r.qual"), F.col("r.strand"))
    out = rows.join(ends, "read_id", "left_semi").select("read_id", "read_end", seq.alias("seq"), F.col("read_id").alias("comment"), qual.alias("qual"))
    named = dense_ids(out, ["read_id"], "fragment").withColumn("fragment", F.col("fragment").cast("string")) if rename else out.withColumn("fragment", F.col("read_id"))
    return named.select("fragment", "read_end", "seq", "comment", "qual")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Tiles (chromosome, start, seq) of one line each, start 1-based; the id is the header's first word.

    A line's header is the last one of its block before it, else the last one of an earlier block of the file; lengths are
    summed within blocks and carried from block to block, so a task holds a block and not a chromosome.
    """
    lines = numbered_lines(spark, path).withColumn("head", F.when(F.col("value").startswith(">"), F.struct("line", F.regexp_extract("value", r"^>(\S+)", 1).alias("name"))))
    in_file, in_block = (Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file", "block").orderBy("line"))
    carried = lines.groupBy("file", "block").agg(F.max("head").alias("_last")).select("file", "block", F.last("_last", ignorenulls=True).over(in_file).alias("_carry"))
    own = lines.withColumn("_own", F.last("head", ignorenulls=True).over(in_block)).where("head is null")
    body = own.join(carried, ["file", "block"]).select("file", "block", "line", "value", F.coalesce("_own", "_carry").alias("head"))
    body = body.withColumn("head", F.when(F.col("head").isNotNull(), F.col("head")).otherwise(F.raise_error(F.lit("a sequence without a header"))))
    far = Window.partitionBy("file", "head.line").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = body.groupBy("file", "head", "block").agg(F.sum(F.length("value")).alias("_n")).select("file", "head", "block", F.coalesce(F.sum("_n").over(far), F.lit(0)).alias("_before"))
    near = Window.partitionBy("file", "block", "head.line").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = body.withColumn("_within", F.coalesce(F.sum(F.length("value")).over(near), F.lit(0))).join(before, ["file", "head", "block"])
    return placed.select(F.col("head.name").alias("chromosome"), (F.col("_before") + F.col("_within") + 1).alias("start"), F.col("value").alias("seq"))


def fetch(tiles: DataFrame, ranges: DataFrame, width: int, default: str = "N") -> DataFrame:
    """(range_id, seq) of closed ranges (range_id, chromosome, start, end) over tiles of at most ``width`` letters; ``default`` beyond the ends."""
    want = ranges.select("range_id", "chromosome", F.col("start").alias("a"), F.col("end").alias("b"), F.explode(F.sequence(F.floor((F.col("start") - width) / width), F.floor(F.col("end") / width))).alias("bin"))
    have = tiles.select("chromosome", F.col("start").alias("t"), "seq", F.floor(F.col("start") / width).alias("bin"))
    hit = want.join(have, ["chromosome", "bin"]).where((F.col("t") <= F.col("b")) & (F.col("t") + F.length("seq") > F.col("a")))
    lo = F.greatest("a", "t")
    piece = F.substring("seq", (lo - F.col("t") + 1).cast("int"), (F.least(F.col("b"), F.col("t") + F.length("seq") - 1) - lo + 1).cast("int"))
    parts = hit.groupBy("range_id").agg(F.sort_array(F.collect_list(F.struct(lo.alias("lo"), piece.alias("s")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["s"]), "")
    first = F.when(F.col("parts").isNull(), F.col("b") + 1).otherwise(F.col("parts")[0]["lo"])
    out = ranges.select("range_id", F.col("start").alias("a"), F.col("end").alias("b")).join(parts, "range_id", "left")
    left = F.repeat(F.lit(default), (first - F.col("a")).cast("int"))
    return out.select("range_id", F.rpad(F.concat(left, F.coalesce(text, F.lit(""))), (F.col("b") - F.col("a") + 1).cast("int"), default).alias("seq"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, feature, start, end, strand, gene_id, gene_name)."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(p.alias("p")).where("size(p) >= 9")
    field = lambda k: F.regexp_extract(F.col("p")[8], rf'{k} "([^"]*)"', 1)
    return rows.select(F.col("p")[0].alias("chromosome"), F.col("p")[2].alias("feature"), F.col("p")[3].cast("long").alias("start"), F.col("p")[4].cast("long").alias("end"), F.col("p")[6].alias("strand"), field("gene_id").alias("gene_id"), field("gene_name").alias("gene_name"))


def gene_location(position: Column, strand: Column, start: Column, end: Column, in_exon: Column) -> Column:
    """Our classes of a position against its nearest gene: upstream, downstream, exon or intron."""
    before = F.when(strand == "-", position > end).otherwise(position < start)
    outside = (position < start) | (position > end)
    return F.when(outside & before, "upstream").when(outside, "downstream").when(in_exon, "exon").otherwise("intron")


def _vcf(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(p.alias("p"))
    return rows.select(F.col("p")[0].alias("chromosome_1"), F.col("p")[1].cast("long").alias("position_1"), F.col("p")[2].alias("id"), F.col("p")[4].alias("alt"), F.col("p")[7].alias("info"))


def _info(key: str) -> Column:
    return F.regexp_extract("info", rf"(?:^|;){key}=([^;]*)", 1)


def read_vcf_connections(spark: SparkSession, path: str) -> DataFrame:
    """Breakpoints of a VCF whose CT field gives connections such as 3to5; 3 is the + strand."""
    rows = _vcf(spark, path)
    side = lambda i: F.when(F.regexp_extract(_info("CT"), r"^([35])to([35])", i) == "3", "+").otherwise("-")
    other = F.when(_info("CHR2") != "", _info("CHR2")).otherwise(F.col("chromosome_1"))
    return rows.select("id", "chromosome_1", side(1).alias("strand_1"), "position_1", other.alias("chromosome_2"), side(2).alias("strand_2"), _info("END").cast("long").alias("position_2"))


def read_vcf_strands(spark: SparkSession, path: str) -> DataFrame:
    """Breakpoints of a VCF with STRANDS entries such as +-:5,-+:2, one row each (suffix _A, _B); secondary records are skipped."""
    rows = _vcf(spark, path).where(~F.col("info").rlike(r"(^|;)SECONDARY($|;)"))
    mate = r"[\[\]]([^\[\]:]+):(\d+)[\[\]]"
    bnd = F.regexp_extract("alt", mate, 1) != ""
    c2 = F.when(bnd, F.regexp_extract("alt", mate, 1)).otherwise(F.col("chromosome_1"))
    p2 = F.when(bnd, F.regexp_extract("alt", mate, 2)).otherwise(_info("END")).cast("long")
    each = rows.select("*", c2.alias("chromosome_2"), p2.alias("position_2"), F.posexplode(F.split(_info("STRANDS"), ",")).alias("k", "strands"))
    return each.select(F.concat("id", F.lit("_"), F.chr(F.col("k") + 65)).alias("id"), "chromosome_1", valid_strand(F.substring("strands", 1, 1)).alias("strand_1"), "position_1", "chromosome_2", valid_strand(F.substring("strands", 2, 1)).alias("strand_2"), "position_2")


def write_stats(stats: DataFrame, path: str) -> None:
    """(type, key, value) with a header."""
    write_tsv(stats.select("type", "key", "value"), path, header=True)

