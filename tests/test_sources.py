import gzip
import struct
import zlib

from pyspark.sql import functions as F

from svspark.sources import bam, text
from svspark.streaming import mates


def _file(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content)
    return str(path)


def test_fastq_round_trip(spark, tmp_path):
    reads = [("r%d" % i, e, "ACGT" * (i + 1), "c" if e else "", "@" * 4 * (i + 1)) for i in range(5) for e in (0, 1)]
    df = spark.createDataFrame(reads, "fragment string, read_end int, seq string, comment string, qual string")
    text.write_fastq(df, str(tmp_path / "out"))
    assert sorted(map(tuple, text.read_fastq(spark, str(tmp_path / "out")).collect())) == sorted(reads)


def test_fasta_tiles_and_fetch(spark, tmp_path):
    path = _file(tmp_path, "g.fa", ">1 first\nACGTACGTAC\nGGGGGTTTTT\nCC\n>X other\nTTTTTTTTTT\nAA\n")
    tiles = text.read_fasta(spark, path)
    assert {(r.chromosome, r.start, r.seq) for r in tiles.collect()} == {("1", 1, "ACGTACGTAC"), ("1", 11, "GGGGGTTTTT"), ("1", 21, "CC"), ("X", 1, "TTTTTTTTTT"), ("X", 11, "AA")}
    ranges = spark.createDataFrame([(0, "1", 8, 13), (1, "1", 21, 25), (2, "X", -1, 3), (3, "9", 1, 2), (4, "1", 1, 22)], "range_id int, chromosome string, start long, end long")
    assert {r.range_id: r.seq for r in text.fetch(tiles, ranges, 10).collect()} == {0: "TACGGG", 1: "CCNNN", 2: "NNTTT", 3: "NN", 4: "ACGTACGTACGGGGGTTTTTCC"}


def test_sam_and_small_tables(spark, tmp_path):
    sam = "@HD\tVN:1\nr1/1\t16\t1\t100\t30\t4S6M\t*\t0\t0\tACGTACGTAC\t*\nr2\t128\tX\t5\t0\t4M\t*\t0\t0\tACGT\t*\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n"
    got = text.read_sam(spark, _file(tmp_path, "a.sam", sam)).orderBy("read_id").collect()
    assert [(r.read_id, r.read_end, r.chromosome, r.strand, r.position, r.end) for r in got] == [("r1", 0, "1", "-", 100, 109), ("r2", 1, "X", "+", 5, 8)]
    from svspark.functions.seq import soft_clipped

    assert text.read_sam(spark, str(tmp_path / "a.sam")).select(soft_clipped(F.col("cigar")).alias("n")).agg(F.sum("n")).first()[0] == 4
    assert text.read_regions(spark, _file(tmp_path, "r", "1\t5\t9\tx\n")).collect()[0] == ("1", 5, 9)
    assert text.read_fai(spark, _file(tmp_path, "f", "1\t500\t3\n")).collect()[0] == ("1", 500)
    assert text.read_bedgraph(spark, _file(tmp_path, "b", "1\t0\t5\t300.5\n")).collect()[0].value == 255
    assert text.read_dgv(spark, _file(tmp_path, "d", "a\tb\tc\td\te\nv1\t3\t10\t20\tx\n")).collect()[0] == ("v1", "3", 10, 20)
    gtf = '1\tsrc\texon\t5\t9\t.\t-\t.\tgene_id "G1"; gene_name "N";\n#x\n'
    assert text.read_gtf(spark, _file(tmp_path, "g", gtf)).collect()[0] == ("1", "exon", 5, 9, "-", "G1", "N")


def test_vcf_dialects(spark, tmp_path):
    one = "#h\n1\t100\td1\tN\t<DEL>\t.\tPASS\tCHR2=2;END=900;CT=3to5\n"
    assert tuple(text.read_vcf_connections(spark, _file(tmp_path, "a.vcf", one)).collect()[0]) == ("d1", "1", "+", 100, "2", "-", 900)
    two = "1\t100\tl1\tN\tN]5:777]\t.\t.\tSTRANDS=++:3,--:2\n1\t5\tl2\tN\t<X>\t.\t.\tSECONDARY;STRANDS=+-:1\n"
    got = text.read_vcf_strands(spark, _file(tmp_path, "b.vcf", two)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("l1_A", "1", "+", 100, "5", "+", 777), ("l1_B", "1", "-", 100, "5", "-", 777)]


def test_tsv_nulls_and_booleans(spark, tmp_path):
    df = spark.createDataFrame([(1, None, True), (2, "X", False)], "a int, b string, c boolean")
    text.write_tsv(df, str(tmp_path / "t"), header=True, na="NA")
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert "1\tNA\tTrue" in lines and "2\tX\tFalse" in lines
    back = text.read_tsv(spark, str(tmp_path / "t"), "a int, b string, c boolean", header=True, null="NA")
    assert sorted(map(tuple, back.collect())) == [(1, None, True), (2, "X", False)]


def test_bam(spark, tmp_path):
    def rec(name, flag, ref, pos, seq, tags=b""):
        body = struct.pack("<iiIIiiii", ref, pos, 30 << 8 | len(name) + 1, flag << 16 | 1, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack("<I", len(seq) << 4)
        codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        body += bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + bytes([20] * len(seq)) + tags
        return struct.pack("<i", len(body)) + body

    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 1000)
    data = head + rec("a", 16, 0, 99, "ACGTA", b"NMi\x01\0\0\0CBZcell\0") + rec("b", 0, -1, -1, "AC")
    (tmp_path / "x.bam").write_bytes(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    rows = sorted(bam.read_bam(spark, str(tmp_path / "x.bam")).collect())
    assert (rows[0].name, rows[0].flag, rows[0].chromosome, rows[0].position, rows[0].cigar, rows[0].seq, rows[0].qual, rows[0].barcode) == ("a", 16, "1", 100, "5M", "ACGTA", "55555", "cell")
    assert rows[1].chromosome is None and zlib.crc32(b"") == 0


def test_stream_equals_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(d).schema
    import os

    os.makedirs(tmp_path / "in")
    os.symlink(d, tmp_path / "in" / "e.parquet")
    batch = {tuple(r) for r in mates.window_counts(spark.read.parquet(d)).collect()}
    stream = mates.window_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), delay="400 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.sql("select * from w").collect()} == batch
    finally:
        q.stop()
