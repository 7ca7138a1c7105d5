"""Readers and writers, and the commands from file to file."""

import gzip
import random

from pyspark.sql import functions as F

from isoloom import __main__ as cli
from isoloom.operators import intervals, junctions, transcripts
from isoloom.schema import ALIGNMENT
from isoloom.sources import bam, text
from isoloom.streaming.junctions import running_counts

SAM = """@HD\tVN:1.6
@SQ\tSN:chr1\tLN:1000
@SQ\tSN:chr2\tLN:500
r1\t2\tchr1\t101\t60\t5S10M100N2M50N3D20M\t*\t0\t0\tAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA\t*\tNM:i:1\tXS:A:-\tNH:i:1
r2\t18\tchr2\t1\t60\t10M30N10M\t*\t0\t0\tAAAAAAAAAAAAAAAAAAAA\t*\tNH:i:2
r3\t4\t*\t0\t0\t*\t*\t0\t0\tAA\t*
"""

GTF = """# comment
chr1\ts\ttranscript\t101\t400\t.\t-\t.\tgene_id "g1"; transcript_id "t1";
chr1\ts\texon\t300\t400\t.\t-\t.\tgene_id "g1"; transcript_id "t1";
chr1\ts\texon\t101\t110\t.\t-\t.\tgene_id "g1"; transcript_id "t1"; ref_gene_id "x";
chr2\ts\ttranscript\t1\t50\t.\t+\t.\tgene_id "g2"; gene_name "N"; transcript_id "t2";
chr2\ts\texon\t1\t50\t.\t+\t.\tgene_id "g2"; gene_name "N"; transcript_id "t2";
chrUn\ts\ttranscript\t5\t50\t.\t+\t.\tgene_id "g3"; transcript_id "t3";
chrUn\ts\texon\t5\t50\t.\t+\t.\tgene_id "g3"; transcript_id "t3";
"""


def put(folder, name, content):
    path = folder / name
    path.write_bytes(gzip.compress(content.encode()) if name.endswith(".gz") else content.encode())
    return str(path)


def test_sam(spark, tmp_path):
    rows = text.sam(spark, put(tmp_path, "a.sam", SAM)).orderBy("ord").collect()
    assert [(r["qname"], r["flag"], r["tid"], r["chr"], r["pos"], r["l_qseq"], r["nm"], r["xs"], r["nh"]) for r in rows] == [("r1", 2, 0, "chr1", 100, 37, 1, "-", 1), ("r2", 18, 1, "chr2", 0, 20, None, None, 2), ("r3", 4, None, "*", -1, 2, None, None, None)]


def test_gtf(spark, tmp_path):
    lines = text.gtf(spark, put(tmp_path, "a.gtf.gz", GTF))
    tx = {r["transcript_id"]: r for r in transcripts.assemble(lines, partition=["file"]).collect()}
    assert set(tx) == {"t1", "t3"}  # one exon is too few, except at the end
    assert (tx["t1"]["start"], tx["t1"]["end"], tx["t1"]["is_rev"], tx["t1"]["gene_name"]) == (101, 400, 1, "g1")
    order = transcripts.sort_lines(lines, ["file"]).collect()
    assert [r["rank"] for r in order] == [1, 1, 1, 2, 2, 26, 26]


def test_fasta_and_fastq(spark, tmp_path):
    fa = text.fasta(spark, put(tmp_path, "a.fa.gz", ">chr1 first one\nACGT\nAC\n>chr2\nGGG\n"))
    assert sorted(map(tuple, fa.collect())) == [("chr1", "ACGTAC"), ("chr2", "GGG")]
    fq = text.fastq(spark, put(tmp_path, "a.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\nII\n"))
    assert sorted((r["name"], r["seq"]) for r in fq.collect()) == [("r1", "ACGT"), ("r2", "GG")]


def test_star(spark, tmp_path):
    rows = text.star_junctions(spark, put(tmp_path, "SJ.out.tab", "chr1\t10\t20\t1\t1\t1\t5\t6\t7\nchr1\t30\t40\t0\t0\t0\t1\t0\t9\n")).collect()
    assert [(r["start"], r["is_rev"], r["uniq"]) for r in rows] == [(10, 0, 5), (30, None, 1)]


def test_samples():
    assert text.samples("a,b:c") == [["a", "b"], ["c"]]
    assert text.sample_list("2\n2\na\nb\n1\nc\n") == [["a", "b"], ["c"]]
    for bad in ("0", "1 0", "1 2 a"):
        try:
            text.sample_list(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_bam_round_trip(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    sam = text.sam(spark, put(tmp_path, "a.sam", SAM))
    rows = sam.select(*[c.split()[0] for c in ALIGNMENT.split(", ")])
    out = str(tmp_path / "out")
    rows.coalesce(1).orderBy("ord").write.format("bam").mode("append").option("header", "chr1:1000,chr2:500").save(out)
    back = spark.read.format("bam").load(out)
    pick = ["qname", "flag", "tid", "pos", "l_qseq", "cigar", "nm", "xs", "nh"]
    assert [tuple(r) for r in back.orderBy("ord").select(*pick).collect()][:2] == [tuple(r) for r in rows.orderBy("ord").select(*pick).collect()][:2]
    assert back.where("flag = 4").select("tid").first()[0] == -1


def test_commands(spark, tmp_path):
    sam, gtf = put(tmp_path, "a.sam", SAM), put(tmp_path, "a.gtf", GTF)
    cli.main(["junctions", sam, str(tmp_path / "sj")], spark)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "sj/rows")).collect()) == ["chr1\t111\t210\t0\t1\t1\t0\t0", "chr1\t213\t262\t0\t1\t1\t0\t0", "chr2\t11\t40\t0\t1\t0\t1\t0"]
    cli.main(["transcripts", sam, str(tmp_path / "gtf")], spark)
    assert spark.read.text(str(tmp_path / "gtf")).count() == 6
    cli.main(["filter", sam, gtf, str(tmp_path / "kept")], spark)
    kept = [r[0] for r in spark.read.text(str(tmp_path / "kept")).collect()]
    assert kept[:3] == SAM.splitlines()[:3] and [x.split("\t")[0] for x in kept[3:]] == ["r2.path1"]
    assert {(r["tid"], r["chr"]) for r in text.sam_header(spark, str(tmp_path / "kept")).collect()} == {(0, "chr1"), (1, "chr2")}
    cli.main(["novel", sam, gtf, "-o", str(tmp_path / "novel")], spark)
    cli.main(["sort", gtf, str(tmp_path / "sorted")], spark)
    assert spark.read.text(str(tmp_path / "sorted")).count() == 7


def test_motif(spark):
    rows = spark.createDataFrame([(0, "chr1", 3, 8, 1), (0, "chr1", 2, 8, 1), (0, "chr9", 3, 8, 1)], "tid int, chr string, don int, acc int, uniq int")
    genome = spark.createDataFrame([("chr1", "aactacgcaa")], "chr string, seq string")
    got = {(r["chr"], r["don"]): (r["motif"], r["strand"]) for r in junctions.with_motif(rows, genome).collect()}
    assert got == {("chr1", 3): (4, 2), ("chr1", 2): (0, 0), ("chr9", 3): (0, 0)}


def test_strand_conflict(spark):
    rows = spark.createDataFrame([(0, "c", 1, 9, 1, 1, 0), (0, "c", 1, 9, 2, 0, 0), (0, "c", 2, 9, 2, 1, 0)], "tid int, chr string, don int, acc int, strand int, uniq int, motif int")
    assert sorted((r["don"], r["strand"], r["uniq_c"], r["multi_c"]) for r in junctions.count(rows).collect()) == [(1, 0, 1, 1), (2, 2, 1, 0)]


def test_intervals(spark):
    rows = spark.createDataFrame([(0, 1, 50), (0, 40, 100), (0, 101, 120), (1, 1, 5)], "tid int, start int, end int")
    blocks = intervals.union(rows, ["tid"])
    assert sorted(map(tuple, blocks.collect())) == [(0, 1, 100), (0, 101, 120), (1, 1, 5)]
    points = spark.createDataFrame([(0, 60), (0, 1), (0, 101), (0, 500)], "tid int, point int")
    assert sorted(map(tuple, intervals.split(blocks, points, ["tid"]).collect())) == [(0, 1, 59), (0, 60, 100), (0, 101, 120), (1, 1, 5)]


def test_gene_fusion_is_strict(spark):
    schema = "ord long, tid int, start int, end int, is_rev int, gene_id string, gene_name string"
    rows = [(0, 0, 1, 100, 0, "a", "A"), (1, 0, 100, 200, 1, "b", "B"), (2, 1, 1, 100, 0, "c", "C"), (3, 1, 99, 200, 1, "d", "D")]
    got = transcripts.fuse_genes(spark.createDataFrame(rows, schema)).collect()
    assert [(r["tid"], r["start"], r["end"], r["gene_id"]) for r in got] == [(0, 1, 100, "a"), (0, 100, 200, "b"), (1, 1, 200, "c")]


def test_files_of_one_folder(spark, tmp_path):
    folder = tmp_path / "two files"
    folder.mkdir()
    put(folder, "a.sam", SAM)
    put(folder, "b.sam.gz", SAM.replace("@SQ\tSN:chr1\tLN:1000\n", "@SQ\tSN:chr3\tLN:70\n").replace("chr1", "chr3"))
    rows = text.sam(spark, str(folder)).collect()
    assert len(rows) == 6 and len({r["ord"] for r in rows}) == 6
    assert [(r["qname"], r["chr"], r["tid"]) for r in sorted(rows, key=lambda r: r["ord"])] == [("r1", "chr1", 0), ("r2", "chr2", 1), ("r3", "*", None), ("r1", "chr3", 2), ("r2", "chr2", 1), ("r3", "*", None)]
    put(folder, "c.sam", "@SQ\tSN:chr1\tLN:7\n")
    try:
        text.sam_header(spark, str(folder)).collect()
        raise AssertionError("lengths that differ")
    except Exception as e:
        assert "disagree" in str(e)


def test_order_key_over_splits(spark, tmp_path):
    put(tmp_path, "a.txt", "".join(f"a{k}\n" for k in range(4000)))
    put(tmp_path, "b.txt", "".join(f"b{k}\n" for k in range(700)))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        rows = text.ordered_lines(spark, str(tmp_path / "*.txt")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert [r["value"] for r in sorted(rows, key=lambda r: r["ord"])] == [f"a{k}" for k in range(4000)] + [f"b{k}" for k in range(700)]
    assert len({r["ord"] for r in rows}) == 4700


def test_sequence_grammar(spark, tmp_path):
    fa = text.fasta(spark, put(tmp_path, "b.fa", ">chr1 A>B variant\r\nAC\r\n\r\nGT\r\n>chr2\n>chr3 x\nGG"))
    assert sorted(map(tuple, fa.collect())) == [("chr1", "ACGT"), ("chr2", ""), ("chr3", "GG")]
    fq = text.fastq(spark, put(tmp_path, "b.fq", "junk\n@a one\nACGT\n+\n@III\n@b\nAC\nGT\n+b\n@@\n+I\n>c\nTT\n@d\n\n+\n"))
    assert sorted((r["name"], r["seq"], r["qual"]) for r in fq.collect() if r["name"] != "d") == [("a", "ACGT", "@III"), ("b", "ACGT", "@@+I"), ("c", "TT", None)]


def test_genome_tiles(spark):
    seq = "".join("ACGT"[k * k % 7 % 4] for k in range(25))
    tiles = text.genome_tiles(spark.createDataFrame([("c", seq)], "chr string, seq string"), 8).orderBy("tile").collect()
    assert [(r["tile"], r["piece"]) for r in tiles] == [(k, seq[8 * k : 8 * k + 9]) for k in range(4)]


def test_motif_at_tile_edges(spark):
    n = text.TILE
    seq = "A" * (n - 1) + "GT" + "C" * (n - 3) + "AG" + "T" * 10
    rows = spark.createDataFrame([(0, "c", n, 2 * n - 1, 1), (0, "c", n, 9 * n, 1)], "tid int, chr string, don int, acc int, uniq int")
    got = {r["acc"]: (r["motif"], r["strand"]) for r in junctions.with_motif(rows, spark.createDataFrame([("c", seq)], "chr string, seq string")).collect()}
    assert seq[n - 1 : n + 1] == "GT" and seq[2 * n - 3 : 2 * n - 1] != "" and got[9 * n] == (0, 0)
    at = seq.index("AG", n) + 2
    exact = spark.createDataFrame([(0, "c", n, at, 1)], "tid int, chr string, don int, acc int, uniq int")
    assert [(r["motif"], r["strand"]) for r in junctions.with_motif(exact, spark.createDataFrame([("c", seq)], "chr string, seq string")).collect()] == [(1, 1)]


def _bam(path, refs, names, text_head=""):
    """A BAM file whose records have bases, qualities, a mate and a tag of their own."""
    import struct

    head = text_head.encode()
    out = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(refs))
    for n, size in refs:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    for k, name in enumerate(names):
        body = struct.pack("<iiBBHHHiiii", k % len(refs), 10 + k, len(name) + 1, 37, 4680, 1, 2, 4, k % len(refs), 90, 100) + name.encode() + b"\0"
        body += struct.pack("<I", 4 << 4) + bytes([0x12, 0x48]) + bytes([30, 31, 32, 33]) + b"NMi" + struct.pack("<i", 0) + b"RGZgrp\0"
        out += struct.pack("<i", len(body)) + body
    path.write_bytes(bam.bgzf(out) + bam.END_BLOCK)


def test_bam_files_keep_all(spark, tmp_path):
    spark.dataSource.register(bam.BamSource)
    folder = tmp_path / "in"
    folder.mkdir()
    _bam(folder / "a.bam", [("c1", 100), ("c2", 200)], ["x", "y"], "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:100\tM5:q\n@SQ\tSN:c2\tLN:200\n@PG\tID:p\n")
    _bam(folder / "b.bam", [("c2", 200), ("c3", 300)], ["x", "z", "z"])
    rows = spark.read.format("bam").load(str(folder))
    got = sorted(rows.collect(), key=lambda r: r["ord"])
    assert [(r["qname"], r["chr"], r["tid"], r["file"][-5:]) for r in got] == [("x", "c1", 0, "a.bam"), ("y", "c2", 1, "a.bam"), ("x", "c2", 1, "b.bam"), ("z", "c3", 2, "b.bam"), ("z", "c2", 1, "b.bam")]
    assert len({r["ord"] for r in got}) == 5
    gtf = put(tmp_path, "m.gtf", GTF)
    out = str(tmp_path / "kept")
    for _ in range(2):  # the second run replaces the first
        cli.main(["filter", str(folder) + "/*.bam", gtf, out, "-v", "0.1"], spark)
    back = sorted(spark.read.format("bam").load(out).collect(), key=lambda r: r["ord"])
    assert [(r["qname"], r["chr"]) for r in back] == [("x.path1", "c1"), ("y.path1", "c2"), ("x.path1", "c2")]
    assert bam.references(out) == [("c1", 100), ("c2", 200), ("c3", 300)]
    assert bam.header_text(out).startswith("@HD\tVN:1.6\n@SQ\tSN:c1\tLN:100\tM5:q\n") and "@PG\tID:p" in bam.header_text(out)
    raw = bytes(back[2]["raw"])
    name = b"x.path1\0"
    assert raw[32 : 32 + len(name)] == name and raw[9] == 37 and raw.endswith(b"RGZgrp\0") and bytes([0x12, 0x48, 30, 31, 32, 33]) in raw
    assert int.from_bytes(raw[20:24], "little") == 1  # the mate's sequence has its new number


def test_limits_on_the_command_line(spark, tmp_path):
    sam = put(tmp_path, "a.sam", SAM)
    cli.main(["junctions", sam, str(tmp_path / "u"), "-U", "1,1,1,1,1"], spark)
    assert spark.read.text(str(tmp_path / "u/rows")).count() == 2
    cli.main(["junctions", sam, str(tmp_path / "n"), "-A", "2,2,2,2,2"], spark)
    assert spark.read.text(str(tmp_path / "n/rows")).count() == 0
    cli.main(["junctions", sam, str(tmp_path / "a"), "-a", "20,1,1,1,1"], spark)
    assert spark.read.text(str(tmp_path / "a/rows")).count() == 0


def test_junction_file_as_table(spark, tmp_path):
    path = put(tmp_path, "SJ.out.tab", "b\t30\t40\t0\t0\t0\t1\t0\t9\na\t10\t20\t1\t1\t1\t5\t6\t7\na\t10\t15\t2\t1\t1\t5\t6\t7\n")
    header = spark.createDataFrame([(0, "a", 1), (1, "b", 1)], "tid int, chr string, len long")
    rows = text.star_table(text.star_junctions(spark, path, header)).collect()
    assert [tuple(r) for r in rows] == [(0, "a", 10, 15, 2, 1, 5, 6, 1, 7), (0, "a", 10, 20, 1, 1, 5, 6, 1, 7), (1, "b", 30, 40, 0, 0, 1, 0, 0, 9)]


def test_streaming_counts(spark, tmp_path):
    rows = text.sam(spark, put(tmp_path, "a.sam", SAM)).select(*[c.split()[0] for c in ALIGNMENT.split(", ")])
    rows.write.parquet(str(tmp_path / "in/1"))
    rows.write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = running_counts(stream).writeStream.outputMode("complete").format("memory").queryName("sj").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sj").agg(F.sum("uniq_c"), F.sum("multi_c")).first() == (4, 2)


def test_tiles_from_lines(spark, tmp_path):
    """Lines of any length, blank ones, records that fill tiles to the letter, in chunks that cut records."""
    import random

    rng, seqs, lines = random.Random(5), {}, []
    for k, n in enumerate([0, 1, 15, 16, 17, 32, 33, 200]):
        seq, at = "".join(rng.choice("ACGTn") for _ in range(n)), 0
        seqs[f"c{k}"] = seq
        lines.append(f">c{k} note >x")
        while at < n:
            step = rng.choice([1, 5, 16, 40])
            lines.append(seq[at : at + step] + rng.choice(["", " ", "\r"]))
            lines += [""] * rng.randrange(2)
            at += step
    path = put(tmp_path, "a.fa", "\n".join(lines) + "\n")
    expected = {(c, t): s[t * 16 : t * 16 + 17] for c, s in seqs.items() for t in range(-(-len(s) // 16))}
    for chunk in (30, 1 << 20):
        got = {(r["chr"], r["tile"]): r["piece"] for r in text.fasta_tiles(spark, path, 16, chunk).collect()}
        assert got == expected
    whole = {(r["chr"], r["tile"]): r["piece"] for r in text.genome_tiles(text.fasta(spark, path), 16).collect()}
    assert whole == expected


def test_a_sequence_named_twice_is_an_error(spark, tmp_path):
    path = put(tmp_path, "b.fa", ">a\nACGT\n>b\nGG\n>a\nTT\n")
    try:
        text.fasta_tiles(spark, path).collect()
        raise AssertionError
    except Exception as e:
        assert "two sequences are named a" in str(e)


def test_sample_lists(spark):
    rows = spark.createDataFrame([("x", "2\n2\na\nb\n1\nc\n")], "id string, text string")
    got = sorted((r["sample"], r["replicate"], r["path"]) for r in text.sample_lists(rows).collect())
    assert got == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    for bad in ("0", "1 0", "1 2 a", "", "2 1 a"):
        try:
            text.sample_lists(spark.createDataFrame([("x", bad)], "id string, text string")).collect()
            raise AssertionError(bad)
        except Exception as e:
            assert "not whole" in str(e), bad


def test_genome_lines_are_read_once(spark, tmp_path):
    """Order keys depend on the splits, so tiles must not mix several readings; once four scans of the file did."""
    rng = random.Random(5)
    seqs = {f"c{k}": "".join(rng.choices("ACGTn", k=n)) for k, n in enumerate((0, 1, 4096, 4097, 150_000, 60))}
    lines = []
    for name, s in seqs.items():
        lines += [f">{name} a>b", *(s[i : i + 50] + rng.choice(["", " "]) for i in range(0, len(s), 50)), ""]
    path = put(tmp_path, "g.fa", "\r\n".join(["ACGT", *lines, ">long", seqs["c4"] * 2]))
    seqs["long"] = seqs["c4"] * 2
    expected = {(c, t): s[t * 64 : t * 64 + 65] for c, s in seqs.items() for t in range(-(-len(s) // 64))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        tiles = text.fasta_tiles(spark, path, 64)
        assert {(r["chr"], r["tile"]): r["piece"] for r in tiles.collect()} == expected
        plan = tiles._jdf.queryExecution().optimizedPlan().toString()
        assert "text" not in plan.lower().split()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_motifs_of_ends_with_few_bases(spark):
    """Motifs go by numbers of two bases; a side at the sequence's end has fewer, one beyond it none. Counts are worked
    out once, as they are read twice."""
    genome = spark.createDataFrame([("c", "aGTccAGxCTnACGCaagG")], "chr string, seq string")
    rows = spark.createDataFrame([(0, "c", 2, 7), (0, "c", 9, 13), (0, "c", 14, 18), (0, "c", 2, 20), (0, "c", 2, 99), (0, "d", 2, 7)], "tid int, chr string, don int, acc int")
    got = {(r["chr"], r["don"], r["acc"]): (r["motif"], r["strand"]) for r in junctions.with_motif(rows, genome).collect()}
    assert got == {("c", 2, 7): (1, 1), ("c", 9, 13): (2, 2), ("c", 14, 18): (3, 1), ("c", 2, 20): (0, 0), ("c", 2, 99): (0, 0), ("d", 2, 7): (0, 0)}
    aln = spark.createDataFrame([("q", 2, 0, "c", 0, [("M", 1), ("N", 6), ("M", 4)], 1)], "qname string, flag int, tid int, chr string, pos int, cigar array<struct<op:string,len:int>>, nh int")
    table = junctions.table(aln, genome)
    assert [(r["don"], r["acc"], r["motif"], r["uniq_c"]) for r in table.collect()] == [(2, 7, 1, 1)]
    assert "nh#" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_each_tag_is_sought_once(spark):
    """Empty, absent and partly like tags; a line is searched once a tag (once it was twice, and again for each fallback)."""
    attributes = ['gene_id "g1"; transcript_id "t1";', 'xgene_id "no"; gene_id "";', 'my.gene_name "no";gene_name="n";transcript_name "a" transcript_name "b"', "gene_id g1", 'gene_id\t"g"', "", ' gene_id "x;y"']
    lines = spark.createDataFrame([(k, f"c\ts\texon\t1\t2\t.\t-\t.\t{a}") for k, a in enumerate(attributes)] + [(90, "c\ts\texon\t1\t2"), (91, "c\ts\texon\t1"), (92, "#c\ts\texon\t1\t2")], "ord long, value string")
    rows = text.parse_gtf(lines)
    got = {r["ord"]: (r["gene_id"], r["gene_name"], r["transcript_id"], r["transcript_name"]) for r in rows.collect()}
    no = (None,) * 4
    assert got == {0: ("g1", "g1", "t1", "g1"), 1: ("",) * 4, 2: (None, "n", "a", "a"), 3: no, 4: no, 5: no, 6: ("x;y",) * 4, 90: no}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 4 and "RLIKE" not in plan
