"""Registered queries of the transcript and junction operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoloom import views
from isoloom.functions import attributes as at
from isoloom.functions import cigar as cg
from isoloom.functions import strings
from isoloom.operators import details, filtering, intervals, junctions, novelty, transcripts
from isoloom.operators.scans import numbered
from isoloom.plans import commands
from isoloom.schema import ExonParams, FilterParams, JunctionParams, UpdateParams
from isoloom.sources import sinks, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EX = f"ex AS ({views.EXON})"
TX = f"""{EX}, tx AS (SELECT tx, any_value(tid) AS tid, any_value(is_rev) AS is_rev, min(s) AS s0, max(e) AS e0, count(*) AS n FROM ex GROUP BY tx),
it AS (SELECT a.tx, a.tid, a.is_rev, a.k AS i, a.s AS ls, a.e AS le, b.s AS rs, b.e AS re FROM ex a JOIN ex b ON a.tx = b.tx AND b.k = a.k + 1)"""
AL = f"""a0 AS ({views.ALIGNED}), al AS (SELECT *, h % 25 AS tid, CAST(floor(h/3) AS BIGINT) AS pos, l_qseq - clip5 - clip3 AS qlen,
l_qseq - clip5 - clip3 - nm + del_len AS score, l_qseq - clip5 - clip3 + del_len + 100*intron_n AS rlen FROM a0)"""
OK = "unmapped = 0 AND CAST(qlen AS DOUBLE)/l_qseq >= CAST(CAST(0.67 AS REAL) AS DOUBLE) AND CAST(score AS REAL) >= CAST(0.75 AS REAL)*CAST(qlen AS REAL)"
MASK = f"mask AS ({views.MASK})"
BEST = """SELECT concat(qname, '.path', CAST(path AS VARCHAR)) AS qname, ord, CAST(score AS BIGINT) AS score, CAST(second AS BIGINT) AS second FROM (
 SELECT *, row_number() OVER (PARTITION BY qname ORDER BY ord) AS path, row_number() OVER (PARTITION BY qname ORDER BY score DESC, ord) AS rk,
 greatest(coalesce(lead(score) OVER (PARTITION BY qname ORDER BY score DESC, ord), 0), 0) AS second FROM ok) q
 WHERE rk = 1 AND CAST(second AS REAL) < CAST(0.98 AS REAL)*CAST(score AS REAL)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _tx(spark: SparkSession, d: str) -> DataFrame:
    return views.transcripts(spark, d)


def _aln(spark: SparkSession, d: str) -> DataFrame:
    return views.alignments_of(_tx(spark, d))


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return views.mask(spark, d)


def _junction_sql(more: str = "") -> str:
    return f"""WITH {TX} SELECT tid, concat('chr', CAST(tid+1 AS VARCHAR)) AS chr, CAST(le+1 AS BIGINT) AS don, CAST(rs-1 AS BIGINT) AS acc, 0 AS strand, 1 AS anno,
CAST(sum(1 - tx % 2) AS BIGINT) AS uniq_c, CAST(sum(tx % 2) AS BIGINT) AS multi_c, 0 AS motif FROM it WHERE tx % 5 <> 0 GROUP BY tid, le, rs {more}"""


# ---- junctions


@query(_junction_sql())
def junction_table(spark, d):
    return commands.junction_table(_aln(spark, d))


@query(_junction_sql("HAVING sum(1 - tx % 2) >= 2 AND count(*) >= 3"))
def sj_threshold(spark, d):
    return junctions.threshold(junctions.table(_aln(spark, d)), [2] * 5, [3] * 5)


@query(_junction_sql())
def sj_merge(spark, d):
    aln = _aln(spark, d)
    return junctions.merge(*[junctions.table(aln.where(F.col("ord") % 2 == k)) for k in (0, 1)])


@query(f"""WITH {TX} SELECT tid, le+1 AS don, rs-1 AS acc, CASE WHEN min(is_rev) = max(is_rev) THEN min(is_rev)+1 ELSE 0 END AS strand,
CAST(count(*) AS BIGINT) AS uniq_c FROM it GROUP BY tid, le, rs""")
def sj_strand_conflict(spark, d):
    one = JunctionParams(require_proper_pair=False)
    rows = _aln(spark, d).withColumn("nh", F.lit(1))
    both = [junctions.extract(rows.where(F.col("flag").bitwiseAND(16) == bit), one).withColumns({"strand": F.lit(s), "motif": F.lit(0)}) for bit, s in ((0, 1), (16, 2))]
    return junctions.count(both[0].unionByName(both[1])).select("tid", "don", "acc", "strand", "uniq_c")


_CODE = "upper(concat(substr(seq, CAST(le+1 AS INT), 2), substr(seq, CAST(rs-2 AS INT), 2)))"


@query(f"""WITH {TX}, g AS (SELECT repeat(string_agg(substr('ACGT', CAST(p_size % 4 + 1 AS INT), 1), '' ORDER BY p_partkey), 20) AS seq FROM part),
c AS (SELECT DISTINCT tid, le, rs, {_CODE} AS code FROM it, g WHERE tx % 5 <> 0)
SELECT tid, le+1 AS don, rs-1 AS acc, CASE code WHEN 'GTAG' THEN 1 WHEN 'CTAC' THEN 2 WHEN 'GCAG' THEN 3 WHEN 'CTGC' THEN 4 WHEN 'ATAC' THEN 5 WHEN 'GTAT' THEN 6 ELSE 0 END AS motif,
CASE WHEN code IN ('GTAG','GCAG','ATAC') THEN 1 WHEN code IN ('CTAC','CTGC','GTAT') THEN 2 ELSE 0 END AS strand FROM c""")
def sj_motif(spark, d):
    return junctions.table(_aln(spark, d), text.fasta_tiles(spark, views.genome_file(spark, d))).select("tid", "don", "acc", "motif", "strand")


# ---- alignments to transcripts


@query(f"WITH {EX} SELECT tx, tid, is_rev, s AS start, e AS \"end\" FROM ex")
def alignment_exons(spark, d):
    rows = transcripts.from_alignments(_aln(spark, d))
    return rows.select("tx", "tid", "is_rev", F.explode("exons").alias("x")).select("tx", "tid", "is_rev", "x.start", "x.end")


@query(f"WITH {TX} SELECT tx, tid, is_rev, s0 AS start, e0 AS \"end\", CAST(n AS INT) AS n_exons, concat('t', CAST(tx AS VARCHAR)) AS transcript_id FROM tx")
def alignment_transcripts(spark, d):
    return transcripts.from_alignments(_aln(spark, d)).select("tx", "tid", "is_rev", "start", "end", F.size("exons").alias("n_exons"), "transcript_id")


_ATTR = "concat('gene_id \"UNCLASSIFIED\"; transcript_id \"t', CAST(tx AS VARCHAR), '\";')"
_LINE = "concat_ws(chr(9), concat('chr', CAST(tid+1 AS VARCHAR)), 'NONE', {kind}, CAST({s} AS VARCHAR), CAST({e} AS VARCHAR), '.', CASE is_rev WHEN 1 THEN '-' ELSE '+' END, '.', " + _ATTR + ")"


@query(f"""WITH {TX} SELECT tx, 0 AS k, {_LINE.format(kind="'transcript'", s="s0", e="e0")} AS value FROM tx
UNION ALL SELECT tx, CAST(k+1 AS INT), {_LINE.format(kind="'exon'", s="s", e="e")} FROM ex""")
def gtf_lines(spark, d):
    return commands.transcript_lines(_aln(spark, d))


# ---- CIGAR arithmetic


@query(f"WITH {AL} SELECT ord, CAST(intron_n AS INT) AS introns, CAST(intron_n + 1 AS INT) AS matches, CAST(rlen AS INT) AS rlen, CAST(qlen AS INT) AS qlen, CAST(score AS INT) AS score FROM al")
def cigar_measures(spark, d):
    c = F.col("cigar")
    return views.grouped_alignments(spark, d).select("ord", cg.count_ops(c, "N").alias("introns"), cg.count_ops(c, "M").alias("matches"), cg.reference_length(c).cast("int").alias("rlen"), cg.aligned_query_length(c, F.col("l_qseq")).cast("int").alias("qlen"), cg.score(c, F.col("l_qseq"), F.col("nm")).cast("int").alias("score"))


@query(f"""WITH {AL} SELECT ord, concat(CASE WHEN clip5 > 0 THEN concat(CAST(clip5 AS VARCHAR), 'S') ELSE '' END, CAST(qlen - intron_n AS VARCHAR), 'M',
CASE WHEN del_len > 0 THEN concat(CAST(del_len AS VARCHAR), 'D') ELSE '' END, repeat('100N1M', CAST(intron_n AS INT)), CASE WHEN clip3 > 0 THEN concat(CAST(clip3 AS VARCHAR), 'S') ELSE '' END) AS cigar FROM al""")
def cigar_text(spark, d):
    once = cg.text(F.col("cigar"))
    return views.grouped_alignments(spark, d).select("ord", cg.text(cg.parse(once)).alias("cigar"))


# ---- alignment filter


@query(f"WITH {AL} SELECT ord, CAST(score AS INT) AS score, CAST(qlen AS INT) AS qlen FROM al WHERE {OK}")
def filter_confident(spark, d):
    return filtering.confident(views.grouped_alignments(spark, d)).select("ord", F.col("score").cast("int").alias("score"), F.col("qlen").cast("int").alias("qlen"))


@query(f"WITH {TX}, {AL}, {MASK} SELECT ord FROM al WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.tid = al.tid AND m.start <= al.pos + al.rlen - 1 AND m.e >= al.pos)")
def filter_rrna_anti(spark, d):
    return filtering.outside(views.grouped_alignments(spark, d), _mask(spark, d)).select("ord")


@query(ORACLE_SQL["filter_rrna_anti"])
def filter_rrna_bins(spark, d):
    """As filter_rrna_anti, by the way that larger masks take."""
    return filtering.outside(views.grouped_alignments(spark, d), _mask(spark, d), broadcast_rows=0).select("ord")


@query(f"WITH {AL}, ok AS (SELECT * FROM al WHERE {OK}) {BEST}")
def filter_best(spark, d):
    rows = filtering.best_of_names(filtering.confident(views.grouped_alignments(spark, d)))
    return rows.select("qname", "ord", F.col("score").cast("long").alias("score"), F.col("second").cast("long").alias("second"))


@query(f"WITH {AL}, ok AS (SELECT * FROM al WHERE {OK}) {BEST}")
def filter_islands(spark, d):
    """Runs of names in the order of the input, in chunks of 4096 rows whose edges cut many of them."""
    rows = filtering.confident(views.grouped_alignments(spark, d))
    return filtering.best(rows, chunk=4096).select("qname", "ord", F.col("score").cast("long").alias("score"), F.col("second").cast("long").alias("second"))


@query(f"""WITH {TX}, {AL}, {MASK}, ok AS (SELECT * FROM al WHERE {OK} AND NOT EXISTS (SELECT 1 FROM mask m WHERE m.tid = al.tid AND m.start <= al.pos + al.rlen - 1 AND m.e >= al.pos))
SELECT * FROM ({BEST} AND intron_n >= 1) z""")
def filter_full(spark, d):
    rows = commands.filter_alignments(views.grouped_alignments(spark, d), _mask(spark, d), FilterParams(min_introns=1))
    return rows.select("qname", "ord", F.col("score").cast("long").alias("score"), F.col("second").cast("long").alias("second"))


@query(f"WITH {AL} SELECT CAST(count(*) AS BIGINT) AS n_in, CAST(count(*) FILTER (WHERE {OK}) AS BIGINT) AS n_out, CAST(count(*) - count(*) FILTER (WHERE {OK}) AS BIGINT) AS filtered FROM al")
def filter_counters(spark, d):
    return filtering.counted(views.grouped_alignments(spark, d), filtering.confident)[1]


# ---- novelty

PAIRS = """p AS (SELECT r.tx AS r, a.tx AS a, r.n AS rn, a.n AS an, a.s0 AS as0, a.e0 AS ae0 FROM {reads} r JOIN tx a ON r.tid = a.tid AND r.is_rev = a.is_rev AND a.s0 <= r.e0 AND a.e0 >= r.s0
WHERE a.tx % 3 <> 0 AND a.n > 1)"""
CELLS = """c AS (SELECT p.r, p.a, x.i, y.i AS j, CASE WHEN abs(x.le - y.le) <= {d} THEN 1 ELSE 0 END AS l, CASE WHEN abs(x.rs - y.rs) <= {d} THEN 1 ELSE 0 END AS rr
FROM p JOIN {introns} x ON x.tx = p.r JOIN it y ON y.tx = p.a WHERE y.i = 0 OR y.ls <= x.rs),
h AS (SELECT r, a, i, j, lag(j) OVER (PARTITION BY r, a ORDER BY i, j) AS pj FROM c WHERE l = 1 AND rr = 1),
m AS (SELECT p.r, p.a, p.rn, p.as0, p.ae0, coalesce(q.iden_n, 0) AS iden_n, coalesce(q.iden_intron_n, 0) AS iden_intron_n, coalesce(z.bad, 0) AS bad FROM p
LEFT JOIN (SELECT r, a, sum(l + rr) AS iden_n, sum(l * rr) AS iden_intron_n FROM c GROUP BY r, a) q ON q.r = p.r AND q.a = p.a
LEFT JOIN (SELECT r, a, max(CASE WHEN pj IS NOT NULL AND j <> pj + 1 THEN 1 ELSE 0 END) AS bad FROM h GROUP BY r, a) z ON z.r = p.r AND z.a = p.a),
f AS (SELECT *, CASE WHEN iden_intron_n = rn - 1 AND bad = 0 THEN 1 ELSE 0 END AS ai FROM m)"""
READS = "(SELECT * FROM tx WHERE tx % 3 = 0 AND n > 1)"
KEPT = """rx AS (SELECT tx, tid, is_rev, CASE WHEN k > 1 THEN k - 1 ELSE k END AS k, CASE WHEN k = 1 THEN s ELSE s END AS s, CASE WHEN k = 1 THEN lead_e ELSE e END AS e
FROM (SELECT e1.*, lead(e) OVER (PARTITION BY tx ORDER BY k) AS lead_e FROM ex e1 WHERE tx % 3 = 1 AND tx IN (SELECT tx FROM tx WHERE n > 3)) q WHERE k <> 2),
rit AS (SELECT a.tx, a.k AS i, a.s AS ls, a.e AS le, b.s AS rs FROM rx a JOIN rx b ON a.tx = b.tx AND b.k = a.k + 1),
rtx AS (SELECT tx, any_value(tid) AS tid, any_value(is_rev) AS is_rev, min(s) AS s0, max(e) AS e0, count(*) AS n FROM rx GROUP BY tx)"""


def _chain(distance: int = 0) -> str:
    return f"{TX}, {PAIRS.format(reads=READS)}, {CELLS.format(d=distance, introns='it')}"


def _pairs(spark, d):
    tx = _tx(spark, d)
    return novelty.pairs(views.reads(tx), views.annotation(tx))


def _as_int(df: DataFrame, *names: str) -> list:
    return [F.col(n).cast("int").alias(n) for n in names]


@query(f"WITH {TX}, {PAIRS.format(reads=READS)} SELECT r AS tx, a AS r_tx FROM p")
def overlap_join(spark, d):
    return _pairs(spark, d).select("tx", "r_tx")


def _match_query(name: str, distance: int):
    sql = f"WITH {_chain(distance)} SELECT r AS tx, a AS r_tx, CAST(iden_n AS INT) AS iden_n, CAST(iden_intron_n AS INT) AS iden_intron_n, CAST(1 - bad AS INT) AS consecutive FROM m"

    def run(spark, d):
        rows = novelty.junction_match(_pairs(spark, d), distance)
        return rows.select("tx", "r_tx", *_as_int(rows, "iden_n", "iden_intron_n", "consecutive"))

    run.__name__ = name
    query(sql)(run)


_match_query("junction_match", 0)
_match_query("junction_match_tolerant", 20)


@query(f"WITH {TX}, {KEPT}, {PAIRS.format(reads='rtx')}, {CELLS.format(d=0, introns='rit')} SELECT r AS tx, a AS r_tx, CAST(iden_n AS INT) AS iden_n, CAST(iden_intron_n AS INT) AS iden_intron_n, CAST(1 - bad AS INT) AS consecutive, ai AS all_iden FROM f")
def intron_retention(spark, d):
    tx = _tx(spark, d)
    rows = novelty.pair_flags(novelty.junction_match(novelty.pairs(views.retained(tx), views.annotation(tx))))
    return rows.select("tx", "r_tx", *_as_int(rows, "iden_n", "iden_intron_n", "consecutive", "all_iden"))


_FLAGS = """g AS (SELECT r, max(ai) AS all_iden, max(CASE WHEN ai = 0 AND iden_n > 0 THEN 1 ELSE 0 END) AS novel, max(CASE WHEN ai = 0 AND iden_n = 0 THEN 1 ELSE 0 END) AS all_novel,
arg_max(concat('g', CAST(CAST(floor(a/7) AS BIGINT) AS VARCHAR)), struct_pack(s := as0, e := ae0, t := a)) FILTER (WHERE ai = 0 AND iden_n > 0) AS gene FROM f GROUP BY r)"""
_CLASS = "SELECT t.tx, coalesce(g.all_iden, 0) AS all_iden, coalesce(g.novel, 0) AS novel, coalesce(g.all_novel, 0) AS all_novel, g.gene AS gene_id FROM (SELECT * FROM tx WHERE tx % 3 = 0 AND n > 1) t LEFT JOIN g ON g.r = t.tx"


@query(f"WITH {_chain()}, {_FLAGS} {_CLASS}")
def novel_class(spark, d):
    tx = _tx(spark, d)
    rows = novelty.classify(views.reads(tx), views.annotation(tx))
    return rows.select("tx", *_as_int(rows, "all_iden", "novel", "all_novel"), F.col("new_gene_id").alias("gene_id"))


@query(f"WITH {_chain()}, {_FLAGS}, z AS ({_CLASS}) SELECT tx, CASE WHEN all_novel = 1 THEN 1 ELSE 0 END AS unclassified FROM z WHERE novel = 1 AND all_iden = 0")
def novel_emit(spark, d):
    tx = _tx(spark, d)
    rows = novelty.classify(views.reads(tx), views.annotation(tx), UpdateParams(keep_unclassified=True)).where("emit")
    return rows.select("tx", F.col("all_novel").cast("int").alias("unclassified"))


_ENDS = """b AS (SELECT p.r, p.a, max(CASE WHEN x.k = 0 AND y.k = 0 AND x.e = y.e THEN 1 ELSE 0 END) AS l1, max(CASE WHEN x.k = p.rn-1 AND y.k = p.an-1 AND x.s = y.s THEN 1 ELSE 0 END) AS r1,
max(CASE WHEN x.k = 0 AND y.k = 0 AND x.s <= y.e AND y.s <= x.e THEN 1 ELSE 0 END) AS l2, max(CASE WHEN x.k = p.rn-1 AND y.k = p.an-1 AND x.s <= y.e AND y.s <= x.e THEN 1 ELSE 0 END) AS r2,
max(CASE WHEN x.k = 0 AND x.s <= y.e AND y.s <= x.e THEN 1 ELSE 0 END) AS la, max(CASE WHEN x.k = p.rn-1 AND x.s <= y.e AND y.s <= x.e THEN 1 ELSE 0 END) AS ra
FROM p JOIN ex x ON x.tx = p.r JOIN ex y ON y.tx = p.a GROUP BY p.r, p.a)"""
_LEVELS = {1: "max(l1) = 1 AND max(r1) = 1", 2: "max(l2) = 1 AND max(r2) = 1", 3: "(max(l2) = 1 OR max(la) = 0) AND (max(r2) = 1 OR max(ra) = 0)", 4: "max(l2) = 1 OR max(la) = 0", 5: "true"}


def _full_query(level: int):
    sql = f"WITH {TX}, {PAIRS.format(reads=READS)}, {_ENDS} SELECT r AS tx, CASE WHEN {_LEVELS[level]} THEN 1 ELSE 0 END AS \"full\" FROM b GROUP BY r"

    def run(spark, d):
        tx = _tx(spark, d)
        pair = novelty.pair_flags(novelty.junction_match(novelty.pairs(views.reads(tx), views.annotation(tx))))
        flags = novelty.read_flags(views.reads(tx), pair, UpdateParams(full_level=level))
        met = pair.select("tx").distinct()
        return flags.join(met, "tx", "left_semi").select("tx", F.col("full").cast("int").alias("full"))

    run.__name__ = f"full_l{level}"
    query(sql)(run)


for _level in _LEVELS:
    _full_query(_level)


def _short(spark, d) -> DataFrame:
    """Short-read introns: those of every fourth transcript, one base longer at the end for every eighth."""
    tx = _tx(spark, d).where("tx % 4 = 1 AND size(exons) > 1")
    rows = tx.select("tx", "tid", "is_rev", F.explode(F.sequence(F.lit(0), F.size("exons") - 2)).alias("i"), "exons")
    return rows.select("tid", "is_rev", (F.get("exons", F.col("i"))["end"] + 1).alias("start"), (F.get("exons", F.col("i") + 1)["start"] - 1 + F.when(F.col("tx") % 8 == 1, 1).otherwise(0)).cast("int").alias("end"))


def _support_query(name: str, distance: int):
    sql = f"""WITH {_chain(distance)}, si AS (SELECT DISTINCT tid, is_rev, le+1 AS s, rs-1 + CASE WHEN tx % 8 = 1 THEN 1 ELSE 0 END AS e FROM it WHERE tx % 4 = 1),
u AS (SELECT p.r, p.a, x.tid, x.is_rev, x.le+1 AS s, x.rs-1 AS e FROM p JOIN it x ON x.tx = p.r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.r = p.r AND h.a = p.a AND h.i = x.i)),
w AS (SELECT u.r, u.a, min(CASE WHEN EXISTS (SELECT 1 FROM si WHERE si.tid = u.tid AND si.is_rev = u.is_rev AND si.s BETWEEN u.s - {distance} AND u.s AND abs(si.e - u.e) <= {distance}) THEN 1 ELSE 0 END) AS ok FROM u GROUP BY u.r, u.a)
SELECT p.r AS tx, p.a AS r_tx, CASE WHEN coalesce(w.ok, 1) = 1 AND EXISTS (SELECT 1 FROM si WHERE si.tid = t.tid AND si.e > t.s0) THEN 1 ELSE 0 END AS supported
FROM p JOIN tx t ON t.tx = p.r LEFT JOIN w ON w.r = p.r AND w.a = p.a"""

    def run(spark, d):
        tx, introns = _tx(spark, d), _short(spark, d)
        pair = novelty.pairs(novelty.with_short(views.reads(tx), introns, distance), views.annotation(tx))
        rows = novelty.short_support(novelty.junction_match(pair, distance), introns, distance)
        return rows.select("tx", "r_tx", F.col("supported").cast("int").alias("supported"))

    run.__name__ = name
    query(sql)(run)


_support_query("short_sj_support", 0)
_support_query("short_sj_support_tolerant", 1)


@query(f"""WITH {TX} SELECT tid, is_rev, chain, CAST(count(*) AS BIGINT) AS cov, min(s0) AS start, max(e0) AS "end" FROM (
SELECT tx.tid, tx.is_rev, tx.s0, tx.e0, (SELECT string_agg(concat(CAST(le AS VARCHAR), '-', CAST(rs AS VARCHAR)), ',' ORDER BY i) FROM it WHERE it.tx = tx.tx) AS chain FROM tx WHERE n > 1) q GROUP BY tid, is_rev, chain""")
def chain_merge(spark, d):
    return novelty.exact_chains(_tx(spark, d))


_SI = "si AS (SELECT DISTINCT tid, is_rev, le+1 AS s, rs-1 + CASE WHEN tx % 8 = 1 THEN 1 ELSE 0 END AS e FROM it WHERE tx % 4 = 1)"
_SUPPORTED = f"""{_SI}, u AS (SELECT p.r, p.a, x.tid, x.is_rev, x.le+1 AS s, x.rs-1 AS e FROM p JOIN it x ON x.tx = p.r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.r = p.r AND h.a = p.a AND h.i = x.i)),
w AS (SELECT u.r, u.a, min(CASE WHEN EXISTS (SELECT 1 FROM si WHERE si.tid = u.tid AND si.is_rev = u.is_rev AND si.s = u.s AND si.e = u.e) THEN 1 ELSE 0 END) AS ok FROM u GROUP BY u.r, u.a),
v AS (SELECT f.*, CASE WHEN coalesce(w.ok, 1) = 1 AND EXISTS (SELECT 1 FROM si JOIN tx t ON t.tx = f.r WHERE si.tid = t.tid AND si.e > t.s0) THEN 1 ELSE 0 END AS sup FROM f LEFT JOIN w ON w.r = f.r AND w.a = f.a)"""


def _merged(level: int, unclassified: bool, short: bool = False) -> str:
    """kept(tx, tid, is_rev, s, e, cov, all_novel, gene): the ordered merge, read by read along each chromosome.

    A read looks from the newest kept transcript back for one of its own chain (which gains coverage), one that holds
    its chain or is held by it (the read goes), or one that ends before it starts (the search ends); a read that finds
    none is kept if it is novel. Chains do not change in merging, so how they relate is known beforehand.
    """
    flags = _FLAGS.replace("FROM f GROUP", "FROM v GROUP").replace("iden_n > 0", "iden_n > 0 AND sup = 1") if short else _FLAGS
    more = f"{_SUPPORTED}, " if short else ""
    keep = "" if unclassified else " AND z.all_novel = 0"
    return f"""WITH RECURSIVE {_chain()}, {more}{flags}, {_ENDS}, fl AS (SELECT r, CASE WHEN {_LEVELS[level]} THEN 1 ELSE 0 END AS fu FROM b GROUP BY r), z AS ({_CLASS}),
ch AS (SELECT tx, list(concat(CAST(le AS VARCHAR), '-', CAST(rs AS VARCHAR)) ORDER BY i) AS c FROM it GROUP BY tx),
rd AS (SELECT t.tx, t.tid, t.is_rev, t.s0, t.e0, ch.c, z.all_novel, z.gene_id AS gene, CASE WHEN z.novel = 1 AND z.all_iden = 0 AND coalesce(fl.fu, 0) = 1{keep} THEN 1 ELSE 0 END AS emit,
row_number() OVER (PARTITION BY t.tid ORDER BY t.s0, t.tx) AS k FROM {READS} t JOIN ch ON ch.tx = t.tx JOIN z ON z.tx = t.tx LEFT JOIN fl ON fl.r = t.tx),
lg AS (SELECT x.tx AS x, y.tx AS y, x.c = y.c AS same, CASE WHEN len(x.c) > len(y.c) THEN x.c ELSE y.c END AS l, CASE WHEN len(x.c) > len(y.c) THEN y.c ELSE x.c END AS s
FROM rd x JOIN rd y ON x.tid = y.tid AND x.is_rev = y.is_rev AND x.k > y.k AND y.emit = 1 AND list_has_any(x.c, y.c)),
rl AS (SELECT x, y, same, list_position(l, s[1]) AS p0, l, s FROM lg),
rel AS (SELECT x, list(y) FILTER (WHERE same) AS eq, list(y) FILTER (WHERE NOT same AND p0 > 0 AND l[p0:p0+least(len(s), len(l)-p0+1)-1] = s[1:least(len(s), len(l)-p0+1)]) AS con FROM rl GROUP BY x),
st AS (SELECT DISTINCT tid, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(tx BIGINT, e BIGINT, cov BIGINT)[]) AS kept FROM rd
UNION ALL SELECT tid, k, CASE WHEN is_eq THEN list_transform(kept, lambda t: CASE WHEN t.tx = hit.tx THEN struct_pack(tx := t.tx, e := greatest(t.e, e0), cov := t.cov + 1) ELSE t END)
WHEN is_con OR emit = 0 THEN kept ELSE list_append(kept, struct_pack(tx := tx, e := e0, cov := CAST(1 AS BIGINT))) END FROM (
SELECT q.*, coalesce(list_contains(eq, hit.tx), false) AS is_eq, coalesce(list_contains(con, hit.tx), false) AS is_con FROM (
SELECT st.tid, rd.k, rd.tx, CAST(rd.e0 AS BIGINT) AS e0, rd.emit, st.kept, rel.eq, rel.con, list_filter(list_reverse(st.kept), lambda t: coalesce(list_contains(rel.eq, t.tx), false) OR coalesce(list_contains(rel.con, t.tx), false) OR rd.s0 > t.e)[1] AS hit
FROM st JOIN rd ON rd.tid = st.tid AND rd.k = st.k + 1 LEFT JOIN rel ON rel.x = rd.tx) q) q2),
fin AS (SELECT st.tid, unnest(kept) AS t FROM st JOIN (SELECT tid, max(k) AS k FROM rd GROUP BY tid) m ON m.tid = st.tid AND m.k = st.k),
kept AS (SELECT rd.tx, rd.tid, rd.is_rev, rd.s0 AS s, fin.t.e AS e, fin.t.cov AS cov, rd.all_novel, rd.gene, rd.k FROM fin JOIN rd ON rd.tx = fin.t.tx)"""


@query(f"""{_merged(5, False)} SELECT kept.tx, kept.tid, kept.is_rev, CAST(kept.s AS INT) AS start, CAST(kept.e AS INT) AS "end", kept.cov, kept.gene AS gene_id, CAST(tx.n AS INT) AS n_exons FROM kept JOIN tx ON tx.tx = kept.tx""")
def novel_merge(spark, d):
    tx = _tx(spark, d)
    return commands.novel_transcripts(views.reads(tx), views.annotation(tx)).select("tx", "tid", "is_rev", "start", "end", "cov", "gene_id", F.size("exons").alias("n_exons"))


@query(f"""{_merged(3, True)} SELECT tx, tid, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", cov, CASE WHEN all_novel = 1
THEN concat('UNCLA_', CAST(row_number() OVER (PARTITION BY all_novel ORDER BY tid, s, tx) - 1 AS VARCHAR)) ELSE replace(gene, 'g', 'n') END AS gene_name FROM kept""")
def novel_merge_unclassified(spark, d):
    tx = _tx(spark, d)
    params = UpdateParams(keep_unclassified=True, full_level=3)
    return commands.novel_transcripts(views.reads(tx), views.annotation(tx), params).select("tx", "tid", "start", "end", "cov", "gene_name")


_GTF = """concat_ws(chr(9), concat('chr', CAST(tid+1 AS VARCHAR)), 'isoloom', {kind}, CAST({s} AS VARCHAR), CAST({e} AS VARCHAR), {score}, CASE is_rev WHEN 1 THEN '-' ELSE '+' END, '.',
concat('gene_id "', gene, '"; transcript_id "t', CAST(tx AS VARCHAR), '"; gene_name "', replace(gene, 'g', 'n'), '";'))"""


@query(f"""{_merged(5, False, True)}, kx AS (SELECT kept.*, ex.k AS xk, ex.s AS xs, CASE WHEN ex.k = tx.n - 1 THEN kept.e ELSE ex.e END AS xe, tx.n FROM kept JOIN tx ON tx.tx = kept.tx JOIN ex ON ex.tx = kept.tx)
SELECT tx, 0 AS k, {_GTF.format(kind="'transcript'", s="s", e="e", score="'.'")} AS value FROM kept
UNION ALL SELECT tx, CAST(CASE WHEN is_rev = 1 THEN n - xk ELSE xk + 1 END AS INT), {_GTF.format(kind="'exon'", s="xs", e="xe", score="CAST(450 + 50*cov AS VARCHAR)")} FROM kx""")
def novel_gtf(spark, d):
    tx = _tx(spark, d)
    return commands.novel_lines(views.reads(tx), views.annotation(tx), introns=_short(spark, d))


# ---- intervals and details


#: Order keys that begin with a start are 10^9 a base: a chunk is a bin of bases, so rows of a chunk don't thin out.
_START_CHUNK = 1_000_000_000 * intervals.BIN
_GENES = "g AS (SELECT CAST(s AS BIGINT)*1000000000 + tx*10 + k AS ord, tid, s AS start, e FROM ex)"


@query(f"""WITH {EX}, {_GENES}, w AS (SELECT *, max(e) OVER (PARTITION BY tid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
v AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY ord) AS island FROM w)
SELECT tid, min(start) AS start, max(e) AS "end", CAST(count(*) AS BIGINT) AS n_genes, arg_min(concat('g', CAST(ord AS VARCHAR)), ord) AS gene_id FROM v GROUP BY tid, island""")
def gene_fusion(spark, d):
    """Every exon stands for a gene, in the order of a sorted file."""
    rows = views.exon_rows(spark, d).select((F.col("s").cast("long") * 1_000_000_000 + F.col("tx") * 10 + F.col("k")).alias("ord"), "tid", F.col("s").alias("start"), F.col("e").alias("end"), "is_rev")
    genes = rows.select("*", F.concat(F.lit("g"), F.col("ord").cast("string")).alias("gene_id"), F.lit("x").alias("gene_name"))
    return transcripts.fuse_genes(genes, _START_CHUNK).select("tid", "start", "end", "n_genes", "gene_id")


_UNION = """w AS (SELECT *, max(e) OVER (PARTITION BY tid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
v AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM w),
un AS (SELECT tid, min(s) AS s, max(e) AS e FROM v GROUP BY tid, island)"""


@query(f'WITH {EX}, b AS (SELECT DISTINCT tid, s, e FROM ex), {_UNION} SELECT tid, s AS start, e AS "end" FROM un')
def exon_union(spark, d):
    rows = views.exon_rows(spark, d).select("tid", F.col("s").alias("start"), F.col("e").alias("end"))
    return intervals.union(rows, ["tid"])


@query(f'WITH {EX} SELECT tid, s AS start, max(e) AS "end" FROM ex GROUP BY tid, s')
def exon_max_end(spark, d):
    return details.exon_ends(details.blocks(details.details(_aln(spark, d), JunctionParams(require_proper_pair=False))))


@query(f"WITH {TX} SELECT DISTINCT tid, point FROM (SELECT tid, le+1 AS point FROM it UNION ALL SELECT tid, rs FROM it) q")
def split_points(spark, d):
    return details.split_points(details.details(_aln(spark, d), JunctionParams(require_proper_pair=False)))


@query(f"""WITH {TX}, b AS (SELECT tid, s, max(e) AS e FROM ex GROUP BY tid, s), {_UNION},
pt AS (SELECT DISTINCT tid, point FROM (SELECT tid, le+1 AS point FROM it UNION ALL SELECT tid, rs FROM it) q),
cut AS (SELECT un.tid, un.s, un.e, un.s AS p FROM un UNION SELECT un.tid, un.s, un.e, pt.point FROM un JOIN pt ON pt.tid = un.tid AND pt.point > un.s AND pt.point <= un.e)
SELECT tid, p AS start, coalesce(lead(p) OVER (PARTITION BY tid, s, e ORDER BY p) - 1, e) AS "end" FROM cut""")
def segment_split(spark, d):
    return details.segments(details.details(_aln(spark, d), JunctionParams(require_proper_pair=False)))


_DETAIL = f"""{TX}, dt AS (SELECT tx.tx AS ord, tx.tid, tx.s0 AS start, tx.e0 AS e, tx.e0 - tx.s0 + 1 AS rlen, CASE WHEN tx.n > 2 THEN 1 ELSE 0 END AS is_splice, tx.n,
(SELECT string_agg(CAST(e AS VARCHAR), ',' ORDER BY k) FROM ex WHERE ex.tx = tx.tx) AS exon_end, coalesce((SELECT string_agg(CAST(rs-1 AS VARCHAR), ',' ORDER BY i) FROM it WHERE it.tx = tx.tx), '') AS intr_end,
(SELECT e - s + 1 FROM ex WHERE ex.tx = tx.tx AND k = 0) AS head, (SELECT e - s + 1 FROM ex WHERE ex.tx = tx.tx AND k = tx.n - 1) AS tail FROM tx WHERE tx.tx % 5 <> 0)"""


def _detail_rows(rows: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("ord", "tid", "start", F.col("end"), "rlen", F.col("is_splice").cast("int").alias("is_splice"), join("exon_end"), join("intr_end"))


@query(f'WITH {_DETAIL} SELECT ord, tid, start, e AS "end", rlen, is_splice, exon_end, intr_end FROM dt')
def alignment_detail(spark, d):
    return _detail_rows(details.details(_aln(spark, d)))


@query(f'WITH {_DETAIL} SELECT ord, tid, start, e AS "end", rlen, is_splice, exon_end, intr_end FROM dt WHERE n = 1 OR (head >= 30 AND tail >= 30)')
def anchor_filter(spark, d):
    return _detail_rows(details.ordered(details.anchored(details.details(_aln(spark, d)), 30)))


@query(f"WITH {_DETAIL} SELECT min(ord) AS ord, tid, start, rlen, exon_end FROM dt GROUP BY tid, start, rlen, exon_end")
def ad_dedup(spark, d):
    return _detail_rows(details.distinct(details.details(_aln(spark, d)))).select("ord", "tid", "start", "rlen", "exon_end")


@query(f"WITH {TX} SELECT tid, value FROM (SELECT tid, s0 AS value, row_number() OVER (PARTITION BY tid ORDER BY s0) AS rn FROM tx) q WHERE rn = 5")
def kth_smallest(spark, d):
    return details.kth_smallest(_tx(spark, d), F.col("start"), 5, ["tid"])


# ---- annotation text


def _lines(spark, d) -> DataFrame:
    return text.parse_gtf(views.lines(_tx(spark, d)))


@query(f"""WITH {TX}, o AS (SELECT tx*100 AS ord, 'transcript' AS type, tid, s0 AS start, e0 AS e, is_rev, tx FROM tx UNION ALL SELECT tx*100+k+1, 'exon', tid, s, e, is_rev, tx FROM ex)
SELECT ord, concat('chr', CAST(tid+1 AS VARCHAR)) AS chr, type, start, e AS "end", is_rev, concat('g', CAST(CAST(floor(tx/7) AS BIGINT) AS VARCHAR)) AS gene_id, concat('n', CAST(CAST(floor(tx/7) AS BIGINT) AS VARCHAR)) AS gene_name,
concat('t', CAST(tx AS VARCHAR)) AS transcript_id, concat('n', CAST(CAST(floor(tx/7) AS BIGINT) AS VARCHAR)) AS transcript_name FROM o""")
def gtf_attrs(spark, d):
    return _lines(spark, d).drop("value")


@query(f'WITH {TX} SELECT tx*100 AS tx, s0 AS start, e0 AS "end", CAST(n AS INT) AS n_exons, concat(\'t\', CAST(tx AS VARCHAR)) AS transcript_id FROM tx WHERE n > 1 OR tx = (SELECT max(tx) FROM tx)')
def gtf_assemble(spark, d):
    return transcripts.assemble(_lines(spark, d)).select("tx", "start", "end", F.size("exons").alias("n_exons"), "transcript_id")


@query(f"""WITH {TX}, o AS (SELECT tx*100 AS ord, tid, s0, e0 FROM tx UNION ALL SELECT ex.tx*100+k+1, ex.tid, s0, e0 FROM ex JOIN tx ON tx.tx = ex.tx)
SELECT ord, CASE WHEN tid < 22 THEN tid+1 ELSE 25 + (SELECT count(*) FROM (SELECT tid, min(ord) AS f FROM o GROUP BY tid) z WHERE z.tid >= 22 AND z.f <= (SELECT min(ord) FROM o q WHERE q.tid = o.tid)) END AS rank, s0 AS tx_start, e0 AS tx_end FROM o""".replace("AS rank", "AS \"rank\""))
def sorted_gtf(spark, d):
    return commands.sorted_lines(_lines(spark, d)).select("ord", F.col("rank").cast("long").alias("rank"), "tx_start", "tx_end")


@query(f"WITH {TX} SELECT concat('chr', CAST(tid+1 AS VARCHAR)) AS chr, CAST(row_number() OVER (ORDER BY min(tx)) - 1 AS INT) AS tid FROM tx GROUP BY tx.tid")
def chr_dictionary(spark, d):
    return transcripts.chromosome_ids(_lines(spark, d))


@query("""SELECT chr, CASE WHEN chr LIKE 'chrX%' THEN 22 WHEN chr LIKE 'chrY%' THEN 23 WHEN chr LIKE 'chrM%' THEN 24 ELSE coalesce(CAST(nullif(regexp_extract(substr(chr, 4), '^[0-9]+'), '') AS INT), 0) - 1 END AS id
FROM (SELECT concat('chr', CAST(l AS VARCHAR)) AS chr FROM (SELECT DISTINCT l_linenumber AS l FROM lineitem) q UNION ALL SELECT concat('chr', r_name) FROM region UNION ALL SELECT concat('chr', upper(substr(n_name, 1, 1))) FROM nation) z""")
def chromosome_number(spark, d):
    t = lambda n: views.table(spark, d, n)
    names = t("lineitem").select(F.concat(F.lit("chr"), F.col("l_linenumber").cast("string")).alias("chr")).distinct()
    names = names.union(t("region").select(F.concat(F.lit("chr"), "r_name"))).union(t("nation").select(F.concat(F.lit("chr"), F.upper(F.substring("n_name", 1, 1)))))
    return names.select("chr", at.chromosome_number(F.col("chr")).cast("int").alias("id"))


@query(f'WITH {TX} SELECT concat(\'g\', CAST(CAST(floor(tx/7) AS BIGINT) AS VARCHAR)) AS gene_id, min(s0) AS start, max(e0) AS "end", CAST(count(*) AS BIGINT) AS n_transcripts FROM tx GROUP BY 1')
def gene_bounds(spark, d):
    return transcripts.gene_bounds(_tx(spark, d))


_NAMES = "concat('gene_id \"g', CAST(CAST(floor(tx/7) AS BIGINT) AS VARCHAR), '\"; transcript_id \"t', CAST(tx AS VARCHAR), '\"; gene_name \"n', CAST(CAST(floor(tx/7) AS BIGINT) AS VARCHAR), '\";')"
_NOVEL = "concat_ws(chr(9), concat('chr', CAST(tid+1 AS VARCHAR)), 'x', {kind}, CAST({s} AS VARCHAR), CAST({e} AS VARCHAR), {score}, CASE is_rev WHEN 1 THEN '-' ELSE '+' END, '.', " + _NAMES + ")"


@query(f"""WITH {TX}, n AS (SELECT ex.*, tx.n FROM ex JOIN tx ON tx.tx = ex.tx) SELECT tx, 0 AS k, {_NOVEL.format(kind="'transcript'", s="s0", e="e0", score="'.'")} AS value FROM tx
UNION ALL SELECT tx, CAST(CASE WHEN is_rev = 1 THEN n - k ELSE k + 1 END AS INT), {_NOVEL.format(kind="'exon'", s="s", e="e", score="CAST(450 + 50*(tx % 3 + 1) AS VARCHAR)")} FROM n""")
def novel_lines(spark, d):
    return transcripts.novel_lines(_tx(spark, d).withColumn("cov", F.col("tx") % 3 + 1), "x")


@query(f"""WITH {TX}, g AS (SELECT CAST(floor(tx/50) AS BIGINT) AS gene, min(s0) AS s, max(e0) AS e FROM tx GROUP BY 1)
SELECT gene, CAST(-1 AS BIGINT) AS tx, 0 AS k, concat_ws(chr(9), 'chr1', 'x', 'gene', CAST(s AS VARCHAR), CAST(e AS VARCHAR), '.', '+', '.', concat('gene_id "G', CAST(gene AS VARCHAR), '"; gene_name "N";')) AS value FROM g
UNION ALL SELECT CAST(floor(tx/50) AS BIGINT), tx, 1, concat_ws(chr(9), 'chr1', 'x', 'transcript', CAST(s0 AS VARCHAR), CAST(e0 AS VARCHAR), '.', '+', '.', concat('gene_id "G', CAST(CAST(floor(tx/50) AS BIGINT) AS VARCHAR), '"; transcript_id "t', CAST(tx AS VARCHAR), '"; gene_name "N";')) FROM tx
UNION ALL SELECT CAST(floor(tx/50) AS BIGINT), tx, CAST(k+2 AS INT), concat_ws(chr(9), 'chr1', 'x', 'exon', CAST(s AS VARCHAR), CAST(e AS VARCHAR), '0', '+', '.', concat('gene_id "G', CAST(CAST(floor(tx/50) AS BIGINT) AS VARCHAR), '"; transcript_id "t', CAST(tx AS VARCHAR), '"; gene_name "N";')) FROM ex""")
def gene_lines(spark, d):
    tx = _tx(spark, d).withColumn("gene", F.floor(F.col("tx") / 50)).drop("gene_id", "gene_name")
    genes = tx.groupBy("gene").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("gene", F.lit("chr1").alias("chr"), "start", "end", F.lit(0).alias("is_rev"), F.concat(F.lit("G"), F.col("gene").cast("string")).alias("gene_id"), F.lit("N").alias("gene_name"))
    return transcripts.gene_lines(genes, tx, "x")


@query("""SELECT r_name, CAST(s.k AS INT) AS sample, CAST(p.k AS INT) AS replicate, concat(r_name, CAST(s.k AS VARCHAR), CAST(p.k AS VARCHAR)) AS path
FROM region, (SELECT 0 AS k UNION ALL SELECT 1) s, (SELECT 0 AS k UNION ALL SELECT 1) p WHERE NOT (s.k = 1 AND p.k = 1)""")
def sample_replicates(spark, d):
    one = lambda s: F.concat(F.col("r_name"), F.lit(s))
    specs = views.table(spark, d, "region").select("r_name", F.concat(one("00"), F.lit(","), one("01"), F.lit(":"), one("10")).alias("spec"))
    return text.sample_table(specs).select("r_name", "sample", "replicate", "path")


@query(f"""WITH {TX} SELECT concat('chr', CAST(tid+1 AS VARCHAR)) AS chr, CAST(le+1 AS INT) AS start, CAST(rs-1 AS INT) AS "end", CAST(tx % 3 - 1 AS INT) AS is_rev,
CAST(count(*) AS BIGINT) AS n, CAST(sum(tx % 9) AS BIGINT) AS uniq FROM it GROUP BY 1, 2, 3, 4""")
def star_scan(spark, d):
    rows = _tx(spark, d).where("size(exons) > 1").select("tx", "chr", "exons", F.explode(F.sequence(F.lit(0), F.size("exons") - 2)).alias("i"))
    s, e = F.get("exons", F.col("i"))["end"] + 1, F.get("exons", F.col("i") + 1)["start"] - 1
    lines = rows.select(F.concat_ws("\t", "chr", s.cast("string"), e.cast("string"), (F.col("tx") % 3).cast("string"), F.lit("1"), F.lit("1"), (F.col("tx") % 9).cast("string"), F.lit("0"), F.lit("20")).alias("value"))
    return text.parse_star(lines).fillna(-1, ["is_rev"]).groupBy("chr", "start", "end", "is_rev").agg(F.count("*").alias("n"), F.sum("uniq").alias("uniq"))


@query(f"""WITH {TX} SELECT tid, le+1 AS don, rs-1 AS acc, CAST(count(*) AS BIGINT) AS uniq_c FROM it WHERE tx % 5 <> 0 AND tx % 2 = 0 GROUP BY tid, le, rs""")
def sj_unique_only(spark, d):
    return junctions.table(_aln(spark, d), params=JunctionParams(use_multi=False)).select("tid", "don", "acc", "uniq_c")


@query(f"WITH {AL} SELECT ord FROM al WHERE unmapped = 0 AND clip5 = 0 AND clip3 = 0 AND del_len = 0")
def ad_skips_only(spark, d):
    return details.details(views.grouped_alignments(spark, d), JunctionParams(require_proper_pair=False), skips_only=True).select("ord")


@query("""SELECT p_partkey, CAST(length(p_type) - length(replace(p_type, ' ', '')) + 1 AS INT) AS n_tokens, split_part(p_type, ' ', 2) AS second, CAST(instr(p_type, 'T') - 1 AS INT) AS first_t,
CAST(CASE WHEN instr(substr(p_type, 4), 'E') > 0 THEN instr(substr(p_type, 4), 'E') + 2 ELSE -1 END AS INT) AS e_after_3, CAST(instr(substr(p_type, 1, 6), 'T') - 1 AS INT) AS t_within_6,
CAST(length(p_type) - length(replace(p_type, 'A', '')) AS INT) AS n_a, CAST(floor((p_size + 7) / 2) AS INT) AS middle FROM part""")
def string_functions(spark, d):
    part = views.table(spark, d, "part")
    t, words = F.col("p_type"), strings.tokens(F.col("p_type"), " ")
    return part.select("p_partkey", F.size(words).alias("n_tokens"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("second"), strings.find(t, F.lit("T")).alias("first_t"), strings.find(t, F.lit("E"), 3).alias("e_after_3"), strings.find_within(t, F.lit("T"), 6).alias("t_within_6"), strings.count(t, F.lit("A")).cast("int").alias("n_a"), strings.middle(F.col("p_size"), F.lit(7)).cast("int").alias("middle"))


# ---- files: written to the shared folder, then read


@query(f"""WITH {TX} SELECT concat('t', CAST(tx AS VARCHAR)) AS qname, CAST(CASE WHEN tx % 5 = 0 THEN 0 ELSE 2 END + is_rev * 16 AS INT) AS flag, CAST(tid AS INT) AS tid, CAST(s0 - 1 AS INT) AS pos,
CAST(2 * n - 1 AS INT) AS n_ops, CASE WHEN tx % 2 = 0 THEN 1 ELSE 2 END AS nh, CAST(row_number() OVER (PARTITION BY tx % 2 ORDER BY tx) - 1 AS BIGINT) AS place FROM tx""")
def sam_scan(spark, d):
    """Two SAM files with headers of their own: even reads in one, odd ones in the other."""
    rows = numbered(text.sam(spark, views.sam_files(spark, d)), "place", ["file"])
    return rows.select("qname", "flag", "tid", "pos", F.size("cigar").alias("n_ops"), "nh", "place")


@query(f"""WITH {TX} SELECT concat('t', CAST(tx AS VARCHAR)) AS qname, CAST(CASE WHEN tx % 5 = 0 THEN 0 ELSE 2 END + is_rev * 16 AS INT) AS flag, concat('chr', CAST(tid+1 AS VARCHAR)) AS chr, CAST(s0 - 1 AS INT) AS pos,
CAST(2 * n - 1 AS INT) AS n_ops, CASE WHEN tx % 2 = 0 THEN 1 ELSE 2 END AS nh FROM tx""")
def sam_compressed(spark, d):
    """Compressed SAM text whose lines end in two letters."""
    return text.sam(spark, views.sam_folders(spark, d)).select("qname", "flag", "chr", "pos", F.size("cigar").alias("n_ops"), "nh")


@query("""SELECT r.r_regionkey AS region, CAST(dense_rank() OVER (PARTITION BY r.r_regionkey ORDER BY n.n_nationkey) - 1 AS INT) AS sample, CAST(k.range AS INT) AS replicate, concat(n.n_name, '/', CAST(k.range AS VARCHAR)) AS path
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey, range(3) k WHERE k.range <= n.n_nationkey % 3""")
def sample_lists(spark, d):
    """A list file for each region: a sample for each nation, with one to three replicates."""
    name = F.col("n_name")
    paths = F.transform(F.sequence(F.lit(0), (F.col("n_nationkey") % 3).cast("int")), lambda k: F.concat(name, F.lit("/"), k.cast("string")))
    one = F.concat((F.col("n_nationkey") % 3 + 1).cast("string"), F.lit("\n"), F.array_join(paths, "\n"))
    files = views.table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("t")))).alias("s"))
    whole = F.concat(F.size("s").cast("string"), F.lit("\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n"), F.lit("\n"))
    got = text.sample_lists(files.select(F.col("n_regionkey").alias("region"), whole.alias("text")))
    return got.select("region", "sample", "replicate", "path")


@query(f"WITH {TX} SELECT CAST(row_number() OVER (ORDER BY min(tx % 2), min(tx.tid)) - 1 AS INT) AS tid, concat('chr', CAST(tx.tid+1 AS VARCHAR)) AS chr, CAST(max(e0) AS BIGINT) AS len FROM tx GROUP BY tx.tid")
def sam_dictionary(spark, d):
    """A header names the sequences of its own half's reads, each as long as its last read reaches in either half."""
    return text.sam_header(spark, views.sam_files(spark, d)).select(F.col("tid").cast("int").alias("tid"), "chr", "len")


@query(f"""WITH {TX} SELECT concat('t', CAST(tx AS VARCHAR), '.z') AS qname, CAST(CASE WHEN tx % 5 = 0 THEN 0 ELSE 2 END + is_rev * 16 AS INT) AS flag, CAST(tid AS INT) AS tid, CAST(s0 - 1 AS INT) AS pos,
CAST(2 * n - 1 AS INT) AS n_ops, CASE WHEN tx % 2 = 0 THEN 1 ELSE 2 END AS nh FROM tx""")
def bam_round_trip(spark, d):
    """Alignments as BAM files, read, renamed, written and read again."""
    return views.bam_copy(spark, _aln(spark, d)).select("qname", "flag", "tid", "pos", F.size("cigar").alias("n_ops"), "nh")


_SEQ = "(SELECT repeat(string_agg(substr('ACGT', CAST(p_size % 4 + 1 AS INT), 1), '' ORDER BY p_partkey), 20) FROM part)"


@query(f"SELECT concat('chr', CAST(range+1 AS VARCHAR)) AS chr, CAST(length({_SEQ}) AS INT) AS len, substr({_SEQ}, 50, 30) AS head, md5({_SEQ}) AS digest FROM range(25)")
def fasta_scan(spark, d):
    return text.fasta(spark, views.genome_file(spark, d)).select("chr", F.length("seq").alias("len"), F.substring("seq", 50, 30).alias("head"), F.md5("seq").alias("digest"))


@query(f"""WITH g AS (SELECT {_SEQ} AS seq) SELECT concat('chr', CAST(c.range+1 AS VARCHAR)) AS chr, CAST(t.range AS INT) AS tile, md5(substr(seq, CAST(t.range*4096+1 AS INT), 4097)) AS digest
FROM g, range(25) c, range(CAST((SELECT ceil(length(seq)/4096.0) FROM g) AS BIGINT)) t""")
def fasta_tiles(spark, d):
    return text.fasta_tiles(spark, views.genome_file(spark, d)).select("chr", "tile", F.md5("piece").alias("digest"))


@query("SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS name, repeat('ACGTN', CAST(p_size AS INT)) AS seq, repeat('@+>I ', CAST(p_size AS INT)) AS qual FROM part")
def fastq_scan(spark, d):
    """Records of several lines, whose qualities begin with the marks of other lines."""
    part = views.table(spark, d, "part").withColumn("n", F.col("p_size").cast("int"))
    cut = lambda c: F.regexp_replace(F.repeat(F.lit(c), F.col("n")), "(.{10})(?=.)", "$1\n")
    value = F.concat(F.lit("@p"), F.col("p_partkey").cast("string"), F.lit(" x\n"), cut("ACGTN"), F.lit("\n+\n"), cut("@+>I "))
    return text.fastq(spark, views.stored_text(part.select(value.alias("value")))).select("name", "seq", "qual")


@query(_junction_sql().replace("SELECT tid, concat", "SELECT concat_ws(chr(9), chr, CAST(don AS VARCHAR), CAST(acc AS VARCHAR), '0', '1', CAST(uniq_c AS VARCHAR), CAST(multi_c AS VARCHAR), '0') AS value FROM (SELECT tid, concat").replace("GROUP BY tid, le, rs ", "GROUP BY tid, le, rs) q"))
def junction_text(spark, d):
    return sinks.junction_lines(junctions.table(_aln(spark, d)))


@query(f"""WITH {TX}, c AS (SELECT *, sum(CASE WHEN s - pe - 1 >= 70 THEN 1 ELSE 0 END) OVER (PARTITION BY tx ORDER BY k ROWS UNBOUNDED PRECEDING) AS blk FROM (SELECT *, lag(e) OVER (PARTITION BY tx ORDER BY k) AS pe FROM ex) q),
b AS (SELECT tx, blk, min(s) AS s, max(e) AS e FROM c GROUP BY tx, blk) SELECT tx, s AS start, e AS "end" FROM (SELECT *, min(blk) OVER (PARTITION BY tx) AS lo, max(blk) OVER (PARTITION BY tx) AS hi FROM b) q WHERE blk = lo OR blk = hi OR e - s + 1 >= 30""")
def short_blocks(spark, d):
    """Gaps under 70 bases are no introns; internal exons under 30 go."""
    rows = transcripts.from_alignments(_aln(spark, d), ExonParams(min_exon=30, min_intron=70))
    return rows.select("tx", F.explode("exons").alias("x")).select("tx", "x.start", "x.end")


@query(f"""WITH {TX} SELECT tid, le+1 AS don, rs-1 AS acc, CAST(count(*) AS BIGINT) AS n FROM it WHERE tx % 5 <> 0 AND rs - le - 1 >= 70 GROUP BY tid, le, rs""")
def short_gaps(spark, d):
    return junctions.table(_aln(spark, d), params=JunctionParams(min_intron=70)).select("tid", "don", "acc", (F.col("uniq_c") + F.col("multi_c")).alias("n"))


@query(f"""WITH {TX} SELECT tx*100 AS ord, 'transcript' AS type FROM tx UNION ALL SELECT tx*100+k+1, 'exon' FROM ex""")
def gtf_comments(spark, d):
    """Every other line has a comment before it."""
    rows = views.lines(_tx(spark, d))
    noise = rows.where("ord % 2 = 0").select((F.col("ord") - 50).alias("ord"), F.concat(F.lit("#"), "value").alias("value"))
    return text.parse_gtf(rows.unionByName(noise)).select("ord", "type")


@query(f"""WITH {TX}, s AS (SELECT tid, is_rev, le+1 AS don, rs-1 AS acc, CAST(sum(tx % 9) AS BIGINT) AS u, CAST(count(*) AS BIGINT) AS m FROM it GROUP BY tid, is_rev, le, rs)
SELECT tid, don, acc, is_rev + 1 AS strand, 1 AS anno, u AS uniq_c, m AS multi_c, 2 AS motif, 20 AS max_over, CAST(row_number() OVER (PARTITION BY tid ORDER BY don, acc, is_rev) AS INT) AS place FROM s""")
def star_junction_table(spark, d):
    rows = _tx(spark, d).where("size(exons) > 1").select("tx", "tid", "chr", "is_rev", "exons", F.explode(F.sequence(F.lit(0), F.size("exons") - 2)).alias("i"))
    one = rows.groupBy("chr", "is_rev", (F.get("exons", F.col("i"))["end"] + 1).alias("s"), (F.get("exons", F.col("i") + 1)["start"] - 1).alias("e")).agg(F.sum(F.col("tx") % 9).alias("u"), F.count("*").alias("m"))
    lines = one.select(F.concat_ws("\t", "chr", *[F.col(c).cast("string") for c in ("s", "e")], (F.col("is_rev") + 1).cast("string"), F.lit("2"), F.lit("1"), F.col("u").cast("string"), F.col("m").cast("string"), F.lit("20")).alias("value"))
    header = spark.range(25).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("chr"))
    got = text.star_table(text.parse_star(lines, header))
    place = F.row_number().over(Window.partitionBy("tid").orderBy("don", "acc", "strand"))
    return got.select("tid", "don", "acc", "strand", "anno", "uniq_c", "multi_c", "motif", "max_over", place.alias("place"))


@query(f"""WITH {TX}, o AS (SELECT *, CASE WHEN is_rev = 1 THEN n - 1 - k ELSE k END AS rank FROM (SELECT ex.*, tx.n FROM ex JOIN tx ON tx.tx = ex.tx) q),
tt AS (SELECT tx, any_value(tid) AS tid, min(s) AS s, max(e) AS e, any_value(n) AS n, string_agg(concat(CAST(s AS VARCHAR), '-', CAST(e AS VARCHAR)), ',' ORDER BY rank) AS exons FROM o GROUP BY tx),
gl AS (SELECT *, s AS gs, s + 80 AS ge FROM tt), w AS (SELECT *, max(ge) OVER (PARTITION BY tid ORDER BY s, tx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gl),
v AS (SELECT *, sum(CASE WHEN reach IS NULL OR gs >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY s, tx) AS island FROM w)
SELECT tid, min(gs) AS start, max(ge) AS "end", concat('g', CAST(arg_min(tx, CAST(s AS BIGINT) * 1000000000 + tx) AS VARCHAR)) AS gene_id, string_agg(concat('t', CAST(tx AS VARCHAR), ':', exons), ';' ORDER BY s, tx) AS transcripts FROM v GROUP BY tid, island""")
def gene_groups(spark, d):
    """Each transcript has a gene line of 81 bases at its start; lines are sorted by start."""
    tx = _tx(spark, d)
    base = F.col("start").cast("long") * 1_000_000_000 + F.col("tx") * 10
    kinds = F.concat(F.array(F.struct(F.lit(-2).alias("k"), F.lit("gene").alias("type"), F.col("start"), (F.col("start") + 80).alias("end")), F.struct(F.lit(-1).alias("k"), F.lit("transcript").alias("type"), F.col("start"), F.col("end"))), F.transform("exons", lambda e, i: F.struct(i.alias("k"), F.lit("exon").alias("type"), e["start"].alias("start"), e["end"].alias("end"))))
    rows = tx.select("tx", "tid", "chr", "is_rev", "transcript_id", "transcript_name", base.alias("base"), F.explode(kinds).alias("x"))
    name = F.concat(F.lit("g"), F.col("tx").cast("string"))
    lines = rows.select((F.col("base") + F.col("x.k") + 2).alias("ord"), "tid", "chr", "x.type", "x.start", "x.end", "is_rev", name.alias("gene_id"), name.alias("gene_name"), "transcript_id", "transcript_name")
    one = F.transform("transcripts", lambda t: F.concat(t["transcript_id"], F.lit(":"), F.array_join(F.transform(t["exons"], lambda e: F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string"))), ",")))
    return transcripts.gene_groups(lines, ["tid"], _START_CHUNK).select("tid", "start", "end", "gene_id", F.array_join(one, ";").alias("transcripts"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junction_table(spark, sf_dir)
