"""Row types and parameters of the transcript and splice-junction operators.

Coordinates of exons, transcripts and junctions are 1-based and inclusive; ``pos`` of an alignment is 0-based.
"""

from __future__ import annotations

from dataclasses import dataclass

CIGAR = "array<struct<op:string,len:int>>"
EXONS = "array<struct<start:int,end:int>>"
ALIGNMENT = f"ord long, qname string, flag int, tid int, chr string, pos int, l_qseq int, cigar {CIGAR}, nm int, xs string, nh int"
TRANSCRIPT = f"tx long, tid int, chr string, is_rev int, start int, end int, exons {EXONS}, gene_id string, gene_name string, transcript_id string, transcript_name string"
STAR = "chr string, start int, end int, strand int, motif int, annotated int, uniq long, multi long, overhang int"
HEADER = "tid int, chr string, len long"

UNMAPPED, PROPER_PAIR, REVERSE = 0x4, 0x2, 0x10


@dataclass(frozen=True)
class ExonParams:
    """Least length of an internal exon, and of an N operation that counts as an intron."""

    min_exon: int = 3
    min_intron: int = 3


@dataclass(frozen=True)
class FilterParams:
    """Alignment filter: aligned share of the query, identity, ratio of second to best, introns of the best."""

    coverage: float = 0.67
    identity: float = 0.75
    second_ratio: float = 0.98
    min_introns: int = 0
    #: Compare the alignment's coordinates as 1-based; by default its 0-based start meets 1-based transcripts as they are.
    strict_coords: bool = False


@dataclass(frozen=True)
class UpdateParams:
    """Novel transcripts: splice-site tolerance, full-length level 1 to 5, keep unclassified ones."""

    distance: int = 0
    full_level: int = 5
    keep_unclassified: bool = False
    min_anno_exons: int = 2
    source: str = "isoloom"


@dataclass(frozen=True)
class JunctionParams:
    min_intron: int = 3
    require_proper_pair: bool = True
    use_multi: bool = True
    anchor: int = 1


#: Intron motifs by the first two and last two bases, with the strand each implies (1 is +, 2 is -).
MOTIFS = {"GTAG": (1, 1), "CTAC": (2, 2), "GCAG": (3, 1), "CTGC": (4, 2), "ATAC": (5, 1), "GTAT": (6, 2)}
