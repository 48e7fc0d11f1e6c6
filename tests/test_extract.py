"""Alignment records to events."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from breakweave.functions import exprs as X
from breakweave.operators import extract
from breakweave.sources import alignments
from breakweave.sources.schemas import ALIGNMENTS, EXTRA, SIGNALS, names
from breakweave.sources.tables import read_tsv, write_tsv

HEADER = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:100000\n@SQ\tSN:chr2\tLN:100000\n"


def sam_line(name, flag, chrom, pos, mapq, cigar, n, *tags):
    return "\t".join([name, str(flag), chrom, str(pos), str(mapq), cigar, "*", "0", "0", "A" * n if n else "*", "*", *tags]) + "\n"


SPLIT_SAM = (
    HEADER
    + sam_line("readA", 0, "chr1", 101, 60, "60S100M40S", 200, "SA:Z:chr2,501,-,80M70S,55,3;", "NM:i:1")
    + sam_line("readA", 2048, "chr2", 501, 55, "80M70S", 150, "NM:i:3")
    + sam_line("readB", 256, "chr1", 1001, 20, "100S100M", 200)
    + sam_line("readC", 4, "*", 0, 0, "*", 0)
)


@pytest.fixture
def sam(tmp_path):
    path = tmp_path / "a.sam"
    path.write_text(SPLIT_SAM)
    return str(path)


def test_split_and_clip_evidence(spark, sam):
    rows = extract.extract_extra(alignments.read_sam(spark, sam)).orderBy(*extract.extra_order()).collect()
    assert len(rows) == 4
    by = {r.evidence_type: r for r in rows}
    left, right, split, supp = (by[k] for k in ("SOFTCLIP_LEFT", "SOFTCLIP_RIGHT", "SA_CONNECTION", "SUPPLEMENTARY"))
    assert (left.src_chrom, left.event_pos, left.event_len) == ("chr1", 100, 60)
    assert (right.src_chrom, right.event_pos, right.event_len) == ("chr2", 580, 70)
    assert (split.dst_chrom, split.dst_start, split.dst_end, split.dst_strand, split.dst_mapq) == ("chr2", 500, 580, "-", 55)
    assert (split.chrom_change, split.orientation_change, split.sa_cigar, split.nm, split.event_len) == (1, 1, "80M70S", 3, 0)
    assert (supp.src_chrom, supp.event_pos, supp.event_len) == ("chr2", 500, 80)


def test_no_evidence_gives_a_header_only_table(spark, tmp_path):
    path = tmp_path / "b.sam"
    path.write_text(HEADER + sam_line("r", 0, "chr1", 1, 60, "100M", 100))
    out = extract.extract_extra(alignments.read_sam(spark, str(path))).select(*names(EXTRA))
    write_tsv(out, str(tmp_path / "extra.tsv"))
    assert (tmp_path / "extra.tsv").read_text() == "\t".join(names(EXTRA)) + "\n"
    assert read_tsv(spark, str(tmp_path / "extra.tsv"), EXTRA).count() == 0
    assert read_tsv(spark, str(tmp_path / "missing.tsv"), EXTRA).columns == names(EXTRA)


def test_header_contigs(spark, sam):
    assert alignments.contig_lengths(spark, sam) == {"chr1": 100000, "chr2": 100000}
    assert alignments.contig_lengths(spark, sam + ".none.bam") == {}


def walk(cigar, start, min_size):
    """The walk, one operation after the other."""
    import re

    ref, read, out = start, 0, []
    for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", cigar)):
        if op in "DI" and n >= min_size:
            out.append(("INS", ref, ref + 1, n, read, read + n) if op == "I" else ("DEL", ref, ref + n, n, read, read))
        ref += n if op in "M=XDN" else 0
        read += n if op in "M=XIS" else 0
    return out


def test_cigar_walk_against_a_plain_walk(spark):
    rng = random.Random(5)
    cases = ["100M60D10M", "10H5S50M70I20M3S", "50N60D", "*", "80I"]
    cases += ["".join(f"{rng.choice((1, 20, 49, 50, 51, 300))}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randint(1, 30))) for _ in range(200)]
    rows = [(i, f"r{i}", 0, "chr1", i * 10, 60, c, 100, None, None) for i, c in enumerate(cases)]
    got = extract.extract_signals(spark.createDataFrame(rows, ALIGNMENTS)).orderBy("record_ordinal", "event_ordinal").collect()
    want = [(i, *e) for i, c in enumerate(cases) if c != "*" for e in walk(c, i * 10, 50)]
    assert [(r.record_ordinal, r.svtype, r.event_pos, r.event_end, r.svlen, r.read_event_start, r.read_event_end) for r in got] == want


def test_signal_index_is_the_place_in_the_sorted_table(spark):
    rows = [(i, f"r{i % 7}", 0, ["chr10", "chr2", "chrX", "odd"][i % 4], (i * 37) % 100, 60, "5M60D5M70I", 100, None, None) for i in range(60)]
    out = extract.indexed_signals(extract.extract_signals(spark.createDataFrame(rows, ALIGNMENTS))).collect()
    key = {"chr2": (0, 2), "chr10": (0, 10), "chrX": (0, 23), "odd": (1, 0)}
    want = sorted(out, key=lambda r: (key[r.chrom], r.event_pos, r.svtype, r.read_name, r.record_ordinal, r.event_ordinal))
    assert [r.signal_index for r in want] == list(range(120))


@pytest.mark.parametrize(("cigar", "plain", "behind"), [("40S", (40, 40), (40, 40)), ("5H40S10M6S", (0, 6), (40, 6)), ("10M", (0, 0), (0, 0)), ("7S3M9S4H", (7, 0), (7, 9))])
def test_end_clips(spark, cigar, plain, behind):
    row = spark.range(1).select(*[X.end_clip(F.lit(cigar), side, hard).alias(f"{side}{hard}") for hard in (False, True) for side in (True, False)]).first()
    assert (tuple(row)[:2], tuple(row)[2:]) == (plain, behind)


def bam_bytes(records):
    out = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for name, flag, pos, mapq, ops, seq, tags in records:
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, mapq, 0, len(ops), flag, seq, -1, -1, 0)
        body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + b"\x11" * ((seq + 1) // 2) + b"\xff" * seq + tags
        out += struct.pack("<i", len(body)) + body
    return out


def test_bam_is_read_like_sam(spark, tmp_path):
    path = tmp_path / "a.bam"
    tags = b"XXBc\x02\x00\x00\x00\x01\x02" + b"NMC\x03" + b"SAZchr1,5,+,3M,9,1;\0"
    data = bam_bytes([("r1", 16, 9, 60, [(5, "S"), (60, "D")], 5, tags), ("r2", 0, 3, 1, [(4, "M")], 4, b"")])
    half = len(data) // 2  # two gzip members, as in blocked gzip
    path.write_bytes(gzip.compress(data[:half]) + gzip.compress(data[half:]))
    rows = alignments.read_alignments(spark, str(path)).orderBy("record_ordinal").collect()
    assert [tuple(r) for r in rows] == [(0, "r1", 16, "chr1", 9, 60, "5S60D", 5, "chr1,5,+,3M,9,1;", 3), (1, "r2", 0, "chr1", 3, 1, "4M", 4, None, None)]
    assert alignments.contig_lengths(spark, str(path)) == {"chr1": 1000}
    with pytest.raises(ValueError, match="CRAM"):
        alignments.read_alignments(spark, "x.cram")


def test_signal_columns(spark, sam):
    assert extract.extract_signals(alignments.read_sam(spark, sam)).drop("record_ordinal", "event_ordinal").columns == names(SIGNALS)
