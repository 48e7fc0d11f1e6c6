"""Blocked gzip, tabix index and BAM splits against plain versions."""

import gzip
import random
import struct

import pytest

from breakweave.sources import alignments, bgzf, variants, vcf_out


@pytest.fixture
def small_splits(spark):
    """Splits of a few thousand bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def predictions(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randint(0, 40_000_000) if i % 3 else rng.randint(100_000, 130_000)
        size = rng.choice([50, 80, 20_000, 3_000_000])
        kind = rng.choice(["DEL", "INS"])
        rows.append((f"C{i}", rng.choice(["chr1", "chr2", "chrX"]), start, start + size if kind == "DEL" else start + 1, kind, size, 5, 0, 0.9, 1))
    return spark.createDataFrame(rows, "candidate_id string, chrom string, start bigint, end bigint, svtype string, median_svlen bigint, support_read_count bigint, label int, gnn_prob double, gnn_pred int")


def test_bins():
    rng = random.Random(1)
    for _ in range(500):
        beg = rng.randrange(1 << 29)
        end = min(beg + rng.choice([1, 100, 1 << 15, 1 << 21, 1 << 28]), 1 << 29)
        own = bgzf.region_bin(beg, end)
        assert own in bgzf.region_bins(beg, end)
        level = next(s for s, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0)) if own >= first)
        first = {14: 4681, 17: 585, 20: 73, 23: 9, 26: 1, 29: 0}[level]
        assert (own - first) << level <= beg and end <= (own - first + 1) << level
        assert level == 14 or beg >> level - 3 != end - 1 >> level - 3


def test_compressed_calls_are_the_plain_ones(spark, tmp_path):
    pred = predictions(spark)
    vcf_out.write_vcf(pred, str(tmp_path / "a.vcf"))
    assert vcf_out.write_vcf(pred, str(tmp_path / "a.vcf.gz"), compress=True) == 3000
    data = (tmp_path / "a.vcf.gz").read_bytes()
    assert gzip.decompress(data) == (tmp_path / "a.vcf").read_bytes()
    assert data.endswith(bgzf.END) and bgzf.block_size(data)
    at = 0
    while at < len(data):
        assert len(bgzf.content(data[at : at + bgzf.block_size(data[at:])])) <= bgzf.MOST
        at += bgzf.block_size(data[at:])
    assert at == len(data)
    assert variants.read_lines(spark, str(tmp_path / "a.vcf.gz")).count() == len((tmp_path / "a.vcf").read_text().splitlines())


def test_a_lookup_gives_what_a_filter_gives(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.vcf.gz")
    vcf_out.write_vcf(predictions(spark), path, compress=True)
    lines = [x for x in gzip.decompress((tmp_path / "a.vcf.gz").read_bytes()).decode().splitlines() if not x.startswith("#")]
    regions = [("chr1", 0, 1 << 29), ("chr2", 100_000, 100_001), ("chr2", 110_000, 112_000), ("chrX", 3_999_999, 4_000_000), ("chrX", 39_000_000, 39_500_000), ("chr9", 0, 1000), ("chr1", 50_000_000, 60_000_000)]
    for bound in (bgzf.LOOKUP_BYTES, 0):
        monkeypatch.setattr(bgzf, "LOOKUP_BYTES", bound)
        for chrom, beg, end in regions:
            want = [x for x in lines if bgzf._touches(x.encode(), chrom, beg, end)]
            assert sorted(r.line for r in bgzf.region_lines(spark, path, chrom, beg, end).collect()) == sorted(want)


def test_the_index_holds_every_record(spark, tmp_path):
    """Each record lies in a chunk of its bin, and its tile's offset is not behind it."""
    path = str(tmp_path / "a.vcf.gz")
    vcf_out.write_vcf(predictions(spark, 4000, 9), path, compress=True)
    index = bgzf.read_index(spark, f"{path}.tbi")
    text, places = b"", []
    for at, data in bgzf.content_from(spark, path):
        places += [(at << 16) + i for i in range(len(data))]
        text += data
    begin, counts = 0, {}
    for line in text.split(b"\n"):
        span = bgzf.vcf_span(line)
        if span:
            chrom, beg, end = span
            bins, linear = index[chrom]
            here = places[begin]
            assert any(a <= here < b for a, b in bins[bgzf.region_bin(beg, end)])
            assert linear[beg >> 14] <= here
            counts[chrom] = counts.get(chrom, 0) + 1
        begin += len(line) + 1
    assert {c: bins[bgzf.COUNTS_BIN][1][0] for c, (bins, _) in index.items()} == counts


def test_no_calls(spark, tmp_path):
    path = str(tmp_path / "none.vcf.gz")
    assert vcf_out.write_vcf(predictions(spark, 5).where("false"), path, compress=True) == 0
    assert bgzf.read_index(spark, f"{path}.tbi") == {} and bgzf.region_lines(spark, path, "chr1", 0, 100).count() == 0


def test_caller_records_are_indexed(spark, tmp_path):
    (tmp_path / "c.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t500\tb\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-100;END=600\n1\t20\ta\tN\t<INS>\t.\tPASS\tSVTYPE=INS;SVLEN=70\n")
    out = str(tmp_path / "c.vcf.gz")
    assert variants.filter_caller_vcf(spark, str(tmp_path / "c.vcf"), out, compress=True) == 2
    assert [r.line.split("\t")[2] for r in bgzf.region_lines(spark, out, "1", 599, 700).collect()] == ["b"]
    assert [r.line.split("\t")[2] for r in bgzf.region_lines(spark, out, "1", 0, 20).collect()] == ["a"]


def test_broken_blocks_are_refused(spark, tmp_path):
    good = bgzf.block(b"hello" * 100)
    assert bgzf.content(good) == b"hello" * 100
    for bad in (good[:-1] + b"\1", good[:30] + b"\xff" + good[31:], good[:-6] + b"\0" + good[-5:]):
        with pytest.raises(ValueError):
            bgzf.content(bad)
    (tmp_path / "x.gz").write_bytes(b"plain text")
    with pytest.raises(ValueError):
        list(bgzf.content_from(spark, str(tmp_path / "x.gz")))


# --- BAM

CONTIGS = [("chr1", 250_000_000), ("chr2", 200_000_000)]


def records(spark, n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cigar = rng.choice(["100M", "20S30M60D50M", "5H10M70I20M3S", None])
        sa = f"chr2,{i},+,50M,60,1;" if i % 7 == 0 else None
        rows.append((i, f"read{i}", rng.choice([0, 16, 2048, 4]), rng.choice(["chr1", "chr2", None]), rng.choice([None, rng.randrange(1_000_000)]), rng.randrange(61), cigar, rng.choice([0, 100, 3000, 9001]), sa, rng.choice([None, 0, 3])))
    return spark.createDataFrame(rows, alignments.ALIGNMENTS)


def told(df):
    return sorted(tuple(r) for r in df.select(*[c.split()[0] for c in alignments.ALIGNMENTS.split(", ")]).collect())


@pytest.mark.parametrize("n", [0, 1, 1200])
def test_bam_round_trip_in_splits(spark, tmp_path, small_splits, n):
    path = str(tmp_path / "a.bam")
    alignments.write_bam(records(spark, n), path, CONTIGS)
    if n > 1:
        assert bgzf.raw_blocks(spark, path).rdd.getNumPartitions() > 4
    assert told(alignments.read_alignments(spark, path)) == told(records(spark, n))
    assert alignments.contig_lengths(spark, path) == dict(CONTIGS)


def test_records_longer_than_splits_and_many_small_blocks(spark, tmp_path, small_splits):
    """Blocks of a few hundred bytes, records that reach over several of them and over whole splits."""
    rng = random.Random(8)
    head = b"BAM\x01" + struct.pack("<ii", 0, 2) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in CONTIGS)
    body, names = b"", []
    for i in range(150):
        seq = rng.choice([5, 200, 20_000])
        name = f"r{i}".encode() + b"\0"
        data = struct.pack("<iiBBHHHiiii", i % 2, i * 10, len(name), 9, 0, 1, 0, seq, -1, -1, 0) + name + struct.pack("<I", 50 << 4) + rng.randbytes((seq + 1) // 2) + rng.randbytes(seq)
        body += struct.pack("<i", len(data)) + data
        names.append(f"r{i}")
    whole = head + body
    path = tmp_path / "b.bam"
    path.write_bytes(b"".join(bgzf.block(whole[i : i + 700]) for i in range(0, len(whole), 700)) + bgzf.END)
    got = alignments.read_bam(spark, str(path)).orderBy("record_ordinal").collect()
    assert [r.qname for r in got] == names and [r.record_ordinal for r in got] == list(range(150))
    path.write_bytes(b"".join(bgzf.block(whole[i : i + 700]) for i in range(0, len(whole) - 900, 700)) + bgzf.END)
    with pytest.raises(ValueError):
        alignments.read_bam(spark, str(path)).collect()


def test_text_without_its_extension_and_cram(spark, tmp_path):
    (tmp_path / "reads.bam").write_text("@SQ\tSN:chr1\tLN:1000\nr1\t0\tchr1\t11\t60\t50M\t*\t0\t0\t*\t*\n")
    assert [r.qname for r in alignments.read_alignments(spark, str(tmp_path / "reads.bam")).collect()] == ["r1"]
    assert alignments.contig_lengths(spark, str(tmp_path / "reads.bam")) == {"chr1": 1000}
    (tmp_path / "reads.bin").write_bytes(b"CRAM\x03\0")
    with pytest.raises(ValueError):
        alignments.read_alignments(spark, str(tmp_path / "reads.bin"))
