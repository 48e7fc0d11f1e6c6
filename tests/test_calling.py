"""Clustering, proposals, merging, labels, filters, duplicates, metrics, VCF."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from breakweave.operators import cluster, merge, metrics, propose, select
from breakweave.sources import variants, vcf_out
from breakweave.sources.schemas import EXTRA, EXTRA_CANDIDATES, PREDICTIONS, SIGNALS, names

SIGNAL_ROWS = [
    ("read1", "chr1", 100, 160, "DEL", 60, 60, "+", 1000, 100, 100, 0, 0, 0, 0, "100M60D840M", 0),
    ("read2", "chr1", 120, 182, "DEL", 62, 50, "-", 1100, 120, 120, 0, 1, 5, 0, "120M62D918M", 1),
    ("read3", "chr1", 1000, 1001, "INS", 80, 55, "+", 900, 400, 480, 1, 1, 0, 20, "400M80I420M", 2),
]
CANDIDATE = "candidate_id string, chrom string, start bigint, end bigint, svtype string, median_svlen bigint, support_read_count bigint, ordinal bigint"


@pytest.fixture
def signals(spark):
    return spark.createDataFrame(SIGNAL_ROWS, SIGNALS + ", signal_index bigint")


def test_two_candidates(signals):
    rows = cluster.candidates(signals, 500, 1).orderBy("candidate_id").collect()
    assert [(r.candidate_id, r.svtype, r.support_read_count, r.start, r.end) for r in rows] == [("CAND_000001", "DEL", 2, 110, 171), ("CAND_000002", "INS", 1, 1000, 1001)]
    assert (rows[0].read_names, rows[0].signal_indices, rows[0].mean_mapq, rows[0].std_pos, rows[0].std_svlen) == (["read1", "read2"], [0, 1], 55.0, 10.0, 1.0)


def test_null_reads_count_for_the_threshold_only(spark):
    rows = [(n, "chr1", 10, 70, "DEL", 60, 1, "+", 1, 0, 0, 0, 0, 0, 0, "", i) for i, n in enumerate(("a", None))]
    out = cluster.candidates(spark.createDataFrame(rows, SIGNALS + ", signal_index bigint"), 500, 2).collect()
    assert [(r.support_read_count, r.read_names) for r in out] == [(1, ["a"])]
    assert cluster.candidates(spark.createDataFrame([], SIGNALS + ", signal_index bigint")).count() == 0


def plain_clusters(rows, window):
    """Sequential clustering of one group's sorted (pos, length, index)."""
    out, current = {}, []
    for pos, length, index in sorted(rows):
        if current:
            mid = median(x[1] for x in current)
            alike = length <= 0 or mid <= 0 or min(length, mid) / max(length, mid) >= 0.5
            if pos - current[-1][0] > window or not alike:
                current = []
        current.append((pos, length, index))
        out[index] = current[0][2]
    return out


def test_clusters_against_sequential_clustering(spark):
    rng = random.Random(3)
    rows = [("r", "c", rng.randint(0, 4000), 0, "DEL", rng.choice((50, 60, 100, 130, 400)), 1, "+", 1, 0, 0, 0, 0, 0, 0, "", i) for i in range(400)]
    got = {r.signal_index: r.cluster for r in cluster.cigar_clusters(spark.createDataFrame(rows, SIGNALS + ", signal_index bigint"), 20).collect()}
    assert got == plain_clusters([(r[2], r[5], r[16]) for r in rows], 20)


def extra_row(kind, name, s0, s1, d0=None, d1=None, pos=None, size=None, chrom="chr1", dst="chr1"):
    v = dict.fromkeys(names(EXTRA)) | {
        "read_name": name, "evidence_type": kind, "src_chrom": chrom, "src_start": s0, "src_end": s1, "src_strand": "+", "event_pos": pos, "event_len": size, "orientation_change": 0,
        "softclip_left": 0, "softclip_right": 0, "dst_chrom": dst if d0 is not None else None, "dst_start": d0, "dst_end": d1,
    }
    return tuple(v[c] for c in names(EXTRA))


EXTRA_ROWS = [
    extra_row("SOFTCLIP_LEFT", "read1", 100, 200, pos=100, size=60), extra_row("SOFTCLIP_RIGHT", "read2", 110, 210, pos=120, size=70),
    extra_row("SA_CONNECTION", "read3", 500, 600, 700, 800, 500, 200), extra_row("SA_CONNECTION", "read4", 510, 610, 710, 810, 510, 200),
]


@pytest.mark.parametrize(("support", "want"), [
    (cluster.source_support(2), [("DEL", 605, 705, -100, "SA"), ("INS", 110, 111, 65, "SOFTCLIP")]),
    (cluster.source_support(), [("DEL", 605, 705, -100, "SA")]),
    (cluster.source_support(2, sa=3), [("INS", 110, 111, 65, "SOFTCLIP")]),
])
def test_extra_candidates(spark, support, want):
    p = propose.proposals(spark.createDataFrame(EXTRA_ROWS, EXTRA))
    rows = cluster.extra_candidates(p, 50, 50, support).orderBy("svtype").collect()
    assert [(r.svtype, r.start, r.end, r.svlen, r.source) for r in rows] == want


def test_proposals_need_evidence_type(spark):
    assert propose.proposals(spark.createDataFrame([("a", "b")], "x string, y string")).count() == 0
    assert propose.proposals(spark.createDataFrame([], EXTRA)).count() == 0


def merged(spark, extras, **more):
    cigar = spark.createDataFrame([("CAND_000001", "chr1", 1000, 1100, "DEL", 100, 3, 0)], CANDIDATE)
    rows = [("chr1", s, s + 100, t, -n, -n, k, src, float(s), float(n), i) for i, (s, t, n, k, src) in enumerate(extras)]
    return merge.merge_candidates(cigar, spark.createDataFrame(rows, EXTRA_CANDIDATES + ", extra_ordinal bigint"), **more).orderBy("_side", "_order").collect()


def test_merge(spark):
    (row,) = merged(spark, [])
    assert (row.candidate_source, row.extra_support, row.matched_extra_count) == ("CIGAR_ONLY", 0, 0)
    (row,) = merged(spark, [(1020, "DEL", 100, 2, "SA")])
    assert (row.candidate_source, row.extra_support, row.matched_extra_count, row.extra_source) == ("CIGAR_EXTRA", 2, 1, "SA")
    (row,) = merged(spark, [(1020, "DEL", 100, 2, "SA"), (1030, "DEL", 90, 4, "SOFTCLIP"), (990, "DEL", 110, 3, "SA")])
    assert (row.extra_support, row.matched_extra_count, row.extra_source) == (9, 3, "SA,SOFTCLIP")
    for extra in ((1020, "INS", 100), (1020, "DEL", 400), (3000, "DEL", 100)):
        assert [r.candidate_source for r in merged(spark, [(*extra, 29, "SA")])] == ["CIGAR_ONLY"]
        rows = merged(spark, [(*extra, 30, "SA")])
        assert [r.candidate_source for r in rows] == ["CIGAR_ONLY", "EXTRA_ONLY"]
        assert (rows[1].candidate_id, rows[1].support_read_count, rows[1].read_names) == ("EXTRA_000001", 30, [])


TRUTH = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\nchr1\t101\ttruth_del\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=160;SVLEN=-60\nchr1\tx\tbad\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=5\nchr1\t9\t.\tN\tNACGT\t.\tq10\tSVTYPE=INS\nshort\tline\n"


def test_truth_and_labels(spark, signals, tmp_path):
    path = tmp_path / "t.vcf"
    path.write_text(TRUTH)
    truth = variants.read_truth(spark, str(path))
    assert [(r.truth_id, r.pos, r.svtype, r.svlen) for r in truth.orderBy("truth_ordinal").collect()] == [("truth_del", 100, "DEL", 60), ("chr1:9:INS", 8, "INS", 4)]
    out = merge.label_candidates(cluster.candidates(signals, 500, 1), truth).orderBy("candidate_id").collect()
    assert [(r.label, r.matched_truth_id, r.pos_distance) for r in out] == [(1, "truth_del", 10), (0, ".", -1)]
    assert variants.read_truth(spark, str(tmp_path / "none.vcf")).count() == 0
    assert out[1].size_similarity == 0.0 and out[1].matched_truth_pos == -1


PRED = [("A", "chr1", 110, 171, "DEL", 61, 2, 1, 0.91, 1), ("B", "chr1", 1000, 1001, "INS", 80, 1, 0, 0.30, 0)]


def test_evaluation_and_vcf(spark, tmp_path):
    pred = spark.createDataFrame(PRED, PREDICTIONS)
    text = metrics.evaluation_report(pred)
    assert "Raw Precision: 0.500000" in text and "GNN F1: 1.000000" in text and "FP reduction: 1 (1.000000)" in text
    assert metrics.evaluation_report(pred.withColumn("label", F.lit(-1))).startswith("No usable labels")
    path = str(tmp_path / "o.vcf")
    assert vcf_out.write_vcf(pred, path, 1, 0.5, fallback=48129895) == 1
    lines = (tmp_path / "o.vcf").read_text().splitlines()
    assert "##contig=<ID=chr1,length=48129895>" in lines
    assert lines[-1].split("\t")[:8] == ["chr1", "111", "SV_1", "N", "<DEL>", "91.00", "PASS", "SVTYPE=DEL;END=171;SVLEN=-61;SUPPORT=2;GNN_PROB=0.910000"]
    assert lines[-1].endswith("GT\t0/1")
    assert vcf_out.write_vcf(pred.where("false"), path, 2) == 0
    assert (tmp_path / "o.vcf").read_text().splitlines()[-1].startswith("#CHROM")


def calls(spark, rows):
    schema = "candidate_id string, chrom string, start bigint, end bigint, svtype string, median_svlen bigint, support_read_count bigint, gnn_prob double, candidate_source string, ordinal bigint"
    base = {"chrom": "chr21", "start": 100, "svtype": "DEL", "size": 100, "n": 3, "p": 0.8, "source": "CIGAR_ONLY"}
    full = [base | r for r in rows]
    return spark.createDataFrame([(f"c{i}", r["chrom"], r["start"], r["start"] + r["size"], r["svtype"], r["size"], r["n"], r["p"], r["source"], i) for i, r in enumerate(full)], schema)


@pytest.mark.parametrize(("rows", "kept"), [
    ([{}, {"p": 0.9, "start": 150}], [1]), ([{}, {"svtype": "INS"}], [0, 1]), ([{}, {"start": 1000}], [0, 1]), ([{}, {"size": 300}], [0, 1]),
    ([{"n": 2}, {"n": 5}], [1]), ([{"source": "EXTRA_ONLY"}, {"source": "CIGAR_EXTRA"}, {}], [1]), ([{}, {}], [0]), ([{"start": 0}, {"start": 400}, {"start": 800, "p": 0.9}], [2]),
    ([{"chrom": None}, {}], [1]), ([], []),
])
def test_dedup(spark, rows, kept):
    assert sorted(r.ordinal for r in select.deduplicate(calls(spark, rows)).collect()) == kept


def test_dedup_report_and_columns(spark):
    c = calls(spark, [{}, {"p": 0.9}, {"svtype": "INS"}])
    assert select.dedup_report(c, select.deduplicate(c)).endswith("removed_by_svtype\nDEL\t1\n")
    assert select.dedup_report(c.where("ordinal = 2"), c.where("ordinal = 2")).endswith("None\t0\n")
    with pytest.raises(ValueError, match="gnn_prob"):
        select.deduplicate(c.drop("gnn_prob"))


def test_supplement_fills_empty_cells_from_the_first_row(spark):
    c = calls(spark, [{"source": ""}, {"source": "X"}])
    more = spark.createDataFrame([("c0", "CIGAR_EXTRA", 7, 0), ("c0", "LATER", 8, 1), ("c1", "CIGAR_EXTRA", 9, 2)], "candidate_id string, candidate_source string, extra_support int, ordinal bigint")
    rows = select.supplement(c, more).orderBy("candidate_id").collect()
    assert [(r.candidate_source, r.extra_support) for r in rows] == [("CIGAR_EXTRA", 7), ("X", 9)]


def test_caller_vcf_filter(spark, tmp_path):
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    text += "21\t500\tb\tN\t<INS>\t.\tPASS\tSVTYPE=INS;SVLEN=60\n21\t100\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=180\n21\t7\tsmall\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-10\n20\t7\tother\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;SVLEN=-100\n"
    (tmp_path / "c.vcf").write_text(text)
    assert variants.filter_caller_vcf(spark, str(tmp_path / "c.vcf"), str(tmp_path / "o.vcf"), "chr21") == 2
    lines = (tmp_path / "o.vcf").read_text().splitlines()
    assert lines[1] == variants.GT_HEADER and [x.split("\t")[2] for x in lines[3:]] == ["a", "b"]
    assert variants.header_with_gt(["##a"]) == ["##a", variants.GT_HEADER]


def test_native_match(spark, signals):
    from breakweave.plans.benchmarks import native_match

    calls_ = spark.createDataFrame([(1, "c", "DEL", 100, -60), (2, "c", "DEL", 9000, 60)], "call_id bigint, chrom string, svtype string, start bigint, median_svlen bigint")
    truth = spark.createDataFrame([("t", "c", 120, "DEL", 70, 0), ("u", "c", 500000, "DEL", 70, 1), ("v", "c", 130, "DEL", 50, 2)], "truth_id string, chrom string, pos bigint, svtype string, svlen bigint, truth_ordinal bigint")
    row = native_match(calls_, truth).first()
    assert (row.tp, row.tp_base, row.fp, row.fn) == (1, 1, 1, 2)
    regions = spark.createDataFrame([("c", 0, 1000), ("c", 50, 1000)], "chrom string, start bigint, end bigint")
    row = native_match(calls_, truth, regions=regions).first()
    assert (row.tp, row.tp_base, row.fp, row.fn) == (1, 1, 0, 1)


def test_one_to_one_is_the_greedy_walk(spark):
    import random

    from breakweave.plans.benchmarks import one_to_one

    rng = random.Random(5)
    c = [(i, "c", "DEL", rng.randrange(3000), rng.randint(50, 150)) for i in range(150)]
    t = [(i, "c", "DEL", rng.randrange(3000), rng.randint(50, 150)) for i in range(150)]
    calls = spark.createDataFrame(c, "call_id bigint, chrom string, svtype string, start bigint, median_svlen bigint")
    truth = spark.createDataFrame(t, "truth_ordinal bigint, chrom string, svtype string, pos bigint, svlen bigint")
    pairs = sorted((abs(a[3] - b[3]), -min(a[4], b[4]) / max(a[4], b[4]), b[0], a[0]) for a in c for b in t if abs(a[3] - b[3]) <= 100 and min(a[4], b[4]) / max(a[4], b[4]) >= 0.7)
    want, used_c, used_t = set(), set(), set()
    for _, _, b, a in pairs:
        if a not in used_c and b not in used_t:
            want.add((a, b))
            used_c.add(a)
            used_t.add(b)
    assert {tuple(r) for r in one_to_one(calls, truth, 100, 0.7).collect()} == want and len(want) > 50


def test_extra_only_rows_count_no_match_and_weak_support_is_one(spark):
    cigar = spark.createDataFrame([(0, "c", 9000, 9100, "DEL", 100)], "ordinal bigint, chrom string, start bigint, end bigint, svtype string, median_svlen bigint")
    extra = spark.createDataFrame([(0, "c", 100, "del", None, 160, 0), (1, "c", 500, "INS", 80, None, None), (2, "c", 700, "DUP", 80, None, 9)], "extra_ordinal bigint, chrom string, start bigint, svtype string, median_svlen bigint, end bigint, support bigint")
    got = {r.candidate_id: r for r in merge.merge_candidates(cigar, extra, min_extra_only_support=1).where("candidate_source = 'EXTRA_ONLY'").collect()}
    a, b = got["EXTRA_000001"], got["EXTRA_000002"]
    assert len(got) == 2 and (a.matched_extra_count, a.extra_support, a.median_svlen, a.end) == (0, 1, -60, 160)
    assert (b.matched_extra_count, b.extra_support, b.median_svlen, b.end) == (0, 1, 80, 501)


def test_missing_median_keeps_the_sign_of_its_type(spark):
    schema = "ordinal bigint, chrom string, start bigint, end bigint, svtype string, median_svlen double"
    got = merge.normalize_cigar(spark.createDataFrame([(0, "c", 100, 200, "DEL", None), (1, "c", 100, 160, "INS", None), (2, "c", 100, None, "DEL", 60.5)], schema)).orderBy("ordinal").collect()
    assert [(r.median_svlen, r.end) for r in got] == [(-100.0, 200), (60.0, 160), (60.5, 160)]


def test_evidence_columns_by_other_names(spark):
    from breakweave.operators import propose

    rows = [("SOFTCLIP_LEFT", "c", "120", "60", None), ("SUPPLEMENTARY", "c", "300", "-70", "ins"), ("SOFTCLIP_RIGHT", "c", "x", "60", None)]
    extra = spark.createDataFrame(rows, "evidence_type string, CHROM string, pos string, SVLEN string, svtype string")
    assert sorted(tuple(r) for r in propose.proposals(extra).collect()) == [("c", 120, "INS", 60, "SOFTCLIP"), ("c", 300, "INS", 70, "SUPPLEMENTARY")]


def test_runs_are_planned_skipped_and_told(tmp_path):
    from breakweave.plans import benchmarks

    at = {"bam": "{chrom}.bam", "truth": "t{chrom}.vcf", "bed": "{chrom}.bed", "out": str(tmp_path / "{chrom}")}
    (tmp_path / "21" / "svim").mkdir(parents=True)
    (tmp_path / "21" / "svim" / "variants.vcf").write_text("x")
    plan = benchmarks.plan_runs(["20", "21"], ["svim"], at, "ref.fa", skip_existing=True)
    assert [c[0] for c in plan] == ["svim", "truvari", "truvari"]
    ran: list = []
    assert len(benchmarks.run_all(plan, dry_run=True, run=ran.append)) == 3 and not ran
    benchmarks.run_all(plan, run=ran.append)
    assert ran == plan


def test_bed_regions(spark, tmp_path):
    from breakweave.sources.tables import read_bed

    (tmp_path / "r.bed").write_text("track x\n#c\n\nchr1\t10\t20\tname\nchr1\t30\t30\nchr2\tx\t5\nchr2 1 5\n")
    assert [tuple(r) for r in read_bed(spark, str(tmp_path / "r.bed")).collect()] == [("chr1", 10, 20), ("chr2", 1, 5)]
    assert read_bed(spark, str(tmp_path / "none.bed")).isEmpty()
