"""Scans, folds and components cut into small pieces against the same in one piece, and what their plans hold."""

import random

import pytest
from pyspark.sql import functions as F

from breakweave.operators import bandjoin, cluster, metrics, select

SCHEMA = "signal_index bigint, read_name string, chrom string, svtype string, event_pos bigint, svlen bigint, mapq double"


def signals(spark, n, seed, gap=40, lengths=(50, 60, 90, 200, 400)):
    rng, rows, pos = random.Random(seed), [], 0
    for i in range(n):
        pos += rng.choice([0, 1, gap, gap, gap if rng.random() < 0.98 else 10 * gap])
        rows.append((i, f"r{i % 9}", rng.choice(["1", "2"]) if n < 100 else "1", rng.choice(["DEL", "DEL", "INS"]), pos, rng.choice(lengths), 3.0))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def told(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("scan", [1, 3, 4096])
def test_islands_in_stretches(spark, scan):
    rows = signals(spark, 300, 1)
    got = {(r.chrom, r.svtype, r._bin): r.island for r in cluster.island_bins(rows, ["chrom", "svtype"], "event_pos", 100, scan=scan).collect()}
    want, last, start = {}, {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.event_pos):
        key = (r.chrom, r.svtype)
        if key not in last or r.event_pos - last[key] > 100:
            start[key] = r.event_pos
        last[key] = r.event_pos
        want[*key, r.event_pos // 100] = start[key]
    # a bin's rows are of one island, that of its last row as well as of its first
    assert got == want


@pytest.mark.parametrize(("chunk_rows", "seed"), [(3, 2), (10, 3), (50, 4), (250, 5)])
def test_fold_in_chunks(spark, chunk_rows, seed):
    rows = signals(spark, 260, seed)
    one = told(cluster.cigar_clusters(rows, 100), "signal_index", "cluster", "member")
    assert told(cluster.cigar_clusters(rows, 100, chunk_rows=chunk_rows), "signal_index", "cluster", "member") == one


def test_one_island_of_all_rows_with_many_repairs(spark):
    """Alternating lengths: where a cluster begins depends on every row before, so each chunk's fold from its start is wrong."""
    rows = [(i, "r", "1", "DEL", i, (100, 150, 220, 330, 500)[i % 5], 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = told(cluster.cigar_clusters(df, 100), "signal_index", "cluster", "member")
    assert told(cluster.cigar_clusters(df, 100, chunk_rows=7), "signal_index", "cluster", "member") == one
    calm = spark.createDataFrame([(i, "r", "1", "DEL", i, 100, 1.0) for i in range(60)], SCHEMA)
    assert {r.cluster for r in cluster.cigar_clusters(calm, 100, chunk_rows=9).collect()} == {0}


def test_only_heads_of_chunks_are_folded_again(spark, monkeypatch):
    """A chunk is mended up to the first cluster that begins either way; what is read for that is no second copy of the rows."""
    rows, put, sizes = signals(spark, 900, 7), cluster.StageTables.put, {}
    one = told(cluster.cigar_clusters(rows, 1000), "signal_index", "cluster", "member")
    monkeypatch.setattr(cluster.StageTables, "put", lambda *a: sizes.setdefault(a[1], put(*a)))
    monkeypatch.setattr(cluster, "HEAD", 2)
    assert told(cluster.cigar_clusters(rows, 1000, chunk_rows=100), "signal_index", "cluster", "member") == one
    rounds = [t.count() for name, t in sizes.items() if name.startswith("round")]
    assert rounds[0] >= 800 and len(rounds) > 1 and sum(rounds[1:]) < 300


@pytest.mark.parametrize("head", [1, 3])
def test_heads_that_are_too_short(spark, monkeypatch, head):
    names = ("signal_index", "cluster", "member", "event_pos", "svlen", "mapq")
    monkeypatch.setattr(cluster, "HEAD", head)
    rows = spark.createDataFrame([(i, "r" if i % 3 else None, "1", "DEL", i, (100, 150, 220, 330, 500)[i % 5 if i < 60 else 0], 1.0) for i in range(120)], SCHEMA)
    one = told(cluster.cigar_clusters(rows, 100), *names)
    assert told(cluster.cigar_clusters(rows, 100, chunk_rows=20), *names) == one and len(one) == 120


def calls(spark, n, seed, spread=30):
    rng = random.Random(seed)
    rows = [(i, "1", rng.choice(["DEL", "INS"]), rng.randint(0, n * spread), rng.choice([50, 70, 90, 150, 400, 900, 0])) for i in range(n)]
    return spark.createDataFrame(rows, "ordinal bigint, chrom string, svtype string, start bigint, median_svlen bigint")


def plain_components(rows, window):
    parent = {r.ordinal: r.ordinal for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in rows:
        for b in rows:
            if a.svtype == b.svtype and abs(a.start - b.start) <= window and min(a.median_svlen, b.median_svlen) > 0 and min(a.median_svlen, b.median_svlen) / max(a.median_svlen, b.median_svlen) >= 0.5:
                p, q = root(a.ordinal), root(b.ordinal)
                parent[max(p, q)] = min(p, q)
    return sorted((i, root(i)) for i in parent)


@pytest.mark.parametrize(("chunk_rows", "spread", "seed"), [(10, 30, 1), (5, 3, 2), (10, 200, 3), (1000, 30, 4), (10, 0, 5)])
def test_components_in_chunks(spark, chunk_rows, spread, seed):
    df = calls(spark, 150, seed, spread)
    got = select.duplicate_components(df.repartition(3), 100, chunk_rows=chunk_rows)
    assert sorted((r.ordinal, r.component) for r in got.collect()) == plain_components(df.collect(), 100)


def test_a_chain_over_all_chunks(spark):
    df = spark.createDataFrame([(i, "1", "DEL", i * 100, 60) for i in range(200)], "ordinal bigint, chrom string, svtype string, start bigint, median_svlen bigint")
    assert {r.component for r in select.duplicate_components(df, 100, chunk_rows=10).collect()} == {0}


def test_running_sums_and_ordinals(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.randint(0, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, s double, v bigint").repartition(5)
    total, want = 0, {}
    for k, (i, _, v) in enumerate(sorted(rows, key=lambda r: r[1])):
        want[i] = (k, total)
        total += v
    got = {r.i: r.below for r in bandjoin.running_sum(df, "below", "v", [F.col("s")], 7).collect()}
    place = {r.i: r.place for r in bandjoin.global_ordinal(df, "place", [F.col("s")], 7).collect()}
    assert {i: (place[i], got[i]) for i in got} == want
    assert bandjoin.running_sum(df.where("i < 0"), "below", "v", [F.col("s")]).count() == 0


def test_no_window_over_everything(spark):
    """Windows without a partition hold one row per range partition only."""
    pred = spark.createDataFrame([(i % 2, i / 50) for i in range(50)], "label int, gnn_prob double")
    for df in (metrics.roc_auc(pred), cluster.gap_islands(signals(spark, 50, 1), ["chrom", "svtype"], "event_pos", 100)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "island" not in line:
                assert "_part" in line or "_stretch" in line, line


def test_nearest_against_all_pairs(spark):
    """Copies, zero sizes, ties and places that only the widest band reaches."""
    rng = random.Random(8)
    side = lambda n: [(i, rng.choice("ab"), rng.randint(0, 400) * 7, float(rng.choice([0, 50, 60, 70, 100, 140, 500]))) for i in range(n)]
    a, b = side(150), side(60)
    left, right = spark.createDataFrame(a, "i bigint, k string, p bigint, z double"), spark.createDataFrame(b, "o bigint, k string, q bigint, y double")
    for width, least in ((300, 0.5), (300, 1.0), (40, 0.7), (300, 0.0)):
        want = {}
        for _, k, p, z in a:
            for o, kk, q, y in b:
                sim = min(z, y) / max(z, y) if z > 0 and y > 0 else 0.0
                if k == kk and abs(p - q) <= width and sim >= least:
                    want[k, p, z] = min(want.get((k, p, z), (1e9,)), (abs(p - q), -sim, o))
        got = bandjoin.nearest(left, right, ["k"], "p", "z", "q", "y", width, least, "o").collect()
        assert len(got) == len(want) and {(r.k, r.p, r.z): (r.dist, -r.sim, r.o) for r in got} == want


def test_labels_do_not_list_a_dense_band(spark, monkeypatch):
    """300 copies of a call and of a truth row are 90,000 pairs; what a join makes stays in proportion to the rows."""
    from breakweave.operators import merge

    calls = spark.range(300).selectExpr("concat('c', id) as candidate_id", "'1' as chrom", "'DEL' as svtype", "1000 as start", "100 as median_svlen")
    truth = spark.range(300).selectExpr("concat('t', 299 - id) as truth_id", "'1' as chrom", "'DEL' as svtype", "1003 as pos", "-90 as svlen", "299 - id as truth_ordinal")
    seen, plain = [], bandjoin.band_join
    monkeypatch.setattr(bandjoin, "band_join", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    got = merge.label_candidates(calls, truth).collect()
    assert {(r.matched_truth_id, r.matched_truth_svlen, r.pos_distance, r.size_similarity) for r in got} == {("t0", -90, 3, 0.9)} and len(got) == 300
    assert seen and sum(p.count() for p in seen) < 300


def test_long_islands_stream_through_their_tasks(spark):
    """Neither fold nor components take a chunk as one group: plans of long islands have no grouped Python step."""
    import inspect

    for step in (cluster._in_chunks, select._in_chunks):
        assert "applyInPandas" not in inspect.getsource(step) and "mapInPandas" in inspect.getsource(step)
    rows = [(0, "1", 5, 60.0, 1), (0, "1", 9, 61.0, 0), (0, "2", 9, 61.0, 2), (1, "2", 9, 61.0, 3)]
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["chunk", "chrom", "start", "size", "ordinal"])
    # one island over two batches
    got = pd.concat(select._components(10, 0.5, ["chunk", "chrom"], ["ordinal"])(iter([frame[:1], frame[1:]])))
    assert got.values.tolist() == [[1, 0], [0, 0], [2, 2], [3, 3]]


def test_one_to_one_in_chunks_is_the_greedy_walk(spark, monkeypatch):
    """Copies, ties and very small chunks; the pairs of a dense band are not listed by a join."""
    import random

    from breakweave.operators import bandjoin, matching

    monkeypatch.setattr(bandjoin, "band_join", lambda *a, **k: 1 / 0)
    for seed, span, sizes in ((1, 4000, (50, 150)), (2, 300, (1, 4)), (3, 40, (0, 3)), (4, 6000, (10, 11))):
        rng = random.Random(seed)
        rows = lambda: [(i, rng.choice("ab"), "DEL", rng.randrange(span), rng.randint(*sizes)) for i in rng.sample(range(10**17, 10**17 + 5000), 300)]  # noqa: B023, E731
        c, t = rows(), rows()
        calls = spark.createDataFrame(c, "call_id bigint, chrom string, svtype string, pos bigint, size bigint")
        truth = spark.createDataFrame(t, "truth_ordinal bigint, chrom string, svtype string, pos bigint, size bigint")
        alike = lambda a, b: min(a, b) / max(a, b) if a and b else 0.0
        pairs = sorted((abs(a[3] - b[3]), -alike(a[4], b[4]), b[0], a[0]) for a in c for b in t if a[1] == b[1] and abs(a[3] - b[3]) <= 60 and alike(a[4], b[4]) >= 0.5)
        want, used_c, used_t = set(), set(), set()
        for _, _, b, a in pairs:
            if a not in used_c and b not in used_t:
                want.add((a, b))
                used_c.add(a)
                used_t.add(b)
        for half in (20, 10_000):
            got = [tuple(r) for r in matching.one_to_one(calls, truth, 60, 0.5, half).collect()]
            assert set(got) == want and len(got) == len(want) > 100


def test_extraction_works_out_its_arrays_once(spark):
    """A filter that Spark infers from a plain explode would hold the whole extraction a second time."""
    from breakweave.operators import extract
    from breakweave.plans.adapters import adapter

    records = adapter(spark, "/root/testdata/sf0.001", "alignments")
    for df in (extract.extract_extra(records).where("evidence_type = 'SUPPLEMENTARY'"), extract.extract_signals(records)):
        filters = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if " Filter " in line]
        assert filters and not any("regexp_extract" in line for line in filters)


def test_bam_records_travel_as_arrow():
    """Records of a split come and go in Arrow batches, with nulls and numbers as they were."""
    import pyarrow as pa

    from breakweave.sources import alignments, bgzf

    rows = [("q", 0, "a", 7, 60, "5S10M", 15, "b,1,+,10M,5,0;", 3), ("r", 4, None, None, 0, None, 0, None, None), ("s", 16, "b", 2**31 - 2, 255, "1H2X", 2, None, -(2**31))]
    data = b"".join(alignments._bam_bytes({"a": 0, "b": 1}, *row) for row in rows * 2000)
    packer = bgzf.Packer(3)
    blocks = [*packer.add(data), *packer.rest()]
    batch = pa.RecordBatch.from_pydict({"value": [b"", *[b[4:] for b in blocks]], "split": [0] * (len(blocks) + 1)})
    got = list(alignments._bam_splits([batch], ["a", "b"], [2**31 - 1] * 2, 0))
    assert all(isinstance(b, pa.RecordBatch) for b in got)
    told = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert [r[2:11] for r in told[:-1]] == rows * 2000 and [r[1] for r in told[:-1]] == list(range(6000)) and told[-1][-2:] == (True, False)


def test_duplicate_pairs_meet_once(spark):
    """All pairs, equal starts and ordinals in either order too, of bins that are met on one side only."""
    import random

    from breakweave.operators import select

    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), "DEL", rng.randrange(-400, 400), rng.randint(0, 9)) for i in rng.sample(range(1000), 200)]
    calls = spark.createDataFrame(rows, "ordinal bigint, chrom string, svtype string, start bigint, median_svlen bigint")
    got = select.duplicate_pairs(calls, 50)
    near = lambda x, y: x[0] < y[0] and x[1] == y[1] and abs(x[3] - y[3]) <= 50 and x[4] * y[4] and min(x[4], y[4]) / max(x[4], y[4]) >= 0.5
    assert sorted(map(tuple, got.collect())) == sorted((x[0], y[0]) for x in rows for y in rows if near(x, y))
    assert "array(-1, 0, 1)" not in got._jdf.queryExecution().toString() and "[-1,0,1]" not in got._jdf.queryExecution().toString()


def test_growing_tables_are_not_broadcast(spark):
    """Small files may hold many rows, and rows are exploded behind them: nothing that grows with the input goes whole to the driver."""
    from breakweave.operators import bandjoin, merge

    left = spark.range(100).selectExpr("'1' as chrom", "id as a")
    cigar = spark.range(50).selectExpr("'1' as chrom", "id * 10 as start", "id * 10 + 60 as end", "'DEL' as svtype", "60D as median_svlen", "id as ordinal")
    extra = spark.range(50).selectExpr("'1' as chrom", "id * 11 as start", "id * 11 + 60 as end", "'DEL' as svtype", "-60 as median_svlen", "40 as support", "'SA' as source", "id as extra_ordinal")
    truth = spark.range(50).selectExpr("'1' as chrom", "id * 11 as pos", "'DEL' as svtype", "60 as svlen", "id as truth_ordinal", "concat('t', id) as truth_id")
    plans = [bandjoin.band_join(left, left.withColumnRenamed("a", "b"), ["chrom"], "a", "b", 5), merge.best_cigar_match(merge.normalize_cigar(cigar), merge.normalize_extra(extra)), merge.label_candidates(cigar, truth), select.duplicate_pairs(cigar)]
    for df in plans:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString() and df.count()
    # offsets of partitions are all that is broadcast in merging
    assert merge.merge_candidates(cigar, extra)._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") <= 1
