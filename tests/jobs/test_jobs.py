"""Both jobs over growing, repeated and empty input, against their operators over everything."""

import json

import pytest

from breakweave.operators import cluster
from jobs import candidate_refresh, threshold_report
from jobs import queries as jobs

CONFIG = json.loads(candidate_refresh.CONFIG.read_text())
PLAIN = {"signals": ["signal_index", "read_name", "chrom", "event_pos", "svtype", "svlen", "mapq"], "window": 100, "min_support": 1, "min_ratio": 0.5, "region": 1000}
SCHEMA = "signal_index bigint, read_name string, chrom string, event_pos bigint, svtype string, svlen bigint, mapq double"


def signals(spark, rows, at, mode="append"):
    data = [(i, f"r{i % 7}" if i % 5 else None, chrom, pos, kind, size, 30.0) for i, chrom, pos, kind, size in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode(mode).parquet(str(at))


def shown(df):
    return sorted((r.chrom, r.start, r.end, r.svtype, r.median_svlen, r.support_read_count, tuple(r.read_names), tuple(r.signal_indices)) for r in df.collect())


def whole(spark, at, config):
    rows = spark.read.parquet(str(at)).dropna(subset=["chrom", "svtype", "event_pos", "svlen"])
    return shown(cluster.summarize_clusters(cluster.cigar_clusters(rows, config["window"], config["min_ratio"]), config["min_support"]))


def test_growing_input_gives_what_one_run_gives(spark, tmp_path):
    source, out, mark = tmp_path / "signals", str(tmp_path / "out"), str(tmp_path / "mark")
    batches = [
        [(i, c, p, "DEL", 100) for i, (c, p) in enumerate([("1", 100), ("1", 350), ("1", 360), ("1", 2500), ("2", 40), ("2", 5000)])],
        # closes the gap of two islands, so that a candidate moves and another region is left without one
        [(10, "1", 190, "DEL", 110), (11, "1", 270, "DEL", 90), (12, "1", 2590, "DEL", 100), (13, "1", 2680, "DEL", 100), (14, "1", 3200, "INS", 60)],
        [(20, "2", 5001, "DEL", 1000), (21, "2", 5002, "DEL", 20), (22, None, 5, "DEL", 1), (23, "2", None, "DEL", 1), (24, "1", 2400, "DEL", 95)],
    ]
    for n, rows in enumerate(batches):
        signals(spark, rows, source)
        got = shown(candidate_refresh.run(spark, str(source), out, mark, PLAIN))
        assert got == whole(spark, source, PLAIN)
        taken = spark.read.schema(candidate_refresh.SIGNALS).parquet(f"{out}/signals")
        assert sorted(r.signal_index for r in taken.where(f"batch = {n}").collect()) == sorted(r[0] for r in rows if None not in r)
        assert shown(candidate_refresh.run(spark, str(source), out, mark, PLAIN)) == got
        assert taken.select("batch").distinct().count() == n + 1
    regions = spark.read.schema(candidate_refresh.TOUCHED).parquet(f"{out}/touched").where("batch = 2").collect()
    assert {r.chrom for r in regions} == {"1", "2"} and ("2", 0) not in {(r.chrom, r.region) for r in regions}


def test_a_batch_that_failed_is_taken_again(spark, tmp_path, monkeypatch):
    source, out, mark = tmp_path / "signals", str(tmp_path / "out"), str(tmp_path / "mark")
    signals(spark, [(0, "1", 10, "DEL", 100), (1, "1", 20, "DEL", 100)], source)
    candidate_refresh.run(spark, str(source), out, mark, PLAIN)
    signals(spark, [(2, "1", 30, "DEL", 100)], source)
    with monkeypatch.context() as m:
        m.setattr(candidate_refresh, "refreshed", lambda *a: 1 / 0)
        with pytest.raises(Exception):  # noqa: B017 - whatever the stream makes of it
            candidate_refresh.run(spark, str(source), out, mark, PLAIN)
    assert shown(candidate_refresh.run(spark, str(source), out, mark, PLAIN)) == whole(spark, source, PLAIN)
    assert spark.read.schema(candidate_refresh.SIGNALS).parquet(f"{out}/signals").count() == 3


def test_bins_of_a_batch_are_worked_out_once(spark, tmp_path, monkeypatch):
    calls, bins = [], candidate_refresh.cluster.island_bins
    monkeypatch.setattr(candidate_refresh.cluster, "island_bins", lambda *a, **k: calls.append(1) or bins(*a, **k))
    signals(spark, [(i, "1", 10 * i, "DEL", 100) for i in range(50)], tmp_path / "signals")
    got = shown(candidate_refresh.run(spark, str(tmp_path / "signals"), str(tmp_path / "out"), str(tmp_path / "mark"), PLAIN))
    assert len(calls) == 1 and got == whole(spark, tmp_path / "signals", PLAIN)


def test_no_usable_signals(spark, tmp_path):
    source = tmp_path / "signals"
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(str(source))
    assert candidate_refresh.run(spark, str(source), str(tmp_path / "out"), str(tmp_path / "mark"), PLAIN).count() == 0


def test_growing_input_of_the_given_table(spark, tmp_path):
    """The events in two files on a copy: the second run reads the second one only."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    source, out, mark = tmp_path / "events", str(tmp_path / "out"), str(tmp_path / "mark")
    n = events.count()
    events.limit(n // 2).coalesce(1).write.parquet(str(source))
    candidate_refresh.run(spark, str(source), out, mark, CONFIG)
    events.offset(n // 2).coalesce(1).write.mode("append").parquet(str(source))
    got = shown(candidate_refresh.run(spark, str(source), out, mark, CONFIG))
    assert got == shown(jobs.candidate_refresh.run(spark, "/root/testdata/sf0.001/events.parquet", str(tmp_path / "o2"), str(tmp_path / "m2"), CONFIG))
    assert spark.read.schema(candidate_refresh.SIGNALS).parquet(f"{out}/signals").select("batch").distinct().count() == 2


REPORT = {"id": "id", "group": "team", "score": "s", "label": "y", "thresholds": [0.25, 0.5, 0.75], "default_threshold": 0.4}


def report(spark, tmp_path, records, labels):
    spark.createDataFrame(records, "id bigint, team string, s double, label string, threshold string").write.mode("overwrite").parquet(str(tmp_path / "r"))
    spark.createDataFrame(labels, "id bigint, y int").write.mode("overwrite").parquet(str(tmp_path / "l"))
    return threshold_report.run(spark, str(tmp_path / "r"), str(tmp_path / "l"), str(tmp_path / "out"), REPORT)


def test_thresholds_by_group(spark, tmp_path):
    records = [(1, "a", 0.9, "x", "x"), (2, "a", 0.6, None, None), (3, "a", 0.3, "x", "x"), (4, "b", 0.3, "", ""), (4, "b", None, "", ""), (5, None, 0.45, "", ""), (None, "b", 1.0, "", "")]
    labels = [(1, 1), (2, 1), (2, 0), (3, 0), (4, None), (9, 1)]
    for _ in range(2):
        out = report(spark, tmp_path, records, labels)
        got = sorted((r.team, r.id or -1, r.score, r.label, r.threshold, r.kept) for r in out.collect())
    want = [("(none)", 5, 0.45, None, 0.4, True), ("a", 1, 0.9, 1, 0.5, True), ("a", 2, 0.6, 1, 0.5, True), ("a", 3, 0.3, 0, 0.5, False), ("b", -1, 1.0, None, 0.4, True), ("b", 4, 0.0, None, 0.4, False), ("b", 4, 0.3, None, 0.4, False)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    swept = {(r.team, r.threshold): (r.tp, r.fp, r.fn, r.tn) for r in spark.read.parquet(str(tmp_path / "out/sweep")).collect()}
    assert swept == {("a", 0.25): (2, 1, 0, 0), ("a", 0.5): (2, 0, 0, 1), ("a", 0.75): (1, 0, 1, 1)}


def test_no_records(spark, tmp_path):
    assert report(spark, tmp_path, [], []).count() == 0


@pytest.mark.parametrize("job", [candidate_refresh, threshold_report])
def test_command_lines(job, capsys):
    with pytest.raises(SystemExit) as e:
        job.main(["--help"])
    assert e.value.code == 0 and "--out" in capsys.readouterr().out
