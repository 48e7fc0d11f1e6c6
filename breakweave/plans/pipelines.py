"""The two calling pipelines as one lazy plan each; every stage table can be written as a side output."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cluster, extract, gnn, graph, merge, metrics, propose, select
from ..sources import alignments, variants, vcf_out
from ..sources.stages import StageTables
from ..sources.tables import exists, write_text, write_tsv


@dataclass
class Stages:
    """Every table of a run, by name, and the reports written."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)
    vcf_records: int | None = None


#: Sort orders of the written tables.
_ORDERS = {
    "signals": ["signal_index"], "candidates": ["candidate_id"], "extra_signals": ["extra_index"], "predictions": ["candidate_id"],
    "candidates_labeled": ["candidate_id"], "candidates_for_graph": ["candidate_id"],
}


def _require(spark: SparkSession, **paths: str | None) -> None:
    for label, path in paths.items():
        if path is not None and not exists(spark, path):
            raise FileNotFoundError(f"{label} file is missing: {path}")


def _signals(stage: StageTables, path: str, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Records, scanned once for all extractions, and indexed signals."""
    records = stage.put("records", alignments.read_alignments(stage.spark, path))
    return records, stage.put("signals", extract.indexed_signals(extract.extract_signals(records, min_size)))


def _write(stages: Stages, outdir: str | None, sample: str) -> None:
    if outdir is None:
        return
    for name, df in stages.tables.items():
        if any(kind.startswith(("array<array", "struct", "map")) for _, kind in df.dtypes):
            df.write.mode("overwrite").parquet(f"{outdir}/{name}.parquet")
            continue
        path = f"{outdir}/{name}.tsv"
        write_tsv(df, path, [c for c in _ORDERS.get(name, ["chrom", "start"]) if c in df.columns])
        stages.files[name] = path


def run_v1(spark: SparkSession, bam: str, model: str, outdir: str | None = None, truth: str | None = None, min_size: int = 50, window: int = 500, min_support: int = 1, max_dist: int = 500, min_size_sim: float = 0.7, threshold: float = 0.5, sample: str = "SAMPLE", vcf: bool = True) -> Stages:
    """Signals, clusters, labels, graphs of 16 features, prediction, probability filter, VCF, evaluation."""
    _require(spark, bam=bam, model=model, truth=truth)
    out = Stages()
    stage = StageTables(spark)
    _, signals = _signals(stage, bam, min_size)
    found = stage.put("candidates", cluster.candidates(signals, window, min_support))
    labeled = merge.label_candidates(found, variants.read_truth(spark, truth), max_dist, min_size_sim) if truth else merge.unlabeled(found)
    labeled = stage.put("labeled", labeled)
    nodes = stage.put("nodes", graph.nodes_v1(labeled, signals))
    rows = stage.put("graphs", graph.graphs(labeled, nodes, graph.edges(nodes, 1)))
    weights, _ = gnn.load_model(model)
    pred = stage.put("predictions", gnn.predict(rows, weights, threshold))
    kept = select.by_probability(pred, threshold)
    out.tables = {"signals": signals.drop("record_ordinal", "event_ordinal"), "candidates": found, "candidates_labeled": labeled, "dataset": rows, "predictions": pred, "filtered_candidates": kept}
    _write(out, outdir, sample)
    if outdir and vcf:
        out.files["vcf"] = f"{outdir}/filtered.vcf"
        out.vcf_records = vcf_out.write_vcf(pred, out.files["vcf"], 1, threshold, sample=sample)
    if outdir and truth:
        out.files["evaluation"] = f"{outdir}/evaluation.txt"
        write_text(out.files["evaluation"], metrics.evaluation_report(pred, threshold))
    return out


def run_v2(
    spark: SparkSession, bam: str, model: str, outdir: str | None = None, truth: str | None = None, min_size: int = 50, min_clip: int = 50, window: int = 500, min_support: int = 1,
    propose_extra: bool = False, extra_window: int = 500, extra_min_support: int | None = None, softclip_support: int | None = None, sa_support: int | None = None,
    supplementary_support: int | None = None, min_extra_only_support: int = 30, max_dist: int = 500, min_size_sim: float = 0.5, graph_window: int = graph.EXTRA_WINDOW,
    read_edge_window: int = graph.READ_EDGE_WINDOW, threshold: float = 0.5, dedup: bool = False, dedup_window: int = 500, dedup_size_sim: float = 0.5, sample: str = "SAMPLE",
    contig_length: int | None = None,
) -> Stages:
    """Adds extra evidence, optional proposals and merging, graphs of 18 features, the wider filter and deduplication.

    Deduplication sees candidate_source only if a truth set was given, because it is read from the labelled table;
    evaluation looks at the predictions before deduplication.
    """
    _require(spark, bam=bam, model=model, truth=truth)
    out = Stages()
    stage = StageTables(spark)
    records, signals = _signals(stage, bam, min_size)
    extra = stage.put("extra_signals", extract.global_ordinal(extract.extract_extra(records, min_clip), "extra_index", extract.extra_order()))
    found = stage.put("candidates", cluster.candidates(signals, window, min_support))
    out.tables |= {"signals": signals.drop("record_ordinal", "event_ordinal"), "candidates": found, "extra_signals": extra.drop("record_ordinal", "event_ordinal")}
    if propose_extra:
        support = cluster.source_support(extra_min_support, softclip_support, sa_support, supplementary_support)
        more = cluster.extra_candidates(propose.proposals(extra, min_size), extra_window, min_size, support)
        more = stage.put("extra_candidates", extract.global_ordinal(more, "extra_ordinal", [*cluster.extra_candidate_order(), F.col("source")]))
        numbered = found.withColumn("ordinal", F.regexp_extract("candidate_id", r"(\d+)$", 1).cast("bigint") - 1)
        found = merge.merge_candidates(numbered, more, extra_window, min_size_sim, min_extra_only_support).drop("_order", "_side")
        found = stage.put("merged", found)
        out.tables |= {"extra_candidates": more.drop("extra_ordinal"), "candidates_v3_merged": found}
    labeled = merge.label_candidates(found, variants.read_truth(spark, truth), max_dist, min_size_sim) if truth else merge.unlabeled(found)
    labeled = stage.put("labeled", labeled)
    out.tables["candidates_labeled" if truth else "candidates_for_graph"] = labeled
    nodes = stage.put("nodes", graph.nodes_v2(labeled, signals, extra, graph_window))
    rows = stage.put("graphs", graph.graphs(labeled, nodes, graph.edges(nodes, 2, read_edge_window)))
    weights, _ = gnn.load_model(model)
    pred = stage.put("predictions", gnn.predict(rows, weights, threshold))
    kept = select.by_call(pred, threshold)
    out.tables |= {"dataset_v2": rows, "predictions_v2": pred, "filtered_candidates": kept}
    final = kept
    if dedup:
        calls = extract.global_ordinal(kept, "ordinal", [X.chrom_key("chrom"), F.col("start"), F.col("candidate_id")])
        calls = stage.put("calls", calls)
        if truth:
            calls = select.supplement(calls, extract.global_ordinal(labeled, "ordinal", [X.chrom_key("chrom"), F.col("start"), F.col("svtype"), F.col("candidate_id")]))
        best = stage.put("best", select.deduplicate(calls, dedup_window, dedup_size_sim))
        final = best.drop("ordinal")
        out.tables["filtered_candidates_dedup"] = final
        if outdir:
            out.files["dedup_summary"] = f"{outdir}/dedup_summary.txt"
            write_text(out.files["dedup_summary"], select.dedup_report(calls, best))
    _write(out, outdir, sample)
    if outdir:
        out.files["vcf"] = f"{outdir}/filtered{'_dedup' if dedup else ''}.vcf"
        out.vcf_records = vcf_out.write_vcf(final, out.files["vcf"], 2, threshold, lengths=alignments.contig_lengths(spark, bam), fallback=contig_length, sample=sample)
        if truth:
            out.files["evaluation"] = f"{outdir}/evaluation_v2.txt"
            write_text(out.files["evaluation"], metrics.evaluation_report(pred, threshold))
    return out
