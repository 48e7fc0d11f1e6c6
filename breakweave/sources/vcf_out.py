"""Calls as VCF lines: three versions of header and record, and single-file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .bgzf import write_bgzf_vcf
from .tables import write_lines

#: Header lines that every version shares: fixed values of the format.
INFO_LINES = (
    '##ALT=<ID=DEL,Description="Deletion">',
    '##ALT=<ID=INS,Description="Insertion">',
    '##FILTER=<ID=PASS,Description="All filters passed">',
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="Last position that the call covers">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length of the variant">',
    '##INFO=<ID=SUPPORT,Number=1,Type=Integer,Description="Number of supporting reads">',
    '##INFO=<ID=GNN_PROB,Number=1,Type=Float,Description="Probability of the graph model">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
)
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


def contig_length(chrom: str, lengths: dict[str, int], fallback: int | None = None) -> int | None:
    """Exact name, then with or without 'chr', then the fallback."""
    other = chrom[3:] if chrom.startswith("chr") else f"chr{chrom}"
    return lengths.get(chrom, lengths.get(other, fallback))


def chromosomes(pred: DataFrame) -> list[str]:
    """Distinct contigs in sort order; there are as many as the genome has."""
    key = X.chrom_key("chrom")
    return [r.chrom for r in pred.select("chrom").where("chrom is not null and chrom <> ''").distinct().orderBy(key).collect()]


def header(source: str, chroms: list[str], lengths: dict[str, int] | None = None, fallback: int | None = None, sample: str = "SAMPLE") -> list[str]:
    """Header lines; a contig without a known length has none."""
    contigs = []
    for c in chroms:
        n = contig_length(c, lengths or {}, fallback)
        contigs.append(f"##contig=<ID={c}>" if n is None else f"##contig=<ID={c},length={n}>")
    return ["##fileformat=VCFv4.2", f"##source={source}", *contigs, *INFO_LINES, f"{COLUMNS}\t{sample}"]


def record_columns(genotype: str, prefix: str, number: Column) -> Column:
    """One record line of a prediction row."""
    size, start = X.export_length(), X.whole("start")
    deletion = F.col("svtype") == "DEL"
    end = F.when(deletion, F.greatest(X.whole("end"), start + size)).otherwise(start + 1)
    prob = X.number_or("gnn_prob")
    info = F.concat(
        F.lit("SVTYPE="), F.col("svtype"), F.lit(";END="), end.cast("string"), F.lit(";SVLEN="), F.when(deletion, -size).otherwise(size).cast("string"),
        F.lit(";SUPPORT="), X.whole("support_read_count").cast("string"), F.lit(";GNN_PROB="), X.sixes(prob),
    )
    return F.concat_ws(
        "\t", F.col("chrom"), (start + 1).cast("string"), F.concat(F.lit(f"{prefix}_"), number.cast("string")), F.lit("N"), F.concat(F.lit("<"), F.col("svtype"), F.lit(">")),
        F.format_string("%.2f", prob * 100), F.lit("PASS"), info, F.lit("GT"), F.lit(genotype),
    )


def _ranked(rows: DataFrame) -> DataFrame:
    from ..operators.bandjoin import numbered

    order = [F.col("start"), F.col("end"), F.col("svtype")] + [F.col(c) for c in ("candidate_id",) if c in rows.columns]
    return numbered(rows.withColumn("_key", X.chrom_key("chrom")), "number", ["_key"], [F.min("_key")], order, 1)


def records(pred: DataFrame, version: int = 2, threshold: float = 0.5, prefix: str = "SV") -> DataFrame:
    """(number, line): the records of a version.

    1 keeps probability at or above the threshold with genotype 0/1; 2 also keeps what the model called, with ./.;
    3 is version 1's filter with ./. for a threshold sweep. Rows without a start or an end have no record.
    """
    rows = pred.where(F.col("svtype").isin("DEL", "INS") & X.number_or("start", None).isNotNull() & X.number_or("end", None).isNotNull())
    keep = X.number_or("gnn_prob") >= threshold
    if version == 2 and "gnn_pred" in pred.columns:
        keep = keep | (X.number_or("gnn_pred") == 1)
    genotype = "0/1" if version == 1 else "./."
    return _ranked(rows.where(keep)).select("number", record_columns(genotype, prefix, F.col("number")).alias("line"))


def write_vcf(pred: DataFrame, path: str, version: int = 2, threshold: float = 0.5, source: str | None = None, lengths: dict[str, int] | None = None, fallback: int | None = None, sample: str = "SAMPLE", prefix: str = "SV", compress: bool = False) -> int:
    """Writes one VCF file; returns the number of records. Contigs come from all predictions, filtered or not.

    A compressed file is blocked gzip, with its tabix index beside it.
    """
    rows = records(pred, version, threshold, prefix)
    head = header(source or f"breakweave_v0.{version}", chromosomes(pred), lengths, fallback, sample)
    lines = pred.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "number bigint, line string")
    if compress:
        write_bgzf_vcf(lines.unionByName(rows), path, ["number"])
    else:
        write_lines(lines.unionByName(rows), path, ["number"])
    return rows.count()


def write_sweep(pred: DataFrame, outdir: str, thresholds, chrom: str, fallback: int | None = None) -> dict[float, str]:
    """One VCF file per threshold for one chromosome; the header names the contig with 'chr' whatever the rows say."""
    from ..operators.select import on_chromosome

    rows, out = on_chromosome(pred, chrom).cache(), {}
    bare = chrom[3:] if chrom.startswith("chr") else chrom
    for t in thresholds:
        path = f"{outdir}/threshold_{t:.2f}.vcf"
        body = records(rows, 3, t)
        head = header("breakweave_sweep", [f"chr{bare}"] if fallback else [], {}, fallback)
        lines = pred.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "number bigint, line string")
        write_lines(lines.unionByName(body), path, ["number"])
        out[t] = path
    rows.unpersist()
    return out
