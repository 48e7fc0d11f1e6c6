"""Variant files: truth sets, caller files that keep their lines, and benchmark summaries in JSON."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from .schemas import TRUTH
from .tables import empty, exists

#: The sample genotype header that records with GT need.
GT_HEADER = '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'
#: Metrics of a benchmark summary, as they are named there.
SUMMARY_FLOATS, SUMMARY_COUNTS = ("precision", "recall", "f1"), ("TP-comp", "TP-base", "FP", "FN")


def _field(n: int) -> Column:
    return F.get(F.split("value", "\t"), F.lit(n))


def truth_columns(lines: DataFrame, allowed: tuple[str, ...] = ("DEL", "INS")) -> DataFrame:
    """Truth rows of VCF lines (value, ordinal): 0-based pos, absolute length, FILTER not looked at.

    The length is SVLEN's, else that to a positive END, else that of a literal insertion of two bases or more; rows
    without one are skipped. Types are compared as they are written.
    """
    rows = lines.where(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) >= 8))
    rows = rows.select("ordinal", _field(0).alias("chrom"), _field(1).alias("p"), _field(2).alias("id"), _field(4).alias("alt"), X.info_map(_field(7)).alias("info"))
    symbolic = F.col("alt").startswith("<") & F.col("alt").endswith(">")
    told = F.split_part(X.info_text(F.col("info"), "SVTYPE"), F.lit(","), F.lit(1))
    svtype = F.when(told != "", told).when(symbolic, F.regexp_replace("alt", "^[<>]+|[<>]+$", "")).otherwise("")
    rows = rows.select("*", svtype.alias("svtype"), F.when(F.trim("p").rlike(r"^[+-]?\d+$"), F.trim("p").try_cast("bigint") - 1).alias("pos"))
    own, end = F.abs(X.first_int(F.col("info")["SVLEN"])), X.first_int(F.col("info")["END"])
    reach = F.when(end > 0, F.abs(end - F.col("pos"))).otherwise(0)
    literal = (F.col("svtype") == "INS") & (F.length("alt") > 1) & ~F.col("alt").startswith("<")
    svlen = F.when(own > 0, own).when(reach > 0, reach).when(literal, F.length("alt") - 1).otherwise(0)
    rows = rows.select("*", svlen.cast("bigint").alias("svlen")).where(F.col("svtype").isin(*allowed) & F.col("pos").isNotNull() & (F.col("svlen") > 0))
    named = F.coalesce(F.when(~F.col("id").isin("", "."), F.col("id")), F.concat_ws(":", "chrom", "p", "svtype"))
    return rows.select(named.alias("truth_id"), "chrom", "pos", "svtype", "svlen", F.col("ordinal").alias("truth_ordinal"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ordinal) of a text or gzip file, ordinal rising with the place in the file."""
    at = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return spark.read.text(path).select("value", at.alias("ordinal"))


def read_truth(spark: SparkSession, path: str, allowed: tuple[str, ...] = ("DEL", "INS")) -> DataFrame:
    """Truth rows of a VCF file; a file that can't be opened is an empty truth set."""
    if not exists(spark, path):
        return empty(spark, TRUTH)
    return truth_columns(read_lines(spark, path), allowed)


def caller_columns(lines: DataFrame, chrom: str | None, sizemin: int = 50) -> DataFrame:
    """DEL and INS records of a caller's VCF lines with their svtype and svlen, whole lines kept.

    Without a readable SVLEN the length counts from the 1-based position to END, unlike in truth rows; without a
    readable END either it is 0. Contigs are compared as they are written, with or without 'chr'.
    """
    rows = lines.where(~F.col("value").startswith("#") & (F.size(F.split("value", "\t")) >= 8))
    rows = rows.select("*", _field(0).alias("chrom"), X.decimal_text(_field(1)).cast("bigint").alias("pos1"), F.upper(_field(4)).alias("alt"), X.info_map(_field(7)).alias("info"))
    told, info = F.upper(X.info_text(F.col("info"), "SVTYPE")), F.col("info")
    svtype = F.when(told != "", told).when(F.col("alt").isin("<DEL>", "DEL", "<INS>", "INS"), F.regexp_replace("alt", "[<>]", "")).otherwise("")
    # the whole field must be a number here, not its first part
    end = F.when(F.map_contains_key(info, "END"), F.when(info["END"].isNull(), F.lit(1).cast("bigint")).otherwise(X.decimal_text(info["END"]).cast("bigint"))).otherwise(F.col("pos1"))
    svlen = F.coalesce(F.abs(X.first_int(info["SVLEN"], None)), F.abs(end - F.col("pos1")), F.lit(0).cast("bigint"))
    rows = rows.select("value", "ordinal", "chrom", "pos1", svtype.alias("svtype"), svlen.alias("svlen"))
    rows = rows.where(F.col("svtype").isin("DEL", "INS") & (F.col("svlen") >= sizemin))
    return rows.where(F.col("chrom").isin(*X.chrom_aliases(chrom))) if chrom else rows


def header_with_gt(header: list[str]) -> list[str]:
    """Header lines with the genotype format line, before the column line or at the end."""
    if any(h.startswith("##FORMAT=<ID=GT,") for h in header):
        return list(header)
    at = next((i for i, h in enumerate(header) if h.startswith("#CHROM")), len(header))
    return [*header[:at], GT_HEADER, *header[at:]]


def filter_caller_vcf(spark: SparkSession, path: str, out: str, chrom: str | None = None, sizemin: int = 50, compress: bool = False) -> int:
    """Writes the caller's DEL and INS records sorted by position under its own header; returns how many.

    A compressed file is blocked gzip, with its tabix index beside it.
    """
    from .bgzf import write_bgzf_vcf
    from .tables import write_lines

    lines = read_lines(spark, path)
    # a VCF header is a few thousand lines at most, whatever the number of records
    header = [r.value for r in lines.where(F.col("value").startswith("#")).orderBy("ordinal").collect()]
    rows = caller_columns(lines, chrom, sizemin).select("value", X.chrom_key("chrom").alias("_key"), "pos1", "ordinal")
    head = spark.createDataFrame([(h, i) for i, h in enumerate(header_with_gt(header))], "line string, ordinal bigint")
    body = rows.select(F.col("value").alias("line"), F.lit(1).alias("_part"), "_key", "pos1", "ordinal")
    head = head.select("line", F.lit(0).alias("_part"), F.lit(None).cast(body.schema["_key"].dataType).alias("_key"), F.lit(0).cast("bigint").alias("pos1"), "ordinal")
    order = ["_part", "_key", "pos1", "ordinal"]
    if compress:
        write_bgzf_vcf(head.unionByName(body), out, order)
    else:
        write_lines(head.unionByName(body), out, order)
    return rows.count()


def read_summary(path: str) -> dict[str, float | int]:
    """The seven metrics of a benchmark summary; missing or unreadable ones are 0."""
    found = json.loads(Path(path).read_text())

    def of(name, kind):
        try:
            return kind(float(found.get(name) or 0))
        except (TypeError, ValueError):
            return kind(0)

    return {n: of(n, float) for n in SUMMARY_FLOATS} | {n: of(n, int) for n in SUMMARY_COUNTS}
