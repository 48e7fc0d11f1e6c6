"""Extra evidence to typed proposals (chrom, position, svtype, size, source), as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

_SCHEMA = "chrom string, position bigint, svtype string, size bigint, source string"
#: Columns that may hold an evidence row's contig, position and length; the first one filled counts: fixed values.
CHROM_NAMES = ("src_chrom", "chrom", "CHROM")
POSITION_NAMES = ("event_pos", "pos", "start", "src_start")
LENGTH_NAMES = ("event_len", "svlen", "SVLEN", "size")


def _first_number(kinds: dict[str, str], names: tuple[str, ...]) -> Column:
    """Whole number of the first filled column; unreadable text there is null, later columns are not looked at."""
    have = [n for n in names if n in kinds]
    if all(kinds[n] in ("bigint", "int") for n in have):
        return F.coalesce(*[F.col(n).cast("bigint") for n in have], F.lit(None).cast("bigint"))
    return X.whole(X.first_filled(kinds, have), None)


def _proposal(position: Column, svtype: Column, size: Column, source: str, chrom: Column) -> Column:
    return F.struct(chrom.alias("chrom"), position.cast("bigint").alias("position"), svtype.alias("svtype"), size.cast("bigint").alias("size"), F.lit(source).alias("source"))


def softclip_proposal(columns, min_size: int = 50) -> Column:
    """An insertion where reads are clipped; the clip's length is its size."""
    chrom, pos, told = X.first_filled(columns, CHROM_NAMES), F.col("event_pos"), F.coalesce("event_len", F.lit(0))
    side = F.when(F.col("evidence_type") == "SOFTCLIP_LEFT", F.col("softclip_left")).otherwise(F.col("softclip_right"))
    size = F.when(told > 0, told).otherwise(F.coalesce(side, F.lit(0)))
    return F.when(size >= min_size, _proposal(pos, F.lit("INS"), size, "SOFTCLIP", chrom))


def sa_proposal(columns, min_size: int = 50) -> Column:
    """A deletion between two parts of one read that align in the same direction on one chromosome."""
    chrom = X.first_filled(columns, CHROM_NAMES[:2])
    fits = (chrom == F.col("dst_chrom")) & (F.coalesce("orientation_change", F.lit(0)) == 0)
    # a missing breakpoint makes a difference null, which is no proposal
    ahead, behind = F.col("dst_start") - F.col("src_end"), F.col("src_start") - F.col("dst_end")
    fits = fits & ahead.isNotNull() & behind.isNotNull() & ((ahead >= min_size) | (behind >= min_size))
    forward = ahead >= min_size
    return F.when(fits, _proposal(F.when(forward, F.col("src_end")).otherwise(F.col("dst_end")), F.lit("DEL"), F.when(forward, ahead).otherwise(behind), "SA", chrom))


def supplementary_proposal(columns, min_size: int = 50) -> Column:
    """Only rows that name a type themselves; evidence extracted here never does."""
    own = [c for c in ("svtype", "SVTYPE") if c in columns]
    if not own:
        return F.lit(None).cast(f"struct<{_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    svtype, size = F.upper(X.first_filled(columns, own)), F.abs(F.coalesce("event_len", F.lit(0)))
    return F.when(svtype.isin("DEL", "INS") & (size >= min_size), _proposal(F.col("event_pos"), svtype, size, "SUPPLEMENTARY", X.first_filled(columns, CHROM_NAMES)))


def proposals(extra: DataFrame, min_size: int = 50) -> DataFrame:
    """All proposals; tables without evidence_type, and rows of unknown type, without chromosome, position or size, give none."""
    if "evidence_type" not in extra.columns:
        return extra.sparkSession.createDataFrame([], _SCHEMA)
    kind, columns = F.col("evidence_type"), extra.columns
    kinds = dict(extra.dtypes)
    extra = extra.withColumns({"event_pos": _first_number(kinds, POSITION_NAMES), "event_len": _first_number(kinds, LENGTH_NAMES)})
    for c in ("src_start", "src_end", "dst_start", "dst_end", "orientation_change", "softclip_left", "softclip_right"):
        if kinds.get(c) not in ("bigint", "int"):
            extra = extra.withColumn(c, X.whole(c, None) if c in kinds else F.lit(None).cast("bigint"))
    if "dst_chrom" not in columns:
        extra = extra.withColumn("dst_chrom", F.lit(None).cast("string"))
    p = F.when(kind.isin("SOFTCLIP_LEFT", "SOFTCLIP_RIGHT"), softclip_proposal(columns, min_size)).when(kind == "SA_CONNECTION", sa_proposal(columns, min_size))
    p = p.when(kind == "SUPPLEMENTARY", supplementary_proposal(columns, min_size))
    # a generator keeps the case distinction from being repeated for each field and filter
    out = extra.select(F.inline(F.array_compact(F.array(p))))
    return out.where((F.col("chrom") != "") & F.col("position").isNotNull() & (F.col("size") > 0))
