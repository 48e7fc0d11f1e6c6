"""From alignment records to DEL/INS signals and to soft-clip, split-alignment and supplementary evidence.

Input columns: record_ordinal, qname, flag, rname, pos (0-based start), mapq, cigar, seq_len, sa, nm. The CIGAR walk is
one fold per record with two cursors; nothing but emitted events is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .bandjoin import global_ordinal

UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x800
_EVENT = "array<struct<svtype:string,event_pos:bigint,event_end:bigint,svlen:bigint,read_event_start:bigint,read_event_end:bigint>>"


def _bit(mask: int) -> Column:
    return (F.col("flag").bitwiseAND(mask) != 0).cast("int")


def primary_lines(records: DataFrame) -> DataFrame:
    """Mapped, not secondary."""
    return records.where(F.col("flag").bitwiseAND(UNMAPPED | SECONDARY) == 0)


def _usable(cigar) -> Column:
    return cigar.isNotNull() & ~cigar.isin("*", "")


def cigar_events(cigar, start, min_size: int = 50) -> Column:
    """Array of the deletions and insertions of one alignment, in the order in which they occur."""
    state = F.struct(X._c(start).cast("bigint").alias("ref"), F.lit(0).cast("bigint").alias("read"), F.array().cast(_EVENT).alias("events"))

    def step(s, x):
        op, n = x["op"], x["len"]
        hit = op.isin("D", "I") & (n >= min_size)
        ins = op == "I"
        event = F.struct(
            F.when(ins, "INS").otherwise("DEL").alias("svtype"), s["ref"].alias("event_pos"), (s["ref"] + F.when(ins, 1).otherwise(n)).alias("event_end"),
            n.alias("svlen"), s["read"].alias("read_event_start"), (s["read"] + F.when(ins, n).otherwise(0)).alias("read_event_end"),
        )
        return F.struct(
            (s["ref"] + F.when(op.isin("M", "=", "X", "D", "N"), n).otherwise(0)).alias("ref"),
            (s["read"] + F.when(op.isin("M", "=", "X", "I", "S"), n).otherwise(0)).alias("read"),
            F.when(hit, F.concat(s["events"], F.array(event))).otherwise(s["events"]).cast(_EVENT).alias("events"),
        )

    return F.aggregate(X.cigar_ops(cigar), state, step, lambda s: s["events"])


def extract_signals(records: DataFrame, min_size: int = 50) -> DataFrame:
    """The 16 signal columns, with record_ordinal and event_ordinal for ties."""
    rows = primary_lines(records).where(_usable(F.col("cigar")) & F.col("pos").isNotNull() & F.col("rname").isNotNull() & (F.col("rname") != "*"))
    rows = rows.select(
        "record_ordinal", F.col("qname").alias("read_name"), F.col("rname").alias("chrom"), F.posexplode_outer(cigar_events(F.col("cigar"), F.col("pos"), min_size)).alias("event_ordinal", "e"),
        "mapq", F.when(_bit(REVERSE) == 1, "-").otherwise("+").alias("strand"), F.coalesce("seq_len", F.lit(0)).cast("bigint").alias("read_len"),
        _bit(SUPPLEMENTARY).alias("is_supplementary"), F.col("sa").isNotNull().cast("int").alias("has_sa"),
        X.end_clip("cigar", True).alias("softclip_left"), X.end_clip("cigar", False).alias("softclip_right"), "cigar",
    )
    return rows.where("event_ordinal is not null").select(
        "read_name", "chrom", "e.event_pos", "e.event_end", "e.svtype", "e.svlen", "mapq", "strand", "read_len", "e.read_event_start", "e.read_event_end",
        "is_supplementary", "has_sa", "softclip_left", "softclip_right", "cigar", "record_ordinal", "event_ordinal",
    )


def signal_order() -> list[Column]:
    return [X.chrom_key("chrom"), F.col("event_pos"), F.col("svtype"), F.col("read_name"), F.col("record_ordinal"), F.col("event_ordinal")]


def indexed_signals(signals: DataFrame) -> DataFrame:
    """Adds signal_index, the 0-based position in the sorted table."""
    return global_ordinal(signals, "signal_index", signal_order())


_EXTRA = (
    "evidence_type:string,dst_chrom:string,dst_start:bigint,dst_end:bigint,dst_strand:string,event_pos:bigint,event_len:bigint,dst_mapq:bigint,"
    "chrom_change:int,orientation_change:int,sa_cigar:string,nm:bigint"
)


def _evidence(kind, pos, length, nm, dst=None) -> Column:
    none = F.lit(None)
    dst = dst or {}
    fields = {
        "evidence_type": F.lit(kind), "dst_chrom": none, "dst_start": none, "dst_end": none, "dst_strand": none, "event_pos": pos, "event_len": length,
        "dst_mapq": none, "chrom_change": F.lit(0), "orientation_change": F.lit(0), "sa_cigar": none, "nm": nm,
    } | dst
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(f"struct<{_EXTRA}>")


def sa_entries(sa) -> Column:
    """The entries of an SA tag; those with fewer than six fields are skipped, unreadable numbers are 0."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(X._c(sa), F.lit("")), "^;+|;+$", ""), ";"), lambda e: F.split(e, ",")), lambda p: F.size(p) >= 6)

    def entry(p):
        start = F.greatest(F.lit(0).cast("bigint"), X.strict_int(p[1], 0) - 1)
        return F.struct(
            p[0].alias("chrom"), start.alias("start"), (start + X.reference_span(p[3])).alias("end"), p[2].alias("strand"), p[3].alias("cigar"),
            X.strict_int(p[4], 0).alias("mapq"), X.strict_int(p[5], 0).alias("nm"),
        )

    return F.transform(parts, entry)


def extract_extra(records: DataFrame, min_clip: int = 50) -> DataFrame:
    """The 24 evidence columns, with record_ordinal and event_ordinal: left clip, right clip, split alignments, supplementary."""
    rows = primary_lines(records).where(F.col("pos").isNotNull() & F.col("rname").isNotNull() & (F.col("rname") != "*"))
    end = F.col("pos") + X.reference_span("cigar")
    strand = F.when(_bit(REVERSE) == 1, "-").otherwise("+")
    rows = rows.select(
        "*", end.cast("bigint").alias("_end"), strand.alias("_strand"), _bit(SUPPLEMENTARY).alias("_supp"),
        X.end_clip("cigar", True, True).alias("_left"), X.end_clip("cigar", False, True).alias("_right"),
    )
    start, nm, usable = F.col("pos"), F.col("nm"), _usable(F.col("cigar"))
    none = F.lit(None).cast(f"struct<{_EXTRA}>")
    left = F.when(usable & (F.col("_left") >= min_clip), _evidence("SOFTCLIP_LEFT", start, F.col("_left"), nm)).otherwise(none)
    right = F.when(usable & (F.col("_right") >= min_clip), _evidence("SOFTCLIP_RIGHT", F.col("_end"), F.col("_right"), nm)).otherwise(none)
    supp = F.when(F.col("_supp") == 1, _evidence("SUPPLEMENTARY", start, F.greatest(F.lit(0), F.col("_end") - start), nm)).otherwise(none)

    def split(e):
        change = (e["chrom"] != F.col("rname")).cast("int")
        length = F.when(change == 1, 0).otherwise(F.abs(e["start"] - start))
        return _evidence("SA_CONNECTION", start, length, e["nm"], {
            "dst_chrom": e["chrom"], "dst_start": e["start"], "dst_end": e["end"], "dst_strand": e["strand"], "dst_mapq": e["mapq"],
            "chrom_change": change, "orientation_change": (e["strand"] != F.col("_strand")).cast("int"), "sa_cigar": e["cigar"],
        })

    splits = F.when((F.col("_supp") == 0) & F.col("sa").isNotNull(), F.transform(sa_entries("sa"), split)).otherwise(F.array().cast(f"array<struct<{_EXTRA}>>"))
    rows = rows.withColumn("_all", F.array_compact(F.concat(F.array(left, right), splits, F.array(supp))))
    # with the plain posexplode Spark infers a filter on the array and works out all of it twice, once for the filter
    rows = rows.select("*", F.posexplode_outer("_all").alias("event_ordinal", "e")).where("event_ordinal is not null")
    origin = F.when(F.col("e.evidence_type").startswith("SOFTCLIP"), "CIGAR").when(F.col("e.evidence_type") == "SA_CONNECTION", "SA").otherwise("SUPPLEMENTARY")
    return rows.select(
        F.col("qname").alias("read_name"), "e.evidence_type", F.col("rname").alias("src_chrom"), F.col("pos").alias("src_start"), F.col("_end").alias("src_end"),
        F.col("_strand").alias("src_strand"), "e.dst_chrom", "e.dst_start", "e.dst_end", "e.dst_strand", "e.event_pos", "e.event_len", "mapq", "e.dst_mapq",
        "e.chrom_change", "e.orientation_change", F.col("_supp").alias("is_supplementary"), F.col("sa").isNotNull().cast("int").alias("has_sa"),
        F.col("_left").alias("softclip_left"), F.col("_right").alias("softclip_right"), "cigar", "e.sa_cigar", "e.nm", origin.alias("source"), "record_ordinal", "event_ordinal",
    )


def extra_order() -> list[Column]:
    return [X.chrom_key("src_chrom"), F.col("event_pos"), F.col("evidence_type"), F.col("read_name"), F.col("record_ordinal"), F.col("event_ordinal")]
