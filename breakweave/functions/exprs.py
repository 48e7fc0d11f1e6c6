"""Scalar expressions of the domain, all JVM-side columns.

Three readings of "number or default" exist side by side because callers differ on NaN: ``number`` keeps NaN,
``number_or`` turns it into the default, ``whole`` rounds half to even.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature slots of the evidence one-hot: fixed values.
EVIDENCE_SLOTS = ("candidate", "cigar_del", "cigar_ins", "softclip_left", "softclip_right", "sa_connection", "supplementary")
TRUE_WORDS = ("1", "true", "t", "yes", "y")
MISSING_WORDS = ("", "NA", "nan", "NaN", "None")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_even(x) -> Column:
    """Nearest whole number, ties to even, as bigint."""
    return F.bround(_c(x).cast("double"), 0).cast("bigint")


def half_up(x) -> Column:
    return F.round(_c(x).cast("double"), 0).cast("bigint")


def number(x, default: float = 0.0) -> Column:
    """Double, the default where it is missing or unreadable; NaN stays."""
    return F.coalesce(_c(x).try_cast("double"), F.lit(default))


def number_or(x, default: float | None = 0.0) -> Column:
    """Double, the default also for NaN."""
    d = F.lit(default).cast("double")
    return F.coalesce(F.nanvl(_c(x).try_cast("double"), F.lit(None).cast("double")), d)


def whole(x, default: int | None = 0) -> Column:
    """Nearest whole number (ties to even) of a readable value, else the default."""
    return F.coalesce(F.bround(number_or(x, None), 0).cast("bigint"), F.lit(default).cast("bigint"))


def strict_int(x, default: int = 0) -> Column:
    """Whole numbers only: '12.0' gives the default."""
    text = F.trim(_c(x).cast("string"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), F.lit(default).cast("bigint"))


def decimal_text(x) -> Column:
    """Double of a text that is a plain decimal number, with blanks around it allowed; else null ('5d' and '0x1' are no numbers)."""
    return F.when(_c(x).rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(_c(x)).try_cast("double"))


def first_int(x, default: int | None = 0) -> Column:
    """First comma field, truncated toward zero."""
    return F.coalesce(decimal_text(F.split_part(_c(x), F.lit(","), F.lit(1))).cast("bigint"), F.lit(default).cast("bigint"))


def flag(x) -> Column:
    """1.0 for the words that mean true, else 0.0; '1.0' is not among them."""
    return F.when(F.lower(F.trim(_c(x).cast("string"))).isin(*TRUE_WORDS), 1.0).otherwise(0.0)


def strand_sign(x) -> Column:
    return F.when(_c(x) == "+", 1.0).when(_c(x) == "-", -1.0).otherwise(0.0)


def is_missing(x) -> Column:
    return F.coalesce(F.trim(_c(x).cast("string")).isin(*MISSING_WORDS), F.lit(True))


def first_filled(df_columns, names, default: str = "") -> Column:
    """The first of several columns, where present, that is not empty."""
    have = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in df_columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default)


def size_similarity(a, b) -> Column:
    """Smaller over larger absolute size; 0 unless both are positive."""
    a, b = F.abs(_c(a)).cast("double"), F.abs(_c(b)).cast("double")
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def log_norm(x, scale: float = 1000.0) -> Column:
    """log1p of the positive part over log1p of the scale; unreadable gives 0."""
    return F.log1p(F.greatest(F.lit(0.0), number_or(x))) / F.log1p(F.lit(scale))


def clipped_log_length(x, top: float = 1e6) -> Column:
    return F.log1p(F.least(F.abs(number_or(x)), F.lit(top))) / F.log1p(F.lit(top))


def mapq_norm(x) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), number_or(x)) / 60.0)


def distance_norm(position, center, scale: float = 1000.0) -> Column:
    return F.least(F.lit(1.0), F.abs(number_or(position) - _c(center)) / scale)


def one_hot(kind, slots=EVIDENCE_SLOTS) -> list[Column]:
    return [F.when(_c(kind) == s, 1.0).otherwise(0.0) for s in slots]


def center(start="start", end="end") -> Column:
    return (_c(start) + _c(end)) / F.lit(2.0)


def anchors(start="start", end="end") -> Column:
    return F.array(_c(start).cast("double"), _c(end).cast("double"), center(start, end))


def index_list(x) -> Column:
    """Comma-separated whole numbers as an array; other fields are skipped."""
    return F.array_compact(F.transform(F.split(_c(x), ","), lambda t: F.when(F.trim(t).rlike(r"^[+-]?\d+$"), F.trim(t).try_cast("bigint"))))


def _lengths(df_columns) -> list[tuple[str, Column]]:
    """The length columns a table has, each null where it is missing, unreadable or 0."""
    return [(c, F.nullif(number_or(c, None), F.lit(0.0))) for c in ("median_svlen", "svlen", "size") if c in df_columns]


def row_size(df_columns, start: float | None = None) -> Column:
    """First non-zero absolute length, fractions kept; else the span where both ends are known; else 0.

    ``start`` stands for a missing start.
    """
    span = [F.abs(number_or("end", None) - number_or("start", start))] if {"start", "end"} <= set(df_columns) else []
    return F.coalesce(*[F.abs(v) for _, v in _lengths(df_columns)], *span, F.lit(0.0))


def signed_length(df_columns, svtype="svtype") -> Column:
    """First non-zero length with its sign, rounded; for deletions ``size`` and the span are negative."""
    deletion = F.upper(_c(svtype)) == "DEL"
    signed = [F.when(deletion & (c == "size"), -F.abs(v)).otherwise(v) for c, v in _lengths(df_columns)]
    size = row_size(df_columns)
    return half_even(F.coalesce(*signed, F.when(deletion, -size).otherwise(size)))


def export_length(median="median_svlen", start="start", end="end") -> Column:
    """Rounded absolute median, or at least 1 from the span."""
    m = F.abs(whole(median))
    return F.when(m > 0, m).otherwise(F.greatest(F.lit(1), F.abs(whole(end) - whole(start))))


def chrom_key(chrom="chrom") -> Column:
    """Sort key of contigs: numbered, X, Y, mitochondrial, then others by name."""
    name = F.coalesce(_c(chrom).cast("string"), F.lit(""))
    bare = F.regexp_replace(name, r"(?i)^chr", "")
    low = F.lower(bare)
    special = F.when(low == "x", 23).when(low == "y", 24).when(low.isin("m", "mt"), 25)
    value = F.coalesce(F.when(bare.rlike(r"^\d+$"), bare.try_cast("bigint")), special.cast("bigint"))
    return F.struct(F.when(value.isNull(), 1).otherwise(0).alias("class"), F.coalesce(value, F.lit(0).cast("bigint")).alias("num"), F.when(value.isNull(), bare).otherwise("").alias("text"), name.alias("name"))


def chrom_aliases(chrom: str) -> list[str]:
    bare = chrom[3:] if chrom.lower().startswith("chr") else chrom
    return [bare, f"chr{bare}"]


# --- CIGAR strings


def cigar_ops(cigar) -> Column:
    """array<struct<op, len>>; null or '*' gives an empty array."""
    c = F.coalesce(_c(cigar), F.lit(""))
    n = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    o = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(n, o, lambda a, b: F.struct(b.alias("op"), a.cast("bigint").alias("len")))


def reference_span(cigar) -> Column:
    """Bases of the reference that an alignment covers."""
    lengths = F.regexp_extract_all(F.coalesce(_c(cigar), F.lit("")), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, n: s + n.cast("bigint"))


def end_clip(cigar, left: bool, behind_hard: bool = False) -> Column:
    """Soft clip at one end; ``behind_hard`` looks past a hard clip. A lone S counts for both ends."""
    pattern = (r"^(?:\d+H)?(\d+)S" if behind_hard else r"^(\d+)S") if left else (r"(\d+)S(?:\d+H)?$" if behind_hard else r"(\d+)S$")
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(_c(cigar), F.lit("")), pattern, 1), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))


# --- VCF fields


def info_map(info) -> Column:
    """INFO as a map; a bare flag maps to null, a lone dot is no entry."""
    pairs = F.filter(F.split(F.when(_c(info) == ".", "").otherwise(_c(info)), ";"), lambda p: p != "")
    deduped = F.array_distinct(F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1))))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)) == k), -1)
    value = lambda p: F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p)))
    return F.map_from_arrays(deduped, F.transform(deduped, lambda k: value(last(k))))


def info_text(info, key: str) -> Column:
    """A field's text, '' where it is absent; a bare flag is the word True."""
    return F.when(F.map_contains_key(info, key), F.coalesce(info[key], F.lit("True"))).otherwise("")


def sixes(x) -> Column:
    """Six decimals as text."""
    return F.format_string("%.6f", _c(x).cast("double"))
