"""Alignment records from SAM text and BAM files, and contig lengths from their headers."""

from __future__ import annotations

import itertools
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bgzf
from .schemas import ALIGNMENTS
from .stages import StageTables
from .variants import read_lines

_OPS = "MIDNSHP=X"


def sam_columns(lines: DataFrame) -> DataFrame:
    """Records of SAM lines (value, ordinal); sequences and qualities are reduced to a length at once."""
    lines = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
    fields = F.split("value", "\t")
    f = [F.get(fields, F.lit(i)) for i in range(11)]
    tag = lambda kind: F.nullif(F.regexp_extract("value", rf"\t{kind}:([^\t]*)", 1), F.lit(""))
    star = lambda c: F.when(c != "*", c)
    return lines.select(
        F.col("ordinal").alias("record_ordinal"), f[0].alias("qname"), f[1].cast("int").alias("flag"), star(f[2]).alias("rname"),
        F.when(f[3].cast("bigint") > 0, f[3].cast("bigint") - 1).alias("pos"), f[4].cast("bigint").alias("mapq"), star(f[5]).alias("cigar"),
        F.when(f[9] == "*", 0).otherwise(F.length(f[9])).cast("bigint").alias("seq_len"), tag("SA:Z").alias("sa"), tag("NM:i").cast("bigint").alias("nm"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text, record_ordinal rising with the place in the file."""
    return sam_columns(read_lines(spark, path))


def contig_columns(lines: DataFrame) -> DataFrame:
    """(chrom, length, ordinal) of header lines (value, ordinal)."""
    field = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]*)", 1)
    out = lines.where(F.col("value").startswith("@SQ")).select(field("SN").alias("chrom"), field("LN").try_cast("bigint").alias("length"), "ordinal")
    return out.where((F.col("chrom") != "") & F.col("length").isNotNull())


def bam_header(data: bytes) -> tuple[list[tuple[str, int]], int] | None:
    """Contigs with their lengths and the header's size, None where ``data`` ends within it."""
    if data[:4] != b"BAM\x01"[: len(data)]:
        raise ValueError("no BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        (n,), at, out = struct.unpack_from("<i", data, at), at + 4, []
        for _ in range(n):
            size = struct.unpack_from("<i", data, at)[0]
            out.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
            at += 8 + size
        return out, at
    except struct.error:
        return None


def read_bam_header(spark: SparkSession, path: str) -> tuple[list[tuple[str, int]], int]:
    held = b""
    for _, data in bgzf.content_from(spark, path):
        held += data
        found = bam_header(held)
        if found:
            return found
    raise ValueError(f"{path} ends within its header")


_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_KINDS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}


_TAGS = {b"SA": "SA", b"NM": "NM"}


def _tags(data: bytes) -> dict[str, object]:
    """SA and NM among the optional fields."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = _TAGS.get(data[at : at + 2]), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode() if name else None, end + 1
        elif kind == "B":
            n = struct.unpack_from("<i", data, at + 1)[0]
            value, at = None, at + 5 + n * _SIZES[chr(data[at])]
        else:
            value = struct.unpack_from(_KINDS[kind], data, at)[0] if kind in _KINDS else None
            at += _SIZES[kind]
        if name:
            out[name] = value
    return out


_RECORD = struct.Struct("<iiBBHHHi")


@lru_cache(1 << 14)
def _cigar_text(ops: bytes) -> str | None:
    return "".join(f"{x >> 4}{_OPS[x & 15]}" for (x,) in struct.iter_unpack("<I", ops)) or None


def bam_record(data: bytes, contigs: list[str]) -> tuple:
    """The alignment columns, but for the ordinal, of one record without its length."""
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq = _RECORD.unpack_from(data)
    at = 32
    name = data[at : at + l_name - 1].decode()
    at += l_name
    cigar = _cigar_text(data[at : at + 4 * n_ops])
    at += 4 * n_ops + (l_seq + 1) // 2 + l_seq
    tags = _tags(data[at:])
    return name, flag, contigs[ref] if ref >= 0 else None, pos if pos >= 0 else None, mapq, cigar, l_seq, tags.get("SA"), tags.get("NM")


def _plausible(data: bytes, at: int, lengths: list[int]) -> int:
    """The size of what looks like a record here, with the length before it, or 0."""
    size, ref, pos, l_name, _, _, n_ops, _, l_seq, ref2, pos2, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (34 <= size and -1 <= ref < len(lengths) and -1 <= ref2 < len(lengths) and l_name > 1 and l_seq >= 0 and pos >= -1 and pos2 >= -1):
        return 0
    if 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq > size or (ref >= 0 and pos > lengths[ref]) or (ref2 >= 0 and pos2 > lengths[ref2]):
        return 0
    name = data[at + 36 : at + 36 + l_name]
    if name[-1:] != b"\0"[: len(name) == l_name] or not all(33 <= c <= 126 for c in name[: l_name - 1]):
        return 0
    ops = data[at + 36 + l_name : at + 36 + l_name + 4 * n_ops]
    return 0 if any(c & 15 > 8 for c in ops[::4]) else size + 4


#: Records in a row that must look like ones for the first of them to be taken as such.
_CHAIN = 10


def first_record(data: bytes, lengths: list[int]) -> int | None:
    """Where the first plausible record begins, one that others follow as far as ``data`` goes."""
    for start in range(len(data) - 36):
        at, seen = start, 0
        while seen < _CHAIN and at + 36 <= len(data):
            size = _plausible(data, at, lengths)
            if not size:
                break
            at, seen = at + size, seen + 1
        else:
            return start
    return None


_FIELDS = "qname string, flag int, rname string, pos bigint, mapq bigint, cigar string, seq_len bigint, sa string, nm bigint"
_ROWS = f"split bigint, seq bigint, {_FIELDS}, prefix binary, suffix binary, starts boolean, torn boolean"
#: Content of a split in which its first record is looked for at a time.
_AHEAD = 1 << 20


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)
    return out


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(v, _ARROW[kind]) for v, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _split_records(values: Iterator[bytes], split: int, contigs: list[str], lengths: list[int], header: int) -> Iterator[tuple]:
    """Records of a split as rows, and at last one row of what it holds of records of other splits."""
    held, skip, started, n, prefix, torn, nothing = bytearray(), header if split == 0 else 0, split == 0, 0, b"", False, (None,) * 9

    def records():
        nonlocal n
        at, data = 0, bytes(held)
        while at + 4 <= len(data):
            size = int.from_bytes(data[at : at + 4], "little", signed=True)
            if size < 32:
                raise ValueError("a BAM record can't be that short")
            if at + 4 + size > len(data):
                break
            yield (split, n, *bam_record(data[at + 4 : at + 4 + size], contigs), None, None, None, None)
            n, at = n + 1, at + 4 + size
        del held[:at]

    def look():
        nonlocal started, prefix
        found = first_record(bytes(held), lengths)
        if found is not None:
            started, prefix = True, bytes(held[:found])
            del held[:found]

    wanted = _AHEAD
    for data in bgzf.whole_blocks(values):
        if data is None:
            torn = True
            break
        held += bgzf.content(data)
        if skip:
            gone = min(skip, len(held))
            del held[:gone]
            skip -= gone
        if not started and len(held) >= wanted:
            look()
            wanted *= 2
        if started and not skip:
            yield from records()
    if not started and not torn:
        look()
        if started:
            yield from records()
    torn = torn or skip > 0  # a header longer than its split
    yield (split, n, *nothing, prefix if started else bytes(held), bytes(held) if started else b"", started, torn)


def _bam_splits(frames, contigs, lengths, header):
    """All splits of a partition; rows of a split come one after the other."""
    def values():
        for batch in frames:
            yield from zip(batch["split"].to_pylist(), (v.as_py() for v in batch["value"]), strict=True)

    for split, rows in itertools.groupby(values(), key=lambda x: x[0]):
        made = _split_records((v for _, v in rows), split, contigs, lengths, header)
        while some := list(itertools.islice(made, 5000)):
            yield _batch(some, _ROWS)


def _between(pdf: pd.DataFrame, contigs: list[str]) -> pd.DataFrame:
    """Records that reach over splits, from their pieces in order; torn if the bytes are no whole records."""
    data = b"".join(pdf.sort_values("place").data)
    rows, at, group = [], 0, int(pdf.group.iloc[0])
    while at + 36 <= len(data) and at + 4 + struct.unpack_from("<i", data, at)[0] <= len(data) and struct.unpack_from("<i", data, at)[0] >= 32:
        size = struct.unpack_from("<i", data, at)[0]
        rows.append((group, len(rows), *bam_record(data[at + 4 : at + 4 + size], contigs), False))
        at += 4 + size
    if at != len(data):
        rows = [(group, 0, *(None,) * 9, True)]
    return _frame(rows, f"group bigint, seq bigint, {_FIELDS}, torn boolean")


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Records of a BAM file (or a comma-separated list), each file cut as Spark cuts text files.

    A split's first record is the first place from which on everything looks like records. That is a guess, which is
    proven afterwards: what two splits hold of the records between them must be whole records without a byte to spare.
    Where it isn't - or the header or a block's own bytes got in the way of a cut - the file is one task.
    """
    files = [read_gzip_bam(spark, p) if _kind(spark, p) == "gzip" else _read_bam(spark, p) for p in path.split(",")]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out


def _read_bam(spark: SparkSession, path: str) -> DataFrame:
    found, header = read_bam_header(spark, path)
    contigs, lengths = [c for c, _ in found], [n for _, n in found]
    raw, stages = bgzf.raw_blocks(spark, path), StageTables(spark)
    work = lambda frames: _bam_splits(frames, contigs, lengths, header)
    fields = [c.split()[0] for c in _FIELDS.split(", ")]
    rows = stages.put("splits", raw.select("value", "split").mapInArrow(work, _ROWS))
    # one row per split
    told = rows.where("starts is not null").select("split", F.col("seq").alias("n"), "prefix", "suffix", "starts", "torn")
    group = F.sum(F.col("starts").cast("bigint")).over(Window.orderBy("split"))
    told = told.withColumn("group", group)
    begins = told.select((F.col("group") - F.col("starts").cast("bigint")).alias("group"), (F.col("split") * 2).alias("place"), F.col("prefix").alias("data"))
    ends = told.where("starts").select("group", (F.col("split") * 2 + 1).alias("place"), F.col("suffix").alias("data"))
    pieces = begins.unionByName(ends).where(F.length("data") > 0)
    between = stages.put("between", pieces.groupBy("group").applyInPandas(lambda g: _between(g, contigs), f"group bigint, seq bigint, {_FIELDS}, torn boolean"))
    if told.where("torn").limit(1).count() or between.where("torn or group < 1").limit(1).count():
        whole = raw.withColumn("row", F.monotonically_increasing_id()).repartition(1).sortWithinPartitions("split", "row").select("value", F.lit(0).cast("bigint").alias("split"))
        rows = stages.put("whole", whole.mapInArrow(work, _ROWS))
        last = rows.where("starts is not null").first()
        if last and (last.torn or last.suffix):
            raise ValueError(f"{path} is no whole BAM file")
        return rows.where("starts is null").select(F.col("seq").alias("record_ordinal"), *fields)
    more = between.groupBy("group").agg(F.count(F.lit(1)).alias("more"))
    starts = told.where("starts").select("split", "group", "n").join(more, "group", "left").na.fill(0, ["more"])
    before = F.coalesce(F.sum(F.col("n") + F.col("more")).over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(stages.put("starts", starts.select("split", "group", "n", before.alias("before"))))
    own = rows.where("starts is null").join(starts, "split").select((F.col("before") + F.col("seq")).alias("record_ordinal"), *fields)
    other = between.join(starts, "group").select((F.col("before") + F.col("n") + F.col("seq")).alias("record_ordinal"), *fields)
    return own.unionByName(other)


@lru_cache(1 << 14)
def _cigar_bytes(cigar: str | None) -> tuple[int, bytes]:
    """How many operations, and these."""
    ops = [(int(n) << 4) | _OPS.index(op) for n, op in _CIGAR.findall(cigar or "")]
    return len(ops), struct.pack(f"<{len(ops)}I", *ops)


def _whole(x, none: int) -> int:
    return none if x is None or x != x else int(x)


def _bam_bytes(refs: dict[str, int], qname, flag, rname, pos, mapq, cigar, seq_len, sa, nm) -> bytes:
    """A record of the alignment columns with its length before it: sequence and qualities have their length only."""
    name, (n_ops, ops), n = qname.encode() + b"\0", _cigar_bytes(cigar), _whole(seq_len, 0)
    tags = b"" if sa is None else b"SAZ" + sa.encode() + b"\0"
    if nm is not None and nm == nm:
        tags += b"NMi" + int(nm).to_bytes(4, "little", signed=True)
    size = 32 + len(name) + len(ops) + (n + 1) // 2 + n + len(tags)
    head = _WRITTEN.pack(size, refs.get(rname, -1), _whole(pos, -1), len(name), _whole(mapq, 0), 0, n_ops, int(flag), n, -1, -1, 0)
    return b"".join((head, name, ops, b"\x11" * ((n + 1) // 2), b"\xff" * n, tags))


_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_WRITTEN = struct.Struct("<iiiBBHHHiiii")


def write_bam(records: DataFrame, path: str, contigs: list[tuple[str, int]]) -> None:
    """Alignment columns as one BAM file in the order of record_ordinal, those with the same one by the other columns."""
    spark, refs = records.sparkSession, {c: i for i, (c, _) in enumerate(contigs)}

    fields, packed_rows = [c.split()[0] for c in _FIELDS.split(", ")], "part int, number int, data binary"

    def pack(frames):
        packer, part = bgzf.Packer(3), TaskContext.get().partitionId()
        for batch in frames:
            first, made = packer.number, []
            for row in zip(*(batch[f].to_numpy(zero_copy_only=False).tolist() for f in fields), strict=True):
                made += packer.add(_bam_bytes(refs, *row))
            yield _batch([(part, first + i, data) for i, data in enumerate(made)], packed_rows)
        yield _batch([(part, packer.number, data) for data in packer.rest()], packed_rows)

    packed = StageTables(spark).put("packed", records.orderBy("record_ordinal", *fields).mapInArrow(pack, packed_rows))
    text = "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs).encode()
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for c, n in contigs:
        head += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n)
    bgzf.write_blocks(packed, path, head)


def _kind(spark: SparkSession, path: str) -> str:
    """bam, gzip (a BAM file in ordinary gzip members), cram or sam, by what a file begins with."""
    head = bgzf.read_bytes(spark, path, 0, 1 << 16)
    if head[:4] == b"CRAM":
        return "cram"
    if head[:2] != b"\x1f\x8b":
        return "sam"
    try:
        magic = zlib.decompressobj(31).decompress(head, 4)
    except zlib.error as e:
        raise ValueError(f"{path} can't be read: {e}") from e
    return "sam" if magic != b"BAM\x01" else "bam" if bgzf.block_size(head) else "gzip"


def _members(held: bytes) -> bytes:
    """The content of gzip members, one after the other."""
    out = []
    while held:
        member = zlib.decompressobj(31)
        out.append(member.decompress(held))
        if not member.eof:
            raise ValueError("the BAM file ends early")
        held = member.unused_data
    return b"".join(out)


def _gzip_records(frames):
    for pdf in frames:
        for data in pdf.content:
            out = _members(bytes(data))
            contigs, at = bam_header(out) or ([], len(out))
            rows, names = [], [c for c, _ in contigs]
            while at < len(out):
                size = struct.unpack_from("<i", out, at)[0] if at + 4 <= len(out) else 0
                if size < 32 or at + 4 + size > len(out):
                    raise ValueError("the BAM file ends early")
                rows.append((len(rows), *bam_record(out[at + 4 : at + 4 + size], names)))
                at += 4 + size
            yield _frame(rows, ALIGNMENTS)


def read_gzip_bam(spark: SparkSession, path: str) -> DataFrame:
    """A BAM file in ordinary gzip members, which can't be cut: one task, 2 GB at most."""
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_gzip_records, ALIGNMENTS)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """SAM by its extension, else BAM, or SAM again where the file holds text; CRAM is not supported."""
    if path.endswith((".sam", ".sam.gz")):
        return read_sam(spark, path)
    kind = "cram" if path.endswith(".cram") else _kind(spark, path.split(",")[0])
    if kind == "cram":
        raise ValueError("CRAM files are not supported; convert them to BAM")
    return read_sam(spark, path) if kind == "sam" else read_bam(spark, path)


def contig_lengths(spark: SparkSession, path: str) -> dict[str, int]:
    """Contig -> length from the header, an empty dict if it can't be read."""
    try:
        if path.endswith((".sam", ".sam.gz")) or _kind(spark, path) == "sam":
            return {r.chrom: r.length for r in contig_columns(read_lines(spark, path)).orderBy("ordinal").collect()}
        if _kind(spark, path) == "gzip":
            return dict((bam_header(_members(bgzf.read_bytes(spark, path))) or ([], 0))[0])
        return dict(read_bam_header(spark, path)[0])
    except (OSError, ValueError, EOFError, Py4JJavaError, AnalysisException):
        return {}
