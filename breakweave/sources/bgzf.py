"""Blocked gzip: blocks made and read in parallel, and the tabix index of what was written.

Writing. Sorted records are packed by the tasks of their range partitions into blocks of at most ``MOST`` bytes, with
one row per run of records of a bin, told by block numbers of the partition. Sizes of blocks, summed up, turn these into
file offsets. Spark's text writer puts the blocks into part files: every block ends in a zero byte, its length being less
than 2**24, so a block without it is a line and the zero byte the line separator. Parts in order are the file.

Reading. The first four bytes of every block are its separator for Spark's text reader, which finds it from any place in
a file; the same bytes inside compressed data are told by the block's own length.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stages import StageTables
from .tables import join_parts

MOST = 65280
MAGIC = b"\x1f\x8b\x08\x04"
#: The empty block that ends a file: fixed value of the format.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: The place of a block's own length in its header, for writers with this one extra field.
_SIZE = 16


def block(data: bytes, level: int = 6) -> bytes:
    """One block of at most ``MOST`` bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    if len(body) > 65510:  # what can't be compressed is stored
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
    head = MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(data: bytes) -> int:
    """Bytes of the block that begins here by its header, 0 if this is no block."""
    if len(data) < 18 or data[:4] != MAGIC:
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", data, 10)[0]
    while at + 4 <= min(end, len(data)):
        kind, n = data[at : at + 2], struct.unpack_from("<H", data, at + 2)[0]
        if kind == b"BC" and n == 2 and at + 6 <= len(data):
            return struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + n
    return 0


def content(data: bytes) -> bytes:
    """What a block holds; a broken one is refused."""
    extra = struct.unpack_from("<H", data, 10)[0]
    try:
        out = zlib.decompress(data[12 + extra : -8], -15)
    except zlib.error as e:
        raise ValueError(f"a block can't be read: {e}") from e
    crc, n = struct.unpack_from("<II", data, len(data) - 8)
    if n != len(out) or crc != zlib.crc32(out):
        raise ValueError("a block's content does not match its checksum")
    return out


class Packer:
    """Bytes into blocks, with the place (block, offset) of whatever comes next."""

    def __init__(self, level: int = 6):
        self.held, self.number, self.level = bytearray(), 0, level

    @property
    def place(self) -> tuple[int, int]:
        return self.number, len(self.held)

    def add(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while len(self.held) >= MOST:
            yield block(bytes(self.held[:MOST]), self.level)
            del self.held[:MOST]
            self.number += 1

    def rest(self) -> Iterator[bytes]:
        if self.held:
            yield block(bytes(self.held), self.level)
            self.held.clear()
            self.number += 1


def region_bin(beg: int, end: int) -> int:
    """The smallest bin of the index that holds the 0-based span [beg, end)."""
    last = max(end - 1, beg)
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == last >> shift:
            return first + (beg >> shift)
    return 0


def region_bins(beg: int, end: int) -> list[int]:
    """All bins that may hold records over the span [beg, end)."""
    out = [0]
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out += range(first + (beg >> shift), first + (max(end - 1, beg) >> shift) + 1)
    return out


def vcf_span(line: bytes) -> tuple[str, int, int] | None:
    """Contig and 0-based span of a VCF record, None for headers and lines without a position."""
    cell = line.split(b"\t", 8)
    if line[:1] == b"#" or len(cell) < 5 or not cell[1].isdigit():
        return None
    beg = int(cell[1]) - 1
    end = beg + max(len(cell[3]), 1)
    for part in cell[7].split(b";") if len(cell) > 7 else ():
        if part[:4] == b"END=" and part[4:].isdigit():
            end = int(part[4:])
    return cell[0].decode(), max(beg, 0), max(end, beg + 1)


_ROWS = "part int, number int, data binary, size int, chrom string, bin int, records long, first int, first_at int, last int, last_at int, tile long"


def _pack_lines(batches, column: str):
    """Rows of three kinds: blocks (data), runs of records of one bin (bin), and where the records of a tile begin (tile)."""
    part, packer, rows, run, tiles = TaskContext.get().partitionId(), Packer(), [], None, {}
    names = [c.split()[0] for c in _ROWS.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "long": pa.int64()}
    types = [kinds[c.split()[1]] for c in _ROWS.split(", ")]

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows.clear()
        return batch

    def blocks(made):
        for k, data in enumerate(made):
            rows.append((part, first + k, data, len(data), *[None] * 8))

    def close():
        if run:
            (chrom, bin_), n, (a, a_at), (b, b_at) = run
            rows.append((part, None, None, None, chrom, bin_, n, a, a_at, b, b_at, None))

    for batch in batches:
        for line in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist():
            if line is None:
                continue
            span, begin, first = vcf_span(line), packer.place, packer.number
            blocks(packer.add(line + b"\n"))
            if span:
                chrom, beg, end = span
                key = (chrom, region_bin(beg, end))
                if run and run[0] == key:
                    run = (key, run[1] + 1, run[2], packer.place)
                else:
                    close()
                    run = (key, 1, begin, packer.place)
                for tile in range(beg >> 14, (end - 1 >> 14) + 1):
                    if (chrom, tile) not in tiles:
                        tiles[chrom, tile] = begin
                        rows.append((part, None, None, None, chrom, None, None, *begin, None, None, tile))
            if len(rows) >= 64:
                yield out()
                if len(tiles) > 100_000:  # repeated tiles do no harm, the first place counts
                    tiles.clear()
    first = packer.number
    blocks(packer.rest())
    close()
    if rows:
        yield out()


def write_blocks(packed: DataFrame, path: str, head: bytes = b"") -> None:
    """Block rows (part, number, data) into one file at ``path``, after the blocks of ``head``."""
    spark, parts = packed.sparkSession, f"{path}.parts-{uuid.uuid4().hex[:8]}"
    lines = packed.orderBy("part", "number").select(F.expr("substring(data, 1, length(data) - 1)").cast("string").alias("v"))
    lines.write.option("lineSep", "\0").text(parts)
    join_parts(spark, parts, path, b"".join(block(head[i : i + MOST]) for i in range(0, len(head), MOST)), END)


def _places(packed: DataFrame) -> DataFrame:
    """Where each block (part, number) begins in the file and where it stops."""
    sizes = packed.where("data is not null").select("part", "number", F.col("size").cast("long").alias("size"))
    # one row per partition of the sort
    totals = sizes.groupBy("part").agg(F.sum("size").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    stop = F.col("before") + F.sum("size").over(Window.partitionBy("part").orderBy("number"))
    return sizes.join(F.broadcast(before), "part").select("part", "number", (stop - F.col("size")).alias("at"), stop.alias("stop"))


def write_bgzf_vcf(lines: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Writes the column ``line`` in the given order as ``path`` and its index as ``path``.tbi.

    Returns the index as rows: chrom, bin, records. An empty table gives a file of the end block alone. Records need no
    order for a right index; sorted ones make it short.
    """
    spark = lines.sparkSession
    stages = StageTables(spark)
    packed = stages.put("packed", lines.orderBy(*order).select("line").mapInArrow(lambda b: _pack_lines(b, "line"), _ROWS))
    write_blocks(packed.where("data is not null").select("part", "number", "data"), path)
    places = stages.put("places", _places(packed))
    begins = places.select("part", F.col("number").alias("first"), F.col("at").alias("from_block"))
    # a run that ends where a block is full ends where that block stops
    ends = places.select("part", F.col("number").alias("last"), F.col("at").alias("to_block"), "stop")
    runs = packed.where("bin is not null").withColumn("full", (F.col("last_at") == 0) & (F.col("last") > 0))
    runs = runs.withColumn("last", F.col("last") - F.col("full").cast("int")).join(begins, ["part", "first"]).join(ends, ["part", "last"])
    from_ = F.shiftleft("from_block", 16) + F.col("first_at")
    to = F.when(F.col("full"), F.shiftleft("stop", 16)).otherwise(F.shiftleft("to_block", 16) + F.col("last_at"))
    runs = stages.put("runs", runs.select("chrom", "bin", "records", from_.alias("from"), to.alias("to")))
    tiles = packed.where("tile is not null").select("part", "chrom", "tile", "first", "first_at").join(begins, ["part", "first"])
    tiles = tiles.groupBy("chrom", "tile").agg(F.min(from_).alias("from"))
    told = runs.groupBy("chrom").cogroup(tiles.groupBy("chrom")).applyInArrow(lambda a, b: _contig_index(a, b), "chrom string, first long, data binary")
    # what an index holds of a contig is bounded by its bins and tiles, not by its records
    contigs = [(r.chrom, bytes(r.data)) for r in told.orderBy("first").collect()]
    names = b"".join(c.encode() + b"\0" for c, _ in contigs)
    index = b"TBI\x01" + struct.pack("<8i", len(contigs), 2, 1, 2, 0, ord("#"), 0, len(names)) + names + b"".join(d for _, d in contigs)
    write_bytes(spark, f"{path}.tbi", b"".join(block(index[i : i + MOST]) for i in range(0, len(index), MOST)) + END)
    return runs.groupBy("chrom", "bin").agg(F.sum("records").alias("records"))


def merged(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans of virtual offsets, those that meet within a block as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: The bin of the index that holds a contig's span and number of records instead: fixed value of the format.
COUNTS_BIN = 37450


def _contig_index(runs: pa.Table, tiles: pa.Table) -> pa.Table:
    """The index of one contig: bins with their chunks, and the first place of every tile."""
    col = {n: runs.column(n).to_pylist() for n in ("chrom", "bin", "records", "from", "to")}
    bins: dict[int, list[tuple[int, int]]] = {}
    for b, x, y in zip(col["bin"], col["from"], col["to"], strict=True):
        bins.setdefault(b, []).append((x, y))
    out = [struct.pack("<i", len(bins) + 1)]
    for b in sorted(bins):
        chunks = merged(bins[b])
        out.append(struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
    first = min(col["from"])
    out.append(struct.pack("<IiQQQQ", COUNTS_BIN, 2, first, max(col["to"]), sum(col["records"]), 0))
    places = dict(zip(tiles.column("tile").to_pylist(), tiles.column("from").to_pylist(), strict=True))
    linear, last = [], 0
    for t in range(max(places) + 1):
        last = places.get(t, last)
        linear.append(last)
    out.append(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))
    return pa.table({"chrom": [col["chrom"][0]], "first": pa.array([first], pa.int64()), "data": pa.array([b"".join(out)], pa.binary())})


# --- reading


def _open(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.open(at), fs.getFileStatus(at).getLen()


def read_bytes(spark: SparkSession, path: str, start: int = 0, n: int | None = None) -> bytes:
    """Some bytes of a file of any store that Hadoop knows, fewer where it ends."""
    stream, size = _open(spark, path)
    try:
        stream.seek(start)
        n = max(0, min(size - start, n if n is not None else size))
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()


def content_from(spark: SparkSession, path: str, start: int = 0, upto: int | None = None, piece: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(file offset, content) of the blocks from ``start`` on, whose own offset is at most ``upto``."""
    held, at, ahead = b"", start, start
    while upto is None or at <= upto:
        need = block_size(held)
        if not need or len(held) < need:
            more = read_bytes(spark, path, ahead, piece)
            if not more:
                if held:
                    raise ValueError(f"{path} is no blocked gzip file or ends within a block")
                return
            held, ahead = held + more, ahead + len(more)
            if not block_size(held) and len(held) >= 1 << 16:
                raise ValueError(f"{path} is no blocked gzip file")
            continue
        yield at, content(held[:need])
        held, at = held[need:], at + need


def read_index(spark: SparkSession, path: str) -> dict[str, tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """contig -> (bin -> chunks, tile offsets) of a tabix index."""
    data = b"".join(c for _, c in content_from(spark, path))
    if data[:4] != b"TBI\x01":
        raise ValueError(f"{path} is no tabix index")
    n, *_, size = struct.unpack_from("<8i", data, 4)
    names = data[36 : 36 + size].split(b"\0")[:n]
    at, out = 36 + size, {}
    for name in names:
        bins: dict[int, list[tuple[int, int]]] = {}
        (count,), at = struct.unpack_from("<i", data, at), at + 4
        for _ in range(count):
            (b, k), at = struct.unpack_from("<Ii", data, at), at + 8
            bins[b] = [struct.unpack_from("<QQ", data, at + 16 * i) for i in range(k)]
            at += 16 * k
        (count,), at = struct.unpack_from("<i", data, at), at + 4
        linear, at = list(struct.unpack_from(f"<{count}Q", data, at)), at + 8 * count
        out[name.decode()] = (bins, linear)
    return out


#: Compressed bytes of a region up to which a lookup reads its blocks at once; a larger region is a scan.
LOOKUP_BYTES = 64 << 20


def region_lines(spark: SparkSession, path: str, chrom: str, beg: int, end: int) -> DataFrame:
    """Records (line) of an indexed VCF that touch the 0-based span [beg, end): by its index, or a scan where that is much."""
    bins, linear = read_index(spark, f"{path}.tbi").get(chrom, ({}, []))
    least = linear[min(beg >> 14, len(linear) - 1)] if linear else 0
    chunks = merged([(max(a, least), b) for k in region_bins(beg, end) for a, b in bins.get(k, []) if b > least])
    if sum((b >> 16) - (a >> 16) + (1 << 16) for a, b in chunks) > LOOKUP_BYTES:
        touches = F.udf(lambda line: _touches(line.encode(), chrom, beg, end), "boolean")
        return spark.read.text(path).select(F.col("value").alias("line")).where(F.col("line").startswith(f"{chrom}\t")).where(touches("line"))
    lines = []
    for a, b in chunks:
        held = b""
        for at, data in content_from(spark, path, a >> 16, b >> 16, 1 << 16):
            upto = b & 0xFFFF if at == b >> 16 else len(data)
            held += data[a & 0xFFFF if at == a >> 16 else 0 : upto]
        lines += [(x.decode(),) for x in held.split(b"\n") if _touches(x, chrom, beg, end)]
    return spark.createDataFrame(lines, "line string")


def _touches(line: bytes, chrom: str, beg: int, end: int) -> bool:
    span = vcf_span(line)
    return span is not None and span[0] == chrom and span[1] < end and span[2] > beg


def raw_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of blocks (value without its first four bytes, file, split), in file order within a partition."""
    rows = spark.read.option("lineSep", MAGIC.decode("latin1")).option("encoding", "ISO-8859-1").text(path)
    return rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def whole_blocks(values: Iterator[bytes]) -> Iterator[bytes | None]:
    """Blocks from what lay between separators; None for what begins or ends within a block."""
    held = b""
    for value in values:
        if not held and not value:
            continue  # before the first block of a file
        held = held + MAGIC + value
        size = block_size(held)
        if not size:
            yield None
            held = b""
        elif len(held) == size:
            yield held
            held = b""
        elif len(held) > size:
            raise ValueError("bytes after a block that are no block")
    if held:
        yield None

