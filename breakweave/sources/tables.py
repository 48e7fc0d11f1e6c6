"""Tab-separated tables: read as text and cast, written as one file with a header."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from .schemas import names, types


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and (fs.getFileStatus(at).isDirectory() or fs.getFileStatus(at).getLen() > 0)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def cast_to(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` from text columns; unreadable cells and missing columns are null, further columns stay."""
    kinds = types(schema)
    out = []
    for name in names(schema):
        kind = kinds[name]
        if name not in df.columns:
            out.append(F.lit(None).cast(kind).alias(name))
        elif kind == "array<string>":
            out.append(F.filter(F.split(F.coalesce(F.col(name), F.lit("")), ","), lambda t: t != "").alias(name))
        elif kind == "array<bigint>":
            out.append(X.index_list(F.coalesce(F.col(name), F.lit(""))).alias(name))
        elif kind in ("bigint", "int"):
            out.append(X.number_or(name, None).cast("bigint").cast(kind).alias(name))
        elif kind == "double":
            out.append(X.number_or(name, None).alias(name))
        else:
            out.append(F.nullif(F.col(name), F.lit("")).alias(name))
    return df.select(*out, *[c for c in df.columns if c not in kinds])


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table from text. A missing or empty file is an empty table of ``schema``; without a schema all is text."""
    if not exists(spark, path):
        return empty(spark, schema or "value string")
    raw = spark.read.option("sep", "\t").option("header", True).option("inferSchema", False).option("quote", "").csv(path)
    return cast_to(raw, schema) if schema else raw


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Regions (chrom, start, end) of a BED file, plain or gzip; headers, short lines and unreadable or empty spans are skipped."""
    if not exists(spark, path):
        return empty(spark, "chrom string, start bigint, end bigint")
    cell = F.split("value", r"\s+")
    whole = lambda n: F.get(cell, F.lit(n)).try_cast("bigint")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track\b|browser\b|\s*$)"))
    return rows.select(F.get(cell, F.lit(0)).alias("chrom"), whole(1).alias("start"), whole(2).alias("end")).where("end > start")


def read_tsv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A table whose columns get the narrowest type that all their cells allow; the file is read twice."""
    if not exists(spark, path):
        return empty(spark, "value string")
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).option("quote", "").csv(path)


def require_columns(df: DataFrame, *needed: str) -> None:
    lacking = sorted(set(needed) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")


def cells(df: DataFrame, shown: list[str]) -> list:
    """Columns as text: arrays joined by commas, null as empty."""
    kinds = dict(df.dtypes)
    out = []
    for name in shown:
        col = F.col(f"`{name}`")
        out.append(F.coalesce(F.array_join(col.cast("array<string>"), ",") if kinds[name].startswith("array") else col.cast("string"), F.lit("")))
    return out


def join_parts(spark: SparkSession, parts: str, path: str, head: bytes = b"", tail: bytes = b"") -> None:
    """Part files of a written folder, in order, as one file at ``path``, which appears when it is whole; the folder goes."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part, to, draft = fs_path(parts), fs_path(path), fs_path(f"{path}.draft-{uuid.uuid4().hex[:8]}")
    fs = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(to.getParent()) if to.getParent() else None
    out = fs.create(draft, True)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
    if head:
        out.write(bytearray(head))
    for f in sorted(s.getPath().toString() for s in fs.listStatus(part) if s.getPath().getName().startswith("part-")):
        stream = fs.open(fs_path(f))
        copy.copyBytes(stream, out, 1 << 20, False)
        stream.close()
    if tail:
        out.write(bytearray(tail))
    out.close()
    fs.delete(to, True)
    fs.rename(draft, to)
    fs.delete(part, True)


def write_lines(lines: DataFrame, path: str, order: list[str], compress: bool = False) -> None:
    """One text file of the column ``line`` in the given order."""
    spark = lines.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    part = fs_path(f"{path}.parts")
    part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True)
    # range partitions are written in parallel and put together in order; only the file is single
    lines.orderBy(*order).select("line").write.option("compression", "gzip" if compress else "none").text(part.toString())
    join_parts(spark, part.toString(), path)


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One tab-separated file with a header, also for an empty table. ``order`` names columns that sort the rows."""
    shown = [c for c in df.columns if not c.startswith("_order")]
    keys = [f"_k{i}" for i in range(len(order or []))]
    keyed = df.select(F.concat_ws("\t", *cells(df, shown)).alias("line"), *[F.col(c).alias(k) for c, k in zip(order or [], keys, strict=True)])
    head = df.sparkSession.createDataFrame([("\t".join(shown), 0)], "line string, _part int")
    body = keyed.withColumn("_part", F.lit(1)).withColumn("_row", F.monotonically_increasing_id())
    for k in keys:
        head = head.withColumn(k, F.lit(None).cast(body.schema[k].dataType))
    write_lines(head.withColumn("_row", F.lit(0).cast("bigint")).unionByName(body), path, ["_part", *keys, "_row"])


def write_text(path: str, text: str) -> None:
    """A small report next to the tables."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
