"""Scratch tables, bounded broadcasts and Arrow batch plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step holds at a time; a step needs about 40 times as much memory.
STEP_BYTES = 1 << 19
#: Rows of (long key, few bytes) up to which an id list may be broadcast; about 40 MB on each executor.
BROADCAST_ROWS = 1_000_000

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _fallback.setdefault("dir", tempfile.mkdtemp(prefix="breakweave-"))


#: Arrow batches between the JVM and Python: rows and bytes, so that long texts don't add up.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship(spark: SparkSession) -> None:
    """Bounds Arrow batches, and gives executors this package, once per context, where they may not have it on their path."""
    for name, value in ARROW_BATCH.items():
        spark.conf.set(name, value)
    context = spark.sparkContext
    if getattr(context, "_breakweave_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    code = io.BytesIO()
    with zipfile.ZipFile(code, "w") as z:
        for f in sorted((root / "breakweave").rglob("*.py")):
            z.write(f, f.relative_to(root).as_posix())
    if context.master.startswith("local"):
        to = str(Path(tempfile.mkdtemp(prefix="breakweave-code-")) / "breakweave.zip")
        Path(to).write_bytes(code.getvalue())
    else:
        to = f"{shared_dir(spark)}/code-{uuid.uuid4().hex[:12]}/breakweave.zip"
        at = context._jvm.org.apache.hadoop.fs.Path(to)
        out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(code.getvalue()))
        out.close()
    context.addPyFile(to)
    context._breakweave_shipped = True


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Smaller Arrow batches for what is written inside, where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written in the shared folder, so that lineage is cut and a lost executor loses nothing.

    A table goes when ``drop`` names it or when the Python process ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        ship(spark)
        self.spark, self.at, self.kept = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}", []
        atexit.register(self.close)

    def put(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        """Writes ``df`` as Parquet, with the writer's ``options``, and reads it again."""
        path = f"{self.at}/{name}-{len(self.kept)}"
        df.write.options(**options).parquet(path)
        self.kept.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in (getattr(t, "_scratch_path", None) for t in tables):
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        try:
            self._delete(self.at)
        except Exception:  # noqa: BLE001 - the session may have ended before
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: str = "doc_id"):
    """crc32 of the id as text, the basis of every held-out split."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def filter_ids(docs: DataFrame, ids: DataFrame, n_ids: int, keep: bool, key: str = "doc_id", max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``docs`` whose key is (not) in ``ids``, a one-column table of ``n_ids`` rows.

    Up to ``max_broadcast`` ids travel to the documents; beyond that both sides are shuffled on the key.
    """
    ids = ids.select(F.col(ids.columns[0]).alias(key))
    small = F.broadcast(ids) if n_ids <= max_broadcast else ids.hint("merge")
    return docs.join(small, key, "left_semi" if keep else "left_anti")


def spread_join(many: DataFrame, one: DataFrame, key: str, amount: str, by: str, most: int = 1024) -> DataFrame:
    """``many`` joined with the one row per ``key`` of ``one``, no task being given a whole hot key.

    ``amount`` of ``one`` tells how many rows of ``many`` a key has. Rows of a key with more than ``most`` are dealt by a
    hash of ``by`` over as many parts as it takes, and the key's row is repeated for each part. The list of hot keys is
    broadcast; ``most`` grows by powers of four until the list has at most ``BROADCAST_ROWS`` entries.
    """
    limits = [most * 4**i for i in range(12)]
    n_hot = one.agg(*[F.count_if(F.col(amount) > x).alias(str(x)) for x in limits]).first()
    if not n_hot[0]:
        return many.join(one.drop(amount), key)
    most = next(x for x, n in zip(limits, n_hot, strict=True) if n <= BROADCAST_ROWS)
    hot = F.broadcast(one.where(F.col(amount) > most).select(key, F.ceil(F.col(amount) / most).cast("int").alias("_parts")))
    many = many.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    one = one.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.when(F.col(amount) > most, F.ceil(F.col(amount) / most)).otherwise(1)).cast("int") - 1)))
    return many.join(one.drop(amount), [key, "_part"]).drop("_part")


def text_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Only what a text pass needs: id and text, null text as empty."""
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after the other, and where each row begins (one more than rows). Null: empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(1, np.int64)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Caches that outlive a task in a Python worker: owner -> how to empty it.
worker_caches: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(owner: str | None) -> None:
    """Empties the caches of other operators, whose tasks this worker ran before, and gives the memory back."""
    others = [k for k in worker_caches if k != owner]
    for k in others:
        worker_caches.pop(k)()
    if others:
        trim()


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` text bytes, a longer row by itself."""
    release(owner)
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pa.compute.binary_length(col).fill_null(0), np.int64)
    total, first = np.cumsum(size), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def by_steps(column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], most: int = STEP_BYTES, owner: str | None = None) -> Callable:
    """A mapInArrow function that applies ``work`` to bounded pieces."""

    def run(batches):
        for batch in batches:
            for piece in steps(batch, column, most, owner):
                yield work(piece)
        trim()

    return run


def tree_sum(df: DataFrame, column: str, size: int, dtype: str = "float64", fan: int = 16, sums: bool = False) -> np.ndarray:
    """Sum over rows of arrays held as bytes, all of one size: in the tasks, then in ``fan`` tasks, then of at most ``fan`` rows here.

    ``sums``: Python made one row per task already, so a second Python worker in the same tasks would gain nothing.
    """

    def add(batches):
        total = np.zeros(size, dtype)
        seen = False
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    total += np.frombuffer(x.as_py(), dtype)
                    seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], [column])

    part = df.select(column).where(F.col(column).isNotNull())
    part = part if sums else part.mapInArrow(add, f"{column} binary")
    total = np.zeros(size, dtype)
    for row in part.repartition(fan).mapInArrow(add, f"{column} binary").collect():
        total += np.frombuffer(row[0], dtype)
    return total
