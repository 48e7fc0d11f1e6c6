"""Order-dependent gap clustering of signals, and gap clustering of proposals.

A gap above the window always splits, so rows fall into islands. Islands are found from one row per occupied bin of the
window's width (rows of one bin can't be further apart than the window), so no chromosome has to pass through one
window partition. Inside an island the length rule needs the running median of the accepted members, a sequential
fold; it streams over sorted partitions and keeps only the current cluster's lengths. An island too long for one task is
folded in chunks whose seams are repaired.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.stages import StageTables
from .bandjoin import numbered


#: Bins of a window of the scan for islands; a second one has a row for each of these.
SCAN = 4096


def island_bins(df: DataFrame, keys: list[str], pos: str, window: int, name: str = "island", scan: int = SCAN) -> DataFrame:
    """Every occupied bin (keys, _bin) of the window's width with the smallest position of its island, its own smallest and largest, and its
    number of rows.

    A scan in two passes: gaps are found within stretches of ``scan`` bins, and between stretches from one row of each, so
    that no window holds more than a stretch's bins or a chromosome's stretches.
    """
    bins = df.groupBy(*keys, F.floor(F.col(pos) / max(1, int(window))).alias("_bin")).agg(F.min(pos).alias("_low"), F.max(pos).alias("_high"), F.count(F.lit(1)).alias("_rows"))
    bins = bins.withColumn("_stretch", F.floor(F.col("_bin") / scan))
    within = Window.partitionBy(*keys, "_stretch").orderBy("_bin")
    bins = bins.withColumn("_begin", F.when(F.col("_low") - F.lag("_high").over(within) > window, F.col("_low")))
    bins = bins.withColumn("_own", F.last("_begin", True).over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("_begin")
    order = Window.partitionBy(*keys).orderBy("_stretch")
    each = bins.groupBy(*keys, "_stretch").agg(F.min("_low").alias("_from"), F.max("_high").alias("_to"), F.max("_own").alias("_last"))
    each = each.withColumn("_head", F.when(F.coalesce(F.col("_from") - F.lag("_to").over(order) > window, F.lit(True)), F.col("_from")))
    carried = F.last(F.coalesce("_last", "_head"), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = each.select(*keys, "_stretch", F.coalesce("_head", carried).alias("_carried"))
    return bins.join(heads, [*keys, "_stretch"]).select(*keys, "_bin", "_low", "_high", "_rows", F.coalesce("_own", "_carried").alias(name))


def gap_islands(df: DataFrame, keys: list[str], pos: str, window: int, name: str = "island") -> DataFrame:
    """Adds the smallest position of each row's island: rows of one key chained by gaps of at most ``window``."""
    bins = island_bins(df, keys, pos, window, name).select(*keys, "_bin", name)
    binned = df.withColumn("_bin", F.floor(F.col(pos) / max(1, int(window))))
    return binned.join(bins, [*keys, "_bin"]).select(*df.columns, name)


def _median(lengths: list[float]) -> float:
    n = len(lengths)
    return lengths[n // 2] if n % 2 else (lengths[n // 2 - 1] + lengths[n // 2]) / 2


class Fold:
    """The open cluster: its island, last position, first row, and the sorted lengths of its members."""

    def __init__(self, window: int, min_ratio: float, key=None, last=None, first=None, lengths=()):
        self.window, self.min_ratio, self.key, self.last, self.first, self.lengths = window, min_ratio, key, last, first, list(lengths)

    def take(self, rows: pd.DataFrame, until: Callable[[int], bool] | None = None) -> tuple[list[int], list[int]]:
        """For rows in order the first row of each one's cluster, and the row's place in it.

        Ends before a row that begins a cluster and for which ``until`` holds, given its place in ``rows``.
        """
        if not len(rows):
            return [], []
        parts = [rows[c].to_numpy() for c in _PART]
        moved = np.ones(len(rows), bool)
        moved[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in parts])
        moved[0] = tuple(x[0] for x in parts) != self.key
        window, ratio, lengths, first, last = self.window, self.min_ratio, self.lengths, self.first, self.last
        firsts, members, at = [], [], -1
        for other, pos, length, index in zip(moved.tolist(), rows.event_pos.tolist(), rows.svlen.tolist(), rows.signal_index.tolist(), strict=True):
            at += 1
            if not other and pos - last <= window:
                mid, size = abs(_median(lengths)), abs(length)
                begins = bool(mid and size) and (size / mid if size < mid else mid / size) < ratio
            else:
                begins = True
            if begins:
                if until is not None and until(at):
                    break
                first, lengths = index, []
            insort(lengths, length)
            last = pos
            firsts.append(first)
            members.append(len(lengths) - 1)
        if firsts:
            self.key = tuple(x[len(firsts) - 1] for x in parts)
        self.lengths, self.first, self.last = lengths, first, last
        return firsts, members


_PART = ["chrom", "svtype", "island"]
_ROW = ["read_name", "chrom", "svtype", "event_pos", "svlen", "mapq", "signal_index"]
_TOLD = "read_name string, chrom string, svtype string, event_pos bigint, svlen bigint, mapq double, signal_index bigint, cluster bigint, member bigint"


def _stream(window: int, min_ratio: float):
    """Folds rows sorted by island and order as they come."""

    def run(batches):
        fold = Fold(window, min_ratio)
        for pdf in batches:
            firsts, members = fold.take(pdf)
            yield pdf[_ROW].assign(cluster=np.array(firsts, np.int64), member=np.array(members, np.int64))

    return run


def _order() -> list[Column]:
    return [F.col(c) for c in (*_PART, "event_pos", "svlen")] + [F.col("read_name").asc_nulls_last(), F.col("signal_index")]


_STATE = "chrom string, svtype string, island bigint, last bigint, first bigint, lengths array<double>"
#: Rows at the beginning of a chunk that are folded again at first; sixteen times as many where they are not enough.
HEAD = 2048


def _in_chunks(placed: DataFrame, n_rows: int, window: int, min_ratio: float, chunk_rows: int) -> DataFrame:
    """The fold of ``n_rows`` rows of islands that are too long for one task.

    Rows are cut into chunks in their order. Every chunk is folded as if a cluster began with it; then each one that goes
    on in the island of the chunk before it is folded again from that chunk's open cluster, up to the first row at which a
    cluster begins either way, since all that follows is the same. Where there is none to a chunk's end, it has another
    open cluster, and the next chunk is folded once more, until nothing changes. Rows stream through a task in batches;
    the open cluster is all that it holds.
    """
    spark = placed.sparkSession
    stage = StageTables(spark, temporary=True)
    parts = max(1, -(-n_rows // chunk_rows))
    kinds = f"chunk bigint, _at bigint, {_TOLD}, {', '.join(c for c in _STATE.split(', ') if c.split()[0] not in _ROW)}"
    names = [c.split()[0] for c in kinds.split(", ")]

    def frame(n: int, **columns) -> pd.DataFrame:
        return pd.DataFrame({c: columns.get(c, [None] * n) for c in names})

    def end(chunk: int, fold: Fold) -> pd.DataFrame:
        """A row without a place: the open cluster at the end of a chunk."""
        own = dict(zip((*_PART, "last", "first", "lengths"), (*fold.key, fold.last, fold.first, fold.lengths), strict=True))
        return frame(1, chunk=[chunk], **{c: [v] for c, v in own.items()})

    def begin(batches):
        """A partition, which is a chunk, in order."""
        fold, chunk = Fold(window, min_ratio), None
        for pdf in batches:
            firsts, members = fold.take(pdf)
            if firsts:
                chunk = int(pdf["_at"].iloc[0]) >> 33
                own = {c: pdf[c] for c in ("_at", *_ROW, "island")}
                yield frame(len(firsts), chunk=[chunk] * len(firsts), **own, cluster=firsts, member=members)
        if chunk is not None:
            yield end(chunk, fold)

    def again(batches):
        """Chunks sorted by place, each after the open cluster before it, which is a row with a place below 0."""
        fold, open_chunk, done = None, None, False
        for pdf in batches:
            for chunk, own in pdf.groupby("chunk", sort=False):
                own = own.reset_index(drop=True)
                if own["_at"].iloc[0] < 0:
                    if open_chunk is not None and not done:
                        yield end(open_chunk, fold)
                    r = own.iloc[0]
                    fold, open_chunk, done = Fold(window, min_ratio, (r.chrom, r.svtype, r.island), int(r["last"]), int(r["first"]), r.lengths.tolist()), int(chunk), False
                    own = own.iloc[1:].reset_index(drop=True)
                if done or own.empty:
                    continue
                before = own.member.tolist()
                firsts, members = fold.take(own, lambda i: before[i] == 0)  # noqa: B023 - used at once
                if firsts:
                    yield frame(len(firsts), chunk=[open_chunk] * len(firsts), _at=own["_at"].iloc[: len(firsts)], cluster=firsts, member=members)
                if len(firsts) < len(own):
                    done = True
                    yield frame(1, chunk=[open_chunk])  # nothing changes from here on
        if open_chunk is not None and not done:
            yield end(open_chunk, fold)

    sorted_ = placed.select(*_ROW, "island").repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())
    made = [stage.put("round0", sorted_.withColumn("_at", F.monotonically_increasing_id()).mapInPandas(begin, kinds))]
    rows = made[0].where("_at is not null")
    ends = lambda f: f(F.struct(*_PART, "event_pos"), "_at")
    # one row per chunk
    each = sorted(rows.groupBy("chunk").agg(ends(F.min_by).alias("a"), ends(F.max_by).alias("b"), F.count(F.lit(1)).alias("n")).collect())
    size = {e.chunk: e.n for e in each}
    goes_on = {q.chunk: p.chunk for p, q in zip(each, each[1:], strict=False) if tuple(p.b)[:3] == tuple(q.a)[:3] and q.a.event_pos - p.b.event_pos <= window}
    told = lambda df: {r.chunk: (r["first"], r.n) for r in df.where("_at is null").select("chunk", "first", F.size("lengths").alias("n")).collect()}
    begun = told(made[0])
    state, source, heads = dict(begun), dict.fromkeys(size, 0), dict.fromkeys(goes_on, HEAD)
    latest, todo, zero = {}, set(goes_on), F.lit(0).cast("bigint")
    while todo:
        turn = len(made)
        which = [(c, goes_on[c], source[goes_on[c]], (c << 33) + heads[c]) for c in sorted(todo)]
        which = F.broadcast(spark.createDataFrame(which, "to bigint, chunk bigint, turn int, most bigint"))
        before = [df.where("_at is null and first is not null").select("chunk", *[c.split()[0] for c in _STATE.split(", ")]).withColumn("turn", F.lit(i)) for i, df in enumerate(made)]
        held = reduce(DataFrame.unionByName, before).join(which, ["chunk", "turn"]).drop("turn", "chunk", "most").withColumnRenamed("to", "chunk")
        held = held.withColumns({"_at": F.lit(-1).cast("bigint"), "event_pos": zero, "svlen": zero, "signal_index": zero, "member": zero})
        mine = rows.join(which.select(F.col("to").alias("chunk"), "most"), "chunk").where("_at < most").select(*[c for c in held.columns if c not in ("last", "first", "lengths")])
        # no column of whole numbers has nulls, which would make them doubles
        mine = mine.withColumns({"last": zero, "first": zero, "lengths": F.array().cast("array<double>")})
        both = mine.unionByName(held).repartition("chunk").sortWithinPartitions("chunk", "_at")
        made.append(stage.put(f"round{turn}", both.mapInPandas(again, kinds)))
        found, changed, short = told(made[-1]), set(), set()
        for c in todo:
            same = found[c][0] is None
            if not same and heads[c] < size[c]:
                heads[c] *= 16
                short.add(c)
                continue
            now, source[c], latest[c] = begun[c] if same else found[c], 0 if same else turn, turn
            if now != state[c]:
                state[c] = now
                changed.add(c)
        todo = short | {c for c, p in goes_on.items() if p in changed}
    rows = rows.select("_at", "chunk", *[c.split()[0] for c in _TOLD.split(", ")])
    if latest:
        last = F.broadcast(spark.createDataFrame(list(latest.items()), "chunk bigint, turn int"))
        mended = [df.where("_at is not null").select("chunk", "_at", F.col("cluster").alias("_cluster"), F.col("member").alias("_member")).withColumn("turn", F.lit(i)) for i, df in enumerate(made) if i]
        mended = reduce(DataFrame.unionByName, mended).join(last, ["chunk", "turn"]).drop("chunk", "turn")
        rows = rows.join(mended, "_at", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("cluster", "member")})
    return rows.select(*[c.split()[0] for c in _TOLD.split(", ")])


#: Rows of an island, and of a chunk of a longer one, that one task folds.
CHUNK_ROWS = 200_000


def split_long(placed: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of islands with up to ``most`` rows, and those of longer ones, None if there are none."""
    long = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys)
    if not long.limit(1).count():
        return placed, None
    # an island has more than ``most`` rows, so there are as few of them as the rows allow
    return placed.join(long, keys, "left_anti"), placed.join(long, keys, "left_semi")


def cigar_clusters(signals: DataFrame, window: int = 500, min_ratio: float = 0.5, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Signals with ``cluster`` (signal_index of its first member) and ``member`` (0-based place in it).

    Rows without chrom, svtype, position or length are dropped; a missing mapping quality is 0.
    """
    whole = lambda c: X.number_or(c, None).cast("bigint").alias(c)
    rows = signals.select("read_name", "chrom", "svtype", whole("event_pos"), whole("svlen"), X.number_or("mapq").alias("mapq"), "signal_index")
    rows = rows.dropna(subset=["chrom", "svtype", "event_pos", "svlen"])
    bins = StageTables(signals.sparkSession, temporary=True).put("bins", island_bins(rows, _PART[:2], "event_pos", window))
    return fold_islands(rows, bins, window, min_ratio, chunk_rows)


def fold_islands(rows: DataFrame, bins: DataFrame, window: int = 500, min_ratio: float = 0.5, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``cigar_clusters`` of the islands whose ``island_bins`` are given; every row needs chrom, svtype, position, length and mapping quality."""
    long = bins.groupBy(*_PART).agg(F.sum("_rows").alias("_n")).withColumn("_long", F.col("_n") > chunk_rows)
    n_long, n_short = long.agg(F.sum(F.when(F.col("_long"), F.col("_n"))), F.sum(F.when(~F.col("_long"), F.col("_n")))).first()
    binned = rows.select(*_ROW, F.floor(F.col("event_pos") / max(1, int(window))).alias("_bin"))

    def placed(which: bool) -> DataFrame:
        # an island has more than ``chunk_rows`` rows to be long, so there are as few of them as the rows allow
        some = bins.join(long.where("_long").select(*_PART), _PART, "left_semi" if which else "left_anti") if n_long else bins
        return binned.join(some.select(*_PART[:2], "_bin", "island"), [*_PART[:2], "_bin"]).drop("_bin")

    told = []
    if n_short or not n_long:
        sorted_ = placed(False).repartition(*_PART).sortWithinPartitions(*_order())
        told.append(sorted_.mapInPandas(_stream(window, min_ratio), _TOLD))
    if n_long:
        told.append(_in_chunks(placed(True), n_long, window, min_ratio, chunk_rows))
    return reduce(DataFrame.unionByName, told)


def round4(x: Column) -> Column:
    return F.round(x, 4)


def summarize_clusters(members: DataFrame, min_support: int = 2) -> DataFrame:
    """One row per cluster with enough distinct reads: the candidate columns but for the id.

    A null read name counts as one read for the threshold, not for the support.
    """
    reads = F.array_sort(F.collect_set("read_name"))
    start, length = X.half_even(F.median("event_pos")), X.half_even(F.median("svlen"))
    out = members.groupBy("chrom", "svtype", "cluster").agg(
        start.alias("start"), length.alias("median_svlen"), round4(F.avg("mapq")).alias("mean_mapq"),
        round4(F.stddev_pop("event_pos")).alias("std_pos"), round4(F.stddev_pop("svlen")).alias("std_svlen"), reads.alias("read_names"),
        F.transform(F.array_sort(F.collect_list(F.struct("member", "signal_index"))), lambda s: s["signal_index"]).alias("signal_indices"),
        F.max(F.col("read_name").isNull().cast("int")).alias("_null_read"), F.min("signal_index").alias("_first"),
        F.min(F.when(F.col("member") == 0, F.col("event_pos"))).alias("_pos"), F.min(F.when(F.col("member") == 0, F.col("svlen"))).alias("_len"),
        F.min(F.when(F.col("member") == 0, F.coalesce("read_name", F.lit("\uffff")))).alias("_read"),
    )
    out = out.where(F.size("read_names") + F.col("_null_read") >= min_support)
    end = F.when(F.col("svtype") == "DEL", F.col("start") + F.col("median_svlen")).otherwise(F.col("start") + 1)
    return out.withColumn("end", end).withColumn("support_read_count", F.size("read_names").cast("bigint"))


def candidates(signals: DataFrame, window: int = 500, min_support: int = 2, min_ratio: float = 0.5) -> DataFrame:
    """The candidate table with consecutive ids CAND_000001…: groups by first appearance, clusters in order of position."""
    members = cigar_clusters(signals, window, min_ratio)
    firsts = members.groupBy("chrom", "svtype").agg(F.min("signal_index").alias("_group"))
    out = summarize_clusters(members, min_support).join(firsts, ["chrom", "svtype"])
    order = [F.col("_pos"), F.col("_len"), F.col("_read"), F.col("cluster")]
    out = numbered(out, "_id", ["chrom", "svtype"], [F.min("_group")], order, 1)
    return out.select(
        F.format_string("CAND_%06d", "_id").alias("candidate_id"), "chrom", "start", "end", "svtype", "median_svlen", "support_read_count", "mean_mapq",
        "std_pos", "std_svlen", "read_names", "signal_indices",
    )


# --- proposals from extra evidence

#: Support a cluster needs per source it holds.
SOURCE_SUPPORT = {"SOFTCLIP": 10, "SA": 2, "SUPPLEMENTARY": 2}


def source_support(min_support: int | None = None, softclip: int | None = None, sa: int | None = None, supplementary: int | None = None) -> dict[str, int]:
    """Thresholds per source: an explicit ``min_support`` replaces the defaults, a source's own value replaces both."""
    own = {"SOFTCLIP": softclip, "SA": sa, "SUPPLEMENTARY": supplementary}
    return {k: v if v is not None else min_support if min_support is not None else SOURCE_SUPPORT[k] for k, v in own.items()}


def extra_clusters(proposals: DataFrame, window: int = 500) -> DataFrame:
    """Proposals (chrom, position, svtype, size, source) with the start of their gap cluster."""
    return gap_islands(proposals, ["chrom", "svtype"], "position", window, "cluster")


def extra_candidates(proposals: DataFrame, window: int = 500, min_size: int = 50, support: dict[str, int] | None = None) -> DataFrame:
    """One row per cluster with the support that its most demanding source asks for, and a median of at least ``min_size``."""
    support = support or source_support()
    need = F.greatest(*[F.max(F.when(F.col("source") == s, n).otherwise(0)) for s, n in support.items()])
    out = extra_clusters(proposals, window).groupBy("chrom", "svtype", "cluster").agg(
        X.half_even(F.median("position")).alias("start"), F.greatest(F.lit(1), F.abs(X.half_even(F.median("size")))).cast("bigint").alias("_size"),
        F.count(F.lit(1)).alias("support"), F.collect_set("source").alias("_sources"), need.alias("_need"),
        round4(F.avg("position")).alias("mean_pos"), round4(F.avg("size")).alias("mean_size"),
    )
    out = out.where((F.col("support") >= F.col("_need")) & (F.col("_size") >= min_size))
    deletion = F.col("svtype") == "DEL"
    signed = F.when(deletion, -F.col("_size")).otherwise(F.col("_size"))
    return out.select(
        "chrom", "start", F.when(deletion, F.col("start") + F.col("_size")).otherwise(F.col("start") + 1).alias("end"), "svtype", signed.alias("svlen"),
        signed.alias("median_svlen"), "support", F.when(F.size("_sources") == 1, F.get("_sources", F.lit(0))).otherwise("MIXED_EXTRA").alias("source"), "mean_pos", "mean_size",
    )


def extra_candidate_order() -> list[Column]:
    return [F.col("chrom"), F.col("start"), F.col("svtype"), F.abs("svlen")]
