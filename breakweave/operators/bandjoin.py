"""Joins on positions that lie near each other, as hash joins over bins, and ordinals without one big partition.

``band_join`` bins one side once and the other into three bins of the band's width, so an equi-join on keys and bin finds
every pair within the band; the exact distance is tested afterwards. ``interval_join`` bins intervals into all bins they
touch. A hot bin is an ordinary skewed join key for adaptive execution. ``sums_up_to`` counts without pairs, ``nearest`` finds the best partner within a band
without listing the pairs of a dense band.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.stages import StageTables

_BIN = "_band_bin"


def meet(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join of two growing tables that is not planned as a broadcast, which would bring one of them whole to the driver.

    Spark takes sizes from files; compressed ones, and rows that are exploded behind them, are a hundred times larger in memory.
    """
    return left.join(right.hint("merge"), on, how)


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs with equal ``keys`` and positions at most ``width`` apart. Column names of the sides must differ but for the keys."""
    step = max(1, int(width))
    near = left.withColumn(_BIN, F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(left_pos) / step) + d)))
    binned = right.withColumn(_BIN, F.floor(F.col(right_pos) / step))
    return meet(near, binned, [*keys, _BIN], how).where(F.abs(F.col(left_pos) - F.col(right_pos)) <= width).drop(_BIN)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, right_pos: str, bin_size: int = 10_000) -> DataFrame:
    """Pairs with equal ``keys`` and ``right_pos`` in [low, high] of the left row."""
    spread = F.when(F.col(high) >= F.col(low), F.sequence(F.floor(F.col(low) / bin_size), F.floor(F.col(high) / bin_size)))
    near = left.withColumn(_BIN, F.explode(spread))
    binned = right.withColumn(_BIN, F.floor(F.col(right_pos) / bin_size))
    return meet(near, binned, [*keys, _BIN]).where(F.col(right_pos).between(F.col(low), F.col(high))).drop(_BIN)


#: Width of the smallest tiles of ``in_tiles``.
TILE = 4096


def in_tiles(left: DataFrame, right: DataFrame, keys: list[str], low: str, high: str, places: list[str], tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_level`` and ``_tile``: every left interval is in one tile, and right rows are in all tiles whose intervals may reach them.

    A tile of level n is ``tile`` * 2 ** n wide, and an interval goes to the level whose tiles are at least its own length, so it
    reaches no further than into the next tile. A right row with several ``places`` is in a tile once. Join both on keys, ``_level`` and
    ``_tile``: all that belongs to a left row is then in one partition, and aggregates over it need no further shuffle.
    """
    length = F.greatest(F.col(high) - F.col(low), F.lit(1)).cast("double")
    wide = lambda: F.lit(tile) * F.pow(F.lit(2), "_level").cast("bigint")
    own = left.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(length / tile))).cast("int")).withColumn("_tile", F.floor(F.col(low) / wide()))
    levels = own.where("_tile is not null").select(*keys, "_level").distinct()
    tiles = F.array_distinct(F.array_compact(F.array(*[F.floor(F.col(p) / wide()) - d for p in places for d in (0, 1)])))
    return own, right.join(F.broadcast(levels), keys).withColumn("_tile", F.explode(tiles))


def sums_up_to(ends: DataFrame, points: DataFrame, keys: list[str], at: str, weights: list[str], tile: int = TILE) -> DataFrame:
    """``ends`` with the sums of the ``weights`` of all ``points`` that have their keys and lie at or before their ``at``.

    Differences of such sums are the numbers of points in intervals, without meeting a point. Sums run within tiles of places, and over one
    row of each tile before, so no window holds more than the rows of a tile or the tiles of a key.
    """
    zero = F.lit(0).cast("bigint")
    rows = ends.withColumns({"_end": F.lit(1), **dict.fromkeys(weights, zero)}).unionByName(points.withColumn("_end", F.lit(0)), allowMissingColumns=True)
    rows = rows.where(F.col(at).isNotNull()).withColumn("_tile", F.floor(F.col(at) / tile))
    line = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "_tile").agg(*[F.sum(w).alias(w) for w in weights]).select(*keys, "_tile", *[F.coalesce(F.sum(w).over(line), zero).alias(f"_before_{w}") for w in weights])
    own = Window.partitionBy(*keys, "_tile").orderBy(at, "_end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumns({w: F.sum(w).over(own) for w in weights}).where("_end = 1").join(before, [*keys, "_tile"])
    return sums.select(*ends.columns, *[(F.col(w) + F.col(f"_before_{w}")).alias(w) for w in weights])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, left_size: str, right_pos: str, right_size: str, width: int, min_sim: float, ordinal: str) -> DataFrame:
    """For each distinct (keys, left_pos, left_size) with a similar partner: that place and size, the partner's ``ordinal``, dist and sim.

    The partner has equal ``keys``, lies at most ``width`` away, and the smaller of the two sizes is at least ``min_sim`` of
    the larger; nearest first, then the more similar, then the smaller ordinal. Sizes are doubles of at least 0; one of 0 is
    similar to nothing. Rows that agree in keys, place and size have one answer, so each side is made distinct first. Places
    search a narrow band, and only those that find nothing there a wider one, so a dense band is not listed; sizes are
    binned by their logarithm, so pairs of unlike sizes don't meet.
    """
    step, any_size = max(1, int(width)), min_sim <= 0
    span = 1.0 if any_size else max(1e-9 - log(min(min_sim, 1.0)), 1e-6)
    size_bin = lambda c: F.lit(0).cast("bigint") if any_size else F.floor(F.log(F.col(c)) / span)
    some = lambda df, p, z: df.where(((F.col(z) > 0) | F.lit(any_size)) & F.col(p).isNotNull())
    stage = StageTables(left.sparkSession, temporary=True)
    mine, place = [F.col(k) for k in keys], [*keys, left_pos, left_size]
    todo = stage.put("left", some(left, left_pos, left_size).select(*mine, left_pos, left_size).distinct())
    theirs = some(right, right_pos, right_size).groupBy(*keys, right_pos, right_size).agg(F.min(ordinal).alias(ordinal))
    theirs = stage.put("right", theirs.withColumn("_size_bin", size_bin(right_size)))
    widths = [step]
    while widths[0] > 16:
        widths.insert(0, widths[0] // 16)
    dist, found = F.abs(F.col(left_pos) - F.col(right_pos)), []
    for w in widths:
        near = todo.withColumn("_size_bin", F.explode(F.transform(F.array(*map(F.lit, (0,) if any_size else (-1, 0, 1))), lambda d: size_bin(left_size) + d)))
        pairs = band_join(near, theirs, [*keys, "_size_bin"], left_pos, right_pos, w)
        pairs = pairs.withColumns({"dist": dist, "sim": X.size_similarity(left_size, right_size)}).where(F.col("sim") >= min_sim)
        told = best_of(pairs.where(F.col("dist") <= width), place, [F.col("dist"), -F.col("sim"), F.col(ordinal)], [ordinal, "dist", "sim"])
        found.append(stage.put(f"found{len(found)}", told))
        if w < step:
            todo = stage.put(f"left{len(found)}", meet(todo, found[-1].select(*place), place, "left_anti"))
    return reduce(DataFrame.unionByName, found)


def best_of(pairs: DataFrame, by: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """For each ``by`` the pair that comes first in ``order``; the last order column should be an ordinal."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], *[F.col(c).alias(c) for c in keep])
    best = pairs.groupBy(*by).agg(F.min(key).alias("_best"))
    return best.select(*by, *[F.col(f"_best.{c}").alias(c) for c in keep])


def numbered(df: DataFrame, name: str, group: list[str], group_order: list[Column], order: list[Column], first: int = 0) -> DataFrame:
    """A running number over groups in ``group_order`` and rows in ``order``, by one range sort of all rows."""
    keys = [f"_g{i}" for i in range(len(group_order))]
    own = df.groupBy(*group).agg(*[c.alias(k) for c, k in zip(group_order, keys, strict=True)]).withColumnsRenamed({g: f"_of_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & df[g].eqNullSafe(own[f"_of_{g}"])
    placed = global_ordinal(df.join(own, same), name, [*map(F.col, [*keys, *group]), *order])
    return placed.select(*df.columns, (F.col(name) + first).cast("bigint").alias(name))


def in_order(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows sorted over all partitions, as a table, with ``_at``: the partition above bit 33, the place in it below.

    It is a table because sampled range bounds must be the same for whatever is summed over partitions and for the rows.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return StageTables(df.sparkSession, temporary=True).put("sorted", placed)


def _part() -> Column:
    return F.shiftright("_at", 33)


def _before(placed: DataFrame, amount: Column) -> DataFrame:
    """The sum of ``amount`` over all earlier partitions; one row per partition, whose number bounds window and broadcast."""
    totals = placed.groupBy(_part().alias("_part")).agg(amount.alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(totals.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))


def global_ordinal(df: DataFrame, name: str, order: list[Column], parts: int | None = None) -> DataFrame:
    """0-based position of each row in the order of ``order``: a range sort, then partition offsets."""
    placed = in_order(df, order, parts)
    out = placed.withColumn("_part", _part()).join(_before(placed, F.count(F.lit(1))), "_part")
    return out.select(*df.columns, (F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before")).cast("bigint").alias(name))


def running_sum(df: DataFrame, name: str, value: str, order: list[Column], parts: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each one in ``order``: sums within range partitions and those before."""
    placed = in_order(df, order, parts)
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_part", _part()).join(_before(placed, F.sum(value)), "_part")
    return out.select(*df.columns, (F.coalesce(F.sum(value).over(own), F.lit(0)) + F.coalesce("_before", F.lit(0))).alias(name))
