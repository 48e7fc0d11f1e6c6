"""Keeps the candidate table of a growing set of signals: reads the signal files that are new and refreshes only the
regions that their gap clusters touch.

    python -m jobs.candidate_refresh --source SIGNALS --out OUT --checkpoint CHECKPOINT [--config CONFIG]

A file stream with a checkpoint takes every file of SIGNALS once. The rows of a batch are written under OUT/signals by
batch and chromosome. Islands of signals, chained by gaps of at most the window, are found from one row per occupied
bin; islands that hold a new signal touch the regions that they span, and all signals of islands that reach into these
regions are clustered anew. OUT/candidates is partitioned by chromosome and region of a candidate's start, and only the
touched partitions, which OUT/touched lists by batch, are overwritten. A batch that is run again after a failure has the same number and the same rows, so
it overwrites its own signals and gives the same regions; a run without new files changes nothing.

Rows without chromosome, type, position or length are dropped. A region that has lost its candidates keeps one row
without a start; ``read_candidates`` leaves those out. Signal indexes must be unique over all files; a candidate's id
holds the index of its first signal. A file is known by its path: one that is replaced in place is not read again.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakweave.functions import exprs as X
from breakweave.operators import cluster
from breakweave.sources.stages import StageTables
from breakweave.sources.tables import exists

CONFIG = Path(__file__).with_suffix(".json")
SIGNALS = "signal_index bigint, read_name string, event_pos bigint, svtype string, svlen bigint, mapq double, batch bigint, chrom string"
CANDIDATES = (
    "candidate_id string, start bigint, end bigint, svtype string, median_svlen bigint, support_read_count bigint, mean_mapq double, std_pos double, std_svlen double, "
    "read_names array<string>, signal_indices array<bigint>, chrom string, region bigint"
)
TOUCHED = "chrom string, region bigint, batch bigint"
KEYS = ["chrom", "svtype"]
log = logging.getLogger("candidate_refresh")


def _files(source: str) -> str:
    """The source as a pattern of one name, since a file stream takes a single file by pattern only."""
    at, _, name = source.rstrip("/").rpartition("/")
    return f"{at}/{{{name}}}" if at else f"{{{name}}}"


def _bin(window: int):
    return F.floor(F.col("event_pos") / window)


def _spans(bins: DataFrame, region: int) -> DataFrame:
    """Islands with every region that they span."""
    spans = bins.groupBy(*KEYS, "island").agg(F.max("_high").alias("last"))
    return spans.select(*KEYS, "island", F.explode(F.sequence(F.floor(F.col("island") / region), F.floor(F.col("last") / region))).alias("region"))


def touched_regions(bins: DataFrame, new: DataFrame, window: int, region: int) -> DataFrame:
    """Regions (chrom, region) spanned by islands with a ``new`` signal, from the islands' bins."""
    fresh = bins.join(new.select(*KEYS, _bin(window).alias("_bin")).distinct(), [*KEYS, "_bin"], "left_semi").select(*KEYS, "island").distinct()
    return _spans(bins, region).join(fresh, [*KEYS, "island"], "left_semi").select("chrom", "region").distinct()


def refreshed(signals: DataFrame, bins: DataFrame, regions: DataFrame, config: dict) -> DataFrame:
    """The new content of the candidate table in ``regions``, a row without a candidate where there is none."""
    window, region = config["window"], config["region"]
    reached = _spans(bins, region).join(regions, ["chrom", "region"], "left_semi").select(*KEYS, "island").distinct()
    bins = bins.join(reached, [*KEYS, "island"], "left_semi")
    rows = signals.withColumn("mapq", X.number_or("mapq"))
    found = cluster.summarize_clusters(cluster.fold_islands(rows, bins, window, config["min_ratio"]), config["min_support"])
    found = found.withColumn("candidate_id", F.concat_ws(":", "chrom", "svtype", F.col("cluster").cast("string"))).withColumn("region", F.floor(F.col("start") / region))
    kinds = dict(c.split() for c in CANDIDATES.split(", "))
    return regions.join(found, ["chrom", "region"], "left").select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def read_candidates(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CANDIDATES).parquet(f"{out}/candidates").where(F.col("start").isNotNull())


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Takes in what is new under ``source`` and returns the whole candidate table."""
    stream = spark.readStream.schema(spark.read.parquet(source).schema)
    if config.get("max_files_per_batch"):
        stream = stream.option("maxFilesPerTrigger", config["max_files_per_batch"])
    whole = lambda c: X.number_or(c, None).cast("bigint").alias(c)
    read = stream.parquet(_files(source)).selectExpr(*config["signals"])
    read = read.select("signal_index", "read_name", whole("event_pos"), "svtype", whole("svlen"), X.number_or("mapq", None).alias("mapq"), "chrom").dropna(subset=["chrom", "svtype", "event_pos", "svlen"])

    def take(batch: DataFrame, number: int) -> None:
        # the stream's own session plans without adaptive execution; what is read back is planned by the caller's
        overwrite = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        overwrite(batch.withColumn("batch", F.lit(number).cast("bigint"))).partitionBy("batch", "chrom").parquet(f"{out}/signals")
        signals = spark.read.schema(SIGNALS).parquet(f"{out}/signals")
        new = signals.where(F.col("batch") == number)
        n, chroms = new.agg(F.count(F.lit(1)), F.collect_set("chrom")).first()
        log.info("batch %d: read %d usable signals of %d chromosomes", number, n, len(chroms))
        if not n:
            return
        near = signals.where(F.col("chrom").isin(chroms))
        # one row per occupied bin, read by all that follows
        bins = StageTables(spark, temporary=True).put("bins", cluster.island_bins(near, KEYS, "event_pos", config["window"]))
        regions = touched_regions(bins, new, config["window"], config["region"])
        overwrite(regions.withColumn("batch", F.lit(number).cast("bigint"))).partitionBy("batch").parquet(f"{out}/touched")
        regions = spark.read.schema(TOUCHED).parquet(f"{out}/touched").where(F.col("batch") == number).drop("batch")
        result = refreshed(near, bins, regions, config)
        overwrite(result.hint("rebalance", "chrom", "region")).partitionBy("chrom", "region").parquet(f"{out}/candidates")
        log.info("batch %d: candidates of %d touched regions written to %s/candidates", number, regions.count(), out)

    log.info("reading new files of %s", source)
    read.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, f"{out}/candidates"):
        return spark.createDataFrame([], CANDIDATES)
    table = read_candidates(spark, out)
    log.info("%s/candidates now holds %d candidates", out, table.count())
    return table


def main(argv: list[str] | None = None) -> None:
    at = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    for name in ("source", "out", "checkpoint"):
        at.add_argument(f"--{name}", required=True)
    at.add_argument("--config", default=str(CONFIG))
    told = at.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("candidate-refresh").getOrCreate()
    try:
        run(spark, told.source, told.out, told.checkpoint, json.loads(Path(told.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
