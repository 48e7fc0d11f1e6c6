"""Chooses a decision threshold for every group of scored records from labels, reports the sweep, and writes decisions.

    python -m jobs.threshold_report --records RECORDS --labels LABELS --out OUT [--config CONFIG]

Records of any table are scored by a Spark SQL expression of the config (of the text table: the share of letters and of
distinct words). Records and labels meet on the id; those without a label of 0 or 1 are scored and decided, and don't
count. Each group's thresholds are swept in one aggregate, its threshold is the first with the largest F1, then recall,
then precision, and a group without usable labels takes the default. Written: OUT/scored (id, score, label), OUT/sweep
and OUT/decisions (id, score, label, threshold, kept), each partitioned by group. Long texts are read once: the sweep and the
decisions come from OUT/scored.

Every run replaces all three tables, so running it again gives the same. A null score is 0, a null group is '(none)', an id
with several labels has the largest; ids that repeat among records are records of their own; empty tables give empty ones.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakweave.operators import metrics

CONFIG = Path(__file__).with_suffix(".json")
log = logging.getLogger("threshold_report")


def run(spark: SparkSession, records: str, labels: str, out: str, config: dict) -> DataFrame:
    """Writes all three tables and returns the decisions."""
    id_, group, thresholds = config["id"], config["group"], tuple(config["thresholds"])
    name = F.coalesce(F.col(group).cast("string"), F.lit("(none)")).alias(group)
    scored = spark.read.parquet(records).select(F.col(id_), name, F.coalesce(F.expr(config["score"]), F.lit(0.0)).alias("gnn_prob"))
    told = spark.read.parquet(labels).groupBy(id_).agg(F.max(F.col(config["label"]).cast("int")).alias("label"))

    def put(df: DataFrame, to: str) -> DataFrame:
        # a hot group is dealt over several tasks, a small one is one file
        df.hint("rebalance", group).write.mode("overwrite").partitionBy(group).parquet(f"{out}/{to}")
        back = spark.read.schema(df.schema).parquet(f"{out}/{to}").select(*df.columns)
        log.info("wrote %d rows to %s/%s", back.count(), out, to)
        return back

    log.info("reading records of %s and labels of %s", records, labels)
    scored = put(scored.join(told, id_, "left"), "scored")
    n, labelled = scored.agg(F.count(F.lit(1)), F.count("label")).first()
    log.info("read %d records, %d of them with a label", n, labelled)
    put(metrics.sweep(scored, thresholds, by=(group,)), "sweep")
    best = metrics.best_threshold(scored, thresholds, by=(group,)).select(group, "threshold")
    threshold = F.coalesce("threshold", F.lit(float(config["default_threshold"])))
    decided = scored.join(best, group, "left").select(id_, group, F.col("gnn_prob").alias("score"), "label", threshold.alias("threshold"))
    return put(decided.withColumn("kept", F.col("score") >= F.col("threshold")), "decisions")


def main(argv: list[str] | None = None) -> None:
    at = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    for name in ("records", "labels", "out"):
        at.add_argument(f"--{name}", required=True)
    at.add_argument("--config", default=str(CONFIG))
    told = at.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("threshold-report").getOrCreate()
    try:
        run(spark, told.records, told.labels, told.out, json.loads(Path(told.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
