"""Confusion counts, precision/recall/F1, ROC AUC, thresholds and class weights, as small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

#: Thresholds of the training search (19) and of the calling sweep (9).
SEARCH = tuple(0.05 + i * 0.05 for i in range(19))
SWEEP = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)


_COUNTS = ("tp", "fp", "fn", "tn")


def usable(pred: DataFrame) -> DataFrame:
    """Rows whose label is 0 or 1."""
    return pred.where(F.col("label").try_cast("int").isin(0, 1)).withColumn("label", F.col("label").try_cast("int"))


def _count(c: Column) -> Column:
    return F.count_if(c)


def confusion_columns(positive: Column, label: str = "label") -> list[Column]:
    label = F.col(label)
    return [
        _count((label == 1) & positive).alias("tp"), _count((label == 0) & positive).alias("fp"),
        _count((label == 1) & ~positive).alias("fn"), _count((label == 0) & ~positive).alias("tn"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_prf(counts: DataFrame, digits: int | None = 6) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; 0 where a denominator is 0."""
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _ratio(2 * p * r, p + r)
    show = (lambda x: F.round(x, digits)) if digits is not None else (lambda x: x)
    return counts.select("*", show(p).alias("precision"), show(r).alias("recall"), show(f1).alias("f1"))


def confusion(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn of probability at or above the threshold."""
    return usable(pred).agg(*confusion_columns(X.number_or("gnn_prob") >= threshold))


def evaluation(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Two rows, everything taken as positive and filtered, and what filtering saves and costs."""
    keep = X.number_or("gnn_prob") >= threshold
    named = lambda prefix, positive: [c.alias(f"{prefix}_{n}") for n, c in zip(_COUNTS, confusion_columns(positive), strict=True)]
    one = usable(pred).agg(*named("raw", F.lit(True)), *named("gnn", keep))
    row = lambda name, prefix: F.struct(F.lit(name).alias("name"), *[F.col(f"{prefix}_{n}").alias(n) for n in _COUNTS])
    gain = [F.col("raw_fp") - F.col("gnn_fp"), F.col("raw_tp") - F.col("gnn_tp")]
    out = one.select(
        gain[0].alias("fp_reduction"), F.round(_ratio(gain[0], F.col("raw_fp")), 6).alias("fp_reduction_rate"), gain[1].alias("tp_loss"),
        F.round(_ratio(gain[1], F.col("raw_tp")), 6).alias("tp_loss_rate"), F.explode(F.array(row("Raw", "raw"), row("GNN", "gnn"))).alias("r"),
    )
    gains = ("fp_reduction", "fp_reduction_rate", "tp_loss", "tp_loss_rate")
    return with_prf(out.select("r.*", *[F.when(F.col("r.name") == "GNN", F.col(g)).alias(g) for g in gains])).select("name", *_COUNTS, "precision", "recall", "f1", *gains)


def evaluation_report(pred: DataFrame, threshold: float = 0.5) -> str:
    """The evaluation as text."""
    rows = {r.name: r for r in evaluation(pred, threshold).collect()}
    if not any(rows["Raw"][k] for k in ("tp", "fp", "fn", "tn")):
        return "No usable labels found for evaluation.\n"
    out = []
    for name, r in rows.items():
        out += [f"{name} TP: {r.tp}", f"{name} FP: {r.fp}", f"{name} FN: {r.fn}", f"{name} TN: {r.tn}", f"{name} Precision: {r.precision:.6f}", f"{name} Recall: {r.recall:.6f}", f"{name} F1: {r.f1:.6f}", ""]
    g = rows["GNN"]
    out += [f"FP reduction: {g.fp_reduction} ({g.fp_reduction_rate:.6f})", f"TP loss: {g.tp_loss} ({g.tp_loss_rate:.6f})"]
    return "\n".join(out) + "\n"


def roc_auc(pred: DataFrame, score: str = "gnn_prob") -> DataFrame:
    """Probability that a positive outranks a negative, ties half; null if one class is missing.

    Counts are taken per distinct score first; only those rows are put in order.
    """
    from .bandjoin import running_sum

    per = usable(pred).groupBy(F.col(score).alias("s")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    below = running_sum(per, "below", "neg", [F.col("s")])
    sums = below.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0))).alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))), 6).alias("auc"))


def sweep(pred: DataFrame, thresholds=SWEEP, digits: int | None = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per threshold (of each group), in one pass: each row goes to the thresholds it reaches by position, not by a join."""
    rows = usable(pred).select(*by, "label", X.number_or("gnn_prob").alias("p"))
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("p")))
    per = rows.groupBy(*by, reached.alias("reached")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    # thresholds are given in ascending order: a row that reaches k of them reaches the first k
    all_ = per.groupBy(*by).agg(F.collect_list(F.struct("reached", "pos", "neg")).alias("c"))
    points = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds)])).alias("t")

    def total(field: str, least: Column) -> Column:
        return F.aggregate(F.filter("c", lambda x: x["reached"] >= least), F.lit(0).cast("bigint"), lambda s, x: s + x[field])

    out = all_.select(*by, "c", points).select(*by, "c", "t.*")
    out = out.select(*by, "k", "threshold", total("pos", F.col("k")).alias("tp"), total("neg", F.col("k")).alias("fp"), total("pos", F.lit(0)).alias("p"), total("neg", F.lit(0)).alias("n"))
    return with_prf(out.select(*by, "k", "threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn")), digits)


def best_threshold(pred: DataFrame, thresholds=SEARCH, by: tuple[str, ...] = ()) -> DataFrame:
    """The first threshold (of each group) with the largest (f1, recall, precision)."""
    rank = F.struct("f1", "recall", "precision", (-F.col("k")).alias("first"))
    best = sweep(pred, thresholds, None, by).groupBy(*by).agg(F.max_by(F.struct("threshold", "f1", "recall", "precision"), rank).alias("b"))
    return best.select(*by, F.round("b.threshold", 6).alias("threshold"), *[F.round(f"b.{c}", 6).alias(c) for c in ("f1", "recall", "precision")])


def positive_weight(pred: DataFrame, mode: str = "auto") -> DataFrame:
    """Negatives per positive; 1 for a single class, null for mode none."""
    n = usable(pred).agg(F.coalesce(F.sum("label"), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("n"))
    w = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("n") / F.col("p")).otherwise(1.0)
    return n.select(F.round(w if mode != "none" else F.lit(None).cast("double"), 6).alias("pos_weight"))
