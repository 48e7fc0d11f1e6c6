"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed by (source, language, topic). The weights of these cells are raked to the three target
marginals in turn, one window sum over the cell table per step; no document takes part. A scale factor turns weights
into inclusion probabilities of at most 1 that keep the wanted share of all tokens in expectation, and a document is
sampled when a hash of its id falls below its cell's probability, so the result is the same on every run.

Targets are shares proportional to (tokens of the class) ** exponent, or given shares; classes that given shares do
not name get the rest in proportion to their tokens.

Defined results: null source, language or topic is a class of its own, shown as '(none)'; null or empty text has no
tokens and is sampled with its cell's probability; cells without tokens keep weight 1; repeated rows are decided
alike; an empty table gives an empty table; other columns pass through ``sample`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Exponents of the default targets: sources are flattened most, then languages, then topics.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Rounds over all marginals, and the share of all tokens to keep.
SWEEPS, KEEP = 12, 0.6
#: Cells up to which the cell table is broadcast to the documents.
BROADCAST_CELLS = 100_000
_DIMS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def content_topic(text: Column) -> Column:
    """A content class of the whole text: tables, notes, articles, books."""
    text = F.coalesce(text, F.lit(""))
    size = F.char_length(text)
    bars = size - F.char_length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(bars * 40 > size, "table").when(size < 600, "note").when(size < 4000, "article").otherwise("book")


def _keyed(docs: DataFrame, text: str, source: str, lang: str, topic: Column) -> dict[str, Column]:
    none = F.lit("(none)")
    return {
        "_bw_source": F.coalesce(F.col(source).cast("string"), none),
        "_bw_lang": F.coalesce(F.col(lang).cast("string"), none),
        "_bw_topic": F.coalesce(topic.cast("string"), none),
    }


def rake(scratch: Scratch, cells: DataFrame, exponents: dict[str, float] = EXPONENTS, shares: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with the raked ``weight`` per token."""
    shares = shares or {}
    every = Window.partitionBy(F.lit(0))
    tokens = F.col("tokens").cast("double")
    for dim in _DIMS:
        if dim in shares:
            given = F.create_map(*[F.lit(x) for pair in shares[dim].items() for x in pair])[F.col(dim)]
            rest = max(0.0, 1.0 - sum(shares[dim].values()))
            marginal = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).withColumn("given", given)
            other = F.sum(F.when(F.col("given").isNull(), F.col("t"))).over(every)
            marginal = marginal.select(dim, F.coalesce("given", F.col("t") / other * rest).alias(f"share_{dim}"))
        else:
            marginal = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).withColumn("p", F.pow(F.col("t").cast("double"), F.lit(exponents[dim])))
            total = F.sum("p").over(every)
            marginal = marginal.select(dim, F.when(total > 0, F.col("p") / total).otherwise(0.0).alias(f"share_{dim}"))
        cells = cells.join(marginal, dim)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for dim in _DIMS:
        cells = cells.withColumn(f"share_{dim}", F.col(f"share_{dim}") * float(total))
    cells = scratch.put("cells", cells.withColumn("weight", F.lit(1.0)))
    for done in range(1, sweeps + 1):
        for dim in _DIMS:
            own = F.sum(tokens * F.col("weight")).over(Window.partitionBy(dim))
            cells = cells.withColumn("own", own).withColumn("weight", F.when(F.col("own") > 0, F.col("weight") * F.col(f"share_{dim}") / F.col("own")).otherwise(F.col("weight"))).drop("own")
        if done % 4 == 0 or done == sweeps:
            before, cells = cells, scratch.put("cells", cells)
            scratch.drop(before)
    return cells.select(*_DIMS, "tokens", "weight")


def probabilities(scratch: Scratch, cells: DataFrame, keep: float = KEEP, rounds: int = 12) -> DataFrame:
    """Raked cells with ``prob`` = min(1, scale * weight), whose expected tokens are ``keep`` of all."""
    cells = scratch.put("raked", cells)
    t, w = F.col("tokens").cast("double"), F.col("weight")
    total, weighted = cells.agg(F.sum(t), F.sum(t * w)).first()
    scale = keep * total / weighted if weighted else 0.0
    for _ in range(rounds):
        capped, rest = cells.agg(F.sum(F.when(w * scale >= 1, t)), F.sum(F.when(w * scale < 1, t * w))).first()
        new = (keep * total - (capped or 0.0)) / rest if rest else scale
        if new == scale:
            break
        scale = new
    return cells.withColumn("prob", F.least(F.lit(1.0), w * scale))


def chance(doc_id: Column) -> Column:
    """A uniform number in [0, 1) from the id."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":mix"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(2**48)


def _fitted(scratch: Scratch, keyed: DataFrame, keep: float, exponents, shares, sweeps) -> DataFrame:
    cells = keyed.groupBy(*[F.col(f"_bw_{d}").alias(d) for d in _DIMS]).agg(F.sum("_bw_tokens").alias("tokens"))
    cells = scratch.put("counts", cells)
    return scratch.put("fitted", probabilities(scratch, rake(scratch, cells, exponents, shares, sweeps), keep))


def _with_cells(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    side = fitted.select(*[F.col(d).alias(f"_bw_{d}") for d in _DIMS], F.col("weight").alias("_bw_weight"), F.col("prob").alias("_bw_prob"))
    side = F.broadcast(side) if fitted.count() <= BROADCAST_CELLS else side
    return rows.join(side, [f"_bw_{d}" for d in _DIMS])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, keep: float = KEEP, exponents=EXPONENTS, shares=None, sweeps: int = SWEEPS) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, prob, sampled."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keys = _keyed(docs, text, source, lang, content_topic(F.col(text)) if topic is None else topic)
    rows = scratch.put("rows", docs.select(F.col(doc_id).cast("long").alias("doc_id"), token_count(F.col(text)).alias("_bw_tokens"), *[c.alias(n) for n, c in keys.items()]))
    out = _with_cells(rows, _fitted(scratch, rows, keep, exponents, shares, sweeps))
    return out.select(
        "doc_id", *[F.col(f"_bw_{d}").alias(d) for d in _DIMS], F.col("_bw_tokens").alias("n_tokens"),
        F.round("_bw_weight", 6).alias("weight"), F.round("_bw_prob", 6).alias("prob"), (chance(F.col("doc_id")) < F.col("_bw_prob")).alias("sampled"),
    )


def sample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None, keep: float = KEEP, exponents=EXPONENTS, shares=None, sweeps: int = SWEEPS) -> DataFrame:
    """The sampled documents, whole rows."""
    scratch = Scratch(docs.sparkSession, "mixing")
    keys = _keyed(docs, text, source, lang, content_topic(F.col(text)) if topic is None else topic)
    fitted = _fitted(scratch, docs.select(token_count(F.col(text)).alias("_bw_tokens"), *[c.alias(n) for n, c in keys.items()]), keep, exponents, shares, sweeps)
    return _with_cells(docs.select("*", *[c.alias(n) for n, c in keys.items()]), fitted).where(chance(F.col(doc_id)) < F.col("_bw_prob")).select(*docs.columns)


def sql(keep: float = KEEP, sweeps: int = SWEEPS, rounds: int = 12, documents: str = "documents") -> str:
    """The same in DuckDB SQL, for the default topic and targets."""
    parts = [
        rf"""rws as (select doc_id, coalesce(text, '') as t, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as tokens,
  case when (length(t) - length(replace(t, '|', ''))) * 40 > length(t) then 'table' when length(t) < 600 then 'note' when length(t) < 4000 then 'article' else 'book' end as topic from {documents})""",
        "cells as (select source, lang, topic, sum(tokens)::double as tokens from rws group by all)",
    ]
    for d in _DIMS:
        parts.append(f"p_{d} as (select {d}, pow(sum(tokens), {EXPONENTS[d]}::double) as p from cells group by {d})")
        parts.append(f"m_{d} as (select {d}, case when (select sum(p) from p_{d}) > 0 then p / (select sum(p) from p_{d}) else 0 end * (select sum(tokens) from cells) as tgt_{d} from p_{d})")
    parts.append("w_0 as (select c.*, tgt_source, tgt_lang, tgt_topic, 1.0::double as weight from cells c join m_source using (source) join m_lang using (lang) join m_topic using (topic))")
    k = 0
    for _ in range(sweeps):
        for d in _DIMS:
            own = f"sum(tokens * weight) over (partition by {d})"
            parts.append(f"w_{k + 1} as materialized (select * replace (case when {own} > 0 then weight * tgt_{d} / {own} else weight end as weight) from w_{k})")
            k += 1
    parts.append(f"s_0 as materialized (select {keep}::double * sum(tokens) / sum(tokens * weight) as s from w_{k})")
    for r in range(rounds):
        parts.append(
            f"s_{r + 1} as materialized (select case when coalesce(sum(tokens * weight) filter (weight * s < 1), 0) > 0 then ({keep}::double * sum(tokens) - coalesce(sum(tokens) filter (weight * s >= 1), 0)) / (sum(tokens * weight) filter (weight * s < 1)) else any_value(s) end as s from w_{k}, s_{r})"
        )
    parts.append(f"fit as (select source, lang, topic, weight, least(1.0::double, weight * (select s from s_{rounds})) as prob from w_{k})")
    return (
        "with " + ",\n".join(parts) + "\nselect doc_id, source, lang, topic, tokens as n_tokens, round(weight, 6) as weight, round(prob, 6) as prob,\n"
        "  ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':mix'), 1, 12))::bigint / 281474976710656.0::double < prob as sampled\nfrom rws join fit using (source, lang, topic)"
    )
