"""Exact dedup with a heavy-hitter split.

Texts are equal when identical after each run of ASCII white space became one space. One pass over the texts
writes (doc_id, digest). Misra-Gries summaries of the digests name every digest above 1/(counters+1) of all rows;
their exact sizes and winners, at most ``counters`` rows, are broadcast and settle the large groups where they are
read. The remaining digests, whose groups are bounded by that share, meet by an ordinary shuffle.

Defined results: null text counts as empty; of equal rows with one doc_id exactly one is kept; a null doc_id
loses against any other, and a group of null ids only has a null keep_id; an empty table gives an empty table;
a very long text is hashed where it is read and only its digest travels; other columns, whatever their names, are not
looked at, but that a hash of them chooses which of several rows with one doc_id and equal texts is kept as a row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, filter_ids

#: Counters of a Misra-Gries summary, and the most rows that are ever broadcast.
COUNTERS = 1024


def normalised(text):
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, row): 32 bytes of SHA-256 and a number that tells repeated rows apart once it is written."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def misra_gries(keys: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Candidates for every value with more than rows/(counters+1) rows: (column, low), at most ``counters`` rows.

    Each task keeps one summary; summaries are merged by adding and cutting at the (counters+1)-th largest count,
    so that all errors together stay below rows/(counters+1).
    """

    def cut(counts: pd.Series) -> pd.Series:
        if len(counts) <= counters:
            return counts
        counts = counts.sort_values(ascending=False)
        counts = counts.iloc[:counters] - counts.iloc[counters]
        return counts[counts > 0]

    def summarise(batches):
        held = pd.Series(dtype="int64")
        for pdf in batches:
            new = pdf.groupby(column, sort=False)["low"].sum() if "low" in pdf else pdf[column].value_counts(sort=False)
            held = cut(held.add(new, fill_value=0).astype("int64") if len(held) else new.astype("int64"))
        if len(held):
            yield pd.DataFrame({column: held.index, "low": held.to_numpy()})

    kind = keys.schema[column].dataType.simpleString()
    part = keys.select(column).mapInPandas(summarise, f"{column} {kind}, low long")
    # two more levels of merging, so that no task reads more than some tens of summaries of a large job
    part = part.repartition(64).mapInPandas(summarise, f"{column} {kind}, low long")
    return part.repartition(1).mapInPandas(summarise, f"{column} {kind}, low long")


def settle(spark: SparkSession, scratch: Scratch, keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """For each row of ``keys`` (doc_id, digest, row): keep_id, group_size, kept."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("r")))
    likely = misra_gries(keys, "digest", counters).select("digest")
    winners = scratch.put("winners", keys.join(F.broadcast(likely), "digest").groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    marked = keys.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where("best is not null")
    own = Window.partitionBy("digest")
    light = marked.where("best is null").drop("best", "group_size").select("*", best.over(own).alias("best"), F.count(F.lit(1)).over(own).alias("group_size"))
    return heavy.unionByName(light).select("doc_id", "digest", "row", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    keys = scratch.put("digests", digests(docs, doc_id, text))
    return settle(spark, scratch, keys, counters).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the copies; columns and whole rows as they were.

    Only ids travel. Rows that repeat both doc_id and text can't be told apart by id; where there are any, they alone
    are shuffled whole and made distinct; the row with the smallest hash of its columns (maps aside) stays.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    keys = scratch.put("digests", digests(docs, doc_id, text))
    told = scratch.put("told", settle(spark, scratch, keys, counters).select("doc_id", "digest", "keep_id", "kept"))
    clash = told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null")
    clash = scratch.put("clash", clash.select("doc_id"))
    n_clash, n_gone = clash.count(), told.where("not kept").count()
    if not n_clash:
        return filter_ids(docs, told.where("not kept").select("doc_id"), n_gone, False, doc_id)
    # ids that occur more than once: keep by digest, one row each
    key = "_breakweave_digest"
    clash_ids = clash.where("doc_id is not null")
    plain = filter_ids(docs.where(F.col(doc_id).isNotNull()), clash_ids, n_clash, False, doc_id)
    plain = filter_ids(plain, told.where("not kept").select("doc_id"), n_gone, False, doc_id)
    odd = docs.join(clash_ids.withColumnRenamed("doc_id", doc_id), doc_id, "left_semi").unionByName(docs.where(F.col(doc_id).isNull()))
    odd = odd.withColumn(key, F.unhex(F.sha2(normalised(F.col(text)), 256)))
    stay = told.join(clash, told.doc_id.eqNullSafe(clash.doc_id), "left_semi").where("kept").select(F.col("doc_id").alias("_breakweave_id"), F.col("digest").alias("_breakweave_kept"))
    odd = odd.join(stay, odd[doc_id].eqNullSafe(F.col("_breakweave_id")) & (F.col(key) == F.col("_breakweave_kept")), "left_semi")
    # of rows that differ in other columns only, a hash of the whole row chooses, so that a repeated task chooses alike
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    odd = odd.withColumn("_breakweave_no", F.row_number().over(Window.partitionBy(doc_id, key).orderBy(whole))).where("_breakweave_no = 1").drop(key, "_breakweave_no")
    return plain.unionByName(odd.select(*plain.columns))


SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id) = 1 as kept, text_sha256
from d
"""
