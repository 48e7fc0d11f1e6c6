"""The driver's general tables seen as the domain's tables.

Every adapter is one select over all rows of its table. The ``raw_`` ones have the gaps and oddities of tables as they are
found: missing positions and lengths, fractions, lower-case types, no support. ``SQL`` holds the same selects for DuckDB;
the two dialects differ only in how seconds are counted, in integer division and in arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CHROM = "case event_type when 'view' then 'chr1' when 'click' then 'chr2' when 'purchase' then '10' when 'signup' then 'chrX' else 'scaffold_a' end"
_TYPE = "case when user_id % 2 = 0 then 'DEL' else 'INS' end"
_LEN = "(50 + cast(floor(value) as bigint))"

#: name -> (table, columns); {sec} is seconds since 2024, {idiv} whole division, {arr}…{end} an array.
_SELECTS = {
    "signals": (
        "events",
        f"event_id as signal_index, case when event_id % 97 = 0 then null else concat('r', cast(user_id as string)) end as read_name, {_CHROM} as chrom, {{sec}} as event_pos, "
        f"{{sec}} + case when user_id % 2 = 0 then {_LEN} else 1 end as event_end, {_TYPE} as svtype, {_LEN} as svlen, case when event_id % 13 <> 0 then event_id % 61 end as mapq, "
        "case when event_id % 2 = 0 then '+' else '-' end as strand, 1000 + event_id % 5000 as read_len, event_id % 900 as read_event_start, event_id % 900 + event_id % 80 as read_event_end, "
        "cast(case when event_id % 5 = 0 then 1 else 0 end as int) as is_supplementary, cast(case when event_id % 3 = 0 then 1 else 0 end as int) as has_sa, "
        "event_id % 80 as softclip_left, event_id % 70 as softclip_right, '100M' as cigar",
    ),
    "raw_signals": (
        "events",
        f"event_id as signal_index, case when event_id % 97 = 0 then null else concat('r', cast(user_id as string)) end as read_name, {_CHROM} as chrom, case when event_id % 101 <> 7 then {{sec}} end as event_pos, "
        f"{_TYPE} as svtype, case when event_id % 103 <> 9 then {_LEN} end as svlen, case when event_id % 13 <> 0 then event_id % 61 end as mapq",
    ),
    "truth": (
        "events",
        f"concat('T', cast(event_id as string)) as truth_id, {_CHROM} as chrom, {{sec}} + (event_id % 5) * 40 - 80 as pos, {_TYPE} as svtype, "
        f"({_LEN} * (55 + event_id % 91)) {{idiv}} 100 as svlen, event_id as truth_ordinal",
    ),
    "candidates": (
        "events",
        f"concat('C', cast(event_id as string)) as candidate_id, {_CHROM} as chrom, {{sec}} as start, {{sec}} + case when user_id % 2 = 0 then {_LEN} else 1 end as end_, {_TYPE} as svtype, "
        f"{_LEN} as median_svlen, event_id % 17 as support_read_count, cast(event_id % 61 as double) as mean_mapq, cast(event_id % 300 as double) as std_pos, cast(event_id % 40 as double) as std_svlen, "
        "case when event_id % 2 = 0 then {arr}event_id, event_id + 1, event_id + 3, event_id{end} else {none} end as signal_indices, cast(event_id % 3 as int) % 2 as label, event_id as ordinal",
    ),
    "raw_candidates": (
        "events",
        f"case when event_id % 29 <> 0 then concat('C', cast(event_id as string)) end as candidate_id, {_CHROM} as chrom, {{sec}} as start, case when event_id % 7 <> 3 then {{sec}} + case when user_id % 2 = 0 then {_LEN} else 1 end end as end_, "
        f"case when event_id % 11 = 0 then lower({_TYPE}) else {_TYPE} end as svtype, case when event_id % 9 = 4 then null when event_id % 9 = 5 then 0.0 else {_LEN} + 0.25 * (event_id % 4) end as median_svlen, "
        f"case when event_id % 18 = 4 then -{_LEN} - 0.5 end as svlen, case when event_id % 10 <> 0 then event_id % 17 end as support_read_count, case when event_id % 8 <> 0 then cast(event_id % 61 as double) end as mean_mapq, event_id as ordinal",
    ),
    "raw_extra_candidates": (
        "events",
        f"{_CHROM} as chrom, {{sec}} + (event_id % 7) * 150 as start, case when event_id % 5 <> 0 then {{sec}} + (event_id % 7) * 150 + 60 + event_id % 50 end as end_, case when event_id % 17 = 0 then 'DUP' when event_id % 11 = 0 then lower({_TYPE}) else {_TYPE} end as svtype, "
        f"case when event_id % 9 <> 4 then (({_LEN} * (30 + event_id % 111)) {{idiv}} 100 + 0.25 * (event_id % 4)) * case when user_id % 2 = 0 then -1 else 1 end end as median_svlen, case when event_id % 18 = 4 then {_LEN} + 0.5 end as size, "
        "case when event_id % 6 <> 0 then event_id % 45 end as support, case event_id % 4 when 0 then 'SA' when 1 then ' SOFTCLIP' when 2 then 'MIXED_EXTRA' else 'nan' end as source, event_id as extra_ordinal",
    ),
    "predictions": (
        "events",
        f"concat('P', cast(event_id as string)) as candidate_id, {_CHROM} as chrom, {{sec}} as start, {{sec}} + case when user_id % 2 = 0 then {_LEN} else 1 end as end_, {_TYPE} as svtype, "
        f"{_LEN} as median_svlen, event_id % 17 as support_read_count, cast(case when event_id % 3 = 0 then 1 else 0 end as int) as label, cast((event_id * 37) % 1000 as double) / 1000 as gnn_prob, "
        "cast(case when (event_id * 41) % 1000 >= 500 then 1 else 0 end as int) as gnn_pred, "
        "case event_id % 4 when 0 then 'CIGAR_EXTRA' when 1 then 'CIGAR_ONLY' when 2 then 'EXTRA_ONLY' else null end as candidate_source, event_id as ordinal",
    ),
    "raw_predictions": (
        "events",
        f"concat('P', cast(event_id as string)) as candidate_id, {_CHROM} as chrom, case when event_id % 19 <> 3 then {{sec}} end as start, case when event_id % 23 <> 5 then {{sec}} + case when user_id % 2 = 0 then {_LEN} else 1 end end as end_, "
        f"case when event_id % 31 = 0 then lower({_TYPE}) else {_TYPE} end as svtype, case when event_id % 9 = 4 then null when event_id % 9 = 5 then 0.0 else {_LEN} + 0.25 * (event_id % 4) end as median_svlen, "
        "case when event_id % 10 <> 0 then event_id % 17 end as support_read_count, case when event_id % 37 <> 0 then cast((event_id * 37) % 1000 as double) / 1000 end as gnn_prob, "
        "cast(case when event_id % 41 = 0 then null when (event_id * 41) % 1000 >= 500 then 1 else 0 end as int) as gnn_pred",
    ),
    "extra": (
        "events",
        f"event_id as extra_index, concat('r', cast(user_id as string)) as read_name, case event_id % 4 when 0 then 'SOFTCLIP_LEFT' when 1 then 'SOFTCLIP_RIGHT' when 2 then 'SA_CONNECTION' else 'SUPPLEMENTARY' end as evidence_type, "
        f"{_CHROM} as src_chrom, {{sec}} as src_start, {{sec}} + 200 + event_id % 300 as src_end, case when event_id % 2 = 0 then '+' else '-' end as src_strand, "
        f"case when event_id % 4 <> 2 then null when event_id % 5 = 0 then 'chr2' else {_CHROM} end as dst_chrom, "
        "case when event_id % 4 = 2 then case when event_id % 3 = 0 then {sec} - 900 + event_id % 500 else {sec} + 200 + event_id % 300 + event_id % 400 end end as dst_start, "
        "case when event_id % 4 = 2 then case when event_id % 3 = 0 then {sec} - 750 + event_id % 500 else {sec} + 350 + event_id % 300 + event_id % 400 end end as dst_end, "
        "{sec} as event_pos, case when event_id % 4 = 2 then event_id % 600 else event_id % 120 end as event_len, event_id % 61 as mapq, "
        f"cast(case when event_id % 4 = 2 and event_id % 5 = 0 and {_CHROM} <> 'chr2' then 1 else 0 end as int) as chrom_change, cast(case when event_id % 4 = 2 and event_id % 11 = 0 then 1 else 0 end as int) as orientation_change, "
        "cast(case when event_id % 4 = 3 then 1 else 0 end as int) as is_supplementary, cast(case when event_id % 4 = 2 then 1 else 0 end as int) as has_sa, event_id % 130 as softclip_left, event_id % 140 as softclip_right",
    ),
    "alignments": (
        "lineitem",
        "l_orderkey * 8 + l_linenumber as record_ordinal, concat('q', cast(l_orderkey as string), '_', cast(l_linenumber as string)) as qname, "
        "cast(case l_linenumber % 6 when 0 then 0 when 1 then 16 when 2 then 2048 when 3 then 256 when 4 then 4 else 2064 end as int) as flag, "
        "case l_returnflag when 'A' then 'chr1' when 'N' then 'chr2' else 'chrX' end as rname, l_partkey * 7 + l_suppkey as pos, cast(l_quantity as bigint) as mapq, "
        "concat(case when l_linenumber % 3 = 0 then concat(cast(40 + cast(l_quantity as bigint) as string), 'S') else '' end, '100M', cast(20 + cast(l_quantity as bigint) as string), 'D50=', "
        "cast(30 + l_suppkey % 60 as string), 'I80X', case when l_partkey % 5 = 0 then '70N10M' else '' end, case when l_linenumber % 2 = 0 then concat(cast(30 + cast(l_quantity as bigint) as string), 'S') else '' end) as cigar, "
        "100 + l_partkey % 50 as seq_len, case when l_orderkey % 4 = 0 then concat('chr2,', cast(l_partkey * 5 + 1 as string), case when l_suppkey % 2 = 0 then ',+,' else ',-,' end, '80M70S20D,55,3;chr9,bad;chr1,', cast(l_suppkey as string), ',+,30M,x,7;') end as sa, "
        "l_suppkey % 9 as nm",
    ),
}
_SPARK = {"sec": "timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)", "idiv": "div", "arr": "array(", "end": ")", "none": "cast(array() as array<bigint>)"}
_DUCK = {"sec": "date_diff('second', timestamp '2024-01-01 00:00:00', ts)", "idiv": "//", "arr": "[", "end": "]", "none": "[]::bigint[]"}

#: Common table expressions for DuckDB, by adapter.
SQL = {name: f"{name} as (select {cols.format(**_DUCK).replace('as end_', 'as end_pos')} from {source})" for name, (source, cols) in _SELECTS.items()}


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table over the driver's tables."""
    source, cols = _SELECTS[name]
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    view = f"_breakweave_{name}_source"
    rows.createOrReplaceTempView(view)
    out = spark.sql(f"select {cols.format(**_SPARK)} from {view}")
    out = out.withColumns({c: out[c].cast("double") for c, k in out.dtypes if k.startswith("decimal")})
    out = out.withColumns({c: out[c].cast("bigint") for c, k in out.dtypes if k == "int" and c not in ("flag", "label", "gnn_pred", "is_supplementary", "has_sa", "chrom_change", "orientation_change")})
    return out.withColumnRenamed("end_", "end")
