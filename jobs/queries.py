"""Both jobs as registered queries: each runs its function twice into one new folder and returns the output as it stands then."""

from __future__ import annotations

import json
import uuid

from breakweave.plans.adapters import SQL as TABLES
from breakweave.plans.queries import _CANDS
from breakweave.sources.stages import shared_folder
from pyspark.sql import functions as F

from . import candidate_refresh, threshold_report


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_candidate_refresh(spark, sf_dir):
    at, config = _folder(spark, "job1"), json.loads(candidate_refresh.CONFIG.read_text())
    for _ in range(2):
        out = candidate_refresh.run(spark, f"{sf_dir}/events.parquet", f"{at}/out", f"{at}/checkpoint", config)
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("read_names", "signal_indices")})


def job2_threshold_report(spark, sf_dir):
    at, config = _folder(spark, "job2"), json.loads(threshold_report.CONFIG.read_text())
    for _ in range(2):
        out = threshold_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{at}/out", config)
    return out


_THRESHOLDS = ", ".join(f"({i}, {round(0.05 * i, 2)!r}::double)" for i in range(1, 20))
QUERIES = {"job1_candidate_refresh": job1_candidate_refresh, "job2_threshold_report": job2_threshold_report}
SQL = {
    "job1_candidate_refresh": f"""with recursive {TABLES["raw_signals"]}, {_CANDS} select concat_ws(':', chrom, svtype, cluster::varchar) as candidate_id, start,
  start + case when svtype = 'DEL' then median_svlen else 1 end as "end", svtype, median_svlen, len(read_names)::bigint as support_read_count, mean_mapq, std_pos, std_svlen,
  array_to_string(read_names, ',') as read_names, array_to_string(signal_indices, ',') as signal_indices, chrom, start // 250000 as region from c""",
    "job2_threshold_report": f"""with s as (
  select doc_id, coalesce(source, '(none)') as source, coalesce(0.5 * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text)
    + 0.5 * len(list_distinct(string_split_regex(text, '[ \\n]+'))) / len(string_split_regex(text, '[ \\n]+')), 0.0)::double as score from documents),
l as (select doc_id, max(quality) as label from labels group by doc_id),
j as (select s.*, label from s left join l using (doc_id)),
t(k, t) as (values {_THRESHOLDS}),
c as (select source, k, t, count(*) filter (label = 1 and score >= t) as tp, count(*) filter (label = 0 and score >= t) as fp, count(*) filter (label = 1 and score < t) as fn from j, t where label in (0, 1) group by all),
p as (select *, coalesce(tp::double / nullif(tp + fp, 0), 0) as p, coalesce(tp::double / nullif(tp + fn, 0), 0) as r from c),
e as (select *, coalesce(2 * p * r / nullif(p + r, 0), 0) as f from p),
b as (select source, t from (select *, row_number() over (partition by source order by f desc, r desc, p desc, k) as n from e) where n = 1)
select doc_id, source, score, label, coalesce(t, 0.5) as threshold, score >= coalesce(t, 0.5) as kept from j left join b using (source)""",
}
