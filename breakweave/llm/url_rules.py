"""URL filters by a sort-merge range join.

A canonical key is the host with its labels reversed, a separator, and the path. A rule (host, path) covers the keys
that begin with its own key, an interval of the sorted keys; intervals are nested or disjoint. A url has one key for
each host suffix that some rule could name, because a rule fits all subdomains. Keys are range-partitioned together
with the row number, so one hot host or url spreads over many tasks, and sorted; a sweep merges them with the sorted
rules and keeps the stack of rules whose intervals are open. The longest rule over all keys of a url wins.

Rules travel to the tasks in blocks of at most ``RULES``; a longer list takes one sweep for each block.

Defined results: a null url or one without '://' has empty host and path and no rule; repeated rows are judged one by
one; of two rules alike the blocking one counts; an empty table gives an empty table; without a rule the verdict is
``default``; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Most rules in one sweep.
RULES = 100_000
_SEP = "\x01"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def key(self) -> str:
        return ".".join(reversed(self.host.split("."))) + _SEP + self.path

    @property
    def rank(self) -> tuple:
        return (len(self.name), len(self.host), self.verdict == "block")


#: The rules of the registered query.
QUERY_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_and_path(url):
    """Two columns: A-Z lower-cased host, and path up to query or fragment."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def sweep(rules: list[Rule]):
    """A mapInArrow function over rows sorted by key: adds length and index of the innermost open rule, or -1."""
    order = sorted(range(len(rules)), key=lambda i: (rules[i].key, rules[i].verdict == "block"))
    keys = [rules[i].key for i in order]

    def run(batches):
        at, open_ = 0, []
        first = True
        for batch in batches:
            best = []
            for key in batch.column(batch.schema.get_field_index("key")).to_pylist():
                if key is None:
                    best.append(-1)
                    continue
                if first:
                    # rules before the first key of this partition: only its own prefixes are still open
                    at, first = bisect_right(keys, key), False
                    open_ = [i for i in range(at) if key.startswith(keys[i])] if at else []
                while at < len(keys) and keys[at] <= key:
                    while open_ and not keys[at].startswith(keys[open_[-1]]):
                        open_.pop()
                    open_.append(at)
                    at += 1
                while open_ and not key.startswith(keys[open_[-1]]):
                    open_.pop()
                best.append(order[open_[-1]] if open_ else -1)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(best, pa.int32())], ["row", "page_id", "host", "path", "rule_no"])

    return run


def judge(pages: DataFrame, rules: tuple[Rule, ...] = QUERY_RULES, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    ship(pages.sparkSession)
    host, path = host_and_path(F.col(url).cast("string"))
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    ranked = sorted(rules, key=lambda r: r.rank)
    if not ranked:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = max(r.host.count(".") + 1 for r in ranked)
    parts = F.reverse(F.split("host", r"\."))
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "."), F.lit(_SEP), F.col("path")))
    keyed = base.withColumn("key", F.explode_outer(F.when(F.col("host") != "", levels))).select("row", "page_id", "host", "path", "key")
    keyed = keyed.repartitionByRange("key", "row").sortWithinPartitions("key")
    found = None
    for first in range(0, len(ranked), RULES):
        own = keyed.mapInArrow(sweep(ranked[first : first + RULES]), "row long, page_id long, host string, path string, rule_no int")
        own = own.withColumn("rule_no", F.when(F.col("rule_no") >= 0, F.col("rule_no") + first).otherwise(-1))
        found = own if found is None else found.unionByName(own)
    # rules are numbered by rank, so the largest number is the longest rule
    best = found.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("rule_no").alias("no"))
    if len(ranked) <= 200:
        # get() gives null for -1; element_at with a null index reads stale values in generated code
        name, verdict = (F.get(F.array(*[F.lit(x) for x in xs]), F.col("no").cast("int")) for xs in ([r.name for r in ranked], [r.verdict for r in ranked]))
        return best.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
    names = pages.sparkSession.createDataFrame([(i, r.name, r.verdict) for i, r in enumerate(ranked)], "no int, rule string, rule_verdict string")
    return best.join(names, "no", "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


SQL = r"""
with rules(v, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts as (
  select page_id, row_number() over () as r,
    case when instr(coalesce(url, ''), '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, r, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), fits as (
  select s.*, h || p as rule, v, row_number() over (partition by r order by length(h || p) desc nulls last) as k
  from split s left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from fits where k = 1
"""
