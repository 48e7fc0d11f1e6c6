"""Delta-maintained token totals by source, language and tokenizer version.

A store is a folder. Each batch of signed events (insert, delete, revise) is summed by its keys, written to a folder
of its own, and becomes visible when its marker appears; the marker's name follows from the batch id, so a batch
counts once however often it is committed or retried. A marker is written under another name and renamed, so it is
whole or absent; what can't be read all the same is no marker.

Compaction folds the newest base and the visible batches into the base of the next generation, whose name follows from
its number: of two compactions at a time one makes it and the other is dropped. A base keeps the ids of all its
batches in a table, so later commits of them are known; only then their own markers go. Readers take the newest base
and the batches that are not in it, so every moment between these steps gives the same totals. ``vacuum`` deletes
data that no marker names.

Events: doc_id, source, lang, tokenizer, op, n_tokens (count after an insert or revision), old_tokens (count before a
deletion or revision). A null source, language or tokenizer is a class of its own, shown as '(none)'; null counts are
0; unknown ops add nothing; repeated events within a batch are separate events; classes whose documents and tokens
are all gone drop out of the totals; an empty batch is a valid batch. Very long texts are counted as any others; the
ids of documents, repeated or null, don't matter here; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
_MARKER = "batch string, generation long, data string"


def signed(events: DataFrame) -> DataFrame:
    """Additive totals of a batch: source, lang, tokenizer, docs, tokens."""
    new, old, op = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0)), F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    tokens = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old).otherwise(0)
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("(none)")).alias(k) for k in KEYS]
    return events.groupBy(*keys).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class TokenStore:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri() if "://" in self.root else self._fs.getUri(), conf)

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def _exists(self, at: str) -> bool:
        return self._fs.exists(self._path(at))

    def _create(self, at: str, marker: dict) -> bool:
        """Makes a marker appear at once and whole; false if there is one of that name."""
        if self._exists(at) and self._read([at]):
            return False
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        self._fs.mkdirs(self._path(at).getParent())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        # a name that is taken by a torn marker, as file systems without rename may leave, is free
        how[0] = rename.OVERWRITE if self._exists(at) and not self._read([at]) else rename.NONE
        try:
            self._files.rename(self._path(draft), self._path(at), how)
        except Exception:
            if not self._exists(at):
                raise
            self._fs.delete(self._path(draft), False)
            return False
        return True

    def _list(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(f.getPath().toString() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _read(self, paths: list[str]) -> list:
        """The readable markers among these files, read in tasks; as many as there were batches since the last compaction."""
        if not paths:
            return []
        rows = self.spark.read.schema("value string").text(paths, wholetext=True).select(F.from_json("value", _MARKER).alias("m")).select("m.*")
        return rows.where("data is not null").collect()

    def _marker(self, batch_id: str) -> str:
        return f"{self.root}/commits/{hashlib.sha256(batch_id.encode()).hexdigest()}.json"

    def _base(self):
        """The marker of the newest readable base, or None."""
        for path in reversed(self._list("bases")):
            found = self._read([path])
            if found:
                return found[0]
        return None

    def _ids(self, base) -> DataFrame:
        """Ids of the batches that a base holds."""
        return self.spark.read.schema("batch string").parquet(f"{base.data}/ids") if base else self.spark.createDataFrame([], "batch string")

    def _live(self, base) -> list:
        """Markers of the batches that count beside the base."""
        found = self._read(self._list("commits"))
        if not found or not base:
            return found
        held = {r.batch for r in self._ids(base).where(F.col("batch").isin([m.batch for m in found])).collect()}
        return [m for m in found if m.batch not in held]

    def committed(self) -> DataFrame:
        """Ids of all batches that count (column ``batch``), compacted ones too."""
        live, base = self._read(self._list("commits")), self._base()
        return self._ids(base).unionByName(self.spark.createDataFrame([(m.batch,) for m in live], "batch string")).distinct()

    def _counts(self, batch_id: str) -> bool:
        # the marker first: it goes only after a base that holds the batch is there
        if self._exists(self._marker(batch_id)) and self._read([self._marker(batch_id)]):
            return True
        return not self._ids(self._base()).where(F.col("batch") == batch_id).isEmpty()

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Adds a batch; false, and no change, if the id was committed before."""
        if self._counts(batch_id):
            return False
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        signed(events).coalesce(1).write.parquet(f"{at}/sums")
        return self._create(self._marker(batch_id), {"batch": batch_id, "generation": 0, "data": at})

    def _sums(self, base, live: list) -> DataFrame:
        at = [f"{m.data}/sums" for m in ([base] if base else []) + live]
        rows = self.spark.read.schema(_SCHEMA).parquet(*at) if at else self.spark.createDataFrame([], _SCHEMA)
        out = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens."""
        # markers first: a batch that a later base holds is left out by its id
        found = self._read(self._list("commits"))
        base = self._base()
        held = {r.batch for r in self._ids(base).where(F.col("batch").isin([m.batch for m in found])).collect()} if found and base else set()
        return self._sums(base, [m for m in found if m.batch not in held]).withColumnsRenamed({"docs": "n_docs", "tokens": "n_tokens"})

    def prepare_compaction(self) -> dict | None:
        """Writes the data of the next base; it counts once ``finish_compaction`` makes its marker."""
        base = self._base()
        live = self._live(base)
        if len(live) + bool(base) < 2:
            return None
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        self._sums(base, live).coalesce(1).write.parquet(f"{at}/sums")
        self._ids(base).unionByName(self.spark.createDataFrame([(m.batch,) for m in live], "batch string")).coalesce(1).write.parquet(f"{at}/ids")
        return {"batch": "", "generation": (base.generation if base else 0) + 1, "data": at}

    def finish_compaction(self, prepared: dict | None) -> bool:
        """Makes the prepared base count, unless another one of its generation does; then the markers it replaces go."""
        if prepared is None:
            return False
        if not self._create(f"{self.root}/bases/{prepared['generation']:012d}.json", prepared):
            self._fs.delete(self._path(prepared["data"]), True)
            return False
        for row in self._ids(self._base()).toLocalIterator():
            self._fs.delete(self._path(self._marker(row.batch)), False)
        return True

    def compact(self) -> bool:
        """Folds the newest base and the visible batches into one; ids stay known. False if there was nothing to do or another was first."""
        return self.finish_compaction(self.prepare_compaction())

    def vacuum(self) -> int:
        """Deletes data and bases that don't count any more; not while others read or commit. Returns how many folders went."""
        base = self._base()
        used = {m.data.rsplit("/", 1)[-1] for m in ([base] if base else []) + self._live(base)}
        gone = [p for p in self._list("data") if p.rsplit("/", 1)[-1] not in used]
        old = [p for p in self._list("bases") if base and not p.endswith(f"/{base.generation:012d}.json")]
        for path in gone + old + self._list("drafts"):
            self._fs.delete(self._path(path), True)
        return len(gone)


def _runs(text, pattern: str):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """Two tokenizer versions' counts of each document, and a revised count of the first."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang",
        _runs(text, r"[^\x20\x09-\x0D]+").alias("words_1"), _runs(text, r"[A-Za-z]+|[0-9]").alias("pieces_2"), _runs(text, r"[A-Za-z0-9]+").alias("revised"),
    )


def token_counts(docs: DataFrame, path: str, tokenizer: str, op: str = "insert") -> DataFrame:
    """Events with the counts of a real tokenizer file, by the chunk-reusing encoder."""
    from .bpe_chunks import encoded_digests

    n = encoded_digests(docs.select("doc_id", "text"), path).select("doc_id", "n_tokens").groupBy("doc_id").agg(F.max("n_tokens").alias("_n"))
    own = docs.select("doc_id", "source", "lang").join(n, "doc_id")
    new, old = (F.col("_n"), F.lit(None).cast("long")) if op == "insert" else (F.lit(None).cast("long"), F.col("_n"))
    return own.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), new.alias("n_tokens"), old.alias("old_tokens"))


def rollup_of(docs: DataFrame) -> DataFrame:
    """Totals after five commits over ``docs``: inserts for two tokenizer versions, deletions of every id that ends in 3,
    revised counts of every id that ends in 7, and the deletions once more, which changes nothing."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-rollup")
    rows = scratch.put("counted", counted(docs))
    store = TokenStore(spark, f"{scratch.at}/store")
    none = F.lit(None).cast("long")

    def events(part, op, tokenizer, new, old):
        return part.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), new.alias("n_tokens"), old.alias("old_tokens"))

    ends = F.pmod("doc_id", F.lit(10))
    gone = rows.where(ends == 3)
    gone = events(gone, "delete", "words-1", none, F.col("words_1")).unionByName(events(gone, "delete", "pieces-2", none, F.col("pieces_2")))
    store.commit("inserts-1", events(rows, "insert", "words-1", F.col("words_1"), none))
    store.commit("inserts-2", events(rows, "insert", "pieces-2", F.col("pieces_2"), none))
    store.commit("deletes", gone)
    store.commit("revised", events(rows.where(ends == 7), "revise", "words-1", F.col("revised"), F.col("words_1")))
    store.commit("deletes", gone)
    store.compact()
    return store.totals()


SQL = r"""
with c as (
  select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, ((doc_id % 10) + 10) % 10 as k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]')) as p,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) as r from documents
), kept as (select * from c where k is distinct from 3)
select source, lang, tokenizer, count(*) as n_docs, sum(tokens)::bigint as n_tokens from (
  select source, lang, 'words-1' as tokenizer, case when k = 7 then r else w end as tokens from kept
  union all select source, lang, 'pieces-2', p from kept
) group by all
"""
