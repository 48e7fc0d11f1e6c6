"""Aligns the tokens of two tokenizers by the bytes that they cover, as relations of passages and documents.

A byte-level BPE (A) and a piece vocabulary (B) cut the same bytes, a space and the text, into tokens. Offsets where a
token of each ends cut both sequences into groups, and all A-B token pairs of a group are linked.

The tokens are those of passages, not of occurrences. A text is cut before every single space or line feed between two
characters that are no white space: the pattern of A starts anew there, and no piece of B reaches over it, which is read
from both vocabularies and never assumed (where it doesn't hold, whole texts are passages). So both tokenizers give the
text's tokens passage by passage, both have a token's end at each cut, and groups never reach over one. Work on tokens
then follows the number of distinct passages, which grows slower than the corpus.

Distinct passages are encoded; their tokens are exploded with positions; windowed sums of lengths give ends; an
equi-join on passage and end gives the cuts, whose running number is the group; each cut and the one before it span the
tokens of a group, and a group's two sides make its links, counted by id where a group is large. Documents meet their
passages in a join: the ``HOT`` most frequent short ones by broadcast, all others by shuffle. Arrow batches put a document's
groups together from its passages. How many documents hold a pair follows from each document's distinct pairs.

Defined results: texts that are null, empty or not given back byte for byte by the tokens of A or B have no tokens: zeros
and an empty digest, and their links are not counted; special tokens' strings are plain text; repeated rows and repeated
or null ids are documents of their own; an empty table gives an empty table; a very long text without cuts is one passage
whose tokens are rows; ties for an A id's highest count are all best; other columns, clashing names too, are ignored.
Rows must come in the same order when ``docs`` is read again, as those of files do: write the result of a shuffle as a
table first.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

#: Passages that are broadcast at most, and the bytes of one, of its groups' text, and the pairs it may have for that.
HOT, HOT_BYTES, HOT_TEXT, HOT_PAIRS = 500_000, 64, 256, 32
#: Links of a passage up to which its pairs are listed in its row, and of a group up to which ids need not be counted first.
LISTED, SMALL = 256, 64
#: Text bytes that a task puts together at a time, and pairs of ids whose counts are broadcast at most.
TASK_BYTES, BROADCAST_PAIRS = 8 << 20, 1_000_000
#: Counts of a passage or document.
_SUMS = ("n_a", "n_b", "n_groups", "n_links")
#: Where every tokenizer with the properties that ``cuts_hold`` asks for starts anew.
CUT = r"(?<=[\p{L}\p{N}\p{P}\p{S}])(?=[ \n][\p{L}\p{N}\p{P}\p{S}])"
#: The byte-level pattern's alternatives, as the library names them, all end before white space that follows other characters.
_LOADED: dict[tuple[str, str], tuple] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def load(path_a: str, path_b: str) -> tuple:
    """Both tokenizers, the bytes of A's tokens by id, and of B's."""
    if (path_a, path_b) not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        a.encode_special_tokens = True
        a.no_truncation()
        a.no_padding()
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256 and on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))}
        a_bytes = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
        _LOADED[path_a, path_b] = (a, b, a_bytes, b_bytes)
    return _LOADED[path_a, path_b]


def cuts_hold(path_a: str, path_b: str) -> bool:
    """Whether both tokenizers start anew at every ``CUT``."""
    import json

    a, b, _, _ = load(path_a, path_b)
    told = json.loads(a.to_str())
    split = told["pre_tokenizer"] or {}
    a_holds = told["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space")
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    alone = all("\n" not in p and "▁" not in p.lstrip("▁") for p in pieces)
    probe = "  éé ﬁ\n\n　x  "  # not normalised, white space kept
    return bool(a_holds and alone and b"".join(load(path_a, path_b)[3][i] for i in b.encode(probe)) == (" " + probe).encode())


def _encode(batches, paths: tuple[str, str]):
    """Tokens of passages with their lengths, and whether their bytes are the passage's."""
    a, b, a_bytes, b_bytes = load(*paths)
    a_all = [a_bytes.get(i, b"") for i in range(max(a.get_vocab(with_added_tokens=True).values()) + 1)]
    a_of, b_of = a_all.__getitem__, b_bytes.__getitem__
    a_len, b_len = (np.array([len(t) for t in x], np.int16) for x in (a_all, b_bytes))
    fast = getattr(a, "encode_batch_fast", a.encode_batch)  # no offsets

    def side(ids: list[list[int]], lens: np.ndarray) -> list[pa.Array]:
        ids = pa.array(ids, pa.list_(pa.int32()))
        return [ids, pa.ListArray.from_arrays(ids.offsets, pa.array(lens[ids.values.to_numpy(zero_copy_only=False)], pa.int16()))]

    for batch in batches:
        texts = batch.column(1).to_pylist()
        raw = [t.encode() for t in texts]
        ia = [e.ids for e in fast(texts, add_special_tokens=False)]
        # B puts a space before what it is given: a passage's own, or one that is taken off again
        ib = b.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        ib = [x if t[:1] == " " else x[1:] for x, t in zip(ib, texts, strict=True)]
        ok = [b"".join(map(a_of, x)) == r and b"".join(map(b_of, y)) == r for x, y, r in zip(ia, ib, raw, strict=True)]
        out = [pa.array(ok), *side(ia, a_len), *side(ib, b_len)]
        told = pa.StructArray.from_arrays([batch.column(1), batch.column(2), *out], ["passage", "n", "ok", "a", "a_len", "b", "b_len"])
        yield pa.RecordBatch.from_arrays([batch.column(0), told], ["sid", "x"])


@contextlib.contextmanager
def _settings(spark: SparkSession, **values: str):
    """Settings for what is written inside."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def align_passages(encoded: DataFrame, base: int, listed: int = LISTED) -> DataFrame:
    """Encoded passages (sid, x) that both tokenizers give back, with n_a, n_b, n_groups, n_links, groups (text), pairs (array of k,
    m; a pair may repeat), or, with more than ``listed`` links, parts (array of the groups' ids a, b) instead of pairs."""
    by, dealt = Window.partitionBy("sid"), encoded.where("x.ok").repartition("sid")

    def ends(side: str) -> DataFrame:
        rows = dealt.select("sid", F.posexplode(f"x.{side}_len").alias(f"{side}_pos", "len"))
        return rows.select("sid", f"{side}_pos", F.sum("len").over(by.orderBy(f"{side}_pos").rowsBetween(Window.unboundedPreceding, 0)).alias("end"))

    order = by.orderBy("end")
    cuts = ends("a").join(ends("b"), ["sid", "end"])
    # the running number of cuts is the group; the cut before it is where its tokens begin
    froms = [F.coalesce(F.lag(f"{s}_pos").over(order) + 1, F.lit(0)).alias(f"{s}_from") for s in "ab"]
    groups = cuts.select("sid", F.row_number().over(order).alias("g"), "a_pos", "b_pos", *froms)
    spans = groups.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("g", "a_from", "a_pos", "b_from", "b_pos"))).alias("spans"))
    cut = lambda s: lambda x: F.slice(F.col(s), x[f"{s}_from"] + 1, x[f"{s}_pos"] - x[f"{s}_from"] + 1)
    parts = F.transform("spans", lambda x: F.struct(cut("a")(x).alias("a"), cut("b")(x).alias("b")))
    out = dealt.join(spans, "sid").select("sid", "x.*", "spans").withColumn("parts", parts).drop("spans")
    text = lambda ids: F.array_join(ids.cast("array<string>"), ",")
    links = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.size(x["a"]).cast("long") * F.size(x["b"]))
    key = lambda x: F.flatten(F.transform(x["a"], lambda i: F.transform(x["b"], lambda j: F.struct((i.cast("long") * base + j).alias("k"), F.lit(1).cast("long").alias("m")))))
    out = out.select(
        "sid", "passage", "n", "ok", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.size("parts").cast("long").alias("n_groups"),
        links.alias("n_links"), F.array_join(F.transform("parts", lambda x: F.concat_ws("|", text(x["a"]), text(x["b"]))), ";").alias("groups"), "parts",
    )
    few = F.col("n_links") <= listed
    return out.select("*", F.when(few, F.flatten(F.transform("parts", key))).alias("pairs")).withColumn("parts", F.when(~few, F.col("parts")))


def counted_pairs(passages: DataFrame, base: int, small: int = SMALL) -> DataFrame:
    """sid, k, m of the passages with many links: ids of a large group are counted before they are paired."""
    groups = passages.where("parts is not null").select("sid", F.posexplode("parts").alias("g", "x")).select("sid", "g", "x.a", "x.b")
    size = F.size("a").cast("long") * F.size("b")
    listed = groups.where(size <= small).select("sid", F.explode("a").alias("a"), "b").select("sid", "a", F.explode("b").alias("b"), F.lit(1).cast("long").alias("m"))
    sides = [groups.where(size > small).select("sid", "g", F.explode(s).alias(s)).groupBy("sid", "g", s).agg(F.count(F.lit(1)).alias(f"n_{s}")) for s in "ab"]
    large = sides[0].join(sides[1], ["sid", "g"]).select("sid", "a", "b", (F.col("n_a") * F.col("n_b")).alias("m"))
    return listed.unionByName(large).groupBy("sid", (F.col("a").cast("long") * base + F.col("b")).alias("k")).agg(F.sum("m").alias("m"))


@dataclass
class _Hot:
    """The hot passages by their numbers: groups' texts, sums, and pairs, those of passage i at start[i] to start[i + 1]."""

    groups: pa.Array
    sums: np.ndarray
    keys: np.ndarray
    start: np.ndarray


def _table(top: DataFrame) -> _Hot:
    """Number 0 is no passage."""
    rows = top.orderBy("place").select(*_SUMS, "groups", "keys").toArrow().combine_chunks()
    one = lambda c: pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], rows.schema.field(c).type)
    keys = one("keys")
    sums = np.stack([one(c).to_numpy(zero_copy_only=False) for c in _SUMS], axis=1).reshape(-1, 4).astype(np.int64)
    size = keys.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return _Hot(one("groups"), np.concatenate([np.zeros((1, 4), np.int64), sums]), keys.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0, 0], np.cumsum(size)]).astype(np.int64))


#: Passages of documents that are put together at a time; a longer document is by itself.
PIECE = 1 << 16


def _numbers(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of passages' groups as text: each group's passage, its number of A and B ids, all A ids and all B ids, both by group."""
    raw = np.frombuffer((";".join(texts) + ";").encode(), np.uint8) if texts else np.zeros(0, np.uint8)
    stop = np.flatnonzero((raw < 48) | (raw > 57))
    size, ids = np.diff(stop, prepend=-1) - 1, np.zeros(len(stop), np.int64)
    for d in range(int(size.max(initial=0))):
        has = size > d
        ids[has] += (raw[stop[has] - 1 - d].astype(np.int64) - 48) * 10**d
    ends, bars = raw[stop] == ord(";"), raw[stop] == ord("|")
    group = np.cumsum(ends) - ends
    is_b = (np.cumsum(bars) - bars - group).astype(bool)  # a group's bar lies behind
    n = int(ends.sum())
    last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return np.searchsorted(last, stop[ends]), np.bincount(group[~is_b], minlength=n), np.bincount(group[is_b], minlength=n), ids[~is_b], ids[is_b]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``size`` of them, one span after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def _lists(size: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, kind))


def _piece(batch: pa.RecordBatch, hot: _Hot, told: np.ndarray, base: int, kind) -> list[pa.Array]:
    n, places, rares = batch.num_rows, batch.column(2), batch.column(3)
    count = lambda x: x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    size, own, n_rare, rare = count(places), places.flatten().to_numpy(zero_copy_only=False), count(rares), rares.flatten()
    start, doc, rare_doc = np.cumsum(size) - size, np.repeat(np.arange(n), size), np.repeat(np.arange(n), n_rare)
    groups, listed, sid = rare.field("groups").to_pylist(), rare.field("own"), rare.field("place").to_numpy(zero_copy_only=False)
    known = np.array([g is not None for g in groups], bool)
    texts = told[own]
    texts[start[rare_doc] + rare.field("pos").to_numpy(zero_copy_only=False)] = groups
    valid = size > 0
    valid[rare_doc[~known]] = False
    alone = np.flatnonzero(valid & (size == 1))
    valid[alone] = [bool(t) for t in texts[start[alone]]]
    total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(hot.sums[own], axis=0)])
    sums = total[start + size] - total[start]
    # rare passages: their ids from the text of their groups
    passage, n_a, n_b, a, b = _numbers([g for g in groups if g is not None])
    n_own = count(listed)
    paired, of = (n_own == 0)[known][passage], rare_doc[known][passage]
    for i, x in enumerate((n_a, n_b, np.ones_like(n_a), n_a * n_b)):
        sums[:, i] += np.bincount(of, x, n).astype(np.int64)
    meets = np.repeat(np.where(paired, n_b, 0), n_a)
    first_b = np.repeat(np.cumsum(n_b) - n_b, n_a)
    more = np.repeat(a, meets) * base + b[_spans(first_b, meets)]
    # hot passages, each once in a document
    seen = np.unique(doc * len(hot.start) + own)
    seen_doc, seen = seen // len(hot.start), seen % len(hot.start)
    n_keys = hot.start[seen + 1] - hot.start[seen]
    keys = np.concatenate([hot.keys[_spans(hot.start[seen], n_keys)].astype(np.int64), more, listed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)])
    key_doc = np.concatenate([np.repeat(seen_doc, n_keys), np.repeat(np.repeat(of, n_a), meets), np.repeat(rare_doc, n_own)])
    shift = int(keys.max(initial=0)).bit_length()
    both = np.unique((key_doc << shift | keys)[valid[key_doc]])
    text, ends = texts.tolist(), (start + size).tolist()
    digests = [hashlib.sha256(";".join(text[i:j]).encode()).hexdigest() if v else "" for v, i, j in zip(valid.tolist(), start.tolist(), ends, strict=True)]
    sums[~valid] = 0
    out = [pa.array(valid), *[pa.array(sums[:, i]) for i in range(4)], pa.array(digests, pa.string())]
    keys = both & ((1 << shift) - 1)
    keys = _lists(np.bincount(both >> shift, minlength=n), keys.astype(np.int32) if kind == pa.int32() else keys, kind)
    return [*out, keys, _lists(np.where(valid, n_rare, 0), sid[valid[rare_doc]].astype(np.int64), pa.int64())]


def _put_together(batches, table, base: int, narrow: str):
    """Documents from their passages in order: sums, the digest of all groups, distinct pairs, and the rare passages."""
    hot, kind = table.value, pa.int32() if narrow == "int" else pa.int64()
    told = np.array(["", *hot.groups.to_pylist()], object)
    names = ["row", "doc_id", "valid", *_SUMS, "groups_sha256", "keys", "rare"]
    for batch in batches:
        total, first = np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + PIECE, "right")))
            piece = batch.slice(first, last - first)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *_piece(piece, hot, told, base, kind)], names)
            first = last


@dataclass
class Alignment:
    """documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. passages: passage, n, ok,
    n_a, n_b, n_groups, n_links, groups. pairs: a, b, documents, is_best. Tables in the shared folder."""

    documents: DataFrame
    passages: DataFrame
    pairs: DataFrame


#: One row per document is put together in a hash table, which has as many entries as a task has documents.
_ROWWISE = {"spark__sql__objectHashAggregate__sortBased__fallbackThreshold": str(1 << 20)}
#: What a table's making has shuffled goes when it is written.
_CLEAN = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
#: Passages travel once, as one column, for all three uses, and are grouped as they are sorted.
_SORTED = {"spark__sql__optimizer__nestedSchemaPruning__enabled": "false", "spark__sql__requireAllClusterKeysForCoPartition": "false", "spark__sql__execution__useObjectHashAggregateExec": "false"}


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, listed: int = LISTED, small: int = SMALL) -> Alignment:
    """Aligns the tokens of all documents."""
    ship(docs.sparkSession)
    with _settings(docs.sparkSession, **_CLEAN):
        return _align(docs, path_a, path_b, doc_id, text, hot, listed, small)


def _align(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str, hot: int, listed: int, small: int) -> Alignment:
    spark = docs.sparkSession
    scratch, paths = Scratch(spark, "token-alignment"), (path_a, path_b)
    base = load(*paths)[1].get_piece_size()
    narrow = "int" if (max(load(*paths)[2]) + 1) * base < 1 << 31 else "long"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spaced = F.concat(F.lit(" "), F.col("text"))
    cut = F.when(F.col("text") != "", F.split(spaced, CUT) if cuts_hold(*paths) else F.array(spaced))
    found = rows.select(F.explode(cut).alias("passage")).groupBy("passage").agg(F.count(F.lit(1)).alias("n"))
    found = found.select(F.monotonically_increasing_id().alias("sid"), "passage", "n")
    ids, lens = "array<int>", "array<smallint>"
    encoded = scratch.put("encoded", found.mapInArrow(lambda x: _encode(x, paths), f"sid long, x struct<passage: string, n: long, ok: boolean, a: {ids}, a_len: {lens}, b: {ids}, b_len: {lens}>"), compression="zstd")
    with _settings(spark, **_SORTED):
        broken = encoded.where("not x.ok").select("sid", "x.passage", "x.n", "x.ok").withColumns({c: F.lit(0).cast("long") for c in _SUMS})
        known = scratch.put("passages", align_passages(encoded, base, listed).unionByName(broken, allowMissingColumns=True), compression="zstd")
    scratch.drop(encoded)
    short = (F.octet_length("passage") <= HOT_BYTES) & F.col("pairs").isNotNull() & (F.octet_length("groups") <= HOT_TEXT) & (F.size("pairs") <= HOT_PAIRS)
    # the least count above which no more than ``hot`` short passages lie: single counts up to 63, then powers of two
    least = [2**i for i in range(48)] if hot < HOT else [*range(1, 64), *[2**i for i in range(6, 48)]]
    bits = F.length(F.bin("n"))
    level = F.when(short, bits if hot < HOT else F.when(F.col("n") < 64, F.col("n")).otherwise(bits + 57).cast("int"))
    by_level = known.groupBy(F.coalesce(level, F.lit(0)).alias("level")).agg(F.sum(F.octet_length("passage") * F.col("n")).alias("bytes"), F.count(F.lit(1)).alias("n"), F.count("parts").alias("long")).collect()
    text_bytes, n_known, n_long = (sum(r[c] for r in by_level) for c in ("bytes", "n", "long"))
    above = [sum(r.n for r in by_level if r.level > i) for i in range(len(least))]
    at = next(i for i, n in enumerate(above) if n <= hot)
    is_hot = F.coalesce(short, F.lit(False)) & (F.col("n") >= least[at])
    has_rare = n_known > above[at]
    more = scratch.put("counted", counted_pairs(known, base, small)) if n_long else None
    keys = F.array_distinct(F.transform("pairs", lambda p: p["k"].cast(narrow)))
    # hot passages by falling count, so that the numbers that documents keep are mostly small; bounded by ``hot`` rows
    place = F.row_number().over(Window.orderBy(F.desc("n"), "sid"))
    top = scratch.put("hot", known.where(is_hot).withColumn("place", place).select("sid", "place", "passage", *[F.col(c).cast("int").alias(c) for c in _SUMS], "groups", keys.alias("keys")))
    dealt = rows.repartition(max(1, -(-text_bytes // TASK_BYTES)), "row").select("row", "doc_id", F.posexplode_outer(cut).alias("pos", "passage"))
    met = dealt.join(F.broadcast(top.select("passage", "place")), "passage", "left")
    # a document's passages in order: the number of a hot one, 0 for a rare one, which follows by its place and its bytes
    packed = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.coalesce("place", F.lit(0)).cast("long"))
    rest = F.when(F.col("place").isNull() & F.col("pos").isNotNull(), F.struct("pos", "passage"))
    met = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(packed)).alias("places"), F.collect_list(rest).alias("rest"))
    numbers = F.transform("places", lambda x: x.bitwiseAND((1 << 32) - 1).cast("int"))
    with _settings(spark, **_ROWWISE):
        met = scratch.put("met", met.select("row", "doc_id", numbers.alias("places"), "rest"), compression="zstd", **{"parquet.dictionary.page.size": str(16 << 20)})
    parts = max(1, -(-text_bytes // TASK_BYTES))
    # of a rare passage the text of its groups travels, null for a broken one, and its pairs only where they are many
    rare = known.where(~is_hot).select(F.col("sid").alias("place"), "passage", "groups")
    if more is not None:
        own = more.groupBy(F.col("sid").alias("place")).agg(F.collect_list("k").alias("own"))
        rare = rare.join(own, "place", "left")
    else:
        rare = rare.withColumn("own", F.lit(None).cast("array<long>"))
    missed = met.select("row", F.explode("rest").alias("x")).select("row", "x.pos", "x.passage").join(rare.hint("merge"), "passage")
    missed = missed.select("row", "pos", "place", "groups", "own").repartition(parts, "row").groupBy("row").agg(F.collect_list(F.struct("pos", "place", "groups", "own")).alias("rare"))
    both = met.select("row", "doc_id", "places").repartition(parts, "row").join(missed, "row", "left") if has_rare else met.select("row", "doc_id", "places", F.lit(None).cast("array<struct<pos:int,place:long,groups:string,own:array<long>>>").alias("rare"))
    # the table that all tasks hold: at most ``hot`` passages
    table = spark.sparkContext.broadcast(_table(top))
    schema = f"row long, doc_id long, valid boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<{narrow}>, rare array<long>"
    with _settings(spark, **_ROWWISE):
        put_together = both.mapInArrow(lambda batches: _put_together(batches, table, base, narrow), schema)
        per = scratch.put("documents", put_together, compression="zstd", **{"parquet.dictionary.page.size": str(16 << 20)})

    pairs = per.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("documents"))
    pairs = pairs.select(F.col("k").cast("long").alias("k"), F.floor(F.col("k") / base).cast("int").alias("a"), (F.col("k") % base).cast("int").alias("b"), "documents")
    pairs = scratch.put("pairs", pairs.withColumn("is_best", F.col("documents") == F.max("documents").over(Window.partitionBy("a"))))
    counts = pairs.select("k", "documents", "is_best")
    counts = F.broadcast(counts) if pairs.count() <= BROADCAST_PAIRS else counts.hint("merge")
    held = known.where("pairs is not null").select("sid", F.explode("pairs").alias("p")).select("sid", "p.k", "p.m")
    held = (held.unionByName(more.select("sid", "k", "m")) if more is not None else held).join(counts, "k")
    worth = held.groupBy("sid").agg(F.sum(F.when(F.col("is_best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("documents")).alias("count_sum"))
    worth = scratch.put("worth", worth)
    total = [F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")]
    of_hot = F.broadcast(worth.join(top.select("sid", "place"), "sid").drop("sid"))
    gains = met.select("row", F.explode("places").alias("place")).join(of_hot, "place").groupBy("row").agg(*total)
    if has_rare:
        of_rare = worth.join(top.select("sid"), "sid", "left_anti").withColumnRenamed("sid", "place")
        gains = gains.unionByName(per.select("row", F.explode("rare").alias("place")).join(of_rare.hint("merge"), "place").groupBy("row").agg(*total)).groupBy("row").agg(*total)
    zero = F.lit(0).cast("long")
    out = per.select("row", "doc_id", "valid", *_SUMS, "groups_sha256").join(gains, "row", "left")
    of = lambda c: F.when(F.col("valid"), F.coalesce(c, zero)).otherwise(zero).alias(c)
    out = out.select("doc_id", *_SUMS, of("n_best"), of("count_sum"), "groups_sha256")
    return Alignment(out, known.drop("sid", "pairs", "parts"), pairs.drop("k"))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document, see ``Alignment.documents``."""
    return align(docs, path_a, path_b).documents
