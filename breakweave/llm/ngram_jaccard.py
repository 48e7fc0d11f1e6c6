"""N-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Two documents link when 100 * |A and B| >= 80 * |A or B| for their sets of distinct 5-word shingles.

1. A text pass hashes the shingles of every document: set size, a 128-bit digest of the set, and a fixed-size count
   sketch over all documents, a first guess at which shingles are rare. Equal sets become one class with the smallest
   doc_id as representative, so copies are never compared.
2. A second pass writes each document's prefix, its rarest |A| - ceil(0.8 |A|) + 1 shingles. Linked documents share a
   prefix shingle in any fixed order. Shingles are then counted exactly over all prefixes; those that are frequent in
   spite of the sketch, as they are once it is saturated by a large corpus, go to the end of the order, and documents
   that had one in their prefix take another prefix. All others keep theirs, which the new order does not touch.
3. Documents that share a prefix shingle form a tile. A tile of more than a few members is cut into size bands, each so
   wide that linked documents are of one band or of neighbouring bands. The members of a band are linked by a star
   to its smallest member, and those of neighbouring bands to each other; candidates of fitting sizes pass the bitmap
   bound (parity bits: differing bits are no more than differing shingles, so the overlap is at most half of
   |A| + |B| - bits), then the intersection of sorted arrays decides.
4. Tiles whose members are not yet one component are cut into blocks of bounded size; the blocks that hold members
   outside the tile's main component meet the blocks of their own and the neighbouring bands, compare only across
   components by bitmap, and the survivors are decided exactly. Members that are already connected need no further
   comparison for components, which keeps groups of near copies linear in their size.
5. All links lie within components. Where links are counted, a component of up to ``BLOCK`` classes is decided by one
   task. The members of a larger one are written as differences to a head, the shingles that it lacks and those it
   adds: the overlap of two follows from the differences, and their numbers alone bound it from both sides. Members of
   like numbers form a cell; pairs of cells that the bounds settle are counted by multiplication. Only blocks of cells that
   are not settled meet, with differences in place of whole arrays, and give one count per member.

A shingle, a star's head or a band that very many rows share is dealt over several tasks (``spread_join``, and pairs of
block groups in step 4).

Defined results: null and empty text and text without words have size 0 and link with nothing; rows that share a
doc_id count as one component, null ids link with nothing, n_links counts classes of equal sets whatever their ids; an empty table gives an empty table; a very long text is a step by
itself and needs some 40 times its bytes; clashing or extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, arrow_rows, by_steps, filter_ids, joined_bytes, spread_join, steps, text_rows, tree_sum, trim
from .components import connected_components
from .wordhash import Words, distinct, mix, shingles

#: Counters of the sketch that orders shingles first; a fixed half megabyte.
SKETCH = 1 << 17
#: Prefixes that hold a shingle from which on it is frequent, how many frequent ones are told to the tasks at most (the
#: first number grows until they fit), and how often prefixes are taken anew.
FREQUENT, MOST_FREQUENT, ROUNDS = 2048, 1 << 18, 2
#: Members of a block of a residual tile, tiles that are small enough for a list of their members, tiles whose pairs are
#: looked at without bitmaps, and blocks that travel together.
BLOCK, SMALL, TINY, GROUP = 256, 64, 16, 16
#: Shingles of a component, or differences of a block, beyond which links are counted by more than one block.
BLOCK_VALUES = 1 << 19


def _sets(piece: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, at = joined_bytes(piece.column(piece.schema.get_field_index("text")))
    return distinct(*shingles(Words(data, at), k))


def _sum_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _digest(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set."""
    one, two = (_sum_by(mix(values ^ np.uint64(salt)), at) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344))
    return one.view(np.int64), two.view(np.int64)


def set_summaries(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n, h1, h2) per document, and per task one row with the sketch alone."""

    def run(batches):
        sketch = np.zeros(SKETCH, np.uint32)
        shape = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sketch", pa.binary())])
        for batch in batches:
            for piece in steps(batch, "text"):
                values, at = _sets(piece, k)
                sketch += np.bincount(values & np.uint64(SKETCH - 1), minlength=SKETCH).astype(np.uint32)
                h1, h2 = _digest(values, at)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(at)), pa.array(h1), pa.array(h2), pa.nulls(piece.num_rows, pa.binary())], schema=shape)
        if sketch.any():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([sketch.astype(np.uint64).tobytes()], pa.binary())], schema=shape)
        trim()

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sketch binary")


def _least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap with which a set of n can still reach the similarity: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _width(n: int) -> int:
    """Bits of a parity signature: the power of two from 64 up that is at least the set's size."""
    return max(64, 1 << (int(n) - 1).bit_length()) if n > 1 else 64


def parity(values: np.ndarray) -> bytes:
    width = _width(len(values))
    bits = np.bincount((values >> np.uint64(20)) & np.uint64(width - 1), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def fold(sig: np.ndarray, size: int) -> np.ndarray:
    """A parity signature at a smaller power-of-two width."""
    return np.bitwise_xor.reduce(sig.reshape(-1, size), axis=0) if len(sig) > size else sig


def may_link(n_a: int, n_b: int, sig_a: bytes, sig_b: bytes, percent: int) -> bool:
    """False only if the bit counts show that the overlap is too small."""
    a, b = np.frombuffer(sig_a, np.uint8), np.frombuffer(sig_b, np.uint8)
    size = min(len(a), len(b))
    bits = int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())
    most = min((n_a + n_b - bits) // 2, n_a, n_b)
    return 100 * most >= percent * (n_a + n_b - most)


def band_starts(percent: int) -> np.ndarray:
    """The smallest size of each band. Sets that can reach the similarity are of one band or of neighbouring ones:
    the larger has at most 100/percent times the smaller's size, and a band ends before that times its start."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts)


def prefixes(docs: DataFrame, rank: bytes, k: int = 5, percent: int = 80, frequent: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n, band, tokens, sig): the rarest shingles and the parity signature of each document that has any.

    Shingles are ordered by the sketch's rank and their value, those in ``frequent`` (sorted) behind all others.
    """
    starts = band_starts(percent)

    def run(piece):
        common = np.frombuffer(rank, np.uint8)
        values, at = _sets(piece, k)
        n = np.diff(at)
        kept = n - _least_overlap(n, percent) + (n > 0)
        lead = common[values & np.uint64(SKETCH - 1)].astype(np.int16)
        if frequent is not None and len(frequent) and len(values):
            own = values.view(np.int64)
            lead[frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own] += 256
        out, sigs = [], []
        for a, b, p in zip(at[:-1], at[1:], kept, strict=True):
            # values ascend, so a stable sort by class orders by (class, value)
            out.append(values[a:b][np.argsort(lead[a:b], kind="stable")[:p]])
            sigs.append(parity(values[a:b]))
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum(kept, out=ends[1:])
        flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        band = pa.array((np.searchsorted(starts, n, "right") - 1).astype(np.int32))
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), band, tokens, pa.array(sigs, pa.binary())], ["doc_id", "n", "band", "tokens", "sig"])

    return docs.mapInArrow(by_steps("text", run), "doc_id long, n long, band int, tokens array<long>, sig binary").where("n > 0")


def shared_tokens(lead: DataFrame) -> DataFrame:
    """(token, size, head, last) of each shingle that two prefixes hold or more; head and last are the outer members."""
    members = lead.select(F.explode("tokens").alias("token"), "doc_id")
    return members.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("size > 1")


def listed_members(lead: DataFrame, large: DataFrame) -> DataFrame:
    """(doc_id, n, band, pos, token, size, head) of the prefix places whose shingle is in ``large``.

    A bitmap of the shingles, 32 bits for each and 32 MB at most, keeps nearly all other places from being shuffled;
    those it lets pass are dropped by the join.
    """
    spark = lead.sparkSession
    bits = min(max(16, (32 * large.count()).bit_length()), 28)
    slot = F.shiftrightunsigned("token", 64 - bits) + 1
    parts = large.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bitmap = np.zeros(max(1 << (bits - 3), 4096), np.uint8)
    for p in parts:
        bitmap[(p.bucket - 1) * 4096 : p.bucket * 4096] = np.frombuffer(p.bits, np.uint8)[: len(bitmap)]
    told = spark.sparkContext.broadcast(bitmap.tobytes())

    def run(batches):
        known = np.frombuffer(told.value, np.uint8)
        for batch in batches:
            lists = batch.column(3)
            at = np.asarray(lists.offsets, np.int64)
            flat = np.asarray(lists.values)[at[0] : at[-1]]
            slots = flat.view(np.uint64) >> np.uint64(64 - bits)
            hit = np.flatnonzero(known[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8) & 1)
            doc = np.searchsorted(at[1:] - at[0], hit, "right")
            of = [batch.column(i).take(pa.array(doc)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*of, pa.array((hit - (at[doc] - at[0])).astype(np.int32)), pa.array(flat[hit])], ["doc_id", "n", "band", "pos", "token"])
        trim()

    found = lead.select("doc_id", "n", "band", "tokens").mapInArrow(run, "doc_id long, n long, band int, pos int, token long")
    return spread_join(found, large.select("token", "size", F.col("size").alias("_rows"), "head"), "token", "_rows", "doc_id")


def frequent_tokens(shared: DataFrame, least: int, most: int) -> np.ndarray:
    """The shingles in more than ``least`` prefixes, sorted; the number rises by powers of two until there are at most ``most``."""
    limits = [min(least << i, 1 << 62) for i in range(40)]
    n = shared.agg(*[F.count_if(F.col("size") > x).alias(str(x)) for x in limits]).first()
    limit = next(x for x, k in zip(limits, n, strict=True) if k <= most)
    if not n[0]:
        return np.zeros(0, np.int64)
    return np.sort(shared.where(F.col("size") > limit).select("token").toPandas().token.to_numpy(np.int64))


def settled_prefixes(scratch: Scratch, rows: DataFrame, heads: DataFrame, heads_n: int, rank: bytes, k: int, percent: int, least: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes of the class representatives and the shingles that they share, frequent ones put last as far as they can."""

    def holding(frequent):
        def run(batches):
            for batch in batches:
                lists = batch.column(1)
                at, flat = np.asarray(lists.offsets, np.int64), np.asarray(lists.values)
                flat = flat[at[0] : at[-1]]
                hit = frequent[np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)] == flat if len(flat) else np.zeros(0, bool)
                some = np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(at))[hit], minlength=batch.num_rows) > 0
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(some))], ["doc_id"])

        return run

    lead = scratch.put("prefixes", filter_ids(prefixes(rows, rank, k, percent), heads, heads_n, True))
    shared = scratch.put("shared", shared_tokens(lead))
    frequent = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        more = np.setdiff1d(frequent_tokens(shared, least, most), frequent)
        if not len(more):
            break
        frequent = np.union1d(frequent, more)
        ids = scratch.put("again", lead.select("doc_id", "tokens").mapInArrow(holding(frequent), "doc_id long").distinct())
        n_ids = ids.count()
        anew = filter_ids(filter_ids(prefixes(rows, rank, k, percent, frequent), heads, heads_n, True), ids, n_ids, True)
        old, lead = lead, scratch.put("prefixes", filter_ids(lead, ids, n_ids, False).unionByName(anew))
        before, shared = shared, scratch.put("shared", shared_tokens(lead))
        scratch.drop(old, before, ids)
    return lead, shared


def bodies(docs: DataFrame, k: int = 5, digests: bool = False) -> DataFrame:
    """(doc_id, body): the sorted shingle hashes of each document with words; with ``digests`` h1 and h2 of the set too."""

    def run(piece):
        values, at = _sets(piece, k)
        own = [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        more = [pa.array(x) for x in _digest(values, at)] if digests else []
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(own, pa.binary()), *more], ["doc_id", "body", *["h1", "h2"][: len(more)]])

    return docs.mapInArrow(by_steps("text", run), "doc_id long, body binary" + ", h1 long, h2 long" * digests).where("length(body) > 0")


def fits(n_a, n_b, percent: int):
    """Sizes between which the similarity can be reached."""
    return (F.least(n_a, n_b) * 100) >= (F.greatest(n_a, n_b) * percent)


def with_sides(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """Pairs with columns of both sides. A document may be the smaller one, ``a``, of very many pairs."""
    side = lambda s: sets.select(F.col("doc_id").alias(s), *[F.col(x).alias(f"{x}_{s}") for x in columns])
    often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_rows"))
    return spread_join(pairs.join(side("b"), "b"), side("a").join(often, "a"), "a", "_rows", "b")


def verify(scratch: Scratch, rows: DataFrame, pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among candidate ``pairs`` (a, b): the bitmap bound first, then arrays of the survivors' texts."""

    def bound(batches):
        for batch in batches:
            c = {x: batch.column(i).to_pylist() for i, x in enumerate(batch.schema.names)}
            yield batch.filter(pa.array([may_link(*x, percent) for x in zip(c["n_a"], c["n_b"], c["sig_a"], c["sig_b"], strict=True)], pa.bool_())).select(["a", "b"])

    def exact(batches):
        for batch in batches:
            c = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
            keep = []
            for x, y in zip(c["body_a"], c["body_b"], strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int(np.count_nonzero(q[at] == p))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    likely = scratch.put("likely", with_sides(pairs, sets, "n", "sig").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(bound, "a long, b long"))
    ids = scratch.put("ids", likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct())
    arrays = scratch.put("arrays", bodies(filter_ids(rows, ids, ids.count(), True), k))
    links = scratch.put("linked", with_sides(likely, arrays, "body").select("a", "b", "body_a", "body_b").mapInArrow(exact, "a long, b long").distinct())
    scratch.drop(arrays, likely, ids)
    return links


def _signature_packs(sigs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Signatures by width: which rows, and their bytes as a matrix."""
    width = np.array([len(x) for x in sigs])
    of = [np.flatnonzero(width == w) for w in np.unique(width)]
    return [(at, np.frombuffer(b"".join(sigs[i] for i in at), np.uint8).reshape(len(at), -1)) for at in of]


def _may_link(n: int, sig: bytes, sizes: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """``may_link`` of one set with others whose signatures have one width."""
    own = np.frombuffer(sig, np.uint8)
    size = min(bits.shape[1], len(own))
    other = np.bitwise_xor.reduce(bits.reshape(len(bits), -1, size), axis=1) if bits.shape[1] > size else bits
    apart = np.bitwise_count(other ^ fold(own, size)).sum(axis=1, dtype=np.int64)
    most = np.minimum((sizes + n - apart) // 2, np.minimum(sizes, n))
    return 100 * most >= percent * (sizes + n - most)


def _across_members(percent: int):
    """Pairs of a small tile's members in different components that its shingle, and their bitmaps if they are there, still let link.

    The first shingle that two documents share has all their other shared ones behind it. A pair is left to another
    tile, or can't link, where too few shingles follow in one of the two.
    """

    def run(batches):
        for batch in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(batch.num_rows):
                own = batch.column(0)[k].values
                ids, comps, n, pos = (np.asarray(own.field(x), np.int64) for x in ("doc_id", "comp", "n", "pos"))
                sigs = own.field("sig").to_pylist() if own.type.get_field_index("sig") >= 0 else None
                for at, bits in _signature_packs(sigs) if sigs else [(np.arange(len(ids)), None)]:
                    for i in range(len(ids)):
                        # overlap o links if 100 o >= percent (n_i + n_j - o)
                        least = -(-percent * (n[i] + n[at]) // (100 + percent))
                        ok = np.flatnonzero((at > i) & (comps[at] != comps[i]) & (n[i] - pos[i] >= least) & (n[at] - pos[at] >= least))
                        if len(ok):
                            j = at[ok[_may_link(n[i], sigs[i], n[at[ok]], bits[ok], percent)]] if sigs else at[ok]
                            out_a.append(np.minimum(ids[j], ids[i]))
                            out_b.append(np.maximum(ids[j], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def _across_blocks(percent: int):
    """Compares one block of members (left, outside the main component) with another by bitmap, across components only."""

    def members(row):
        own = row.values
        return (*(np.asarray(own.field(x)) for x in ("doc_id", "comp", "n")), own.field("sig").to_pylist())

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                out_a, out_b = [], []
                ids, comps, sizes, sigs = members(batch.column(1)[k])
                packs = _signature_packs(sigs)
                for doc_id, comp, n, sig in zip(*members(batch.column(0)[k]), strict=True):
                    for at, bits in packs:
                        for x in ids[at][_may_link(n, sig, sizes[at], bits, percent) & (comps[at] != comp)].tolist():
                            out_a.append(min(doc_id, x))
                            out_b.append(max(doc_id, x))
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(lhs, rhs): every block outside its tile's main component with every block of its own and the neighbouring bands.

    ``GROUP`` blocks travel together, and every two groups meet under a key of their own, so no task is given all
    pairs of a hot tile; a block is repeated once for each group that it meets.
    """
    group = F.floor(F.col("block") / GROUP).cast("int")
    near = [F.col("band") + d for d in (-1, 0, 1)]
    # the last group of the blocks outside and inside the main component, null where a band has none
    last = lambda band, inside: F.floor((F.ceil(F.element_at("held", (band * 2 + inside).cast("int")) / BLOCK) - 1) / GROUP).cast("int")
    meets = F.filter(F.array(*[F.struct(b.alias("other"), F.lit(bool(i)).alias("of_main"), last(b, i).alias("last")) for b in near for i in (0, 1)]), lambda m: m["last"].isNotNull())
    left = blocks.where("not of_main").select("token", group.alias("g"), F.explode(meets).alias("m"), F.col("members").alias("lhs"))
    left = left.select("token", "g", "m.other", "m.of_main", F.explode(F.sequence(F.lit(0), F.col("m.last"))).alias("h"), "lhs")
    right = blocks.select("token", F.col("band").alias("other"), "of_main", group.alias("h"), F.greatest(*[last(b, 0) for b in near]).alias("g_last"), F.col("members").alias("rhs"))
    right = right.where("g_last is not null").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("g_last")))).drop("g_last")
    return left.join(right, ["token", "other", "of_main", "g", "h"]).select("lhs", "rhs")


def residual_pairs(scratch: Scratch, tiles: DataFrame, comps: DataFrame, sets: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) inside tiles of three and more members that are not one component yet.

    Tiles of up to ``SMALL`` members give their pairs across components as far as the shingle's places and bitmaps allow.
    Larger ones are cut into bands and blocks that carry bitmaps.
    """
    member = tiles.select("token", "doc_id", "n", "band", "pos", "size").join(comps, "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")
    member = scratch.put("members", member)
    per = member.where(F.col("size") > SMALL).groupBy("token", "comp", "band").agg(F.count(F.lit(1)).alias("rows"))
    per = scratch.put("per", per)
    mixed = per.groupBy("token", "comp").agg(F.sum("rows").alias("rows")).groupBy("token").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.max("rows").alias("inner"), F.sum("rows").alias("rows")).where("rows > inner")
    # rows of each band inside and outside the main component; there are some hundred bands at most
    side = F.col("band") * 2 + (F.col("comp") == F.col("main")).cast("int")
    held = per.join(mixed.select("token", "main"), "token").groupBy("token", side.alias("side")).agg(F.sum("rows").alias("held"))
    held = held.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("side", "held"))).alias("held"))
    mixed = scratch.put("mixed", mixed.select("token", "main", "rows").join(held, "token"))
    inside = spread_join(member.where(F.col("size") > SMALL).drop("n", "size", "pos"), mixed, "token", "rows", "doc_id").join(sets, "doc_id")
    inside = inside.withColumn("of_main", F.col("comp") == F.col("main")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.ceil(F.element_at("held", side) / BLOCK)))
    # a member of the main component that has nobody outside in its own and the neighbouring bands meets no one
    inside = inside.where(F.coalesce(*[F.element_at("held", (F.col("band") + d) * 2) for d in (-1, 0, 1)]).isNotNull())
    blocks = inside.groupBy("token", "band", "of_main", "block").agg(F.first("held").alias("held"), F.collect_list(F.struct("doc_id", "comp", "n", "sig")).alias("members"))
    blocks = scratch.put("blocks", blocks)
    found = block_pairs(blocks).mapInArrow(_across_blocks(percent), "a long, b long")

    lists = member.where(F.col("size") <= SMALL).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("doc_id", "comp", "n", "pos"))).alias("members"))
    lists = lists.where(F.size(F.array_distinct("members.comp")) > 1)
    # Tiles with the same members count once, at the earliest of their shingles: the order of shingles is the same in
    # every document, so the least array of places is the least in each place.
    lists = lists.groupBy(F.col("members.doc_id").alias("doc_id")).agg(F.first("members.comp").alias("comp"), F.first("members.n").alias("n"), F.min("members.pos").alias("pos"), F.min("token").alias("token"))
    lists = scratch.put("lists", lists.select("token", F.arrays_zip("doc_id", "comp", "n", "pos").alias("members")))
    found = found.unionByName(lists.where(F.size("members") <= TINY).select("members").mapInArrow(_across_members(percent), "a long, b long"))
    lists = lists.where(F.size("members") > TINY).select("token", F.explode("members").alias("m")).select("token", "m.*").join(sets.select("doc_id", "sig"), "doc_id")
    lists = lists.groupBy("token").agg(F.collect_list(F.struct("doc_id", "comp", "n", "pos", "sig")).alias("members")).select("members")
    found = found.unionByName(lists.mapInArrow(_across_members(percent), "a long, b long")).distinct()
    return found.join(seen, ["a", "b"], "left_anti")


def cell(x: np.ndarray) -> np.ndarray:
    """The least number of the cell that holds x: cells hold one number each up to 31, then a sixteenth of a power of two."""
    shift = np.maximum(np.frexp(x.astype(np.float64))[1] - 5, 0)
    return (x >> shift) << shift


def settled(n_head: int, m: int, d: int, ms: np.ndarray, ds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether all pairs of a set of cell (m, d) with sets of the cells (ms, ds) link, and whether none does.

    A set of cell (m, d) lacks m shingles of the head's n_head and has d that the head hasn't. Two sets share at least
    what neither lacks, and at most the head but for the larger lack, with the smaller number of added ones.
    """
    last = lambda x: x + (1 << np.maximum(np.frexp(np.asarray(x, np.float64))[1].astype(np.int64) - 5, 0)) - 1
    m_last, d_last, ms_last, ds_last = last(m), last(d), last(ms), last(ds)
    least, sizes = n_head - m_last - ms_last, 2 * n_head - m_last - ms_last + d_last + ds_last
    most = n_head - np.maximum(m, ms) + np.minimum(d_last, ds_last)
    return (100 + percent) * least >= percent * sizes, (100 + percent) * most < percent * (2 * n_head - m_last - ms_last + d + ds)


def _consensus(batches):
    """The shingles that more than half of some members of a component hold."""
    for batch in batches:
        heads = []
        for own in batch.column(1):
            values, n = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in own.values]), return_counts=True)
            heads.append(values[2 * n > len(own.values)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], ["component", "head"])


def _differences(batches):
    """How many shingles of the head a member lacks (m) and how many it adds (d), and both kinds as one sorted array."""
    for batch in batches:
        c = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
        sizes, diffs = [], []
        for body, head in zip(c["body"], c["head"], strict=True):
            x, h = np.frombuffer(body.as_buffer(), np.uint64), np.frombuffer(head.as_buffer(), np.uint64)
            diff = np.setxor1d(x, h, assume_unique=True)
            both = (len(x) + len(h) - len(diff)) // 2
            sizes.append((len(h), len(h) - both, len(x) - both))
            diffs.append(diff.tobytes())
        n_head, m, d = np.array(sizes, np.int64).reshape(-1, 3).T
        cols = [*(c[x] for x in ("component", "doc_id", "h1", "h2")), pa.array(n_head), pa.array(m), pa.array(d), pa.array(cell(m)), pa.array(cell(d)), pa.array(diffs, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["component", "doc_id", "h1", "h2", "n_head", "m", "d", "cell_m", "cell_d", "body"])


PLAN = "component long, cell_m long, cell_d long, rows long, grp int, parts int, certain long, open boolean, other int, other_parts int"


def _plan(percent: int, block: int, block_values: int):
    """Of each component's cells: how many links are certain, which group of blocks holds a cell, and which groups must meet.

    Consecutive cells make up a group of one block; a cell that is too large for one is a group of several parts. There are
    as many cells as sizes of differences, not as members: each of two axes has at most 16 for each power of two.
    """

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(2)[k].values
                m, d, rows, values = (np.asarray(own.field(x), np.int64) for x in ("cell_m", "cell_d", "rows", "values"))
                order = np.lexsort((m, m + d))
                m, d, rows, values = m[order], d[order], rows[order], values[order]
                need = np.maximum(-(-rows // block), -(-values // block_values)).astype(np.int32)
                grp, at, held, used = np.zeros(len(m), np.int32), -1, block, 0
                for i in range(len(m)):
                    if need[i] > 1 or held + rows[i] > block or used + values[i] > block_values:
                        at, held, used = at + 1, 0, 0
                    # a group of several parts takes no other cell
                    held, used = (block, 0) if need[i] > 1 else (held + rows[i], used + values[i])
                    grp[i] = at
                parts = np.maximum.reduceat(need, np.flatnonzero(np.diff(grp, prepend=-1)))
                certain, is_open, meets = np.zeros(len(m), np.int64), np.zeros(len(m), bool), set()
                for i in range(len(m)):
                    every, none = settled(batch.column(1)[k].as_py(), m[i], d[i], m, d, percent)
                    certain[i] = rows[every].sum() - every[i]
                    unknown = ~every & ~none
                    unknown[i] &= rows[i] > 1
                    is_open[i] = unknown.any()
                    meets.update((int(grp[i]), int(g)) for g in np.unique(grp[unknown]) if g >= grp[i])
                none_of = lambda n, t: pa.nulls(n, t)
                g, h = np.array(sorted(meets), np.int32).reshape(-1, 2).T
                shape = pa.schema([("component", pa.int64()), ("cell_m", pa.int64()), ("cell_d", pa.int64()), ("rows", pa.int64()), ("grp", pa.int32()), ("parts", pa.int32()), ("certain", pa.int64()), ("open", pa.bool_()), ("other", pa.int32()), ("other_parts", pa.int32())])
                name = lambda n: pa.array(np.full(n, batch.column(0)[k].as_py(), np.int64))
                n = len(m)
                yield pa.RecordBatch.from_arrays([name(n), *map(pa.array, (m, d, rows, grp, parts[grp], certain, is_open)), none_of(n, pa.int32()), none_of(n, pa.int32())], schema=shape)
                n = len(g)
                yield pa.RecordBatch.from_arrays([name(n), *[none_of(n, pa.int64())] * 3, pa.array(g), pa.array(parts[g]), none_of(n, pa.int64()), none_of(n, pa.bool_()), pa.array(h), pa.array(parts[h])], schema=shape)

    return run


def _links_between(n_head: int, lhs, rhs, percent: int):
    """Keys of both blocks' members and how many of the other block each links with, of one block alone if ``rhs`` is null.

    Pairs that the sizes of the differences settle are left out; they are counted by cells.
    """

    def members(row):
        own = row.values
        values = [np.frombuffer(x.as_buffer(), np.uint64) for x in own.field("body")]
        m, d = (np.asarray(own.field(x), np.int64) for x in ("m", "d"))
        return np.stack([np.asarray(own.field(x), np.int64) for x in ("doc_id", "h1", "h2")], axis=1), m, d, values

    a_keys, a_m, a_d, a_values = members(lhs)
    alone = not rhs.is_valid
    b_keys, b_m, b_d, b_values = (a_keys, a_m, a_d, []) if alone else members(rhs)
    _, places = np.unique(np.concatenate([*a_values, *b_values, np.zeros(0, np.uint64)]), return_inverse=True)
    a_at = np.cumsum([0, *[len(v) for v in a_values]])
    of_b = places if alone else places[a_at[-1] :]
    b_of = np.repeat(np.arange(len(b_keys)), b_m + b_d)  # whose each difference is
    held = np.zeros(len(places) + 1, bool)
    linked = np.zeros((len(a_keys), len(b_keys)), bool)
    cells, cell_of = np.unique(np.stack([cell(b_m), cell(b_d)], axis=1), axis=0, return_inverse=True)
    cell_of = cell_of.reshape(-1)
    a_cells = np.stack([cell(a_m), cell(a_d)], axis=1)
    unknown: dict[tuple, np.ndarray] = {}
    for i, (a, b) in enumerate(zip(a_at[:-1], a_at[1:], strict=True)):
        of = (int(a_cells[i, 0]), int(a_cells[i, 1]))
        if of not in unknown:
            every, none = settled(n_head, *of, cells[:, 0], cells[:, 1], percent)
            unknown[of] = (~every & ~none)[cell_of]
        if not unknown[of].any():
            continue
        held[places[a:b]] = True
        both = np.bincount(b_of[held[of_b]], minlength=len(b_keys))
        held[places[a:b]] = False
        sizes = 2 * n_head - a_m[i] + a_d[i] - b_m + b_d
        # the sets differ where their differences to the head do
        overlap = (sizes - (a_m[i] + a_d[i] + b_m + b_d - 2 * both)) // 2
        linked[i] = unknown[of] & (100 * overlap >= percent * (sizes - overlap))
    if alone:
        np.fill_diagonal(linked, False)
        return a_keys, linked.sum(axis=1)
    return np.concatenate([a_keys, b_keys]), np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])


def _count_links(percent: int):
    def run(batches):
        for batch in batches:
            for n_head, lhs, rhs in zip(*batch.columns, strict=True):
                keys, n = _links_between(n_head.as_py(), lhs, rhs, percent)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in keys.T), pa.array(n.astype(np.int64))], ["doc_id", "h1", "h2", "n"])
        trim()

    return run


COUNTED = "doc_id long, h1 long, h2 long, n long"


def class_arrays(scratch: Scratch, rows: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """(doc_id, h1, h2, body, component, large) of the classes in ``kinds``, each once."""
    ids = kinds.select("doc_id").distinct()
    key = ["doc_id", "h1", "h2"]
    arrays = scratch.put("members", bodies(filter_ids(rows, ids, ids.count(), True), k, True).join(kinds, key))
    if arrays.count() == kinds.count():
        return arrays
    # rows that repeat id and text
    once = scratch.put("members", arrays.groupBy(*key).agg(*[F.first(x).alias(x) for x in ("body", "component", "large")]))
    scratch.drop(arrays)
    return once


def differences(scratch: Scratch, arrays: DataFrame, per: DataFrame) -> DataFrame:
    """The members of large components as their differences to the component's head.

    The head is a consensus of up to 15 members that a hash chooses. Any other would give the same links; one near to
    most members makes the differences short.
    """
    key = F.xxhash64("doc_id", "h1", "h2")
    some = arrays.select("component", "doc_id", "h1", "h2", key.alias("_key")).groupBy("component", F.pmod("_key", F.lit(15)).alias("_of"))
    some = some.agg(F.min(F.struct("_key", "doc_id", "h1", "h2")).alias("s")).select("s.doc_id", "s.h1", "s.h2")
    heads = arrays.join(some, ["doc_id", "h1", "h2"], "left_semi").groupBy("component").agg(F.collect_list("body").alias("bodies"))
    with arrow_rows(scratch.spark, 16):
        heads = scratch.put("heads", heads.mapInArrow(_consensus, "component long, head binary"))
    to_head = spread_join(arrays, heads.join(per, "component").select("component", "head", "rows"), "component", "rows", "doc_id")
    shape = "component long, doc_id long, h1 long, h2 long, n_head long, m long, d long, cell_m long, cell_d long, body binary"
    return scratch.put("differences", to_head.select("component", "doc_id", "h1", "h2", "body", "head").mapInArrow(_differences, shape))


def link_counts(scratch: Scratch, rows: DataFrame, kinds: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, h1, h2, n_links): with how many others each class (doc_id, h1, h2, n, component) links."""
    per = scratch.put("per", kinds.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("values")))
    large = (F.col("rows") > BLOCK) | (F.col("values") > BLOCK_VALUES)
    kinds = scratch.put("kinds", spread_join(kinds.drop("n"), per.select("component", large.alias("large"), F.col("rows").alias("_rows")), "component", "_rows", "doc_id"))
    arrays = class_arrays(scratch, rows, kinds, k)
    member = F.struct("doc_id", "h1", "h2", "m", "d", "body")
    nobody = F.lit(None).cast("array<struct<doc_id:bigint,h1:bigint,h2:bigint,m:bigint,d:bigint,body:binary>>")

    # a small component is one block, with an empty head
    small = arrays.where("not large").withColumn("m", F.lit(0).cast("long")).withColumn("d", F.expr("length(body) div 8"))
    small = small.groupBy("component").agg(F.collect_list(member).alias("lhs"))
    with arrow_rows(scratch.spark, 16):  # a row holds a block or two
        found = [scratch.put("in_small", small.select(F.lit(0).cast("long").alias("n_head"), "lhs", nobody.alias("rhs")).mapInArrow(_count_links(percent), COUNTED))]

    if per.where(large).take(1):
        diffs = differences(scratch, arrays.where("large"), per)
        cells = diffs.groupBy("component", "n_head", "cell_m", "cell_d").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr("length(body) div 8")).alias("values"))
        cells = cells.groupBy("component", "n_head").agg(F.collect_list(F.struct("cell_m", "cell_d", "rows", "values")).alias("cells"))
        with arrow_rows(scratch.spark, 16):
            plan = scratch.put("plan", cells.mapInArrow(_plan(percent, 4 * BLOCK, BLOCK_VALUES), PLAN))
        at = F.struct("component", "cell_m", "cell_d").alias("cell")
        of_cell = plan.where("other is null").select(at, "rows", "grp", "parts", "certain", "open")
        placed = scratch.put("placed", spread_join(diffs.withColumn("cell", at), of_cell, "cell", "rows", "doc_id"))
        found.append(placed.select("doc_id", "h1", "h2", F.col("certain").alias("n")))
        blocks = placed.where("open").groupBy("component", "n_head", "grp", F.pmod(F.xxhash64("doc_id", "h1"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(member).alias("members"))
        blocks = scratch.put("blocks", blocks)
        meet = plan.where("other is not null").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        meet = meet.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1))).select("component", "grp", "part", "other", "other_part")
        self_pair = (F.col("grp") == F.col("other")) & (F.col("part") == F.col("other_part"))
        mine, keys = ["component", "grp", "part"], ["component", "grp", "part", "other", "other_part"]
        alone = blocks.join(meet.where(self_pair), mine, "left_semi").select("n_head", F.col("members").alias("lhs"), nobody.alias("rhs"))
        meet = meet.where((F.col("grp") < F.col("other")) | (F.col("part") < F.col("other_part")))
        lhs = blocks.withColumnRenamed("members", "lhs").join(meet, mine)
        rhs = blocks.select("component", F.col("grp").alias("other"), F.col("part").alias("other_part"), F.col("members").alias("rhs")).join(meet, ["component", "other", "other_part"])
        with arrow_rows(scratch.spark, 16):
            pairs = alone.unionByName(lhs.join(rhs, keys).select("n_head", "lhs", "rhs"))
            found.append(scratch.put("in_large", pairs.mapInArrow(_count_links(percent), COUNTED)))
        scratch.drop(diffs, blocks)
    scratch.drop(arrays)
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return scratch.put("n_links", total.groupBy("doc_id", "h1", "h2").agg(F.sum("n").alias("n_links")))


def jaccard_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, count_links: bool = True, frequent: int = FREQUENT, most_frequent: int = MOST_FREQUENT
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and n_links, how many other classes (equal sets) its class links.

    Without ``count_links`` there is no n_links, and members of one component are not compared again.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-jaccard")
    rows = text_rows(docs, text, doc_id)
    told = scratch.put("sets", set_summaries(rows, k))
    sketch = tree_sum(told, "sketch", SKETCH, "uint64")
    rank = np.minimum(np.log2(1 + sketch) * 4, 255).astype(np.uint8).tobytes()
    summary = told.where("n is not null").select("doc_id", "n", "h1", "h2")
    classes = scratch.put("classes", summary.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))
    heads = classes.select(F.col("rep").alias("doc_id")).distinct()
    heads_n = heads.count()

    lead, shared = settled_prefixes(scratch, rows, heads, heads_n, rank, k, percent, frequent, most_frequent)
    # two members are a pair already; only larger tiles need their members listed
    tiles = scratch.put("tiles", listed_members(lead, shared.where("size > 2")))
    sets = scratch.put("signatures", lead.select("doc_id", "n", "sig"))
    scratch.drop(lead)

    # stars: to the head of a small tile, in larger ones to the head of each band, and between heads of neighbouring bands
    big = tiles.where(F.col("size") > SMALL).withColumn("tile", F.struct("token", "band"))
    bands = scratch.put("bands", big.groupBy("tile").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_rows")))
    of_band = spread_join(big.select("tile", "doc_id"), bands, "tile", "_rows", "doc_id")
    next_band = bands.select(F.struct("tile.token", (F.col("tile.band") - 1).alias("band")).alias("tile"), F.col("first").alias("other"))
    pairs = shared.where("size = 2").select(F.col("head").alias("x"), F.col("last").alias("y"))
    for more in (tiles.where(F.col("size") <= SMALL).select("head", "doc_id"), of_band.select("first", "doc_id"), bands.join(next_band, "tile").select("first", "other")):
        pairs = pairs.union(more)
    pairs = scratch.put("pairs", pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    stars = scratch.put("stars", with_sides(pairs, sets, "n").where(fits(F.col("n_a"), F.col("n_b"), percent)).select("a", "b"))
    links = verify(scratch, rows, stars, sets, k, percent)
    comps = connected_components(scratch, links)
    comps = scratch.put("parts", comps.withColumnRenamed("node", "doc_id"))
    with arrow_rows(spark, 64):  # a row may hold two blocks
        more = scratch.put("more", residual_pairs(scratch, tiles, comps, sets, stars, percent))
    if more.take(1):
        more = verify(scratch, rows, more, sets, k, percent)
        links = scratch.put("links", links.unionByName(more).distinct())
        if more.take(1):
            comps = connected_components(scratch, links).withColumnRenamed("node", "doc_id")
            comps = scratch.put("parts", comps)
    scratch.drop(sets, tiles)
    found = classes.join(comps.withColumnRenamed("doc_id", "rep"), "rep", "left")
    if count_links:
        kinds = classes.withColumnRenamed("rep", "doc_id").join(comps, "doc_id")
        found = found.join(link_counts(scratch, rows, kinds, k, percent).withColumnRenamed("doc_id", "rep"), ["rep", "h1", "h2"], "left")
    else:
        found = found.withColumn("n_links", F.lit(None))
    out = summary.join(found.select("h1", "h2", "n", "rep", "component", "n_links"), ["h1", "h2", "n"], "left")
    counted = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"), *counted)


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the smallest doc_id of each component; documents that link with nothing all stay."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    gone = scratch.put("gone", jaccard_components(docs, doc_id, text, k, percent, count_links=False).where("doc_id <> component_id").select("doc_id"))
    return filter_ids(docs, gone, gone.count(), False, doc_id, BROADCAST_ROWS)


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), sets as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s from w
), sized as (select doc_id, len(s) as n, s from sets), flat as (select doc_id, n, unnest(s) as g from sized),
links as (
  select a.doc_id as a, b.doc_id as b, a.n = b.n and count(*) = a.n as equal from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), sym as (select a, b, equal from links union all select b, a, equal from links),
classes as (select d.doc_id, least(d.doc_id, coalesce(min(b), d.doc_id)) as class from documents d left join sym on a = d.doc_id and equal group by d.doc_id),
linked as (select a as doc_id, count(distinct class)::bigint as n_links from sym join classes c on c.doc_id = b where not equal group by a),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join sym l on r.b = l.a)
select s.doc_id, s.n::bigint as n_shingles, min(r.b) as component_id, any_value(coalesce(n_links, 0)) as n_links
from sized s join reach r on s.doc_id = r.a left join linked k on k.doc_id = s.doc_id group by s.doc_id, s.n
"""
