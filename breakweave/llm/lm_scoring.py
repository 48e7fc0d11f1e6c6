"""Language-model scores of whole texts by a weighted backoff automaton that is dealt to the documents in slices.

The model is an interpolated bigram model with three absolute discounts (for pairs seen once, twice and more often)
over add-one unigrams. Written as an automaton, its states are the start of a text, every word seen in training and
the root; a seen pair is an arc with a weight, and every other step takes the failure arc of its state, whose weight is
the mass that discounting left, on to the root, where every word has an arc and the words never seen share one.

No machine holds the automaton, which grows with the corpus. Documents are dealt into blocks, runs of rows of a file
split. A block asks for the arcs that it can reach: its distinct (state, word) pairs with their counts in its training
texts, in packets by a hash of the state. Each part of that hash adds up what all blocks sent, and answers each packet
with the corpus-wide counts in the order of the packet and what its states need for their failure arcs. A block then
walks its texts from left to right once, carrying the state, and sums log probabilities. States that make up more than
``HOT`` of all tokens by a sample are dealt by pair, and their few totals are added on the driver; the sample decides on
dealing only, never on a result. All counts are over all training texts, nothing is pruned.

Words are known by 64-bit hashes, of which any two of a billion words share one with a chance of 3 %.

Defined results: null and empty texts are one token, the end; rows with a null id are scored and neither learned from nor
held out; with nothing to learn from, every token has the base's probability; repeated rows and ids give as many rows;
an empty table gives an empty table; a very long text is a step by itself and needs some 40 times its bytes; other
columns, clashing names too, are ignored. Rows must come in the same order when ``docs`` is read again, as those of
files do: write the result of a shuffle as a table first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_crc, joined_bytes, ship, steps, trim
from .wordhash import Words, mix

#: Text bytes of a block, and pairs that a part of the automaton holds, both about.
BLOCK_BYTES, PART_PAIRS = 16 << 20, 1 << 21
#: Share of tokens above which a state is dealt by pair, and documents of the sample that tells.
HOT, SAMPLE = 1 / 500, 2000
#: The end of a text as a token and its start as a state.
END, START = np.uint64(1), np.uint64(2)
_REPLY = "block long, part long, counts binary, states binary, state long, sums array<long>"


@dataclass
class Model:
    """What all blocks need beside their slices."""

    tokens: int
    types: int
    discounts: tuple[float, float, float]
    parts: int
    #: Sorted hot states, and of each its count and the number of words seen once, twice and more often after it.
    hot: np.ndarray
    totals: np.ndarray


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each, and where each text's begin."""
    words = Words(data, at)
    n = len(at) - 1
    first = words.first + np.arange(n + 1)
    out = np.full(first[-1], END, np.uint64)
    out[np.arange(len(words.starts)) + np.repeat(np.arange(n), words.count)] = words.hashes()
    return out, first


class Block:
    """The distinct (state, word) pairs of a block, in the order in which parts are asked for them."""

    def __init__(self, pieces: list[tuple[np.ndarray, np.ndarray]], parts: int, hot: np.ndarray, places: bool):
        toks = np.concatenate([t for t, _ in pieces])
        begins, base = [], 0
        for t, first in pieces:
            begins.append(first[:-1] + base)
            base += len(t)
        self.begins = np.concatenate(begins)
        self.words, word = np.unique(np.append(toks, [START, END]), return_inverse=True)
        start, word = word[-2], word[:-2]
        self.start, self.end = int(start), int(np.searchsorted(self.words, END))
        state = np.empty_like(word)
        state[1:] = word[:-1]
        state[self.begins] = start
        self.word = word
        code = state.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
        codes, *where = np.unique(code, return_inverse=places)
        self.states, self.nexts = (codes >> np.uint64(32)).astype(np.int64), (codes & np.uint64(0xFFFFFFFF)).astype(np.int64)
        part = mix(self.words)[self.states]
        at = np.searchsorted(hot, self.words)
        is_hot = (hot[np.minimum(at, max(len(hot) - 1, 0))] == self.words) if len(hot) else np.zeros(len(self.words), bool)
        salted = np.flatnonzero(is_hot[self.states])
        part[salted] = mix(part[salted] ^ self.words[self.nexts[salted]])
        part = (part % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        self.states, self.nexts, part = self.states[order], self.nexts[order], part[order]
        self.part, self.cut = np.unique(part, return_index=True)
        self.cut = np.append(self.cut, len(part))
        self.code, self.order = codes, order
        if places:
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            self.place = back[where[0]]

    def runs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """States of the pairs a to b, and how many pairs each has."""
        own = self.states[a:b]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        return own[new], np.diff(np.append(new, len(own)))


def _ask(batches, shift: int, parts: int, hot: np.ndarray):
    """Packets (block, part, states, runs, words, counts) of each block; rows come block by block."""

    def packets(block, pieces, train):
        b = Block([p for p in pieces], parts, hot, True)
        n = np.bincount(b.place, np.repeat(np.concatenate(train), np.diff(np.append(b.begins, len(b.word)))), len(b.states)).astype(np.int64)
        rows = []
        for part, x, y in zip(b.part.tolist(), b.cut[:-1].tolist(), b.cut[1:].tolist(), strict=True):
            states, runs = b.runs(x, y)
            rows.append((block, part, b.words[states].tobytes(), _pack(runs), b.words[b.nexts[x:y]].tobytes(), _pack(n[x:y])))
            if len(rows) == 256:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    now, pieces, train = None, [], []
    for batch in batches:
        for piece in steps(batch, "text", 1 << 20):
            block = np.asarray(piece.column(0)) >> shift
            for a, b in _runs(block):
                if block[a] != now and pieces:
                    yield from packets(int(now), pieces, train)
                    pieces, train = [], []
                now = block[a]
                own = piece.slice(a, b - a)
                pieces.append(tokens(*joined_bytes(own.column(1))))
                train.append(np.asarray(own.column(2).cast(pa.int8()), np.float64))
    if pieces:
        yield from packets(int(now), pieces, train)
    trim()


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the smallest type that holds them, its size first."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def _unpack(told: bytes) -> np.ndarray:
    return np.frombuffer(told, f"u{told[0]}", offset=1).astype(np.int64)


def _runs(values: np.ndarray):
    cut = np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values)).tolist()
    return list(zip(cut[:-1], cut[1:], strict=True)) if len(values) else []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "part", "states", "runs", "words", "counts"])


def _add(asked: pa.Table, hot: np.ndarray) -> pa.Table:
    """One part of the automaton: corpus-wide counts, told to every block that asked for them."""
    col = {n: asked.column(n).to_pylist() for n in ("block", "part", "states", "runs", "words", "counts")}
    own = [np.frombuffer(x, np.uint64) for x in col["states"]]
    runs = [_unpack(x) for x in col["runs"]]
    state = np.concatenate([np.repeat(s, r) for s, r in zip(own, runs, strict=True)])
    word = np.concatenate([np.frombuffer(x, np.uint64) for x in col["words"]])
    n = np.concatenate([_unpack(x) for x in col["counts"]])
    order = np.lexsort((word, state))
    state, word = state[order], word[order]
    new = np.flatnonzero(np.append(True, (state[1:] != state[:-1]) | (word[1:] != word[:-1])))
    total = np.add.reduceat(n[order], new)
    counts = np.empty(len(n), np.int64)
    counts[order] = np.repeat(total, np.diff(np.append(new, len(n))))
    heads = state[new]
    first = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
    known = heads[first]
    sums = np.stack([np.add.reduceat(x, first) for x in (total, total == 1, total == 2, total > 2)], axis=1).astype(np.int64)
    rows, at = [], 0
    for block, part, s, r in zip(col["block"], col["part"], own, runs, strict=True):
        size = int(r.sum())
        rows.append((block, part, _pack(counts[at : at + size]), _pack(sums[np.searchsorted(known, s)]), None, None))
        at += size
    is_hot = np.isin(known, hot)
    rows += [(-1, 0, None, None, int(k), s) for k, s in zip(known[is_hot].view(np.int64).tolist(), sums[is_hot].tolist(), strict=True)]
    # pairs seen 1 to 4 times, all tokens, words known (hot ones are counted from their totals)
    types = np.count_nonzero((sums[:, 0] > 0) & ~is_hot & (known != START))
    rows.append((-2, 0, None, None, None, [*(int(np.count_nonzero(total == k)) for k in (1, 2, 3, 4)), int(total.sum()), int(types)]))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "part", "counts", "states", "state", "sums"])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more from how many pairs were seen 1 to 4 times; half a count where that can't tell."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [k - (k + 1) * y * b / a if a and b else y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(float(np.clip(d, 0.1, k - 0.1)) for k, d in enumerate(found, 1))


class Slice:
    """The arcs that a block can reach."""

    def __init__(self, block: Block, replies: dict[int, tuple[bytes, bytes]], model: Model):
        count, own = np.zeros(len(block.states), np.int64), np.zeros((len(block.words), 4), np.int64)
        for part, a, b in zip(block.part.tolist(), block.cut[:-1].tolist(), block.cut[1:].tolist(), strict=True):
            c, s = replies[part]
            count[a:b] = _unpack(c)
            own[block.runs(a, b)[0]] = _unpack(s).reshape(-1, 4)
        at = np.searchsorted(block.words, model.hot)
        here = np.flatnonzero(block.words[np.minimum(at, len(block.words) - 1)] == model.hot) if len(model.hot) else []
        if len(here):
            own[at[here]] = model.totals[here]
        own[block.end] = 0
        self.known = own[:, 0].copy()
        self.known[block.end] = own[block.start, 0]
        #: Log probability of every word's arc at the root.
        p = (self.known + 1) / (model.tokens + model.types + 1)
        self.root = np.log10(p)
        seen = own[:, 0]
        left = (own[:, 1:] @ np.array(model.discounts)) / np.maximum(seen, 1)
        #: Log weight of every state's failure arc; a state never seen is the root itself.
        self.failure = np.where(seen > 0, np.log10(np.where(left > 0, left, 1)), 0)
        less = np.array([0, *model.discounts])[np.minimum(count, 3)]
        arc = (count - less) / np.maximum(seen[block.states], 1) + left[block.states] * p[block.nexts]
        #: Log weight of every pair: its arc, or the failure arc and the root's.
        self.pair = np.where(count > 0, np.log10(np.where(count > 0, arc, 1)), self.failure[block.states] + self.root[block.nexts])


def _walk(docs: pa.Table, replies: pa.Table, model: Model) -> pa.Table:
    """Scores of the texts of a block."""
    pieces, ids, held = [], [], []
    for batch in docs.select(["doc_id", "text", "held_out"]).to_batches():
        for piece in steps(batch, "text", 1 << 20):
            pieces.append(tokens(*joined_bytes(piece.column(1))))
            ids.append(piece.column(0))
            held.append(piece.column(2))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if not pieces:
        return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
    block = Block(pieces, model.parts, model.hot, True)
    told = {p: (c, s) for p, c, s in zip(*(replies.column(x).to_pylist() for x in ("part", "counts", "states")), strict=True)}
    own = Slice(block, told, model)
    size = np.diff(np.append(block.begins, len(block.word)))
    add = lambda x: np.add.reduceat(x, block.begins)
    out = [
        pa.chunked_array(ids), pa.chunked_array(held), pa.array(size.astype(np.int64)), pa.array(add((own.known[block.word] > 0).astype(np.int64))),
        pa.array(np.full(len(size), model.tokens, np.int64)), pa.array(add(own.root[block.word])), pa.array(add(own.pair[block.place])),
    ]
    trim()
    return pa.Table.from_arrays(out, names)


def _hot_states(rows: DataFrame, n: int, share: float) -> np.ndarray:
    """States with more than ``share`` of the tokens of a sample, and the start."""

    def count(batches):
        for batch in batches:
            for piece in steps(batch, "text"):
                w, c = np.unique(tokens(*joined_bytes(piece.column(0)))[0], return_counts=True)
                top = np.argsort(-c)[: int(2 / share)]
                w, c = np.append(w[top], START), np.append(c[top], c.sum())
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "n"])

    some = rows.select("text").sample(min(1.0, SAMPLE / max(n, 1)), 7).mapInArrow(count, "w long, n long")
    by = some.groupBy("w").agg(F.sum("n").alias("n"))
    # the total, as the start's row, is the first of them
    top = [(np.uint64(w & (1 << 64) - 1), c) for w, c in by.orderBy(F.desc("n")).limit(int(1 / share) + 2).collect()]
    return np.unique(np.array([w for w, c in top if c > share * top[0][1]] + [START], np.uint64))


def lm_scores(docs: DataFrame, modulus: int = 7, held: int = 2, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, part_pairs: int = PART_PAIRS, hot: float = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from the texts whose id's crc32 leaves another remainder than ``held``. Scores are log10 probabilities.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lm-scoring")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shift = max(0, int(np.log2(max(block_bytes / max(size / max(n, 1), 1), 1))))
    parts = max(1, -(-size // (6 * part_pairs)))
    states = _hot_states(rows, n, hot)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "text", "doc_id", (id_crc() % modulus == held).alias("held"))
    asked = rows.select("row", "text", F.coalesce(~F.col("held"), F.lit(False)).alias("train"))
    asked = asked.mapInArrow(partial(_ask, shift=shift, parts=parts, hot=states), "block long, part long, states binary, runs binary, words binary, counts binary")
    replies = scratch.put("replies", asked.groupBy("part").applyInArrow(lambda group: _add(group, states), _REPLY))
    known = [int(x or 0) for x in replies.where("block = -2").agg(*[F.sum(F.col("sums")[i]) for i in range(6)]).first()]
    totals = replies.where("block = -1").groupBy("state").agg(*[F.sum(F.col("sums")[i]) for i in range(4)]).collect()
    found = {np.uint64(r[0] & (1 << 64) - 1): list(r[1:]) for r in totals}
    table = np.array([found.get(k, [0, 0, 0, 0]) for k in states], np.int64).reshape(-1, 4)
    # the end is a token too, and as often as texts begin
    types = known[5] + int(np.count_nonzero((table[:, 0] > 0) & (states != START) & (states != END))) + int(table[states == START, 0].sum() > 0)
    model = Model(known[4], types, discounts(known[:4]), parts, states, table)
    blocks = rows.select(F.shiftright("row", shift).alias("block"), "doc_id", "text", F.coalesce("held", F.lit(False)).alias("held_out"))
    told = replies.where("block >= 0").select("block", "part", "counts", "states")
    walk = lambda left, right: _walk(left, right, model)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(docs: DataFrame, **how) -> DataFrame:
    """``lm_scores`` with both scores to six places, as the SQL gives them."""
    return lm_scores(docs, **how).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


#: The model in DuckDB: crc32 by its table, pairs by position, the discounts of ``discounts``.
SQL = r"""
with tab as (select list(v order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) x(i))),
d as (
  select row_number() over () as r, doc_id,
    coalesce(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::bigint) % 7, -1) as k,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' e') as w
  from documents, tab),
s as (select r, k, unnest(list_prepend(' s', w[:-2])) as h, unnest(w) as w from d),
p as (select h, w, count(*) as c from s where k not in (2, -1) group by all),
m as (select count(*) filter (c = 1) as n1, count(*) filter (c = 2) as n2, count(*) filter (c = 3) as n3, count(*) filter (c = 4) as n4, coalesce(sum(c), 0)::bigint as n, count(distinct w) as v from p),
y as (select *, case when n1 > 0 then n1 / (n1 + 2 * n2) else 0.5::double end as y from m),
g as (select n, v, [greatest(0.1, least(0.9, case when n1 > 0 and n2 > 0 then 1 - 2 * y * n2 / n1 else y end)), greatest(0.1, least(1.9, case when n2 > 0 and n3 > 0 then 2 - 3 * y * n3 / n2 else y end)),
    greatest(0.1, least(2.9, case when n3 > 0 and n4 > 0 then 3 - 4 * y * n4 / n3 else y end))]::double[] as d from y),
u as (select w, sum(c)::bigint as c from p group by w),
f as (select h, sum(c)::bigint as c, sum(d[least(c, 3)::int]) as left_over from p, g group by h),
x as (
  select s.r, coalesce(u.c, 0) as cw, (coalesce(u.c, 0) + 1) / (n + v + 1)::double as base, p.c, f.c as ch, case when p.c is null then 0 else p.c - d[least(p.c, 3)::int] end as over_, f.left_over
  from s cross join g left join u on s.w = u.w left join p on s.h = p.h and s.w = p.w left join f on s.h = f.h)
select any_value(doc_id) as doc_id, any_value(k) = 2 as held_out, count(*) as n_tokens, count(*) filter (cw > 0) as n_known, any_value(g.n) as train_tokens, round(sum(log10(base)), 6) as base_score,
  round(sum(log10(case when ch is null then base else over_ / ch + left_over / ch * base end)), 6) as score
from x join d using (r), g group by r"""
