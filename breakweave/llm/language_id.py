"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with single boundaries between words. Tasks count the 4-grams of each language over
all training texts; counts are summed by shuffle. From the 4-gram counts follow the continuation counts of the lower
orders and one interpolated Kneser-Ney model per language. Models are stored together in sorted hash arrays: for each
order, the sorted hashes of all n-grams that any language knows and one row of log probabilities per n-gram. The
language with the lowest cross-entropy per symbol wins. Its margin is turned into a probability by isotonic
calibration, and a text is rejected if its cross-entropy is above that which all but ``1 - ACCEPT`` of a language's own
texts stay below. Both come from all training texts, and each is judged by a model that has not seen it: texts are
halved by a hash of the id, and each half is judged by the model of the other one.

Every n-gram of the training texts stays in the model. Beyond ``GRAMS`` (language, 4-gram) rows the model is cut into
shards by the two middle symbols of a 4-gram: all that a 4-gram's probability needs, its context, its 3-gram and 2-gram
and their contexts, lies in one shard, with discounts and continuation counts of the whole table. Shards are built one
after the other and broadcast, and a task loads one at a time, so driver and tasks hold about one shard however large
the model is.

Defined results: a null text or one without letters is 'und' with score 0 and rejected; with nothing to learn from,
every text is 'und'; rows without language or id are not learned from; a language none of whose texts the other
half's model gets right rejects nothing; of languages with the same cross-entropy the first by name wins; repeated rows and repeated or null ids give as many rows, null ids are
not held out; an empty table gives an empty table; a very long text is a step by itself and needs some 40 times its
bytes; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import BINS, Isotonic
from .common import Scratch, id_crc, joined_bytes, steps, tree_sum
from .wordhash import mix

ORDER = 4
#: Most (language, 4-gram) rows of a shard of the model.
GRAMS = 1_000_000
#: The share of a language's own unseen texts that must not be rejected, the cross-entropies (bits) at which that is
#: told apart, and the highest of them.
ACCEPT, LEVELS, HIGHEST = 0.999, 4096, 32.0
_PIECE = 1 << 20
_symbols: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Code point to symbol: 0 if not a letter, else the lower-case letter in 16 bits."""
    if not _symbols:
        out = np.zeros(0x110000, np.uint16)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                x = ord(low) if len(low) == 1 else i
                out[i] = x if 0 < x < 0xD800 else 0xD800 + x % 0x2800
        _symbols.append(out)
    return _symbols[0]


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each after three boundaries, and where each text's own begin and end."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[at]
    s = _table()[np.minimum(points, 0x10FFFF)]
    before = np.zeros(len(s), bool)
    before[1:] = s[:-1] != 0
    begin = at[:-1][at[:-1] < len(s)]
    before[begin] = False
    keep = (s != 0) | before
    total = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    size = total[at[1:]] - total[at[:-1]]
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 3, out=first[1:])
    out = np.zeros(first[-1], np.uint16)
    doc = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(doc)) + 3 * (doc + 1)] = s[keep]
    return out, first


def grams(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each symbol of each text, 16 bits a symbol, and where each text's begin."""
    wide = s.astype(np.uint64)
    key = wide.copy()
    for j in range(1, ORDER):
        key[j:] |= wide[:-j] << np.uint64(16 * j)
    own = np.ones(len(s), bool)
    for j in range(3):
        own[first[:-1] + j] = False
    return key[own], first - 3 * np.arange(len(first))


class SortedHashes:
    """Keys in the order of their hashes, found through an index on the leading bits."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys)
        h = mix(keys)
        order = np.argsort(h)
        self.keys, self.hashes = keys[order], h[order]
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        self.start = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is missing."""
        h = mix(keys)
        b = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[b], self.start[b + 1]
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero(at < end)
        pos = at[todo]
        while len(todo):
            hit = self.hashes[pos] == h[todo]
            out[todo[hit]] = pos[hit]
            pos = pos + 1
            more = ~hit & (pos < end[todo])
            todo, pos = todo[more], pos[more]
        return out


def _discount(n1: int, n2: int) -> float:
    return float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.1, 0.9))


def _kneser_ney(keys: np.ndarray, counts: np.ndarray, low: dict[int, tuple[np.ndarray, np.ndarray]] | None = None, discounts: dict[int, float] | None = None) -> list[dict]:
    """Per order 1 to 4: n-grams, their interpolated probability, contexts and their back-off weight, for one language.

    A shard gives what its own 4-grams don't tell: n-grams and continuation counts of the ``low`` orders, and discounts.
    """
    levels = [(keys, counts.astype(float))]
    for order in range(ORDER - 1, 0, -1):
        if low and order in low:
            levels.append((low[order][0], low[order][1].astype(float)))
            continue
        keys_of, n = np.unique(levels[-1][0] & np.uint64((1 << (16 * order)) - 1), return_counts=True)
        levels.append((keys_of, n.astype(float)))
    out: list[dict] = []
    for order, (k, c) in zip(range(1, ORDER + 1), reversed(levels), strict=True):
        d = discounts[order] if discounts else _discount(np.sum(c == 1), np.sum(c == 2))
        ctx, inv = np.unique(k >> np.uint64(16), return_inverse=True)
        total, kinds = np.bincount(inv, c), np.bincount(inv)
        back = d * kinds / total
        if order == 1:
            lower = np.full(len(k), 1 / 65536)
        else:
            below = out[-1]
            suffix = k & np.uint64((1 << (16 * (order - 1))) - 1)
            lower = below["p"][np.searchsorted(below["k"], suffix)]
        p = np.maximum(c - d, 0) / total[inv] + back[inv] * lower
        out.append({"k": k, "p": p, "ctx": ctx, "back": back})
    return out


class Model:
    """All languages' models over shared sorted hash arrays, with calibration."""

    #: Text bytes that are judged at a time.
    piece = _PIECE

    def __init__(self, langs: list[str], tables: list[list[dict]]):
        self.langs = langs
        self.grams: list[SortedHashes] = []
        self.ctxs: list[SortedHashes] = []
        self.logp: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        n = len(langs)
        for order in range(1, ORDER + 1):
            own = [t[order - 1] for t in tables]
            ctxs = SortedHashes(np.concatenate([t["ctx"] for t in own]))
            back = np.zeros((len(ctxs.keys), n), np.float32)
            for j, t in enumerate(own):
                back[ctxs.find(t["ctx"]), j] = np.log(t["back"])
            every = SortedHashes(np.concatenate([t["k"] for t in own]))
            logp = self._lower(order, every.keys, ctxs, back, n)
            for j, t in enumerate(own):
                logp[every.find(t["k"]), j] = np.log(t["p"])
            self.grams.append(every)
            self.ctxs.append(ctxs)
            self.back.append(back)
            self.logp.append(logp.astype(np.float32))
        self.curve, self.limit = None, np.full(n, np.inf)

    def _lower(self, order: int, keys: np.ndarray, ctxs: SortedHashes, back: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities by backing off from ``order``."""
        at = ctxs.find(keys >> np.uint64(16))
        out = np.where((at >= 0)[:, None], back[at], 0).astype(np.float32)
        if order == 1:
            return out - np.float32(np.log(65536))
        return out + self.log_probs(keys & np.uint64((1 << (16 * (order - 1))) - 1), order - 1)

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of each n-gram's last symbol in every language."""
        at = self.grams[order - 1].find(keys)
        out = self.logp[order - 1][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[miss] = self._lower(order, keys[miss], self.ctxs[order - 1], self.back[order - 1], len(self.langs))
        return out

    def entropies(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits per symbol of each text in each language, and the number of symbols."""
        keys, first = grams(*symbols(data, at))
        size = np.diff(first)
        out = np.zeros((len(size), len(self.langs)))
        some = np.flatnonzero(size)
        if len(some):
            out[some] = -np.add.reduceat(self.log_probs(keys), first[some], axis=0, dtype=np.float64) / size[some][:, None] / np.log(2)
        return out, size

    def judge(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: best language or -1, raw margin in [0, 1), its cross-entropy, and whether it is rejected."""
        ce, size = self.entropies(data, at)
        best = np.where(size > 0, ce.argmin(axis=1), -1)
        two = np.sort(ce, axis=1)
        margin = two[:, 1] - two[:, 0] if ce.shape[1] > 1 else np.ones(len(ce))
        raw = np.where(size > 0, 1 - np.exp(-margin * np.sqrt(np.maximum(size, 1)) / 4), 0)
        rejected = (best < 0) | (two[:, 0] > self.limit[best])
        return best, raw, two[:, 0], rejected


def _middle(keys: np.ndarray) -> np.ndarray:
    """The two middle symbols of 4-grams, the third one first."""
    return (keys >> np.uint64(16) & np.uint64(0xFFFF)) << np.uint64(16) | keys >> np.uint64(32) & np.uint64(0xFFFF)


class Sharded(Model):
    """A model in shards: broadcast models of the 4-grams whose middle symbols lie between two of ``cuts``."""

    #: Larger, so that loading shards costs little beside judging.
    piece = 4 * _PIECE

    def __init__(self, langs: list[str], cuts: list[int], shards: list):
        self.langs, self.cuts, self.shards = langs, np.array(cuts, np.uint64), shards
        self.curve, self.limit = None, np.full(len(langs), np.inf)

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order != ORDER:
            raise ValueError("shards are found by 4-grams")
        of = np.searchsorted(self.cuts, _middle(keys), "right")
        out = np.empty((len(keys), len(self.langs)), np.float32)
        by = np.argsort(of, kind="stable")
        first = np.searchsorted(of[by], np.arange(len(self.shards) + 1))
        for k, shard in enumerate(self.shards):
            own = by[first[k] : first[k + 1]]
            if len(own):
                out[own] = shard.value.log_probs(keys[own])
                shard.__dict__.pop("_value", None)  # the next shard takes its place
        return out


def _texts(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *more)


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = GRAMS) -> Model | None:
    """Learns from all texts with a language outside the held-out remainder. None if there are none."""
    scratch = Scratch(docs.sparkSession, "language-id")
    train = _texts(docs, doc_id, text, F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & (F.col("doc_id").isNotNull()) & (id_crc() % modulus != held))
    train = train.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))

    def count(batches):
        held_: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(name, keys, n):
            if name in held_:
                keys, n = np.concatenate([held_[name][0], keys]), np.concatenate([held_[name][1], n])
                keys, inv = np.unique(keys, return_inverse=True)
                n = np.bincount(inv, n).astype(np.int64)
            held_[name] = (keys, n)

        def out():
            for name, (keys, n) in held_.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held_.clear()

        for batch in batches:
            for piece in steps(batch, "text", _PIECE):
                keys, first = grams(*symbols(*joined_bytes(piece.column(1))))
                names = np.array(piece.column(2).to_pylist(), object)
                of = np.repeat(np.arange(len(names)), np.diff(first))
                for name in set(names):
                    add(name, *np.unique(keys[(names == name)[of]], return_counts=True))
                if sum(len(k) for k, _ in held_.values()) > 4_000_000:
                    yield from out()
        yield from out()

    name = F.concat(F.col("half").cast("string"), "lang").alias("lang")
    counted = train.select("doc_id", "text", name).mapInArrow(count, "lang string, gram long, n long")
    first = F.sum(F.when(F.col("lang").startswith("0"), F.col("n")).otherwise(0))
    counted = scratch.put("grams", counted.groupBy(F.substring("lang", 2, 1 << 30).alias("lang"), "gram").agg(F.sum("n").alias("n"), first.alias("n0")))
    langs = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not langs:
        return None
    number = F.create_map(*[F.lit(x) for i, v in enumerate(langs) for x in (v, i)])
    counted = counted.select(number[F.col("lang")].alias("l"), "gram", "n", "n0")

    def build(rows: DataFrame) -> Model:
        return Model(langs, [_kneser_ney(*x) for x in _by_language(rows, len(langs))]) if rows.count() <= most else _sharded(scratch, rows, langs, most)

    n = len(langs)

    def calibrate(batches, model):
        total = np.zeros(2 * BINS + LEVELS * n)
        for batch in batches:
            for piece in steps(batch, "text", model.piece):
                best, raw, ce, _ = model.judge(*joined_bytes(piece.column(1)))
                true = np.array([langs.index(x) if x in langs else -2 for x in piece.column(2).to_pylist()])
                use = best >= 0
                k = Isotonic.bins(raw[use], 0, 1)
                right = best[use] == true[use]
                total[: 2 * BINS] += np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, right, BINS)])
                level = np.minimum((ce[use][right] * (LEVELS / HIGHEST)).astype(np.int64), LEVELS - 1)
                total[2 * BINS :] += np.bincount(best[use][right] * LEVELS + level, minlength=LEVELS * n)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    s = np.zeros(2 * BINS + LEVELS * n)
    for half, own in enumerate((F.col("n0"), F.col("n") - F.col("n0"))):
        other = build(counted.select("l", "gram", own.alias("n")).where("n > 0"))
        unseen = train.where(F.col("half") != half).select("doc_id", "text", "lang")
        s += tree_sum(unseen.mapInArrow(partial(calibrate, model=other), "s binary"), "s", len(s), sums=True)
    model = build(counted.select("l", "gram", "n"))
    model.curve = Isotonic(0, 1, s[:BINS], s[BINS : 2 * BINS])
    model.counted = int(s[:BINS].sum())
    below = np.cumsum(s[2 * BINS :].reshape(n, LEVELS), axis=1)
    # the first level's end that at least the accepted share stays below, and a little room for small folds
    level = (below < ACCEPT * below[:, -1:]).sum(axis=1) + 1
    model.limit = np.where(below[:, -1] > 0, level * (HIGHEST / LEVELS) + 1 / np.sqrt(np.maximum(below[:, -1], 1)), np.inf)
    return model


def _by_language(rows: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted n-grams and counts of each language."""
    t = rows.select("l", "gram", "n").toPandas()
    l, keys, counts = t.l.to_numpy(), t.gram.to_numpy(np.int64).view(np.uint64), t.n.to_numpy(np.int64)
    order = np.lexsort((keys, l))
    at = np.searchsorted(l[order], np.arange(n + 1))
    return [(keys[order[a:b]], counts[order[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _sharded(scratch: Scratch, counted: DataFrame, langs: list[str], most: int) -> Sharded:
    """The model of all ``counted`` rows (l, gram, n) in shards of ``most`` rows; more where two middle symbols have more."""
    levels = {ORDER: counted}
    for order in range(ORDER - 1, 0, -1):
        low = levels[order + 1].groupBy("l", F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1)).alias("gram"))
        levels[order] = scratch.put(f"order{order}", low.agg(F.count(F.lit(1)).alias("n")))
    discounts: list[dict[int, float]] = [{} for _ in langs]
    for order, t in levels.items():
        for l, n1, n2 in t.groupBy("l").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect():
            discounts[l][order] = _discount(n1, n2)
    third, second = (F.shiftrightunsigned("gram", k).bitwiseAND(F.lit(0xFFFF)) for k in (16, 32))
    placed = counted.withColumn("middle", F.shiftleft(third, 16).bitwiseOR(second))
    per = placed.groupBy("middle").agg(F.count(F.lit(1)).alias("rows")).orderBy("middle").toPandas()
    cuts, held = [], 0
    for middle, rows in zip(per.middle.tolist(), per.rows.tolist(), strict=True):
        if held and held + rows > most:
            cuts.append(middle)
            held = 0
        held += rows
    one = _by_language(levels[1], len(langs))
    shards = []
    for a, b in zip([0, *cuts], [*cuts, 1 << 32], strict=True):
        own = _by_language(placed.where(F.col("middle").between(a, b - 1)), len(langs))
        two = _by_language(levels[2].where(F.shiftrightunsigned("gram", 16).between(a >> 16, (b - 1) >> 16)), len(langs))
        tables = [_kneser_ney(*own[j], {2: two[j], 1: one[j]}, discounts[j]) for j in range(len(langs))]
        shards.append(scratch.spark.sparkContext.broadcast(Model(langs, tables)))
    return Sharded(langs, cuts, shards)


def identify(docs: DataFrame, model: Model | None, modulus: int = 4, held: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every document."""

    def run(batches):
        for batch in batches:
            for piece in steps(batch, "text", model.piece if model else _PIECE):
                m = piece.num_rows
                if model is None:
                    name, score, ce, rejected = ["und"] * m, np.zeros(m), np.zeros(m), np.ones(m, bool)
                else:
                    best, raw, ce, rejected = model.judge(*joined_bytes(piece.column(1)))
                    name = [model.langs[i] if i >= 0 else "und" for i in best]
                    score = np.where(best >= 0, model.curve(raw), 0.0)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(name), pa.array(np.round(score, 6)), pa.array(np.round(ce, 4)), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    out = _texts(docs, doc_id, text).mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.select("doc_id", F.coalesce(id_crc() % modulus == held, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
