"""Toxicity by weak supervision.

Many voters look at a text: a seed lexicon, lexicons mined from the labelled documents (whole words and word
beginnings, by strength and by hash, copies counted once), and patterns over their hits (several different hits, dense hits). Each says yes
or nothing. A generative label model over the vote patterns estimates each voter's rates given the hidden label by
expectation maximisation; correlations of votes that the hidden label does not explain lower the weight of voters that
repeat each other. From gold labels come the mined lexicons, the class balance and a bound on each voter's rate among
clean texts; the posteriors come from the votes alone. A linear classifier over hashed words and word beginnings is
then trained on the posterior labels. Its scores are calibrated by isotonic regression over gold labels, every row
scored by a classifier that was trained without the row's fold.

At most ``bound`` labelled documents are used for fitting; whole texts of all documents are scored. Words lose
punctuation at their ends, so 'word,' counts as 'word'.

The model depends on the rows only, not on their order or partitions: copies of one text (by SHA-256) count once, with
the largest of their labels and the smallest of their folds, and are learned from in the order of their digests.

Defined results: null and empty texts get the score of a text without any hit; without labels, or without documents
that have one, every score is 0, with one kind of label 0 or 1; the same text always scores alike, repeated rows and
repeated or null ids give as many rows, null ids are not held out; null labels are left out, of several labels of one
document the largest counts; an empty table gives an empty table; a very long text is a step by itself and needs some
40 times its bytes; other columns, clashing names too, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import BINS, Isotonic, labelled
from .common import Scratch, by_steps, id_crc, joined_bytes, text_rows, tree_sum
from .wordhash import Words, mix

#: Hash buckets of features, most features of the linear classifier, most labelled rows for fitting, folds for calibration.
BUCKETS, FEATURES, TRAIN_ROWS, FOLDS = 1 << 19, 16_384, 40_000, 5
#: A text is called toxic from this score on.
THRESHOLD = 0.3
#: Seed lexicon: common insults.
SEED = "idiot moron stupid dumb loser pathetic worthless trash scum disgusting clown fool jerk ugly garbage imbecile hate shut".split()
#: Beginnings of words, in bytes.
STEMS = (4, 5, 6, 7, 8)
#: ASCII that may stand at the ends of a word and is no letter or digit.
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_SALT = tuple(np.uint64((0x6A09E667F3BCC909 * (2 * i + 1)) % 2**64) for i in range(1 + len(STEMS)))


def _pairs(data: np.ndarray, at: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Words]:
    """Distinct (document, bucket) pairs, of the buckets in ``mask`` if given."""
    w = Words(data, at)
    sums = w.sums()
    doc = np.repeat(np.arange(len(at) - 1), w.count)
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(3):
        starts += (ends - starts > 1) & _PUNCTUATION[data[starts]]
        ends -= (ends - starts > 1) & _PUNCTUATION[data[ends - 1]]
    buckets, docs = [], []
    for salt, size in zip(_SALT, (0, *STEMS), strict=True):
        if size:
            use = np.flatnonzero(ends - starts > size)
            h = w.hashes(sums=sums, starts=starts[use], ends=starts[use] + size)
            d = doc[use]
        else:
            h, d = w.hashes(sums=sums, starts=starts, ends=ends), doc
        b = (mix(h ^ salt) & np.uint64(BUCKETS - 1)).astype(np.int64)
        if mask is not None:
            hit = mask[b]
            b, d = b[hit], d[hit]
        buckets.append(b)
        docs.append(d)
    key = np.unique(np.concatenate(docs) * BUCKETS + np.concatenate(buckets))
    return key // BUCKETS, key % BUCKETS, w


def _seed_buckets() -> np.ndarray:
    raw = np.frombuffer(" ".join(SEED).encode(), np.uint8)
    return (mix(Words(raw, np.array([0, len(raw)])).hashes() ^ _SALT[0]) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Voters:
    """Which voter each bucket belongs to, and the pattern voters over hits. Bit j of a vote pattern is voter j."""

    #: seed, then mined voters in three strengths by four hash classes, then three patterns.
    N = 1 + 12 + 3

    def __init__(self, toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float):
        odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
        chance = (toxic + clean) * n_toxic / max(n_toxic + n_clean, 1)
        excess = (toxic - chance) / np.sqrt(chance + 0.25)
        common = (toxic >= 3) & (odds >= 2.5)
        self.of = np.full(BUCKETS, -1, np.int8)
        strength = np.digitize(excess, [4.0, 7.0, 12.0]) - 1
        mined = common & (strength >= 0)
        self.of[mined] = (1 + strength[mined] * 4 + (np.flatnonzero(mined) % 4)).astype(np.int8)
        self.seed = np.zeros(BUCKETS, bool)
        self.seed[_seed_buckets()] = True
        self.strong = mined

    def patterns(self, doc: np.ndarray, bucket: np.ndarray, n_docs: int, n_words: np.ndarray) -> np.ndarray:
        out = np.zeros(n_docs, np.int64)
        for j in range(1, 13):
            out[np.unique(doc[self.of[bucket] == j])] |= 1 << j
        out[np.unique(doc[self.seed[bucket]])] |= 1
        hits = np.bincount(doc[self.strong[bucket]], minlength=n_docs)
        for j, yes in enumerate((hits >= 2, hits >= 4, hits * 100 >= np.maximum(n_words, 1))):
            out[yes & (hits > 0)] |= 1 << (13 + j)
        return out


def label_model(counts: np.ndarray, balance: float | None = None, most_false: np.ndarray | float = 0.5, rounds: int = 60) -> tuple[np.ndarray, dict]:
    """Posterior of the hidden label for each vote pattern, from how often each occurs; and what was estimated.

    ``balance`` is the share of toxic texts if it is known, else it is estimated too; ``most_false`` bounds each voter's
    rate among clean texts, so that texts with a single hit do not make up a clean class of their own.
    """
    seen = np.flatnonzero(counts)
    n, votes = counts[seen], (seen[:, None] >> np.arange(Voters.N)) & 1
    prior, yes, no = 0.1 if balance is None else balance, np.full(Voters.N, 0.5), np.full(Voters.N, 0.05)
    weight, corr = np.full(Voters.N, 1.0), np.eye(Voters.N)
    spread = n / max(n.sum(), 1)
    rate = spread @ votes
    no = np.clip(rate * 0.5, 1e-4, np.minimum(most_false, 0.3))
    post = np.zeros(len(seen))
    for r in range(rounds):
        llr = np.where(votes == 1, np.log(yes / no), np.log((1 - yes) / (1 - no)))
        logit = np.log(prior / (1 - prior)) + llr @ weight
        post = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        a, b = n * post, n * (1 - post)
        if balance is None:
            prior = np.clip((a.sum() + 1) / (n.sum() + 10), 1e-3, 0.5)
        yes = np.clip((a @ votes + 1) / (a.sum() + 2), 1e-3, 1 - 1e-3)
        no = np.clip((b @ votes + 0.1) / (b.sum() + 2), 1e-5, np.minimum(most_false, yes * 0.9))
        if r in (10, 20, 30):  # correlations that the label does not explain
            dev = votes - (post[:, None] * yes + (1 - post[:, None]) * no)
            cov = (dev * n[:, None]).T @ dev / max(n.sum(), 1)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            corr = cov / sd / sd[:, None]
            over = np.maximum(corr, 0)
            np.fill_diagonal(over, 0)
            weight = 1 / (1 + over.sum(axis=1))
    out = np.full(len(counts), prior)
    out[seen] = post
    return out, {"prior": prior, "yes": yes, "no": no, "correlations": corr, "weights": weight}


class Model:
    """Weights over buckets and a calibration curve: two megabytes whatever the data."""

    def __init__(self, weight: np.ndarray, bias: float, curve: Isotonic, voters: dict | None = None):
        self.weight, self.bias, self.curve, self.voters = weight.astype(np.float32), bias, curve, voters
        self.mask = self.weight != 0

    def raw(self, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(doc, self.weight[bucket], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        doc, bucket, _ = _pairs(data, at, self.mask)
        return np.round(self.curve(self.raw(doc, bucket, len(at) - 1)), 6)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2, bound: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", epochs: int = 6) -> Model:
    """Fits on labelled documents outside the held-out remainder."""
    scratch = Scratch(docs.sparkSession, "toxicity")

    def extract(piece):
        doc, bucket, w = _pairs(*joined_bytes(piece.column(1)))
        ends = np.zeros(piece.num_rows + 1, np.int32)
        ends[1:] = np.cumsum(np.bincount(doc, minlength=piece.num_rows))
        own = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
        return pa.RecordBatch.from_arrays([piece.column(2), piece.column(3), pa.array(w.count.astype(np.int32)), own, piece.column(4)], ["label", "fold", "words", "buckets", "digest"])

    rows = labelled(docs, labels, label, modulus, held, bound, doc_id, text).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = rows.mapInArrow(by_steps("text", extract), "label int, fold int, words int, buckets array<int>, digest binary")
    every = scratch.put("features", rows.withColumn("row", F.monotonically_increasing_id()))
    # copies of one text would make its own words look telling; only digests and numbers are shuffled
    kept = scratch.put("kept", every.groupBy("digest").agg(F.max("label").alias("label"), F.min("fold").alias("fold"), F.min("row").alias("row")).drop("digest"))
    rows = scratch.put("distinct", every.select("words", "buckets", "digest", "row").join(kept, "row").select("label", "fold", "words", "buckets", "digest"))
    scratch.drop(every)

    def arrays(batch):
        lists = batch.column(3)
        ends = np.asarray(lists.offsets, np.int64)
        return np.asarray(batch.column(0)), np.asarray(batch.column(2)), np.repeat(np.arange(batch.num_rows), np.diff(ends)), np.asarray(lists.values)[ends[0] : ends[-1]].astype(np.int64)

    def summed(part: DataFrame, of, size: int, dtype="float64") -> np.ndarray:
        def run(batches):
            total = np.zeros(size, dtype)
            for b in batches:
                if b.num_rows:
                    of(total, *arrays(b))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        return tree_sum(part.mapInArrow(run, "s binary"), "s", size, dtype, sums=True)

    def count(total, y, words, doc, bucket):
        total[: 2 * BUCKETS] += np.bincount(bucket + BUCKETS * (y[doc] == 1), minlength=2 * BUCKETS).astype(np.float32)
        total[-2:] += (np.sum(y != 1), np.sum(y == 1))

    c = summed(rows, count, 2 * BUCKETS + 2, "float32").astype(float)
    clean, toxic, (n_clean, n_toxic) = c[:BUCKETS], c[BUCKETS:-2], c[-2:]
    if not n_toxic or not n_clean:
        empty = Isotonic(0, 1, np.zeros(1), np.zeros(1))
        empty.value = np.full(1, 1.0 if n_toxic else 0.0)
        return Model(np.zeros(BUCKETS), 0.0, empty)
    voters = Voters(toxic, clean, n_toxic, n_clean)

    def tally(total, y, words, doc, bucket):
        total += np.bincount(voters.patterns(doc, bucket, len(y), words) + (y == 1) * (1 << Voters.N), minlength=2 << Voters.N)

    tallied = summed(rows, tally, 2 << Voters.N).reshape(2, -1)
    bits = (np.arange(1 << Voters.N)[:, None] >> np.arange(Voters.N)) & 1
    most_false = (1.5 * (tallied[0] @ bits) + 1) / (tallied[0].sum() + 1)
    posterior, told = label_model(tallied.sum(axis=0), float(np.clip(n_toxic / (n_toxic + n_clean), 1e-3, 0.5)), most_false)

    # features that tell most: the largest standardised difference of rates
    rate = (toxic + clean) / (n_toxic + n_clean)
    z = np.abs(toxic / n_toxic - clean / n_clean) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    z *= np.sqrt(n_toxic * n_clean / (n_toxic + n_clean))  # in standard errors
    z[(toxic + clean < 3) | (z < 2.5)] = 0
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] > 0]
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def examples(batches):
        for b in batches:
            if b.num_rows:
                y, words, doc, bucket = arrays(b)
                q = posterior[voters.patterns(doc, bucket, len(y), words)]
                own = place[bucket]
                use = own >= 0
                ends = np.append(0, np.cumsum(np.bincount(doc[use], minlength=len(y)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(4), b.column(1), b.column(0), pa.array(q), pa.ListArray.from_arrays(pa.array(ends), pa.array(own[use]))], ["digest", "fold", "label", "q", "own"])

    told_rows = scratch.put("examples", rows.mapInArrow(examples, "digest binary, fold int, label int, q double, own array<int>"))
    n_features, start = len(chosen), float(np.log(n_toxic / n_clean))

    def learn(group: pa.Table) -> pa.Table:
        """One classifier, on all rows but those of fold ``part``; the group is at most ``bound`` texts with their chosen features."""
        group = group.sort_by("digest").combine_chunks()
        q, own = group.column("q").to_numpy(), group.column("own").combine_chunks()
        at, flat = np.asarray(own.offsets, np.int64), np.asarray(own.values)
        data = [(float(t), flat[i:j]) for t, i, j in zip(q, at[:-1], at[1:], strict=True)]
        weight, bias, seen_w, seen_b = np.zeros(n_features), start, np.full(n_features, 1e-2), 1e-2
        for _ in range(epochs):
            for t, mine in data:
                p = 1 / (1 + np.exp(-min(max(bias + weight[mine].sum(), -30.0), 30.0)))
                g = p - t
                seen_b += g * g
                bias -= 0.3 * g / np.sqrt(seen_b)
                seen_w[mine] += g * g
                weight[mine] -= 0.3 * g / np.sqrt(seen_w[mine])
        return pa.table({"part": group.column("part").slice(0, 1), "weights": pa.array([np.append(weight, bias).tobytes()], pa.binary())})

    parts = told_rows.select("*", F.explode(F.array(*[F.lit(k) for k in range(FOLDS + 1)])).alias("part")).where("fold <> part")
    # FOLDS + 1 rows of weights
    learned = {r.part: np.frombuffer(r.weights) for r in parts.groupBy("part").applyInArrow(learn, "part int, weights binary").collect()}
    none = np.append(np.zeros(n_features), start)
    by_fold = np.array([learned.get(k, none) for k in range(FOLDS + 1)])

    def curve(batches):
        total = np.zeros(2 * BINS)
        for b in batches:
            if b.num_rows:
                own = b.column(4)
                at = np.asarray(own.offsets, np.int64)
                doc, mine = np.repeat(np.arange(b.num_rows), np.diff(at)), np.asarray(own.values)[at[0] : at[-1]]
                fold, y = np.asarray(b.column(1)), np.asarray(b.column(2))
                raw = by_fold[fold, -1] + np.bincount(doc, by_fold[fold[doc], mine], minlength=b.num_rows)
                k = Isotonic.bins(1 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)
                total += np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, y == 1, BINS)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    own = tree_sum(told_rows.mapInArrow(curve, "s binary"), "s", 2 * BINS, sums=True)
    weight = np.zeros(BUCKETS)
    weight[chosen] = by_fold[FOLDS, :-1]
    return Model(weight, float(by_fold[FOLDS, -1]), Isotonic(0, 1, own[:BINS], own[BINS:]), told)


def scores(docs: DataFrame, model: Model, modulus: int = 4, held: int = 2, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(piece):
        s = model.score(*joined_bytes(piece.column(1)))
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = text_rows(docs, text, doc_id).mapInArrow(by_steps("text", run), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(id_crc() % modulus == held, F.lit(False)).alias("held_out"), "score", "predicted")
