"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic scores.

Every text becomes a fixed vector of statistics over its whole length. Random Fourier features of the standardised
vector approximate a Gaussian kernel. Tasks sum Z'Z and Z'y of their rows; the sums of at most 16 partitions are
solved here, so the driver's share depends on the number of features alone. The ridge score of rows that were set
apart is calibrated by isotonic regression. At most ``bound`` labelled rows are used for fitting; all documents are
scored.

Defined results: null and empty texts have the statistics of an empty text and get a score; without any label the
score is 0.5; repeated rows score alike; null labels are left out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import BINS, TRAIN_ROWS, Isotonic, labelled
from .common import Scratch, by_steps, id_crc, joined_bytes, text_rows, tree_sum
from .wordhash import SPACE, Words

#: Random Fourier features, the kernel's width in standardised statistics, and the ridge penalty per row.
FEATURES, WIDTH, RIDGE = 384, 4.0, 1e-4
#: Frequent short words of four languages, for the share of each in a text.
STOPS = {
    "en": "the of and to in a is that for it as was with be by on not he this are",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au ne pas",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}


def _hash_of(words: str) -> np.ndarray:
    raw = np.frombuffer(words.encode(), np.uint8)
    return np.sort(Words(raw, np.array([0, len(raw)])).hashes())


_STOPS = {k: _hash_of(v) for k, v in STOPS.items()}
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_WIDE = np.arange(256) >= 128
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in ".,;:'\"()?!-"]] = True
_SYMBOL = ~(_LETTER | _WIDE | _DIGIT | _PLAIN | SPACE)
_SYMBOL[:32] = False


def _per(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of statistics per text."""
    docs = len(at) - 1
    size = np.diff(at).astype(float)
    of_byte = np.repeat(np.arange(docs), np.diff(at))
    hist = np.bincount(of_byte * 256 + data, minlength=docs * 256).reshape(docs, 256).astype(float)
    n = np.maximum(size, 1)
    share = hist / n[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1)
    sets = [hist[:, m].sum(axis=1) for m in (_LETTER, _WIDE, _UPPER, _DIGIT, _PLAIN, _SYMBOL, SPACE)]
    marks = [hist[:, ord(c)] for c in "\n!?.,|<>{}/@#*_&$%="]

    w = Words(data, at)
    words = np.maximum(w.count, 1).astype(float)
    length = (w.ends - w.starts).astype(float)
    mean = _per(length, w.first) / words
    spread = np.sqrt(np.maximum(_per(length**2, w.first) / words - mean**2, 0))
    last = data[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    lead = data[w.starts] if len(w.starts) else np.zeros(0, np.uint8)
    h = w.hashes()
    doc = np.repeat(np.arange(docs), w.count)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    kinds = np.bincount(ds[new], minlength=docs)
    runs = np.diff(np.append(np.flatnonzero(new), len(hs)))
    most = np.zeros(docs)
    np.maximum.at(most, ds[new], runs)
    once = np.bincount(ds[new][runs == 1], minlength=docs)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pair = np.zeros(max(len(h) - 1, 0), np.uint64)
    if len(h) > 1:
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        inside = doc[:-1] == doc[1:]
        pair, pdoc = pair[inside], doc[:-1][inside]
        o = np.lexsort((pair, pdoc))
        p, q = pair[o], pdoc[o]
        fresh = np.ones(len(p), bool)
        fresh[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        pairs = np.bincount(q[fresh], minlength=docs) / np.maximum(w.count - 1, 1)
    else:
        pairs = np.ones(docs)
    stops = [_per(np.isin(h, s), w.first) / words for s in _STOPS.values()]
    ranked = np.sort(np.stack(stops), axis=0)
    lines = hist[:, 10] + 1
    columns = [
        np.log1p(size), np.log1p(w.count), mean, spread, entropy, *[s / n for s in sets], *[np.sqrt(m / n) for m in marks],
        _per(_SYMBOL[last], w.first) / words, _per(last == ord("!"), w.first) / words, _per(_PLAIN[last], w.first) / words, _per(_UPPER[lead], w.first) / words,
        kinds / words, most / words, once / words, _per(again, w.first) / words, pairs,
        *stops, ranked[-1], ranked[-2], np.log1p(lines), np.log1p(w.count / lines), np.log1p(kinds),
    ]
    return np.stack(columns, axis=1)


N_STATS = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


class Model:
    """What scoring needs; a few hundred kilobytes whatever the data."""

    def __init__(self, mean, scale, turn, shift, weight, curve):
        self.mean, self.scale, self.turn, self.shift, self.weight, self.curve = mean, scale, turn, shift, weight, curve

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.cos(x @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weight

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.round(self.curve(self.raw(stats)), 6)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, bound: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> Model:
    """Fits on labelled documents outside the held-out remainder."""
    scratch = Scratch(docs.sparkSession, "quality")

    def measure(piece):
        stats = statistics(*joined_bytes(piece.column(1)))
        return pa.RecordBatch.from_arrays([piece.column(2), piece.column(3), pa.array([x.tobytes() for x in stats], pa.binary())], ["label", "fold", "stats"])

    rows = labelled(docs, labels, label, modulus, held, bound, doc_id, text)
    rows = scratch.put("stats", rows.mapInArrow(by_steps("text", measure), "label int, fold int, stats binary").repartition(16))

    def summed(part: DataFrame, of, size: int) -> np.ndarray:
        def run(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    x = np.frombuffer(b"".join(b.column(2).to_pylist()), float).reshape(b.num_rows, -1)
                    new = of(x, np.asarray(b.column(0), float))
                    total = new if total is None else total + new
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        return tree_sum(part.mapInArrow(run, "s binary"), "s", size, sums=True)

    m = summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]), 1 + 2 * N_STATS)
    n = max(m[0], 1)
    mean = m[1 : 1 + N_STATS] / n
    scale = np.sqrt(np.maximum(m[1 + N_STATS :] / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / WIDTH, (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), Isotonic(0, 1, np.zeros(1), np.zeros(1)))
    if not m[0]:
        model.curve.value = np.full(1, 0.5)
        return model
    d = FEATURES + 1

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(y)]])

    s = summed(rows.where("fold <> 0"), normal, d * d + d + 1)
    penalty = np.full(d, RIDGE * max(s[-1], 1))
    penalty[-1] = 1e-9 * max(s[-1], 1)
    model.weight = np.linalg.solve(s[: d * d].reshape(d, d) + np.diag(penalty) + 1e-9 * np.eye(d), s[d * d : d * d + d])

    low, high = -0.5, 1.5

    def curve(x, y):
        k = Isotonic.bins(model.raw(x), low, high)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, y, BINS)])

    c = summed(rows.where("fold = 0"), curve, 2 * BINS)
    if not c[:BINS].sum():  # too few labels to set some apart
        c = summed(rows, curve, 2 * BINS)
    model.curve = Isotonic(low, high, c[:BINS], c[BINS:])
    return model


def scores(docs: DataFrame, model: Model, modulus: int = 3, held: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(piece):
        s = model.score(statistics(*joined_bytes(piece.column(1))))
        return pa.RecordBatch.from_arrays([piece.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = text_rows(docs, text, doc_id).mapInArrow(by_steps("text", run), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(id_crc() % modulus == held, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score at least ``threshold``, whole rows, decided where they are read."""

    def keep(piece):
        data = joined_bytes(piece.column(piece.schema.get_field_index(text)))
        return piece.filter(pa.array(model.score(statistics(*data)) >= threshold))

    return docs.mapInArrow(by_steps(text, keep), docs.schema)
