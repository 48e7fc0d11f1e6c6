"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last eight bytes says so, so equal passages give equal chunks wherever they
stand. A worker encodes each distinct chunk once and keeps it in caches of bounded bytes that outlive the task. A cut
falls anywhere, also inside a word; the join of two chunks is repaired by re-encoding.

Two kinds of joins. Where the tokenizer drops white space (its vocabulary and probes of the library are asked, nothing
is assumed), a space or line feed is a point where encoding the sides apart agrees with encoding them together: the
bytes from the last such point of the left chunk to the first of the right one are encoded anew, and within chunks
the runs between these points are encoded once per worker too. Everywhere else - tokenizers whose pieces hold spaces,
and passages without spaces - a window of both sides is re-encoded and widened until it agrees with each side's own
encoding on ``AGREE`` consecutive pieces of the tokenizer's pattern, whole and away from the window's edges; the ids
are the left side's up to the agreement, the window's between, the right side's after it. Where no window agrees the
passage is encoded whole, and one in ``AUDIT`` repaired passages is encoded whole too and must be equal, else all are.

Decoding goes from ids: by the library's decode, or, for a tokenizer without a decoder, by its table of token strings.

Defined results: null and empty texts have no tokens and decode to ''; special tokens that stand in a text become
their ids, as the library does; repeated rows and repeated or null ids give as many rows; an empty table gives an
empty table; a very long text is worked through chunk by chunk, and what it needs beside its own bytes is its ids;
other columns, clashing names too, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_steps, joined_bytes, text_rows, worker_caches

#: A chunk ends where the top bits of the rolling hash are zero: 1 in 2**CUT_BITS bytes on average.
CUT_BITS = 10
_CUT = np.uint64(0xD6E8FEB86659FD93)
#: A chunk has this many bytes at least, but for the last of a text, and at most.
SHORTEST, LONGEST = 128, 1 << 16
#: Bounds of a worker's caches in bytes, what an entry costs beside its own bytes, and the longest run that is looked up as one.
WORD_BYTES, CHUNK_BYTES, ENTRY, LONG = 96 << 20, 32 << 20, 300, 512
#: Characters of the first window on each side of a join, bytes of the chunks that a join may reach over, pieces that
#: must agree, and how many repaired passages there are to one that is checked.
WINDOW, REACH, AGREE, AUDIT = 48, 1 << 13, 2, 64
#: Both sides of a join of which a tokenizer that drops white space must make the same, apart and together.
_PROBES = ("a", "the", "Word", "don't", "'s", "12", "3.5", "!?", "--", "é", "e\u0301", "\u0301x", "日本", "ß", "İ", "Σ", "_", "(a", "x)")


def cut_points(data: np.ndarray, first: int, last: int) -> list[int]:
    """Where the chunks of data[first:last] end, always at the start of a character; the last is ``last``."""
    n = last - first
    if n <= 8:
        return [last] if n else []
    window = np.ndarray((n - 7,), np.uint64, data, first, (1,))
    at = np.flatnonzero((window * _CUT) >> np.uint64(64 - CUT_BITS) == 0) + first + 8
    for _ in range(3):
        inside = at[at < last]
        at = np.concatenate([inside + ((data[inside] & 0xC0) == 0x80), at[at >= last]])
    cuts, before = [], first
    for end in [*np.unique(at[at < last]).tolist(), last]:
        # no cut for long: the next one is a fixed way from the last, at the start of a character
        while end - before > LONGEST:
            before += LONGEST
            while (data[before] & 0xC0) == 0x80:
                before -= 1
            cuts.append(before)
        if end - before >= SHORTEST or end == last:
            cuts.append(end)
            before = end
    return cuts


class Segment:
    """A chunk's own encoding: ids, and of each piece of the tokenizer's pattern where it begins and ends and its first token."""

    __slots__ = ("ids", "starts", "ends", "tokens", "chars", "cost")

    def __init__(self, encoding, chars: int):
        self.ids, self.chars = np.array(encoding.ids, np.int32), chars
        piece = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
        spans = np.array(encoding.offsets, np.int64).reshape(-1, 2)
        new = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (piece[1:] < 0))) if len(piece) else np.zeros(0, np.int64)
        self.tokens = np.append(new, len(piece))
        self.starts = np.minimum.reduceat(spans[:, 0], new) if len(new) else new
        self.ends = np.maximum.reduceat(spans[:, 1], new) if len(new) else new
        self.cost = ENTRY + 4 * len(self.ids) + 24 * len(self.starts)

    def same(self, i: int, other: Segment, j: int, shift: int) -> bool:
        """Whether piece i equals the other's piece j, whose place is ``shift`` characters further on here."""
        if self.starts[i] != other.starts[j] + shift or self.ends[i] != other.ends[j] + shift:
            return False
        return np.array_equal(self.ids[self.tokens[i] : self.tokens[i + 1]], other.ids[other.tokens[j] : other.tokens[j + 1]])


def agreement(left: Segment, right: Segment, window: Segment, wide_left: int, begin: int) -> tuple[int, int, int, int] | None:
    """Token places (in left, in window, in window, in right) where a window over a join agrees with both sides, or None.

    The window holds the last ``wide_left`` characters of the left side. Its first and last pieces may be torn and don't
    count, nor do pieces that touch the join, nor those of the left side before its token ``begin``.
    """
    at = {int(s): i for i, s in enumerate(left.starts) if left.tokens[i] >= begin}
    shift, before = left.chars - wide_left, None
    for j in range(1, len(window.starts) - AGREE + 1):
        if window.ends[j + AGREE - 1] >= wide_left:
            break
        i = at.get(int(window.starts[j]) + shift)
        if i is not None and i + AGREE <= len(left.starts) and all(left.same(i + k, window, j + k, shift) for k in range(AGREE)):
            before = (int(left.tokens[i + AGREE]), int(window.tokens[j + AGREE]))
            break
    at = {int(s): i for i, s in enumerate(right.starts)}
    after = None
    for j in range(len(window.starts) - 1 - AGREE, -1, -1):
        if window.starts[j] <= wide_left:
            break
        i = at.get(int(window.starts[j]) - wide_left)
        if i is not None and i + AGREE <= len(right.starts) and all(right.same(i + k, window, j + k, -wide_left) for k in range(AGREE)):
            after = (int(window.tokens[j]), int(right.tokens[i]))
            break
    return (*before, *after) if before and after and before[1] <= after[0] else None


class Encoder:
    """One tokenizer with its caches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.number = [b"%d " % i for i in range(size)]
        self.string = [(self.tokenizer.id_to_token(i) or "").encode() + b" " for i in range(size)]
        # without a decoder the library joins token strings by spaces
        described = json.loads(self.tokenizer.to_str())
        self.plain_decode, self.word_end = described["decoder"] is None, described["model"].get("end_of_word_suffix") or ""
        self.splits = self._splits_at_spaces()
        self.words: dict[bytes, tuple[int, bytes, bytes]] = {b"": (0, b"", b"")}
        self.word_bytes = 0
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_bytes = 0
        self.segments: dict[bytes, Segment] = {}
        self.segment_bytes = 0
        self.repaired, self.exact = 0, True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _splits_at_spaces(self) -> bool:
        """Whether spaces and line feeds are points where encodings of the sides agree with the encoding of the whole."""
        pieces = (t.removesuffix(self.word_end) for t in self.tokenizer.get_vocab())
        if not self.plain_decode or any(len(t) > 1 and any(mark in t for mark in (" ", "\n", "Ġ", "Ċ", "▁")) for t in pieces):
            return False
        return all(self._ids(a + gap + b) == self._ids(a) + self._ids(b) for a in _PROBES for b in _PROBES for gap in (" ", "\n"))

    def learn(self, words: set[bytes]) -> None:
        """Encodes the runs that the cache lacks; a full cache starts anew."""
        new = [w for w in words if w not in self.words]
        if self.word_bytes > WORD_BYTES:
            self.words, self.word_bytes = {b"": (0, b"", b"")}, 0
            new = [w for w in words if w]
        for first in range(0, len(new), 20_000):
            part = new[first : first + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self.words[w] = told = self._told(e.ids)
                self.word_bytes += len(w) + len(told[1]) + len(told[2]) + ENTRY

    def _told(self, ids) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids and what they decode to, each with a space behind."""
        numbers = b"".join([self.number[i] for i in ids])
        if self.plain_decode:
            return len(ids), numbers, b"".join([self.string[i] for i in ids])
        return len(ids), numbers, self.tokenizer.decode(list(ids), skip_special_tokens=False).encode() + b" "

    def segment(self, chunk: bytes) -> Segment:
        """A chunk's own encoding, from the cache if it is there."""
        if chunk not in self.segments:
            text = chunk.decode("utf-8", "replace")
            self.segments[chunk] = made = Segment(self.tokenizer.encode(text, add_special_tokens=False), len(text))
            self.segment_bytes += len(chunk) + made.cost
            while self.segment_bytes > CHUNK_BYTES and len(self.segments) > 1:
                oldest = next(iter(self.segments))
                self.segment_bytes -= len(oldest) + self.segments.pop(oldest).cost
        return self.segments[chunk]

    def _join(self, a: bytes, b: bytes, left: Segment, right: Segment, begin: int) -> tuple | None:
        """The window over a join, re-encoded and widened until it agrees with both sides: (window, places) or None."""
        one, two = a.decode("utf-8", "replace"), b.decode("utf-8", "replace")
        wide = WINDOW
        while True:
            x, y = min(wide, len(one)), min(wide, len(two))
            window = Segment(self.tokenizer.encode(one[len(one) - x :] + two[:y], add_special_tokens=False), x + y)
            places = agreement(left, right, window, x, begin)
            if places or (x == len(one) and y == len(two)):
                return (window, places) if places else None
            wide *= 4

    def _repair(self, chunks: list[bytes]) -> np.ndarray | None:
        """Ids of the chunks as one text, put together from their own encodings and windows over the joins; None where none agrees."""
        out, begin, a, left = [], 0, chunks[0], self.segment(chunks[0])
        rest = iter(chunks[1:])
        for b in rest:
            while (found := self._join(a, b, left, right := self.segment(b), begin)) is None:
                # over as many chunks as it takes
                more = next(rest, None)
                if more is None or len(b) + len(more) > REACH:
                    return None
                b += more
            window, (stop, w1, w2, start) = found
            out += (left.ids[begin:stop], window.ids[w1:w2])
            begin, a, left = start, b, right
        return np.concatenate([*out, left.ids[begin:]])

    def passage(self, chunks: list[bytes]) -> list[int]:
        """Ids of chunks that follow each other, with no known agreement point inside."""
        chunks = [c for c in chunks if c]
        if not chunks:
            return []
        if len(chunks) == 1 and len(chunks[0]) <= LONGEST:
            return self.segment(chunks[0]).ids.tolist()
        ids = self._repair(chunks) if self.exact and len(chunks) > 1 else None
        self.repaired += ids is not None
        if ids is not None and self.repaired % AUDIT:
            return ids.tolist()
        whole = self._ids(b"".join(chunks).decode("utf-8", "replace"))
        self.exact = self.exact and (ids is None or ids.tolist() == whole)
        return whole

    def joined(self, words: list[bytes]) -> tuple[int, bytes, bytes]:
        if not words:
            return 0, b"", b""
        n, ids, strings = zip(*[self.words[w] for w in words], strict=True)
        return sum(n), b"".join(ids), b"".join(strings)

    @staticmethod
    def _run(parts: list[bytes], runs: set[bytes]) -> bytes | list[bytes]:
        """A run between agreement points: looked up as one if it is short, else the chunks it is made of."""
        if len(parts) > 1 and sum(map(len, parts)) > LONG:
            return parts
        runs.add(run := b"".join(parts))
        return run

    def encode(self, texts: list[list[bytes]]) -> list[tuple[int, bytes, bytes]]:
        """For each text, given as its chunks: number of tokens, ids and token strings, each followed by a space."""
        if not self.splits:
            return [self._told(self.passage(chunks)) if chunks else (0, b"", b"") for chunks in texts]
        fresh: dict[bytes, list[bytes] | None] = {}
        plans, runs = [], set()
        for chunks in texts:
            plan, pending = [], []
            for c in chunks:
                if c in self.chunks:
                    held = self.chunks[c]
                    head, tail = held[0], held[1]
                elif c in fresh:
                    parts = fresh[c]
                    head, tail = (None, c) if parts is None else (parts[0], parts[-1])
                else:
                    parts = c.replace(b"\n", b" ").split(b" ")
                    if len(parts) == 1:
                        fresh[c], head, tail = None, None, c
                    else:
                        fresh[c], head, tail = parts, parts[0], parts[-1]
                        runs.update(parts[1:-1])
                if head is None:  # no agreement point in this chunk: the join reaches on
                    pending.append(c)
                    continue
                plan.append((self._run([*pending, head], runs), c))
                pending = [tail]
            plans.append((plan, self._run(pending, runs)))
        self.learn(runs)
        done = {c: (parts[0], parts[-1], *self.joined(parts[1:-1])) for c, parts in fresh.items() if parts is not None}
        out = []
        for plan, pending in plans:
            n, ids, strings = 0, [], []
            for join, c in plan:
                a = self.words[join] if isinstance(join, bytes) else self._told(self.passage(join))
                b = self.chunks[c] if c not in done else done[c]
                n += a[0] + b[2]
                ids += (a[1], b[3])
                strings += (a[2], b[4])
            a = self.words[pending] if isinstance(pending, bytes) else self._told(self.passage(pending))
            out.append((n + a[0], b"".join([*ids, a[1]]), b"".join([*strings, a[2]])))
        for c, held in done.items():
            self.chunks[c] = held
            self.chunk_bytes += len(c) + len(held[3]) + len(held[4]) + ENTRY
        while self.chunk_bytes > CHUNK_BYTES:
            c = next(iter(self.chunks))
            held = self.chunks.pop(c)
            self.chunk_bytes -= len(c) + len(held[3]) + len(held[4]) + ENTRY
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    worker_caches["bpe"] = _encoders.clear
    return _encoders[path]


def _plain(ids: pa.Array, found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    numbers = [np.array(x[1].split(), np.int32) for x in found]
    return pa.RecordBatch.from_arrays([ids, pa.array(numbers, pa.list_(pa.int32())), pa.array([x[2][:-1].decode() for x in found], pa.string())], ["doc_id", "ids", "decoded"])


def encode_texts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", finish: Callable = _plain, schema: str = "doc_id long, ids array<int>, decoded string") -> DataFrame:
    """One row per document: its ids and what they decode to.

    ``finish`` makes the output rows of a piece from the ids column and, per document, (number of tokens, ids, token
    strings), the last two as bytes with a space after each.
    """

    def run(piece):
        data, at = joined_bytes(piece.column(1))
        body = data.tobytes()
        own = encoder(path)
        texts = []
        for first, last in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            cuts = [first, *cut_points(data, first, last)]
            texts.append([body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return finish(piece.column(0), own.encode(texts))

    return text_rows(docs, text, doc_id).mapInArrow(by_steps("text", run, 1 << 20, "bpe"), schema)


def _sha(x: bytes) -> str:
    return hashlib.sha256(x[:-1]).hexdigest()


def _digests(ids: pa.Array, found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in found], pa.int64()), pa.array([_sha(x[1]) for x in found], pa.string()), pa.array([_sha(x[2]) for x in found], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(ids: pa.Array, found: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    plain, told = _plain(ids, found), _digests(ids, found)
    return pa.RecordBatch.from_arrays([ids, told.column(1), plain.column(1), told.column(2), told.column(3)], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])


def encoded_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the operator's ids and decoded texts."""
    return encode_texts(docs, path, doc_id, text, _digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids themselves beside their number and digests."""
    return encode_texts(docs, path, doc_id, text, _ids, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    """The tokenizer file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
