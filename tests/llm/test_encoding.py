"""WebP media columns and BPE."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from breakweave.llm import bpe_chunks, media
from breakweave.llm import webp_lossless as webp

OPTIONS = [
    {}, {"cache_bits": 4}, {"references": True}, {"cache_bits": 10, "references": True}, {"block": 2}, {"block": 3, "cache_bits": 3, "references": True},
    {"transforms": (("green",),)}, {"transforms": (("cross", 2, [[3, 250, 77]]),)}, {"transforms": (("predictor", 2, list(range(14))),)},
    {"transforms": (("predictor", 3, [11, 12, 13, 5]), ("cross", 3, [[1, 2, 3], [200, 130, 7]]), ("green",)), "cache_bits": 6, "references": True},
]


def images():
    rng = np.random.default_rng(1)
    out = [rng.integers(0, 256, (h, w, 4), dtype=np.uint8) for h, w in ((1, 1), (3, 5), (17, 33))]
    smooth = np.add.outer(np.arange(20), np.arange(31))[:, :, None] * np.array([1, 2, 3, 0]) + np.array([0, 0, 0, 255])
    return [*out, rng.integers(0, 3, (20, 19, 4), dtype=np.uint8) * 80, np.zeros((8, 8, 4), np.uint8), smooth.astype(np.uint8), np.tile(out[1], (9, 2, 1))]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_webp_round_trip(options):
    for im in images():
        assert np.array_equal(webp.decode(webp.encode(im, **options)), im)


@pytest.mark.parametrize("colours", [1, 2, 4, 13, 16, 100, 256])
def test_webp_palette(colours):
    rng = np.random.default_rng(colours)
    im = rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (11, 23))]
    for more in ((), (("predictor", 2, [1, 2, 7]),)):
        assert np.array_equal(webp.decode(webp.encode(im, (("palette",), *more), references=True)), im)


def test_webp_header_and_errors():
    out = webp.encode(np.zeros((5, 7, 4), np.uint8))
    assert out[:4] == b"RIFF" and out[8:16] == b"WEBPVP8L" and int.from_bytes(out[4:8], "little") + 8 == len(out)
    bits = int.from_bytes(out[21:25], "little")
    assert (out[20], bits & 0x3FFF, bits >> 14 & 0x3FFF) == (0x2F, 6, 4)
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)]
    with pytest.raises(ValueError, match="no lossless"):
        webp.files(b"not a file at all")


def _file(*fields):
    """A file from (value, bits) fields, written out by hand from the format's description."""
    value, n = 0, 0
    for v, size in fields:
        value, n = value | v << n, n + size
    stream = value.to_bytes((n + 7) // 8, "little")
    body = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + body


def _lone(symbol):
    return (1, 1), (0, 1), (1, 1), (symbol, 8)  # a simple code of one symbol of eight bits


_NO_DISTANCE = ((1, 1), (0, 1), (0, 1), (0, 1))
_PLAIN = ((0, 1), (0, 1), (0, 1))  # no transform, no colour cache, one group of codes


def test_golden_streams():
    """Streams put together by hand, with the pixels that the format gives them."""
    size = lambda w, h: ((0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 1), (0, 3))
    one = _file(*size(1, 1), *_PLAIN, *_lone(20), *_lone(10), *_lone(30), *_lone(255), *_NO_DISTANCE)
    assert webp.decode(one).tolist() == [[[10, 20, 30, 255]]]
    # green takes two symbols, 7 and 9, one bit each
    two = ((1, 1), (1, 1), (1, 1), (7, 8), (9, 8))
    row = _file(*size(4, 1), *_PLAIN, *two, *_lone(1), *_lone(2), *_lone(3), *_NO_DISTANCE, (0b0110, 4))
    assert webp.decode(row)[0, :, 1].tolist() == [7, 9, 9, 7] and webp.decode(row)[0, 0].tolist() == [1, 7, 2, 3]
    # the last two predictor modes are opaque black; the first row and column have rules of their own
    residual = (*_lone(20), *_lone(10), *_lone(30), *_lone(0), *_NO_DISTANCE)
    for mode in (14, 15):
        head = ((1, 1), (0, 2), (0, 3), (0, 1), *_lone(mode), *_lone(0), *_lone(0), *_lone(255), *_NO_DISTANCE)
        assert webp.decode(_file(*size(2, 2), *head, *_PLAIN, *residual)).tolist() == [[[10, 20, 30, 255], [20, 40, 60, 255]], [[20, 40, 60, 255], [10, 20, 30, 255]]]
    # subtract green, then a palette of two colours with eight pixels in a byte
    green = _file(*size(1, 1), (1, 1), (2, 2), *_PLAIN, *_lone(20), *_lone(10), *_lone(250), *_lone(255), *_NO_DISTANCE)
    assert webp.decode(green).tolist() == [[[30, 20, 14, 255]]]
    table = ((1, 1), (3, 2), (1, 8), (0, 1), *_lone(5), *_lone(6), *_lone(7), *_lone(128), *_NO_DISTANCE)
    palette = _file(*size(3, 1), *table, *_PLAIN, *_lone(0b010), *_lone(0), *_lone(0), *_lone(255), *_NO_DISTANCE)
    assert webp.decode(palette).tolist() == [[[6, 5, 7, 128], [12, 10, 14, 0], [6, 5, 7, 128]]]


def test_broken_streams_are_refused():
    rng = np.random.default_rng(5)
    whole = webp.encode_rows(rng.integers(0, 256, 576 * 4, dtype=np.uint8), 144)
    stream = webp.files(whole)[0]
    for bad in (stream[:-40], stream[: len(stream) // 2]):
        with pytest.raises(ValueError, match="early"):
            webp.decode_stream(bad)
    packed = webp.files(webp.encode(rng.integers(0, 3, (30, 20, 4), dtype=np.uint8) * 80, cache_bits=4, references=True))[0]
    with pytest.raises(ValueError):
        webp.decode_stream(packed[: len(packed) // 2])
    with pytest.raises(ValueError, match="gaps or overlap"):
        webp.Prefix([1, 1, 1])
    with pytest.raises(ValueError, match="gaps or overlap"):
        webp.Prefix([2, 2, 2])


def test_streams_of_many_windows(monkeypatch):
    text = (b"some prose with Capitals and 12 numbers. " * 40_000)[:1_080_000]
    noisy = np.random.default_rng(3).integers(32, 127, 700_000, dtype=np.uint8)
    for raw in (np.frombuffer(text, np.uint8), noisy):
        p = media.payload_of(raw)
        stored = media.store(p)
        assert len(webp.files(stored)) == 1 and media.load(stored).tobytes() == p.tobytes()
    monkeypatch.setattr(webp, "_WINDOW", 64)
    assert media.load(stored).tobytes() == p.tobytes()


def test_payloads_of_many_files_and_kinds(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 256)
    for text in (b"", b"a", b"In. " * 2000, bytes(range(256)) * 5, b"THE!! END!! " * 400, "prosa größer ñandú ".encode() * 9000):
        p = media.payload_of(np.frombuffer(text, np.uint8))
        assert len(p) % 576 == 0 and len(p) >= max(576, len(text)) and len(p) - len(text) <= 576
        stored = media.store(p)
        assert media.load(stored).tobytes() == p.tobytes()
    assert len(webp.files(stored)) > 1


def test_media_digests(docs, texts):
    rows = {r.doc_id: r for r in media.digests(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    a, b = texts.index(""), texts.index(None)
    assert rows[a].media_sha256 == rows[b].media_sha256 and rows[a].feature == rows[b].feature
    assert media.digests(docs.where("false")).count() == 0
    stored = media.encode_column(docs.where("doc_id < 3"))
    for r in media.decode_column(stored).collect():
        assert bytes(r.pixels)[: r.n_bytes].decode() == texts[r.doc_id] and (r.width, len(r.pixels)) == (144, r.width * r.height * 4)


HARD = ["", "a", "a\tb \x1c<|endoftext|>é é", "x" * 3000, "Σας ΣΑΣ ß İ " * 300, "don't we'll 1234!!" * 500, "e\u0301 n\u0303 \u00a0\u2003wide", "日本語 テキスト " * 200, "\n\n \t", "<|startoftext|> z"]


def plain_bpe(text):
    tokenizer = bpe_chunks.encoder(bpe_chunks.default_path()).tokenizer
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(make, texts):
    pytest.importorskip("public_tokenizers")
    every = texts + HARD + HARD[2:5]
    rows = {r.doc_id: r for r in bpe_chunks.encode_texts(make(every), bpe_chunks.default_path()).collect()}
    told = {r.doc_id: r for r in bpe_chunks.encoded_digests(make(every), bpe_chunks.default_path()).collect()}
    assert len(rows) == len(told) == len(every)
    for i, t in enumerate(every):
        ids, decoded = plain_bpe(t)
        assert (rows[i].ids, rows[i].decoded) == (ids, decoded), t
        joined = " ".join(map(str, ids))
        assert (told[i].n_tokens, told[i].ids_sha256, told[i].decoded_sha256) == (len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def _cut(text):
    data = np.frombuffer(text.encode(), np.uint8)
    at = bpe_chunks.cut_points(data, 0, len(data))
    return [data.tobytes()[a:b] for a, b in zip([0, *at], at)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_joins_are_repaired_until_they_agree(name, texts):
    import public_tokenizers

    rng = random.Random(3)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) if rng.random() < 0.9 else rng.choice("，。！") for _ in range(20000))
    mixed = "".join(rng.choice("abcdefgh0123!?") for _ in range(20000))
    every = [t or "" for t in texts] + HARD + [han, han[3000:15000] + mixed[:5000], mixed, "x" * 150000, "".join(rng.choice("á\u0302b'sé日 ") for _ in range(9000)), "<|endoftext|>" * 500, "ab" * 40000]
    own = bpe_chunks.Encoder(public_tokenizers.path(name))
    assert own.splits == (name == "word_bpe_49k.json")
    for t in every:
        n, ids, decoded = own.encode([_cut(t)])[0]
        want = own.tokenizer.encode(t, add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want and n == len(want)
        assert decoded[:-1].decode() == own.tokenizer.decode(want, skip_special_tokens=False)
    assert own.repaired >= 3 and own.exact and own._repair(_cut(han)) is not None
    shared = set(_cut(han)) & set(_cut(han[3000:15000] + mixed[:5000]))
    assert len(shared) > 5 and all(c in own.segments for c in shared)


def test_caches_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe_chunks, "WORD_BYTES", 1 << 20)
    monkeypatch.setattr(bpe_chunks, "CHUNK_BYTES", 1 << 20)
    rng = random.Random(4)
    own = bpe_chunks.Encoder(bpe_chunks.default_path())
    for _ in range(400):
        text = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(300)) + "。" + "".join(rng.choice("abc0123456789") for _ in range(3000)) + " end"
        own.encode([_cut(text)])
        step = 200_000  # what one text may add before the bound is looked at
        assert own.word_bytes <= bpe_chunks.WORD_BYTES + step and own.segment_bytes <= bpe_chunks.CHUNK_BYTES + step and own.chunk_bytes <= bpe_chunks.CHUNK_BYTES + step
        assert sum(len(k) + len(v[1]) + len(v[2]) for k, v in own.words.items()) <= own.word_bytes


def test_long_spaceless_text_and_empty_table(make):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnop0123456789!?.,;") for _ in range(5_000_000))
    rows = {r.doc_id: r for r in bpe_chunks.encoded_digests(make([long, "", long[:9]]), bpe_chunks.default_path()).collect()}
    ids, decoded = plain_bpe(long)
    assert rows[0].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and rows[0].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_chunks.encoded_digests(make([]), bpe_chunks.default_path()).count() == 0


def test_chunks_are_shared_and_bounded():
    own = bpe_chunks.Encoder(bpe_chunks.default_path())
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(3000))
    cut = []
    for lead in ("", "something else before "):
        data = np.frombuffer((lead + passage).encode(), np.uint8)
        at = bpe_chunks.cut_points(data, 0, len(data))
        raw = data.tobytes()
        cut.append([raw[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)])
    assert len(set(cut[0]) & set(cut[1])) >= len(set(cut[0])) - 2 > 3
    assert own.encode(cut[:1])[0] == own.encode(cut[:1])[0] and len(own.chunks) > 3
    assert sum(len(c) for c in cut[0]) == len(passage)
