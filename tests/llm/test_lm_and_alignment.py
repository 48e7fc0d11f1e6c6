"""Language-model scores and token alignment against plain versions, with every kind of trouble."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from breakweave.llm import lm_scoring, token_alignment

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["</s>"]


def remainder(doc_id, modulus=7):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def plain_scores(rows):
    """Every count in dictionaries, every text word by word."""
    uni, bi = Counter(), Counter()
    for doc_id, text in rows:
        if remainder(doc_id) not in (2, None):
            t = words(text)
            uni.update(t)
            bi.update(zip(["<s>", *t[:-1]], t, strict=True))
    n, v, kinds = sum(uni.values()), len(uni), Counter(bi.values())
    d = lm_scoring.discounts([kinds[k] for k in (1, 2, 3, 4)])
    seen, left = Counter(), Counter()
    for (h, _), c in bi.items():
        seen[h] += c
        left[h] += d[min(c, 3) - 1]
    out = []
    for doc_id, text in rows:
        t, base, score = words(text), 0.0, 0.0
        for h, w in zip(["<s>", *t[:-1]], t, strict=True):
            root = (uni[w] + 1) / (n + v + 1)
            c = bi[h, w]
            base += math.log10(root)
            score += math.log10(root if not seen[h] else (c - d[min(c, 3) - 1] if c else 0) / seen[h] + left[h] / seen[h] * root)
        out.append((doc_id, remainder(doc_id) == 2, len(t), sum(uni[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=2e-6)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 1 << 11, "part_pairs": 1 << 6, "hot": 0.02}, {"block_bytes": 1, "hot": 0.9}])
def test_scores_against_dictionaries(docs, how):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in lm_scoring.scores(docs, **how).collect()), key=str)
    same(got, plain_scores(rows))


def test_scores_of_repeats_and_null_ids(spark, make, texts):
    some = make(texts[:40])
    docs = some.unionByName(some.where("doc_id < 5")).unionByName(some.where("doc_id > 35").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(sorted((tuple(r) for r in lm_scoring.scores(docs).collect()), key=str), plain_scores(rows))


def test_scores_without_rows_or_training(spark, make):
    assert lm_scoring.scores(make([])).count() == 0
    held = next(i for i in range(100) if remainder(i) == 2)
    docs = spark.createDataFrame([(held, "a b c"), (None, "a")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm_scoring.scores(docs).collect()}
    assert got[held].score == got[held].base_score == 0.0 and got[held].train_tokens == 0 and got[None].n_tokens == 2 and not got[None].held_out


def test_sql_says_the_same(docs):
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text").toPandas())
    want = sorted((tuple(r) for r in c.sql(lm_scoring.SQL).fetchall()), key=str)
    same(sorted((tuple(r) for r in lm_scoring.scores(docs).collect()), key=str), want)


def test_probabilities_sum_to_one(spark):
    """After a known state, all known words, the end and the class of unknown words share the whole mass."""
    held = iter(i for i in range(100_000) if remainder(i) == 2)
    train = [(i, t) for i, t in zip((i for i in range(100) if remainder(i) != 2), ["a b a c", "b a a", "c c b a", "a"] * 3, strict=False)]
    asked = [(next(held), t) for t in ("a a", "a b", "a c", "a new", "a")]
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(spark.createDataFrame(train + asked, "doc_id bigint, text string")).collect()}
    of = {t: got[i] for i, t in asked}
    # the probability of a word after "a" is that of "a word" without those of its first word and its end
    bare = plain_scores(train + asked)
    assert len(bare) == len(got)
    uni = Counter(w for _, t in train for w in words(t))
    bi = Counter(p for _, t in train for p in zip(["<s>", *words(t)[:-1]], words(t), strict=True))
    d = lm_scoring.discounts([Counter(bi.values())[k] for k in (1, 2, 3, 4)])

    def step(h, w):
        seen = {k: c for (x, k), c in bi.items() if x == h}
        n = sum(seen.values())
        root = (uni[w] + 1) / (sum(uni.values()) + len(uni) + 1)
        return root if not n else max(seen.get(w, 0) - (d[min(seen.get(w, 0), 3) - 1] if w in seen else 0), 0) / n + sum(d[min(c, 3) - 1] for c in seen.values()) / n * root

    own = {w: 10 ** (of[f"a {w}"] - math.log10(step("<s>", "a")) - math.log10(step(w, "</s>"))) for w in ("a", "b", "c", "new")}
    end = 10 ** (of["a"] - math.log10(step("<s>", "a")))
    assert sum(own.values()) + end == pytest.approx(1, abs=1e-9)


# --- alignment


def plain_alignment(rows, paths):
    a, b, a_bytes, b_bytes = token_alignment.load(*paths)
    found, per = [], Counter()
    for doc_id, text in rows:
        groups = None
        if text:
            raw = (" " + text).encode()
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta, tb = [a_bytes[i] for i in ia], [b_bytes[i] for i in ib]
            if b"".join(ta) == raw == b"".join(tb):
                ends = [[sum(map(len, t[: i + 1])) for i in range(len(t))] for t in (ta, tb)]
                groups, x, y = [], 0, 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    u, v = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                    groups.append((ia[x:u], ib[y:v]))
                    x, y = u, v
                per.update({(p, q) for u, v in groups for p in u for q in v})
        found.append((doc_id, groups))
    best = defaultdict(int)
    for (p, _), n in per.items():
        best[p] = max(best[p], n)
    out = []
    for doc_id, groups in found:
        if groups is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for u, v in groups for p in u for q in v]
        told = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        counts = [per[x] for x in links]
        out.append((doc_id, sum(len(u) for u, _ in groups), sum(len(v) for _, v in groups), len(groups), len(links), sum(c == best[x[0]] for c, x in zip(counts, links, strict=True)), sum(counts), hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


HARD = [
    None, "", " ", "\n", "a ▁ b", "▁", "  x\n\n y\t z ", "<|endoftext|> <s> </s> <unk>", "é日本 🎉🎉 a  b 　c d   e", "x" * 700, "=-=-" * 100 + " ok\nfine", "don't   stop'll\r\nyes\r\n ok",
    "a\x00b c d", "1234 5678.90\n-1", "é ́x", "İstanbul ß ﬁ Σς", "tail \n", "word " * 200, "﻿bom ​zero", "a\n b \nc",
]


@pytest.mark.parametrize("hot", [token_alignment.HOT, 20, 0])
def test_alignment_against_bytes(spark, texts, hot):
    paths = token_alignment.default_paths()
    assert token_alignment.cuts_hold(*paths)
    rows = list(enumerate([*HARD, *[t if t is None else t[:900] for t in texts]])) + [(3, "repeated row"), (3, "repeated row"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id bigint, text string, passage string, sid int, groups string")
    got = sorted((tuple(r) for r in token_alignment.align(docs, *paths, hot=hot).documents.collect()), key=str)
    assert got == plain_alignment(rows, paths)


def test_whole_texts_where_cuts_dont_hold(spark, monkeypatch):
    paths = token_alignment.default_paths()
    rows = list(enumerate(HARD))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(token_alignment, "cuts_hold", lambda *a: False)
    for listed, small in ((token_alignment.LISTED, token_alignment.SMALL), (3, 1)):  # ids are counted before they are paired
        found = token_alignment.align(docs, *paths, listed=listed, small=small).documents
        assert sorted((tuple(r) for r in found.collect()), key=str) == plain_alignment(rows, paths)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_alignment.aligned_documents(docs, *token_alignment.default_paths()).count() == 0


def test_passages_and_pairs(spark):
    """The operator's own tables: groups of passages and how many documents hold a pair."""
    found = token_alignment.align(spark.createDataFrame([(1, "the cat"), (2, "the the"), (3, "cat")], "doc_id bigint, text string"), *token_alignment.default_paths())
    passages = {r.passage: r for r in found.passages.collect()}
    assert set(passages) == {" the", " cat"} and passages[" the"].n == 3 and passages[" the"].n_groups == 1
    assert sorted(r.documents for r in found.pairs.collect()) == [2, 2] and all(r.is_best for r in found.pairs.collect())


def test_groups_of_many_passages_are_read_at_once():
    """Ids, sides and passages from the text of groups, as splitting each text gives them."""
    texts = ["1|2", "30,4|5;6|7,88,9", "12345|1;2,3|4,5;6,1000000|70"]
    passage, n_a, n_b, a, b = token_alignment._numbers(texts)
    sides = [(i, *([int(t) for t in side.split(",")] for side in g.split("|"))) for i, text in enumerate(texts) for g in text.split(";")]
    assert passage.tolist() == [i for i, _, _ in sides]
    assert (n_a.tolist(), n_b.tolist()) == ([len(x) for _, x, _ in sides], [len(y) for _, _, y in sides])
    assert (a.tolist(), b.tolist()) == ([t for _, x, _ in sides for t in x], [t for _, _, y in sides for t in y])
    assert [x.tolist() for x in token_alignment._numbers([])] == [[]] * 5


@pytest.mark.parametrize("piece", [1, 4, 1 << 16])
def test_documents_put_together_in_pieces(monkeypatch, piece):
    """Hot, rare, broken, empty and often linked passages; documents of all pieces come in order."""
    monkeypatch.setattr(token_alignment, "PIECE", piece)
    groups = ["1|2", "3,4|5"]
    hot = token_alignment._Hot(pa.array(groups), np.array([[0] * 4, [1, 1, 1, 1], [2, 1, 1, 2]]), np.array([102, 305, 405], np.int32), np.array([0, 0, 1, 3]))
    rare = lambda pos, place, text, own=None: {"pos": pos, "place": place, "groups": text, "own": own}
    rows = [([1, 2, 1], None), ([1, 0], [rare(1, 70, "6|7,8;9|2")]), ([0, 2], [rare(0, 71, None)]), ([], None), ([0], [rare(0, 72, "1,1|2;3|5", [11, 12])]), ([2], [])]
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("place", pa.int64()), ("groups", pa.string()), ("own", pa.list_(pa.int64()))]))
    n = len(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array([p for p, _ in rows], pa.list_(pa.int32())), pa.array([r for _, r in rows], kind)], ["row", "doc_id", "places", "rare"])
    got = [tuple(r.values()) for b in token_alignment._put_together([batch], SimpleNamespace(value=hot), 100, "int") for r in b.to_pylist()]
    digest = lambda *t: hashlib.sha256(";".join(t).encode()).hexdigest()
    none = (False, 0, 0, 0, 0, "", [], [])
    assert [r[2:] for r in got] == [
        (True, 4, 3, 3, 4, digest("1|2", "3,4|5", "1|2"), [102, 305, 405], []), (True, 3, 4, 3, 4, digest("1|2", "6|7,8;9|2"), [102, 607, 608, 902], [70]), none, none,
        (True, 3, 2, 2, 3, digest("1,1|2;3|5"), [11, 12], [72]), (True, 2, 1, 1, 2, digest("3,4|5"), [305, 405], []),
    ]
    assert [r[:2] for r in got] == [(i, i) for i in range(n)]
