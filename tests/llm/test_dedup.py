"""Exact copies, near copies, components."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breakweave.llm import exact_dedup, ngram_jaccard
from breakweave.llm.common import Scratch, spread_join
from breakweave.llm.components import connected_components

from .conftest import SCHEMA


def plain_groups(texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    return {i: (norm.index(n), norm.count(n), norm.index(n) == i, hashlib.sha256(n.encode()).hexdigest()) for i, n in enumerate(norm)}


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_groups(docs, texts, counters):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs, counters=counters).collect()}
    assert got == plain_groups(texts)


def test_dropping_copies_keeps_whole_rows(docs, texts, spark):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, g in plain_groups(texts).items() if g[2])
    assert exact_dedup.drop_exact_copies(docs.where("false")).count() == 0 == exact_dedup.exact_groups(docs.where("false")).count()


def test_repeated_ids_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "b"), (None, "c"), (2, "a"), (3, None), (4, "")]
    d = spark.createDataFrame([(i, t, "en", "s", 0, None, None, None) for i, t in rows], SCHEMA)
    assert sorted(((r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(d).collect()), key=str) == [(1, "a"), (1, "b"), (3, None), (None, "c")]
    got = exact_dedup.exact_groups(d).collect()
    assert len(got) == 8 and sum(r.kept for r in got) == 4 and [r.group_size for r in got if r.text_sha256 == hashlib.sha256(b"a").hexdigest()] == [3, 3, 3]


def test_rows_that_differ_in_other_columns_keep_the_same_one(spark):
    rows = [(1, "a  b", "en", f"s{k}", k, "x", None, "y") for k in range(12)] + [(2, "a b", "en", "s", 0, "x", None, "y")]
    kept = [sorted(map(tuple, exact_dedup.drop_exact_copies(spark.createDataFrame(r, SCHEMA).repartition(n)).collect()), key=str) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0][0] == 1


def test_misra_gries_finds_every_frequent_value(spark):
    rng = random.Random(1)
    values = ["hot"] * 400 + ["warm"] * 150 + [f"v{i}" for i in range(1000)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    got = {r.v for r in exact_dedup.misra_gries(df, "v", 12).collect()}
    assert {"hot", "warm"} <= got and len(got) <= 12


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(sets))}


def near(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs).collect()}


def test_near_copies(docs, texts):
    want = plain_components(texts)
    assert near(docs) == want
    kept = ngram_jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, (_, c) in want.items() if i == c]
    assert ngram_jaccard.jaccard_components(docs.where("false")).count() == 0


@pytest.mark.parametrize("small", [2, 32])
def test_a_chain_of_near_copies_is_one_component(make, monkeypatch, small):
    """Neighbours link, far ones do not: stars alone would miss them."""
    monkeypatch.setattr(ngram_jaccard, "SMALL", small)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(25):
        texts.append(" ".join(words))
        words[rng.randrange(100)] = f"n{len(texts)}"
    texts += [" ".join(f"q{k}x{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(8)) for k in range(10)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    want = plain_components(texts)
    assert near(make(texts)) == want and len({c for _, c in want.values()}) < len(texts) - 10


def test_a_saturated_sketch_is_mended_by_exact_counts(spark, make, monkeypatch):
    """Boilerplate that the sketch can't tell from rare text leaves the prefixes; what links stays the same."""
    monkeypatch.setattr(ngram_jaccard, "SKETCH", 16)
    rng = random.Random(6)
    plate = [f"plate{i}" for i in range(40)]
    texts = [" ".join([f"own{k}x{i}" for i in range(60)] + plate) for k in range(80)]
    texts += [t.replace("x7 ", "y7 ") for t in texts[:20]] + [" ".join(plate), " ".join(plate) + " end", " ".join(rng.sample(plate, 40))]
    want = plain_components(texts)
    docs = make(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(docs, frequent=8, most_frequent=64).collect()}
    assert got == want == near(docs)
    scratch = Scratch(spark, "t")
    rows = docs.select("doc_id", "text")
    ids, flat = docs.select("doc_id"), np.full(16, 7, np.uint8).tobytes()
    most = [ngram_jaccard.settled_prefixes(scratch, rows, ids, len(texts), flat, 5, 80, least, 64)[1].agg(F.max("size")).first()[0] for least in (1000, 8)]
    assert most[0] > 90 and most[1] < 30


def test_many_near_copies_are_dealt_over_tasks(make, monkeypatch):
    """A thousand near copies of one text: more heads, bands and blocks than one task is given."""
    monkeypatch.setattr(ngram_jaccard, "SMALL", 4)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 64)
    monkeypatch.setattr(ngram_jaccard, "GROUP", 2)
    monkeypatch.setattr(ngram_jaccard.spread_join, "__defaults__", (50,))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for _ in range(1000):
        own = [*words, *[f"m{i}" for i in range(rng.choice((0, 0, 8, 30)))]]
        own[rng.randrange(len(own))] = f"n{rng.randrange(400)}"
        texts.append(" ".join(own))
    assert near(make(texts)) == plain_components(texts)


def test_bands_hold_what_can_link():
    starts = ngram_jaccard.band_starts(80)
    band = np.searchsorted(starts, np.arange(1, 5001), "right") - 1
    for n in range(1, 4001):
        assert band[min(n * 100 // 80, 5000) - 1] - band[n - 1] <= 1


def test_spread_join_is_a_join_without_hot_tasks(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id") % 50).alias("k"), "id")
    one = many.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.concat(F.lit("n"), F.col("k").cast("string")))
    got = spread_join(many, one, "k", "rows", "id", 64)
    assert sorted(map(tuple, got.select("k", "id", "name").collect())) == sorted((r.k, r.id, f"n{r.k}") for r in many.collect())
    assert got.withColumn("p", F.spark_partition_id()).count() == 1000


def test_every_outside_block_meets_every_block_of_near_bands(spark):
    schema = "token bigint, band int, of_main boolean, block bigint, held map<int,bigint>, members array<struct<doc_id:bigint>>"
    kinds = [(b, m, n) for b, m, n in ((1, False, 5), (1, True, 40), (2, True, 18), (3, False, 20), (5, True, 2))]
    held = {b * 2 + m: n * ngram_jaccard.BLOCK for b, m, n in kinds}
    rows = [(7, b, m, i, held, [(b * 10000 + m * 1000 + i,)]) for b, m, n in kinds for i in range(n) if (b, i) != (3, 4)]
    got = [(r.lhs[0][0], r.rhs[0][0]) for r in ngram_jaccard.block_pairs(spark.createDataFrame(rows, schema)).collect()]
    ids = {r[5][0][0]: (r[1], r[2]) for r in rows}
    want = {(a, b) for a in ids for b in ids if not ids[a][1] and abs(ids[a][0] - ids[b][0]) <= 1}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("block", [3, 256])
def test_links_inside_components_are_counted(make, texts, monkeypatch, block):
    """Three mutual near copies have two links each, however the component was found; copies count with their class."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    words = [f"w{i}" for i in range(60)]
    own = [" ".join([*words, f"end{k}"]) for k in range(3)]
    own = [*own, own[0], "far " * 3, *texts]
    sets = []
    for t in own:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    kinds = set(sets) - {frozenset()}
    want = {i: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in kinds) if a else 0 for i, a in enumerate(sets)}
    got = {r.doc_id: r.n_links for r in ngram_jaccard.jaccard_components(make(own)).collect()}
    assert got == want and [got[i] for i in range(5)] == [2, 2, 2, 2, 0] and max(want.values()) > 2
    assert "n_links" not in ngram_jaccard.jaccard_components(make(own), count_links=False).columns


def shingle_sets(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    return [frozenset({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) for w in words]


@pytest.mark.parametrize("block, values", [(8, 1 << 19), (8, 600)])
def test_links_of_a_large_component_by_differences_to_its_head(make, monkeypatch, block, values):
    """Versions with one to many changes, families of changes, a chain and repeated rows: counts are those of all pairs."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_VALUES", values)
    rng = random.Random(21)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        own = list(words)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4))):
            own[rng.randrange(120)] = f"n{rng.randrange(30)}"
        texts.append(" ".join(own + [f"tail{rng.randrange(3)}x{i}" for i in range(rng.choice((0, 0, 12)))]))
    for k in range(40):
        words[rng.randrange(120)] = f"c{k}"
        texts.append(" ".join(words))
    texts += texts[:5]
    sets = shingle_sets(texts)
    want = {i: sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in set(sets)) for i, a in enumerate(sets)}
    docs = make(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_components(docs.union(docs.limit(7))).collect()}
    assert got == {i: (*c, want[i]) for i, c in plain_components(texts).items()}
    assert len(set(want.values())) > 10


def test_sizes_of_differences_settle_only_what_they_may():
    rng = np.random.default_rng(5)
    head, other = np.arange(200), np.arange(1000, 1200)
    seen = [0, 0, 0]
    for _ in range(3000):
        a, b = (np.concatenate([head[rng.random(200) < x], other[rng.random(200) < y]]) for x, y in rng.choice([0.3, 0.8, 0.9, 0.97], 4).reshape(2, 2) * [[1, 0.1]])
        (m, d), (m2, d2) = ((200 - np.sum(x < 1000), np.sum(x >= 1000)) for x in (a, b))
        every, none = ngram_jaccard.settled(200, *(int(ngram_jaccard.cell(np.array([x]))[0]) for x in (m, d)), *(ngram_jaccard.cell(np.array([x])) for x in (m2, d2)), 80)
        both = len(np.intersect1d(a, b))
        links = 100 * both >= 80 * (len(a) + len(b) - both)
        assert not (every[0] and not links) and not (none[0] and links)
        seen[0 if every[0] else 1 if none[0] else 2] += 1
    assert min(seen) > 0


def test_bitmap_bound_never_rejects_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, m = int(rng.integers(1, 300)), int(rng.integers(0, 20))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[m:], rng.integers(0, 2**63, m, dtype=np.uint64)])) if len(a) > m else a
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        if linked:
            assert ngram_jaccard.may_link(len(a), len(b), ngram_jaccard.parity(a), ngram_jaccard.parity(b), 80)
    one, two = (np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64)) for _ in range(2))
    assert not ngram_jaccard.may_link(500, 500, ngram_jaccard.parity(one), ngram_jaccard.parity(two), 80)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    got = connected_components(Scratch(spark, "t"), spark.createDataFrame(links, "a bigint, b bigint")).toPandas()
    parent = {n: n for e in links for n in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    want = {n: root(n) for n, _ in ((n, 0) for e in links for n in e if e[0] != e[1])}
    assert dict(zip(got.node, got.component, strict=True)) == want
    assert isinstance(got, pd.DataFrame)
