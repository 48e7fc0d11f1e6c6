"""Classifiers, language identification, rollups, mixing, URL rules, pipeline."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from breakweave.llm import calibration, language_id, mixing, quality, token_rollup, toxicity, url_rules
from breakweave.llm.common import Scratch

from .conftest import frame

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def corpus(spark):
    """Four kinds of text in two languages with labels: plain, junk, toxic."""
    rng = random.Random(7)
    en = "the of and to in that house water running over green field morning people walk slowly home again".split()
    de = "der die und das ein haus wasser über grünes feld morgen leute gehen langsam wieder heim nicht".split()
    texts, langs, labels = [], [], []
    for i in range(900):
        words = en if i % 3 else de
        body = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        junk, toxic = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                body.insert(rng.randrange(len(body)), rng.choice(["idiot", "moron"]) if i % 3 else "zwackel" + rng.choice("abcd"))
        if junk:
            body = [w.upper() + "!!" for w in body]
        texts.append(" ".join(body))
        langs.append("en" if i % 3 else "de")
        labels.append((i, int(not junk), int(toxic)))
    texts += [None, "", "123 !!", "x"]
    langs += ["en", None, "de", None]
    labels += [(900, 1, 0), (901, 0, 0), (5, None, None)]
    return frame(spark, texts, langs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def held(i, modulus, rest):
    return zlib.crc32(str(i).encode()) % modulus == rest


def test_quality(corpus):
    docs, labels = corpus
    rows = quality.scores(docs, quality.fit(docs, labels)).collect()
    want = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id, 3, 1) for r in rows)
    judged = [(r.predicted, want[r.doc_id]) for r in rows if r.held_out and r.doc_id in want and r.doc_id < 900]
    assert np.mean([a == b for a, b in judged]) > 0.97 and len(judged) > 200
    model = quality.fit(docs, labels)
    kept = quality.accepted(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score >= 0.5}
    bare = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.scores(docs, bare).collect()} == {0.5}
    assert quality.scores(docs.where("false"), model).count() == 0


def test_toxicity(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    rows = toxicity.scores(docs, model).collect()
    want = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    judged = [(r.predicted, want[r.doc_id]) for r in rows if r.held_out and r.doc_id < 900]
    assert np.mean([a == b for a, b in judged]) > 0.97 and all(r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id, 4, 2) for r in rows)
    assert model.voters["yes"][0] > model.voters["no"][0]
    assert {r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels.where("false"))).collect()} == {0.0}
    empty = {r.score for r in rows if r.doc_id in (900, 901)}
    assert len(empty) == 1 and empty.pop() < 0.3


def test_toxicity_depends_on_rows_only(corpus):
    docs, labels = corpus
    # copies with labels that disagree, repeated rows, null ids
    docs = docs.unionByName(docs.where("doc_id < 90").withColumn("doc_id", F.col("doc_id") + 5000)).unionByName(docs.where("doc_id = 7")).unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("bigint")))
    labels = labels.unionByName(labels.where("doc_id < 90").selectExpr("doc_id + 5000 as doc_id", "quality", "1 - toxic as toxic"))
    one = toxicity.scores(docs, toxicity.fit(docs, labels)).collect()
    other = docs.repartition(7, "n_chars").sortWithinPartitions(F.col("doc_id").desc())
    two = toxicity.scores(other, toxicity.fit(other, labels.orderBy(F.rand(3)))).collect()
    assert len(one) == 904 + 90 + 2 and sorted(one, key=str) == sorted(two, key=str)
    assert not next(r for r in one if r.doc_id is None).held_out
    empty = docs.where("false")
    assert toxicity.scores(empty, toxicity.fit(empty, labels)).count() == 0
    assert {r.score for r in toxicity.scores(docs, toxicity.fit(empty, labels)).collect()} == {0.0}
    assert {r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels.where("toxic = 1"))).collect()} == {1.0}


def test_toxicity_against_a_plain_version(corpus):
    """The same model from dictionaries of words, the label model and the classifier written out."""
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    want = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    train = [i for i in want if not held(i, 4, 2)]
    seen, odds = {}, {}
    for i in train:
        for w in set(texts[i].lower().split()):
            seen.setdefault(w.strip("!"), [0, 0])[want[i]] += 1
    n = [sum(want[i] == k for i in train) for k in (0, 1)]
    odds = {w: np.log((b + 0.5) / (n[1] + 1)) - np.log((a + 0.5) / (n[0] + 1)) for w, (a, b) in seen.items()}
    telling = {w for w, o in odds.items() if o >= 2.5 and sum(seen[w]) >= 3}
    for i in (i for i in want if held(i, 4, 2)):
        plain = any(w.strip("!") in telling for w in texts[i].lower().split())
        assert scored[i].predicted == int(plain) == want[i]


def test_label_model_recovers_rates():
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.15
    yes, no = np.array([0.8, 0.7, 0.6]), np.array([0.02, 0.01, 0.05])
    votes = np.where(y[:, None], rng.random((20000, 3)) < yes, rng.random((20000, 3)) < no)
    code = (votes * (1 << np.arange(3))).sum(axis=1)
    post, told = toxicity.label_model(np.bincount(code, minlength=1 << toxicity.Voters.N).astype(float))
    assert abs(told["prior"] - 0.15) < 0.03 and np.all(np.abs(told["yes"][:3] - yes) < 0.1)
    assert post[7] > 0.95 and post[0] < 0.05


def test_language(corpus, make):
    docs, _ = corpus
    model = language_id.fit(docs)
    rows = language_id.identify(docs, model).collect()
    true = {r.doc_id: r.lang for r in docs.collect()}
    assert model.langs == ["de", "en"] and np.mean([r.lang_pred == true[r.doc_id] for r in rows if r.held_out and r.doc_id < 900]) == 1
    by = {r.doc_id: r for r in rows}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (900, 901, 902)) and by[903].lang_pred in ("de", "en")
    assert all(r.held_out == held(r.doc_id, 4, 2) for r in rows)
    odd = {r.doc_id: r for r in language_id.identify(make(["qxz vvjk " * 30, "the water and the house " * 10]), model).collect()}
    assert odd[0].rejected and not odd[1].rejected
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_language_keeps_all_ngrams_in_shards(make):
    rng = random.Random(3)
    en, ja = "the of and water house field walk home".split(), [chr(0x4E00 + i) for i in range(900)]
    texts = [" ".join(rng.choice(en) for _ in range(60)) for _ in range(60)] + ["".join(rng.choice(ja) for _ in range(30)) for _ in range(8)]
    docs = make(texts, ["en"] * 60 + ["ja"] * 8)
    whole, cut = (language_id.fit(docs, most=most) for most in (1_000_000, 40))
    assert type(whole) is language_id.Model and len(cut.shards) > 5 and cut.langs == whole.langs == ["en", "ja"]
    a, b = ({r.doc_id: r for r in language_id.identify(docs, m).collect()} for m in (whole, cut))
    assert {r.lang_pred for r in b.values() if r.doc_id >= 60} == {"ja"}
    for i, r in a.items():
        assert b[i].lang_pred == r.lang_pred and b[i].cross_entropy == pytest.approx(r.cross_entropy, abs=2e-4) and b[i].score == pytest.approx(r.score, abs=1e-4)


def test_language_calibrates_on_all_training_texts(make):
    """All texts count, each judged by a model of the half that it is not in; a rare language has its own limit."""
    n, rare = 28_000, ["der wald und das haus " * 3, "die leute gehen heim " * 4]
    docs = make(["the house"] * n + rare * 6, ["en"] * n + ["de"] * 12)
    model = language_id.fit(docs)
    used = sum(not held(i, 4, 2) for i in range(n + 12))
    assert model.langs == ["de", "en"] and np.isfinite(model.limit).all() and model.counted == used > 20_000


def test_language_model_against_a_plain_version(make):
    """Interpolated Kneser-Ney from dictionaries gives the same cross-entropies."""
    rng = random.Random(12)
    words = {"en": "the of and water house".split(), "de": "der und das wasser haus".split()}
    texts = [" ".join(rng.choice(words[("en", "de")[i % 2]]) for _ in range(8)) for i in range(60)]
    langs = [("en", "de")[i % 2] for i in range(60)]
    docs = make([*texts, "thunder house", "", None, "9 9"], [*langs, "en", "en", "de", "de"])
    rows = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}

    def symbols(t):
        return "\0\0\0" + "".join(c if c.isalpha() else "\0" for c in t.lower())

    def model(lang):
        c = {4: {}}
        for i, t in enumerate(texts):
            if langs[i] == lang and not held(i, 4, 2):
                s = symbols(t)
                for k in range(3, len(s)):
                    c[4][s[k - 3 : k + 1]] = c[4].get(s[k - 3 : k + 1], 0) + 1
        for order in (3, 2, 1):
            c[order] = {}
            for g in c[order + 1]:
                c[order][g[1:]] = c[order].get(g[1:], 0) + 1
        d = {}
        for order in c:
            n1, n2 = (sum(v == k for v in c[order].values()) for k in (1, 2))
            d[order] = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)

        def p(g):
            if not g:
                return 1 / 65536
            own = [v for k, v in c[len(g)].items() if k[:-1] == g[:-1]]
            if not own:
                return p(g[1:])
            return max(c[len(g)].get(g, 0) - d[len(g)], 0) / sum(own) + d[len(g)] * len(own) / sum(own) * p(g[1:])

        return p

    models = {x: model(x) for x in ("de", "en")}
    for i in [k for k in range(60) if held(k, 4, 2)] + [60]:
        s = symbols(texts[i] if i < 60 else "thunder house")
        ce = {x: -sum(np.log2(p(s[k - 3 : k + 1])) for k in range(3, len(s))) / (len(s) - 3) for x, p in models.items()}
        assert rows[i].lang_pred == min(ce, key=ce.get) and rows[i].cross_entropy == pytest.approx(min(ce.values()), abs=1e-3)
    assert {rows[k].lang_pred for k in (61, 62, 63)} == {"und"}
    assert language_id.identify(docs.where("false"), language_id.fit(docs)).count() == 0


def test_kneser_ney_sums_to_one():
    text = "abab abba aab bba ab"
    raw = np.frombuffer(text.encode(), np.uint8)
    keys, counts = np.unique(language_id.grams(*language_id.symbols(raw, np.array([0, len(raw)])))[0], return_counts=True)
    model = language_id.Model(["x"], [language_id._kneser_ney(keys, counts)])
    for context in (int(keys[0]) >> 16, int(keys[-1]) >> 16, 12345):
        every = (np.uint64(context) << np.uint64(16)) | np.arange(65536, dtype=np.uint64)
        assert np.exp(model.log_probs(every)).sum() == pytest.approx(1, abs=1e-3)


def test_pool_and_isotonic():
    assert calibration.pool(np.array([1.0, 1, 0, 2]), np.array([1.0, 0, 0, 2])).tolist() == [0.5, 0.5, 0.5, 1.0]
    curve = calibration.Isotonic(0, 1, np.array([50.0, 50]), np.array([0.0, 50]))
    assert curve(np.array([0.0, 1.0]))[1] > 0.9 and np.all(np.diff(curve(np.linspace(0, 1, 20))) >= 0)


def test_rollup_is_idempotent_and_additive(spark, docs):
    store = token_rollup.TokenStore(spark, f"{Scratch(spark, 'test-rollup').at}/store")
    assert store.totals().count() == 0
    schema = "doc_id bigint, source string, lang string, tokenizer string, op string, n_tokens bigint, old_tokens bigint"
    one = spark.createDataFrame([(1, "a", "en", "t", "insert", 10, None), (2, None, "en", "t", "insert", 5, None), (3, "a", "en", "t", "insert", None, None)], schema)
    two = spark.createDataFrame([(1, "a", "en", "t", "revise", 7, 10), (2, None, "en", "t", "delete", None, 5), (9, "a", "en", "t", "what", 1, 1)], schema)
    assert store.commit("one", one) and not store.commit("one", two) and store.commit("two", two) and store.commit("none", one.where("false"))
    want = [("a", "en", "t", 2, 7)]
    assert [tuple(r) for r in store.totals().collect()] == want
    store.compact()
    again = token_rollup.TokenStore(spark, store.root)
    assert [tuple(r) for r in again.totals().collect()] == want and {r.batch for r in again.committed().collect()} == {"one", "two", "none"} and not again.commit("two", two)
    assert token_rollup.rollup_of(docs.where("false")).count() == 0


_EVENTS = "doc_id bigint, source string, lang string, tokenizer string, op string, n_tokens bigint, old_tokens bigint"


def _insert(spark, n):
    return spark.createDataFrame([(n, "a", "en", "t", "insert", n, None)], _EVENTS)


def test_rollup_compactions_at_the_same_time_count_once(spark):
    store = token_rollup.TokenStore(spark, f"{Scratch(spark, 'test-rollup').at}/store")
    other = token_rollup.TokenStore(spark, store.root)
    store.commit("one", _insert(spark, 10))
    store.commit("two/odd name", _insert(spark, 20))
    mine, theirs = store.prepare_compaction(), other.prepare_compaction()
    store.commit("three", _insert(spark, 30))  # between both steps
    assert store.finish_compaction(mine) and not other.finish_compaction(theirs)
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 3, 60)]
    assert not other.commit("one", _insert(spark, 10)) and not other.commit("three", _insert(spark, 30))
    assert other.compact() and not other.compact() and store.vacuum() >= 3
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "t", 3, 60)] and not store.commit("two/odd name", _insert(spark, 20))
    # a writer that checked before the batch was folded and makes its marker afterwards
    store._create(store._marker("one"), {"batch": "one", "generation": 0, "data": f"{store.root}/data/late"})
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 3, 60)]


def test_rollup_survives_torn_markers_and_racing_commits(spark):
    store = token_rollup.TokenStore(spark, f"{Scratch(spark, 'test-rollup').at}/store")
    store.commit("one", _insert(spark, 10))
    for at in (store._marker("torn"), f"{store.root}/bases/000000000009.json"):
        store._fs.mkdirs(store._path(at).getParent())
        store._fs.create(store._path(at), False).close()
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 1, 10)]
    assert store.commit("torn", _insert(spark, 5)) and not store.commit("torn", _insert(spark, 5))
    late = {"batch": "one", "generation": 0, "data": f"{store.root}/data/none"}
    assert not store._create(store._marker("one"), late)
    assert store.compact() and [tuple(r) for r in store.totals().collect()] == [("a", "en", "t", 2, 15)]


def test_rollup_counts_real_tokens(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    store = token_rollup.TokenStore(spark, f"{Scratch(spark, 'test-rollup').at}/store")
    store.commit("bpe", token_rollup.token_counts(docs, path, "word_bpe_49k"))
    own = Tokenizer.from_file(path)
    assert sum(r.n_tokens for r in store.totals().collect()) == sum(len(own.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())


def test_mixing_hits_targets_and_keeps_rows(make):
    rng = random.Random(5)
    n = 400
    d = make([" ".join(["w"] * rng.randint(1, 900)) for _ in range(n - 2)] + [None, ""], [rng.choice(["en", "de", None]) for _ in range(n)], [rng.choice(["big", "big", "big", "x", None]) for _ in range(n)])
    rows = mixing.mix(d).toPandas()
    for dim in ("source", "lang", "topic"):
        have, want = rows.groupby(dim).apply(lambda g: (g.n_tokens * g.weight).sum(), include_groups=False), rows.groupby(dim).n_tokens.sum() ** mixing.EXPONENTS[dim]
        assert np.allclose(have / have.sum(), want / want.sum(), atol=2e-3)
    assert (rows.n_tokens * rows.prob).sum() / rows.n_tokens.sum() == pytest.approx(mixing.KEEP, abs=1e-3) and rows.prob.max() <= 1
    out = mixing.sample(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == sorted(rows[rows.sampled].doc_id)
    given = mixing.mix(d, shares={"source": {"x": 0.5}}, keep=0.3).toPandas()
    assert (given.n_tokens * given.weight)[given.source == "x"].sum() / (given.n_tokens * given.weight).sum() == pytest.approx(0.5, abs=0.01)
    assert mixing.mix(d.where("false")).count() == 0 == mixing.sample(d.where("false")).count()


def plain_rule(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: r.rank, default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


@pytest.mark.parametrize("block", [2, 100_000])
def test_url_rules(spark, monkeypatch, block):
    monkeypatch.setattr(url_rules, "RULES", block)
    rules = (*url_rules.QUERY_RULES, url_rules.Rule("block", "b.a.org", "/"), url_rules.Rule("allow", "a.org", "/x/y"), url_rules.Rule("block", "a.org", "/x"), url_rules.Rule("block", "org", "/x"))
    hosts = ["a.org", "b.a.org", "c.b.a.ORG", "xa.org", "example.org", "m.example.org", "q.com", "com", "", "a..org", "q.net"]
    paths = ["", "/", "/x", "/x/y/z", "/es/1", "/en/1", "/en/12?x=/es/", "/fr/#a", "/de/2", "?q", "#h/x", "x"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/x", "://", "a://b.a.org/x://c", "http://a.org/x", "http://a.org/x"]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge(pages, rules).collect()}
    assert got == {i: plain_rule(u, rules) for i, u in enumerate(urls)}
    assert url_rules.judge(pages.where("false")).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, ()).collect()} == {"allow"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_ngram_jaccard", "op3_exact_dedup", "op4_token_rollup", "op6_mixing", "op8_url_rules"])
def test_query_against_sql(spark, name):
    from breakweave.llm import queries

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.SQL[name]).df()
    rows = lambda d: sorted(tuple(str(v) for v in r) for r in d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    """Each stage's decision by a plain version over what the stage before kept."""
    import corpus_pipeline as pipeline

    from .test_dedup import plain_components
    from .test_encoding import plain_bpe

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.score for r in quality.scores(docs, quality.fit(docs, labels)).collect()}
    left = {r.doc_id: r.text for r in docs.collect() if scored[r.doc_id] >= 0.5}
    seen: dict[str, int] = {}
    for i in sorted(left):
        seen.setdefault(" ".join(left[i].split()), i)
    left = {i: left[i] for i in sorted(seen.values())}
    ids = list(left)
    comps = plain_components([left[i] for i in ids])
    left = {ids[k]: left[ids[k]] for k, (_, c) in comps.items() if k == c}
    kept = docs.where(F.col("doc_id").isin(list(left)))
    chosen = {r.doc_id for r in mixing.mix(kept).where("sampled").collect()}
    got = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(got) == chosen and 0 < len(chosen) < len(left)
    for i in list(got)[:60]:
        assert got[i].ids == plain_bpe(left[i])[0] and got[i].n_tokens == len(got[i].ids)
