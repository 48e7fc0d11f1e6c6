"""What the entry module registers for these operators: thin queries with production parameters, and their SQL."""

from __future__ import annotations

from . import bpe_chunks, exact_dedup, language_id, lm_scoring, media, mixing, ngram_jaccard, quality, token_alignment, token_rollup, toxicity, url_rules
from .common import table


def op1_webp_media(spark, sf_dir):
    return media.digests(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_token_rollup(spark, sf_dir):
    return token_rollup.rollup_of(table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_url_rules(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op9_bpe_chunks(spark, sf_dir):
    return bpe_chunks.encoded_digests(table(spark, sf_dir, "documents"), bpe_chunks.default_path())


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_lm_scoring(spark, sf_dir):
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark, sf_dir):
    return token_alignment.aligned_documents(table(spark, sf_dir, "documents"), *token_alignment.default_paths())


QUERIES = {f.__name__: f for f in (op1_webp_media, op2_ngram_jaccard, op3_exact_dedup, op4_token_rollup, op5_language_id, op6_mixing, op7_quality, op8_url_rules, op9_bpe_chunks, op10_toxicity, op11_lm_scoring, op12_token_alignment)}
SQL = {
    "op2_ngram_jaccard": ngram_jaccard.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_token_rollup": token_rollup.SQL,
    "op6_mixing": mixing.sql(),
    "op8_url_rules": url_rules.SQL,
    "op11_lm_scoring": lm_scoring.SQL,
}
