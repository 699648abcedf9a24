"""The queries of this subpackage, by name, and the SQL that must agree with them."""

from __future__ import annotations

from . import embedding_dedup, language_model, licenses, mixing, pieces, prefix_trie, quality, sharding, simhash, topk, toxicity, url_filters, whitening
from .shared import read

#: A public model file of the machine's; a parameter of the operator, never part of this repository.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_feistel_sharding(spark, sf_dir):
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op2_multi_index_near_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def op3_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_fuzzy_license_scan(spark, sf_dir):
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op5_pitman_yor_scores(spark, sf_dir):
    return language_model.score_documents(read(spark, sf_dir, "documents"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op7_norm_bucket_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op8_pu_quality(spark, sf_dir):
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_lexicon_toxicity(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(read(spark, sf_dir, "documents"), MODEL)


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_nodes(read(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark, sf_dir):
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op13_url_filters(spark, sf_dir):
    return url_filters.judge(read(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (
        op1_feistel_sharding,
        op2_multi_index_near_dedup,
        op3_simhash_near_dedup,
        op4_fuzzy_license_scan,
        op5_pitman_yor_scores,
        op6_source_mixing,
        op7_norm_bucket_top_k,
        op8_pu_quality,
        op9_lexicon_toxicity,
        op10_sentencepiece,
        op11_prefix_trie,
        op12_embedding_whitening,
        op13_url_filters,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql():
    return {
        "op2_multi_index_near_dedup": embedding_dedup.ORACLE,
        "op6_source_mixing": mixing.ORACLE,
        "op7_norm_bucket_top_k": topk.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op13_url_filters": url_filters.ORACLE,
    }
