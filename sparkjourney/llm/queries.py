"""The registered queries: each numbered operator over its whole table, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from sparkjourney.llm import (bpe_stream, chat_perspectives, chunk_fingerprint, decontaminate, host_reputation, language_id, line_dedup, merkle,
                              ngram_join, ranked_search, secret_grammar, site_templates, token_counts)
from sparkjourney.sources import read_table as table


def op1_chat_perspectives(spark, sf_dir):
    return chat_perspectives.with_written_spans(chat_perspectives.perspectives(table(spark, sf_dir, "conversations")))


def op2_bpe_stream(spark, sf_dir):
    return bpe_stream.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_fingerprints(spark, sf_dir):
    return chunk_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_main_text(spark, sf_dir):
    return site_templates.main_texts(table(spark, sf_dir, "pages"))


def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op7_secrets(spark, sf_dir):
    return secret_grammar.span_digests(secret_grammar.find_secrets(table(spark, sf_dir, "documents")))


def op8_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_host_reputation(spark, sf_dir):
    return host_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_line_dedup(spark, sf_dir):
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat_perspectives, op2_bpe_stream, op3_decontaminate, op4_fingerprints, op5_main_text, op6_language,
                                   op7_secrets, op8_ngram_join, op9_host_reputation, op10_token_counts, op11_line_dedup, op12_ranked_search,
                                   op13_merkle_manifest)} | {"pipeline": corpus_pipeline.run}
ORACLE = {"op1_chat_perspectives": chat_perspectives.perspectives_sql(), "op9_host_reputation": host_reputation.judge_sql(),
          "op11_line_dedup": line_dedup.line_digests_sql(), "op12_ranked_search": ranked_search.ranked_sql(), "op13_merkle_manifest": merkle.manifest_sql()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
