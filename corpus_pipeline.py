"""The training-data pipeline: documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

import uuid

import public_tokenizers

from sparkjourney.llm import bpe_stream, decontaminate, language_id, ngram_join, secret_grammar
from sparkjourney.llm.common import release, shared_folder
from sparkjourney.sources import read_table


def languages(spark, docs, sf_dir):
    """Drops documents without a language; ``lang`` becomes the identified one, which
    corrects wrong labels and fills in missing ones."""
    return language_id.identified(docs, language_id.fit(docs))


def near_duplicates(spark, docs, sf_dir):
    """Keeps the smallest doc_id of each group of linked documents."""
    return ngram_join.one_of_each(docs)


def benchmark_free(spark, docs, sf_dir):
    """Drops documents that hold a benchmark passage."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark, docs, sf_dir):
    """Replaces secrets in the texts by marks."""
    return secret_grammar.redacted(docs)


def tokens(spark, docs, sf_dir):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document left."""
    return bpe_stream.token_digests(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("language", languages), ("near_duplicates", near_duplicates), ("benchmark", benchmark_free), ("secrets", without_secrets), ("tokens", tokens)]
#: Fitted models, Unicode normalisation and merging are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's frame; each stage before it is written as Parquet, into a fresh
    folder under ``spark.checkpoint.dir``, and read back as the next one's docs.  A
    stage's files go once the next one's are written, the last ones with the driver."""
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(path(folder))
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        release(spark)
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            store.delete(path(f"{folder}/{before}"), True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
