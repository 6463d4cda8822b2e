"""From documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. The
quality model is fitted on labelled rows of the documents table, the other stages look at their own input alone.
"""

from __future__ import annotations

import public_tokenizers

from tidewater.llm import mixing, ngram_join, packing, quality, substring_dedup
from tidewater.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark, docs, sf_dir):
    """Drop documents that the quality model rejects. Repeated ids are judged row by row on (doc_id, text)."""
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs.select(COLUMNS), model)


def one_of_each_group(spark, docs, sf_dir):
    """Keep one row of each component, the one with the smallest id; documents without shingles stay."""
    return ngram_join.one_of_each(docs.select(COLUMNS))


def without_repeats(spark, docs, sf_dir):
    """Cut repeated substrings out of the texts that hold some; the others stay as they are."""
    return substring_dedup.clean(docs.select(COLUMNS))


def mixed(spark, docs, sf_dir):
    """Repeat documents of small sources up to one and a half times, leaving none out."""
    return mixing.mix(docs.select(COLUMNS), repetition_limit=1.5, keep_all=True).select(COLUMNS)


def packed(spark, docs, sf_dir):
    """Pack the documents into sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", one_of_each_group), ("substring dedup", without_repeats), ("mixing sources to target weights", mixed), ("best-fit packing", packed)]

#: A conditional random field and a tokenizer are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
