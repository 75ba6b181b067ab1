"""A training corpus from raw documents, stage by stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the
docs of the next stage.  All stages but the last return the columns of
documents.  ``run`` applies them to the documents table.

1. quality classifier: importance resampling; documents that it rejects go.
2. SimHash near-dedup over 5-word shingles: candidates by fingerprints, links at
   an exact similarity of 0.8 and more (``similar``): of each group of
   near-duplicates the document with the smallest doc_id stays.
3. secret scans: secrets are masked in the text; no document goes.
4. mixing sources to target weights: documents are repeated, or left out, by
   their source's repetition rate.
5. SentencePiece encoding: ids of each text, and the text that they give back.

No stage is one that SQL can express as a whole (fitted models, tokenizer), so
``ORACLE_SQL`` is None and the tests compare each stage with a brute-force
version.  An empty table gives an empty result; nulls are as each operator's
module says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import importance, mixing, piece_codec, secret_scan, similar
from larkspur.llm.shared import aside, back, discard, materialise, places, table

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents; fitted on the labels of ``sf_dir`` and on all of ``docs``."""
    return importance.take(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are counted once, for the sources' targets; which documents are taken then depends on id and source only."""
    targets = materialise(mixing.source_targets(mixing.with_sizes(docs.select("source", "text"))), "targets")
    dealt = mixing.with_copies(aside(docs, "doc_id", "source"), targets)
    return back(mixing.expand(dealt, list(places(docs.columns))), docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256, decoded_sha256."""
    coded = piece_codec.round_trip(docs, public_tokenizers.path(piece_codec.MODEL), keys=("doc_id", "source"))
    return coded.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
