"""A corpus pipeline: stages that each read their predecessor's documents as Parquet and pass on what they keep.

1. toxicity: documents whose restored text scores as toxic go; the labels of the folder's ``labels`` table are learned
   from the documents that the stage is given.
2. line dedup: each line that an earlier document (or an earlier place) has goes; documents that lose all lines go.
3. SimHash near-dedup: of each class of near-duplicates the document with the smallest id stays.
4. benchmark decontamination: documents that an item of ``benchmark`` contaminates go.
5. BPE: the remaining texts are encoded, decoded again and handed on with their ids.

All stages but the last return the columns of the documents they are given, whatever their names, with the caller's
values; n_chars is that of the text they return.

Cases, for every stage: a null text counts as empty; rows with a null id stay, as do empty texts (toxicity scores them like
others); of repeated rows line dedup and near-dedup keep the first lines and documents; texts are taken whole, whatever their
length; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import bpe, decontaminate, line_dedup, near_copies, toxicity
from driftloom.llm.common import shared_folder, table, unused

#: Words of a shingle; texts that share four fifths of their shingles are near copies, as are those whose fingerprints
#: over the shingles differ in two bits or less.
SHINGLE = 5


def _through(operator: Callable[[DataFrame], DataFrame], docs: DataFrame, keep: str, *made: str) -> DataFrame:
    """The rows of ``operator``, which adds the columns ``made``, for which ``keep`` holds, with the columns of ``docs``.

    Columns of the caller's that are named like those are set aside meanwhile."""
    aside = {c: unused(f"own_{c}", docs) for c in docs.columns if c.lower() in made}
    out = operator(docs.withColumnsRenamed(aside)).filter(keep)
    return out.drop(*made).withColumnsRenamed({v: k for k, v in aside.items()})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that score as toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _through(lambda d: toxicity.score(d, model), docs, "predicted = 0", "score", "predicted").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without repeated lines; a document of which nothing is left goes."""

    def cut(d: DataFrame) -> DataFrame:
        out = line_dedup.dedup(d)
        if "n_chars" not in d.columns:
            return out
        return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(d.schema["n_chars"].dataType))

    return _through(cut, docs, "n_removed < n_lines or n_lines = 0", "n_lines", "n_removed").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return near_copies.keep_first(docs, words=SHINGLE)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that hold benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of each document; ids are little-endian unsigned 32-bit integers."""
    at = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text"), *at), *at)
    return both.select("doc_id", bpe.n_ids().alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("bpe", tokenize),
]

#: The stages are not expressible in SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written as Parquet to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
