"""The numbered queries, each a thin layer over its operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, language_id, line_dedup, periodic_runs, quality_model
from . import quality_rules as rules
from . import simhash, suffix_dedup, suffix_tree, token_files, toxicity
from .common import bucket_of, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.filter(~_held_out(3, 1)))
    return language_id.identify(docs.select("doc_id", "text"), net).select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels.filter(~_held_out(5, 0)))
    return quality_model.score(docs.select("doc_id", "text"), model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, *at), *at)
    return both.select("doc_id", bpe.n_ids().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, n_windows, share, exact, class_id, variant_id, n_items) of each contaminated document and class of
    benchmark items."""
    return decontaminate.class_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _held_out(modulus: int, remainder: int):
    return F.coalesce(bucket_of("doc_id", modulus) == remainder, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~_held_out(4, 2)))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _held_out(5, 1).alias("held_out"))
    return suffix_tree.train_and_score(spark, docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the token files that were written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of each document (some of them planted by the id, see ``with_tails``) and digests of runs and collapsed text."""
    docs = periodic_runs.with_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("m"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * m.length) div (-m.q)")
    return out.select("doc_id", "n_runs", (-F.col("m.s")).alias("start"), F.col("m.length").alias("length"), (-F.col("m.q")).alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language by how much more often their words occur together than apart."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_bpe, op3_quality_model, op4_quality_rules, op5_suffix_dedup, op6_simhash, op7_decontaminate, op8_line_dedup, op9_toxicity, op10_suffix_tree, op11_token_files, op12_periodic_runs, op13_collocations)}
ORACLE_SQL = {"op4_quality_rules": rules.oracle(), "op13_collocations": collocations.oracle()}
