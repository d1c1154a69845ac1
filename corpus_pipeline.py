"""Corpus pipeline: five stages from documents to token files, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import cut, in_fraction, read
from harrow.llm.decontaminate import find
from harrow.llm.jaccard import drop_similar
from harrow.llm.mixing import expand, mix
from harrow.llm.tokens import read_tokens, write_tokens
from harrow.llm.toxicity import toxicity
from harrow.sources.sinks import scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic. The machine learns from the stage's own labelled rows whose
    crc32(doc_id as text) mod 4 is not 2."""
    judged = toxicity(docs, docs.filter(~in_fraction("doc_id", 4, 2)), read(spark, sf_dir, "labels"))
    return judged.filter("predicted = 0").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id: links of the trie of SimHash fingerprints that an
    exact check (Jaccard similarity of 5-word shingles of 0.8 or more) confirms, and similar texts that the trie cannot reach."""
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that lie in a benchmark window are cut out of the text and n_chars follows; documents of which
    no word is left go, untouched documents stay as they are."""
    found = find(docs, read(spark, sf_dir, "benchmark"), clean=True)
    hit = F.size("spans") > 0
    left = F.regexp_like("kept", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    new = {"text": F.col("kept"), "n_chars": F.when(hit, F.length("kept")).otherwise(F.col("row.n_chars")).cast("long")}
    return found.filter(~hit | left).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target asks for."""
    return expand(mix(docs)).select("row.*")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(spark, "token_files")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", one_of_each_group),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]

#: No SQL for a learned score and a tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
