"""A training corpus from raw documents: clean, deduplicate, mix, pack.

STAGES run one after another; each gets what the one before kept, written as Parquet and read
again, and all but the last return the columns of documents.

Defined cases, by stage: a null text counts as empty (not toxic, one empty line, no duplicate, no
words, one token of the pack); a null id is an id like others, after all others; rows that repeat an
id are rows of their own to toxicity, lines and packing, stay or go together as duplicates, and are
mixed alike if their texts are equal, too; a null source is one of its own; other columns pass
through; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import line_dedup, mixing, ngram_join, packing, toxicity
from barloom.llm.common import keep
from barloom.llm.queries import TOKENIZERS, table

#: SQL has no recurrent network and no tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict as toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return keep(toxicity.score(docs, model).where("predicted = 0").select(*docs.columns), "scored")  # a job of its own, with batches of bounded size


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document has."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the document with the smallest id; documents without words are no duplicates."""
    stay = ngram_join.join_components(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words stay once."""
    mixed = mixing.mix(docs, with_row=True)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    return mixed.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", one_of_each_group),
    ("source_mix", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
