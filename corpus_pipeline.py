"""The corpus pipeline: quality, line dedup, near dedup, source mix and encoding, each stage over all that is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result to the shared folder and reads it again for the next one.

Defined cases, of every stage: null and empty texts are documents like others (of log weight 0, without repeated lines,
like no other, with a place in the mix and without tokens); long texts are taken whole; an empty table gives an empty table; columns
besides doc_id, text, source, lang and n_chars pass through all stages but the last. Rows that repeat an id: quality
judges each by its own text, with one noise; line_dedup counts them as one document; near_dedup keeps one row of those
alike; source_mix and bpe give each a place and ids of its own. Rows without an id: no noise, lines stay, never near
another. Ties: sort keys at the threshold are all kept; of equal rows either stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, line_dedup, minhash_dedup, quality, source_mix
from tessera.llm.common import materialise, table
from tessera.llm.queries import target_weight

#: Stages that SQL cannot express: resampling, sketching and encoding. The pipeline is tested against a brute-force version.
ORACLE_SQL = None


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns that are named like a stage's own put aside, and how to name them again."""
    own = {f"__aside_{n}": n for n in names if n in docs.columns}
    return docs.withColumnsRenamed({v: k for k, v in own.items()}), own


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    docs, own = aside(docs, "log_weight", "sort_key", "kept", "__id", "__label", "__unseen")
    scored = quality.resampled(docs, table(spark, sf_dir, "labels"))
    return scored.where("kept").select(*docs.columns).withColumnsRenamed(own)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; n_chars follows. Documents that lose all their lines stay, as empty texts."""
    docs, own = aside(docs, "kept", "n_lines", "n_dropped", "__id", "__digests")
    left = line_dedup.drop_repeated(docs)
    text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept"))
    return left.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns).withColumnsRenamed(own)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of least id."""
    docs, own = aside(docs, "__id", "__key")
    return minhash_dedup.one_of_each(docs).withColumnsRenamed(own)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix, which gives sources shares by their target weights while they last."""
    docs, own = aside(docs, "slot", "position", *source_mix.OWN)
    return source_mix.laid_out(source_mix.mixed(docs, target_weight), docs.columns).withColumnsRenamed(own)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit), their number and digest, and the digest of the decoded text, with its slot and position in the mix.

    Rows lose their order where files are read again; the mix depends on the documents alone, so it is dealt again here.
    """
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(source_mix.mixed(docs, target_weight).select("doc_id", "lang", "source", "text", "slot", "position"), path).select(
        "doc_id",
        "lang",
        "source",
        "slot",
        "position",
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("source_mix", mix_stage), ("bpe", bpe_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
