"""The training-corpus pipeline: toxicity, near-duplicates, secrets, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm import bpe, minhash, mixing, secrets, toxicity
from factweave.llm.common import WORD, read, shared_folder, text_column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its decision; it learns from the training folds. A
    classifier without features (no labels, or none that tell) rejects no document."""
    model = toxicity.fit(docs.where(toxicity.fold_of("doc_id") != 2), read(spark, sf_dir, "labels"))
    if not len(model.weight):
        return docs
    return toxicity.score(docs, model, out="__toxicity").where(F.col("__toxicity") < toxicity.DECISION).select(docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of docs with __key, a hash of the text, and __tie, one of the other columns."""
    others = F.to_json(F.struct(*[docs[c] for c in docs.columns if c != "text"]))
    return docs.withColumn("__tie", F.xxhash64(others)).withColumn("__key", F.xxhash64(text_column()))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the least id (nulls last) and, of rows of one id, the least
    by hashes of the text and of the other columns; of rows alike in every way one. Documents
    without a word are in no group and stay. Links are of 5-word shingles and a similarity of 0.8."""
    grouped = minhash.with_groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = grouped.where("group is not null").groupBy("group").agg(F.min(order).alias("kept")).select("kept.doc_id", F.col("kept.key").alias("__key"))
    keyed = _keyed(docs)
    # which of the rows that share id and text: one of them, found without its text
    chosen = keyed.select("doc_id", "__key", "__tie").alias("d").join(kept.alias("k"), F.expr("d.__key = k.__key and d.doc_id <=> k.doc_id")).groupBy("d.doc_id", "d.__key").agg(F.min("__tie").alias("__tie"), F.count("*").alias("__times"))
    rows = keyed.join(chosen.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), F.col("__tie").alias("__t"), "__times"), F.expr("__key = __k and __tie = __t and doc_id <=> __id"))
    once = rows.where("__times = 1").select(docs.columns)
    several = rows.where("__times > 1").dropDuplicates(["__id", "__k", "__t"]).select(docs.columns)
    return once.union(several).union(docs.where(~F.regexp_like(text_column(), F.lit(WORD))))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts overwritten."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that share id, source and text share what the
    mix takes of them, dealt in the order of a hash of the other columns."""
    taken = mixing.mix(docs.select("doc_id", "source", "text"), keep_source=True).groupBy("doc_id", "source", "key").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0")
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("key").alias("__k"), "__copies", "__rows")
    rows = _keyed(docs).join(taken, F.expr("__key = __k and doc_id <=> __id and source <=> __source"))
    copies = F.col("__copies").cast("int")
    one = rows.where("__rows = 1").withColumn("__n", copies)
    several = rows.where("__rows > 1").withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__source", "__k").orderBy("__tie")))
    several = several.withColumn("__n", F.floor(copies / F.col("__rows")).cast("int") + (F.col("__nth") <= copies % F.col("__rows")).cast("int")).where("__n > 0").drop("__nth")
    return one.union(several).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document doc_id, n_tokens, ids_sha256 and decoded_sha256; null text counts as empty, repeated
    rows are encoded alike, other columns are ignored."""
    import public_tokenizers

    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: The classifier and the merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
