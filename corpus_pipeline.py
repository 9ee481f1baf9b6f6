"""The corpus pipeline: toxicity, n-gram Jaccard join, suffix-array dedup, PII, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next stage's docs. All but the last return the columns that they are given. Stages work on every row they get:

- toxicity drops documents whose score is 0.5 or more; its model learns from the labelled documents of sf_dir.
- jaccard_join takes rows that differ in doc_id or text as documents of their own, and keeps one row of each document and,
  of each group of near copies (five-word shingles, similarity 0.8 or more), the document with the smallest doc_id.
  Documents without words are in no group and stay.
- repeated_spans cuts strings of 200 bytes that stand more than once out of the texts.
- pii replaces personal data by marks and sanitises terms that disclose it.
- packing returns the token pieces and their places in sequences of at most 4096 tokens.

Null doc_ids count as ids of their own, after all others; null and empty texts stay as they are and pack as one end id.
Very long texts, repeated rows, empty tables and further columns, whatever their names, go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import common, jaccard, packing, pii, repeats, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose toxicity score is under 0.5, row by row (null text: empty). Fitted like op4, outside its held-out fold."""
    labels = common.table(spark, sf_dir, "labels").where(common.bucket_of("doc_id", 5) != 0)
    model = toxicity.fit(common.table(spark, sf_dir, "documents"), labels, "toxic")
    kept = toxicity.scored(docs, model).where("__score < 0.5")
    return kept.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, of smallest doc_id (then of least hash); equal rows are such a group, too.

    Rows are joined by a hash of doc_id and text. Rows that share a doc_id but no text are judged apart, and rows with a null
    doc_id as well. Of rows that are equal in both one stays, that of least hash over all columns.
    """
    common.bounded_batches(spark)
    since = common.mark()
    uid = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    rows = docs.withColumn("__uid", uid)
    found = jaccard.jaccard_components(rows.select(F.col("__uid").alias("doc_id"), "text"))
    ids = rows.groupBy("__uid").agg(F.first(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("id"), F.count("*").alias("__rows"))
    groups = ids.join(found.select(F.col("doc_id").alias("__uid"), "component_id").distinct(), "__uid")
    firsts = groups.groupBy("component_id").agg(F.min(F.struct("id", "__uid")).alias("first")).select(F.col("first.__uid").alias("__uid"), F.lit(True).alias("__stays"))
    # what goes, and what there is more than once: most rows are neither
    told = groups.join(firsts, "__uid", "left").where("__stays is null or __rows > 1").select("__uid", F.coalesce("__stays", F.lit(False)).alias("__stays"), "__rows")
    told = common.materialise(told, "told")
    common.tidy(since, told)
    bitmap = common.bitmap_of(told.select(F.col("__uid").alias("key")))
    near = common.split_join(common.likely(rows, F.col("__uid"), bitmap), told, ["__uid"], "__rows", F.monotonically_increasing_id(), "left").where(F.coalesce("__stays", F.lit(True)))
    several = F.coalesce(F.col("__rows"), F.lit(1)) > 1
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    once = near.where(several).withColumn("__n", F.row_number().over(Window.partitionBy("__uid").orderBy(every))).where("__n = 1")
    parts = common.likely(rows, F.col("__uid"), bitmap, wanted=False), near.where(~several), once
    return parts[0].select(*docs.columns).unionAll(parts[1].select(*docs.columns)).unionAll(parts[2].select(*docs.columns))


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where both are there."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without strings of 200 bytes that start more than once. All rows stay, empty and null texts as they are."""
    common.bounded_batches(spark)
    return counted(repeats.remove_repeats(docs))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data and what discloses it replaced. All rows stay; rows without any, and null texts, as they are."""
    return counted(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; null and empty texts are one piece, repeated rows are packed each."""
    import public_tokenizers

    common.bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("jaccard_join", one_of_each_group), ("repeated_spans", cut_repeats), ("pii", sanitise), ("packing", pack)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read by the next; what is done with is deleted."""
    docs = common.table(spark, sf_dir, "documents")
    since = common.mark()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, f"stage-{name}")
        common.tidy(since, docs)
    return docs
