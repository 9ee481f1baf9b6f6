"""Sinks: BED, GFF, tables, one folder a segment. The *_rows functions give the lines as columns; write_* store them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.genome import is_reverse, numbered


def bed_rows(df: DataFrame, name: str | None = None, score: str | None = None, prefix: str = "") -> DataFrame:
    """chr, start, end, name, score, strand of BED: 0-based starts, chr%02d for numbers, names id1, id2, ... and 0 where there are none."""
    number = df.schema["chr"].dataType.typeName() in ("integer", "long", "short")
    text = F.format_string("chr%02d", "chr") if number else F.concat(F.lit("chr"), F.col("chr"))
    if name is None:
        df = numbered(df, [F.col("chr")], F.least("start", "end"), ["id"], "__place")
    label = F.concat(F.lit("id"), F.col("__place").cast("string")) if name is None else F.col(name).cast("string")
    value = F.lit("0") if score is None else F.col(score).cast("string")
    return df.select(text.alias("chr"), (F.least("start", "end") - 1).alias("start"), F.greatest("start", "end").alias("end"), F.concat(F.lit(prefix), label).alias("name"), F.concat(F.lit(prefix), value).alias("score"), F.when(is_reverse(), "-").otherwise("+").alias("strand"))


def gff_attributes(columns: list[str], sep: str = "; ", notes: list[str] | None = None) -> Column:
    """key=value of the columns that have a value, then note="k:v" of the notes."""
    plain = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns]
    noted = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'note="{c}:'), F.col(c).cast("string"), F.lit('"'))) for c in notes or []]
    return F.concat_ws(sep, *plain, *noted)


def gff_rows(df: DataFrame, attributes: list[str], source: str = "loomspan", sep: str = "; ", notes: list[str] | None = None) -> DataFrame:
    """The nine columns: score and phase '.', phase 0 for CDS, whole chromosomes and plasmids are of type source."""
    kind = F.when(F.col("type").isin("chromosome", "plasmid"), "source").otherwise(F.col("type"))
    score = F.coalesce(F.col("score").cast("string"), F.lit(".")) if "score" in df.columns else F.lit(".")
    return df.select(F.col("chr").alias("seqname"), F.lit(source).alias("source"), kind.alias("feature"), "start", "end", score.alias("score"), "strand", F.when(F.col("type") == "CDS", "0").otherwise(".").alias("frame"), gff_attributes(attributes, sep, notes).alias("attributes"))


def write_rows(df: DataFrame, path: str, header: bool = False, na: str = "") -> None:
    df.write.option("sep", "\t").option("header", header).option("nullValue", na).option("emptyValue", "").option("quote", "\u0000").csv(path)


def write_bed(df: DataFrame, path: str, **options) -> None:
    write_rows(bed_rows(df, **options).orderBy("chr", "start"), path)


def write_gff(df: DataFrame, path: str, attributes: list[str], **options) -> None:
    write_rows(gff_rows(df, attributes, **options), path)


def write_segments(segments: DataFrame, data: DataFrame, path: str) -> None:
    """The data rows of each segment in its own folder, segment=<id>."""
    from loomspan.operators.intervals import segment_reads

    rows = segment_reads(segments, data)
    rows.withColumn("segment", F.col("t_id")).repartition("segment").write.partitionBy("segment").option("sep", "\t").option("header", True).csv(path)


def csv_to_parquet(spark, source: str, path: str, fill: float | None = None) -> None:
    df = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(source)
    (df if fill is None else df.fillna(fill)).write.parquet(path)
